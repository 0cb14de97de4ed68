"""Operator 4: exact substring dedup by a distributed, common-prefix-aware merge sort of suffixes.

Every byte that a string of ``LENGTH`` bytes covers is removed if the same string starts earlier in
the corpus. The strings are the suffixes of the texts cut to that length; equal ones are neighbours
in sorted order. Sorting all of them would move a hundred times the corpus, so they are sorted in
blocks, and in rounds that get finer:

* A window (a string of ``LENGTH`` bytes) is assigned to the place of the least hash among its
  ``k``-grams. Neighbouring windows of one place form a block: the suffix at the first window, cut at
  the end of the last. Which block a window belongs to is decided by its own bytes, so equal windows
  lie in blocks with an equal ``k``-gram at that place.
* Blocks whose ``k``-gram occurs once in the corpus hold no repeated window. They are found by an
  exchange of hashes and go no further.
* Each task sorts its other blocks into runs, and runs are exchanged front-coded: the length of the
  prefix shared with the predecessor, and the rest. Ranges of strings, cut by a bounded sample, are the
  buckets of the exchange, dealt further by a digest where ranges are not enough; there are as many as the bytes of the blocks
  ask for. Equal blocks of a run travel once, so a string that is everywhere is a row a run; the other places
  are repeats, and pass the merge by.
* A loser tree merges the runs of a bucket; it keeps, for each head, the prefix shared with the last
  winner, so known prefixes are never compared again. The merge streams: it holds the coded runs of
  one bucket and the last block.
* All but the earliest of equal blocks repeat in all their windows. Different blocks with one
  ``k``-gram can share some of their windows, so the earliest of each goes to the next round with a
  larger ``k``; with ``k = LENGTH`` a block is a single window and nothing is left open.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialize, shuffle_partitions

LENGTH = 100
#: Lengths of the grams that assign windows, round by round.
ROUNDS = (50, 84, 100)
#: Bytes hashed together, windows in a segment of a long text, bytes whose hashes are exchanged together, and blocks sorted in one run.
CHUNK_BYTES = 1 << 18
SEGMENT_BYTES = 1 << 24
BATCH_BYTES = 1 << 25
RUN_BLOCKS = 1 << 17
#: Bytes of text whose hashes make a bucket of their exchange, and bytes of blocks that make a bucket of runs.
HASH_BUCKET_BYTES = 1 << 28
RUN_BUCKET_BYTES = 1 << 25
#: Blocks drawn for each bucket to find where buckets end, and at most; they pass the driver.
DRAWN_A_BUCKET, DRAWN = 16, 200_000
#: Keys over which repeats that pass the merge by are dealt.
ASIDE = 1 << 20
#: The texts of one id are told apart by the bits of a place beyond these.
VERSION_BITS = 40

#: Random values of the bytes, and the multiplier of the polynomial hash.
BYTE_VALUES = np.random.default_rng(20240101).integers(0, 2**64, 256, dtype=np.uint64)
MULTIPLIER = 0x9E3779B97F4A7C15
PLACE_BITS = np.uint64(26)
PLACE = np.uint64((1 << 26) - 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-grams, by doubling: a gram of twice the length is made of two."""
    found, found_length, power, length, left = None, 0, BYTE_VALUES[data], 1, k
    while True:
        step = np.uint64(pow(MULTIPLIER, length, 1 << 64))
        if left & 1:
            if found is None:
                found = power
            else:
                n = len(data) - found_length - length + 1
                found = found[:n] * step + power[found_length : found_length + n]
            found_length += length
        left >>= 1
        if not left:
            break
        n = len(power) - length
        power = power[:n] * step + power[length:]
        length *= 2
    mixed = found ^ (found >> np.uint64(32))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def blocks(data: np.ndarray, ends: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, windows, hash)`` of the blocks of texts that lie one after another and end at ``ends``."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty.astype(np.uint64)
    hashes = gram_hashes(data, k)
    places = np.arange(len(hashes), dtype=np.uint64)
    least, width = (hashes & ~PLACE) | places, 1
    wanted = length - k + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        rest = wanted - width
        least = np.minimum(least[:-rest], least[rest:])
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(least) + 1, dtype=np.int8)  # +1 where windows of a text begin, -1 after the last
    last = np.maximum(ends - length + 1, starts)
    np.add.at(inside, np.minimum(starts, len(least)), 1)
    np.add.at(inside, np.minimum(last, len(least)), -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return empty, empty, empty.astype(np.uint64)
    place = (least[windows] & PLACE).astype(np.int64)
    first = np.concatenate(([True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)))
    at = np.flatnonzero(first)
    return windows[at], np.diff(np.append(at, len(windows))), hashes[place[at]]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """Segments ``(doc, base, text, extra)`` of about ``CHUNK_BYTES`` together."""
    docs, bases, texts, extras, size = [], [], [], [], 0
    for batch in batches:
        extra = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for doc, base, text, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), extra, strict=True):
            if text is None or len(text) < LENGTH:
                continue
            docs.append(doc)
            bases.append(base)
            texts.append(text)
            extras.append(more)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield docs, bases, texts, extras
                docs, bases, texts, extras, size = [], [], [], [], 0
    if docs:
        yield docs, bases, texts, extras


def chunk_blocks(texts: list[bytes], k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, their ends, the blocks, and the number of blocks of each text."""
    joined = b"".join(texts)
    ends = np.cumsum([len(text) for text in texts])
    start, windows, hashes = blocks(np.frombuffer(joined, np.uint8), ends, k)
    counts = np.diff(np.searchsorted(start, ends, side="left"), prepend=0)
    return joined, ends, start, windows, hashes, counts


HASHES, DIRECTORY, REPEATED = 0, 1, 2
EXCHANGE = "key int, batch long, kind int, a binary, b binary"
EXCHANGE_NAMES = ["key", "batch", "kind", "a", "b"]


def exchange_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], names=EXCHANGE_NAMES)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches, by the value of a column."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            value = row[batch.schema.names[column]]
            if value != key and rows:
                yield key, rows
                rows = []
            key = value
            rows.append(row)
    if rows:
        yield key, rows


def repeated_blocks(segments: DataFrame, k: int, size: int) -> DataFrame:
    """``(doc, base, own binary)``: the numbers of the blocks of each segment whose gram occurs again; ``size`` is the bytes of all texts.

    A task sends each hash of its batch once, so a gram that is everywhere costs a row a batch.
    """
    parts = shuffle_partitions(segments.sparkSession)
    buckets = max(parts, -(-size // HASH_BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, hashes, docs, bases, counts = 0, 0, [], [], [], []

        def flush() -> pa.RecordBatch:
            batch = (TaskContext.get().partitionId() << 32) + number
            values = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            order = np.argsort(values, kind="stable")
            ordered = values[order]
            first = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
            same = np.append(ordered[1:] == ordered[:-1], False) | ~first if len(ordered) else first
            rows = [
                (batch % buckets, batch, DIRECTORY, np.array(docs, "<i8").tobytes() + np.array(bases, "<i8").tobytes(), np.array(counts, "<u4").tobytes()),
                (batch % buckets, batch, REPEATED, b"", order[same].astype("<u4").tobytes()),
            ]
            sent, at = ordered[first], order[first]
            own = bucket_of(sent, buckets)
            by = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[by], np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                part = by[cuts[bucket] : cuts[bucket + 1]]
                rows.append((bucket, batch, HASHES, (sent[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), at[part].astype("<u4").tobytes()))
            return exchange_rows(rows)

        for c_docs, c_bases, texts, _ in chunks(batches):
            _, _, _, _, own, count = chunk_blocks(texts, k)
            hashes.append(own)
            docs += c_docs
            bases += c_bases
            counts += count.tolist()
            size += sum(map(len, texts))
            if size >= BATCH_BYTES:
                yield flush()
                number, size = number + 1, 0
                hashes, docs, bases, counts = [], [], [], []
        if docs:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, 0):
            out = [(key, row["batch"], row["kind"], row["a"], row["b"]) for row in rows if row["kind"] != HASHES]
            sent = [row for row in rows if row["kind"] == HASHES]
            if sent:
                hashes = np.concatenate([np.frombuffer(row["a"], "<u4") for row in sent])
                places = np.concatenate([np.frombuffer(row["b"], "<u4") for row in sent])
                owner = np.repeat(np.arange(len(sent)), [len(row["a"]) // 4 for row in sent])
                order = np.argsort(hashes, kind="stable")
                equal = hashes[order][1:] == hashes[order][:-1]
                again = order[np.append(equal, False) | np.append(False, equal)]
                again = again[np.argsort(owner[again], kind="stable")]
                cuts = np.searchsorted(owner[again], np.arange(len(sent) + 1))
                out += [(key, row["batch"], REPEATED, b"", places[again[cuts[n] : cuts[n + 1]]].tobytes()) for n, row in enumerate(sent) if cuts[n + 1] > cuts[n]]
            yield exchange_rows(out)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 1):
            listed = [row for row in rows if row["kind"] == DIRECTORY]
            counts = np.concatenate([np.frombuffer(row["b"], "<u4") for row in listed]).astype(np.int64)
            names = np.frombuffer(b"".join(row["a"] for row in listed), "<i8").reshape(2, -1)
            again = np.unique(np.concatenate([np.frombuffer(row["b"], "<u4") for row in rows if row["kind"] == REPEATED]).astype(np.int64))
            begins = np.cumsum(counts) - counts
            segment = np.searchsorted(begins + counts, again, side="right")
            cuts = np.searchsorted(segment, np.arange(len(counts) + 1))
            held = np.flatnonzero(np.diff(cuts))
            own = [(again[cuts[n] : cuts[n + 1]] - begins[n]).astype("<u4").tobytes() for n in held.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names[0][held]), pa.array(names[1][held]), pa.array(own, pa.binary())], names=["doc", "base", "own"])

    sent = segments.select("doc", "base", "text").mapInArrow(send, EXCHANGE).repartition(parts, "key").sortWithinPartitions("key")
    met = sent.mapInArrow(meet, EXCHANGE).repartition(parts, "batch").sortWithinPartitions("batch")
    return met.mapInArrow(resolve, "doc long, base long, own binary")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of strings that agree in ``known`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


RUN = "key int, shared binary, lengths binary, rest binary, docs binary, places binary, windows binary, grams binary"
RUN_NAMES = ["key", "shared", "lengths", "rest", "docs", "places", "windows", "grams"]


def run_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(column, pa.binary()) for column in columns[1:])], names=RUN_NAMES)


def wanted_blocks(texts: list[bytes], bases: list[int], owns: list[bytes], k: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The listed blocks of some segments: strings, places, windows, hashes of their grams, and the number of the segment of each."""
    joined, ends, start, windows, hashes, counts = chunk_blocks(texts, k)
    begins = np.cumsum(counts) - counts
    lists = [np.frombuffer(own, "<u4").astype(np.int64) for own in owns]
    lists = [own[own < count] for own, count in zip(lists, counts.tolist(), strict=True)]
    segment = np.repeat(np.arange(len(texts)), [len(own) for own in lists])
    wanted = np.concatenate([own + begin for own, begin in zip(lists, begins.tolist(), strict=True)])
    own_start = (ends - np.array([len(text) for text in texts]))[segment]
    at, n = start[wanted], windows[wanted]
    cut = [joined[a:b] for a, b in zip(at.tolist(), (at + n + LENGTH - 1).tolist(), strict=True)]
    return cut, np.array(bases, np.int64)[segment] + at - own_start, n, hashes[wanted], segment


def range_ends(met: DataFrame, blocks_there: int, k: int, buckets: int) -> list[bytes]:
    """The strings at which the buckets after the first begin: quantiles of a sample of the blocks, the same on each run.

    ``met`` is ``(doc, base, text, own)``. The sample is bounded by ``DRAWN``, whatever the table.
    """
    share = min(1.0, min(DRAWN, DRAWN_A_BUCKET * buckets) / max(blocks_there, 1))
    of_segments = min(1.0, 10 * share)
    of_blocks = share / of_segments

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, bases, texts, owns in chunks(batches):
            cut, places, _, _, segment = wanted_blocks(texts, bases, owns, k)
            mixed = (np.array(docs, np.int64)[segment] * 31 + places).view(np.uint64) * np.uint64(MULTIPLIER)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            drawn = np.flatnonzero((mixed >> np.uint64(11)).astype(np.float64) < of_blocks * 2.0**53)
            yield pa.RecordBatch.from_arrays([pa.array([cut[n] for n in drawn.tolist()], pa.binary())], names=["text"])

    some = met.where(F.shiftrightunsigned(F.xxhash64(F.lit(13), "doc", "base"), 2) <= int(of_segments * 2**62))
    found = sorted({row["text"] for row in some.mapInArrow(draw, "text binary").collect()})
    return sorted({found[len(found) * n // buckets] for n in range(1, buckets)}) if found else []


def sorted_runs(segments: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """Front-coded sorted runs of the blocks that may be repeated, a row for each bucket of a run.

    A bucket is a range of strings. The strings that bound the ranges pass the driver, so there are at most ``DRAWN // DRAWN_A_BUCKET``
    ranges; where a range would hold more than ``RUN_BUCKET_BYTES``, its strings are dealt to several buckets by a digest, each of them
    a sorted run still. Of equal blocks of one run only the earliest is sent on; the others are repeats already and
    pass the merge by: bare places in a row without strings, under a negative key that says nothing but where to lie.
    """
    parts = shuffle_partitions(segments.sparkSession)
    met = segments.join(repeated, ["doc", "base"]).select("doc", "base", "text", "own")
    there = int(repeated.agg(F.sum(F.octet_length("own") / 4)).first()[0] or 0)
    wanted = max(parts, -(-there * 3 * LENGTH // 2 // RUN_BUCKET_BYTES))
    buckets = min(wanted, DRAWN // DRAWN_A_BUCKET)
    deals = -(-wanted // buckets)
    ends = range_ends(met, there, k, buckets) if there else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            rows, at, bucket = [], 0, 0
            gone: list[tuple[int, int, int]] = []
            while at < len(held):
                while bucket < len(ends) and held[at][0] >= ends[bucket]:
                    bucket += 1
                stop = ends[bucket] if bucket < len(ends) else None
                begin = at
                while at < len(held) and (stop is None or held[at][0] < stop):
                    at += 1
                own = held[begin:at]
                if deals == 1:
                    rows.append(front_coded(bucket, own, gone))
                    continue
                dealt: dict[int, list[tuple[bytes, int, int, int, int]]] = {}
                for block in own:
                    dealt.setdefault(zlib.crc32(block[0]) % deals, []).append(block)
                rows += [front_coded(bucket * deals + deal, blocks, gone) for deal, blocks in dealt.items()]
            if gone:
                array = np.array(gone, "<i8")
                aside = zlib.crc32(array[0].tobytes()) % ASIDE
                rows.append((-1 - aside, b"", b"", b"", array[:, 0].tobytes(), array[:, 1].tobytes(), array[:, 2].astype(np.uint8).tobytes(), b""))
            held.clear()
            return run_rows(rows)

        for docs, bases, texts, owns in chunks(batches):
            cut, places, windows, grams, segment = wanted_blocks(texts, bases, owns, k)
            held += zip(cut, np.array(docs, np.int64)[segment].tolist(), places.tolist(), windows.tolist(), grams.view(np.int64).tolist(), strict=True)
            if len(held) >= RUN_BLOCKS:
                yield flush()
        if held:
            yield flush()

    return met.mapInArrow(run, RUN).repartition(parts, "key").sortWithinPartitions("key")


def front_coded(key: int, blocks: list[tuple[bytes, int, int, int, int]], gone: list[tuple[int, int, int]]) -> tuple:
    """A row of a run: the earliest of each string of sorted ``blocks``; the others are added to ``gone``."""
    before = b""
    shared, lengths, rest, docs, places, windows, grams = bytearray(), bytearray(), [], [], [], bytearray(), []
    for text, doc, place, n, gram in blocks:
        if text == before and docs:
            if (doc, place) != (docs[-1], places[-1]):
                gone.append((doc, place, n))
        else:
            same = common_prefix(before, text)
            shared.append(same)
            lengths.append(len(text) - same)
            rest.append(text[same:])
            docs.append(doc)
            places.append(place)
            windows.append(n)
            grams.append(gram)
            before = text
    return key, bytes(shared), bytes(lengths), b"".join(rest), np.array(docs, "<i8").tobytes(), np.array(places, "<i8").tobytes(), bytes(windows), np.array(grams, "<i8").tobytes()


class Run:
    """A front-coded run, read from its start; ``shared`` is the prefix that the head shares with the last winner."""

    __slots__ = ("at", "docs", "grams", "head", "lengths", "offset", "places", "rest", "row", "shared", "shares", "windows")

    def __init__(self, row: dict) -> None:
        self.shares, self.lengths, self.rest = row["shared"], row["lengths"], row["rest"]
        self.docs, self.places = np.frombuffer(row["docs"], "<i8").tolist(), np.frombuffer(row["places"], "<i8").tolist()
        self.windows, self.grams = row["windows"], np.frombuffer(row["grams"], "<i8").tolist()
        self.at, self.offset, self.head, self.shared = -1, 0, b"", 0
        self.advance()

    def advance(self) -> None:
        self.at += 1
        if self.at == len(self.lengths):
            self.head, self.shared = None, -1  # past the end: loses to all
            return
        self.shared = self.shares[self.at]
        end = self.offset + self.lengths[self.at]
        self.head = self.head[: self.shared] + self.rest[self.offset : end]
        self.offset = end


def merge(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """Runs in the order of their heads, with the prefix that each head shares with the one before.

    Of two heads that share different lengths with the last winner, the longer is the smaller string,
    without a look at either. Only heads that share equally much are compared, from there on; the
    loser then keeps what it shares with the new winner.
    """
    count = len(runs)
    if count == 0:
        return
    size = 1 << (count - 1).bit_length()
    losers: list[Run | None] = [None] * size

    def play(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        if b is None or b.head is None:
            return a, b
        if a is None or a.head is None:
            return b, a
        if a.shared != b.shared:
            return (a, b) if a.shared > b.shared else (b, a)
        same = common_prefix(a.head, b.head, a.shared)
        x, y = a.head, b.head
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            b.shared = same
            return a, b
        a.shared = same
        return b, a

    def first(node: int) -> Run | None:
        if node >= size:
            return runs[node - size] if node - size < count else None
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    leaf = {id(run): size + number for number, run in enumerate(runs)}
    winner = first(1)
    while winner is not None and winner.head is not None:
        yield winner, winner.shared
        node = leaf[id(winner)] >> 1
        winner.advance()
        while node:
            rival = losers[node]
            # The usual case without a call: one shares more with the last winner.
            if rival is None or rival.head is None:
                pass
            elif winner.head is None:
                winner, losers[node] = rival, winner
            elif rival.shared < winner.shared:
                pass
            elif rival.shared > winner.shared:
                winner, losers[node] = rival, winner
            else:
                winner, losers[node] = play(winner, rival)
            node >>= 1


OUTCOME = "doc long, place long, windows int, text binary, gram long"
#: Rows of the outcome that leave the merge together.
OUT_ROWS = 1 << 14


def merged(runs: DataFrame, further: bool) -> DataFrame:
    """``(doc, place, windows, text, gram)``: repeats (no text), and the earliest of equal blocks if there is a next round."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, bytes | None, int | None]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.int64())], names=["doc", "place", "windows", "text", "gram"])

        def rows_of(aside: bool) -> Iterator[dict]:
            """Rows in order: first those that pass the merge by, then the others."""
            nonlocal ahead
            for row in all_rows:
                if (row["key"] < 0) != aside:
                    ahead = row
                    return
                yield row

        all_rows = (row for batch in batches for row in batch.to_pylist())
        ahead: dict | None = None
        for row in rows_of(True):
            array = (np.frombuffer(row[name], kind).tolist() for name, kind in (("docs", "<i8"), ("places", "<i8"), ("windows", np.uint8)))
            out += ((doc, place, n, None, None) for doc, place, n in zip(*array, strict=True))
            if len(out) >= OUT_ROWS:
                yield batch()
        merging = itertools.chain([ahead] if ahead else [], rows_of(False))
        for _, rows in itertools.groupby(merging, key=lambda row: row["key"]):
            held = [Run(row) for row in rows]
            last: tuple | None = None  # the earliest of the equal blocks at hand
            for run, shared in merge(held):
                at, text = run.at, run.head
                own = (run.docs[at], run.places[at], run.windows[at], text, run.grams[at])
                if last is not None and shared == len(text) == len(last[3]):
                    if own[:2] < last[:2]:
                        own, last = last, own
                    if own[:2] != last[:2]:
                        out.append((*own[:3], None, None))
                else:
                    if last is not None and further:
                        out.append(last)
                    last = own
                if len(out) >= OUT_ROWS:
                    yield batch()
            if last is not None and further:
                out.append(last)
        yield batch()

    return runs.mapInArrow(combine, OUTCOME)


def still_open(outcome: DataFrame) -> DataFrame:
    """``(doc, base, text)``: blocks whose gram another block has too. A gram may be in a third of them."""
    blocks_left = outcome.where("text is not null").select("doc", F.col("place").alias("base"), "text", "gram")
    shared = materialize(blocks_left.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams")
    hot = F.broadcast(hot_keys(shared, "gram", "n", blocks_left.count()))
    rest = blocks_left.join(hot, "gram", "left_anti").join(shared.select("gram"), "gram", "left_semi")
    return blocks_left.join(hot, "gram", "left_semi").unionByName(rest).drop("gram")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(own, data, doc, version)``: the id as it is, the bytes, the id (null is the least), and the number of the text among those of the id, by digest from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("own"), F.encode(text, "UTF-8").alias("data"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.unhex(F.md5(text)).alias("digest"))
    pairs = keyed.select("doc", "digest")
    several = pairs.groupBy("doc").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("doc")
    order = Window.partitionBy("doc").orderBy("digest")
    versions = pairs.join(several, "doc", "left_semi").distinct().withColumn("version", F.row_number().over(order) - 1)
    versions = materialize(versions.where("version > 0"), "suffix-versions")
    return keyed.join(versions, ["doc", "digest"], "left").withColumn("version", F.coalesce("version", F.lit(0)).cast("long")).drop("digest")


def repeats(whole: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``(doc, place, windows)``: runs of windows of ``whole(doc, version, whole binary)`` that occur earlier.

    A place is the version, shifted by ``VERSION_BITS``, and the byte at which the first window begins.
    """
    whole = whole.where(F.octet_length("whole") >= LENGTH)
    # The windows of a very long text are dealt to several segments.
    bases = F.sequence(F.lit(0).cast("long"), (F.octet_length("whole") - LENGTH).cast("long"), F.lit(segment_bytes).cast("long"))
    cut = F.expr(f"substring(whole, cast(at + 1 as int), {segment_bytes + LENGTH - 1})")
    segments = whole.select("doc", "version", "whole", F.explode(bases).alias("at")).select("doc", (F.shiftleft("version", VERSION_BITS) + F.col("at")).alias("base"), cut.alias("text"))
    size, found = whole.agg(F.sum(F.octet_length("whole").cast("long"))).first()[0] or 0, None
    for k in ROUNDS:
        repeated = materialize(repeated_blocks(segments, k, size), "suffix-repeated")
        outcome = materialize(merged(sorted_runs(segments, repeated, k), k < LENGTH), "suffix-outcome")
        gone = outcome.where("text is null").select("doc", "place", "windows")
        found = gone if found is None else found.unionByName(gone)
        if k < LENGTH:
            segments = materialize(still_open(outcome), "suffix-open")
            size = segments.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return found


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept binary, spans``: every text without its repeated bytes.

    ``spans`` are the maximal removed runs ``start, end`` in bytes of the text as it was. Strings are
    judged on the input; matches never cross texts. Null texts count as empty and keep nothing;
    texts under 100 bytes stay as they are; longer ones than ``segment_bytes`` are judged in overlapping
    segments. Rows are named by id and text: rows that agree in both are one occurrence and get the same
    cuts, and of an id with several texts the one of the smaller digest counts as earlier. An empty table gives an
    empty one; other columns are ignored.
    """
    keyed = named(docs, id_col, text_col)
    windows = repeats(keyed.select("doc", "version", F.col("data").alias("whole")), segment_bytes)
    place = F.col("place").bitwiseAND(F.lit((1 << VERSION_BITS) - 1)).alias("place")
    per_doc = windows.groupBy("doc", F.shiftright("place", VERSION_BITS).alias("version")).agg(F.array_sort(F.collect_set(F.struct(place, "windows"))).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for data, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for row in gone or ():
                    start, end = row["place"], min(row["place"] + row["windows"] + LENGTH - 1, len(data))
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    elif start < end:
                        runs.append([start, end])
                parts, at = [], 0
                for start, end in runs:
                    parts.append(data[at:start])
                    at = end
                kept.append(b"".join((*parts, data[at:])))
                spans.append([{"start": start, "end": end} for start, end in runs])
            sizes = pa.array([len(data) for data in batch.column(1).to_pylist()], pa.int64())
            removed = pa.array([sum(span["end"] - span["start"] for span in own) for own in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, removed, pa.array([len(own) for own in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(data).hexdigest() for data in kept]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"],
            )

    met = keyed.join(per_doc, ["doc", "version"], "left").select("own", "data", "gone")
    kind = docs.schema[id_col].dataType.simpleString()
    return met.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start: long, end: long>>")
