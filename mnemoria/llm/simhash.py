"""Operator 8: SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``b`` bits differ in at most ``b`` of their eight
bytes, so they agree in at least ``8 - b`` byte positions: the guaranteed minimum of matches.

The plain index has a posting list for each position and byte, but each holds one fingerprint in 256,
and a list of three positions is the intersection of three of them. These intersections are indexed
instead. Nothing is lost: of five or more shared positions, three lie in one half of the eight, so
the pair meets in the list of that triple. A pair that meets there has a tally of three from the
index; the other five positions are tallied one after another, and the pair is dropped once it
can't reach ``8 - b`` any more. What reaches it is verified bit by bit.

Texts that are similar rather than equal but for a few words differ in too many bits for that: at a
Jaccard similarity of 0.8, in ten of 64. For them there is a wide fingerprint of 144 bytes in 48 groups of three,
and the minimum of matches is two byte positions of one group. The lists are the intersections of two positions
of a group, and what meets is verified by the bits of its first two words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex64, join_by_key, materialize, shuffle_partitions
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Of any five of the eight positions, three lie in one half: these eight triples meet every pair
#: that agrees in five positions, and a list of three bytes is short.
KEYS = tuple(triple for half in (range(4), range(4, 8)) for triple in combinations(half, 3))
#: The positions that a list says nothing of, as shifts.
OTHERS = np.array([[8 * position for position in range(8) if position not in triple] for triple in KEYS], dtype=np.uint64)
#: Longer lists are cut into tiles of about this size; every two tiles meet in a task of their own.
TILE = 1024
#: Fingerprint bits tallied at once.
TALLY_ROWS = 1 << 14
#: A wide fingerprint: 64-bit words, and the pairs of byte positions that have lists.
WIDE_WORDS = 18
WIDE_PAIRS = tuple(pair for first in range(0, 8 * WIDE_WORDS, 3) for pair in combinations(range(first, first + 3), 2))
#: Bits of the first two words in which a link of wide fingerprints may differ. Shingle sets of similarity s agree in a bit with
#: probability p = 1 - acos(2 s / (1 + s)) / pi or more: 0.849 at 0.8. They meet in no list with probability 8.3e-5
#: there, and 5.4e-5 differ in more bits; at 0.9, both are below 1e-9. Of unrelated pairs 4e-7 of those that meet are linked.
WIDE_BITS = 36
#: Votes of a shingle on each bit: with one, sets of four and five shingles would be tied too often.
VOTES = 2
#: One in so many fingerprints tells which lists are long.
LENGTH_SHARE = 16
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text as an unsigned number."""
    words = text.encode().lower().split() if text else []  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = max(1, len(words) - words_per_shingle + 1)
    ends = starts[len(words) - n :] + sizes[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[start:end], SEED) for start, end in zip(starts[:n].tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, TALLY_ROWS):
        ones += np.unpackbits(hashes[at : at + TALLY_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)``; ``fp`` is the fingerprint as a signed 64-bit number."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, words_per_shingle) for text in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(measure, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def posting_lists(prints: DataFrame) -> DataFrame:
    """``(list, triple, tile, other, fp)``: the index, each fingerprint under its bytes at each triple of positions."""
    masks = [sum(0xFF << (8 * position) for position in triple) for triple in KEYS]
    signed = [mask - (1 << 64) if mask >= 1 << 63 else mask for mask in masks]
    entries = F.array(*(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))) for number, mask in enumerate(signed)))
    listed = prints.select("fp", F.posexplode(entries).alias("triple", "list"))
    long = listed.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("list", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    met = listed.join(long, "list", "left")
    own = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("tiles"))).cast("int")
    met = met.withColumn("own", own)
    # A fingerprint meets every tile: under (its tile, other) and, for the smaller others, (other, its tile).
    others = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = met.select("list", "triple", "own", "fp", F.explode(others).alias("third"))
    return met.select("list", "triple", F.least("own", "third").alias("tile"), F.greatest("own", "third").alias("other"), "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with at most one edge for each fingerprint."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def enough_shared(differ: np.ndarray, triples: np.ndarray, least: int) -> np.ndarray:
    """Places of the pairs that share ``least`` positional bytes or more; ``differ`` is the exclusive or of a pair.

    The tally starts at the three that the list stands for.
    """
    alive = np.arange(len(differ))
    tally = np.full(len(differ), 3)
    for number in range(OTHERS.shape[1]):
        tally = tally + ((differ[alive] >> OTHERS[triples[alive], number]) & np.uint64(0xFF) == 0)
        still = tally + (OTHERS.shape[1] - 1 - number) >= least
        alive, tally = alive[still], tally[still]
    return alive


def link_lists(groups: np.ndarray, triples: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each run of equal ``groups``, by count filter and verification."""
    n = len(prints)
    change = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    ends = np.repeat(np.append(change, n), np.diff(np.concatenate(([0], change, [n]))))
    active, found_a, found_b = np.arange(n), [], []
    step = 1
    while len(active := active[active + step < ends[active]]):
        a, b = prints[active], prints[active + step]
        differ = (a ^ b).view(np.uint64)
        likely = enough_shared(differ, triples[active], 8 - max_bits)
        if len(likely):
            close = likely[(np.bitwise_count(differ[likely]) <= max_bits) & (differ[likely] != 0)]
            found_a.append(a[close])
            found_b.append(b[close])
        step += 1
        if len(found_a) >= 64:
            kept = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [kept[0]], [kept[1]]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` over distinct fingerprints: edges whose components are those of all links.

    Lists are never gathered whole: a task reads its lists in order, and holds one list of at most
    about two tiles. Of a dense list only a spanning forest leaves the task.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the positions indexed guarantee a meeting up to three bits")
    lists = posting_lists(prints)
    dealt = lists.select(F.xxhash64("list", "tile", "other").alias("g"), F.col("triple").cast("int").alias("triple"), "fp").repartition(shuffle_partitions(prints.sparkSession), "g").sortWithinPartitions("g")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_g, kept_t, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                kept_g = np.concatenate((kept_g, batch.column(0).to_numpy()))
                kept_t = np.concatenate((kept_t, batch.column(1).to_numpy()))
                kept_fp = np.concatenate((kept_fp, batch.column(2).to_numpy()))
                # The last list may go on in the next batch.
                whole = int(np.searchsorted(kept_g, kept_g[-1])) if len(kept_g) else 0
            else:
                whole = len(kept_g)
            if whole:
                a, b = link_lists(kept_g[:whole], kept_t[:whole], kept_fp[:whole], max_bits)
                kept_g, kept_t, kept_fp = kept_g[whole:], kept_t[whole:], kept_fp[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes in :data:`WIDE_WORDS` words; zeros for an empty set."""
    seeds = np.arange(1, VOTES * WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    columns = np.arange(8 * WIDE_WORDS) * 256
    tally = np.zeros(len(columns) * 256, np.int64)
    for at in range(0, len(hashes), TALLY_ROWS // 8):
        mixed = hashes[at : at + TALLY_ROWS // 8, None] + seeds  # SplitMix64
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        # Bits are tallied by counting the values of each byte.
        tally += np.bincount((mixed.view(np.uint8).reshape(-1, len(columns)) + columns).ravel(), minlength=len(tally))
    ones = tally.reshape(len(columns), 256) @ BYTE_BITS
    return np.packbits(2 * ones > VOTES * len(hashes)).view(np.uint64)


def wide_lists(prints: DataFrame) -> DataFrame:
    """``(g, node, a, b)``: the index of ``prints(node, wide)``, each under its bytes at each pair of positions, with its first two words.

    ``g`` stands for a list, or for two tiles of a long one. Lengths are told from a share of the fingerprints; they decide
    how lists are cut, never what meets.
    """

    numbers = np.arange(len(WIDE_PAIRS))[:, None] << 16
    one, two = np.array(WIDE_PAIRS).T

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                wide = part.column(1).flatten().to_numpy().reshape(len(part), WIDE_WORDS)
                positions = np.ascontiguousarray(wide).view(np.uint8).T.astype(np.int64)
                lists = numbers + (positions[one] << 8) + positions[two]
                columns = (lists, *(np.broadcast_to(values, lists.shape) for values in (part.column(0).to_numpy(), wide[:, 0], wide[:, 1])))
                yield pa.RecordBatch.from_arrays([pa.array(values.ravel()) for values in columns], names=["list", "node", "a", "b"])

    def posted(rows: DataFrame) -> DataFrame:
        return rows.select("node", "wide").mapInArrow(post, "list long, node long, a long, b long")

    few = posted(prints.where(F.pmod(F.xxhash64("node"), F.lit(LENGTH_SHARE)) == 0))
    long = few.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") * LENGTH_SHARE > TILE)
    long = materialize(long.select("list", F.ceil(F.col("n") * LENGTH_SHARE / TILE).cast("int").alias("tiles")), "simhash-long")
    listed = posted(prints).join(F.broadcast(long), "list", "left")
    own = F.pmod(F.xxhash64("node", "list"), F.col("tiles"))
    tiled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1), lambda other: F.xxhash64("list", F.least(own, other), F.greatest(own, other)))
    return listed.select(F.explode(F.when(F.col("tiles").isNull(), F.array("list")).otherwise(tiled)).alias("g"), "node", "a", "b")


def wide_links(prints: DataFrame, max_bits: int = WIDE_BITS) -> DataFrame:
    """``(a, b)`` over the nodes of ``prints(node, wide)``: edges whose components are those of all links of wide fingerprints."""
    dealt = wide_lists(prints).repartition(shuffle_partitions(prints.sparkSession), "g").sortWithinPartitions("g")

    def linked(groups: np.ndarray, nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        change = np.flatnonzero(groups[1:] != groups[:-1]) + 1
        ends = np.repeat(np.append(change, len(groups)), np.diff(np.concatenate(([0], change, [len(groups)]))))
        active, found, step = np.arange(len(groups)), [(nodes[:0], nodes[:0])], 1
        while len(active := active[active + step < ends[active]]):
            close = active[np.bitwise_count(words[active] ^ words[active + step]).sum(axis=1) <= max_bits]
            found.append((nodes[close], nodes[close + step]))
            step += 1
            if len(found) >= 64:
                found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
        return forest(*map(np.concatenate, zip(*found, strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        for batch in _with_end(batches):
            if batch is not None:
                kept = [np.concatenate((part, column.to_numpy())) for part, column in zip(kept, batch.columns, strict=True)]
            # The last list may go on in the next batch.
            whole = len(kept[0]) if batch is None else int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
            if whole:
                a, b = linked(kept[0][:whole], kept[1][:whole], np.stack((kept[2][:whole], kept[3][:whole]), axis=1).view(np.uint64))
                kept = [part[whole:] for part in kept]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words_per_shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id``: a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits.
    Documents of one fingerprint are one vertex, so copies are never paired with each other. Null,
    empty and blank texts have fingerprint zero and link like any other; a null id takes part in no
    minimum unless all ids of its component are null; repeated rows and rows of one id are rows of their own; a
    very long text is shingled whole; an empty table gives an empty one; other columns are ignored.
    A fingerprint that a third of all rows have meets its class by broadcast.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    labels = connected_components(links(distinct.select("fp"), max_bits), "simhash-components")
    of_class = distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(of_class.join(smallest, "component").select("fp", "component_id"), "simhash-classes")
    return join_by_key(prints, classes, "fp").select(id_col, hex64(F.col("fp")).alias("fingerprint"), "component_id")
