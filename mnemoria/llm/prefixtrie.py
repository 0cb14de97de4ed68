"""Operator 12: the trie of conversation prefixes, as the Cartesian tree over sorted conversations.

Conversations are sorted by the digests of their turns, and neighbours share a common prefix of a certain length (LCP). A node of the
trie with several members is an interval of the sorted conversations between two smaller LCPs; a stack finds all
nearest smaller values in one scan. Equal LCPs of an interval are one node, the depths between a node and the
next wider interval hold the same members, and what is summed over a subtree is summed over an interval.

Each partition scans its own range. Intervals that are open at an edge are kept as the minima of the block: those that fall from its left
edge and those that rise to its right edge. The same stack then runs over these minima, of which a partition has a bounded number, and
closes the intervals that span partitions.

A conversation may be of any length, so it is cut into pieces of :data:`PIECE` turns. A piece is sorted among those that
follow the same turns, which a digest names; the trie is made of one segment for each such digest, and pieces of one turn sequence
hang below the node where the sequence ended. So no row and no stack grows with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, materialize, shuffle_partitions

#: Turns of a piece; turns that are joined with their conversation under one key; bytes of a digest.
PIECE, BLOCK, DIGEST = 64, 1 << 16, 16
#: Conversations that begin alike, and the most turns that they share.
FAMILY, SHARED = 20, 3
#: Characters of ids that are hashed from one row.
ENDS = 4096


def running_sums(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sums over the rows before each one of its ``key``, by ``order``; exclusive.

    A key may hold any share of the rows: they are dealt by ranges of key and order, summed in each range, and a key that
    began in an earlier range gets the totals of those, at most one key for each range.
    """
    places = [f"order_{k}" for k in range(len(order))]
    wanted = rows.select("*", *(c.alias(place) for c, place in zip(order, places, strict=True)), *(c.alias(f"own_{total}") for total, c in sums.items()), F.monotonically_increasing_id().alias("tie"))
    dealt = materialize(wanted.repartitionByRange(shuffle_partitions(rows.sparkSession), key, *places, "tie").withColumn("dealt", F.spark_partition_id()), name)
    before = Window.partitionBy("dealt", key).orderBy(*places, "tie").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(key).orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    of_ranges = dealt.groupBy("dealt", key).agg(*(F.sum(f"own_{total}").alias(f"own_{total}") for total in sums))
    bases = of_ranges.select("dealt", key, *(F.sum(f"own_{total}").over(ranges).alias(f"base_{total}") for total in sums)).where(F.col(f"base_{next(iter(sums))}").isNotNull())
    bases = materialize(bases, f"{name}-bases")  # a row for each range at most
    summed = dealt.select("*", *(F.coalesce(F.sum(f"own_{total}").over(before), F.lit(0)).alias(total) for total in sums)).join(F.broadcast(bases), ["dealt", key], "left")
    return summed.select(*rows.columns, *((F.col(total) + F.coalesce(f"base_{total}", F.lit(0))).alias(total) for total in sums))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, digest, words, pos)``: turns by their place, from 1; ties by role and text. Only digests of texts leave the scan."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 2 * DIGEST).alias("hex"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    turns = turns.withColumn("digest", F.unhex("hex")).drop("hex")
    return running_sums(turns, "conv", [F.col("turn").isNotNull(), F.col("turn"), F.col("digest")], {"pos": F.lit(1)}, "trie-turns").select("conv", "digest", "words", (F.col("pos") + 1).alias("pos"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv, size, i, digest, words)`` of all rebuilt conversations, and ``(conv, size)`` of each."""
    turns = materialize(placed_turns(conversations), "trie-placed")
    shared = F.crc32(F.col("conv").cast("string")) % (SHARED + 1)
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") <= SHARED)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    counts = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("shared", shared.cast("int")).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    convs = counts.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("shared")))
    convs = convs.withColumn("size", F.size("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    convs = materialize(convs.select("conv", "n", "shared", "head", "size"), "trie-conversations")
    # Turns meet their conversation by blocks, so a conversation that holds a third of all turns is many keys.
    blocks = convs.select("conv", "shared", "size", F.size("head").alias("from_head"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK))).alias("block"))
    own = turns.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv", "block"]).where("pos > shared").select("conv", "size", (F.col("pos") - F.col("shared") + F.col("from_head")).alias("i"), "digest", "words")
    led = convs.select("conv", "size", F.explode("head").alias("t")).select("conv", "size", F.col("t.pos").alias("i"), "t.digest", "t.words")
    return own.unionByName(led), convs.select("conv", "size")


def pieces(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv, size, k, digests, words, before, seg, next)``: pieces of at most :data:`PIECE` turns.

    ``before`` counts the words of the pieces before; ``seg`` names the turns before this piece, ``next`` those before the next
    one. A conversation without turns has one piece without turns.
    """
    gathered = turns.groupBy("conv", "size", F.floor((F.col("i") - 1) / PIECE).cast("int").alias("k")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "words"))).alias("t"))
    made = gathered.select("conv", "size", "k", F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), "")).alias("digests"), F.col("t.words").alias("words"))
    none = sizes.where("size = 0").select("conv", "size", F.lit(0).alias("k"), F.lit(b"").alias("digests"), F.array().cast("array<long>").alias("words"))
    made = materialize(made.unionByName(none), "trie-pieces")
    long = made.where(F.col("size") > PIECE)
    digest = F.md5(F.concat(F.encode(F.concat(F.col("k").cast("string"), F.lit(":")), "UTF-8"), F.col("digests")))
    parts = {f"q{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    summed = running_sums(long, "conv", [F.col("k")], {"before": F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b), **parts}, "trie-long")
    name = lambda k, values: F.unhex(F.md5(F.concat_ws(",", k.cast("string"), *(value.cast("string") for value in values))))
    summed = summed.withColumn("next", F.when((F.col("k") + 1) * PIECE < F.col("size"), name(F.col("k") + 1, [F.col(q) + c for q, c in parts.items()])))
    summed = summed.withColumn("seg", F.when(F.col("k") == 0, F.lit(b"")).otherwise(name(F.col("k"), [F.col(q) for q in parts]))).drop(*parts)
    short = made.where(F.col("size") <= PIECE).select("*", F.lit(0).cast("long").alias("before"), F.lit(None).cast("binary").alias("next"), F.lit(b"").alias("seg"))
    return summed.unionByName(short)


def common(a: bytes, b: bytes) -> int:
    """Turns that two pieces have in common from the start."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // DIGEST
    return next(at for at in range(0, least, DIGEST) if a[at : at + DIGEST] != b[at : at + DIGEST]) // DIGEST


RANKED = "part int, idx long, conv long, size long, k int, words array<long>, before long, seg binary, next binary, lcp long, starts boolean, next_lcp long, ends binary, edge binary"


def ranked(made: DataFrame) -> DataFrame:
    """Pieces in order, with the LCP with the neighbours in turns from the start of the conversation; -1 after the last of a segment.

    The first row of a segment has the turns before the segment. What depends on another partition is met
    by the first and last pieces of the partitions (``edge``), in one task.
    """
    size, columns = PIECE, ["conv", "size", "k", "words", "before", "seg", "next"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, n = [], None, 0
        for batch in batches:
            part = batch.column(8)[0].as_py() if batch.num_rows else 0
            for row in batch.to_pylist():
                digests, start = row.pop("digests"), row["k"] * size
                row |= {"part": part, "idx": n, "lcp": None, "starts": None, "next_lcp": None, "edge": None}
                row["ends"] = None if row["next"] is not None else hashlib.md5(row["seg"] + b"%d:" % row["k"] + digests).digest()
                if last is None:
                    row["edge"] = digests
                else:
                    row["starts"] = (row["k"], row["seg"]) != (last[0]["k"], last[0]["seg"])
                    row["lcp"] = start if row["starts"] else start + common(digests, last[1])
                    last[0]["next_lcp"] = -1 if row["starts"] else row["lcp"]
                    rows.append(last[0])
                last, n = (row, digests), n + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if last is not None:
            last[0]["edge"] = last[1]
            yield pa.RecordBatch.from_pylist([last[0]], schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [row for batch in batches for row in batch.to_pylist()]
        for row, after in zip(edges, [*edges[1:], None], strict=True):
            start = row["k"] * size
            if row["lcp"] is None and row["starts"] is None:
                row |= {"starts": True, "lcp": start}
            if row["next_lcp"] is None:
                same = after is not None and (row["k"], row["seg"]) == (after["k"], after["seg"])
                row["next_lcp"] = start + common(row["edge"], after["edge"]) if same else -1
                if after is not None:
                    after |= {"starts": not same, "lcp": row["next_lcp"] if same else after["k"] * size}
        yield pa.RecordBatch.from_pylist([{key: row[key] for key in ("part", "idx", "lcp", "starts", "next_lcp")} for row in edges], pa.schema([("part", pa.int32()), ("idx", pa.int64()), ("lcp", pa.int64()), ("starts", pa.bool_()), ("next_lcp", pa.int64())]))

    long, binary = pa.int64(), pa.binary()
    schema = pa.schema([("part", pa.int32()), ("idx", long), ("conv", long), ("size", long), ("k", pa.int32()), ("words", pa.list_(long)), ("before", long), ("seg", binary), ("next", binary), ("lcp", long), ("starts", pa.bool_()), ("next_lcp", long), ("ends", binary), ("edge", binary)])
    order = ["k", "seg", "digests", F.col("next").isNotNull(), "conv"]
    dealt = made.repartitionByRange(shuffle_partitions(made.sparkSession), *order).sortWithinPartitions(*order)
    found = materialize(dealt.select(*columns, "digests", F.spark_partition_id().alias("part")).mapInArrow(scan, RANKED), "trie-ranked")
    edges = found.where("edge is not null").select("part", "idx", "k", "seg", "lcp", "starts", "next_lcp", "edge")  # two rows for each partition
    met = materialize(edges.repartition(1).sortWithinPartitions("part", "idx").mapInArrow(meet, "part int, idx long, lcp long, starts boolean, next_lcp long"), "trie-edges")
    other = met.select("part", "idx", F.col("lcp").alias("a"), F.col("starts").alias("b"), F.col("next_lcp").alias("c"))
    joined = found.drop("edge").join(F.broadcast(other), ["part", "idx"], "left")
    return joined.select("part", "idx", *columns, "ends", F.coalesce("lcp", "a").alias("lcp"), F.coalesce("starts", "b").alias("starts"), F.coalesce("next_lcp", "c").alias("next_lcp"))


def weighed(rows: DataFrame) -> DataFrame:
    """Rows with what is summed over intervals: all words of the conversation, words of new nodes, and whether a leaf ends there.

    A piece counts what comes in the later pieces of its conversation as well.
    """
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)
    shared = (F.col("lcp") - F.col("k") * PIECE).cast("int")
    told = rows.withColumn("own", add(F.col("words"))).withColumn("w_lcp", F.col("before") + add(F.slice("words", F.lit(1), shared)))
    told = told.withColumn("new", F.col("before") + F.col("own") - F.col("w_lcp")).withColumn("leaf", (F.col("next").isNull() & (F.col("next_lcp") < F.col("k") * PIECE + F.size("words"))).cast("long"))
    told = materialize(told, "trie-weighed")
    long = told.where(F.col("size") > PIECE).select("part", "idx", "conv", "k", "own", "new", "leaf")
    later = running_sums(long, "conv", [-F.col("k")], {"later_words": F.col("own"), "later_new": F.col("new"), "later_leaf": F.col("leaf")}, "trie-later").select("part", "idx", "later_words", "later_new", "later_leaf")
    met = told.where(F.col("size") > PIECE).join(later, ["part", "idx"]).select("*", (F.col("before") + F.col("own") + F.col("later_words")).alias("total"), (F.col("new") + F.col("later_new")).alias("all_new"), (F.col("leaf") + F.col("later_leaf")).alias("leaves"))
    rest = told.where(F.col("size") <= PIECE).select("*", F.col("own").alias("total"), F.col("new").alias("all_new"), F.col("leaf").alias("leaves"))
    return met.drop("later_words", "later_new", "later_leaf").unionByName(rest)


class Interval:
    """An interval that is not closed yet: a node and the depths above it that have the same members."""

    __slots__ = ("conv", "ends", "height", "id", "kids", "leaves", "members", "names", "new", "next", "path", "seg", "start", "total", "w_lcp")

    def __init__(self, id: int, height: int, start: int = 0, path: list[int] | None = None, w_lcp: int = 0, seg: bytes | None = None) -> None:
        self.id, self.height, self.start, self.path, self.w_lcp, self.seg = id, height, start, path, w_lcp, seg
        self.members = self.total = self.new = self.leaves = self.kids = 0
        self.conv = self.ends = self.next = None
        self.names: list[int] = []

    def add(self, members: int, conv: int | None, total: int, new: int, leaves: int) -> None:
        self.members, self.total, self.new, self.leaves = self.members + members, self.total + total, self.new + new, self.leaves + leaves
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)

    def stop(self, ends: bytes | None, then: bytes | None) -> None:
        """Members that end here, or go on in another segment."""
        self.ends, self.next = ends or self.ends, then or self.next

    def record(self, kind: str, **more: object) -> dict:
        return {"kind": kind, "id": self.id, "height": self.height, "start": self.start, "members": self.members, "conv": self.conv, "total": self.total, "new": self.new, "leaves": self.leaves, "kids": self.kids, "ends": self.ends, "next": self.next, "path": self.path, "w_lcp": self.w_lcp, "seg": self.seg} | more

    @classmethod
    def of(cls, row: dict) -> Interval:
        made = cls(row["id"], row["height"], row["start"], row["path"], row["w_lcp"], row["seg"])
        made.add(row["members"], row["conv"], row["total"], row["new"], row["leaves"])
        made.kids, made.ends, made.next = row["kids"], row["ends"], row["next"]
        return made


class Stack:
    """Open intervals, the widest first; ``out`` takes the closed ones.

    ``level`` is the interval that began in an earlier partition, of which only the part that lies here is known; it is
    never closed here but told as a minimum of the block.
    """

    def __init__(self) -> None:
        self.open: list[Interval] = []
        self.out: list[dict] = []
        self.level: Interval | None = None

    def close(self, parent: Interval | None, parent_height: int) -> Interval:
        """The last interval, with its depths and what is saved: ``base - (members - 1) * words before the depth``."""
        closed = self.open.pop()
        if closed.seg:  # the turns before a segment are a node of the segment above
            self.out.append(closed.record("segment"))
            self.out += [{"kind": "segment", "id": name, "seg": closed.seg} for name in closed.names]
        else:
            first = parent_height + 1
            path = [0] if closed.height == 0 else closed.path[first - 1 - closed.start : closed.height - closed.start]
            self.out.append(closed.record("run", first=first, path=path, base=closed.total - closed.new - closed.w_lcp, parent=None if parent is None else parent.id))
            self.out += [{"kind": "name", "id": name, "conv": closed.conv} for name in closed.names]
        return closed

    def settle(self, height: int, id: int) -> Interval:
        """Close what is deeper than ``height``; the interval of that height, which may begin where the last closed one did."""
        closed = None
        while self.open and self.open[-1].height > height:
            below = self.open[-2] if len(self.open) > 1 else self.level
            if below is not None and below.height >= height:
                closed = self.close(below, below.height)
                below.add(closed.members, closed.conv, closed.total, closed.new, closed.leaves)
            else:
                top = self.open[-1]
                wider = Interval(id, height, top.start, top.path, top.w_lcp)
                closed = self.close(wider, height)
                wider.add(closed.members, closed.conv, closed.total, closed.new, closed.leaves)
                wider.kids = 1
                self.open.append(wider)
        if self.open:
            return self.open[-1]
        if self.level.height > height:
            self.out.append(self.level.record("level"))
            self.level = Interval(id, height)
        return self.level

    def finish(self) -> None:
        """Close all."""
        while self.open:
            below = self.open[-2] if len(self.open) > 1 else self.level
            closed = self.close(below, -1 if below is None else below.height)
            if below is not None:
                below.add(closed.members, closed.conv, closed.total, closed.new, closed.leaves)
        if self.level is not None:
            self.out.append(self.level.record("level"))
            self.level = None


NODES = "kind string, part int, seq long, id long, parent long, height long, start long, first long, members long, conv long, total long, new long, leaves long, kids long, base long, w_lcp long, ends binary, next binary, seg binary, path array<long>, ids string"


def node_batch(rows: list[dict]) -> pa.RecordBatch:
    long, binary = pa.int64(), pa.binary()
    kinds = {"string": pa.string(), "int": pa.int32(), "long": long, "binary": binary, "array<long>": pa.list_(long)}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in NODES.split(", "))]))


def scanned(rows: DataFrame) -> DataFrame:
    """Closed intervals of each partition, its block minima in order, and the ids of conversations that end together."""
    size = PIECE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part, serial, ids = Stack(), None, 0, []
        ended, first, began = None, 0, False

        def told() -> Iterator[pa.RecordBatch]:
            """What is open at the right edge, as minima."""
            if stack.level is not None:
                stack.out.append(stack.level.record("level"))
            stack.out += [interval.record("push") for interval in stack.open]
            yield from flushed()

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            if stack.out:
                for row in stack.out:
                    serial += 1
                    row |= {"part": part, "seq": serial}
                yield node_batch(stack.out)
                stack.out = []

        def ids_told() -> None:
            nonlocal ids
            if ids:
                stack.out.append({"kind": "ends", "ends": ended, "conv": first, "ids": ",".join(ids)})
                ids = []

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        ids_told()
                        yield from told()
                    stack, part, serial, ended, began = Stack(), row["part"], 0, None, False
                here = (part << 32) + row["idx"] * 2
                start = row["k"] * size
                end, words = start + len(row["words"]), list(accumulate(row["words"], initial=row["before"]))
                if row["starts"]:
                    if stack.open or stack.level is not None:
                        stack.finish()
                    if not began:  # closes what earlier partitions have left open; here all is closed already
                        stack.out.append({"kind": "begin"})
                        began = True
                    stack.open.append(Interval(here, start, start, words, row["w_lcp"], row["seg"]))
                elif not stack.open and stack.level is None:
                    stack.level = Interval(here, row["lcp"])
                at = stack.settle(row["lcp"], here)
                values = (1, row["conv"], row["total"], row["all_new"], row["leaves"])
                if end > row["lcp"]:
                    at.kids += 1
                    at = Interval(here + 1, end, start, words, row["w_lcp"])
                    stack.open.append(at)
                at.add(*values)
                at.stop(row["ends"], row["next"])
                if row["ends"] != ended or len(ids) * 8 >= ENDS:
                    ids_told()
                    ended, first = row["ends"], row["conv"]
                if ended is not None:
                    ids.append(str(row["conv"]))
            yield from flushed()
        if part is not None:
            ids_told()
            yield from told()

    wanted = rows.select("part", "idx", "conv", "k", "words", "before", "seg", "next", "ends", "lcp", "starts", "w_lcp", "total", "all_new", "leaves")
    dealt = wanted.repartitionByRange(shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part", "idx")
    return dealt.mapInArrow(scan, NODES)


def spanning(minima: DataFrame) -> DataFrame:
    """The intervals that span partitions: the stack over the block minima of all partitions, in order.

    A partition has at most two rows for each height of a piece, whatever its size, so this is one small task.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack()
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == "begin":
                    stack.finish()
                elif row["kind"] == "push":
                    stack.open.append(Interval.of(row))
                else:
                    at = stack.settle(row["height"], row["id"])
                    if at.id != row["id"]:
                        at.names.append(row["id"])
                    at.add(row["members"], row["conv"], row["total"], row["new"], row["leaves"])
                    at.kids += row["kids"]
                    at.stop(row["ends"], row["next"])
            if stack.out:
                yield node_batch(stack.out)
                stack.out = []
        stack.finish()
        if stack.out:
            yield node_batch(stack.out)

    return minima.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(merge, NODES)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``(ends, sha)``: SHA-256 of the ids of each group, numerically ascending and joined by commas.

    The digest of a sequence is made in sequence, so blocks of ids of one group meet in one task, which holds the state of the digest
    and one batch of blocks.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == key:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = own, hashlib.sha256(ids.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], names=["ends", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["ends", "sha"])

    return ends.repartition("ends").sortWithinPartitions("ends", "conv").select("ends", "ids").mapInArrow(digest, "ends binary, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversation ``c`` is rebuilt from the first turns of the conversation that opens its family of 20, and its own. Null roles and
    texts are empty; null turns come first; rows that agree in turn are ordered by a digest of role and text; repeated rows are
    turns of their own; rows without a conversation are left out. Very long texts and conversations are read whole; an empty table has no trie; other
    columns are ignored.
    """
    turns, sizes = rebuilt(conversations)
    found = materialize(scanned(weighed(ranked(pieces(turns, sizes)))), "trie-scanned")
    more = materialize(spanning(found.where("kind in ('begin', 'level', 'push')")), "trie-spanning")
    every = found.unionByName(more)
    runs, segments = every.where("kind = 'run'"), every.where("kind = 'segment'")
    shas = hashed_ends(found.where("kind = 'ends'").select("ends", "conv", "ids"))
    # Keys are unique on both sides of the joins below; rows without a key pass by them.
    kids = segments.where("kids is not null").select(F.col("seg").alias("next"), F.col("kids").alias("more_kids"))
    wide = runs.where("next is not null").join(kids, "next").withColumn("kids", F.col("kids") + F.col("more_kids")).drop("more_kids")
    all_runs = wide.unionByName(runs.where("next is null"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    all_runs = all_runs.where("ends is not null").join(shas, "ends").unionByName(all_runs.where("ends is null").withColumn("sha", none))
    all_runs = materialize(all_runs.select("id", "parent", "first", "members", "conv", "leaves", "kids", "base", "path", "sha"), "trie-runs")
    above = wide.select("next", "conv").join(segments.select(F.col("seg").alias("next"), "id"), "next").select("id", "conv")
    convs = runs.select("id", "conv").unionByName(every.where("kind = 'name'").select("id", "conv")).unionByName(above)
    convs = materialize(convs.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv")), "trie-parents")
    met = join_by_key(all_runs.where("parent is not null"), convs, "parent").unionByName(all_runs.where("parent is null").withColumn("parent_conv", F.lit(None).cast("long")))
    each = met.select("*", F.posexplode("path").alias("at", "words"))
    last = F.col("at") == F.size("path") - 1
    return each.select(
        F.col("conv").alias("conv_id"), (F.col("first") + F.col("at")).alias("depth"), F.when(F.col("at") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("base") - (F.col("members") - 1) * F.col("words")).alias("saved_tokens"), F.when(last, F.col("sha")).otherwise(none).alias("ends_sha256"),
    )
