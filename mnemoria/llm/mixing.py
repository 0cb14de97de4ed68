"""Operator 10: mix sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialize, shuffle_partitions

#: Fractional part of the golden ratio, the step of the schedule's points.
GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block, and slots in a chunk whose ranks are counted together.
BLOCK_WORDS = 256
CHUNK_SLOTS = 4096
#: Cells of the unit interval in which points and sources meet.
CELLS = 4096
#: No source is repeated more often than this.
MAX_EPOCHS = 3


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size)``: the number of runs of other than ASCII white space; 0 for null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            sizes = pa.array([len(text.split()) if text else 0 for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=[id_col, "source", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(source_col).alias("source"), text_col).mapInArrow(count, f"`{id_col}` {kind}, source string, size long")


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``bin``: ranges of the order, so that ranks and running sums need no single task; as a written table."""
    parts = shuffle_partitions(rows.sparkSession)
    return materialize(rows.repartitionByRange(parts, *order).withColumn("bin", F.spark_partition_id()), "mix-ranges")


def running(rows: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """Adds ``name``, the sum of ``value`` up to each row of :func:`in_order`, and ``<name>_before``."""
    inside = Window.partitionBy("bin").orderBy(*order)
    placed = rows.withColumn(name, F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(f"{name}_before", F.lag(name).over(inside))
    ends = placed.groupBy("bin").agg(F.max(name).alias("end"))
    # One row for each range.
    bases = ends.select("bin", F.sum("end").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("base")).na.fill(0, ["base"])
    return placed.join(bases, "bin").withColumn(name, F.col("base") + F.col(name)).withColumn(f"{name}_before", F.when(F.col(f"{name}_before").isNull(), F.col("base")).otherwise(F.col("base") + F.col(f"{name}_before"))).drop("base")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target, low, high, number)``: one row for each source, as a written table.

    Sources are dealt the weights by code point, null last, and share the total; what exceeds ``most`` times a size
    goes to the others by weight. Ranks and running sums go by ranges of names, and a round of sharing is one aggregation, so there may be as
    many sources as web domains. ``low`` and ``high`` bound the source's part of the unit interval.
    """
    order = [F.col("source").isNull(), F.col("source")]
    totals = in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), *order)
    numbered = running(totals, "one", "n", *order).withColumn("number", F.col("n_before"))
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(most)))
    numbered = materialize(numbered.select("bin", "source", "source_size", "number", "weight", "most"), "mix-numbered")
    total = float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    fixed, open_weight, full = 0.0, numbered.agg(F.sum("weight")).first()[0], 0
    while open_weight:
        # A share only grows from round to round, so a source that is full stays so.
        share = F.lit(total - fixed) * F.col("weight") / F.lit(open_weight)
        over = share > F.col("most")
        found = numbered.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if found["full"] == full:
            break
        fixed, open_weight, full = found["fixed"], found["open"], found["full"]
    target = F.least(F.lit(total - fixed) * F.col("weight") / F.lit(open_weight), F.col("most")) if open_weight else F.col("most")
    shared = running(numbered.withColumn("target", target), "target", "upto", F.col("number"))
    whole = F.lit(shared.agg(F.max("upto")).first()[0] or 1.0)
    last = F.lit(numbered.agg(F.max("number")).first()[0])
    high = F.when(F.col("number") == last, 2.0).otherwise(F.col("upto") / whole)
    return materialize(shared.select("source", "source_size", "target", (F.col("upto_before") / whole).alias("low"), high.alias("high"), "number"), "mix-targets")


def running_offsets(sizes: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Each row's place in the shuffled order of its source: adds ``at``, the words before it.

    A source may hold a third of all rows, so it is not summed in one task: each source's rows are
    split by hash into bins, ordered inside, and the totals of the bins give the bins' offsets.
    """
    bins = 4 * shuffle_partitions(sizes.sparkSession)
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    dealt = sizes.withColumn("key", order).withColumn("bin", F.floor((F.shiftrightunsigned("key", 1) / F.lit(float(1 << 63))) * bins).cast("int"))
    inside = Window.partitionBy("source", "bin").orderBy("key", F.col(id_col).asc_nulls_first(), "size")
    dealt = dealt.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = sizes.withColumn("key", order).withColumn("bin", F.floor((F.shiftrightunsigned("key", 1) / F.lit(float(1 << 63))) * bins).cast("int")).groupBy("source", "bin").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bases = totals.select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), (F.sum("total").over(before) - F.col("total")).alias("base"))
    joined = dealt.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    return joined.select(id_col, "source", "size", (F.col("base") + F.col("inside")).alias("at"))


def golden_slots(targets: DataFrame, n_slots: int, n_sources: int, block_words: int) -> DataFrame:
    """The schedule: ``(source, rank, slot, words)``.

    Slot ``t`` belongs to the source whose part of the unit interval holds the fraction of
    ``(t + 1/2) * golden ratio``. Ranks come from counts of chunks of slots, not from one
    long window. A source stops when its target is reached: ``words`` is what a slot still takes.
    The points leave some sources short of their share by a number of slots that grows as the
    logarithm of ``n_slots``; these follow at the end, the sources in turn, so a source of a few
    words lengthens no schedule.
    """
    spark = targets.sparkSession
    parts = max(1, min(shuffle_partitions(spark), n_slots // CHUNK_SLOTS + 1))
    point = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    slots = spark.range(0, n_slots, 1, parts).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"), F.floor(F.col("id") / CHUNK_SLOTS).alias("chunk"))
    # Sources meet the points by cells of the unit interval: an equality join with a small table.
    bounds = targets.where("high > low").select("source", "target", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.least(F.col("high"), F.lit(1.0)) * CELLS))).alias("cell"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    dealt = slots.join(bounds, "cell").where("low <= point and point < high").select("slot", "chunk", "source", "target")
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    bases = counts.select(F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1)
    ranked = ranked.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("chunk") == F.col("b_chunk")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("inside"))
    words = F.least(F.lit(block_words).cast("long"), F.round("target").cast("long") - F.col("rank") * block_words)
    given = counts.groupBy(F.col("source").alias("g_source")).agg(F.sum("n").alias("n"))
    short = targets.join(given, F.col("source").eqNullSafe(F.col("g_source")), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("needed", F.ceil(F.round("target") / block_words))
    late = short.where("n < needed").select("source", "target", "number", "n", F.explode(F.sequence(F.col("n"), F.col("needed") - 1)).alias("rank"))
    late = late.withColumn("slot", n_slots + (F.col("rank") - F.col("n")) * n_sources + F.col("number"))
    both = ranked.select("source", "target", "rank", "slot").unionByName(late.select("source", "target", "rank", "slot"))
    return both.withColumn("words", words).where("words > 0").select("source", "rank", "slot", "words")


def schedule(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 42, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(per document, taken spans)`` of the mix.

    Per document: ``id, source, size, at, source_size, target``. Spans: ``id, at, epoch, start,
    end, slot``: the words ``[start, end)`` of the document that the slot takes, in which pass
    over the source.
    """
    sizes = materialize(word_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    targets = source_targets(sizes, weights)
    placed = running_offsets(sizes, seed, id_col).join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "low", "high", "number")
    placed = materialize(placed, "mix-placed")
    totals = targets.agg(F.sum("target").alias("total"), F.count("*").alias("sources")).first()
    n_slots = math.ceil((totals["total"] or 0) / block_words)
    slots = golden_slots(targets, n_slots, totals["sources"], block_words).join(targets.select(F.col("source").alias("t_source"), "source_size"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # Slot r of a source takes the words [r * block, r * block + words) of the source's endless repetition.
    begin = F.col("rank") * block_words
    first_epoch, last_epoch = F.floor(begin / F.col("source_size")), F.floor((begin + F.col("words") - 1) / F.col("source_size"))
    slots = slots.select("source", "slot", "source_size", begin.alias("begin"), (begin + F.col("words")).alias("stop"), F.explode(F.sequence(first_epoch, last_epoch)).alias("epoch"))
    low = F.greatest(F.col("begin") - F.col("epoch") * F.col("source_size"), F.lit(0))
    high = F.least(F.col("stop") - F.col("epoch") * F.col("source_size"), F.col("source_size"))
    slots = slots.select("source", "slot", "epoch", low.alias("low"), high.alias("high"))
    slots = slots.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))))
    in_blocks = placed.where("size > 0").select(id_col, "source", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))).alias("block"))
    same = F.xxhash64("source", "block")
    left = in_blocks.withColumn("key", same)
    right = slots.select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), "slot", "epoch", "low", "high", same.alias("s_key"))
    met = left.join(right, (F.col("key") == F.col("s_key")) & F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    start = F.greatest(F.col("low"), F.col("at"), F.col("block") * block_words) - F.col("at")
    end = F.least(F.col("high"), F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("at")
    spans = met.select(id_col, "at", "epoch", start.alias("start"), end.alias("end"), "slot").where("start < end")
    return placed, spans


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 42, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: ``id, size, source_size, target, taken``.

    Weights are dealt to the sources by code point (null last) and share the total size; a source
    is repeated at most three times, and what it can't give is reshared. Documents of a source are
    laid out in a seeded shuffled order and cut into blocks of ``block_words`` words; the schedule's
    slots take blocks by rank, going around the source again when it ends. Each source gives its
    rounded target exactly, and no document more than three times its size.

    A null text has size 0 and is never taken; a null source is a source of its own; repeated rows
    are rows of their own; a very long text lies in as many blocks as it fills; an empty table gives an
    empty one; other columns are ignored. Reruns
    agree: order and schedule depend on ids and the seed alone.
    """
    placed, spans = schedule(docs, weights, seed, block_words, id_col, text_col, source_col)
    taken = spans.groupBy(F.col(id_col).alias("s_id"), F.col("at").alias("s_at")).agg(F.sum(F.col("end") - F.col("start")).alias("taken"))
    # Rows with words have each a place of their own in the source, so (id, place) names a row.
    met = placed.join(taken, F.col(id_col).eqNullSafe(F.col("s_id")) & (F.col("at") == F.col("s_at")) & (F.col("size") > 0), "left")
    return met.select(id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of sorted ``spans`` with the white space between them; runs are joined by a line break."""
    runs: list[list[int]] = []
    for start, end in spans:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    places = [match.span() for match in WORD.finditer(text)]
    if runs == [[0, len(places)]]:
        return text
    return "\n".join(text[places[start][0] : places[end - 1][1]] for start, end in runs)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 42, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as documents: a row of ``docs`` for each pass over its source that takes words of it.

    A document taken whole keeps its text as it is, one taken in part has the words taken;
    ``length_col`` follows the new text where the table has it. Texts without words are not in a
    mix. Rows of one id and text are copies of one another; a null id or source is one like any
    other; an empty table gives an empty one; other columns are kept.
    """
    row, rank, taken = fresh_name(docs, "row"), fresh_name(docs, "rank"), fresh_name(docs, "taken")
    rows = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col, source_col).alias("digest")))
    _, spans = schedule(rows, weights, seed, block_words, row, text_col, source_col)
    # Each copy has a place of its own in its source, and spans of its own.
    lists = spans.groupBy(row, "at", "epoch").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(taken)).drop("at", "epoch")
    once = rows.withColumn(rank, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))).where(F.col(rank) == 1).drop(rank)
    met = once.join(lists, row).drop(row)
    at, last = met.columns.index(text_col), len(met.columns) - 1
    length_at = met.columns.index(length_col) if length_col in met.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [cut_words(text, [(span["start"], span["end"]) for span in own]) for text, own in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            columns = list(batch.columns[:last])
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_at is not None:
                columns[length_at] = pa.array([len(text) for text in new], batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return met.mapInArrow(cut, docs.schema)
