"""Operator 1: substring dedup by line hashing.

Texts are cut into lines, and lines at the ends of sentences, since a copied passage seldom begins
and ends with a line. A short sentence says little, so the unit that is hashed goes on from its
sentence to the next ones until it holds ``MIN_BYTES`` of normalised text. A unit begins at every
sentence, so a passage is found by any of the runs of whole sentences that lie in it. A text that holds
less is one unit as a whole, so copies of short texts are found as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, materialize, row_key

#: Bytes of normalised text that a unit holds at least: stock sentences recur in unrelated texts.
MIN_BYTES = 120
#: A sentence or line with what ends it; the pieces of a text add up to the text.
SENTENCE = re.compile(r"(?s).+?(?:[.!?][ \t]|[。！？]|\n|\Z)")
LINE = re.compile(r"(?s).+?(?:\n|\Z)")
PARAGRAPH = re.compile(r"(?s).+?(?:\n[ \t]*\n|\Z)")
PIECES = {"sentences": SENTENCE, "lines": LINE, "paragraphs": PARAGRAPH}
NOT_WORD = re.compile(r"[\W_]+")


def normalised(unit: str) -> str:
    """Case folded, with everything but letters and digits squeezed to single spaces."""
    return NOT_WORD.sub(" ", unit.casefold()).strip()


def units(text: str, min_bytes: int = MIN_BYTES, pieces: str = "sentences") -> Iterator[tuple[int, int, bytes]]:
    """``(start, end, normalised)`` in code points: from each piece on, the fewest pieces that hold ``min_bytes``; all of a text that holds less."""
    starts, ends, keys, first, held, found = [], [], [], 0, 0, False
    for match in PIECES[pieces].finditer(text):
        key = normalised(match[0]).encode()
        if key:
            starts.append(match.start())
            ends.append(match.end())
            keys.append(key)
            held += len(key)
            while held >= min_bytes:
                found = True
                yield starts[first], ends[-1], b" ".join(keys[first:])
                held -= len(keys[first])
                first += 1
            if first > 256:  # what lies behind is needed no more
                del starts[:first], ends[:first], keys[:first]
                first = 0
    if keys and not found:
        yield starts[0], ends[-1], b" ".join(keys)


def digests(docs: DataFrame, min_bytes: int, pieces: str, id_col: str, text_col: str) -> DataFrame:
    """``(row, unit, start, end, digest)`` of every unit; 128-bit digests."""
    keyed = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, ends, hashes = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for number, (start, end, key) in enumerate(units(text or "", min_bytes, pieces)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    ends.append(end)
                    hashes.append(hashlib.md5(key, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(hashes, pa.binary())],
                names=["row", "unit", "start", "end", "digest"],
            )

    return keyed.mapInArrow(split, f"row {keyed.schema['row'].dataType.simpleString()}, unit int, start int, end int, digest binary")


def repeated_units(docs: DataFrame, min_bytes: int = MIN_BYTES, pieces: str = "sentences", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, unit, start, end, first_row, first_unit)``: every unit but the earliest of its digest.

    The earliest is the one of the smallest id (null first), then of the smallest text digest, then
    of the smallest number in its text. Counts and minima are taken with map-side combination. Units
    of digests that occur once are never joined; those of the few digests that hold more than one unit in 2048
    meet their first occurrence where they lie, so a passage of a third of all documents is not brought together.
    """
    found = materialize(digests(docs, min_bytes, pieces, id_col, text_col), "units")
    rank = F.struct("row", "unit")
    first = materialize(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"), "unit-firsts")
    hot = hot_keys(first, "digest", "n")
    first = first.drop("n")
    few = F.broadcast(first.join(F.broadcast(hot), "digest", "left_semi"))
    met = found.join(few, "digest").unionByName(found.join(F.broadcast(hot), "digest", "left_anti").join(first, "digest"))
    later = (F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit"))
    return met.where(F.coalesce(later, F.lit(True))).select("row", "unit", "start", "end", F.col("first.row").alias("first_row"), F.col("first.unit").alias("first_unit"))


def removed_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, pieces: str = "sentences", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, removed array<struct<start, end, first_id, first_unit>>)`` of the rows that lose something, a struct for each unit."""
    repeated = repeated_units(docs, min_bytes, pieces, id_col, text_col)
    return repeated.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("first_row.id").alias("first_id"), "first_unit"))).alias("removed"))


def substring_dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, pieces: str = "sentences", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, kept_text, removed``: texts without the units that occur earlier, and what was cut where.

    ``pieces`` is ``sentences``, ``lines`` or ``paragraphs``; ``removed`` holds a struct for each repeated unit,
    with the original offsets (code points, end excluded; units overlap) and the place of the earliest
    occurrence. A null text stays null; empty and blank texts lose nothing; a text under ``min_bytes``
    of normalised text is one unit; a very long text is cut into units as any other. Rows are named by id and text: rows that
    agree in both are one occurrence and get the same cuts, an id with several texts has each judged on
    its own. Null ids rank first; an empty table gives an empty one; other columns are ignored.
    """
    spans = removed_spans(docs, min_bytes, pieces, id_col, text_col)
    own = docs.select(row_key(id_col, text_col).alias("own"), id_col, F.col(text_col).alias("text"))
    met = own.join(spans, F.col("own").eqNullSafe(F.col("row")), "left").select(id_col, "text", "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for span in removed or ():
                    if span["start"] > at:
                        parts.append(text[at : span["start"]])
                    at = max(at, span["end"])
                kept.append(text if not removed else "".join((*parts, text[at:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), batch.column(2)], names=[id_col, "kept_text", "removed"])

    return met.mapInArrow(cut, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, kept_text string, removed {met.schema['removed'].dataType.simpleString()}")


def per_document(docs: DataFrame, min_bytes: int = MIN_BYTES, pieces: str = "sentences", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_removed, removed_chars, spans`` of every row: repeated units, and the maximal runs they cover as ``start:end``, comma-joined."""
    repeated = repeated_units(docs, min_bytes, pieces, id_col, text_col).select("row", "unit", "start", "end").distinct()
    before = Window.partitionBy("row").orderBy("start", "end")
    gap = F.col("start") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    numbered = repeated.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("run", F.sum("gap").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    spans = runs.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    met = docs.select(row_key(id_col, text_col).alias("own"), F.col(id_col)).join(spans, F.col("own").eqNullSafe(F.col("row")), "left")
    text = F.array_join(F.transform("runs", lambda span: F.concat_ws(":", span["start"], span["end"])), ",")
    zero = F.lit(0).cast("long")
    return met.select(id_col, F.coalesce("n", zero).alias("n_removed"), F.coalesce("chars", zero).alias("removed_chars"), F.coalesce(text, F.lit("")).alias("spans"))
