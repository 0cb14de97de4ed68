"""Operator 9: concatenate all token streams and cut them into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encode

#: Id that ends each document.
END_ID = 0


def token_runs(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ``(id, ids binary, n, part, before)``; ``before`` is the running total in the partition.

    The ids are little-endian, 16 bits where the vocabulary allows it and 32 otherwise (``wide``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes, before, blobs, wide = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(encode(text or "", vocabulary), np.uint32(END_ID))
                large = bool(ids.max() > 0xFFFF)
                blobs.append(ids.astype("<u4" if large else "<u2").tobytes())
                wide.append(large)
                sizes.append(len(ids))
                before.append(total)
                total += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(blobs, pa.binary()), pa.array(wide, pa.bool_()), pa.array(sizes, pa.int64()), pa.array([part] * len(sizes), pa.int32()), pa.array(before, pa.int64())],
                names=[id_col, "ids", "wide", "n", "part", "before"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, wide boolean, n long, part int, before long")


def concatenate_and_cut(docs: DataFrame, window: int = 1024, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into windows of ``window`` tokens; a row for each piece of a document.

    Columns: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. The first pass
    encodes each text once and keeps its ids with a running total inside the partition; the totals
    of the partitions (one small row each) are summed into offsets, and the second pass adds them
    and cuts. Neither pass moves a document to another task, so skew plays no part. A piece that
    fills or crosses a window ends there; only the very last window can be short, so padding is
    under one window for the whole corpus.

    A null or empty text is one token, the end id; repeated rows are packed as often as they occur; a very
    long text is encoded in pieces and cut into as many windows as it fills; an empty table gives no rows;
    other columns are ignored.
    """
    runs = materialize(token_runs(docs, vocabulary, id_col, text_col), "packing")
    totals = runs.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each partition of the scan, never for each document; as a written table it has a size that
    # Spark knows, and is broadcast only while that is below spark.sql.autoBroadcastJoinThreshold.
    bases = materialize(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")), "packing-bases")
    placed = runs.join(bases, "part").select(id_col, "ids", "wide", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, rows = batch.column(0), ([], [], [], [], [], [], [])
            for row, (blob, wide, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                ids = np.frombuffer(blob, dtype="<u4" if wide else "<u2").astype("<u4")
                starts = np.append(0, np.arange(window - at % window, len(ids), window))
                for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                    piece = (row, start, end - start, zlib.crc32(ids[start:end].tobytes()), len(ids), (at + start) // window, (at + start) % window)
                    for column, value in zip(rows, piece, strict=True):
                        column.append(value)
            longs = [pa.array(column, pa.int64()) for column in rows[1:]]
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(rows[0], pa.int64())), *longs], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
