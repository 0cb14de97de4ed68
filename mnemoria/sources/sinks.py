"""Writers: exports, id maps, audit rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# What a batch of a write may hold.
BATCH_POINTS, BATCH_BYTES = 128, 24 * 1024 * 1024


def export_json(points: DataFrame, path: str) -> None:
    """All columns, one object a line (K8, K9)."""
    points.write.mode("overwrite").json(path)


def export_bundles(rows: DataFrame, path: str, bundle: Column, order: Column, wrapper: str = "") -> None:
    """A file for each value of ``bundle``: an array of its rows by ``order``, or ``{wrapper: array}`` (K9).

    Readers of whole files take them; ``bundle`` bounds what a file holds, so it must not be a name that many rows share.
    ``order`` must not be null.
    """
    held = F.collect_list(F.struct(order.alias("place"), F.struct(*rows.columns).alias("row")))
    by_place = F.array_sort(held, lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    packed = rows.groupBy(bundle.alias("bundle")).agg(F.transform(by_place, lambda r: r["row"]).alias("rows"))
    # The limit of one row makes each bundle a file.
    if wrapper:
        packed.select(F.col("rows").alias(wrapper)).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
    else:
        packed.select(F.to_json("rows")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def export_id_map(mapping: DataFrame, path: str) -> None:
    """``old_memory_id,new_memory_id`` with a header."""
    mapping.select("old_memory_id", "new_memory_id").write.mode("overwrite").option("header", True).csv(path)


def append_audit(changes: DataFrame, path: str, action: str, as_of: Column) -> None:
    """A row for each accepted change."""
    changes.select("memory_id", F.lit(action).alias("action"), as_of.alias("at")).write.mode("append").parquet(path)


def batches(points: DataFrame, size: Column, most: int = BATCH_POINTS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Adds ``batch``, at most ``most`` rows and ``most_bytes`` each (K3). Rows stay in their partitions, in the order they have.

    A batch depends on where the one before it ended, so a task counts through its rows: only sizes go
    to Python. A row that is larger than a batch may be is an error.
    """
    own = points.select("*", size.cast("long").alias("_bytes"))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, filled = TaskContext.get().partitionId(), 0, 0, 0
        for batch in parts:
            names = []
            for nbytes in batch.column(batch.num_columns - 1).to_pylist():
                nbytes = nbytes or 0
                if nbytes > most_bytes:
                    raise ValueError(f"a point of {nbytes} bytes exceeds the {most_bytes} bytes of a batch")
                if rows and (rows >= most or filled + nbytes > most_bytes):
                    number, rows, filled = number + 1, 0, 0
                rows, filled = rows + 1, filled + nbytes
                names.append(f"{part}-{number}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string())], names=[*batch.schema.names[:-1], "batch"])

    return own.mapInArrow(deal, StructType([*points.schema.fields, StructField("batch", StringType())]))


def write_cleaned(rows: DataFrame, path: str, part_by: str = "cleanup_status") -> None:
    """Cleaned points as a table of their own, by status."""
    rows.write.mode("overwrite").partitionBy(part_by).parquet(path)


def reflected_points(points: DataFrame, reflections: DataFrame) -> DataFrame:
    """Points with the four flags of their reflection; others stay as they are."""
    flags = {"reflected": "boolean", "reflection_phase": "string", "reflection_depth": "string", "reflection_confidence": "double"}
    new = reflections.select("memory_id", F.lit(True).alias("new_reflected"), F.col("phase").alias("new_reflection_phase"), F.col("depth").alias("new_reflection_depth"), F.col("confidence").cast("double").alias("new_reflection_confidence"))
    met = points.join(new, "memory_id", "left")
    old = {name: F.col(name) if name in points.columns else F.lit(None).cast(kind) for name, kind in flags.items()}
    return met.select(*(c for c in points.columns if c not in flags), *(F.coalesce(f"new_{name}", column).alias(name) for name, column in old.items()))
