"""What the training-data operators share: tables, the shared scratch folder, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many rows; there are fewer hot keys than this, whatever the data.
HOT_SHARE = 2048


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has no folder that all
    executors see, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = local_folder()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def local_folder() -> str:
    """A temporary folder for local sessions, one for each process of the driver."""
    return tempfile.mkdtemp(prefix="spark-")


def materialize(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage at a point that survives lost executors: later stages read files
    that the commit protocol made visible once, whichever task attempt wrote them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex64(col: Column) -> Column:
    """A signed 64-bit value as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while ``df`` has such a column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """What names a row: its id and 64 bits of its text, so an id that comes with several texts is no special case."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """The keys of more than one row in :data:`HOT_SHARE`, as a written table of fewer than that many rows.

    ``counts`` has a row for each key; ``total`` is the sum of ``n``, where it is known. The bound holds for any data: the rows of the keys listed add up to
    no more than all rows.
    """
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    return materialize(counts.where(F.col(n) * HOT_SHARE > total).select(key), "hot-keys")


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has at most one row for each key.

    A key may hold a third of the rows. Hot keys are met by a broadcast of their few rows of
    ``per_key``, where the rows lie; only the others are shuffled. ``rows`` and ``per_key`` are
    read twice and had better be written tables.
    """
    hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key, "n", rows.count())
    few = F.broadcast(per_key.join(F.broadcast(hot), key, "left_semi"))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(per_key, key)
    return rows.join(few, key).unionByName(rest)
