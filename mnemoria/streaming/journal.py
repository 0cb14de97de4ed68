"""Journals of imports: what a table is filled from, and which of its batches count."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
IDENTITY = "version int, identity map<string, string>"
COMMITS = "batch long, points long, last_record_index long"


class OtherImport(ValueError):
    """A journal belongs to another import."""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder, none where it isn't there; a damaged row is an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def open_journal(spark: SparkSession, journal: str, **identity: object) -> bool:
    """Whether the journal has been begun before; another identity or version is refused, so nothing is skipped that another import did.

    Values are compared trimmed, paths without a slash at the end. A new journal is given its identity at once, before any batch.
    """
    own = {name: str("" if value is None else value).strip().rstrip("/") for name, value in identity.items()}
    rows = read_json(spark, f"{journal}/identity", IDENTITY).limit(2).collect()
    if not rows:
        spark.createDataFrame([(VERSION, own)], IDENTITY).coalesce(1).write.mode("overwrite").json(f"{journal}/identity")
        return False
    version, found = rows[0]
    if version != VERSION:
        raise OtherImport(f"{journal} has version {version}, not {VERSION}")
    if found != own:
        other = ", ".join(f"{name}={found.get(name)!r}, not {own.get(name)!r}" for name in sorted(found.keys() | own.keys()) if found.get(name) != own.get(name))
        raise OtherImport(f"{journal} is for another import ({other}); take another journal to start anew")
    return True


def commit(spark: SparkSession, journal: str, batch: int, points: int, last_record_index: int | None) -> None:
    """Names a batch as written. It is the last step of a batch; a batch that is run again names itself anew."""
    row = (batch, points, -1 if last_record_index is None else last_record_index)
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("overwrite").json(f"{journal}/batches/n={batch}")


def commits(spark: SparkSession, journal: str) -> DataFrame:
    """``batch, points, last_record_index`` of the batches that count."""
    return read_json(spark, f"{journal}/batches", COMMITS)


def position(spark: SparkSession, journal: str) -> DataFrame:
    """One row: batches, points, and the furthest record of any batch, so it never moves back; -1 before the first."""
    return commits(spark, journal).agg(F.count("*").alias("batches"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.coalesce(F.max("last_record_index"), F.lit(-1)).alias("last_record_index"))


def remaining(conversations: DataFrame, journal: str) -> DataFrame:
    """The conversations that earlier runs have not finished, by their trimmed ids."""
    done = read_json(conversations.sparkSession, f"{journal}/finished", "conversation_id string")
    return conversations.join(done.withColumnRenamed("conversation_id", "done"), F.trim("conversation_id") == F.col("done"), "left_anti")


def finish(conversations: DataFrame, journal: str) -> None:
    """Adds conversations to those that are finished, each once, none without an id."""
    new = remaining(conversations, journal).select(F.trim("conversation_id").alias("conversation_id")).where("conversation_id <> ''").distinct()
    new.write.mode("append").json(f"{journal}/finished")
