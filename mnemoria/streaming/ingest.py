"""Incremental ingest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import accepted, to_points
from .journal import commit, commits, open_journal

MESSAGES = "conversation_id string, message_id string, record_index long, speaker string, text string, source_type string, project string"


def ingest_stream(spark: SparkSession, source: str, table: str, checkpoint: str, max_files: int = 16, every: str | None = None, model: str = "", size: int | None = 900) -> StreamingQuery:
    """New message files to new points; a run after a crash or over the same files changes nothing.

    The checkpoint keeps which files are done, and the journal beside it which import this is and which batches count: another source, table or
    model is refused (W1-W3). Each micro-batch overwrites its own folder, writes only ids that earlier batches that count lack, and is named in the
    journal last, so a batch that is run again gives the same rows (W4). With ``every``, such as ``300 seconds``, the stream goes on;
    without it, it ends when what is there has been taken (W5).
    """
    journal = journal_of(checkpoint)
    open_journal(spark, journal, source=source, table=table, model=model)
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", max_files).json(source)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        points = to_points(accepted(batch, assistant=True), size=size).dropDuplicates(["memory_id"])
        read, new = Observation(), Observation()
        points = points.observe(read, F.max("record_index").alias("last"))
        stored = ingested(session, table, checkpoint)
        if stored is not None:
            points = points.join(stored.where(F.col("batch") < number).select("memory_id"), "memory_id", "left_anti")
        points.observe(new, F.count("*").alias("points")).write.mode("overwrite").parquet(f"{table}/batch={number}")
        commit(session, journal, number, new.get["points"], read.get["last"])

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def journal_of(checkpoint: str) -> str:
    return checkpoint.rstrip("/") + "_journal"


def ingested(spark: SparkSession, table: str, checkpoint: str) -> DataFrame | None:
    """The points of all batches that the journal names, or nothing before the first; what a killed run left is not read."""
    try:
        written = spark.read.parquet(table)
    except AnalysisException:
        return None
    # One short row for each batch; the join prunes folders.
    return written.join(commits(spark, journal_of(checkpoint)).select("batch"), "batch", "left_semi")
