"""Messages to points: gates, windows, identities, incremental writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.chunks import chunked
from ..functions.ids import memory_id, point_id
from ..functions.text import clamp_body, first_present, trimmed


def speaker_gate(speaker: Column, user: bool = True, assistant: bool = False, system: bool = False) -> Column:
    """Which speakers are taken; unknown ones follow the rule for users, tools that for the system."""
    role = F.lower(F.trim(F.coalesce(speaker, F.lit(""))))
    return F.when(role == "assistant", F.lit(assistant)).when(role.isin("system", "tool"), F.lit(system)).otherwise(F.lit(user))


def accepted(messages: DataFrame, **gates: bool) -> DataFrame:
    """Messages that the gates let through and that say something."""
    return messages.where(speaker_gate(F.col("speaker"), **gates) & (trimmed(F.col("text")) != ""))


def turn_windows(turns: DataFrame, window: int, overlap: int) -> DataFrame:
    """Sliding windows over the turns of each conversation.

    ``turns(conversation_id, turn, speaker, text)``, turns from 0. Each turn is listed under the
    windows it lies in, by arithmetic, so there is no join; blank turns drop out of a window's text.
    """
    step = max(1, window - min(overlap, window - 1))
    last = F.max("turn").over(Window.partitionBy("conversation_id"))
    # Windows start at multiples of the step and end with the first that reaches the last turn.
    final = F.ceil(F.greatest(F.col("last") + 1 - window, F.lit(0)) / step)
    first_window = F.greatest(F.ceil((F.col("turn") - window + 1) / step), F.lit(0))
    last_window = F.least(F.floor(F.col("turn") / step), final)
    placed = turns.withColumn("last", last).where(first_window <= last_window).select("*", F.explode(F.sequence(first_window, last_window)).alias("w")).where(trimmed(F.col("text")) != "")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.upper(F.trim("speaker")).alias("speaker"), trimmed(F.col("text")).alias("text"))))
    grouped = placed.groupBy("conversation_id", "w").agg(rows.alias("rows"))
    return grouped.select("conversation_id", (F.col("w") * step).cast("long").alias("start_turn"), F.size("rows").cast("long").alias("n_turns"), F.array_join(F.array_distinct("rows.speaker"), ",").alias("speakers"), F.array_join(F.transform("rows", lambda r: F.concat(r["speaker"], F.lit(": "), r["text"])), "\n\n").alias("text"))


def to_points(messages: DataFrame, size: int | None = 900, overlap: int = 150, least: int = 120) -> DataFrame:
    """Chunks with identities, summaries and quotes.

    ``messages`` has ``conversation_id, message_id, record_index, speaker, text, source_type, project``. With no ``size``, each message that
    says something is one point, and no row leaves the JVM.
    """
    if size is None:
        pieces = messages.withColumn("text", trimmed(F.col("text"))).where("text <> ''").withColumn("chunk", F.lit(0))
    else:
        pieces = chunked(messages, "text", size, overlap, least)
    key = memory_id(F.col("conversation_id"), F.col("message_id"), F.col("record_index"), F.col("chunk"))
    return pieces.withColumn("memory_id", key).withColumn("point_id", point_id(key)).withColumn("summary", clamp_body(F.col("text"), 220)).withColumn("source_quote", clamp_body(F.col("text"), 180)).withColumn("project", first_present(F.col("project"), F.lit("general")))


def embedded(points: DataFrame, embed: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], dimension: int, text: str = "text") -> DataFrame:
    """Adds ``embedding`` by an injected embedder of batches of texts; another length than ``dimension`` is an error."""
    ask = F.pandas_udf(embed, ArrayType(FloatType()), F.PandasUDFType.SCALAR_ITER)
    told = points.withColumn("embedding", ask(text))
    status = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    return told.withColumn("embedding", F.when(status, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding is missing or not of {dimension} numbers")).cast("array<float>")))


def message_records(records: DataFrame, as_of: Column) -> DataFrame:
    """Records of any import as messages: a title from the conversation, the present time where none is known."""
    when = F.coalesce(F.nullif(F.trim(F.coalesce("timestamp", F.lit(""))), F.lit("")), as_of)
    named = records.withColumn("timestamp", when)
    return named.withColumnRenamed("conversation_title", "source_title") if "conversation_title" in records.columns else named


def missing(points: DataFrame, stored: DataFrame) -> DataFrame:
    """Points that the store lacks; only they are embedded and written."""
    return points.join(stored.select("memory_id"), "memory_id", "left_anti")


def existence(ids: DataFrame, stored: DataFrame) -> DataFrame:
    """Each id and whether it is stored."""
    return ids.join(stored.select("memory_id", F.lit(True).alias("found")).distinct(), "memory_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def legacy_conversations(stored: DataFrame) -> DataFrame:
    """Conversations that hold ids by position."""
    return stored.where(~F.col("memory_id").contains("_msg_")).select(F.lower(F.trim("conversation_id")).alias("c")).distinct()


def guard_legacy(messages: DataFrame, stored: DataFrame, mode: str = "skip") -> DataFrame:
    """With ``skip`` and ``rewrite``, messages with an id stay out of legacy conversations; ``mixed`` lets all in."""
    if mode == "mixed":
        return messages
    keyed = messages.withColumn("c", F.when(F.trim(F.coalesce("message_id", F.lit(""))) != "", F.lower(F.trim("conversation_id"))))
    return keyed.join(legacy_conversations(stored), "c", "left_anti").drop("c")


def rewrite_map(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``(old_memory_id, new_memory_id)``: sorted legacy ids meet sorted new ids of a conversation by position."""
    place = Window.partitionBy("conversation_id").orderBy("memory_id")
    old = stored.where(~F.col("memory_id").contains("_msg_")).select("conversation_id", F.col("memory_id").alias("old_memory_id"), F.row_number().over(place).alias("n"))
    fresh = new.select("conversation_id", F.col("memory_id").alias("new_memory_id"), F.row_number().over(place).alias("n"))
    return old.join(fresh, ["conversation_id", "n"]).select("old_memory_id", "new_memory_id")


def integrity(before: int, after: int, embedded: int, deleted: int) -> None:
    """What was written must be what the table gained."""
    if after - before != embedded - deleted:
        raise RuntimeError(f"stored rows went from {before} to {after}, but {embedded} were written and {deleted} deleted")


def counters(messages: DataFrame, stored: DataFrame, points: DataFrame) -> DataFrame:
    """One row: records, chunks, chunks already stored."""
    found = existence(points.select("memory_id"), stored).agg(F.count("*").alias("chunks"), F.count_if("found").alias("stored"))
    return messages.agg(F.count("*").alias("records"), F.count_if(trimmed(F.col("text")) == "").alias("blank")).join(found)


def backfill(points: DataFrame, column: str, value: str) -> DataFrame:
    """Fills a column where it is blank."""
    return points.withColumn(column, F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", F.lit(value)).otherwise(F.col(column)))


# Code points of a key, the step at which long messages were cut, and the shortest text that is looked for inside others.
KEY_CHARS, SLICE_CHARS, LEAST_INSIDE = 100, 1400, 40


def archive_matches(chunks: DataFrame, archive: DataFrame) -> DataFrame:
    """``(memory_id, message_id, basis)``: stored chunks found again in an export.

    ``chunks(conversation_id, memory_id, text)``, ``archive(conversation_id, message_id, pos, text)``. In turn: an equal text, an equal beginning, the
    beginning of a slice of a long message, a short message that the chunk begins with, a message that contains the chunk; of several messages
    the first. Every step is an equality join of digests inside a conversation; only what is left over goes on to the last two.
    """
    norm = lambda df: df.withColumn("n", F.btrim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))).where("n <> ''")
    left, right = norm(chunks).select("conversation_id", "memory_id", "n"), norm(archive).select("conversation_id", "message_id", "pos", "n")
    starts = F.sequence(F.lit(0), F.char_length("n") - 1, F.lit(SLICE_CHARS))
    slices = F.when(F.char_length("n") > SLICE_CHARS, F.transform(starts, lambda at: F.struct(F.lit(2).alias("step"), F.substring("n", at + 1, F.lit(KEY_CHARS)).alias("key")))).otherwise(F.array().cast("array<struct<step: int, key: string>>"))
    keys = F.concat(F.array(F.struct(F.lit(0).alias("step"), F.col("n").alias("key")), F.struct(F.lit(1).alias("step"), F.substring("n", 1, KEY_CHARS).alias("key"))), slices)
    listed = right.select("conversation_id", "message_id", "pos", F.explode(keys).alias("k")).select("conversation_id", "k.step", F.char_length("k.key").alias("chars"), F.sha2("k.key", 256).alias("key"), F.struct("pos", "message_id").alias("m"))
    index = listed.groupBy("conversation_id", "step", "chars", "key").agg(F.min("m").alias("m"))
    asked = F.array(F.struct(F.lit(0).alias("step"), F.sha2("n", 256).alias("key")), *(F.struct(F.lit(step).alias("step"), F.sha2(F.substring("n", 1, KEY_CHARS), 256).alias("key")) for step in (1, 2)))
    exact = left.select("conversation_id", "memory_id", F.explode(asked).alias("k")).select("conversation_id", "memory_id", "k.step", "k.key").join(index.drop("chars"), ["conversation_id", "step", "key"]).select("memory_id", "step", "m")
    rest = left.join(exact, "memory_id", "left_anti")
    short = index.where(f"step > 0 and chars < {KEY_CHARS}").select("conversation_id", "key", "m", "step")
    lengths = F.sequence(F.lit(1), F.least(F.char_length("n"), F.lit(KEY_CHARS - 1)))
    begins = rest.select("conversation_id", "memory_id", F.explode(F.transform(lengths, lambda k: F.sha2(F.substring("n", F.lit(1), k), 256))).alias("key")).join(short, ["conversation_id", "key"]).select("memory_id", F.lit(3).alias("step"), "m")
    inside = rest.join(begins, "memory_id", "left_anti").where(F.char_length("n") >= LEAST_INSIDE).withColumn("gram", F.sha2(F.substring("n", 1, LEAST_INSIDE), 256)).withColumnRenamed("n", "chunk")
    bodies = right.join(inside.select("conversation_id").distinct(), "conversation_id", "left_semi").where(F.char_length("n") >= LEAST_INSIDE)
    grams = bodies.select("conversation_id", "message_id", "pos", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("n") - LEAST_INSIDE + 1), lambda at: F.sha2(F.substring("n", at, F.lit(LEAST_INSIDE)), 256)))).alias("gram"))
    met = inside.join(grams, ["conversation_id", "gram"]).join(right.select("message_id", "conversation_id", "n"), ["conversation_id", "message_id"]).where(F.col("n").contains(F.col("chunk")))
    held = met.select("memory_id", F.lit(4).alias("step"), F.struct("pos", "message_id").alias("m"))
    best = exact.unionByName(begins).unionByName(held).groupBy("memory_id").agg(F.min(F.struct("step", "m")).alias("b"))
    basis = F.get(F.array(*map(F.lit, ("text", "prefix", "slice", "begins", "contains"))), F.col("b.step"))
    return chunks.select("memory_id").join(best, "memory_id", "left").select("memory_id", F.col("b.m.message_id").alias("message_id"), basis.alias("basis"))


def rekeyed(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Points under their new ids."""
    met = points.join(mapping.withColumnRenamed("old_memory_id", "memory_id"), "memory_id", "left")
    return met.withColumn("memory_id", F.coalesce("new_memory_id", "memory_id")).drop("new_memory_id")
