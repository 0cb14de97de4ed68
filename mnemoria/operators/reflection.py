"""Around a reflecting model: incremental input, shards, caps, decisions, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5

REFLECTION = "phase string, depth string, confidence double, themes array<string>, questions array<string>, echoes array<string>, contradiction boolean"
# How deep a reflection is.
DEPTHS = {"shallow": 0, "moderate": 1, "deep": 2, "profound": 3}


def pending(cleaned: DataFrame, reflected: DataFrame, needs_review: bool = False, least: int = 20, speaker: str = "") -> DataFrame:
    """Safe points not reflected on yet, of one speaker or of all."""
    gate = F.lit(True) if needs_review else F.col("safe_for_reflection")
    if speaker and speaker.lower() != "all":
        gate = gate & (F.lower(F.trim("speaker")) == speaker.lower())
    return cleaned.where(gate & (F.char_length(F.trim("text")) >= least)).join(reflected.select("memory_id"), "memory_id", "left_anti")


def worker_slot(workers: int) -> Callable[[Column], Column]:
    """The shard of an id, the same on any machine: its name-based UUID as a number, modulo ``workers``."""

    def slot(key: Column) -> Column:
        digits = F.replace(uuid5(key), F.lit("-"), F.lit(""))
        high, low = (F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
        return ((high % workers * (2**64 % workers) + low % workers) % workers).cast("int")

    return slot


def answered(raw: Column) -> Column:
    """The JSON of an answer without the fence of code around it."""
    text = F.trim(raw)
    inner = F.element_at(F.split(text, "```"), 2)
    return F.when(text.startswith("```"), F.regexp_replace(inner, "^json", "")).otherwise(text)


def reflect(points: DataFrame, model: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> DataFrame:
    """Answers of an injected model as JSON, parsed.

    A point is asked about if its text, or else its quote, has 20 characters and its quote is not missing; all others, and answers that are no
    JSON, are shallow reflections of no confidence. A phase is unknown where the answer names none or phases do not apply to the point.
    """
    given = lambda c: F.col(c) if c in points.columns else F.lit(None).cast("string")
    said = F.trim(F.coalesce(F.nullif(given("text"), F.lit("")), given("source_quote"), F.lit("")))
    asked = F.coalesce((F.col("quality") != "missing"), F.lit(True)) & (F.char_length(said) >= 20)
    ask = F.pandas_udf(model, "string", F.PandasUDFType.SCALAR_ITER)
    told = points.where(asked).withColumn("r", F.from_json(answered(ask(said)), f"{REFLECTION}, broken string", {"columnNameOfCorruptRecord": "broken"}))
    told = told.unionByName(points.where(~asked).withColumn("r", F.lit(None).cast(told.schema["r"].dataType)))
    fine, unknown = F.col("r").isNotNull() & F.col("r.broken").isNull(), F.lit("unknown")
    phase = F.when(~fine | (F.coalesce(given("phase_applicability"), F.lit("")) == "not_applicable"), unknown).otherwise(F.coalesce(F.nullif(F.col("r.phase"), F.lit("")), unknown))
    depth = F.when(fine, F.coalesce(F.nullif(F.col("r.depth"), F.lit("")), F.lit("shallow"))).otherwise("shallow")
    lists = (F.when(fine, F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias(c) for c in ("themes", "questions", "echoes"))
    return told.select(*points.columns, phase.alias("phase"), depth.alias("depth"), F.when(fine, capped(F.coalesce("r.confidence", F.lit(0.0)), F.col("quality"))).otherwise(F.lit(0.0)).alias("confidence"), *lists, F.coalesce(fine & F.col("r.contradiction"), F.lit(False)).alias("contradiction"))


def capped(confidence: Column, quality: Column) -> Column:
    """No more confidence than the quote bears."""
    most = F.when(quality == "malformed", 0.35).when(quality.isin("partial", "truncated"), 0.75).otherwise(1.0)
    return F.least(F.greatest(confidence, F.lit(0.0)), most)


def decision(confidence: Column, depth: Column, themes: Column, questions: Column, echoes: Column, contradiction: Column) -> Column:
    """``contradiction, interesting, skip``."""
    interesting = (confidence >= 0.6) | (themes >= 3) | (questions >= 2) | (echoes >= 2) | depth.isin("deep", "profound")
    return F.when(contradiction, "contradiction").when(interesting, "interesting").otherwise("skip")


def by_phase_and_depth(reflections: DataFrame) -> DataFrame:
    """Counts and mean confidence."""
    return reflections.groupBy("phase", "depth").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def reflections_where(reflections: DataFrame, phase: str = "", depth: str = "", speaker: str = "", contradiction: bool = False) -> DataFrame:
    """Reflections that agree with the fields given, the surest first."""
    found = reflections
    for name, value in (("phase", phase), ("depth", depth), ("speaker", speaker)):
        if value:
            found = found.where(F.col(name) == value)
    return (found.where("contradiction") if contradiction else found).orderBy(F.desc("confidence"), "memory_id")


def run_counters(cleaned: DataFrame, reflected: DataFrame, told: DataFrame) -> DataFrame:
    """One row on a run: safe points, those reflected before, those told now, and how they turned out."""
    before = cleaned.where("safe_for_reflection").select("memory_id").join(reflected.select("memory_id", F.lit(True).alias("done")).distinct(), "memory_id", "left").agg(F.count("*").alias("safe"), F.count("done").alias("reflected_before"))
    now = told.agg(F.count("*").alias("told"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("contradiction", "interesting", "skip")))
    return before.join(now)


def section_summary(hits: DataFrame) -> DataFrame:
    """Per section: the most frequent phase, mean score and confidence, and the whole percentage of the user's own words."""
    phases = hits.groupBy("section", F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.count("*").alias("n")).groupBy("section").agg(F.min(F.struct((-F.col("n")).alias("n"), "phase")).alias("p"))
    means = hits.groupBy("section").agg(F.count("*").alias("hits"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean_score"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("mean_confidence"), F.floor(100 * F.count_if(F.col("speaker") == "user") / F.count("*")).cast("long").alias("user_percent"))
    return means.join(phases, "section").select("section", "hits", F.col("p.phase").alias("top_phase"), "mean_score", "mean_confidence", "user_percent")
