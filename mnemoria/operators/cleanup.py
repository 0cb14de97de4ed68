"""Cleaning of stored points: quality of quotes, kinds, scopes, duplicates, blockers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.text import speaker_role, trimmed
from ..functions.times import normalized

# Words that mark a domain.
SPIRITUAL = ("awakening", "consciousness", "operation new earth", "higher self", "metaphysical", "ra material", "seth", "dolores cannon", "spiritual")
TECHNICAL = ("python", "database", "server", "cad", "inventory", "sql", "go", "docker", "script", "coding")
# Words in a title, the project they hint at, and the confidence; the first that fits counts.
PROJECT_HINTS = (
    ("modular steel inventory", "Steel Inventory", 0.8),
    ("steel inventory", "Steel Inventory", 0.75),
    ("tts voices", "TTS Voices", 0.75),
    ("audio", "Audio Tools", 0.6),
    ("awakening infinite potential", "Awakening Infinite Potential", 0.9),
    ("operation new earth", "Operation New Earth", 0.9),
    ("best llms for lm studio", "LM Studio / Local LLM Setup", 0.9),
    ("lm studio", "LM Studio / Local LLM Setup", 0.8),
    ("nvidia", "LM Studio / Local LLM Setup", 0.75),
)
# Words that mark the kind of a point.
HISTORY = ("decision", "decided", "milestone", "shipped", "implemented")
PREFERENCE = ("prefer", "preference", "i like", "i want", "i don't want")
PERSONA = ("persona", "instruction", "voice", "style", "how you should")
DECISION = ("decide", "decision", "we will", "we should")
SUPPORT = ("user said", "mark said", "preference")
# The longest field that is no oddity.
OVERSIZED = 16000
END_MARKS = ".!?\"'”’"
MEMORY_ID = r"^(.+)_turn_(\d+)_chunk_(\d+)$"


def chunk_positions(points: DataFrame) -> DataFrame:
    """Adds ``chunk_position``: ``single, first, middle, last`` (Q1).

    The largest chunk of a turn is a maximum over ids alone, with map-side combination; points whose id
    names no turn take no part in it, and texts are not moved.
    """

    def part(k: int) -> Column:
        return F.regexp_extract("memory_id", MEMORY_ID, k)

    parsed = points.withColumn("p_conv", part(1)).withColumn("p_turn", part(2).try_cast("int")).withColumn("p_chunk", part(3).try_cast("int"))
    most = parsed.where("p_chunk is not null").groupBy("p_conv", "p_turn").agg(F.max("p_chunk").alias("p_most")).where("p_most > 1")
    # Ids that name no turn would all meet under one key.
    names_turn = F.col("p_turn").isNotNull() & F.col("p_chunk").isNotNull()
    met = parsed.where(names_turn).join(most, ["p_conv", "p_turn"], "left")
    position = F.when(F.col("p_most").isNull(), "single").when(F.col("p_chunk") <= 1, "first").when(F.col("p_chunk") >= F.col("p_most"), "last").otherwise("middle")
    return met.select(*points.columns, position.alias("chunk_position")).unionByName(parsed.where(~names_turn).select(*points.columns, F.lit("single").alias("chunk_position")))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: a generated column is no part of the conditions and columns made from it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def has_any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a text that is at hand has any of the phrases; plain searches are faster than an alternation."""
    return reduce(Column.__or__, (text.contains(phrase) for phrase in phrases))


def quote_warnings(quote: Column) -> Column:
    """What looks wrong about a quote (Q2)."""
    return bound(trimmed(quote), trimmed_warnings)


def trimmed_warnings(t: Column) -> Column:
    n_words = F.size(F.split(t, r"(?U)\s+", 5))  # more than four need no count
    count = lambda c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    checks = [
        (F.char_length(t) < 20, "very_short_quote"),
        (t.startswith("...") | t.endswith("..."), "ellipsis_truncation"),
        (t.rlike(r"^[a-z]{2,}[^\s]"), "possible_midword_start"),
        (t.rlike("^[a-z]") & (n_words > 2), "starts_lower_fragment"),
        (~F.substring(t, -1, 1).isin(*END_MARKS), "ends_mid_sentence"),
        (count("(") != count(")"), "unmatched_parentheses"),
        (n_words < 4, "low_semantic_content"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in checks)))
    return F.when(t == "", F.array(F.lit("missing_quote"))).otherwise(found)


def quote_quality(warnings: Column, position: Column) -> Column:
    """``missing, malformed, truncated, partial, complete``; edges count only where a turn begins or ends (Q2)."""
    has = lambda name: F.array_contains(warnings, name)
    first, last = position.isin("single", "first"), position.isin("single", "last")
    return (
        F.when(has("missing_quote"), "missing")
        .when(has("unmatched_parentheses") | (first & (has("possible_midword_start") | has("starts_lower_fragment"))), "malformed")
        .when(has("ellipsis_truncation") | (last & has("ends_mid_sentence")), "truncated")
        .when(F.size(warnings) > 0, "partial")
        .otherwise("complete")
    )


def project_hint(title: Column) -> Column:
    """``struct<hint, confidence>`` of the first keyword in the title (Q3)."""
    text = F.lower(F.coalesce(title, F.lit("")))
    found = F.struct(F.lit(None).cast("string").alias("hint"), F.lit(0.0).alias("confidence"))
    for word, hint, confidence in reversed(PROJECT_HINTS):
        found = F.when(text.contains(word), F.struct(F.lit(hint).alias("hint"), F.lit(confidence).alias("confidence"))).otherwise(found)
    return found


def domain(*texts: Column) -> Column:
    """``mixed, spiritual, technical, general`` (Q4)."""
    def named(s: Column, t: Column) -> Column:
        return F.when(s & t, "mixed").when(s, "spiritual").when(t, "technical").otherwise("general")

    return bound(F.lower(F.concat_ws(" ", *texts)), lambda blob: named(has_any(blob, SPIRITUAL), has_any(blob, TECHNICAL)))


def phase(role: Column, of: Column) -> Column:
    """Whether phases of reflection apply (Q5)."""
    return F.when((role == "assistant") & (of == "technical"), "not_applicable").when(of == "mixed", "uncertain").when(of == "spiritual", "applicable").when(of == "technical", "not_applicable").otherwise("uncertain")


def phase_warning(role: Column, of: Column) -> Column:
    """Why phases don't apply or are uncertain; null where they apply (Q5)."""
    return F.when((role == "assistant") & (of == "technical"), "assistant_technical_content").when(of == "mixed", "mixed_spiritual_technical_signals").when(of == "technical", "technical_content_detected").when(of != "spiritual", "insufficient_phase_signal")


def user_support(context: Column) -> Column:
    """Whether any of the neighbouring messages ``array<struct<speaker, text>>`` is a user's (Q6)."""
    said = lambda m: (F.lower(F.trim(F.coalesce(m["speaker"], F.lit("")))) == "user") | F.lower(F.coalesce(m["text"], F.lit(""))).startswith("user:")
    return F.coalesce(F.exists(context, said), F.lit(False))


def kind(role: Column, blob: Column, of: Column, supported: Column | None = None) -> Column:
    """What a point is, by its speaker and words; an assistant that reports what its user said states a fact (Q7)."""
    by_assistant = F.when((F.lit(False) if supported is None else supported) & has_any(blob, SUPPORT), "user_asserted_fact").when(has_any(blob, HISTORY), "project_support_history").otherwise("assistant_guidance")
    by_user = F.when(has_any(blob, PREFERENCE), "preference").when(has_any(blob, PERSONA), "persona_instruction").when(has_any(blob, DECISION), "project_decision").otherwise("user_asserted_fact")
    return F.when(role == "assistant", by_assistant).when(role == "user", by_user).when(role.isin("system", "tool") | (of == "technical"), "project_support_history").otherwise("unknown")


def scopes(role: Column, of: Column, supported: Column) -> dict[str, Column]:
    """What a point may be used for; ``supported`` is an assistant's report of its user (Q7)."""
    user, assistant = role == "user", role == "assistant"
    known = role.isin("user", "assistant", "system", "tool")
    return {
        "usable_for_user_profile": user | (assistant & supported),
        "usable_for_project_history": known | (of == "technical"),
        "usable_for_assistant_guidance": role.isin("user", "assistant", "system"),
        "usable_for_persona_memory": user | (assistant & supported),
        "usable_for_canon": role != "mixed",
    }


def evidence(quote: Column, text: Column, quality: Column) -> Column:
    """``none, weak, medium, strong`` by length (Q8)."""
    total = F.char_length(trimmed(quote)) + F.char_length(trimmed(text))
    return F.when(quality.isin("missing", "malformed"), "none").when(total < 80, "weak").when(total < 240, "medium").otherwise("strong")


# The scope of reflection that goes with the strength of evidence.
REFLECTION_SCOPES = {"none": "not_enough_context", "weak": "quote_only", "medium": "quote_plus_context", "strong": "cluster_context"}


def marked_repeats(rows: DataFrame, key: str, content: str, *order: str, ids: DataFrame | None = None) -> DataFrame:
    """Adds ``repeated`` (the key came before) and ``duplicate_of`` (with the same content), in ``order`` (Q9).

    Only ids that occur more than once are ordered, and their list is made from the ids alone: all other
    rows, with their texts, stay where they are. ``ids`` has the same keys where ``rows`` cost more to make.
    """
    several = (rows if ids is None else ids).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    nothing = [F.lit(False).alias("repeated"), F.lit(None).cast("string").alias("duplicate_of")]
    single = rows.join(several, key, "left_anti").select("*", *nothing)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, content))
    of_content = F.row_number().over(Window.partitionBy(key, content).orderBy(*order))
    others = rows.join(several, key, "left_semi").withColumn("place", place).withColumn("again", of_content)
    return single.unionByName(others.select(*rows.columns, (F.col("place") > 1).alias("repeated"), F.when(F.col("again") > 1, F.col(key)).alias("duplicate_of")))


def optional(points: DataFrame, name: str, kind_of: str) -> Column:
    return F.col(name) if name in points.columns else F.lit(None).cast(kind_of)


def cleaned(points: DataFrame, repair: bool = True) -> DataFrame:
    """Every point with its quality, kind, scopes, blockers and cleanup status (Q1-Q13).

    Points come in the order of ``ts``: an id that came before is a duplicate record, and one with
    the same content a duplicate. ``payload_error``, ``timestamp``, ``context`` (neighbouring messages) and ``embedding``
    are used where the table has them.
    """
    rows = chunk_positions(points)
    # What needs whole texts is worked out once and before texts are joined, so that they are not moved where only their signs are asked for.
    rows = once(rows, "_trimmed", F.struct(trimmed(F.col("text")).alias("text"), trimmed(F.col("source_quote")).alias("quote")))
    text, quote = F.col("_trimmed.text"), F.col("_trimmed.quote")
    rows = once(rows, "quote_warnings", trimmed_warnings(F.when(text != "", text).otherwise(quote))).withColumn("_n_text", F.char_length(text))
    role = speaker_role(F.col("speaker"))
    raw_role = F.lower(trimmed(F.col("speaker")))
    rows = once(rows.withColumn("role", role), "quality", quote_quality(F.col("quote_warnings"), F.col("chunk_position")))
    rows = rows.withColumn("chunk_boundary_warning", F.array_contains("quote_warnings", "ellipsis_truncation"))
    repaired = F.lit(repair) & F.col("quality").isin("partial", "truncated") & (F.char_length(quote) >= 20)
    rows = rows.withColumn("repaired", repaired).withColumn("quality", F.when(F.col("repaired"), "repaired").otherwise(F.col("quality")))
    rows = rows.withColumn("source_quote_original", F.col("source_quote")).withColumn("source_quote", F.when(F.col("repaired"), F.trim(F.translate(quote, "\n", " "))).otherwise(quote))
    rows = rows.withColumn("memory_id", F.coalesce("memory_id", F.lit(""))).withColumn("content_hash", F.sha2(F.concat_ws("\x1f", "memory_id", "source_quote", text), 256))
    rows = marked_repeats(rows.drop("_trimmed"), "memory_id", "content_hash", "ts", ids=points.select(F.coalesce("memory_id", F.lit("")).alias("memory_id")))
    raw = domain(F.coalesce("source_title", F.lit("")), F.coalesce("project", F.lit("")), F.col("text"))
    rows = rows.withColumn("domain", raw).withColumn("domain", F.when((F.col("role") == "assistant") & (F.col("domain") != "spiritual"), "technical").otherwise(F.col("domain")))
    blob = F.lower(F.concat_ws(" ", F.coalesce("source_title", F.lit("")), "text", "source_quote"))
    short = (F.col("_n_text") < 20) & (F.char_length("source_quote") < 20)
    broken = F.coalesce(optional(points, "payload_error", "boolean"), F.lit(False))
    _, time_warning = normalized(F.col("timestamp")) if "timestamp" in points.columns else (None, F.lit(None).cast("string"))
    # The labels of blockers.
    blockers = F.array_sort(F.array_compact(F.array(
        F.when(broken, F.lit("corrupted_json")), F.when(time_warning == "malformed_timestamp", F.lit("unsupported_schema")),
        F.when(F.col("memory_id") == "", F.lit("missing_source_id")), F.when(F.col("repeated"), F.lit("duplicate_record")),
        F.when(F.col("quality") == "missing", F.lit("missing_quote")), F.when(F.col("quality") == "malformed", F.lit("malformed_quote")),
        F.when(short, F.lit("insufficient_context")), F.when((F.col("_n_text") == 0) & (F.col("source_quote") == ""), F.lit("vector_only_payload")),
    )))
    near_user = user_support(F.col("context")) if "context" in points.columns else None
    supported = F.lit(False) if near_user is None else near_user & bound(blob, lambda b: has_any(b, SUPPORT))
    rows = rows.withColumn("blockers", blockers).withColumn("kind", bound(blob, lambda b: kind(F.col("role"), b, F.col("domain"), near_user))).withColumn("phase", phase(F.col("role"), F.col("domain"))).withColumn("evidence", evidence(F.col("source_quote"), F.col("text"), F.col("quality")))
    for name, usable in scopes(F.col("role"), F.col("domain"), supported).items():
        rows = rows.withColumn(name, usable)
    vector = optional(points, "embedding", "array<double>")
    long_field = F.greatest(*(F.char_length(F.coalesce(F.col(c), F.lit(""))) for c in ("source_quote_original", "text", "summary") if c in (*points.columns, "source_quote_original"))) > OVERSIZED
    blank = lambda name: F.trim(F.coalesce(optional(points, name, "string"), F.lit(""))) == ""
    # The labels of warnings.
    warnings = F.array_sort(F.array_distinct(F.concat("quote_warnings", F.array_compact(F.array(
        F.when(raw_role == "", F.lit("missing_speaker")).when(raw_role.isin("ai", "model", "bot"), F.lit("speaker_normalized_from_alias")).when((F.col("role") == "unknown") & (raw_role != "unknown"), F.lit("unknown_speaker")),
        time_warning, F.when(blank("project"), F.lit("empty_project")), F.when(blank("source_title"), F.lit("missing_source_title")), F.when(blank("conversation_id"), F.lit("missing_conversation_id")),
        phase_warning(F.col("role"), F.col("domain")), F.when(F.col("role") == "mixed", F.lit("source_separation_required")), F.when(long_field, F.lit("oversized_fields")),
    )))))
    hint = project_hint(F.col("source_title"))
    unnamed = blank("project")
    status = (
        F.when(F.col("duplicate_of").isNotNull(), "skipped_duplicate").when(F.array_contains("blockers", "corrupted_json"), "failed").when(F.size("blockers") > 0, "needs_review")
        .when(F.col("repaired"), "repaired").when(F.col("quality").isin("partial", "truncated"), "needs_review").otherwise("clean")
    )
    scope = F.element_at(F.create_map(*(F.lit(x) for pair in REFLECTION_SCOPES.items() for x in pair)), F.col("evidence"))
    return (
        rows.withColumn("cleanup_status", status).withColumn("safe_for_reflection", F.size("blockers") == 0).withColumn("warnings", warnings)
        .withColumn("cleaned_id", uuid5(F.concat(F.lit("cleaned:"), "memory_id", F.lit(":"), "content_hash"))).withColumn("dedupe_key", F.concat("memory_id", F.lit(":"), F.substring("content_hash", 1, 16)))
        .withColumn("duplicate_confidence", F.when(F.col("duplicate_of").isNotNull(), 0.99).otherwise(0.0)).withColumn("repair_method", F.when(F.col("repaired"), "whitespace_normalization").otherwise("none")).withColumn("repair_confidence", F.when(F.col("repaired"), 0.35).otherwise(0.0))
        .withColumn("project_hint", F.when(unnamed, hint["hint"])).withColumn("project_confidence", F.when(unnamed, hint["confidence"]).otherwise(1.0)).withColumn("reflection_scope", scope)
        .withColumn("vector_present", F.coalesce(F.size(vector) > 0, F.lit(False))).withColumn("vector_dimensions", F.when(vector.isNull(), 0).otherwise(F.size(vector)))
        .drop("repeated", "_n_text")
    )


def summary(rows: DataFrame) -> DataFrame:
    """Counters of a cleanup in one pass."""
    states = ("clean", "repaired", "needs_review", "failed", "skipped_duplicate")
    return rows.agg(F.count("*").alias("points"), F.count_if("safe_for_reflection").alias("safe"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"), *(F.count_if(F.col("cleanup_status") == s).alias(s) for s in states), *(F.count_if(F.col("quality") == q).alias(q) for q in ("malformed", "truncated", "partial")))


def reviewed(rows: DataFrame, only_needs_review: bool = False) -> DataFrame:
    """All cleaned rows, or those that someone has to look at (Q14)."""
    return rows.where("cleanup_status = 'needs_review'") if only_needs_review else rows
