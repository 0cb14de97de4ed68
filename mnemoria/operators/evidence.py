"""Evidence against hypotheses and its sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import RELATIONS, concepts, contains_any, hedged, negated
from .recall import bounded

# Relevance, and what a piece of evidence moves.
RELEVANCE, CONFIDENCE_SCALE, STRENGTH_SCALE, MATERIAL, DEFAULT_CONFIDENCE = 0.5, 0.06, 0.08, 0.01, 0.42
# Tiers of sources with weight and rank.
TIERS = {
    "RAW_SOURCE": (1.0, 8),
    "RAW_TRANSCRIPT": (0.9, 7),
    "VERSIONED_DRAFT": (0.88, 6),
    "DIRECT_NOTE": (0.8, 5),
    "DERIVED_SUMMARY": (0.45, 4),
    "AUDIO_OVERVIEW": (0.42, 3),
    "PRESENTATION_SUMMARY": (0.4, 2),
    "AI_SYNTHESIS": (0.2, 1),
    "UNKNOWN": (0.25, 0),
}


def tier(source_type: Column, title: Column) -> Column:
    """The tier of a source; the order of the rules matters."""
    kind, name = F.lower(F.trim(F.coalesce(source_type, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (
        F.when(kind.contains("document") | name.rlike(r"\.(md|pdf|docx)$"), "RAW_SOURCE")
        .when(kind.contains("transcript"), "RAW_TRANSCRIPT")
        .when(kind.contains("draft"), "VERSIONED_DRAFT")
        .when(kind.rlike("note|chat_export|jsonl"), "DIRECT_NOTE")
        .when(kind.contains("audio_overview"), "AUDIO_OVERVIEW")
        .when(kind.rlike("presentation|diagram"), "PRESENTATION_SUMMARY")
        .when(kind.rlike("summary"), "DERIVED_SUMMARY")
        .otherwise("UNKNOWN")
    )


def tier_number(of: Column, which: int) -> Column:
    found = F.lit(TIERS["UNKNOWN"][which])
    for name, numbers in TIERS.items():
        found = F.when(of == name, F.lit(numbers[which])).otherwise(found)
    return found


def provenance_profile(points: DataFrame, *group: str) -> DataFrame:
    """Tiers of each group: mean weight, best tier, and ``tier=count``."""
    tiered = points.withColumn("tier", tier(F.col("source_type"), F.col("source_title")))
    counts = tiered.groupBy(*group, "tier").agg(F.count("*").alias("n"))
    weighted = counts.withColumn("w", tier_number(F.col("tier"), 0)).withColumn("r", tier_number(F.col("tier"), 1))
    return weighted.groupBy(*group).agg(F.round(F.sum(F.col("w") * F.col("n")) / F.sum("n"), 6).alias("score"), F.max_by("tier", "r").alias("best"), F.array_join(F.array_sort(F.collect_list(F.concat("tier", F.lit("="), F.col("n").cast("string")))), ",").alias("profile"))


def classified(evidence: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``evidence_id, hypothesis_id, relevance, polarity`` of every pair.

    The hypotheses are a stated set of at most 10,000, sent to each task; the concepts of either side are
    worked out once a row, before the pairs.
    """
    left = evidence.select("evidence_id", concepts(F.col("text")).alias("e_concepts"), negated(F.col("text")).alias("negated"), hedged(F.col("text")).alias("hedged"), (F.trim("text") == "").alias("blank"))
    right = hypotheses.select("hypothesis_id", concepts(F.col("statement")).alias("h_concepts"))
    pairs = left.join(F.broadcast(bounded(right)))
    matched = F.array_intersect("h_concepts", "e_concepts")
    relevance = F.when(F.size("h_concepts") == 0, F.lit(0.0)).otherwise(F.size(matched) / F.size("h_concepts"))
    relation = F.arrays_overlap(matched, F.array(*map(F.lit, RELATIONS)))
    relevant = ~F.col("blank") & (F.size("h_concepts") > 0) & (relation | (relevance >= RELEVANCE))
    polarity = F.when(~relevant, "none").when(F.col("negated"), "counter").when(F.col("hedged"), "ambiguous").otherwise("support")
    return pairs.select("evidence_id", "hypothesis_id", F.round(relevance, 6).alias("relevance"), polarity.alias("polarity"))


def seeded(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses ``(session_id, hypothesis_id, statement, confidence, strength, rank, status, pos)`` ready for evidence.

    Blank ids, statements and ranks follow the place in the list; a confidence that is not set is
    the default, here and never later; ranks are numbered anew by rank and id. A session has few hypotheses.
    """
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    named = hypotheses.withColumn("hypothesis_id", F.coalesce(text("hypothesis_id"), F.concat(F.lit("H"), F.col("pos").cast("string")))).withColumn("given", F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.col("pos")))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("given", "hypothesis_id")).cast("long")
    return named.select("session_id", "hypothesis_id", F.coalesce(text("statement"), "hypothesis_id").alias("statement"), F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, DEFAULT_CONFIDENCE).otherwise(unit(F.col("confidence"))).alias("confidence"), unit(F.coalesce("strength", F.lit(0.0))).alias("strength"), place.alias("rank"), F.coalesce(text("status"), F.lit("active")).alias("status"))


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


KINDS = ("support", "counter", "ambiguous")


def scoring_reason(support: Column, counter: Column, ambiguous: Column, support_weight: Column, counter_weight: Column) -> Column:
    """What the counts of new evidence say, in words."""
    # The wording.
    return (
        F.when((support == 0) & (counter == 0) & (ambiguous == 0), "no new discriminating evidence")
        .when((support == 0) & (counter == 0), "ambiguous evidence, polarity unresolved")
        .when((support > 0) & (counter == 0), F.format_string("new supporting evidence (weight %.2f)", support_weight))
        .when((support == 0) & (counter > 0), F.format_string("new counterevidence (weight %.2f)", counter_weight))
        .otherwise(F.format_string("mixed evidence: support %.2f vs counter %.2f", support_weight, counter_weight))
    )


def updated(hypotheses: DataFrame, weighed: DataFrame) -> DataFrame:
    """Confidence, strength, status, ids, reason and rank after ``weighed(hypothesis_id, evidence_id, polarity, weight)``.

    ``hypotheses`` has ``session_id, hypothesis_id, confidence, strength, rank, status`` and the ids seen so far, ``support_ids,
    counter_ids, ambiguous_ids``. Evidence that a hypothesis has seen under the same polarity, and evidence
    without an id, does not count again. Ranks are within a session, whose hypotheses are few.
    """
    seen = hypotheses.select("hypothesis_id", *(F.coalesce(f"{k}_ids", F.array().cast("array<string>")).alias(f"{k}_ids") for k in KINDS))
    known = reduce(Column.__or__, ((F.col("polarity") == k) & F.array_contains(f"{k}_ids", F.col("evidence_id").cast("string")) for k in KINDS))
    fresh = weighed.where(F.col("polarity").isin(*KINDS) & (F.trim(F.coalesce(F.col("evidence_id").cast("string"), F.lit(""))) != "")).join(seen, "hypothesis_id").where(~known)
    of = lambda k, value: F.when(F.col("polarity") == k, value)
    sums = fresh.groupBy("hypothesis_id").agg(
        *(F.sum(of(k, F.col("weight"))).alias(f"{k}_weight") for k in KINDS), *(F.count(of(k, F.lit(1))).alias(f"n_{k}") for k in KINDS),
        *(F.array_sort(F.collect_set(of(k, F.trim(F.col("evidence_id").cast("string"))))).alias(f"new_{k}") for k in KINDS),
    )
    none = F.array().cast("array<string>")
    met = hypotheses.join(sums, "hypothesis_id", "left").na.fill(0.0, [f"{k}_weight" for k in KINDS]).na.fill(0, [f"n_{k}" for k in KINDS])
    net = F.col("support_weight") - F.col("counter_weight")
    new = met.withColumn("new_confidence", F.round(unit(F.col("confidence") + CONFIDENCE_SCALE * net), 6)).withColumn("new_strength", F.round(unit(F.col("strength") + STRENGTH_SCALE * net), 6))
    state = F.when(F.trim(F.coalesce("status", F.lit(""))) == "", "active").otherwise(F.col("status"))
    had_counter = F.size(F.coalesce("counter_ids", none)) > 0
    new = new.withColumn("status", F.when(F.col("n_counter") > 0, "contested").when((state == "contested") & ~had_counter, "active").otherwise(state))
    for k in KINDS:
        new = new.withColumn(f"{k}_ids", F.array_distinct(F.concat(F.coalesce(f"{k}_ids", none), F.coalesce(f"new_{k}", none))))
    new = new.withColumn("reason", scoring_reason(F.col("n_support"), F.col("n_counter"), F.col("n_ambiguous"), F.col("support_weight"), F.col("counter_weight")))
    score = F.round(F.col("new_confidence") + 0.1 * F.col("new_strength"), 6)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(score.desc(), "hypothesis_id")).cast("long")
    return new.withColumn("new_rank", place).withColumn("rank_delta", F.col("new_rank") - F.col("rank")).withColumn("confidence_delta", F.round(F.col("new_confidence") - F.col("confidence"), 6)).drop(*(f"new_{k}" for k in KINDS))


# What is unresolved, tiers of weak provenance, and words that ask for an order in time.
WEAK_TIERS = ("DERIVED_SUMMARY", "AUDIO_OVERVIEW", "PRESENTATION_SUMMARY", "AI_SYNTHESIS")
CHRONOLOGY = ("earliest", "first", "chronolog", "timestamp", "sequence", "draft", "lineage", "before", "after")


def reclassified(current: Column, n_evidence: Column, provenance: Column, top_tier: Column, contradiction: Column, question: Column) -> Column:
    """``struct<uncertainty, reason>``: the first signal that applies and is not what is assumed already; nulls for none."""
    weak = ((provenance > 0) & (provenance < 0.6)) | top_tier.isin(*WEAK_TIERS)
    asks = contains_any(F.lower(F.trim(question)), CHRONOLOGY)
    now = F.coalesce(F.nullif(F.trim(current), F.lit("")), F.lit("EVIDENCE_GAP"))
    signals = (
        ("CONTRADICTION", "retrieved evidence contains contradiction signals", contradiction),
        ("RETRIEVAL_LIMIT", "strategy returned no retrieval coverage for the unresolved claim", n_evidence == 0),
        ("PROVENANCE_GAP", "retrieved evidence depends on derived or weak provenance", weak),
        ("CHRONOLOGY_GAP", "chronology remains ambiguous despite available provenance", asks & ~weak),
        ("SOURCE_QUALITY", "retrieved source quality is unverifiable", top_tier == "UNKNOWN"),
        ("GENERIC_SIMILARITY", "retrieved evidence resembles generic surface similarity rather than discriminating detail", ~contradiction & (n_evidence > 0) & ~weak),
    )
    found = F.struct(F.lit(None).cast("string").alias("uncertainty"), F.lit(None).cast("string").alias("reason"))
    for name, reason, applies in reversed(signals):
        found = F.when(applies & (now != name), F.struct(F.lit(name).alias("uncertainty"), F.lit(reason).alias("reason"))).otherwise(found)
    return found


def highest_uncertainty(frozen: Column, reclassified_to: Column, low_gains: Column, blockers: Column, question: Column, searches: Column) -> Column:
    """What a session should resolve next, by ordered rules over its state."""
    q = F.lower(F.trim(question))
    set_again = F.trim(F.coalesce(reclassified_to, F.lit("")))
    return (
        F.when(frozen, "DIMINISHING_RETURNS").when((set_again != "") & (set_again != "DIMINISHING_RETURNS"), set_again).when(low_gains >= 1, "DIMINISHING_RETURNS")
        .when(F.size(blockers) > 0, F.get(blockers, F.lit(0))).when(contains_any(q, ("earliest", "first explicit", "draft", "lineage", "chronolog")), "CHRONOLOGY_GAP")
        .when(contains_any(q, ("provenance", "transcript", "citation")), "PROVENANCE_GAP").when(searches == 0, "EVIDENCE_GAP").otherwise("AMBIGUOUS_CLASSIFICATION")
    )


def most_discriminating(questions: DataFrame) -> DataFrame:
    """The best of ``(session_id, pos, question, wanted, current)``, by an additive score; the first of equal ones."""
    q, text = F.trim("question"), F.lower(F.trim("question"))
    score = F.lit(1) + 5 * ((F.trim(F.coalesce("wanted", F.lit(""))) != "") & (q == F.trim(F.coalesce("wanted", F.lit(""))))).cast("int") + 2 * contains_any(text, ("first", "earliest", "upstream")).cast("int") + 2 * contains_any(text, ("falsif", "counter")).cast("int") + (q != F.coalesce("current", F.lit(""))).cast("int")
    best = questions.where(q != "").withColumn("score", score).groupBy("session_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", q.alias("question"))).alias("b"))
    return best.select("session_id", F.col("b.question").alias("question"), (-F.col("b.s")).alias("score"))


# The columns that say where a point comes from, and the names they go by, the first that a table has.
ALIASES = {
    "memory_id": ("memory_id", "id"),
    "source_document_id": ("source_document_id", "document_id", "doc_id", "source_id"),
    "source_title": ("source_title", "title", "document_title"),
    "filename": ("filename", "file_name", "attachment_filename"),
    "path": ("path", "file_path", "source_path"),
    "folder": ("folder", "directory", "source_folder"),
    "chunk_id": ("chunk_id", "chunk_uid"),
    "chunk_index": ("chunk_index", "chunk_idx", "position", "segment_index"),
    "page": ("page", "page_number"),
    "section": ("section", "heading", "header"),
    "source_type": ("source_type", "document_type"),
    "created_date": ("created_date", "created_at"),
    "modified_date": ("modified_date", "modified_at", "updated_at"),
    "text": ("text", "content", "chunk_text"),
    "summary": ("summary", "abstract"),
    "source_quote": ("source_quote", "quote"),
}


def provenance_view(points: DataFrame) -> DataFrame:
    """Any table of points under one set of names, with ``fingerprint``: the first of document, path, file and title.

    Columns that a table lacks are empty; a chunk without an id has the point's. Other columns stay, but for the names given.
    """
    taken = {name: next((alias for alias in aliases if alias in points.columns), None) for name, aliases in ALIASES.items()}
    text = lambda alias: F.trim(F.coalesce(F.col(alias).cast("string"), F.lit(""))) if alias else F.lit("")
    shown = {name: text(alias) for name, alias in taken.items()}
    shown["chunk_index"] = F.coalesce(F.col(taken["chunk_index"]).try_cast("int"), F.lit(0)) if taken["chunk_index"] else F.lit(0)
    shown |= {name: times.written(times.flexible(shown[name])) for name in ("created_date", "modified_date")}
    shown["chunk_id"] = F.coalesce(F.nullif(shown["chunk_id"], F.lit("")), shown["memory_id"])
    fingerprint = F.coalesce(*(F.nullif(shown[name], F.lit("")) for name in ("source_document_id", "path", "filename", "source_title")), F.lit(""))
    return points.select(*(column.alias(name) for name, column in shown.items()), fingerprint.alias("fingerprint"), *(c for c in points.columns if c not in ALIASES and c not in taken.values() and c != "fingerprint"))


def envelope(fields: dict[str, Column]) -> Column:
    """``struct<fields, body>``: the names of what is not blank, and its text joined by spaces (E5)."""
    given = F.filter(F.array(*(F.struct(F.lit(name).alias("name"), F.trim(F.coalesce(c, F.lit(""))).alias("value")) for name, c in fields.items())), lambda f: f["value"] != "")
    return F.struct(F.transform(given, lambda f: f["name"]).alias("fields"), F.array_join(F.transform(given, lambda f: f["value"]), " ").alias("body"))


def document_chunks(chunks: DataFrame, document: str, ids: tuple[str, ...], order: tuple[str, ...], limit: int = 20) -> DataFrame:
    """Chunks that any of the id columns ascribes to a document, in order."""
    if not document.strip():
        raise ValueError("a document id is required")
    named = reduce(Column.__or__, (F.col(c) == document.strip() for c in ids))
    return chunks.where(named).orderBy(*order).limit(max(1, min(limit if limit > 0 else 20, 200)))


def source_ledger(ledger: DataFrame, entry: DataFrame) -> DataFrame:
    """Searches of each session, the new one last, and the ordered union of their sources."""
    both = ledger.unionByName(entry)
    merged = both.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "query", "sources"))).alias("e"))
    return merged.select("session_id", F.size("e").cast("long").alias("searches"), F.array_distinct(F.filter(F.flatten("e.sources"), lambda s: F.trim(s) != "")).alias("sources"))


def best_anchors(anchored: DataFrame) -> DataFrame:
    """The node of each ``anchor`` that says most about its place in time and descent; the first of equal ones by ``memory_id``."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    score = 2 * (F.coalesce("chunk_index", F.lit(0)) > 0).cast("int") + 2 * (F.coalesce("turn_index", F.lit(0)) > 0).cast("int") + 3 * F.col("original_ts").isNotNull().cast("int") + 2 * filled("parent_id").cast("int") + (F.size("cites") > 0).cast("int") + (F.size("derived_from") > 0).cast("int")
    best = anchored.withColumn("score", score).groupBy("anchor").agg(F.min(F.struct((-F.col("score")).alias("s"), "memory_id")).alias("b"))
    return best.select("anchor", "b.memory_id", (-F.col("b.s")).cast("long").alias("score"))


def anchor_matches(nodes_of: DataFrame, anchors: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Nodes that any of their ids, whatever its case, makes the ``anchor`` asked for."""
    keys = F.array_distinct(F.array_compact(F.array(*(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in ids))))
    asked = anchors.select("anchor", F.lower(F.trim("anchor")).alias("key")).where("key <> ''")
    return nodes_of.select("*", F.explode(keys).alias("key")).join(asked, "key").drop("key")


def weaknesses(original: Column, ingested: Column, source_type: Column, family: Column) -> Column:
    """What a trace lacks, as texts."""
    # The wording.
    return F.array_compact(F.array(
        F.when(~original & ingested, F.lit("only ingestion timestamps were available; intellectual chronology not inferred from ingestion order")).when(~original, F.lit("no original chronology metadata (chunk/turn/segment/original timestamp) found")),
        F.when(F.trim(F.coalesce(source_type, F.lit(""))) == "", F.lit("source_type missing on anchor")), F.when(F.coalesce(family, F.lit("")) == "", F.lit("source family key missing on anchor")),
    ))


def information_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """``LOW, MEDIUM, HIGH`` from what changed."""
    met = before.select("hypothesis_id", F.col("confidence").alias("b"), F.col("rank").alias("br")).join(after.select("hypothesis_id", F.col("new_confidence").alias("a"), F.col("new_rank").alias("ar")), "hypothesis_id", "full")
    moved = met.agg(F.coalesce(F.bool_or(F.abs(F.col("a") - F.col("b")) >= MATERIAL), F.lit(False)).alias("material"), F.coalesce(F.bool_or(F.col("ar") != F.col("br")), F.lit(False)).alias("reordered"))
    return moved.select(F.when(F.col("reordered"), "HIGH").when(F.col("material"), "MEDIUM").otherwise("LOW").alias("gain"))


def exhausted(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The strategy that each uncertainty takes next, by successes against uses; to freeze where all are gone.

    Only a score that is not below 0 is better than being the first that is left; the first of equal ones stays.
    """
    used = outcomes.groupBy("uncertainty", "strategy").agg(F.count("*").alias("usage"), F.count_if("success").alias("successes"), F.bool_or("exhausted").alias("gone"))
    met = candidates.join(used, ["uncertainty", "strategy"], "left")
    score = 3 * F.coalesce("successes", F.lit(0)) - F.coalesce("usage", F.lit(0))
    best = F.min(F.when(~F.coalesce("gone", F.lit(False)), F.struct((-F.greatest(score, F.lit(-1))).alias("place"), "pos", "strategy", score.alias("score")))).alias("b")
    return met.groupBy("uncertainty").agg(best).select("uncertainty", F.coalesce("b.strategy", F.lit("FREEZE_BRANCH")).alias("strategy"), "b.score")


def cycles(history: Column) -> Column:
    """Whether the last steps repeat the ones before, by blocks of two or more."""
    n = F.size(history)
    lengths = F.when(n >= 4, F.sequence(F.lit(2), F.floor(n / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.exists(lengths, lambda k: F.slice(history, n - k + 1, k) == F.slice(history, n - 2 * k + 1, k))


def neighbours(chunks: DataFrame, anchors: DataFrame, window: int, document: str = "conversation_id", order: str = "ts") -> DataFrame:
    """Chunks up to ``window`` places around each anchor in its document.

    Places are numbered once and met by equality on shifted places, not by a range over the document.
    """
    place = F.row_number().over(Window.partitionBy(document).orderBy(order, "memory_id"))
    numbered = chunks.select("memory_id", document, place.alias("place"))
    asked = numbered.join(anchors.select("memory_id"), "memory_id", "left_semi").select(F.col("memory_id").alias("anchor_id"), document, F.explode(F.sequence(F.col("place") - window, F.col("place") + window)).alias("place"))
    return numbered.join(asked, [document, "place"]).select("anchor_id", "memory_id", "place")


def recorded(thoughts: DataFrame, history: DataFrame) -> DataFrame:
    """New thoughts; one with a fingerprint known in its session is a rediscovery of low gain."""
    known = history.select("session_id", "fingerprint", F.lit(True).alias("known")).distinct()
    met = thoughts.join(known, ["session_id", "fingerprint"], "left")
    return met.withColumn("status", F.when(F.col("known"), "rediscovery").otherwise("new")).withColumn("gain", F.when(F.col("known"), "LOW").otherwise(F.col("gain"))).drop("known")


def thought_summary(thoughts: DataFrame, n: int = 8) -> DataFrame:
    """The newest thoughts of each kind, with the count of the kind."""
    newest = F.row_number().over(Window.partitionBy("session_id", "thought_type").orderBy(F.desc("ts"), F.desc("thought_id")))
    counts = thoughts.groupBy("session_id", "thought_type").agg(F.count("*").alias("n"))
    return thoughts.withColumn("place", newest).where(F.col("place") <= n).join(counts, ["session_id", "thought_type"])
