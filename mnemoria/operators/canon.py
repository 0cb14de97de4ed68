"""From points to curated facts: clusters, candidates, timelines, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import candidate_id
from ..functions.text import clamp_total, cluster_key, first_present, present
from .order import numbered

CLUSTER_SIZE = 25


def harvest(points: DataFrame, include_canonical: bool = False, canonical_only: bool = False) -> DataFrame:
    """Raw points, or also canonical ones, or only those."""
    canonical = F.coalesce("canonical", F.lit(False))
    return points.where(canonical) if canonical_only else points if include_canonical else points.where(~canonical)


def clusters(points: DataFrame) -> DataFrame:
    """Adds ``cluster_label``, ``part`` and ``cluster_id``; equal snippets of a label count once.

    Parts of 25 follow the time order. The first of equal snippets is a minimum with map-side
    combination; a label may hold most points, so they are numbered by ranges of time.
    """
    label = F.concat_ws(" | ", *(F.coalesce(present(F.col(c)), F.lit(default)) for c, default in (("project", "general"), ("memory_kind", "fact"), ("speaker", "unknown"))))
    snippet = F.lower(first_present(F.col("source_quote"), F.col("summary"), F.col("text"), F.col("memory_id")))
    keyed = points.withColumn("cluster_label", label).withColumn("snippet", F.sha2(snippet, 256))
    one = keyed.groupBy("cluster_label", "snippet").agg(F.min(F.struct("ts", "memory_id")).alias("f")).select("cluster_label", F.col("f.memory_id").alias("memory_id"), F.col("f.ts").alias("ts"))
    placed = numbered(one, ["cluster_label"], "ts", ["ts", "memory_id"], "place")
    parts = placed.select("cluster_label", "memory_id", F.floor((F.col("place") - 1) / CLUSTER_SIZE).cast("long").alias("part"))
    met = keyed.drop("snippet").join(parts, ["cluster_label", "memory_id"])
    return met.withColumn("cluster_id", F.concat(cluster_key(F.col("cluster_label")), F.lit("_"), F.lpad((F.col("part") + 1).cast("string"), 4, "0")))


def kind_of(label: Column) -> Column:
    """Fixed rules in order."""
    return F.when(label.contains("decision"), "project_decision").when(label.contains("preference"), "preference").when(label.contains("persona"), "persona_instruction").otherwise("inferred_pattern")


def candidates(clustered: DataFrame) -> DataFrame:
    """A proposed fact for each cluster (C5-C8, R20): at most 25 points are gathered in one."""
    line = clamp_total(first_present(F.col("summary"), F.col("source_quote"), F.col("text")), 160)
    tags = F.col("tags") if "tags" in clustered.columns else F.array().cast("array<string>")
    row = F.struct("ts", "memory_id", line.alias("line"), clamp_total(F.col("source_quote"), 180).alias("quote"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    grouped = clustered.groupBy("cluster_id", "cluster_label").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.bool_or(F.lower("speaker") == "user").alias("by_user"), F.count("*").alias("n"), F.min("project").alias("project"), F.min("speaker").alias("speaker"))
    lines = F.slice(F.filter(F.col("rows.line"), lambda x: x != ""), 1, 3)
    summary = F.array_join(lines, " ")
    return grouped.select(
        candidate_id(F.col("cluster_id"), summary).alias("candidate_id"), "cluster_id", "project", "speaker",
        kind_of(F.col("cluster_label")).alias("memory_kind"), summary.alias("summary"),
        F.when(F.col("by_user"), "direct").otherwise("inferred").alias("status"),
        F.when(F.col("n") >= 4, "high").when(F.col("n") >= 2, "medium").otherwise("low").alias("confidence"),
        F.array_distinct("rows.memory_id").alias("source_ids"),
        F.array_distinct(F.filter(F.col("rows.quote"), lambda x: x != "")).alias("quotes"),
        F.array_distinct(F.flatten("rows.tags")).alias("tags"),
        F.element_at("rows.ts", 1).alias("ts"),
    )


def timeline(points: DataFrame, group: str = "project") -> DataFrame:
    """The earliest and the latest point of each group, two rows."""
    row = F.struct("ts", "memory_id", clamp_total(first_present(F.col("source_quote"), F.col("summary"), F.col("text")), 160).alias("line"))
    ends = points.groupBy(group).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    both = ends.select(group, F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("first").alias("r")), F.struct(F.lit("last").alias("which"), F.col("last").alias("r")))).alias("e"))
    return both.select(group, "e.which", "e.r.memory_id", "e.r.ts", "e.r.line")


def timeline_candidates(points: DataFrame) -> DataFrame:
    """The earliest and the latest of all points as proposed facts, two rows."""
    quote = clamp_total(first_present(F.col("source_quote"), F.col("summary"), F.col("text")), 180)
    row = F.struct("ts", "memory_id", quote.alias("quote"), F.trim(F.coalesce("project", F.lit(""))).alias("project"), F.trim(F.coalesce("speaker", F.lit(""))).alias("speaker"))
    ends = points.agg(F.min(row).alias("first"), F.max(row).alias("last")).where("first is not null")
    date = lambda c: F.date_format(F.timestamp_seconds(c["ts"]), "yyyy-MM-dd")
    # The wording.
    both = F.array(
        F.struct(F.lit("timeline_first").alias("cluster_id"), F.concat(F.lit("First known memory mention appears around "), date(F.col("first")), F.lit(", based on message metadata.")).alias("summary"), F.lit("inferred").alias("status"), F.col("first").alias("r")),
        F.struct(F.lit("timeline_current").alias("cluster_id"), F.concat(F.lit("Current direction is reflected in later memory records near "), date(F.col("last")), F.lit(".")).alias("summary"), F.lit("needs_review").alias("status"), F.col("last").alias("r")),
    )
    made = ends.select(F.explode(both).alias("e"))
    written = F.date_format(F.timestamp_seconds("e.r.ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return made.select(
        candidate_id(F.col("e.cluster_id"), F.concat("e.r.memory_id", written)).alias("candidate_id"), "e.cluster_id", "e.r.project", "e.r.speaker", F.lit("canonical_timeline").alias("memory_kind"), "e.summary", "e.status",
        F.lit("medium").alias("confidence"), F.array("e.r.memory_id").alias("source_ids"), F.array("e.r.quote").alias("quotes"), F.array().cast("array<string>").alias("tags"), "e.r.ts",
    )


def contradictions(found: DataFrame) -> DataFrame:
    """Per project and kind the first stays; an equal later summary goes, a different one is marked.

    The first of each is a minimum with map-side combination; there are few projects and kinds, and all
    candidates are held against their row of it.
    """
    key = F.lower(F.trim(F.concat_ws("|", F.coalesce("project", F.lit("")), F.coalesce("memory_kind", F.lit("")))))
    keyed = found.withColumn("k", key)
    firsts = keyed.groupBy("k").agg(F.min_by(F.struct("candidate_id", "summary", "source_ids", "quotes"), F.struct("ts", "candidate_id")).alias("f"))
    met = keyed.join(firsts, "k")
    own = F.col("candidate_id") == F.col("f.candidate_id")
    kept = met.where(own | (F.lower("summary") != F.lower("f.summary"))).withColumn("later", ~own)
    mark = lambda c, value: F.when(F.col("later"), value).otherwise(F.col(c))
    marked = kept.withColumns({
        "memory_kind": mark("memory_kind", F.lit("contradiction_note")), "status": mark("status", F.lit("needs_review")), "confidence": mark("confidence", F.lit("medium")),
        "source_ids": mark("source_ids", F.array_distinct(F.concat("source_ids", "f.source_ids"))), "quotes": mark("quotes", F.array_distinct(F.concat("quotes", "f.quotes"))),
    })
    return marked.drop("k", "f", "later")


def canon_key() -> Column:
    return F.sha2(F.lower(F.concat_ws("|", "project", "memory_kind", "summary")), 256)


def curate(found: DataFrame, canon: DataFrame) -> DataFrame:
    """Drops what lacks sources, is canon already or comes twice; a fact is direct only from its user."""
    usable = found.where((F.size("source_ids") > 0) & (F.size("quotes") > 0)).withColumn("k", canon_key())
    fresh = usable.join(canon.select(canon_key().alias("k")).distinct(), "k", "left_anti")
    one = fresh.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("ts", "candidate_id"))).where("n = 1").drop("n", "k")
    return one.withColumn("status", F.when((F.col("status") == "direct") & (F.lower("speaker") != "user"), "inferred").otherwise(F.col("status")))


def proposed(points: DataFrame, canon: DataFrame, include_canonical: bool = False) -> tuple[DataFrame, DataFrame]:
    """A whole run: harvest, clusters, candidates and timeline, contradictions, curation; with one row of counters.

    Counters are ``candidates, skipped, contradictions``: what was proposed, what curation left out, what was marked.
    """
    taken = harvest(points, include_canonical)
    every = contradictions(candidates(clusters(taken)).unionByName(timeline_candidates(taken)))
    curated = curate(every, canon)
    counted = every.agg(F.count("*").alias("n"), F.count_if(F.col("memory_kind") == "contradiction_note").alias("contradictions"))
    counters = curated.agg(F.count("*").alias("candidates")).join(counted).select("candidates", (F.col("n") - F.col("candidates")).alias("skipped"), "contradictions")
    return curated, counters


def queue_list(queue: DataFrame, reviewed: bool | None = None, **equal: str) -> DataFrame:
    """Candidates that agree with the given fields, whatever the case, newest first."""
    found = queue
    for name, value in equal.items():
        if value:
            found = found.where(F.lower(name) == value.lower())
    if reviewed is not None:
        found = found.where(F.col("reviewed_at").isNotNull() == reviewed)
    return found.orderBy(F.desc("created_at"), "candidate_id")


def queue_upsert(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with ``new`` in place of rows of the same id; a time of creation that is not given stays."""
    known = queue.select("candidate_id", F.col("created_at").alias("was_created"))
    fresh = new.join(known, "candidate_id", "left").withColumn("created_at", F.coalesce("created_at", "was_created")).drop("was_created")
    return queue.join(new.select("candidate_id"), "candidate_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def review(queue: DataFrame, decisions: DataFrame, at: Column | None = None) -> DataFrame:
    """Applies ``(candidate_id, action, target_id, reviewed_by)``.

    Approve makes canon and keeps ``direct``, else ``approved``; reject; merge names the target, adds the own id to ``merged_from`` and
    leaves the candidate to be reviewed.
    """
    met = queue.join(decisions.select("candidate_id", "action", "target_id", F.col("reviewed_by").alias("new_by")), "candidate_id", "left")
    action = F.coalesce("action", F.lit(""))
    status = F.when((action == "approve") & (F.col("status") != "direct"), "approved").when(action == "reject", "rejected").when(action == "merge", "needs_review").otherwise(F.col("status"))
    merged = F.coalesce(F.col("merged_from"), F.array()) if "merged_from" in queue.columns else F.array()
    merged = merged.cast("array<string>")
    done = action.isin("approve", "reject", "merge")
    old = lambda name, kind: F.col(name) if name in queue.columns else F.lit(None).cast(kind)
    return met.withColumns({
        "canonical": (action == "approve") | F.coalesce(old("canonical", "boolean"), F.lit(False)), "status": status,
        "merged_from": F.when(action == "merge", F.array_distinct(F.concat(merged, F.array("candidate_id")))).otherwise(merged),
        "merge_target": F.when(action == "merge", F.trim("target_id")).otherwise(old("merge_target", "string")),
        "reviewed_by": F.when(done, F.trim("new_by")).otherwise(old("reviewed_by", "string")), "reviewed_at": F.when(done, F.current_timestamp() if at is None else at).otherwise(old("reviewed_at", "timestamp")),
    }).drop("action", "target_id", "new_by")


def canonical_points(reviewed: DataFrame) -> DataFrame:
    """Approved candidates as points of the store."""
    return reviewed.where("canonical").select(F.col("candidate_id").alias("memory_id"), F.lit("canonical_memory").alias("conversation_id"), F.lit("Canonical Memory").alias("source_title"), F.lit("canonical").alias("source_type"), "speaker", "project", "memory_kind", F.col("summary").alias("text"), "summary", F.coalesce(F.get("quotes", F.lit(0)), F.lit("")).alias("source_quote"), "status", "canonical", "source_ids", "ts")
