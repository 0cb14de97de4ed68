"""Where sources come from: links of explicit metadata, families and order, and how far a trace can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import family_key
from .evidence import anchor_matches, best_anchors, tier, tier_number, weaknesses
from .tables import written

# Relations, what they are based on, and their confidence.
DERIVED_FROM, CITES, SAME_FAMILY, SUMMARIZES, TRANSCRIBES, PRESENTS, EARLIER, LATER, UNKNOWN = "DERIVED_FROM", "CITES", "SAME_SOURCE_FAMILY", "SUMMARIZES", "TRANSCRIBES", "PRESENTS", "EARLIER_IN_SOURCE", "LATER_IN_SOURCE", "UNKNOWN_RELATION"
OF_NODE, OF_ANCHOR, CITED, FAMILY, FAMILY_COUNT, FAMILY_TIME, UNLINKED, UNMATCHED = "explicit metadata keys: derived_from/parent_source", "explicit metadata keys on anchor", "explicit citation identifiers", "inferred shared source family", "duplicate source family detection", "same-family original timestamp signal", "missing citation/parent/family linkage", "no source id/path/title match"
SIGNALS = (("chunk_index ordering within source", 0.82), ("turn index ordering in memory id", 0.77), ("segment offset ordering", 0.79), ("original timestamp ordering", 0.74))
NOT_FOUND = "anchor source metadata not found in scanned collection"
NODE = {
    "source_id": "string", "document_id": "string", "memory_id": "string", "chunk_id": "string", "filename": "string", "source_title": "string", "source_type": "string", "path": "string", "chunk_index": "int", "segment_start": "double", "segment_end": "double",
    "original_ts": "long", "ingested_ts": "long", "parent_id": "string", "derived_from": "array<string>", "cites": "array<string>",
}
# Keys of anchors that are sent to all tasks at most.
KEYS_SENT = 200_000
IDENTITY = ("source_id", "document_id", "filename", "source_title", "memory_id", "chunk_id")


def turn_index(memory_id: Column) -> Column:
    """The number after the first ``turn_`` of an id; 0 without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(memory_id, F.lit("")), r"(?s)^.*?turn_([0-9]*)", 1).try_cast("int"), F.lit(0))


def first_present(*names: str) -> Column:
    return T.first_present(*map(F.col, names))


def lowered(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def nodes(points: DataFrame) -> DataFrame:
    """What a trace is made from (N1). Columns that a table lacks are empty; the family is that of the title, file, path or source."""
    text = lambda kind, c: F.trim(F.coalesce(c, F.lit(""))) if kind == "string" else c
    found = points.select(*(text(kind, F.col(name).cast(kind) if name in points.columns else F.lit(None).cast(kind)).alias(name) for name, kind in NODE.items()), *(["turn_index"] if "turn_index" in points.columns else [turn_index(F.col("memory_id")).alias("turn_index")]))
    found = found.withColumn("node_id", first_present("source_id", "document_id", "memory_id", "chunk_id")).where("node_id <> ''")
    named = found.withColumn("family", family_key(first_present("source_title", "filename", "path", "source_id")))
    return named.withColumn("ids", lowered(F.array(*IDENTITY))).withColumn("tier", tier(F.col("source_type"), first_present("source_title", "filename")))


def within(of: str, peer: str) -> Column:
    """``struct<signal, later, distance>``: the order of a node and its anchor in one source, by the first signal that both have; null without one."""
    a, n = (lambda c: F.coalesce(F.col(f"{of}.{c}"), F.lit(0))), (lambda c: F.coalesce(F.col(f"{peer}.{c}"), F.lit(0)))
    told = lambda k, x, y: F.struct(F.lit(k).alias("signal"), (y > x).alias("later"), F.abs(y - x).cast("double").alias("distance"))
    return (
        F.when((a("chunk_index") > 0) & (n("chunk_index") > 0), told(0, a("chunk_index"), n("chunk_index")))
        .when((a("turn_index") > 0) & (n("turn_index") > 0), told(1, a("turn_index"), n("turn_index")))
        .when((a("segment_end") > 0) & (n("segment_start") > 0), told(2, a("segment_end"), n("segment_start")))
        .when(F.col(f"{of}.original_ts").isNotNull() & F.col(f"{peer}.original_ts").isNotNull(), told(3, a("original_ts"), n("original_ts")))
    )


def family_relation(source_type: Column) -> Column:
    """What a member of the family is to the anchor, by its own type."""
    low = F.lower(F.trim(source_type))
    return F.when(low.rlike("summary|overview"), SUMMARIZES).when(low.rlike("transcript|audio"), TRANSCRIBES).when(low.rlike("presentation|slide|diagram"), PRESENTS).otherwise(SAME_FAMILY)


def trace(every: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and summaries of the traces of ``anchors(anchor)``, names of sources of any kind.

    Edges are ``anchor, from_id, to_id, relation, basis, side, confidence, n, nearest``: ``n`` counts the keys of nodes that give the edge, and
    ``nearest`` is the node that is nearest in the order of a source. Summaries are ``anchor, memory_id, source_type, tier, n_edges, lacks, confidence``.

    What can link a node and an anchor is written as a key on either side. Links that a node names by a key depend on its id alone, so nodes are
    counted by key and id before they meet an anchor, and those that the anchor itself names are taken off; order and families need pairs of nodes and
    anchors, for which the keys of the anchors are the small side.
    """
    asked = anchors.select(F.trim("anchor").alias("anchor")).distinct()
    # The best node of each name, with what the trace needs of it; as many rows as names at most.
    every = written(every, "lineage-nodes")
    best = best_anchors(anchor_matches(every, asked, IDENTITY)).select("anchor", "memory_id")
    a = every.join(best, "memory_id").groupBy("anchor").agg(F.min(F.struct("memory_id", *(c for c in every.columns if c != "memory_id"))).alias("a"))
    a = written(a, "lineage-anchors")
    key = lambda link, value: F.struct(F.lit(link).alias("link"), value.alias("value"))
    keys = lambda link, values: F.transform(lowered(values), lambda v: key(link, v))
    blank = F.array().cast("array<string>")
    known = F.concat(F.array("a.source_id", "a.document_id", "a.memory_id", "a.chunk_id"), F.coalesce("a.derived_from", blank), F.coalesce("a.cites", blank))
    of_anchor = F.concat(keys("ref", known), keys("cite", known), keys("from", F.col("a.derived_from")), keys("parent", F.array("a.parent_id")), keys("to", F.col("a.cites")), keys("family", F.array("a.family")), F.array(key("same", F.lower("anchor"))))
    left = written(a.select("anchor", F.explode(of_anchor).alias("k")).select("anchor", "k.link", "k.value"), "lineage-keys")
    ids, paired = F.array("node_id", "document_id"), F.col("link").isin("same", "family")
    of_link = F.concat(keys("ref", F.concat(F.coalesce("derived_from", blank), F.array("parent_id"))), keys("cite", F.col("cites")), keys("from", ids), keys("parent", F.array("node_id")), keys("to", ids))
    of_pair = F.concat(keys("family", F.array("family")), F.transform("ids", lambda v: key("same", v)))
    few = lambda rows: F.broadcast(rows) if rows.count() <= KEYS_SENT else rows
    node_of = F.struct("node_id", "source_id", "document_id", "memory_id", "chunk_id", "source_type", "chunk_index", "turn_index", "segment_start", "segment_end", "original_ts", "ingested_ts", "ids")
    right = every.select(node_of.alias("n"), of_link.alias("links"), F.explode(of_pair).alias("k")).select("n", "links", "k.link", "k.value")
    pairs = right.join(few(left.where(paired)), ["link", "value"]).withColumn("same", F.array_contains("n.ids", F.lower("anchor")))
    met = pairs.drop("links").join(a, "anchor")

    counts = every.select("node_id", F.explode(of_link).alias("k")).groupBy("k.link", "k.value", "node_id").agg(F.count("*").alias("n"))
    named = left.where(~paired)
    linked = counts.join(named, ["link", "value"]).groupBy("anchor", "link", "node_id").agg(F.sum("n").alias("n"))
    itself = pairs.where("link = 'same'").select("anchor", F.col("n.node_id").alias("node_id"), F.explode("links").alias("k")).select("anchor", "node_id", "k.link", "k.value")
    less = itself.join(named, ["anchor", "link", "value"]).groupBy("anchor", "link", "node_id").agg(F.count("*").alias("less"))
    linked = linked.join(less, ["anchor", "link", "node_id"], "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).where("n > 0").join(a.select("anchor", F.col("a.source_id").alias("source_id")), "anchor")
    away, here = F.col("node_id"), F.col("source_id")
    is_a = lambda start, end, relation, basis, side, confidence: F.struct(start.alias("from_id"), end.alias("to_id"), F.lit(relation).alias("relation"), F.lit(basis).alias("basis"), F.lit(side).alias("side"), F.lit(confidence).alias("confidence"))
    link = (
        F.when(F.col("link") == "ref", is_a(away, here, DERIVED_FROM, OF_NODE, "upstream", 0.92)).when(F.col("link").isin("from", "parent"), is_a(here, away, DERIVED_FROM, OF_ANCHOR, "downstream", 0.9))
        .when(F.col("link") == "cite", is_a(away, here, CITES, CITED, "upstream", 0.88)).when(F.col("link") == "to", is_a(here, away, CITES, CITED, "downstream", 0.88))
    )
    linked = linked.select("anchor", link.alias("e"), "n").select("anchor", "e.*", "n", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("memory_id"))

    source, node = F.col("a.source_id"), F.col("n.node_id")
    edge = lambda start, end, relation, confidence, basis, side, distance=None: F.struct(start.alias("from_id"), end.alias("to_id"), relation.alias("relation"), F.lit(confidence).cast("double").alias("confidence") if isinstance(confidence, float) else confidence.cast("double").alias("confidence"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"), F.lit(side).alias("side"), (F.lit(None) if distance is None else distance).cast("double").alias("distance"))
    apart = lambda *links: F.col("link").isin(*links) & ~F.col("same")
    order, relation = within("a", "n"), family_relation(F.col("n.source_type"))
    other = (first_present("a.memory_id", "a.chunk_id") != first_present("n.memory_id", "n.chunk_id")) & (F.col("link") == "same")
    of_signal = lambda which: F.element_at(F.array(*(F.lit(s[which]) for s in SIGNALS)), F.col("o.signal") + 1)
    both_timed = F.col("a.original_ts").isNotNull() & F.col("n.original_ts").isNotNull()
    edges = F.array_compact(F.array(
        F.when(apart("family"), edge(source, node, relation, F.when(relation == SAME_FAMILY, 0.58).otherwise(0.66), FAMILY, "related")),
        F.when(apart("family") & both_timed, edge(source, first_present("n.source_id", "n.document_id"), F.when(F.col("n.original_ts") > F.col("a.original_ts"), LATER).otherwise(EARLIER), 0.69, FAMILY_TIME, "related")),
        F.when(other & F.col("o").isNotNull(), edge(source, F.col("n.source_id"), F.when(F.col("o.later"), LATER).otherwise(EARLIER), of_signal(1), of_signal(0), "related", F.col("o.distance"))),
    ))
    each = met.withColumn("o", order).select("anchor", F.col("n.memory_id").alias("memory_id"), F.explode(edges).alias("e")).select("anchor", "memory_id", "e.*").withColumn("n", F.lit(1).cast("long"))
    merged = each.unionByName(linked).groupBy("anchor", "from_id", "to_id", "relation", "basis").agg(F.min("side").alias("side"), F.min("confidence").alias("confidence"), F.sum("n").alias("n"), F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "memory_id")))["memory_id"].alias("nearest"))
    merged = written(merged, "lineage-edges")

    timed, ingested = F.col("n.original_ts").isNotNull(), F.col("n.original_ts").isNull() & F.col("n.ingested_ts").isNotNull()
    counted = lambda of, what: F.count_if((F.col("link") == of) & what)
    own = met.groupBy("anchor").agg(counted("same", timed).alias("own_timed"), counted("same", ingested).alias("own_ingested"), counted("family", F.lit(True)).alias("members"))
    whole = every.agg(F.count_if(F.col("original_ts").isNotNull()).alias("timed"), F.count_if(F.col("original_ts").isNull() & F.col("ingested_ts").isNotNull()).alias("ingested"))
    found = merged.groupBy("anchor").agg(F.count("*").alias("n_edges"), F.sum("confidence").alias("total"), F.bool_or(F.col("basis").isin(FAMILY_TIME, *(s[0] for s in SIGNALS))).alias("ordered"))
    told = asked.where("anchor <> ''").join(a, "anchor", "left").join(own, "anchor", "left").join(found, "anchor", "left").join(F.broadcast(whole))  # one row
    told = told.withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).withColumn("members", F.coalesce("members", F.lit(0)))
    original = F.coalesce("ordered", F.lit(False)) | (F.col("a.original_ts").isNotNull() & (F.col("timed") > F.col("own_timed")))
    lacks = F.when(F.col("a").isNull(), F.array(F.lit(NOT_FOUND))).otherwise(weaknesses(original, F.col("ingested") > F.col("own_ingested"), F.col("a.source_type"), F.col("a.family")))
    weight, unit = tier_number(F.col("a.tier"), 0), lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    base = unit(F.when(F.col("n_edges") > 0, 0.55 * weight + 0.45 * F.col("total") / F.col("n_edges")).otherwise(0.65 * weight))
    told = written(told.withColumn("lacks", lacks).withColumn("confidence", F.round(F.when(F.col("a").isNull(), 0.2).otherwise(unit(base - 0.05 * F.size("lacks"))), 6)), "lineage-summaries")
    alone = told.where("n_edges = 0").select("anchor", F.coalesce(source, F.col("anchor")).alias("from_id"), F.lit("").alias("to_id"), F.lit(UNKNOWN).alias("relation"), F.when(F.col("a").isNull(), UNMATCHED).otherwise(UNLINKED).alias("basis"), F.when(F.col("a").isNull(), 0.2).otherwise(0.24).alias("confidence"), F.lit(1).cast("long").alias("n"))
    families = told.where("a.family <> '' and members > 1").select("anchor", source.alias("from_id"), F.col("a.family").alias("to_id"), F.lit(SAME_FAMILY).alias("relation"), F.lit(FAMILY_COUNT).alias("basis"), F.lit(0.63).alias("confidence"), F.col("members").alias("n"))
    more = alone.unionByName(families).select("*", F.lit("related").alias("side"), F.lit(None).cast("string").alias("nearest"))
    summary = told.select("anchor", "a.memory_id", F.when(F.col("a").isNull(), "unknown").otherwise(F.col("a.source_type")).alias("source_type"), F.col("a.tier").alias("tier"), "n_edges", "lacks", "confidence")
    return merged.unionByName(more), summary
