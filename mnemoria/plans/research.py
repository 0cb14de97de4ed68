"""Queries on deep research and on the lineage of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tag_list
from ..functions.times import asked_time
from ..operators import drill, evidence, lineage
from ..streaming.limits import rate_limited
from .curation import FAMILY_SQL, TIER_SQL, quoted
from .relations import MESSAGES_SQL, POINTS_SQL, messages, points, table


def embedded(text: Column) -> Column:
    """A stand-in for an embedder: 64 numbers from a digest."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.ascii(F.substr(F.md5(text), i % 32 + 1, F.lit(1))) - 75).cast("double"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_vectors = points(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), "doc_id", "left")
    return with_vectors.select("memory_id", F.col("conversation_id").alias("document"), "source_title", "source_type", "text", "ts", "embedding")


def asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening turns of the conversations whose id is divisible by 100: the stated set of questions."""
    return table(spark, sf_dir, "conversations").where("conv_id % 100 = 0 and turn = 0").select("conv_id", F.col("text").alias("question"))


def e15_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left and what is gone for every session: records of other models do not count, nor those of a lower tier."""
    m, names, tiers = messages(spark, sf_dir), list(drill.CANDIDATES), list(evidence.TIERS)
    k = F.col("conversation_id").cast("int")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    about = pick(names, k + F.col("turn") % 2)
    record = F.struct(about.alias("uncertainty"), F.get(drill.candidates(about), (F.col("turn") % 4).cast("int")).alias("strategy"), F.when(F.col("turn") % 5 == 3, "tier:|H1:2:active").otherwise("tier:|H1:1:active").alias("model"), pick(tiers, F.col("turn")).alias("tier"))
    sessions = m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))).alias("t")).withColumn("gone", F.transform("t", lambda x: x["r"]))
    model = drill.model_key(F.array(F.struct(F.lit("H1").alias("id"), F.lit(1).alias("rank"), F.lit(" active").alias("status"))), F.lit(""))
    found = sessions.withColumn("uncertainty", pick(names, k)).withColumn("a", drill.availability(F.col("uncertainty"), F.col("gone"), model, pick(tiers, k + 3)))
    history = F.transform("gone", lambda g: F.struct(g["uncertainty"].alias("uncertainty"), g["strategy"].alias("strategy"), F.when(g["tier"] == "RAW_SOURCE", "HIGH").otherwise("LOW").alias("gain")))
    chosen = drill.selected(F.col("uncertainty"), F.col("a.remaining"), history)
    return found.select("conversation_id", "uncertainty", F.array_join("a.remaining", ",").alias("remaining"), F.array_join("a.exhausted", ",").alias("exhausted"), chosen["strategy"].alias("strategy"), chosen["why"].alias("why"), chosen["reused"].alias("reused"))


def e19_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy, and one that has no route, for each question."""
    names = spark.createDataFrame([(name,) for name in [*drill.ROUTES, "UNHEARD_OF"]], "strategy string")
    support = F.when(F.col("strategy") == "NEIGHBOR_CHUNKS", F.array(F.lit("doc_7"))).when(F.col("strategy") == "CROSS_DOCUMENT", F.array(F.lit("src1"), F.lit("src2"))).otherwise(F.array(F.lit("src3")))
    asked = asking(spark, sf_dir).join(F.broadcast(names)).select(F.concat_ws("/", "conv_id", "strategy").alias("session_id"), "strategy", F.col("question").alias("asked"), support.alias("support"))
    found = drill.dispatched(asked, corpus(spark, sf_dir), embedded)
    return found.select("session_id", "pos", "memory_id", "source_type", "score")


CASES = (("", (), 1), ("", ("CHRONOLOGY_GAP",), 0), ("", ("PROVENANCE_GAP", "CONTRADICTION"), 1), ("", ("CONTRADICTION",), 1), ("", ("SOURCE_QUALITY",), 1), ("", ("RETRIEVAL_LIMIT",), 1), ("", ("GENERIC_SIMILARITY",), 1), ("", ("AMBIGUOUS_CLASSIFICATION",), 1), ("Which draft came first?", (), 0), ("Who separated them?", (), 0))
HYPOTHESES = (("H1", "the branches developed independently then recombined"), ("H2", "a the of and in"), ("H3", "one single origin for all"))


def research_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every kind for each question, with three hypotheses."""
    cases = spark.createDataFrame([(n, wanted, list(blockers), searches) for n, (wanted, blockers, searches) in enumerate(CASES)], "n int, wanted string, blockers array<string>, searches int")
    sessions = asking(spark, sf_dir).join(F.broadcast(cases)).select(F.concat_ws("/", "conv_id", "n").alias("session_id"), "question", "wanted", "blockers", "searches")
    given = spark.createDataFrame([(h, statement, k + 1) for k, (h, statement) in enumerate(HYPOTHESES)], "hypothesis_id string, statement string, pos int")
    seeds = sessions.select("session_id").join(F.broadcast(given)).select("session_id", "hypothesis_id", "statement", F.lit(0.0).alias("confidence"), F.lit(0.2).alias("strength"), F.lit(0).alias("rank"), F.lit("active").alias("status"), "pos")
    return drill.opened(sessions, evidence.seeded(seeds))


def said_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with texts that bear on the hypotheses."""
    said = ("They developed independently. ", "It may have one origin. ", "These were never separate and do not recombine. ", "However, a single source for all. ", "")
    number = F.regexp_extract("memory_id", "[0-9]+", 0).cast("int")
    return corpus(spark, sf_dir).withColumn("text", F.concat(F.element_at(F.array(*map(F.lit, said)), (number % len(said) + 1)), F.coalesce("text", F.lit(""))))


def e20_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first steps of every session."""
    _, steps = drill.run(research_sessions(spark, sf_dir), said_points(spark, sf_dir), embedded, steps=5)
    return steps.select("session_id", "step", "uncertainty", "question", "strategy", "evidence", "thoughts", "gain", "status", "duplicate", "negative", "tier", F.array_join("remaining", ",").alias("remaining"), F.array_join("exhausted", ",").alias("exhausted"))


SOURCES = [
    "memory_id", "conversation_id AS source_id", "concat('book_', doc_id - doc_id % 3) AS document_id", "source_title", "CASE WHEN doc_id % 11 = 4 THEN '' WHEN doc_id % 11 = 5 THEN 'Slides' ELSE source_type END AS source_type", "doc_id",
    "cast(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 50 END AS int) AS chunk_index", "CASE WHEN doc_id % 3 = 0 THEN concat('a_turn_', doc_id % 7, '_turn_9') ELSE memory_id END AS turn_id", "cast(doc_id % 5 * 10 AS double) AS segment_start", "cast(CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 * 10 + 5 ELSE 0 END AS double) AS segment_end",
    "CASE WHEN doc_id % 4 < 2 THEN ts - doc_id % 9 * 5000 END AS original_ts", "CASE WHEN doc_id % 2 = 0 THEN ts END AS ingested_ts", "CASE WHEN doc_id % 6 = 2 THEN concat('Book_', doc_id - 2 - (doc_id - 2) % 3) ELSE '' END AS parent_id",
]
LISTS = {"derived_from": ("doc_id % 7 = 3", ("concat('DOC_', doc_id - 3)", "'src5'")), "cites": ("doc_id % 5 = 3", ("concat('doc_', doc_id - 3)",))}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with all that links sources, as nodes."""
    p = points(spark, sf_dir).selectExpr(*SOURCES, *(f"CASE WHEN {when} THEN array({', '.join(values)}) ELSE array() END AS {name}" for name, (when, values) in LISTS.items()))
    return lineage.nodes(p.withColumn("turn_index", lineage.turn_index(F.col("turn_id"))))


def named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated names: ids and titles of the documents whose id is divisible by 100, a source, a book, and what is nowhere."""
    p = points(spark, sf_dir).where("doc_id % 100 = 0")
    names = p.select(F.upper("memory_id").alias("anchor")).unionByName(p.select(F.col("source_title").alias("anchor")))
    return names.unionByName(spark.createDataFrame([("src3",), ("book_9",), ("Nowhere",)], "anchor string"))


def n05_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the traces of all stated names."""
    return lineage.trace(sources(spark, sf_dir), named_sources(spark, sf_dir))[0]


def n09_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the traces of all stated names lack, and how far they can be trusted."""
    return lineage.trace(sources(spark, sf_dir), named_sources(spark, sf_dir))[1].withColumn("lacks", F.array_join("lacks", "+"))


def w09_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events of each user a bucket of three tokens lets through, and the day and tags that each asks for."""
    events = table(spark, sf_dir, "events")
    told = rate_limited(events.select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts"), 1, 3)
    day = F.date_format("ts", "yyyy-MM-dd")
    raw = F.when(F.col("event_id") % 4 == 0, day).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), day, F.lit("T10:00:00+02:00"))).when(F.col("event_id") % 4 == 2, F.concat(day, F.lit(" 10:00"))).otherwise(F.lit("2024-02-31"))
    tags = tag_list(F.array(F.concat("event_type", F.lit(" , a")), F.lit(None).cast("string")), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(",b,"), "event_type")))
    asked = events.select(F.col("event_id").alias("request_id"), F.date_format(asked_time(raw), "yyyy-MM-dd HH:mm").alias("asked"), F.array_join(tags, "+").alias("tags"))
    return told.select("client", "request_id", "allowed", F.round("tokens", 6).alias("tokens")).join(asked, "request_id")


QUERIES = {f.__name__: f for f in (w09_rate_limit, e15_availability, e19_dispatch, e20_run, n05_lineage, n09_trace)}

NAMES, TIER_NAMES = list(drill.CANDIDATES), list(evidence.TIERS)
OFFERED = "CASE {0} " + " ".join(f"WHEN '{name}' THEN [{quoted(strategies)}]" for name, strategies in drill.CANDIDATES.items()) + f" ELSE [{quoted(drill.OTHERS)}] END"
RANK = "coalesce(CASE {0} " + " ".join(f"WHEN '{name}' THEN {rank}" for name, (_, rank) in evidence.TIERS.items()) + " END, 0)"
DIGEST_VECTOR = "list_transform(range(64), lambda i: (ascii(substr(md5({0}), (i % 32 + 1)::INT, 1)) - 75)::DOUBLE)"
ROUTES_SQL = ", ".join(f"('{name}', '{plan}', {k}, {per_source}, '{words}', {by_creation})" for name, (plan, k, per_source, words, by_creation) in (drill.ROUTES | {"UNHEARD_OF": drill.OTHER_ROUTE}).items())

SQL = {
    "e15_availability": f"""WITH {MESSAGES_SQL}, r AS (
  SELECT conversation_id, turn, [{quoted(NAMES)}][(conversation_id::INT + turn % 2) % {len(NAMES)} + 1] AS u, CASE WHEN turn % 5 = 3 THEN 2 ELSE 1 END AS m, [{quoted(TIER_NAMES)}][turn % {len(TIER_NAMES)} + 1] AS t FROM messages), g AS (
  SELECT *, ({OFFERED.format('u')})[turn % 4 + 1] AS s FROM r), sess AS (
  SELECT DISTINCT conversation_id, [{quoted(NAMES)}][conversation_id::INT % {len(NAMES)} + 1] AS uncertainty, [{quoted(TIER_NAMES)}][(conversation_id::INT + 3) % {len(TIER_NAMES)} + 1] AS seen FROM messages), o AS (
  SELECT *, unnest({OFFERED.format('uncertainty')}) AS strategy, generate_subscripts({OFFERED.format('uncertainty')}, 1) AS pos FROM sess), a AS (
  SELECT o.*, EXISTS (SELECT 1 FROM g WHERE g.conversation_id = o.conversation_id AND g.u = o.uncertainty AND g.s = o.strategy AND g.m = 1 AND {RANK.format('o.seen')} <= {RANK.format('g.t')}) AS gone,
    (SELECT count(*) FROM g WHERE g.conversation_id = o.conversation_id AND g.u = o.uncertainty AND g.s = o.strategy) AS used,
    (SELECT count(*) FROM g WHERE g.conversation_id = o.conversation_id AND g.u = o.uncertainty AND g.s = o.strategy AND g.t = 'RAW_SOURCE') AS good FROM o), best AS (
  SELECT DISTINCT ON (conversation_id) conversation_id, strategy, 3 * good - used > -1 AND used > 0 AS reused FROM a WHERE NOT gone ORDER BY conversation_id, CASE WHEN 3 * good - used >= 0 THEN used - 3 * good ELSE 1 END, pos)
SELECT conversation_id, uncertainty, coalesce(string_agg(a.strategy, ',' ORDER BY pos) FILTER (NOT gone), '') AS remaining, coalesce(string_agg(a.strategy, ',' ORDER BY pos) FILTER (gone), '') AS exhausted,
  coalesce(any_value(best.strategy), 'FREEZE_BRANCH') AS strategy, CASE WHEN any_value(best.strategy) IS NULL THEN '{drill.NONE_LEFT}' ELSE '{drill.BY_YIELD}' END AS why, coalesce(any_value(best.reused), true) AS reused
FROM a LEFT JOIN best USING (conversation_id) GROUP BY 1, 2""",
    "e19_dispatch": f"""WITH {POINTS_SQL}, c AS (SELECT p.*, p.conversation_id AS document, e.embedding::DOUBLE[] AS embedding FROM points p LEFT JOIN embeddings e ON p.doc_id = e.vec_id), routes(strategy, plan, k, per_source, words, by_creation) AS (VALUES {ROUTES_SQL}), s AS (
  SELECT conv_id || '/' || strategy AS session_id, routes.*, text AS query FROM conversations, routes WHERE conv_id % 100 = 0 AND turn = 0), w AS (
  SELECT *, list_filter(string_split_regex(lower(trim(query)), '\\s+'), lambda x: x <> '' AND x NOT IN ({quoted(drill.GENERIC)})) AS kept FROM s), asked AS (
  SELECT *, list_filter(list_distinct(string_split_regex(lower(CASE WHEN words = '-' THEN CASE WHEN len(kept) = 0 THEN trim(query) ELSE array_to_string(kept, ' ') END WHEN words LIKE ' %' THEN query || words WHEN words = '' THEN query ELSE words END), '[^a-z0-9]+')), lambda t: t <> '') AS tokens FROM w), kw AS (
  SELECT session_id, memory_id, source_type, ts, k, by_creation, round(len(list_filter(tokens, lambda t: contains(lower(source_title || ' ' || text), t))) / len(tokens)::DOUBLE, 9) AS score FROM asked, c WHERE plan = 'keyword' AND len(tokens) > 0), kw1 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) AS n FROM kw WHERE score > 0), sem AS (
  SELECT session_id, strategy, memory_id, source_title, document, source_type, ts, k, per_source, round(list_cosine_similarity(embedding, {DIGEST_VECTOR.format('query')}), 9) AS score FROM asked, c WHERE plan = 'semantic' AND embedding IS NOT NULL AND (strategy <> 'RAW_SOURCE_LOOKUP' OR source_type = 'document')), sem1 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) AS n FROM sem), sem2 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, document ORDER BY score DESC, memory_id) AS m FROM sem1 WHERE n <= CASE WHEN per_source > 0 THEN least(5 * k, 200) ELSE k END AND NOT (strategy = 'CROSS_DOCUMENT' AND document IN ('src1', 'src2'))), sem3 AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, memory_id) AS r FROM sem2 WHERE per_source = 0 OR m <= per_source), doc AS (
  SELECT session_id, memory_id, source_type, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, memory_id) AS n FROM asked, c WHERE plan = 'document' AND document = 'src3'), placed AS (
  SELECT *, row_number() OVER (PARTITION BY document ORDER BY ts, memory_id) AS place FROM c), near AS (
  SELECT session_id, p.memory_id, p.source_type, p.ts FROM asked, placed p JOIN placed a ON p.document = a.document AND abs(p.place - a.place) <= 2 WHERE plan = 'neighbours' AND a.memory_id = 'doc_7'), found AS (
  SELECT session_id, memory_id, source_type, ts, score, by_creation FROM kw1 WHERE n <= k UNION ALL SELECT session_id, memory_id, source_type, ts, score, false FROM sem3 WHERE r <= k
  UNION ALL SELECT session_id, memory_id, source_type, ts, 1, true FROM doc WHERE n <= 12 UNION ALL SELECT session_id, memory_id, source_type, ts, 1, true FROM near)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN by_creation THEN 0 ELSE -score END, CASE WHEN by_creation THEN ts END NULLS LAST, memory_id)::INT AS pos, memory_id, source_type, score::DOUBLE AS score FROM found""",
}

# Each name with its best node against every node, pair by pair.
TRACE_SQL = f"""{POINTS_SQL}, raw AS (SELECT {', '.join(SOURCES)}, {', '.join(f"CASE WHEN {when} THEN [{', '.join(values)}] ELSE []::VARCHAR[] END AS {name}" for name, (when, values) in LISTS.items())} FROM points), nodes AS (
  SELECT *, {FAMILY_SQL} AS family, CASE WHEN turn_id LIKE 'a_turn_%' THEN substr(turn_id, 8, 1)::INT ELSE 0 END AS turn_index, {TIER_SQL} AS tier, [lower(source_id), lower(document_id), lower(source_title), lower(memory_id)] AS ids FROM raw), names AS (
  SELECT DISTINCT anchor FROM (SELECT upper(memory_id) AS anchor FROM points WHERE doc_id % 100 = 0 UNION ALL SELECT source_title FROM points WHERE doc_id % 100 = 0 UNION ALL SELECT unnest(['src3', 'book_9', 'Nowhere']))), a AS (
  SELECT DISTINCT ON (anchor) anchor, nodes.* FROM names JOIN nodes ON list_contains(ids, lower(anchor))
  ORDER BY anchor, -(2 * (chunk_index > 0)::INT + 2 * (turn_index > 0)::INT + 3 * (original_ts IS NOT NULL)::INT + 2 * (parent_id <> '')::INT + (len(cites) > 0)::INT + (len(derived_from) > 0)::INT), memory_id), known AS (
  SELECT *, list_transform(list_concat([source_id, document_id, memory_id], derived_from, cites), lambda x: lower(x)) AS refs FROM a), pairs AS (
  SELECT a.anchor, a.source_id AS src, n.source_id AS node, n.memory_id AS memory_id, list_contains(n.ids, lower(a.anchor)) AS same, a.memory_id <> n.memory_id AS other,
    list_has_any(list_transform(list_append(n.derived_from, n.parent_id), lambda x: lower(x)), a.refs) AS by_node, list_has_any(list_transform(a.derived_from, lambda x: lower(x)), [lower(n.source_id), lower(n.document_id)]) OR lower(a.parent_id) = lower(n.source_id) AS by_anchor,
    list_has_any(list_transform(n.cites, lambda x: lower(x)), a.refs) AS cites_it, list_has_any(list_transform(a.cites, lambda x: lower(x)), [lower(n.source_id), lower(n.document_id)]) AS cited, a.family = n.family AND a.family <> '' AS family, n.source_type AS kind,
    a.original_ts AS ats, n.original_ts AS nts, n.ingested_ts AS nin, CASE WHEN a.chunk_index > 0 AND n.chunk_index > 0 THEN 0 WHEN a.turn_index > 0 AND n.turn_index > 0 THEN 1 WHEN a.segment_end > 0 AND n.segment_start > 0 THEN 2 WHEN a.original_ts IS NOT NULL AND n.original_ts IS NOT NULL THEN 3 END AS sig,
    CASE WHEN a.chunk_index > 0 AND n.chunk_index > 0 THEN n.chunk_index - a.chunk_index WHEN a.turn_index > 0 AND n.turn_index > 0 THEN n.turn_index - a.turn_index WHEN a.segment_end > 0 AND n.segment_start > 0 THEN n.segment_start - a.segment_end ELSE n.original_ts - a.original_ts END AS apart FROM known a, nodes n), kinds AS (
  SELECT *, CASE WHEN regexp_matches(lower(kind), 'summary|overview') THEN '{lineage.SUMMARIZES}' WHEN regexp_matches(lower(kind), 'transcript|audio') THEN '{lineage.TRANSCRIBES}' WHEN regexp_matches(lower(kind), 'presentation|slide|diagram') THEN '{lineage.PRESENTS}' ELSE '{lineage.SAME_FAMILY}' END AS is_a FROM pairs), edges AS (
  SELECT anchor, node AS from_id, src AS to_id, '{lineage.DERIVED_FROM}' AS relation, '{lineage.OF_NODE}' AS basis, 'upstream' AS side, 0.92 AS confidence, NULL AS d, memory_id FROM kinds WHERE NOT same AND by_node
  UNION ALL SELECT anchor, src, node, '{lineage.DERIVED_FROM}', '{lineage.OF_ANCHOR}', 'downstream', 0.9, NULL, memory_id FROM kinds WHERE NOT same AND by_anchor
  UNION ALL SELECT anchor, node, src, '{lineage.CITES}', '{lineage.CITED}', 'upstream', 0.88, NULL, memory_id FROM kinds WHERE NOT same AND cites_it
  UNION ALL SELECT anchor, src, node, '{lineage.CITES}', '{lineage.CITED}', 'downstream', 0.88, NULL, memory_id FROM kinds WHERE NOT same AND cited
  UNION ALL SELECT anchor, src, node, is_a, '{lineage.FAMILY}', 'related', CASE WHEN is_a = '{lineage.SAME_FAMILY}' THEN 0.58 ELSE 0.66 END, NULL, memory_id FROM kinds WHERE NOT same AND family
  UNION ALL SELECT anchor, src, node, CASE WHEN nts > ats THEN '{lineage.LATER}' ELSE '{lineage.EARLIER}' END, '{lineage.FAMILY_TIME}', 'related', 0.69, NULL, memory_id FROM kinds WHERE NOT same AND family AND nts IS NOT NULL AND ats IS NOT NULL
  UNION ALL SELECT anchor, src, node, CASE WHEN apart > 0 THEN '{lineage.LATER}' ELSE '{lineage.EARLIER}' END, [{quoted([s[0] for s in lineage.SIGNALS])}][sig + 1], 'related', [{', '.join(str(s[1]) for s in lineage.SIGNALS)}][sig + 1], abs(apart), memory_id FROM kinds WHERE same AND other AND sig IS NOT NULL), merged AS (
  SELECT anchor, from_id, to_id, relation, basis, min(side) AS side, min(confidence)::DOUBLE AS confidence, count(*) AS n, arg_min(memory_id, (d, memory_id)) FILTER (d IS NOT NULL) AS nearest FROM edges GROUP BY ALL), sums AS (
  SELECT anchor, count(*) AS n_edges, sum(confidence) AS total, bool_or(basis = '{lineage.FAMILY_TIME}' OR basis IN ({quoted([s[0] for s in lineage.SIGNALS])})) AS ordered FROM merged GROUP BY 1), told AS (
  SELECT names.anchor, a.memory_id, a.source_id, a.source_type, a.tier, a.family, coalesce(n_edges, 0) AS n_edges, total, (SELECT count(*) FROM nodes n WHERE n.family = a.family) AS members,
    coalesce(ordered, false) OR EXISTS (SELECT 1 FROM kinds k WHERE k.anchor = names.anchor AND NOT same AND ats IS NOT NULL AND nts IS NOT NULL) AS original, EXISTS (SELECT 1 FROM kinds k WHERE k.anchor = names.anchor AND NOT same AND nts IS NULL AND nin IS NOT NULL) AS ingested FROM names LEFT JOIN a USING (anchor) LEFT JOIN sums USING (anchor))"""
TIER_WEIGHT = "CASE tier " + " ".join(f"WHEN '{name}' THEN {weight}" for name, (weight, _) in evidence.TIERS.items()) + " END"
SQL["n05_lineage"] = f"""WITH {TRACE_SQL} SELECT anchor, from_id, to_id, relation, basis, side, confidence, n, nearest FROM merged
UNION ALL SELECT anchor, coalesce(source_id, anchor), '', '{lineage.UNKNOWN}', CASE WHEN memory_id IS NULL THEN '{lineage.UNMATCHED}' ELSE '{lineage.UNLINKED}' END, 'related', CASE WHEN memory_id IS NULL THEN 0.2 ELSE 0.24 END, 1, NULL FROM told WHERE n_edges = 0
UNION ALL SELECT anchor, source_id, family, '{lineage.SAME_FAMILY}', '{lineage.FAMILY_COUNT}', 'related', 0.63, members, NULL FROM told WHERE family <> '' AND members > 1"""
SQL["n09_trace"] = f"""WITH {TRACE_SQL}, w AS (SELECT *, CASE WHEN memory_id IS NULL THEN ['{lineage.NOT_FOUND}'] ELSE list_filter([
  CASE WHEN NOT original AND ingested THEN 'only ingestion timestamps were available; intellectual chronology not inferred from ingestion order' WHEN NOT original THEN 'no original chronology metadata (chunk/turn/segment/original timestamp) found' END,
  CASE WHEN source_type = '' THEN 'source_type missing on anchor' END, CASE WHEN family = '' THEN 'source family key missing on anchor' END], lambda x: x IS NOT NULL) END AS l, {TIER_WEIGHT} AS tw FROM told)
SELECT anchor, memory_id, CASE WHEN memory_id IS NULL THEN 'unknown' ELSE source_type END AS source_type, tier, n_edges, array_to_string(l, '+') AS lacks,
  round(CASE WHEN memory_id IS NULL THEN 0.2 ELSE greatest(least(CASE WHEN n_edges > 0 THEN 0.55 * tw + 0.45 * total / n_edges ELSE 0.65 * tw END, 1) - 0.05 * len(l), 0) END, 6)::DOUBLE AS confidence FROM w"""
SQL["w09_rate_limit"] = """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) / 1000000 AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (
  SELECT user_id, event_id, n, secs, true AS allowed, 2::DOUBLE AS tokens FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, secs, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM (SELECT e.user_id, e.event_id, e.n, e.secs, least(3, f.tokens + (e.secs - f.secs) / 60) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT f.user_id::VARCHAR AS client, f.event_id AS request_id, allowed, round(tokens, 6) AS tokens,
  CASE f.event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d 00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%d 08:00') END AS asked, event_type || '+a' || CASE WHEN f.event_id % 3 = 0 THEN '+b+' || event_type ELSE '' END AS tags FROM f JOIN events USING (event_id)"""
