"""Queries on recall, statistics and mutation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import point_id
from ..functions.text import first_present
from ..operators import catalog, postings, recall
from ..operators.predicates import SearchFilters, visible
from ..operators.tables import shared_folder
from .relations import POINTS_SQL, VECTORS_SQL, points, table, vectors

QUERY = "that there heres thand onen"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def r01_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible English points, nearest to vector 0 after the boost."""
    found = visible(vectors(spark, sf_dir), SearchFilters(project="EN"))
    return recall.dense(found, query_vector(spark, sf_dir), 10).select("memory_id", "status", "canonical", F.round("score", 6).alias("score"))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a hybrid search: 40 dense results with their lexical scores."""
    k = recall.candidate_limit(10, True)
    found = recall.dense(visible(vectors(spark, sf_dir)), query_vector(spark, sf_dir), k)
    return found.withColumn("lexical_score", F.round(recall.lexical_score(QUERY, "text", "source_quote", "summary", "source_title"), 9))


def r05_rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.fuse(searched(spark, sf_dir), 10).select("memory_id", F.round("lexical_score", 6).alias("lexical_score"), F.round("fused", 6).alias("fused"))


def r03_lexical_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.lexical(visible(points(spark, sf_dir)), QUERY, 20, "text", "source_title").select("memory_id", F.round("lexical_score", 6).alias("lexical_score"), F.round("score", 6).alias("score"))


def r03_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of ``r03_lexical_recall`` from an inverted index, which is built first."""
    index = postings.build(visible(points(spark, sf_dir)), f"{shared_folder(spark)}/indexes/{uuid.uuid4().hex}", "text", "source_title")
    return postings.search(spark, index, QUERY, 20).select("memory_id", F.round("lexical_score", 6).alias("lexical_score"), F.round("score", 6).alias("score"))


def r06_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of a conversation once, with the ids of its copies."""
    found = recall.collapse(points(spark, sf_dir).withColumn("score", F.lit(1.0)))
    return found.select("conversation_id", "memory_id", "duplicate_count", F.array_join("duplicate_ids", ",").alias("duplicate_ids"))


def r07_conversation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = points(spark, sf_dir).withColumn("score", (F.col("doc_id") * 7919 % 1000) / 1000)
    return recall.floor(recall.cap_per_group(scored, 3, recall.by_score()), 0.5).select("conversation_id", "memory_id", "score")


def r08_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = recall.context_pack(searched(spark, sf_dir), 6000, recall.by_score(), "source_quote", "text", "source_title", "conversation_id", "project", "speaker", "source_type")
    return packed.select("pos", "memory_id", "cost", "used", "dropped")


def r13_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.keyword(points(spark, sf_dir), QUERY, 25, "text", "source_title", "project").select("memory_id", F.round("score", 6).alias("score"))


def v03_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    probes = embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = recall.multi_query(embeddings.withColumn("memory_id", F.lpad(F.col("vec_id").cast("string"), 9, "0")), probes, 5, 0.1)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def j16_merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    first = p.where("doc_id % 3 = 0").select("memory_id", (F.col("doc_id") % 10 / 10).alias("score"))
    second = p.where("doc_id % 2 = 0").select("memory_id", (F.col("doc_id") % 7 / 7).alias("score"))
    return recall.merge_best(first, second).select("memory_id", F.round("score", 6).alias("score"))


def a23_retrieval_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.retrieval_thin(searched(spark, sf_dir), "summary").select("n", "derived_share", "thin")


def a01_memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stats(points(spark, sf_dir), "memory_kind", "speaker", "project", "status")


def a06_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facet_counts(points(spark, sf_dir), "conversation_id", 12)


def a09_corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.profile(points(spark, sf_dir))


def a10_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_documents(points(spark, sf_dir))


def a11_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_documents(points(spark, sf_dir), F.col("source_title"), F.md5("source_type"))


def a13_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.most_common(points(spark, sf_dir), "status")


def a24_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int") % 5)
    return catalog.metrics(events, ["event_type", "k"], "value")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth point twice, and some new ones."""
    p = points(spark, sf_dir).where("doc_id % 10 = 0")
    new = [F.concat("memory_id", F.when(F.col("doc_id") % 20 == 0, F.lit("")).otherwise(F.lit("_new"))).alias("memory_id"), "status"]
    return p.select(*new, F.lit(1).alias("pos")).withColumn("status", F.lit("old")).unionByName(p.select(*new, F.lit(2).alias("pos")).withColumn("status", F.lit("changed")))


def k01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert(points(spark, sf_dir).select("memory_id", "status"), changes(spark, sf_dir))


def k05_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("memory_id", "project", "status")
    patches = points(spark, sf_dir).where("doc_id % 4 = 0").select("memory_id", F.when(F.col("doc_id") % 8 == 0, "patched").alias("project"), F.lit("x").alias("status"), F.lit(True).alias("set_project"), (F.col("doc_id") % 12 == 0).alias("set_status"))
    return catalog.patch(p, patches, ["project", "status"])


def k06_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("memory_id", "status", "doc_id")
    rest = catalog.delete_ids(p, p.where("doc_id % 9 = 0"))
    return catalog.delete_where(rest, F.col("status") == "needs_review").select("memory_id", "status")


def l01_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_after(visible(points(spark, sf_dir), SearchFilters(speaker="USER", since=1704067200 + 600)), "doc_3", 50).select("memory_id", "ts")


def t49_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("memory_id", point_id(F.col("memory_id")).alias("point_id"), first_present(F.lit(" "), F.col("project"), F.lit("general")).alias("project"))


QUERIES = {f.__name__: f for f in (r01_recall, r03_lexical_recall, r03_postings, r05_rrf_hybrid, r06_collapse, r07_conversation_cap, r08_context_pack, r13_keyword_search, v03_multi_query, j16_merge_best, a23_retrieval_thin, a01_memory_stats, a06_facet_counts, a09_corpus_profile, a10_top_documents, a11_duplicate_documents, a13_most_common, a24_event_metrics, k01_upsert, k05_patch, k06_delete, l01_page, t49_point_ids)}

BOOST = "(CASE WHEN canonical THEN 1.25::DOUBLE ELSE 1 END * CASE status WHEN 'approved' THEN 1.2::DOUBLE WHEN 'direct' THEN 1.2 WHEN 'inferred' THEN 1.08 WHEN 'needs_review' THEN 0.98 ELSE 1 END)"
HIDDEN = "status NOT IN ('rejected', 'contradicted', 'outdated', 'deleted')"


def tokens_sql(x: str) -> str:
    return f"""list_filter(list_transform(list_filter(string_split_regex(translate(lower(coalesce({x}, '')), chr(10) || ',.:;"''', '       '), '\\s+'), lambda t: t <> ''), lambda t: trim(t, '`()[]{{}}<>"*#|/\\')), lambda t: t <> '')"""


def lexical_sql(*cols: str) -> str:
    query = tokens_sql(f"'{QUERY}'")
    have = " || ".join(tokens_sql(c) for c in cols)
    return f"len(list_filter({query}, lambda w: list_contains({have}, w))) / len({query})::DOUBLE"


SEARCHED_SQL = f"""{VECTORS_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), found AS (
  SELECT v.*, round(list_cosine_similarity(embedding, q) * {BOOST}, 9) AS score FROM vectors v, q WHERE {HIDDEN}
  ORDER BY score DESC, ts DESC, memory_id LIMIT 40), searched AS (
  SELECT *, round({lexical_sql('text', 'source_quote', 'summary', 'source_title')}, 9) AS lexical_score FROM found)"""

SQL = {
    "r01_recall": f"""WITH {VECTORS_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT memory_id, status, canonical, round(score, 6) AS score FROM (
  SELECT *, round(list_cosine_similarity(embedding, q) * {BOOST}, 9) AS score FROM vectors, q WHERE lower(project) = 'en' AND {HIDDEN}
  ORDER BY score DESC, ts DESC, memory_id LIMIT 10)""",
    "r03_lexical_recall": f"""WITH {POINTS_SQL}, scored AS (SELECT *, {lexical_sql('text', 'source_title')} AS lexical_score FROM points WHERE {HIDDEN})
SELECT memory_id, round(lexical_score, 6) AS lexical_score, round(score, 6) AS score FROM (
  SELECT *, round(lexical_score * {BOOST}, 9) AS score FROM scored WHERE lexical_score > 0 ORDER BY score DESC, ts DESC, memory_id LIMIT 20)""",
    "r05_rrf_hybrid": f"""WITH {SEARCHED_SQL}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, ts DESC, memory_id) AS rd, row_number() OVER (ORDER BY lexical_score DESC, score DESC, ts DESC, memory_id) AS rl FROM searched), raw AS (
  SELECT *, 1::DOUBLE / (60 + rd) + CASE WHEN lexical_score > 0 THEN 1::DOUBLE / (60 + rl) ELSE 0 END AS raw FROM ranked), fused AS (
  SELECT *, round(raw / max(raw) OVER (), 9) AS fused FROM raw)
SELECT memory_id, round(lexical_score, 6) AS lexical_score, round(fused, 6) AS fused FROM (SELECT * FROM fused ORDER BY fused DESC, ts DESC, memory_id LIMIT 10)""",
    "r06_collapse": f"""WITH {POINTS_SQL}, keyed AS (
  SELECT *, trim(regexp_replace(lower(CASE WHEN trim(text) <> '' THEN trim(text) ELSE trim(source_quote) END), '\\s+', ' ', 'g')) AS k FROM points), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id, k ORDER BY ts DESC, memory_id) AS place FROM (SELECT * REPLACE (CASE WHEN k = '' THEN memory_id ELSE k END AS k) FROM keyed))
SELECT conversation_id, max(memory_id) FILTER (place = 1) AS memory_id, count(*) - 1 AS duplicate_count, coalesce(string_agg(memory_id, ',' ORDER BY place) FILTER (place > 1), '') AS duplicate_ids
FROM ranked GROUP BY conversation_id, k""",
    "r07_conversation_cap": f"""WITH {POINTS_SQL}, scored AS (SELECT *, (doc_id * 7919 % 1000) / 1000::DOUBLE AS score FROM points)
SELECT conversation_id, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, ts DESC, memory_id) AS n FROM scored) WHERE (n <= 3 OR conversation_id = '') AND score >= 0.5""",
    "r08_context_pack": f"""WITH RECURSIVE {SEARCHED_SQL}, costed AS (
  SELECT memory_id, row_number() OVER (ORDER BY score DESC, ts DESC, memory_id) AS pos, (strlen(source_quote) + strlen(text) + strlen(source_title) + strlen(conversation_id) + strlen(project) + strlen(speaker) + strlen(source_type))::BIGINT AS cost FROM searched), walk AS (
  SELECT 0::BIGINT AS pos, 0::BIGINT AS used, false AS kept
  UNION ALL SELECT c.pos, CASE WHEN w.used + c.cost <= 6000 THEN w.used + c.cost ELSE w.used END, w.used + c.cost <= 6000 FROM walk w JOIN costed c ON c.pos = w.pos + 1)
SELECT c.pos, c.memory_id, c.cost, (SELECT max(used) FROM walk)::BIGINT AS used, (SELECT count(*) FROM walk WHERE NOT kept AND pos > 0)::BIGINT AS dropped FROM walk w JOIN costed c USING (pos) WHERE w.kept""",
    "r13_keyword_search": f"""WITH {POINTS_SQL}, scored AS (SELECT memory_id, round(({' + '.join(f"contains(lower(text || ' ' || source_title || ' ' || project), '{w}')::INT" for w in QUERY.split())}) / {len(QUERY.split())}::DOUBLE, 9) AS score FROM points)
SELECT memory_id, round(score, 6) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, memory_id LIMIT 25)""",
    "v03_multi_query": """WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE score >= 0.1)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
    "j16_merge_best": f"""WITH {POINTS_SQL} SELECT memory_id, round(max(score), 6) AS score FROM (
  SELECT memory_id, (doc_id % 10) / 10::DOUBLE AS score FROM points WHERE doc_id % 3 = 0 UNION ALL SELECT memory_id, (doc_id % 7) / 7::DOUBLE FROM points WHERE doc_id % 2 = 0) GROUP BY memory_id""",
    "a23_retrieval_thin": f"""WITH {SEARCHED_SQL}, s AS (SELECT count(*) AS n, round(avg(score), 6) AS m, round(avg((source_type = 'summary')::INT), 6) AS derived_share FROM searched)
SELECT n, derived_share, n = 0 OR m < 0.55 OR derived_share > 0.6 AS thin FROM s""",
    "a01_memory_stats": f"""WITH {POINTS_SQL} SELECT 'total' AS facet, '' AS value, count(*) AS n FROM points
UNION ALL SELECT 'memory_kind', memory_kind, count(*) FROM points GROUP BY memory_kind UNION ALL SELECT 'speaker', speaker, count(*) FROM points GROUP BY speaker
UNION ALL SELECT 'project', trim(project), count(*) FROM points WHERE trim(project) <> '' GROUP BY trim(project) UNION ALL SELECT 'status', status, count(*) FROM points GROUP BY status""",
    "a06_facet_counts": f"WITH {POINTS_SQL} SELECT conversation_id AS value, count(*) AS n FROM points WHERE trim(conversation_id) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
    "a09_corpus_profile": f"WITH {POINTS_SQL} SELECT count(*) AS points, count(DISTINCT conversation_id) AS sources, count(DISTINCT source_title) AS titles, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (coalesce(trim(text), '') = '')::BIGINT AS blank FROM points",
    "a10_top_documents": f"WITH {POINTS_SQL} SELECT conversation_id AS document, count(*) AS chunks FROM points GROUP BY 1 ORDER BY chunks DESC, document LIMIT 8",
    "a11_duplicate_documents": f"WITH {POINTS_SQL}, pairs AS (SELECT DISTINCT lower(source_title) AS title, md5(source_type) AS f FROM points) SELECT title, count(*) AS n, string_agg(f, ',' ORDER BY f) AS fingerprints FROM pairs GROUP BY title HAVING count(*) > 1",
    "a13_most_common": f"WITH {POINTS_SQL} SELECT status AS value, count(*) AS n FROM points GROUP BY 1 ORDER BY n DESC, value LIMIT 1",
    "a24_event_metrics": "SELECT event_type, (props->>'$.k')::INT % 5 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "k01_upsert": f"""WITH {POINTS_SQL}, new AS (SELECT memory_id || CASE WHEN doc_id % 20 = 0 THEN '' ELSE '_new' END AS memory_id, 'changed' AS status FROM points WHERE doc_id % 10 = 0)
SELECT memory_id, status FROM points WHERE memory_id NOT IN (SELECT memory_id FROM new) UNION ALL SELECT memory_id, status FROM new""",
    "k05_patch": f"""WITH {POINTS_SQL} SELECT memory_id, CASE WHEN doc_id % 8 = 0 THEN 'patched' WHEN doc_id % 4 = 0 THEN NULL ELSE project END AS project, CASE WHEN doc_id % 12 = 0 THEN 'x' ELSE status END AS status FROM points""",
    "k06_delete": f"WITH {POINTS_SQL} SELECT memory_id, status FROM points WHERE doc_id % 9 <> 0 AND status <> 'needs_review'",
    "l01_page": f"WITH {POINTS_SQL} SELECT memory_id, ts FROM points WHERE {HIDDEN} AND lower(speaker) = 'user' AND ts >= 1704067800 AND memory_id > 'doc_3' ORDER BY memory_id LIMIT 50",
    "t49_point_ids": f"""WITH {POINTS_SQL}, h AS (SELECT memory_id, project, md5(memory_id) AS h FROM points)
SELECT memory_id, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id, coalesce(nullif(trim(project), ''), 'general') AS project FROM h""",
}
SQL["r03_postings"] = SQL["r03_lexical_recall"]
