"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive import neighbours
from .common import read_table
from .factorisation import quality_scores
from .lines import per_document
from .mixing import mix
from .packing import concatenate_and_cut
from .pii import BASE_KINDS, personal_data
from .prefixtrie import prefix_trie
from .quality import quality
from .simhash import near_duplicates
from .suffixes import substring_dedup
from .tokens import token_counts
from .urls import host_of, path_of, temporal_url_filter
from .whitening import whitened


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(read_table(spark, sf_dir, "documents"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def op3_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "embeddings"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list for the pages' own hosts, folders and domains; digests of the patterns set the dates."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    folder = F.when(F.size(F.split(path, "/")) > 2, F.concat(host, F.lit("/"), F.element_at(F.split(path, "/"), 2), F.lit("/")))
    domain = F.regexp_extract(host, r"[^.]+\.[^.]+$", 0)
    names = pages.select(F.explode(F.array(F.struct(F.lit("host").alias("category"), host.alias("pattern")), F.struct(F.lit("folder").alias("category"), folder.alias("pattern")), F.struct(F.lit("domain").alias("category"), domain.alias("pattern")))).alias("e"))
    named = names.select("e.category", "e.pattern").where("pattern <> ''").distinct().withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int"))
    chosen = named.where("(category = 'host' and h % 3 = 0) or (category = 'folder' and h % 2 = 0) or category = 'domain'")
    added = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, h % 200)")
    length = F.when(F.col("category") == "domain", F.col("h") % 5 + 1).otherwise(F.col("h") % 97 + 1)
    dates = F.array(
        F.struct(F.lit("add").alias("action"), added.alias("at")),
        F.struct(F.lit("remove").alias("action"), (added + F.make_interval(days=length)).alias("at")),
        F.struct(F.when(F.col("h") % 5 == 0, "add").alias("action"), (added + F.make_interval(days=length + 60)).alias("at")),
    )
    return chosen.select("pattern", "category", F.explode(dates).alias("d")).select("pattern", "category", "d.action", "d.at")


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(page_id * 7919 % 17520 * 30 as int))")
    captures = pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched_at"))
    found = temporal_url_filter(captures, dated_entries(pages.select("url")))
    return found.select(F.col("id").alias("page_id"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "n_active", "pattern", "blocked")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents"))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(column, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ",")

    counts = [F.size(F.expr(f"filter(base, span -> span.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenate_and_cut(read_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_robust_outliers": op2_robust_outliers,
        "op3_additive_ann": op3_additive_ann,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_temporal_url_filter": op5_temporal_url_filter,
        "op6_token_counts": op6_token_counts,
        "op7_pii": op7_pii,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_source_mix": op10_source_mix,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_quality_classifier": op13_quality_classifier,
    }


#: Sentences, the runs of them that hold 120 bytes of normal form (all of a text that holds less), and every run but the earliest of its text.
OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?s).+?(?:[.!?][ \t]|[。！？]|\n|\z)')) AS piece,
         generate_subscripts(regexp_extract_all(text, '(?s).+?(?:[.!?][ \t]|[。！？]|\n|\z)'), 1) AS number
  FROM documents
), placed AS (
  SELECT doc_id, number, length(piece) AS len, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY number) AS stop,
         trim(regexp_replace(lower(piece), '[^\pL\pN]+', ' ', 'g')) AS norm
  FROM split
), used AS (
  SELECT doc_id, stop - len AS start, stop, norm, row_number() OVER own AS unit,
         sum(strlen(norm)) OVER own AS upto, sum(strlen(norm)) OVER own - strlen(norm) + 120 AS wanted
  FROM placed WHERE norm <> '' WINDOW own AS (PARTITION BY doc_id ORDER BY number)
), ends AS (
  SELECT a.doc_id, a.unit, a.start, b.unit AS last, b.stop
  FROM used a ASOF JOIN used b ON a.doc_id = b.doc_id AND a.wanted <= b.upto
), parts AS (
  SELECT doc_id, unit, start, stop, unnest(range(unit, last + 1)) AS part FROM ends
), runs AS (
  SELECT p.doc_id, p.unit, p.start, p.stop, string_agg(u.norm, ' ' ORDER BY p.part) AS norm
  FROM parts p JOIN used u ON p.doc_id = u.doc_id AND p.part = u.unit GROUP BY ALL
  UNION ALL SELECT doc_id, 1, min(start), max(stop), string_agg(norm, ' ' ORDER BY unit) FROM used GROUP BY doc_id HAVING sum(strlen(norm)) < 120
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) AS rank FROM runs
), gone AS (
  SELECT doc_id, start, stop, start > max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap
  FROM ranked WHERE rank > 1
), numbered AS (
  SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM gone
), merged AS (
  SELECT doc_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM numbered GROUP BY doc_id, run
), totals AS (
  SELECT doc_id, sum(n) AS n_removed, sum(stop - start) AS removed_chars, string_agg(start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start) AS spans
  FROM merged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN totals USING (doc_id)
"""

#: The same dated list, and for each page the patterns that cover it joined by interval.
OP5_SQL = r"""
WITH captures AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919 % 17520 * 30)::INT) AS fetched_at,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), names AS (
  SELECT 'host' AS category, host AS pattern FROM captures
  UNION SELECT 'folder', host || '/' || split_part(path, '/', 2) || '/' FROM captures WHERE len(string_split(path, '/')) > 2
  UNION SELECT 'domain', regexp_extract(host, '[^.]+\.[^.]+$') FROM captures
), hashed AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 4))::INT AS h FROM names WHERE pattern <> ''
), chosen AS (
  SELECT *, TIMESTAMP '2024-01-01' + to_days(h % 200) AS added,
         CASE WHEN category = 'domain' THEN h % 5 + 1 ELSE h % 97 + 1 END AS days
  FROM hashed WHERE (category = 'host' AND h % 3 = 0) OR (category = 'folder' AND h % 2 = 0) OR category = 'domain'
), intervals AS (
  SELECT pattern, category, added AS valid_from, added + to_days(days) AS valid_to FROM chosen
  UNION ALL SELECT pattern, category, added + to_days(days + 60), NULL FROM chosen WHERE h % 5 = 0
), keys AS (
  SELECT page_id, fetched_at, unnest(list_distinct(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda k: array_to_string(string_split(host, '.')[k:], '.'))
    || CASE WHEN path = '' THEN [] ELSE list_transform(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1), lambda k: host || array_to_string(string_split(path, '/')[:k], '/') || '/') || [host || path] END)) AS pattern
  FROM captures WHERE host <> ''
), matches AS (
  SELECT k.page_id, count(*) AS n, min(k.pattern) AS pattern
  FROM keys k JOIN intervals i ON k.pattern = i.pattern AND i.valid_from <= k.fetched_at AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to)
  GROUP BY k.page_id
)
SELECT c.page_id, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(n, 0)::BIGINT AS n_active, pattern, coalesce(n, 0) > 0 AS blocked
FROM captures c LEFT JOIN matches USING (page_id)
"""


#: Prefixes of all rebuilt conversations as lists of digests; CRC-32 is taken bit by bit over the digits.
OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295) % 4 AS h
  FROM turns GROUP BY c
), led AS (
  SELECT convs.c, t.pos AS i, t.t, t.w FROM convs JOIN turns t ON t.c = convs.c - convs.c % 20 AND t.pos <= convs.h
), own AS (
  SELECT turns.c, 3 + turns.pos AS i, t, w FROM turns JOIN convs ON turns.c = convs.c AND turns.pos > convs.h
), listed AS (
  SELECT c, list(t ORDER BY i) AS t, list(w ORDER BY i) AS w FROM (SELECT * FROM led UNION ALL SELECT * FROM own) GROUP BY c
), whole AS (
  SELECT convs.c, coalesce(t, []) AS t, coalesce(w, []) AS w, coalesce(len(t), 0) AS size FROM convs LEFT JOIN listed ON convs.c = listed.c
), prefixes AS (
  SELECT c, size, unnest(range(size + 1)) AS d, t, w FROM whole
), members AS (
  SELECT c, size, d, t[1:d] AS prefix, t[1:d - 1] AS above, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w FROM prefixes
), nodes AS (
  SELECT d, prefix, any_value(above) AS above, min(c) AS c, count(*) AS n, any_value(w) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d) AS ends FROM members GROUP BY d, prefix
), children AS (
  SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, p.c AS parent FROM nodes
  LEFT JOIN children ON nodes.d = children.d AND nodes.prefix = children.prefix
  LEFT JOIN nodes p ON p.d = nodes.d - 1 AND p.prefix = nodes.above
), spread AS (
  SELECT unnest(range(d + 1)) AS d, prefix AS p, (n - 1) * w AS saved, (n_children = 0)::INT AS leaf FROM told
), summed AS (
  SELECT d, p[1:d] AS prefix, sum(saved) AS saved, sum(leaf) AS leaves FROM spread GROUP BY ALL
)
SELECT told.c::BIGINT AS conv_id, told.d::BIGINT AS depth, told.parent::BIGINT AS parent_conv_id, told.n::BIGINT AS n_convs, told.n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM told JOIN summed ON told.d = summed.d AND told.prefix = summed.prefix
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_temporal_url_filter": OP5_SQL, "op12_prefix_trie": OP12_SQL}
