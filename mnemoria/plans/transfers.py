"""Queries that write tables in the forms of exports, folders and sinks, and read them back through the importers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import forest
from ..operators.tables import shared_folder
from ..sources import exports, folders, pages, sinks
from ..streaming import ingest as streaming
from .curation import SQL as CURATION_SQL
from .curation import prepared
from .relations import POINTS_SQL, points, table

# Conversations in a file of an export.
BUNDLE = 128


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run alone, where all executors reach it."""
    return f"{shared_folder(spark)}/transfers/{name}-{uuid.uuid4().hex}"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each conversation numbered from 0; ``s`` picks those with some peculiarity."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null").withColumn("k", F.row_number().over(order) - 1)
    return rows.withColumn("s", F.col("conv_id") + F.col("k"))


def bundle() -> Column:
    return F.floor(F.col("conv_id") / BUNDLE)


def write_trees(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Conversations as an export of message trees, with its side files of shares and ratings."""
    rows = numbered(spark, sf_dir)
    key = F.concat_ws("-", F.lit("n"), "conv_id", (9999999 - F.col("k")).cast("string"))
    ref = F.concat_ws("-", F.lit("file"), "conv_id", "k")
    pointer = F.struct(F.concat(F.lit("file-service://"), ref).alias("asset_pointer"))
    image = F.col("s") % 4 == 1
    parts = F.when(image, F.array(F.col("text").cast("variant"), F.to_variant_object(pointer))).otherwise(F.array(F.col("text").cast("variant")))
    kind = F.when(image, "multimodal_text").when(F.col("s") % 11 == 5, "execution_output").otherwise("text")
    attachments = F.when(F.col("s") % 7 == 3, F.array(F.struct(ref.alias("id"))))
    time = F.when(F.col("s") % 5 > 0, 1704067200.0 + F.col("conv_id") * 86400 + F.floor(F.col("k") / 2) * 60)
    message = F.struct(
        F.concat_ws("-", "conv_id", "k").alias("id"), F.struct(F.col("role")).alias("author"), time.alias("create_time"),
        F.struct(kind.alias("content_type"), parts.alias("parts")).alias("content"), F.struct(attachments.alias("attachments")).alias("metadata"),
    )
    node = F.struct(key.alias("id"), message.alias("message"))
    trees = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("key"), node.alias("value")))).alias("mapping"))
    conv = trees.select("conv_id", F.col("conv_id").cast("string").alias("id"), F.concat(F.lit(" Talk "), F.col("conv_id") % 10).alias("title"), (F.col("conv_id") % 3 == 0).alias("is_starred"), "mapping")
    sinks.export_bundles(conv, f"{folder}/conversations", bundle(), F.col("conv_id"), "conversations")
    ids = rows.select("conv_id").distinct()
    shares = ids.where("conv_id % 5 = 0").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select("conv_id", "n", F.col("conv_id").cast("string").alias("conversation_id"), F.concat_ws("-", F.lit("share"), "conv_id", "n").alias("id"), (F.col("n") == 0).alias("is_anonymous"))
    sinks.export_bundles(shares, f"{folder}/shares", bundle(), F.struct("conv_id", "n"))
    rated = ids.where("conv_id % 4 > 1").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    # Of three ratings the second is the newest where conversations are even; elsewhere all have one time, and the first stays.
    at = F.when(F.col("conv_id") % 2 == 1, "2024-03-01").when(F.col("n") == 1, "2024-05-01").when(F.col("n") == 0, "2024-04-01")
    feedback = rated.select("conv_id", "n", F.col("conv_id").cast("string").alias("conversation_id"), F.element_at(F.array(F.lit("thumbs_up"), F.lit("thumbs_down"), F.lit("none")), F.col("n") + 1).alias("rating"), at.alias("update_time"))
    sinks.export_bundles(feedback, f"{folder}/feedback", bundle(), F.struct("conv_id", "n"))


def s02_chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of message trees, whole and by title and time."""
    folder = own_folder(spark, "trees")
    write_trees(spark, sf_dir, folder)
    shares, ratings = exports.load_shares(spark, f"{folder}/shares"), exports.load_feedback(spark, f"{folder}/feedback").withColumn("update_time", F.lit("")).withColumn("create_time", F.lit("")).withColumn("pos", F.lit(0))
    columns = ["conversation_id", "turn", "message_id", "speaker", F.md5("text").alias("digest"), "timestamp", F.array_join("attachments", ",").alias("refs"), "source_title", "user_starred"]
    whole = exports.chat_export(spark, f"{folder}/conversations", shares, ratings).select(F.lit("whole").alias("of"), *columns, "user_shared", "feedback_rating")
    asked = exports.chat_export(spark, f"{folder}/conversations", title_contains="TALK 3", since="2024-01-01 00:02:00").select(F.lit("asked").alias("of"), *columns, F.lit(False).alias("user_shared"), F.lit(None).cast("string").alias("feedback_rating"))
    return whole.unionByName(asked)


def a07_import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of message trees found."""
    folder = own_folder(spark, "counters")
    write_trees(spark, sf_dir, folder)
    conv = exports.conversations(spark, f"{folder}/conversations")
    return exports.import_counters(conv, exports.message_nodes(conv), exports.load_shares(spark, f"{folder}/shares"), exports.load_feedback(spark, f"{folder}/feedback"))


def s10_thread_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of threads with tools, files, a synthesis and projects, depth first along the parents."""
    folder, rows = own_folder(spark, "threads"), numbered(spark, sf_dir)
    parent = F.when(F.col("s") % 9 == 8, "gone").when(F.col("k") > 0, F.concat_ws("-", "conv_id", F.floor((F.col("k") - 1) / 2)))
    at = F.date_format(F.timestamp_seconds(1704067200 + F.col("conv_id") * 86400 + F.col("k") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    untimed, in_block = F.col("s") % 6 == 5, F.col("s") % 6 == 4
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<zeta: int, command: string>").alias("input"), F.when(in_block, at).alias("start_timestamp"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("calc").alias("name"), F.struct(F.col("k").alias("zeta"), F.concat(F.lit("run\\nline "), "conv_id").alias("command")).alias("input"), F.lit(None).cast("string").alias("start_timestamp"))
    blocks = F.when(F.col("s") % 4 == 2, F.array(said, tool)).otherwise(F.array(said))
    files = F.when(F.col("s") % 5 == 0, F.array(F.struct(F.concat(F.lit(" f"), "k", F.lit(".png")).alias("file_name"))))
    message = F.struct(
        F.concat_ws("-", "conv_id", "k").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), "text", F.when(~(untimed | in_block), at).alias("created_at"),
        parent.alias("parent_message_uuid"), blocks.alias("content"), files.alias("files"),
    )
    threads = rows.groupBy("conv_id").agg(F.collect_list(message).alias("chat_messages"))
    named = threads.select("conv_id", F.col("conv_id").cast("string").alias("uuid"), F.concat(F.lit("Thread "), "conv_id").alias("name"), F.lit("2025-01-01T00:00:00Z").alias("updated_at"), "chat_messages")
    sinks.export_bundles(named, f"{folder}/conversations.json", bundle(), F.col("conv_id"), "conversations")
    langs = table(spark, sf_dir, "documents").where("trim(lang) <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.max("source").alias("source"))
    projects = langs.select(F.col("lang").alias("uuid"), F.when(F.col("n") % 2 == 0, F.upper("lang")).alias("name"), F.lit(" ").alias("description"), F.concat(F.lit("documents: "), "n").alias("prompt_template"), F.array(F.struct(F.concat(F.col("source"), F.lit(".md")).alias("filename"))).alias("docs"))
    sinks.export_bundles(projects, f"{folder}/projects", F.lit(0), F.col("uuid"))
    entries = F.collect_list(F.struct(F.col("lang").alias("key"), F.concat(F.lit(" told of "), "lang").alias("value")))
    first = langs.agg(F.lit(0).alias("n"), F.concat(F.lit("languages: "), F.count("*")).alias("conversations_memory"), F.map_from_entries(entries).alias("project_memories"))
    second = langs.agg(F.lit(1).alias("n"), F.lit("a later row").alias("conversations_memory"), F.map_from_entries(F.slice(entries, 1, 0)).alias("project_memories"))
    sinks.export_bundles(first.unionByName(second), f"{folder}/memories.json", F.lit(0), F.col("n"))
    found = exports.thread_folder(spark, folder)
    return found.select("conversation_id", "source_title", "turn", "message_id", "parent_id", "speaker", F.md5("text").alias("digest"), "timestamp", F.array_join("tags", ",").alias("tags"), "memory_kind")


def s13_thread_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all conversations as trees with orphans and untimed ones, put in depth-first places along tours."""
    rows = numbered(spark, sf_dir)
    parent = F.when(F.col("s") % 9 == 8, "gone").when(F.col("k") > 0, F.concat_ws("-", "conv_id", F.floor((F.col("k") - 1) / 2)))
    ts = F.when(F.col("s") % 6 != 5, 1704067200 + F.col("conv_id") * 86400 + F.col("k") * 60)
    return forest.thread_places(rows.select(F.col("conv_id").cast("string").alias("conversation_id"), F.concat_ws("-", "conv_id", "k").alias("message_id"), parent.alias("parent_id"), ts.alias("ts")))


def s22_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages, as recordings of one segment a line, and as images with captions."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("rec "), "doc_id").alias("source_title"), F.coalesce("text", F.lit("")).alias("text"))
    paged = folders.pages(docs.withColumn("text", F.translate("text", "\n", "\f")))
    segments = docs.select("source_title", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("source_title", (F.col("i") * 7.0).alias("start"), (F.col("i") * 7.0 + 6).alias("stop"), "text")
    turns = folders.transcript_turns(segments)
    images = docs.select("source_title", F.col("text").cast("binary").alias("content"))
    captions = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("digest")).distinct().withColumn("caption", F.concat(F.lit("seen "), "digest"))
    told = [paged.select(F.lit("page").alias("of"), "source_title", F.col("page").alias("n"), "text"), turns.select(F.lit("turn").alias("of"), "source_title", F.col("turn").alias("n"), "text"), folders.captioned(images, captions).select(F.lit("image").alias("of"), "source_title", F.lit(0).alias("n"), "text")]
    return told[0].unionByName(told[1]).unionByName(told[2]).select("of", "source_title", "n", F.md5("text").alias("digest"))


def k08_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as lines, a map of ids, rows of an audit and a table by status, all read back and joined."""
    folder = own_folder(spark, "sinks")
    p = points(spark, sf_dir).select("memory_id", F.col("conversation_id"), F.col("memory_id").alias("message_id"), "speaker", "text", "source_type", "source_title", "project", "memory_kind", F.array("speaker", "status").alias("tags"), "status")
    sinks.export_json(p, f"{folder}/points")
    sinks.export_id_map(p.select(F.col("memory_id").alias("old_memory_id"), F.concat(F.lit("new, \""), "memory_id").alias("new_memory_id")), f"{folder}/ids")
    sinks.append_audit(p.where("status = 'approved'"), f"{folder}/audit", "approve", F.lit("2024-01-01"))
    sinks.append_audit(p.where("speaker = 'user'"), f"{folder}/audit", "correct", F.lit("2024-01-02"))
    sinks.write_cleaned(p.select("memory_id", F.col("status").alias("cleanup_status")), f"{folder}/cleaned")
    read = exports.jsonl(spark, f"{folder}/points").select(F.col("message_id").alias("memory_id"), "conversation_id", F.md5("text").alias("digest"), F.array_join("tags", ",").alias("tags"))
    ids = spark.read.option("header", True).option("escape", "\\").csv(f"{folder}/ids").select(F.col("old_memory_id").alias("memory_id"), "new_memory_id")
    audit = spark.read.parquet(f"{folder}/audit").groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "action", "at"))), ",").alias("actions"))
    return read.join(ids, "memory_id").join(spark.read.parquet(f"{folder}/cleaned"), "memory_id").join(audit, "memory_id", "left")


def k02_paged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written to a paged store, those of users once more as approved, and the last versions read back page by page."""
    pages.register(spark)
    folder = own_folder(spark, "paged")
    p = points(spark, sf_dir).where("doc_id is not null").select("memory_id", "speaker", "status", "text", "ts")
    p.write.format("paged").mode("append").option("points", 2048).save(folder)
    p.where("speaker = 'user'").withColumn("status", F.lit("approved")).write.format("paged").mode("append").option("points", 2048).save(folder)
    read = spark.read.format("paged").load(folder).withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")
    return pages.newest(read).select("memory_id", F.col("_commit").alias("version"), "speaker", "status", "digest", "ts")


def w01_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in files, taken by a stream that is stopped and started again over files it knows and files that repeat rows."""
    folder = own_folder(spark, "stream")
    rows = prepared(spark, sf_dir).select(*(part.split(" ")[0] for part in streaming.MESSAGES.split(", ")))
    half = F.col("conversation_id").cast("long") % 2
    rows.where(half == 0).write.json(f"{folder}/in")
    streaming.ingest_stream(spark, f"{folder}/in", f"{folder}/points", f"{folder}/state", size=None).awaitTermination()
    rows.write.mode("append").json(f"{folder}/in")
    streaming.ingest_stream(spark, f"{folder}/in", f"{folder}/points", f"{folder}/state", size=None).awaitTermination()
    taken = streaming.ingested(spark, f"{folder}/points", f"{folder}/state")
    return taken.select("memory_id", "speaker", "project", F.md5("text").alias("digest"), "summary", "source_quote")


QUERIES = {f.__name__: f for f in (w01_ingest_stream, k02_paged_store, s02_chat_export, a07_import_counters, s10_thread_export, s13_thread_places, s22_media, k08_sinks)}

STAMP = "strftime(make_timestamp(({})::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
NUMBERED_SQL = "numbered AS (SELECT *, conv_id + k AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL))"
TREES_SQL = rf"""{NUMBERED_SQL}, parts AS (
  SELECT *, trim(coalesce(text, ''), E' \n\t\r') AS t, 'file-' || conv_id || '-' || k AS ref, s % 4 = 1 AS image, s % 4 <> 1 AND s % 11 = 5 AS other, s % 7 = 3 AS attached,
    CASE WHEN s % 5 > 0 THEN 1704067200 + conv_id * 86400 + k // 2 * 60 END AS moment FROM numbered), nodes AS (
  SELECT *, CASE WHEN attached THEN [ref] WHEN image THEN ['file-service://' || ref] ELSE [] END AS refs FROM parts), texts AS (
  SELECT *, CASE WHEN image OR (other AND attached) THEN trim(CASE WHEN t <> '' THEN t || chr(10) ELSE '' END || 'attachment_refs: ' || array_to_string(refs, ', ')) WHEN other THEN '' WHEN attached AND t = '' THEN 'attachment_refs: ' || array_to_string(refs, ', ') ELSE t END AS body, NOT other OR attached AS supported FROM nodes)"""
RATED_SQL = "CASE WHEN conv_id % 4 = 2 THEN 'thumbs_down' WHEN conv_id % 4 = 3 THEN 'thumbs_up' END"
TREE_COLUMNS = f"conv_id::VARCHAR AS conversation_id, (row_number() OVER (PARTITION BY conv_id ORDER BY moment NULLS LAST, 'n-' || conv_id || '-' || (9999999 - k)) - 1)::INT AS turn, conv_id || '-' || k AS message_id, lower(trim(role)) AS speaker, md5(body) AS digest, coalesce({STAMP.format('moment')}, '') AS timestamp, array_to_string(refs, ',') AS refs, 'Talk ' || conv_id % 10 AS source_title, conv_id % 3 = 0 AS user_starred"
SQL = {
    "w01_ingest_stream": CURATION_SQL["g06_ingest_points"],
    "s02_chat_export": f"""WITH {TREES_SQL}
SELECT 'whole' AS of, {TREE_COLUMNS}, conv_id % 5 = 0 AS user_shared, {RATED_SQL} AS feedback_rating FROM texts WHERE supported AND body <> ''
UNION ALL SELECT 'asked', {TREE_COLUMNS}, false, NULL FROM texts WHERE supported AND body <> '' AND (conv_id % 10 = 3) AND (moment IS NULL OR moment >= 1704067320)""",
    "a07_import_counters": f"""WITH {TREES_SQL}, c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
SELECT * FROM (SELECT count(*) AS conversations, count(*) FILTER (conv_id % 3 = 0) AS starred, count(*) FILTER (conv_id % 5 = 0) AS shared, count(*) FILTER (conv_id % 4 > 1) AS rated, count(*) FILTER (conv_id % 4 = 3) AS thumbs_up, count(*) FILTER (conv_id % 4 = 2) AS thumbs_down FROM c),
  (SELECT count(*) AS messages, count(*) FILTER (image OR attached) AS with_attachments, count(*) FILTER (NOT supported) AS unsupported, count(*) FILTER (supported AND body = '') AS empty, sum(len(refs))::BIGINT AS attachments FROM texts)""",
    "s10_thread_export": rf"""WITH RECURSIVE {NUMBERED_SQL}, m AS (
  SELECT *, conv_id || '-' || k AS id, s % 9 = 8 AS orphan, CASE WHEN s % 6 = 5 THEN 1 ELSE 0 END AS untimed, {STAMP.format('1704067200 + conv_id * 86400 + k * 60')} AS moment,
    list_distinct(list_filter([trim(coalesce(text, ''), E' \n\t\r')] || CASE WHEN s % 4 = 2 THEN ['tool_use', 'tool_name: calc', 'tool_message:', 'tool_display:', 'run' || chr(10) || 'line ' || conv_id, k::VARCHAR] ELSE [] END || CASE WHEN s % 5 = 0 THEN ['file: f' || k || '.png'] ELSE [] END, lambda x: x <> '')) AS said FROM numbered), walk AS (
  SELECT conv_id, k, [untimed * 1000000 + k] AS path FROM m WHERE k = 0 AND NOT orphan
  UNION ALL SELECT m.conv_id, m.k, w.path || [m.untimed * 1000000 + m.k] FROM walk w JOIN m ON m.conv_id = w.conv_id AND m.k > 0 AND (m.k - 1) // 2 = w.k AND NOT m.orphan), placed AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.conv_id ORDER BY path IS NULL, path, untimed, CASE WHEN untimed = 0 THEN m.k END, id) - 1 AS place FROM m LEFT JOIN walk w ON w.conv_id = m.conv_id AND w.k = m.k), langs AS (
  SELECT lang, count(*) AS n, max(source) AS source FROM documents WHERE trim(lang) <> '' GROUP BY lang), segments AS (
  SELECT conv_id, k, array_to_string(list_filter([trim(coalesce(text, ''), E' \n\t\r'), CASE WHEN s % 4 = 2 THEN 'tool_use' || chr(10) || chr(10) || 'tool_name: calc' || chr(10) || chr(10) || 'tool_message:' || chr(10) || chr(10) || 'tool_display:' || chr(10) || chr(10) || 'run' || chr(10) || 'line ' || conv_id || chr(10) || chr(10) || k END, CASE WHEN s % 5 = 0 THEN 'file: f' || k || '.png' END], lambda x: x <> ''), chr(10) || chr(10)) AS body FROM numbered)
SELECT conv_id::VARCHAR AS conversation_id, 'Thread ' || conv_id AS source_title, place::INT AS turn, id AS message_id, CASE WHEN orphan THEN 'gone' WHEN k > 0 THEN conv_id || '-' || (k - 1) // 2 END AS parent_id, role AS speaker, md5(body) AS digest, CASE WHEN untimed = 1 THEN '2025-01-01T00:00:00Z' ELSE moment END AS timestamp, CASE WHEN s % 4 = 2 THEN 'content_block:tool_use' ELSE '' END AS tags, NULL AS memory_kind FROM placed JOIN segments USING (conv_id, k) WHERE body <> ''
UNION ALL SELECT lang, coalesce(CASE WHEN n % 2 = 0 THEN upper(lang) END, lang), NULL, NULL, NULL, 'assistant', md5(CASE WHEN n % 2 = 0 THEN upper(lang) || chr(10) || chr(10) ELSE '' END || 'documents: ' || n || coalesce(chr(10) || chr(10) || 'project_docs: ' || trim(source) || '.md', '')), NULL, NULL, 'project_config' FROM langs
UNION ALL SELECT lang, 'Claude Project Memory: ' || CASE WHEN n % 2 = 0 THEN upper(lang) ELSE lang END, NULL, NULL, NULL, 'assistant', md5('told of ' || lang), NULL, NULL, 'ai_generated_synthesis' FROM langs
UNION ALL SELECT 'claude_conversations_memory', 'Claude Conversations Memory', NULL, NULL, NULL, 'assistant', md5('languages: ' || count(*)), NULL, NULL, 'ai_generated_synthesis' FROM langs""",
    "s13_thread_places": f"""WITH RECURSIVE {NUMBERED_SQL}, m AS (
  SELECT *, conv_id || '-' || k AS id, s % 9 = 8 AS orphan, CASE WHEN s % 6 = 5 THEN 1 ELSE 0 END AS untimed FROM numbered), walk AS (
  SELECT conv_id, k, [untimed * 1000000 + k] AS path FROM m WHERE k = 0 AND NOT orphan
  UNION ALL SELECT m.conv_id, m.k, w.path || [m.untimed * 1000000 + m.k] FROM walk w JOIN m ON m.conv_id = w.conv_id AND m.k > 0 AND (m.k - 1) // 2 = w.k AND NOT m.orphan)
SELECT m.conv_id::VARCHAR AS conversation_id, m.id AS message_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY path IS NULL, path, untimed, CASE WHEN untimed = 0 THEN m.k END, id) - 1 AS turn FROM m LEFT JOIN walk w ON w.conv_id = m.conv_id AND w.k = m.k""",
    "s22_media": r"""WITH RECURSIVE d AS (SELECT doc_id, 'rec ' || doc_id AS source_title, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), pages AS (
  SELECT source_title, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS n FROM (SELECT source_title, CASE WHEN length(trim(replace(text, chr(10), chr(12)))) >= 100 THEN string_split(text, chr(10)) ELSE ['[no text in ' || source_title || ']'] END AS p FROM d)), lines AS (
  SELECT doc_id, source_title, i, t, strlen(t) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, source_title, trim(unnest(l)) AS t, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, source_title, string_split(text, chr(10)) AS l FROM d)) WHERE t <> ''), walk AS (
  SELECT doc_id, r, 0 AS turn, size AS filled FROM lines WHERE r = 1
  UNION ALL SELECT w.doc_id, l.r, w.turn + (w.filled + l.size + 1 >= 700)::INT, CASE WHEN w.filled + l.size + 1 >= 700 THEN l.size ELSE w.filled + l.size + 1 END FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.r = w.r + 1), turns AS (
  SELECT source_title, turn, min(i) * 7 AS a, max(i) * 7 + 6 AS z, string_agg(t, ' ' ORDER BY i) AS body FROM lines JOIN walk USING (doc_id, r) GROUP BY ALL), captions AS (SELECT DISTINCT sha256(text) AS digest FROM d WHERE doc_id % 2 = 0)
SELECT 'page' AS of, source_title, n::INT AS n, md5(text) AS digest FROM pages WHERE trim(text) <> ''
UNION ALL SELECT 'turn', source_title, turn, md5('[' || source_title || ' - ' || clock(a) || ' to ' || clock(z) || ']' || chr(10) || chr(10) || body) FROM turns
UNION ALL SELECT 'image', source_title, 0, md5(CASE WHEN digest IS NULL THEN '[image: ' || source_title || ']' ELSE 'seen ' || digest END) FROM d LEFT JOIN captions ON digest = sha256(text)""",
    "k02_paged_store": f"""WITH {POINTS_SQL}
SELECT memory_id, CASE WHEN speaker = 'user' THEN 2 ELSE 1 END AS version, speaker, CASE WHEN speaker = 'user' THEN 'approved' ELSE status END AS status, md5(text) AS digest, ts FROM points WHERE doc_id IS NOT NULL""",
    "k08_sinks": f"""WITH {POINTS_SQL}
SELECT memory_id, conversation_id, md5(text) AS digest, speaker || ',' || status AS tags, 'new, "' || memory_id AS new_memory_id, status AS cleanup_status,
  nullif(CASE WHEN status = 'approved' THEN 'approve 2024-01-01' ELSE '' END || CASE WHEN status = 'approved' AND speaker = 'user' THEN ',' ELSE '' END || CASE WHEN speaker = 'user' THEN 'correct 2024-01-02' ELSE '' END, '') AS actions FROM points""",
}
for _side in "az":
    _clock = f"CASE WHEN {_side} >= 3600 THEN lpad(({_side} // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad(({_side} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({_side} % 60)::VARCHAR, 2, '0')"
    SQL["s22_media"] = SQL["s22_media"].replace(f"clock({_side})", f"({_clock})")
