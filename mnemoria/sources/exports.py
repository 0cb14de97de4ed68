"""Chat exports and message files to flat rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import attachment_ref, mime_type, present, trimmed
from ..functions.times import flexible, written

MESSAGE = "conversation_id string, message_id string, timestamp string, speaker string, text string, source_type string, source_title string, project string, memory_kind string, tags array<string>"
ASSETS = "asset_pointer: variant, attachments: variant, assets: variant"
NODE = f"struct<id: string, parent: string, {ASSETS}, message: struct<id: string, author: struct<role: string>, create_time: double, update_time: double, {ASSETS}, content: struct<content_type: string, parts: array<variant>>, metadata: struct<model_slug: string, {ASSETS}>>>"
CONVERSATION = f"struct<id: string, conversation_id: string, title: string, create_time: double, update_time: double, is_starred: boolean, mapping: map<string, {NODE}>>"
# A string field takes whatever is there, nested values as their JSON.
BLOCK = "struct<type: string, text: string, title: string, name: string, message: string, display_content: string, input: string, content: string, structured_content: string, start_timestamp: string, stop_timestamp: string>"
CLAUDE = f"struct<uuid: string, name: string, created_at: string, updated_at: string, chat_messages: array<struct<uuid: string, sender: string, text: string, created_at: string, updated_at: string, parent_message_uuid: string, content: array<{BLOCK}>, attachments: array<struct<extracted_content: string, file_name: string>>, files: array<struct<file_name: string>>>>>"
# Keys of a tool's payload that come first.
PAYLOAD_KEYS = ("text", "content", "new_str", "old_str", "command", "title", "name", "id", "language", "type")
# Fixed value: the parent of messages that have none.
ROOT = "00000000-0000-4000-8000-000000000000"
RFC = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
DAY = re.compile(r"\d{4}-\d\d-\d\d$")
# Keys under which attachments are found.
REF_KEYS = ("asset_pointer", "asset", "file_id", "id", "attachments", "assets")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; a malformed line fails the whole read."""
    return spark.read.schema(MESSAGE).option("mode", "FAILFAST").json(path)


def json_items(spark: SparkSession, path: str, item: str, wrapper: str = "conversations") -> DataFrame:
    """``(file, place, item)`` of files that hold an array, ``{wrapper: array}`` or a single object.

    Arrays are read item by item, so a large export is never one value; ``place`` counts the items of a file from 0.
    """
    kind = spark.createDataFrame([], f"item {item}").schema["item"].dataType
    schema = StructType([*kind.fields, StructField(wrapper, ArrayType(kind))])
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").json(path)
    own = F.struct(*(F.col(f.name) for f in kind.fields))
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.when(F.col(wrapper).isNotNull(), F.col(wrapper)).otherwise(F.array(own))).alias("at", "item"))
    # A file is read by one task, so its rows are numbered without a gap.
    firsts = read.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).groupBy("file").agg(F.min("row").alias("first"))
    return rows.join(firsts, "file").select("file", (F.col("row") - F.col("first") + F.col("at")).cast("int").alias("place"), "item").where("item is not null")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side file of an export; an empty table where there is none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_shares(spark: SparkSession, path: str) -> DataFrame:
    """Shared conversations; the last row of a conversation counts."""
    rows = optional_json(spark, path, "conversation_id string, id string, is_anonymous boolean").withColumn("pos", F.monotonically_increasing_id())
    return rows.where("trim(conversation_id) <> ''").groupBy("conversation_id").agg(F.max_by("id", "pos").alias("share_id"), F.max_by("is_anonymous", "pos").alias("is_anonymous"))


def load_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The latest rating of each conversation."""
    return latest_feedback(optional_json(spark, path, "conversation_id string, rating string, create_time string, update_time string, content string").withColumn("pos", F.monotonically_increasing_id()))


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """``(ref, file)`` of a map from stored names to names, with and without their endings."""
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], "ref string, file string")
    pairs = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("stored", "file")).where("trim(stored) <> '' and trim(file) <> ''")
    bare = F.regexp_replace(F.trim("stored"), r"\.[^./]*$", "")
    return pairs.select(F.explode(F.array_distinct(F.array(F.trim("stored"), bare))).alias("ref"), F.trim("file").alias("file"))


def load_library(spark: SparkSession, path: str) -> DataFrame:
    """``(ref, file, mime_type)`` of the library's files."""
    rows = optional_json(spark, path, "file_id string, file_name string, file_extension string, mime_type string, library_file_category string").where("trim(file_id) <> ''")
    return rows.select(F.trim("file_id").alias("ref"), F.coalesce(present(F.col("file_name")), F.concat_ws(".", F.trim("file_id"), present(F.col("file_extension")))).alias("file"), F.coalesce("mime_type", F.lit("")).alias("mime_type"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The newest rating of each conversation; equal times keep the first, undated ones the last."""
    ts = F.coalesce(flexible(F.col("update_time")), flexible(F.col("create_time")))
    order = [F.desc_nulls_last("ts"), F.when(F.col("ts").isNull(), -F.col("pos")).otherwise(F.col("pos"))]
    ranked = feedback.withColumn("ts", ts).withColumn("n", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*order)))
    return ranked.where("n = 1").select("conversation_id", "rating")


def collected_refs(value: object, found: dict[str, str] | None = None) -> dict[str, str]:
    """References to attachments in nested values, one for each form without its scheme."""
    found = {} if found is None else found
    if isinstance(value, str) and value.strip():
        ref = value.strip()
        found.setdefault(ref.partition("://")[2] or ref, ref)
    elif isinstance(value, list):
        for item in value:
            collected_refs(item, found)
    elif isinstance(value, dict):
        for key in REF_KEYS:
            collected_refs(value.get(key), found)
    return found


@F.pandas_udf(ArrayType(StringType()))
def attachment_refs(places: pd.Series) -> pd.Series:
    """The sorted references of each JSON array of places; only messages with attachments have one."""
    return places.map(lambda text: sorted(collected_refs(json.loads(text)).values()) if text else [])


def conversations(spark: SparkSession, path: str, title_contains: str | None = None, conversation_id: str | None = None, limit: int = 0) -> DataFrame:
    """The conversations of an export of message trees that the filters pass, the first ``limit`` in the order of the files."""
    conv = json_items(spark, path, CONVERSATION).where("item.mapping is not null")
    key = F.coalesce(present(F.col("item.id")), F.concat(F.lit("conversation_"), F.col("place") + 1))
    conv = conv.select("file", "place", key.alias("conversation_id"), F.trim(F.coalesce("item.title", F.lit(""))).alias("source_title"), F.col("item.create_time").alias("c_time"), F.coalesce("item.is_starred", F.lit(False)).alias("user_starred"), "item.mapping")
    if conversation_id:
        conv = conv.where(F.col("conversation_id") == conversation_id.strip())
    if title_contains:
        conv = conv.where(F.lower(F.concat_ws(" ", "source_title", "conversation_id")).contains(title_contains.lower()))
    if limit > 0:
        conv = conv.join(F.broadcast(conv.select("file", "place").orderBy("file", "place").limit(limit)), ["file", "place"], "left_semi")
    return conv


def message_nodes(conv: DataFrame) -> DataFrame:
    """Every message of the trees, with its text as it is stored, its attachments, and whether its kind is understood."""
    m = conv.select("*", F.explode("mapping").alias("node_id", "node")).where("node.message is not null").drop("mapping")
    own, content = F.col("node.message"), F.col("node.message.content")
    parts = F.coalesce(content["parts"], F.array().cast("array<variant>"))
    is_text = lambda p: F.schema_of_variant(p) == "STRING"
    lines = F.filter(F.transform(F.filter(parts, is_text), lambda p: trimmed(F.try_variant_get(p, "$", "string"))), lambda t: t != "")
    others = F.filter(parts, lambda p: F.schema_of_variant(p).startswith("OBJECT"))
    has_key = lambda p: reduce(Column.__or__, (F.try_variant_get(p, f"$.{key}", "variant").isNotNull() for key in ("asset_pointer", "asset", "attachments", "file_id")))
    places = [F.col(f"{at}.{key}") for at in ("node", "node.message", "node.message.metadata") for key in ("asset_pointer", "attachments", "assets")]
    kind = F.lower(trimmed(content["content_type"]))
    of_assets = kind.contains("asset") | kind.contains("image")
    attached = reduce(Column.__or__, (place.isNotNull() for place in places)) | of_assets | F.exists(others, has_key)
    # Parts are asked for fewer keys than what hangs on them.
    of_parts = F.transform(others, lambda p: F.array(*(F.try_variant_get(p, f"$.{key}", "variant") for key in ("asset_pointer", "asset", "file_id", "attachments"))))
    listed = F.when(attached, F.to_json(F.array(*(F.coalesce(place, F.parse_json(F.lit("null"))) for place in places)))), F.when(attached, F.to_json(of_parts))
    rows = m.select("*", lines.alias("lines"), kind.alias("content_type"), attached.alias("has_attachment"), F.when(attached, F.concat(F.lit("["), listed[0], F.lit(","), listed[1], F.lit("]"))).alias("places"), own["id"].alias("message_id"), F.lower(trimmed(own["author"]["role"])).alias("speaker"), F.coalesce(flexible(own["create_time"]), flexible(own["update_time"])).alias("ts"), own["metadata"]["model_slug"].alias("ai_model")).drop("node")
    rows = rows.withColumn("attachments", attachment_refs("places")).drop("places")
    stub = F.array_join(F.concat("lines", F.when(F.size("attachments") > 0, F.array(F.concat(F.lit("attachment_refs: "), F.array_join("attachments", ", ")))).otherwise(F.array().cast("array<string>"))), "\n")
    stub = F.when(stub == "", F.concat(F.lit("attachment content: "), F.col("content_type"))).otherwise(stub)
    plain = (F.col("content_type") == "text") & ((F.size("lines") > 0) | ~F.col("has_attachment"))
    text = F.when(plain, F.array_join("lines", "\n")).when(F.col("has_attachment"), F.trim(stub)).otherwise("")
    return rows.withColumn("text", text).withColumn("supported", (F.col("content_type") == "text") | F.col("has_attachment")).drop("lines")


def chat_export(spark: SparkSession, path: str, shares: DataFrame | None = None, feedback: DataFrame | None = None, since: str | None = None, title_contains: str | None = None, conversation_id: str | None = None, limit: int = 0) -> DataFrame:
    """Messages of an export of message trees in time order of each conversation."""
    rows = message_nodes(conversations(spark, path, title_contains, conversation_id, limit)).where("supported and text <> ''").drop("supported", "file", "place")
    if since:
        rows = rows.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(since).cast("timestamp")))
    if shares is not None:
        rows = rows.join(shares.select("conversation_id", F.lit(True).alias("s")).distinct(), "conversation_id", "left").withColumn("user_shared", F.coalesce("s", F.lit(False))).drop("s")
    if feedback is not None:
        rows = rows.join(latest_feedback(feedback).withColumnRenamed("rating", "feedback_rating"), "conversation_id", "left")
    order = Window.partitionBy("conversation_id").orderBy(F.asc_nulls_last("ts"), "node_id", "message_id")
    return rows.withColumn("turn", F.row_number().over(order) - 1).withColumn("timestamp", written(F.col("ts"))).withColumn("source_type", F.lit("chat_export"))


def import_counters(conv: DataFrame, nodes: DataFrame, shares: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: conversations found, starred, shared and rated; messages found, with attachments, of kinds not understood, empty."""
    ids = conv.select("conversation_id", "user_starred")
    rated = ids.join(ratings.select("conversation_id", "rating"), "conversation_id", "left").join(shares.select("conversation_id", F.lit(True).alias("shared")).distinct(), "conversation_id", "left")
    found = rated.agg(F.count("*").alias("conversations"), F.count_if("user_starred").alias("starred"), F.count_if("shared").alias("shared"), F.count("rating").alias("rated"), F.count_if(F.col("rating") == "thumbs_up").alias("thumbs_up"), F.count_if(F.col("rating") == "thumbs_down").alias("thumbs_down"))
    messages = nodes.agg(F.count("*").alias("messages"), F.count_if("has_attachment").alias("with_attachments"), F.count_if(~F.col("supported")).alias("unsupported"), F.count_if(F.col("supported") & (F.col("text") == "")).alias("empty"), F.sum(F.size("attachments")).alias("attachments"))
    return found.join(messages)


def instant(text: str | None) -> float | None:
    """Seconds of a number, an RFC 3339 time or a plain day; nothing where it is none of them."""
    text = (text or "").strip()
    try:
        return float(text)
    except ValueError:
        pass
    try:
        return datetime.fromisoformat(text if "T" in text else f"{text}T00:00:00Z").timestamp() if RFC.match(text) or DAY.match(text) else None
    except ValueError:
        return None


def message_times(message: dict) -> Iterator[str]:
    """The times a message states, in the order in which they are asked: its own, then those of its blocks."""
    yield from (message.get("created_at"), message.get("updated_at"))
    for block in message.get("content") or []:
        yield from ((block or {}).get("start_timestamp"), (block or {}).get("stop_timestamp"))


def stated_time(message: dict, thread: dict) -> str:
    """The first RFC 3339 time of a message, else of its conversation."""
    told = (*message_times(message), thread["updated_at"], thread["created_at"])
    return next((text.strip() for text in told if text and RFC.match(text.strip()) and instant(text) is not None), "")


def thread_order(messages: list[dict]) -> list[int]:
    """Places of messages depth first along their parents, siblings by time then id; what no root reaches follows by time then id.

    Untimed messages come after timed ones, messages without an id are left out, and of a repeated id one is taken.
    """

    def key(k: int) -> tuple:
        time = next((found for text in message_times(messages[k]) if (found := instant(text)) is not None), None)
        return time is None, time or 0.0, ids[k]

    ids = [(m["uuid"] or "").strip() for m in messages]
    children: dict[str, list[int]] = {}
    for k in sorted((k for k in range(len(messages)) if ids[k]), key=key):
        children.setdefault((messages[k].get("parent_message_uuid") or "").strip() or ROOT, []).append(k)
    done, seen, stack = [], set(), children.get(ROOT, [])[::-1]
    while stack:
        k = stack.pop()
        if ids[k] not in seen:
            seen.add(ids[k])
            done.append(k)
            stack += children.get(ids[k], [])[::-1]
    left = {ids[k]: k for k in range(len(messages)) if ids[k] and ids[k] not in seen}
    return done + sorted(left.values(), key=key)


def decoded(text: str | None) -> str:
    r"""A text with ``\\n``, ``\\t`` or ``\\r`` written out, decoded where that is possible."""
    text = (text or "").strip()
    if any(mark in text for mark in ("\\n", "\\t", "\\r")):
        try:
            return json.loads('"' + text.replace('"', '\\"') + '"')
        except json.JSONDecodeError:
            return text
    return text


def payload_texts(value: object) -> Iterator[str]:
    """The texts of a tool's payload: known keys first, others by name, nested JSON taken apart."""
    if isinstance(value, str):
        text = decoded(value)
        try:
            nested = json.loads(text) if text else None
        except json.JSONDecodeError:
            yield text
            return
        yield from payload_texts(nested) if not isinstance(nested, str) else (nested,)
    elif isinstance(value, list):
        for item in value:
            yield from payload_texts(item)
    elif isinstance(value, dict):
        for key in (*(key for key in PAYLOAD_KEYS if key in value), *sorted(value.keys() - set(PAYLOAD_KEYS))):
            yield from payload_texts(value[key])
    elif value is not None:
        yield str(value).lower() if isinstance(value, bool) else f"{value:g}" if isinstance(value, float) else str(value)


def block_texts(block: dict) -> Iterator[str]:
    """What a block of a message says; thoughts and budgets say nothing."""
    kind, get = (block.get("type") or "").strip().lower(), lambda key: block.get(key) or ""
    if kind == "text":
        yield get("text")
    elif kind == "voice_note":
        yield f"{get('title')}\n{get('text')}"
    elif kind == "tool_use":
        yield from (kind, "tool_name: " + get("name"), "tool_message: " + get("message"), "tool_display: " + get("display_content"))
        yield from payload_texts(block.get("input"))
    elif kind == "tool_result":
        yield from (kind, "tool_name: " + get("name"))
        yield from payload_texts(block.get("content"))
        yield from payload_texts(block.get("structured_content"))


def thread_text(message: dict) -> str:
    """The distinct segments of a message: its text, blocks, attachments and files."""
    blocks = message.get("content") or []
    segments = [message.get("text") or "", *(text for block in blocks if block for text in block_texts(block))]
    for attachment in message.get("attachments") or []:
        extracted, name = (attachment.get("extracted_content") or "").strip(), (attachment.get("file_name") or "").strip()
        segments.append(extracted or (name and f"attachment: {name}"))
    segments += [f"file: {name}" for file in message.get("files") or [] if (name := (file.get("file_name") or "").strip())]
    return "\n\n".join(dict.fromkeys(text for segment in segments if (text := decoded(segment).strip())))


def thread_tags(message: dict) -> list[str]:
    """Marks of tools and voices."""
    kinds = {(block.get("type") or "").strip().lower() for block in message.get("content") or [] if block}
    return sorted(f"content_block:{kind}" for kind in kinds & {"tool_use", "tool_result", "voice_note"})


def ordered_messages(threads: DataFrame) -> DataFrame:
    """``(conversation_id, source_title, turn, ...)``: the messages of each conversation in thread order."""
    schema = "conversation_id string, source_title string, turn int, message_id string, parent_id string, speaker string, text string, timestamp string, tags array<string>"
    names = [part.split(" ")[0] for part in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string())]

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                messages = row["chat_messages"] or []
                for turn, k in enumerate(thread_order(messages)):
                    m = messages[k]
                    when = stated_time(m, row)
                    rows.append((row["conversation_id"], row["source_title"], turn, m["uuid"], m.get("parent_message_uuid"), {"human": "user"}.get(m["sender"], m["sender"]), thread_text(m), when, thread_tags(m)))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names=names)

    return threads.select(F.col("item.uuid").alias("conversation_id"), F.coalesce("item.name", F.lit("")).alias("source_title"), F.col("item.created_at").alias("created_at"), F.col("item.updated_at").alias("updated_at"), F.col("item.chat_messages").alias("chat_messages")).mapInArrow(unroll, schema)


def thread_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an export of threads."""
    return ordered_messages(json_items(spark, path, CLAUDE)).where("text <> ''").withColumn("source_type", F.lit("chat_export"))


def thread_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations, syntheses and projects of an export of threads as one table of messages."""
    projects = load_projects(spark, f"{folder}/projects")
    named = projects.select(F.trim("uuid").alias("key"), present(F.col("name")).alias("name"))
    talk = thread_export(spark, f"{folder}/conversations.json")
    syntheses = synthesis_rows(load_syntheses(spark, f"{folder}/memories.json")).join(named, "key", "left")
    told = syntheses.select(F.when(F.col("key") == "", "claude_conversations_memory").otherwise(F.trim("key")).alias("conversation_id"), F.when(F.col("key") == "", "Claude Conversations Memory").otherwise(F.concat(F.lit("Claude Project Memory: "), F.coalesce("name", "key"))).alias("source_title"), F.lit("assistant").alias("speaker"), F.trim("text").alias("text"), F.lit("ai_generated_synthesis").alias("memory_kind"))
    configured = project_rows(projects).where("text <> ''").select("conversation_id", "source_title", F.lit("assistant").alias("speaker"), "text", F.lit("project_config").alias("memory_kind"))
    return talk.unionByName(told, allowMissingColumns=True).unionByName(configured, allowMissingColumns=True)


def branch_statistics(messages: DataFrame) -> DataFrame:
    """Parents with several children, and the widest of them."""
    fan = messages.where("parent_id is not null").groupBy("conversation_id", "parent_id").agg(F.count("*").alias("n"))
    return fan.groupBy("conversation_id").agg(F.count_if(F.col("n") > 1).alias("branches"), F.max("n").alias("widest"))


def load_projects(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each project file."""
    return optional_json(spark, folder, "uuid string, name string, description string, prompt_template string, created_at string, updated_at string, docs array<struct<filename: string>>")


def project_rows(projects: DataFrame) -> DataFrame:
    """One text for each project: name, description, prompt and document names."""
    docs = F.array_join(F.filter(F.transform("docs", lambda d: F.trim(F.coalesce(d["filename"], F.lit("")))), lambda name: name != ""), ", ")
    listed = F.when(docs != "", F.concat(F.lit("project_docs: "), docs))
    return projects.select(F.trim("uuid").alias("conversation_id"), F.coalesce(present(F.col("name")), F.trim("uuid")).alias("source_title"), F.concat_ws("\n\n", present(F.col("name")), present(F.col("description")), present(F.col("prompt_template")), listed).alias("text"))


def load_syntheses(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file of syntheses, numbered."""
    return optional_json(spark, path, "conversations_memory string, project_memories map<string, string>, account_uuid string").withColumn("pos", F.monotonically_increasing_id())


def synthesis_rows(memories: DataFrame) -> DataFrame:
    """The synthesis of the first row, and one row for each entry of its map of projects, by key."""
    entries = F.transform(F.array_sort(F.map_entries("project_memories")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
    none = F.array().cast("array<struct<key: string, text: string>>")
    first = memories.orderBy("pos").limit(1).select(F.struct(F.lit("").alias("key"), F.col("conversations_memory").alias("text")).alias("whole"), F.coalesce(entries, none).alias("parts"))
    return first.select(F.explode(F.concat(F.array("whole"), "parts")).alias("e")).select("e.key", "e.text").where("trim(text) <> ''")


def resolved_attachments(refs: DataFrame, assets: DataFrame, library: DataFrame) -> DataFrame:
    """``message_id, ref, file, mime_type, system``: the first reference of a message that a map knows, assets before library."""
    keyed = refs.withColumn("ref", attachment_ref(F.col("ref")))
    known = library.select("ref", F.col("file").alias("l"), F.col("mime_type").alias("l_type")) if "mime_type" in library.columns else library.select("ref", F.col("file").alias("l"), F.lit("").alias("l_type"))
    met = keyed.join(assets.select("ref", F.col("file").alias("a")), "ref", "left").join(known, "ref", "left").where("coalesce(a, l) is not null")
    # The names of the two maps.
    system = F.when(F.col("a").isNotNull(), "asset_file_names").otherwise("library_files")
    file = F.coalesce("a", "l")
    kind = F.when(F.col("a").isNotNull(), mime_type(file)).otherwise(F.coalesce(present(F.col("l_type")), mime_type(file)))
    first = met.groupBy("message_id").agg(F.min_by(F.struct("ref", file.alias("file"), kind.alias("mime_type"), system.alias("system")), "pos").alias("f"))
    return first.select("message_id", "f.ref", "f.file", "f.mime_type", "f.system")


def attachment_text(text: Column, system: Column, caption: Column) -> Column:
    """The caption of a resolved image, else the text with its label."""
    return F.coalesce(F.when(system.isNotNull(), present(caption)), text)


def payload_text(payload: Column, *names: str) -> Column:
    """The first non-blank field of a JSON payload."""
    return F.coalesce(*(present(F.get_json_object(payload, f"$.{name}")) for name in names), F.lit(""))
