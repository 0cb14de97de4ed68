"""Exports, folders, sinks and streams on small files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mnemoria.sources import exports, folders, sinks
from mnemoria.streaming import ingest as streaming


def node(key, role, text, time):
    return {"id": key, "message": {"id": f"m{key}", "author": {"role": role}, "create_time": time, "content": {"content_type": "text", "parts": [text, {"unknown": 1}]}}}


def test_chat_export(spark, tmp_path):
    conv = {"id": "c1", "title": "Trees", "is_starred": True, "mapping": {"x": node("x", "user", " hi ", 2.0), "y": node("y", "assistant", "first", 1.0), "z": {"id": "z"}}}
    (tmp_path / "a.json").write_text(json.dumps([conv, {"id": "no mapping"}]))
    (tmp_path / "b.JSON").write_text(json.dumps({"conversations": [conv | {"id": "c2"}]}))
    (tmp_path / "c.json").write_text(json.dumps(conv | {"id": "c3", "title": "Other"}))
    feedback = spark.createDataFrame([("c1", "up", "5", None, 0), ("c1", "down", "5", None, 1), ("c1", "old", "1", None, 2)], "conversation_id string, rating string, update_time string, create_time string, pos int")
    rows = exports.chat_export(spark, str(tmp_path), feedback=feedback, shares=spark.createDataFrame([("c2",)], "conversation_id string")).orderBy("conversation_id", "turn").collect()
    assert [(r["conversation_id"], r["turn"], r["speaker"], r["text"]) for r in rows[:3]] == [("c1", 0, "assistant", "first"), ("c1", 1, "user", "hi"), ("c2", 0, "assistant", "first")]
    assert rows[0]["feedback_rating"] == "up" and rows[2]["user_shared"] and rows[0]["user_starred"] and rows[0]["timestamp"] == "1970-01-01T00:00:01Z"
    assert exports.chat_export(spark, str(tmp_path), title_contains="OTHER", since="1970-01-01 00:00:02").count() == 1


def test_kept_messages(spark, tmp_path):
    """Text that begins with a brace stays; a message with an attachment and no text stays; forms of one reference count once."""
    nodes = {
        "n1": {"id": "n1", "message": {"id": "m1", "author": {"role": "user"}, "content": {"content_type": "text", "parts": ['{"pasted": 1}', "and [more]"]}}},
        "n2": {"id": "n2", "message": {"id": "m2", "author": {"role": "user"}, "content": {"content_type": "text", "parts": [""]}, "metadata": {"attachments": [{"id": "file_abc", "name": "Pasted.md", "mime_type": "text/markdown"}]}}},
        "n3": {"id": "n3", "message": {"id": "m3", "author": {"role": "user"}, "content": {"content_type": "multimodal_text", "parts": [{"asset_pointer": "file-service://file-1", "content_type": "image_asset_pointer", "id": "file-1"}, "look"]}}},
        "n4": {"id": "n4", "message": {"id": "m4", "author": {"role": "tool"}, "content": {"content_type": "execution_output", "text": "x"}}},
        "n5": {"id": "n5", "message": {"id": "m5", "author": {"role": "user"}, "content": {"content_type": "text", "parts": [" "]}}},
    }
    (tmp_path / "conversations.json").write_text(json.dumps([{"title": "no id", "mapping": nodes, "is_starred": True}, {"id": "c2", "title": "second", "mapping": {}}, {"id": "c3", "title": "third", "mapping": {"x": nodes["n1"]}}]))
    (tmp_path / "names.json").write_text(json.dumps({"file-1.dat": "photo.png", "": "x"}))
    (tmp_path / "library.json").write_text(json.dumps([{"file_id": "file_abc", "file_extension": "md", "mime_type": "text/markdown"}, {"file_id": ""}]))
    (tmp_path / "shares.json").write_text(json.dumps([{"conversation_id": "c3", "id": "s1", "is_anonymous": True}, {"conversation_id": "c3", "id": "s2", "is_anonymous": False}]))
    (tmp_path / "feedback.json").write_text(json.dumps([{"conversation_id": "c3", "rating": "thumbs_up", "update_time": "2024-01-01"}, {"conversation_id": "c3", "rating": "thumbs_down", "update_time": "2024-02-01"}]))
    rows = {r["message_id"]: r for r in exports.chat_export(spark, str(tmp_path / "conversations.json"), conversation_id="conversation_1").collect()}
    assert {key: r["text"] for key, r in rows.items()} == {"m1": '{"pasted": 1}\nand [more]', "m2": "attachment_refs: file_abc", "m3": "look\nattachment_refs: file-service://file-1"}
    assert [r["attachments"] for _, r in sorted(rows.items())] == [[], ["file_abc"], ["file-service://file-1"]]
    assert sorted({r["conversation_id"] for r in exports.chat_export(spark, str(tmp_path / "conversations.json"), limit=2).collect()}) == ["conversation_1"]
    conv = exports.conversations(spark, str(tmp_path / "conversations.json"))
    shares = exports.load_shares(spark, str(tmp_path / "shares.json"))
    counted = exports.import_counters(conv, exports.message_nodes(conv), shares, exports.load_feedback(spark, str(tmp_path / "feedback.json"))).first()
    assert counted.asDict() == {"conversations": 3, "starred": 1, "shared": 1, "rated": 1, "thumbs_up": 0, "thumbs_down": 1, "messages": 6, "with_attachments": 2, "unsupported": 1, "empty": 1, "attachments": 2}
    assert shares.first()["share_id"] == "s2" and exports.load_shares(spark, str(tmp_path / "none.json")).collect() == []
    refs = exports.message_nodes(conv).select("message_id", F.posexplode("attachments").alias("pos", "ref"))
    found = {r["message_id"]: tuple(r)[1:] for r in exports.resolved_attachments(refs, exports.load_assets(spark, str(tmp_path / "names.json")), exports.load_library(spark, str(tmp_path / "library.json"))).collect()}
    assert found == {"m2": ("file_abc", "file_abc.md", "text/markdown", "library_files"), "m3": ("file-1", "photo.png", "image/png", "asset_file_names")}


def test_tools_in_threads(spark, tmp_path):
    """Payloads of tools are read, written-out line breaks decoded, thoughts left out; syntheses and projects join in."""
    blocks = [{"type": "text", "text": "plain text block"}, {"type": "thinking", "thinking": "hidden"}, {"type": "tool_use", "name": "artifacts", "input": {"new_str": "line1\\nline2", "zeta": 5, "command": "run"}}, {"type": "tool_result", "name": "artifacts", "content": [{"type": "text", "text": "OK\\nDone"}]}]
    message = {"uuid": "m", "sender": "assistant", "text": "baseline", "content": blocks, "attachments": [{"file_name": "a.txt", "extracted_content": ""}], "files": [{"file_name": "b.png"}]}
    (tmp_path / "projects").mkdir()
    (tmp_path / "conversations.json").write_text(json.dumps([{"uuid": "c", "name": "Tool Test", "created_at": "2026-01-01T00:00:00Z", "chat_messages": [message]}]))
    (tmp_path / "memories.json").write_text(json.dumps([{"conversations_memory": "a synthesis", "project_memories": {"p2": "of two", "p1": "of one"}}, {"conversations_memory": "a later row"}]))
    (tmp_path / "projects" / "p1.json").write_text(json.dumps({"uuid": "p1", "name": "One", "description": " ", "prompt_template": "be brief", "docs": [{"filename": "x.md"}, {"filename": "y.md"}]}))
    rows = exports.thread_folder(spark, str(tmp_path)).collect()
    (talk,) = [r for r in rows if r["memory_kind"] is None]
    assert talk["text"].split("\n\n") == ["baseline", "plain text block", "tool_use", "tool_name: artifacts", "tool_message:", "tool_display:", "line1\nline2", "run", "5", "tool_result", "OK\nDone", "text", "attachment: a.txt", "file: b.png"]
    assert talk["tags"] == ["content_block:tool_result", "content_block:tool_use"]
    assert sorted((r["conversation_id"], r["source_title"], r["text"]) for r in rows if r["memory_kind"]) == [("claude_conversations_memory", "Claude Conversations Memory", "a synthesis"), ("p1", "Claude Project Memory: One", "of one"), ("p1", "One", "One\n\nbe brief\n\nproject_docs: x.md, y.md"), ("p2", "Claude Project Memory: p2", "of two")]
    assert exports.thread_folder(spark, str(tmp_path / "projects" / "..")).count() == 5


def test_threads(spark, tmp_path):
    def m(key, parent, time, sender="human"):
        return {"uuid": key, "parent_message_uuid": parent, "created_at": time, "sender": sender, "text": key}

    messages = [m("b", "a", "3"), m("a", "", "1"), m("c", "a", "2", "assistant"), m("o", "gone", "0"), m("d", "c", "9"), m("p", "q", "5"), m("q", "p", "6")]
    assert [messages[k]["uuid"] for k in exports.thread_order(messages)] == ["a", "c", "d", "b", "o", "p", "q"]
    (tmp_path / "conversations.json").write_text(json.dumps([{"uuid": "t", "name": "n", "chat_messages": messages}]))
    rows = exports.thread_export(spark, str(tmp_path)).orderBy("turn").collect()
    assert [r["text"] for r in rows] == ["a", "c", "d", "b", "o", "p", "q"] and rows[0]["speaker"] == "user"


def test_jsonl(spark, tmp_path):
    good = '{"conversation_id": "c", "text": "t"}'
    (tmp_path / "good.jsonl").write_text(f"{good}\n\n{good}\n")
    (tmp_path / "bad.jsonl").write_text(f"{good}\n{{broken\n")
    assert exports.jsonl(spark, str(tmp_path / "good.jsonl")).count() == 2
    with pytest.raises(Exception):
        exports.jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_folders(spark, tmp_path):
    (tmp_path / "my_note.md").write_text("body of the note")
    (tmp_path / ".hidden.md").write_text("no")
    assert [(r["source_title"], r["text"]) for r in folders.text_files(spark, str(tmp_path)).collect()] == [("my_note.md", "[my note]\n\nbody of the note")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {w}><w:body>{p('before')}{p('Title', 'Heading1')}{p('one')}{p('two')}{p('Chapter 2')}{p('three')}</w:body></w:document>")
        archive.writestr("../evil.txt", "x")
    (tmp_path / "doc.docx").write_bytes(buffer.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    rows = folders.docx_files(spark, str(tmp_path)).orderBy("file", "section").collect()
    assert [r["text"] for r in rows if r["error"] is None] == ["before", "Title\n\none\ntwo", "Chapter 2\n\nthree"] and sum(r["error"] is not None for r in rows) == 1
    (tmp_path / "archive.zip").write_bytes(buffer.getvalue())
    assert [r["name"] for r in folders.zip_entries(spark, str(tmp_path)).collect()] == ["word/document.xml"]


def test_folder_of_many_kinds(spark, tmp_path):
    for name, body in (("b.txt", "note b"), ("a.md", "note a"), ("c.png", "x"), ("d.csv", "1,2"), (".e.txt", "no"), ("f.docx", "no zip"), ("empty.txt", " ")):
        (tmp_path / name).write_text(body)
    rows, counters = folders.folder_messages(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("a.md", 0, "Text Note", "[a]\n\nnote a"), ("b.txt", 0, "Text Note", "[b]\n\nnote b")]
    assert counters.first().asDict() == {"files": 5, "taken": 3, "skipped": 1}
    assert [r["file"] for r in folders.listed_files(spark, str(tmp_path), 2).collect()] == ["a.md", "b.txt"]


def test_embedding(spark):
    import pandas as pd

    from mnemoria.operators.ingest import embedded

    def lengths(batches):
        for texts in batches:
            yield pd.Series([[float(len(text))] * (3 if text != "odd" else 2) for text in texts])

    points = spark.createDataFrame([("a", "xy"), ("b", "odd")], "memory_id string, text string")
    assert embedded(points.where("memory_id = 'a'"), lengths, 3).first()["embedding"] == [2.0, 2.0, 2.0]
    with pytest.raises(Exception):
        embedded(points, lengths, 3).collect()


def test_pages_and_turns(spark):
    texts = spark.createDataFrame([("a", "x" * 60 + "\f" + "y" * 60), ("b", "short")], "source_title string, text string")
    assert [r["text"][:3] for r in folders.pages(texts).orderBy("source_title", "page").collect()] == ["xxx", "yyy", "[no"]
    segments = spark.createDataFrame([("t", 0.0, 5.0, "a" * 300), ("t", 5.0, 9.0, "b" * 300), ("t", 9.0, 70.0, "c" * 300), ("t", 70.0, 71.0, " ")], "source_title string, start double, stop double, text string")
    rows = folders.transcript_turns(segments).orderBy("turn").collect()
    assert [r["text"][:19] for r in rows] == ["[t - 00:00 to 00:09", "[t - 00:09 to 01:10"]


def test_sinks(spark, tmp_path):
    points = spark.range(300).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("memory_id")).coalesce(1)
    assert sorted(r["count"] for r in sinks.batches(points, F.lit(10)).groupBy("batch").count().collect()) == [44, 128, 128]
    sized = sinks.batches(points.limit(5).coalesce(1), F.lit(20), most_bytes=50).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sized) == [1, 2, 2]
    with pytest.raises(Exception):
        sinks.batches(points, F.lit(51), most_bytes=50).collect()
    reflected = sinks.reflected_points(points.limit(2), spark.createDataFrame([("0001", "p", "deep", 0.5)], "memory_id string, phase string, depth string, confidence double"))
    assert sorted((r["memory_id"], r["reflected"], r["reflection_depth"]) for r in reflected.collect()) == [("0000", None, None), ("0001", True, "deep")]
    sinks.export_json(points, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 300


def test_streams(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / name) for name in ("in", "points", "journal"))
    rows = [("c", f"m{k}", k, "user" if k % 2 else "system", f"text {k}", "x", "p") for k in range(10)]
    spark.createDataFrame(rows, streaming.MESSAGES).coalesce(1).write.json(source)
    for _ in range(2):
        streaming.ingest_stream(spark, source, table, checkpoint).awaitTermination(120)
    assert spark.read.parquet(table).count() == 5
    spark.createDataFrame(rows[3:] + [("c", "new", 10, "user", "new text", "x", "p")], streaming.MESSAGES).coalesce(1).write.mode("append").json(source)
    streaming.ingest_stream(spark, source, table, checkpoint).awaitTermination(120)
    assert spark.read.parquet(table).count() == 6


def test_thread_times():
    """A message's time is its own, else that of its blocks, else that of the conversation; what no root reaches is ordered by time alone."""
    m = lambda key, parent="", made=None, blocks=(): {"uuid": key, "parent_message_uuid": parent, "created_at": made, "updated_at": None, "content": list(blocks)}
    block = {"start_timestamp": "soon", "stop_timestamp": "2024-01-02T00:00:00+01:00"}
    thread = {"updated_at": "2025-01-01T00:00:00Z", "created_at": "2024-01-01T00:00:00Z"}
    assert exports.stated_time(m("a", made=" 2024-01-01T00:00:00Z "), thread) == "2024-01-01T00:00:00Z"
    assert exports.stated_time(m("a", made="2024-01-01", blocks=[{}, block]), thread) == "2024-01-02T00:00:00+01:00"
    assert exports.stated_time(m("a", blocks=[None]), thread) == "2025-01-01T00:00:00Z"
    root = exports.ROOT
    messages = [m("late", root, "2024-01-03"), m("zone", root, blocks=[block]), m("early", root, "2024-01-01T23:30:00Z"), m("lost", "gone", "5"), m("child", "lost", "9"), m("other", "far", "7"), m("never", root), m("", root, "1"), m("late", root, "1700000000")]
    order = [messages[k]["uuid"] for k in exports.thread_order(messages)]
    assert order == ["late", "zone", "early", "never", "lost", "other", "child"]


def test_bundles(spark, tmp_path):
    rows = spark.range(10).select("id", F.create_map(F.lit("k"), "id").alias("m"))
    sinks.export_bundles(rows, str(tmp_path / "arrays"), F.col("id") % 3, -F.col("id"))
    sinks.export_bundles(rows, str(tmp_path / "wrapped"), F.col("id") % 3, F.col("id"), "items")
    arrays = sorted(json.loads(file.read_text())[0]["id"] for file in (tmp_path / "arrays").glob("part*"))
    wrapped = sorted([r["m"]["k"] for r in json.loads(file.read_text())["items"]] for file in (tmp_path / "wrapped").glob("part*"))
    assert arrays == [7, 8, 9] and wrapped == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]


def test_long_recordings(spark):
    """Turns follow each other over many batches, and each recording begins anew."""
    segments = spark.range(30000).selectExpr("concat('r', id % 2) AS source_title", "cast(id AS double) AS start", "cast(id + 1 AS double) AS stop", "repeat('x', cast(id % 40 AS int)) AS text")
    got = {(r["source_title"], r["turn"]): r["text"].split("\n\n")[1] for r in folders.transcript_turns(segments).collect()}
    for name, odd in (("r0", 0), ("r1", 1)):
        turns: list[list[str]] = []
        for text in ("x" * (i % 40) for i in range(odd, 30000, 2)):
            if text and (not turns or len(" ".join(turns[-1])) + len(text) + 1 >= 700):
                turns.append([text])
            elif text:
                turns[-1].append(text)
        assert [got[name, k] for k in range(len(turns))] == [" ".join(t) for t in turns]
