"""Fixtures: chunks, windows, ranking, packs, ingest modes, cleanup, evidence."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemoria.functions import text as T
from mnemoria.functions import times
from mnemoria.functions.chunks import chunk_text
from mnemoria.functions.ids import point_id, uuid5
from mnemoria.operators import canon, catalog, cleanup, evidence, ingest, recall, reflection
from mnemoria.operators.predicates import SearchFilters, visible

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_chunks():
    found = chunk_text(LETTERS, 10, 2, 3)
    assert found[0] == "abcdefghij" and "ijklmnop" in found[1]
    assert chunk_text("   ") == [] and chunk_text(None) == []
    found = chunk_text("One sentence is here. Another one follows it. And the last one ends.", 40, 5, 3)
    assert all(piece.endswith(".") for piece in found[:-1]) and len(found) > 1
    assert all(chunk_text("x" * 35, 10, 2, 3))
    long = ("word " * 2000).strip()
    assert all(len(piece) <= 900 for piece in chunk_text(long)[:-1]) and all(piece.strip() for piece in chunk_text(long))
    assert chunk_text("a b c\n\nd e f g h i j k", 12, 0, 1)[0] == "a b c"


def test_turn_windows(spark):
    rows = [("c", 0, "user", "hello"), ("c", 1, "assistant", "hi"), ("c", 2, "system", "  ")]
    turns = spark.createDataFrame(rows, "conversation_id string, turn long, speaker string, text string")
    (pair,) = ingest.turn_windows(turns.where("turn < 2"), 2, 0).collect()
    assert pair["speakers"] == "USER,ASSISTANT" and pair["text"] == "USER: hello\n\nASSISTANT: hi" and pair["n_turns"] == 2
    assert sorted(row["start_turn"] for row in ingest.turn_windows(turns.withColumn("text", F.lit("t")), 2, 1).collect()) == [0, 1]
    assert ingest.turn_windows(turns.where("turn > 1"), 1, 0).collect() == []


def test_identity(spark):
    messages = spark.createDataFrame([("conv a", "msg-1", 0), ("conv-a", None, 4), ("conv-a", " ", 1233)], "conversation_id string, message_id string, record_index long")
    points = ingest.to_points(messages.select("*", F.lit("user").alias("speaker"), F.lit("text").alias("text"), F.lit("x").alias("source_type"), F.lit("").alias("project")))
    assert [row["memory_id"] for row in points.orderBy("record_index").collect()] == ["conv_a_msg_msg-1_chunk_001", "conv-a_turn_005_chunk_001", "conv-a_turn_1234_chunk_001"]
    import uuid

    assert value(spark, uuid5(F.lit("cleaned:x"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "cleaned:x"))
    assert value(spark, point_id(F.lit("6BA7B811-9DAD-11D1-80B4-00C04FD430C8"))) == "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def results(spark):
    rows = [("a", "c1", 3, "Run Docker compose now", 0.9), ("a_copy", "c1", 2, "run  docker COMPOSE now", 0.8), ("b", "c1", 1, "other words", 0.7), ("d", "c2", 1, "run docker compose now", 0.2), ("e", "", 1, "", 0.1)]
    return spark.createDataFrame(rows, "memory_id string, conversation_id string, ts long, text string, score double").withColumn("source_quote", F.lit(""))


def test_ranking(spark):
    found = recall.collapse(results(spark)).orderBy("memory_id").collect()
    assert [(row["memory_id"], row["duplicate_ids"]) for row in found] == [("a", ["a_copy"]), ("b", []), ("d", []), ("e", [])]
    assert recall.cap_per_group(results(spark), 2, recall.by_score()).count() == 4
    blank = results(spark).withColumn("source", F.when(F.col("memory_id") == "d", "s").otherwise(F.lit(" ")))
    assert sorted(row["memory_id"] for row in recall.cap_per_group(blank, 2, recall.by_score(), "source", "_unknown").collect()) == ["a", "a_copy", "d"]
    assert recall.cap_per_group(blank, 1, recall.by_score(), "source").count() == 5
    canonical = results(spark).withColumn("canonical", F.col("memory_id") == "d")
    assert [row["memory_id"] for row in recall.canonical_first(canonical, 2).collect()] == ["d", "a"]
    with pytest.raises(ValueError):
        recall.bounded(results(spark), 4)
    assert recall.floor(results(spark), 0.5).count() == 3
    scored = results(spark).withColumn("lexical_score", recall.lexical_score("docker compose (now)", "text"))
    assert {row["memory_id"]: row["lexical_score"] for row in scored.collect()} == {"a": 1.0, "a_copy": 1.0, "b": 0.0, "d": 1.0, "e": 0.0}
    assert [row["memory_id"] for row in recall.fuse(scored, 3).collect()][0] == "a"
    pack = recall.context_pack(results(spark).where("memory_id in ('a', 'b', 'd')"), 45, recall.by_score(), "text").collect()
    assert sorted(row["memory_id"] for row in pack) == ["a", "b"] and {(row["used"], row["dropped"]) for row in pack} == {(33, 1)}
    assert recall.candidate_limit(3, True) == 40 and recall.candidate_limit(100, True) == 200 and recall.candidate_limit(3, False) == 3


def test_filters(spark):
    rows = [("1", "approved", "P", ["A", "b"], True), ("2", "rejected", "p", ["a"], False), ("3", "deleted", "q", [], None), ("4", None, None, ["A", "B", "c"], None)]
    points = spark.createDataFrame(rows, "memory_id string, status string, project string, tags array<string>, pinned boolean")
    ids = lambda df: sorted(row["memory_id"] for row in df.collect())
    assert ids(visible(points)) == ["1", "4"] and ids(visible(points, include_rejected=True)) == ["1", "2", "3", "4"]
    assert ids(visible(points, SearchFilters(project="p"), True)) == ["1", "2"] and ids(visible(points, SearchFilters(project="p", exact=True), True)) == ["2"]
    assert ids(visible(points, SearchFilters(tags=("a", " B ")))) == ["1", "4"] and ids(visible(points, SearchFilters(pinned=False), True)) == ["2", "3", "4"]
    with pytest.raises(ValueError):
        catalog.delete_where(points, SearchFilters().predicate())


def test_ingest_modes(spark):
    stored = spark.createDataFrame([("c1_turn_001_chunk_001", "c1"), ("c2_msg_m_chunk_001", "c2")], "memory_id string, conversation_id string")
    messages = spark.createDataFrame([("C1 ", "m"), ("c1", None), ("c2", "m")], "conversation_id string, message_id string")
    assert ingest.guard_legacy(messages, stored).count() == 2 and ingest.guard_legacy(messages, stored, "mixed").count() == 3
    ingest.integrity(10, 15, 7, 2)
    with pytest.raises(RuntimeError):
        ingest.integrity(10, 15, 7, 3)


def test_upsert_keeps_one_row_of_an_id(spark):
    old = spark.createDataFrame([("a", 1)], "memory_id string, v int")
    new = spark.createDataFrame([("b", 1, 1), ("b", 2, 2), ("a", 5, 3)], "memory_id string, v int, pos int")
    assert sorted(map(tuple, catalog.upsert(old, new).collect())) == [("a", 5), ("b", 2)]


def test_text(spark):
    assert value(spark, T.clamp_body(F.lit("x" * 230), 220)) == "x" * 220 + "..." and value(spark, T.clamp_total(F.lit("x" * 230), 160)) == "x" * 157 + "..."
    assert value(spark, T.meaningful_tokens(F.lit("The a1 cat, CAT & é über ok"))) == ["a1", "cat", "über"]
    assert value(spark, T.concepts(F.lit("Merged drafts originated"))) == ["recombine", "transcript", "develop"]
    assert value(spark, T.family_key(F.lit(" Report_copy (1).PDF"))) == "reportpdf"
    assert value(spark, T.clock(F.lit(3725))) == "01:02:05" and value(spark, T.clock(F.lit(65))) == "01:05"
    assert value(spark, T.suggestions(F.lit("text\nSUGGESTIONS: a | b ||\n"))) == ["a", "b"]
    assert value(spark, T.attachment_ref(F.lit("file-service://abc"))) == "abc"
    assert value(spark, T.negated(F.lit("This does not hold"))) and not value(spark, T.negated(F.lit("notable")))


def test_times(spark):
    for text, want in (("1704067200.5", "2024-01-01T00:00:00Z"), ("2024-01-01", "2024-01-01T00:00:00Z"), ("2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00Z"), ("soon", ""), ("", "")):
        assert value(spark, times.written(times.flexible(F.lit(text)))) == want
    ts, warning = times.normalized(F.lit("never"))
    assert value(spark, warning) == "malformed_timestamp" and value(spark, ts) is None


def test_cleanup(spark):
    rows = [Row(memory_id="c_turn_001_chunk_001", conversation_id="c", speaker="user", ts=1, text="I prefer short answers to every question I ask.", source_quote="I prefer short answers to every question I ask.", source_title="t", project="p"), Row(memory_id="c_turn_001_chunk_002", conversation_id="c", speaker="bot", ts=2, text="(broken", source_quote="(broken", source_title="", project=None)]
    one, two = cleanup.cleaned(spark.createDataFrame(rows)).orderBy("memory_id").collect()
    assert (one["kind"], one["cleanup_status"], one["chunk_position"], one["safe_for_reflection"]) == ("preference", "clean", "first", True)
    assert (two["role"], two["quality"], two["blockers"], two["chunk_position"]) == ("assistant", "malformed", ["insufficient_context", "malformed_quote"], "last")


def point(memory_id, ts, text, speaker="user", **more):
    return Row(memory_id=memory_id, conversation_id="c", speaker=speaker, ts=ts, text=text, source_quote=text, source_title="t", project="p", **more)


def test_duplicates_are_of_one_id(spark):
    """Equal texts of different ids are no duplicates; an id that comes again is a duplicate record, and a duplicate with equal content."""
    text = "The same words are kept in every one of these."
    rows = [point("a", 1, text), point("b", 2, text), point("a", 3, text), point("a", 4, text + " And one more thing.")]
    found = {row["ts"]: (row["duplicate_of"], row["cleanup_status"], row["blockers"]) for row in cleanup.cleaned(spark.createDataFrame(rows)).collect()}
    assert found == {1: (None, "clean", []), 2: (None, "clean", []), 3: ("a", "skipped_duplicate", ["duplicate_record"]), 4: (None, "needs_review", ["duplicate_record"])}


def test_broken_points(spark):
    rows = [point("a", 1, "A whole sentence that can be read well.", timestamp="soon", payload_error=False), point("b", 2, "A whole sentence that can be read well.", timestamp="", payload_error=True)]
    found = {row["memory_id"]: row for row in cleanup.cleaned(spark.createDataFrame(rows)).collect()}
    assert (found["a"]["blockers"], found["a"]["cleanup_status"]) == (["unsupported_schema"], "needs_review") and "malformed_timestamp" in found["a"]["warnings"]
    assert (found["b"]["blockers"], found["b"]["cleanup_status"]) == (["corrupted_json"], "failed") and "missing_timestamp" in found["b"]["warnings"]
    assert cleanup.reviewed(cleanup.cleaned(spark.createDataFrame(rows)), only_needs_review=True).count() == 1


HYPOTHESES = [("s", f"H{k}", 0.5, 0.3, k, "active", [], [], []) for k in range(1, 5)]
STATE = "session_id string, hypothesis_id string, confidence double, strength double, rank long, status string, support_ids array<string>, counter_ids array<string>, ambiguous_ids array<string>"


def test_model_update(spark):
    """Evidence moves its own hypothesis, once; ranks are recomputed; a refuted hypothesis stays refuted."""
    state = spark.createDataFrame(HYPOTHESES, STATE)
    weighed = "hypothesis_id string, evidence_id string, polarity string, weight double"

    def after(before, rows):
        return {row["hypothesis_id"]: row for row in evidence.updated(before, spark.createDataFrame(rows, weighed)).collect()}

    found = after(state, [("H2", "e1", "support", 1.0)])
    assert found["H2"]["new_confidence"] == 0.56 and (found["H2"]["new_rank"], found["H2"]["rank_delta"], found["H1"]["new_rank"]) == (1, -1, 2)
    assert found["H1"]["new_confidence"] == 0.5 and found["H1"]["reason"] == "no new discriminating evidence"
    again = state.withColumn("support_ids", F.when(F.col("hypothesis_id") == "H2", F.array(F.lit("e1"))).otherwise(F.col("support_ids")))
    assert after(again, [("H2", "e1", "support", 1.0)])["H2"]["new_confidence"] == 0.5
    mixed = after(state, [("H1", "e1", "support", 1.0), ("H1", "e2", "support", 1.0), ("H1", "e3", "counter", 1.0), ("H1", " ", "counter", 1.0)])["H1"]
    assert (mixed["new_confidence"], mixed["status"], mixed["n_support"], mixed["n_counter"], mixed["support_ids"]) == (0.56, "contested", 2, 1, ["e1", "e2"])
    assert mixed["reason"] == "mixed evidence: support 2.00 vs counter 1.00"
    refuted = state.withColumn("confidence", F.lit(0.0))
    assert after(refuted, [("H1", "e1", "counter", 1.0)])["H1"]["new_confidence"] == 0.0
    seeded = evidence.seeded(spark.createDataFrame([("s", None, " ", 0.0, 2.0, 0, "", 1), ("s", "X", "text", 0.9, 0.1, 1, "frozen", 2)], "session_id string, hypothesis_id string, statement string, confidence double, strength double, rank int, status string, pos int"))
    assert sorted(map(tuple, seeded.collect())) == [("s", "H1", "H1", 0.42, 1.0, 1, "active"), ("s", "X", "text", 0.9, 0.1, 2, "frozen")]


def test_archive_matches(spark):
    """Equal texts, beginnings, slices of a long message, messages that a chunk begins with, and chunks inside a message."""
    long = " ".join(f"word{k}" for k in range(600))
    archive = spark.createDataFrame([("c", "m1", 1, "Hello  there"), ("c", "m2", 2, long), ("d", "m3", 3, long)], "conversation_id string, message_id string, pos int, text string")
    texts = ["hello there", "hello there and more", long[:150], long[1400:1700], long[2000:2100], "nothing of the kind is in the archive at all", " ", "word11 wor"]
    chunks = spark.createDataFrame([("c", str(k), text) for k, text in enumerate(texts)], "conversation_id string, memory_id string, text string")
    found = {row["memory_id"]: (row["message_id"], row["basis"]) for row in ingest.archive_matches(chunks, archive).collect()}
    assert found == {"0": ("m1", "text"), "1": ("m1", "begins"), "2": ("m2", "prefix"), "3": ("m2", "slice"), "4": ("m2", "contains"), "5": (None, None), "6": (None, None), "7": (None, None)}


def test_numbered(spark):
    """Places of a group that holds most rows, with ties and nulls, as one window would give them."""
    from pyspark.sql import Window

    from mnemoria.operators.order import numbered

    rows = spark.range(3000).selectExpr("if(id % 5 = 0, id % 7, -1) as g", "if(id % 11 = 0, null, id * 7919 % 500) as ts", "id")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("ts", "id")))
    assert sorted(map(tuple, numbered(rows, ["g"], "ts", ["ts", "id"], "n", 8).select("id", "n").collect())) == sorted(map(tuple, want.select("id", "n").collect()))
    assert numbered(rows.where("id < 0"), ["g"], "ts", ["ts", "id"], "n").collect() == []


def test_pages(spark):
    rows = spark.range(50).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("memory_id"))
    page = catalog.page_at(rows, 40, 10, F.asc("memory_id")).collect()
    assert len(page) == 10 and {row["next_offset"] for row in page} == {None}
    page = catalog.page_at(rows, 30, 10, F.asc("memory_id")).collect()
    assert [row["memory_id"] for row in page] == [f"{k:03d}" for k in range(30, 40)] and {row["next_offset"] for row in page} == {40}
    assert catalog.page_at(rows, 60, 10, F.asc("memory_id")).collect() == []


def test_canon_run(spark):
    """A run proposes facts and a timeline, marks what differs, and proposes nothing that is canon already."""
    rows = [point(f"m{k:02d}", 1704067200 + k, f"I decided on number {k} for good.", summary=f"number {k}", memory_kind="decision" if k % 2 else "fact", canonical=False) for k in range(60)]
    points = spark.createDataFrame(rows)
    none = canon.timeline_candidates(points).where("false")
    found, counters = canon.proposed(points, none)
    assert counters.first().asDict() == {"candidates": 6, "skipped": 0, "contradictions": 3}
    assert {row["memory_kind"] for row in found.collect()} == {"project_decision", "inferred_pattern", "canonical_timeline", "contradiction_note"}
    assert canon.proposed(points, found)[1].first().asDict() == {"candidates": 0, "skipped": 6, "contradictions": 3}


def test_reflection(spark):
    told = spark.createDataFrame([("a", "good text, long enough to ask about", "partial"), ("b", "bad text, long enough to ask about", "complete")], "memory_id string, text string, quality string")

    def model(batches):
        for texts in batches:
            yield texts.map(lambda t: '{"phase": "p", "depth": "deep", "confidence": 0.9, "themes": ["x"]}' if t.startswith("good") else "no json")

    rows = {row["memory_id"]: row for row in reflection.reflect(told, model).collect()}
    assert (rows["a"]["confidence"], rows["a"]["depth"], rows["b"]["confidence"], rows["b"]["depth"]) == (0.75, "deep", 0.0, "shallow")


def test_canon_queue(spark):
    queue = spark.createDataFrame([("1", "direct"), ("2", "inferred"), ("3", "inferred"), ("4", "inferred")], "candidate_id string, status string")
    decisions = spark.createDataFrame([("1", "approve", None), ("2", "approve", None), ("3", "reject", None), ("5", "merge", " 1 ")], "candidate_id string, action string, target_id string").withColumn("reviewed_by", F.lit(" me"))
    found = {row["candidate_id"]: row for row in canon.review(queue.unionByName(spark.createDataFrame([("5", "approved")], queue.schema)), decisions).collect()}
    assert {key: (row["status"], row["canonical"]) for key, row in found.items()} == {"1": ("direct", True), "2": ("approved", True), "3": ("rejected", False), "4": ("inferred", False), "5": ("needs_review", False)}
    assert (found["5"]["merged_from"], found["5"]["merge_target"], found["5"]["reviewed_by"]) == (["5"], "1", "me") and found["4"]["reviewed_at"] is None


def test_cycles(spark):
    for steps, want in ((["a", "b", "a", "b"], True), (["a", "b", "c"], False), (["x", "a", "b", "c", "a", "b", "c"], True), (["a", "a"], False)):
        assert value(spark, evidence.cycles(F.array(*map(F.lit, steps)))) is want
