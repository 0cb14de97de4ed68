"""What a cleanup does once a row, and where rows meet."""

from pyspark.sql import functions as F

from mnemoria.operators import cleanup


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_trimmed_once(spark, small):
    points = spark.createDataFrame([("a", "user", "t", 1, "x", "text (one", "quote")], "memory_id string, speaker string, source_title string, ts long, project string, text string, source_quote string")
    # Conditions on blockers took the trimming of the text over, dozens of times for a row and branch.
    plan = plan_of(cleanup.cleaned(points).where("safe_for_reflection").select("memory_id"))
    assert plan.count("trim(coalesce(text") <= 2


def test_ids_without_a_turn_meet_nowhere(spark):
    ids = ["doc_1", "doc_2", "c_turn_001_chunk_001", "c_turn_001_chunk_002", "c_turn_001_chunk_003", "d_turn_1_chunk_1", "e_turn_99999999999_chunk_2", None]
    points = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "memory_id string, n int")
    found = cleanup.chunk_positions(points)
    assert {r["memory_id"]: r["chunk_position"] for r in found.collect()} == dict(zip(ids, ["single", "single", "first", "middle", "last", "single", "single", "single"], strict=True))
    assert found.columns == ["memory_id", "n", "chunk_position"]
    # The rows that are joined are those whose id names a turn.
    join = plan_of(found).split("Join LeftOuter")[1].split("Aggregate")[0]
    assert "isnotnull(p_turn" in join.replace("#", "") or "regexp_extract" in join and "Filter" in join
