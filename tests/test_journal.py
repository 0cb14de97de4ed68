"""Journals: other imports are refused, killed batches don't count, finished conversations are left out."""

import pytest
from pyspark.sql import functions as F

from mnemoria.streaming import ingest, journal


def test_other_imports(spark, tmp_path):
    path = str(tmp_path / "j")
    assert not journal.open_journal(spark, path, source="/a/b/", table="t", model=" m ")
    assert journal.open_journal(spark, path, source=" /a/b", table="t", model="m")
    for other in ({"source": "/a/c", "table": "t", "model": "m"}, {"source": "/a/b", "table": "u", "model": "m"}, {"source": "/a/b", "table": "t", "model": "n"}, {"source": "/a/b", "table": "t"}):
        with pytest.raises(journal.OtherImport):
            journal.open_journal(spark, path, **other)
    spark.createDataFrame([(2, {"source": "s"})], journal.IDENTITY).coalesce(1).write.json(f"{tmp_path}/old/identity")
    with pytest.raises(journal.OtherImport, match="version 2"):
        journal.open_journal(spark, f"{tmp_path}/old", source="s")


def test_position(spark, tmp_path):
    path = str(tmp_path / "j")
    assert tuple(journal.position(spark, path).first()) == (0, 0, -1)
    journal.commit(spark, path, 0, 5, 90)
    journal.commit(spark, path, 1, 3, 40)
    journal.commit(spark, path, 1, 4, 40)
    journal.commit(spark, path, 2, 0, None)
    assert tuple(journal.position(spark, path).first()) == (3, 9, 90)


def test_killed_batches(spark, tmp_path):
    source, table, state = (str(tmp_path / name) for name in ("in", "points", "state"))
    rows = [("c", f"m{k}", k, "user", f"text {k}", "x", "p") for k in range(4)]
    spark.createDataFrame(rows, ingest.MESSAGES).coalesce(1).write.json(source)
    # Points that a run wrote before it was killed, with no name in the journal: they neither count nor keep the same ids out.
    ingest.to_points(spark.createDataFrame(rows[:2], ingest.MESSAGES)).write.parquet(f"{table}/batch=0")
    ingest.to_points(spark.createDataFrame(rows[2:], ingest.MESSAGES)).write.parquet(f"{table}/batch=7")
    ingest.ingest_stream(spark, source, table, state, model="m").awaitTermination(60)
    got = ingest.ingested(spark, table, state)
    assert sorted(r["message_id"] for r in got.collect()) == ["m0", "m1", "m2", "m3"] and {r["batch"] for r in got.collect()} == {0}
    assert tuple(journal.position(spark, ingest.journal_of(state)).first()) == (1, 4, 3)
    for changed in ({"model": "n"}, {"model": "m", "table": table + "2"}, {"model": "m", "source": source + "2"}):
        with pytest.raises(journal.OtherImport):
            ingest.ingest_stream(spark, changed.get("source", source), changed.get("table", table), state, model=changed["model"])


def test_finished(spark, tmp_path):
    path = str(tmp_path / "j")
    conv = spark.range(6).select(F.concat(F.lit(" c"), "id").alias("conversation_id"), "id")
    journal.finish(conv.where("id < 2"), path)
    journal.finish(conv.where("id < 3").union(conv.where("id = 2")).union(spark.createDataFrame([(" ", 9)], "conversation_id string, id long")), path)
    assert sorted(r["id"] for r in journal.remaining(conv, path).collect()) == [3, 4, 5]
    assert journal.read_json(spark, f"{path}/finished", "conversation_id string").count() == 3
