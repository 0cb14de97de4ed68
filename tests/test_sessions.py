"""Session state over several triggers: late, repeated and expired turns."""

from pyspark.sql import functions as F

from mnemoria.streaming.sessions import clamped, named, session_points

TURN = "session_id string, turn_id string, message string, answer string, seconds long"


def test_sessions_over_triggers(spark, tmp_path):
    turn = lambda n, at=None, s="S 1": (s, f"t{n}", f"question {n}", f"answer {n}", 1_700_000_000 + (n * 10 if at is None else at))
    batches = [
        [turn(n) for n in (1, 3, 2)] + [("other", "x", None, "a" * 300, 1_700_000_000), (None, "y", "m", "a", 1), ("S 1", "z", "no time", "a", None)],
        [turn(3), turn(4), *(turn(n) for n in range(5, 9)), turn(0, at=5)],  # turn 3 again, and one that is late
        [turn(9, at=90 + 200_000)],  # after more than a day
    ]
    folder, got = str(tmp_path / "in"), []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, TURN).withColumn("ts", F.timestamp_seconds("seconds")).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(TURN + ", ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    query = session_points(stream).writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    mine = [row for row in got if row["session_id"] == "S 1"]
    assert [(row["turn"], row["memory_kind"], row["text"].split("\n")[0]) for row in mine if row["memory_kind"] == "chat_turn"] == [(k + 1, "chat_turn", f"User: question {n}") for k, n in enumerate([1, 2, 3, 0, 4, 5, 6, 7, 8])] + [(1, "chat_turn", "User: question 9")]
    (summary,) = [row for row in mine if row["memory_kind"] == "session_summary"]
    assert (summary["memory_id"], summary["turn"], summary["text"]) == ("chat_s_1_session_summary", 8, "question 7\nanswer 7")
    assert mine[-1]["recent"] == ["chat_s_1_000001"] and len([row for row in mine if row["turn"] == 9][0]["recent"]) == 10
    (other,) = [row for row in got if row["session_id"] == "other"]
    assert other["text"] == "User: \nAssistant: " + "a" * 300 and len(other["summary"]) == 220 and other["summary"].endswith("...")


def test_names_and_cuts():
    assert (named(" A-b C "), named("  "), clamped(" abc "), clamped("x" * 221)) == ("a_b_c", "session", "abc", "x" * 217 + "...")
