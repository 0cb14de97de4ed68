"""Rate limits: batch and stream against a plain fold; lexical search against tokens taken apart; reflections; what a request asks for."""

import random
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mnemoria.functions.text import TOKEN_WRAPPERS, optional_flag, tag_list
from mnemoria.functions.times import asked_time
from mnemoria.operators.recall import lexical_score
from mnemoria.operators.reflection import reflect
from mnemoria.streaming.limits import limit_stream, rate_limited

SCHEMA = "client string, request_id long, seconds double, tokens int"


def requests(spark, seed=1, n=600):
    rng, at, rows = random.Random(seed), {}, []
    for k in range(n):
        client = rng.choice(["hot", "hot", "hot", "a", "b", None])
        at[client] = at.get(client, 1.7e9) + rng.choice([0, 0.25, 0.5, 1, 5, 40, 400 if client != "hot" else 2])
        rows.append((client, k, at[client], 0))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("seconds") * 1000000).cast("long"))).repartition(3)


def plain(rows, per_minute, burst):
    state, found = {}, {}
    for client, k, at, _ in sorted(rows, key=lambda row: (row[2], row[1])):
        tokens, before = state.get(client, (burst, at))
        tokens = burst if at - before >= 300 else min(burst, tokens + (at - before) * per_minute / 60)
        found[k] = tokens >= 1
        state[client] = (tokens - found[k], at)
    return found


@pytest.mark.parametrize(("per_minute", "burst"), [(60, 5), (6, 2), (1, 20)])
def test_a_table_agrees_with_a_fold(spark, per_minute, burst):
    rows, table = requests(spark)
    want = plain(rows, per_minute, burst)
    assert 0 < sum(want.values()) < len(want)
    assert {row["request_id"]: row["allowed"] for row in rate_limited(table, per_minute, burst).collect()} == want


def test_a_stream_agrees_with_a_fold(spark, tmp_path, per_minute=6, burst=2):
    rows, _ = requests(spark)
    want = plain(rows, per_minute, burst)
    folder = str(tmp_path / "in")
    for n, (low, high) in enumerate([(0, 200), (200, 400), (400, 600)]):  # each file is a trigger, later than those before
        part = sorted(rows, key=lambda row: (row[2], row[1]))
        spark.createDataFrame(part[low:high], SCHEMA).withColumn("ts", F.timestamp_micros((F.col("seconds") * 1000000).cast("long"))).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    got = {}
    stream = spark.readStream.schema("client string, request_id long, seconds double, tokens int, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    query = limit_stream(stream, per_minute, burst).writeStream.foreachBatch(lambda batch, _: got.update({row["request_id"]: row["allowed"] for row in batch.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert got == want


def test_limits_of_odd_tables(spark):
    _, table = requests(spark, n=5)
    assert rate_limited(table.limit(0), 6).collect() == [] and rate_limited(table.withColumn("ts", F.lit(None).cast("timestamp")), 6).collect() == []
    with pytest.raises(ValueError, match="rate"):
        rate_limited(table, 0)


def test_tokens_are_found_as_if_texts_were_taken_apart(spark):
    rng = random.Random(4)
    pieces = ["map", "maps", "`map`", "(map)", "<b>map</b>", "re-map", "map,", "a/b", "[a/b]", "*map", "map*s", "\u0001map", "MAP", "#map#", "", "x" * 40]
    texts = [rng.choice(["", " "]) + "".join(rng.choice(pieces) + rng.choice([" ", "\n", ", ", "", *TOKEN_WRAPPERS]) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    table = spark.createDataFrame([(t, "Title of a map" if k % 7 == 0 else None) for k, t in enumerate(texts)], "text string, title string")
    for query in ("map a/b", "the map map", "re-map (maps)", "\u0001map"):
        plainly = lexical_score(F.lit(query), "text", "title")
        assert table.where(~lexical_score(query, "text", "title").eqNullSafe(plainly)).collect() == []


def test_reflections_are_gated_and_unwrapped(spark):
    answers = {"a": '```json\n{"phase": "dawn", "depth": "deep", "confidence": 0.9, "themes": ["t"]}\n```', "b": "no JSON", "c": '{"phase": "", "confidence": null}', "d": '{"phase": "dawn", "confidence": 2.0, "contradiction": true}'}
    rows = [(k, f"{k} is a text of twenty characters", q, p) for k, q, p in (("a", "full", None), ("b", "full", ""), ("c", "full", "applies"), ("d", "partial", "not_applicable"))]
    rows += [("e", "too short", "full", None), ("f", "f would be long enough to ask about", "missing", None), ("g", None, "full", None)]
    points = spark.createDataFrame(rows, "memory_id string, text string, quality string, phase_applicability string").withColumn("source_quote", F.when(F.col("memory_id") == "g", "a quote in place of the text that is null"))

    def model(batches):
        for batch in batches:
            yield pd.Series([answers.get(text[0], '{"confidence": 0.1}') if len(text) >= 20 and text[0] not in "ef" else 1 / 0 for text in batch])

    found = {row["memory_id"]: row for row in reflect(points, model).collect()}
    told = {k: (r["phase"], r["depth"], r["confidence"], r["contradiction"]) for k, r in found.items()}
    shallow = ("unknown", "shallow", 0.0, False)
    assert told == {"a": ("dawn", "deep", 0.9, False), "b": shallow, "c": shallow, "d": ("unknown", "shallow", 0.75, True), "e": shallow, "f": shallow, "g": ("dawn", "deep", 0.9, False)}
    assert found["a"]["themes"] == ["t"] and found["b"]["themes"] == [] and told["g"][2] > 0


def test_what_a_request_asks_for(spark):
    times = {"2024-03-01": datetime(2024, 3, 1), "2024-03-01T10:00:00Z": datetime(2024, 3, 1, 10), " 2024-03-01t10:00:00.5+02:00 ": datetime(2024, 3, 1, 8, 0, 0, 500000), "2024-02-30": None, "2024-03-01 10:00": None, "yesterday": None, "": None, None: None}
    table = spark.createDataFrame([(t,) for t in times], "t string")
    found = {row["t"]: row["n"] and datetime.fromtimestamp(row["n"], timezone.utc).replace(tzinfo=None) for row in table.select("t", (F.unix_micros(asked_time(F.col("t"))) / 1000000).alias("n")).collect()}
    assert found == times
    with pytest.raises(PySparkException, match="no day and no time"):
        table.select(asked_time(F.col("t"), strictly=True).alias("t")).collect()
    row = spark.range(1).select(tag_list(F.array(F.lit("a, b"), F.lit(None).cast("string"), F.lit(" ")), F.lit("b,,c ")).alias("t"), tag_list(F.lit(None).cast("array<string>"), F.lit(None).cast("string")).alias("n"), *(optional_flag(F.lit(v)).alias(k) for k, v in (("y", " Yes"), ("no", "0"), ("x", "maybe")))).first()
    assert (row["t"], row["n"], row["y"], row["no"], row["x"]) == (["a", "b", "b", "c"], [], True, False, None)
