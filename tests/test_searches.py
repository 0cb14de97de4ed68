"""Searches by blocks against every pair, with copies, odd vectors and more queries than are sent to a task."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoria.functions.vectors import cosine
from mnemoria.operators import drill, recall, searches


def pair_by_pair(points, queries, k):
    pairs = points.join(queries).withColumn("score", F.round(cosine(F.col("embedding"), F.col("q")), 9)).where("score >= -1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def told(rows):
    return sorted((r["query_id"], r["rank"], r["memory_id"], repr(r["score"])) for r in rows.select("query_id", "rank", "memory_id", "score").collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Copies of one vector, near copies, zeros, nulls, infinite and tiny numbers, and two lengths."""
    n, odd = F.col("id"), {7: [0.0, 0.0, 0.0], 11: [float("nan"), 1.0, 0.0], 13: [float("inf"), 1.0, 0.0], 17: [1e-200, 1e-200, 0.0], 19: [1e200, 1e200, 1.0], 23: [1.0, None, 2.0], 29: None, 31: [1.0, 2.0], 37: []}
    vector = F.when(n % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0))).when(n % 3 == 1, F.array(1 + n / 1e10, F.lit(2.0), F.lit(-1.0))).otherwise(F.array(F.sin(n), F.cos(n * 7), F.sin(n * 3)))
    for k, v in odd.items():
        vector = F.when(n == k, F.lit(None) if v is None else F.array(*map(F.lit, v)).cast("array<double>")).otherwise(vector)
    return spark.range(200).select(F.concat(F.lit("m"), n.cast("string")).alias("memory_id"), (n % 5).alias("kind"), vector.alias("embedding")).repartition(3).cache()


@pytest.mark.parametrize("k", [1, 4, 300])
def test_blocks_find_what_all_pairs_find(spark, vectors, monkeypatch, k):
    monkeypatch.setattr(searches, "NUMBERS", 90)
    monkeypatch.setattr(searches, "PAIRS", 200)
    queries = vectors.where("cast(substring(memory_id, 2) as int) < 40").select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("q"))
    got = recall.multi_query(vectors, queries, k)
    assert set(got.columns) == {"memory_id", "kind", "query_id", "score", "rank"}
    assert told(got) == told(pair_by_pair(vectors, queries, k))
    monkeypatch.setattr(searches, "SENT", 0)  # many queries: block by block
    monkeypatch.setattr(searches, "ASKED", 16)
    assert told(recall.multi_query(vectors, queries, k)) == told(pair_by_pair(vectors, queries, k))


def test_queries_are_not_limited(spark, vectors):
    queries = spark.range(10_050).select(F.col("id").alias("query_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("q"))
    got = recall.multi_query(vectors.where("kind < 2"), queries, 2)
    assert got.count() == 20_100


def test_words_of_many_queries_are_counted_like_each_by_itself(spark, monkeypatch):
    texts = ("the sea, the seaside", "a side e8 0x8 e88", "", "ñand sand and", "s" * 300 + "ea", "of the sand-and-sea", "SEA", "x") * 3
    points = spark.createDataFrame([(f"m{n:02d}", text) for n, text in enumerate(texts)], "memory_id string, low string").repartition(4)
    wanted = (["sea", "side", "the"], ["e8"], ["and", "a", "nd"], ["ssea", "nowhere"], ["nothing"], [chr(97 + n % 26) * (1 + n // 26) for n in range(300)])
    queries = spark.createDataFrame(list(enumerate(wanted)), "query int, tokens array<string>")
    for sent in (searches.SENT, 0):
        monkeypatch.setattr(searches, "SENT", sent)
        found = {}
        for r in searches.worded(points, queries, 5).collect():
            found.setdefault(r["query"], []).append((-r["n"], r["memory_id"]))
        want = {n: sorted((-c, f"m{k:02d}") for k, text in enumerate(texts) if (c := sum(t in text for t in tokens)))[:5] for n, tokens in enumerate(wanted)}
        assert {n: sorted(rows)[:5] for n, rows in found.items()} == {n: rows for n, rows in want.items() if rows}


def test_sessions_are_not_limited(spark):
    points = spark.createDataFrame([(f"m{n}", f"d{n % 3}", "t", "document", f"e8 and {n}", n) for n in range(9)], "memory_id string, document string, source_title string, source_type string, text string, ts long").withColumn("embedding", F.array(F.sin("ts"), F.lit(1.0)))
    strategy = F.element_at(F.array(*map(F.lit, ("PARTITION_TEST", "CROSS_DOCUMENT", "DOCUMENT_EXPANSION"))), (F.col("id") % 3 + 1).cast("int"))
    asked = spark.range(10_050).select(F.col("id").cast("string").alias("session_id"), strategy.alias("strategy"), F.lit("e8").alias("asked"), F.array(F.lit("d1")).alias("support"))
    found = drill.dispatched(asked, points, lambda text: F.array(F.length(text).cast("double"), F.lit(0.0)))
    assert {(r["strategy"], r["n"]) for r in found.join(asked, "session_id").groupBy("strategy").agg(F.count("*").alias("n")).collect()} == {("PARTITION_TEST", 9 * 3350), ("CROSS_DOCUMENT", 6 * 3350), ("DOCUMENT_EXPANSION", 3 * 3350)}
