"""The inverted index against recall that reads every text."""

import random

import pytest

from mnemoria.operators import postings, recall

WORDS = ["alpha", "beta", "gamma", "(delta)", "eps/ilon", "zeta", "\"eta\"", "theta"]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Points in which ``alpha`` is everywhere and ``theta`` rare, with null and empty texts."""
    dealt = random.Random(5)
    rows = [
        (f"m{i:04d}", None if i % 50 == 0 else " ".join(["Alpha", *(w for j, w in enumerate(WORDS) if dealt.random() < 0.6 ** j), ""]), "" if i % 3 else "Title of beta", i // 3, i % 7 == 0, ["approved", "inferred", "needs_review", "x", None][i % 5])
        for i in range(600)
    ]
    points = spark.createDataFrame(rows, "memory_id string, text string, source_title string, ts long, canonical boolean, status string").cache()
    return points, postings.build(points, str(tmp_path_factory.mktemp("index") / "i"), "text", "source_title")


QUERIES = ["theta alpha", "alpha", "theta", "delta alpha alpha zeta", "Alpha BETA gamma delta eps/ilon zeta eta theta", "beta theta none", "none", "", "zeta, (eta) theta alpha"]


@pytest.mark.parametrize("k", [1, 7, 40, 1000])
@pytest.mark.parametrize("query", QUERIES)
def test_same_results(spark, found, query, k):
    points, index = found
    want = [(r.memory_id, r.lexical_score, r.score) for r in recall.lexical(points, query, k, "text", "source_title").collect()]
    got = [(r.memory_id, r.lexical_score, r.score) for r in postings.search(spark, index, query, k).collect()]
    assert got == want


def test_hot_tokens_lie_in_several_files(spark, found, tmp_path):
    points, _ = found
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = postings.build(points, str(tmp_path / "i"), "text", "source_title")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.postings(spark).where("token = 'alpha'").selectExpr("input_file_name() AS f").distinct().count() > 1


def test_bounds_reach_the_scan(spark, found, capsys):
    _, index = found
    postings.matched(index.postings(spark), {"theta": 1}, ["theta"], 0.5).explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "EqualTo(token,theta)" in pushed or "In(token" in pushed
    assert "GreaterThanOrEqual(boost,0.5)" in pushed


def test_an_empty_table(spark, found, tmp_path):
    points, _ = found
    index = postings.build(points.limit(0), str(tmp_path / "none"), "text")
    assert postings.search(spark, index, "alpha", 5).collect() == []
