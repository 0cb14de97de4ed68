"""Traces of sources: explicit links, families, order, and what is said where nothing is found."""

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import lineage
from mnemoria.operators.lineage import CITES, DERIVED_FROM, EARLIER, FAMILY, LATER, PRESENTS, SAME_FAMILY, SIGNALS, SUMMARIZES, TRANSCRIBES, UNKNOWN, turn_index

SCHEMA = "memory_id string, source_id string, source_title string, source_type string, chunk_index int, turn_index int, segment_start double, segment_end double, original_ts long, ingested_ts long, parent_id string, derived_from array<string>, cites array<string>"


def node(memory_id, source, title="", kind="document", chunk=0, turn=0, start=None, end=None, ts=None, ingested=None, parent="", derived=(), cites=()):
    return (memory_id, source, title or source, kind, chunk, turn, start, end, ts, ingested, parent, list(derived), list(cites))


def traced(spark, rows, *anchors):
    edges, told = lineage.trace(lineage.nodes(spark.createDataFrame(rows, SCHEMA).repartition(3)), spark.createDataFrame([(a,) for a in anchors], "anchor string"))
    return {(r["from_id"], r["to_id"], r["relation"], r["basis"]): r for r in edges.collect()}, {r["anchor"]: r for r in told.collect()}


def only(edges, relation):
    return {(k[0], k[1]): (r["side"], r["confidence"]) for k, r in edges.items() if k[2] == relation and k[3] != lineage.FAMILY_COUNT}


def test_explicit_links_depend_on_who_names_whom(spark):
    rows = [node("m1", "child", parent="Mother"), node("m2", "mother"), node("m3", "list", derived=["CHILD", "x"]), node("m4", "paper", cites=["m1"]), node("m5", "sibling", parent="mother")]
    edges, told = traced(spark, rows, "child")
    assert only(edges, DERIVED_FROM) == {("child", "mother"): ("downstream", 0.9), ("list", "child"): ("upstream", 0.92)}
    assert only(edges, CITES) == {("paper", "child"): ("upstream", 0.88)}
    edges, _ = traced(spark, rows, "mother")
    assert only(edges, DERIVED_FROM) == {("child", "mother"): ("upstream", 0.92), ("sibling", "mother"): ("upstream", 0.92)}
    edges, _ = traced(spark, rows, "list")  # what it derives from counts as its own name
    assert only(edges, DERIVED_FROM) == {("list", "child"): ("downstream", 0.9)}
    assert told["child"]["confidence"] == pytest.approx(0.55 * 1 + 0.45 * (0.9 + 0.92 + 0.88) / 3 - 0.05)


def test_a_family_is_named_by_the_kind_of_its_members(spark):
    rows = [node("a", "s0", "Map", ts=100), node("b", "s1", "map copy", "Audio_Overview"), node("c", "s2", "MAP (1)", "audio", ts=90), node("d", "s3", "map", "slide deck", ts=100), node("e", "s4", "map", "odd", ts=101), node("f", "s0", "Map", "summary", ts=7), node("g", "s9", "other", ts=1)]
    edges, _ = traced(spark, rows, "s0")
    assert {k[1]: (k[2], r["confidence"]) for k, r in edges.items() if k[3] == FAMILY} == {"s1": (SUMMARIZES, 0.66), "s2": (TRANSCRIBES, 0.66), "s3": (PRESENTS, 0.66), "s4": (SAME_FAMILY, 0.58)}
    assert {k[1]: (k[2], r["confidence"]) for k, r in edges.items() if k[3] == lineage.FAMILY_TIME} == {"s2": (EARLIER, 0.69), "s3": (EARLIER, 0.69), "s4": (LATER, 0.69)}
    assert edges["s0", "map", SAME_FAMILY, lineage.FAMILY_COUNT]["n"] == 6


def test_order_within_a_source_by_the_first_signal_that_two_nodes_share(spark):
    best = node("z", "s", chunk=3, turn=2, start=10.0, end=20.0, ts=500, parent="p")
    rows = [best, node("c1", "s", chunk=1, turn=9), node("c9", "s", chunk=9), node("c4", "s", chunk=4), node("t1", "s", turn=1), node("t2", "s", turn=2), node("g1", "s", start=20.0, end=21.0), node("g2", "s", start=20.5, end=21.0), node("o1", "s", ts=500), node("o2", "s", ts=501), node("n", "s")]
    edges, told = traced(spark, rows, "s")
    within = {(k[2], k[3]): (r["confidence"], r["n"], r["nearest"]) for k, r in edges.items() if k[3] in dict(SIGNALS)}
    names = [s for s, _ in SIGNALS]
    assert within == {
        (EARLIER, names[0]): (0.82, 1, "c1"), (LATER, names[0]): (0.82, 2, "c4"), (EARLIER, names[1]): (0.77, 2, "t2"), (EARLIER, names[2]): (0.79, 1, "g1"), (LATER, names[2]): (0.79, 1, "g2"), (EARLIER, names[3]): (0.74, 1, "o1"), (LATER, names[3]): (0.74, 1, "o2"),
    }
    assert told["s"]["memory_id"] == "z" and told["s"]["n_edges"] == 7 and told["s"]["lacks"] == []


def test_what_is_said_without_links(spark):
    rows = [node("a", "lone", "Lone", "", ingested=5), node("b", "far", "Far", ingested=6)]
    edges, told = traced(spark, rows, "LONE", "nowhere", "far", " ")
    assert edges["lone", "", UNKNOWN, lineage.UNLINKED]["confidence"] == 0.24 and edges["nowhere", "", UNKNOWN, lineage.UNMATCHED]["confidence"] == 0.2
    assert told["nowhere"]["lacks"] == [lineage.NOT_FOUND] and (told["nowhere"]["confidence"], told["nowhere"]["source_type"]) == (0.2, "unknown")
    assert [text.split()[0] for text in told["LONE"]["lacks"]] == ["only", "source_type"] and told["LONE"]["confidence"] == pytest.approx(0.65 * 0.25 - 0.1)
    assert set(told) == {"LONE", "nowhere", "far"}
    _, none = traced(spark, [], "x")
    assert none["x"]["lacks"] == [lineage.NOT_FOUND]


def test_turns_of_ids(spark):
    ids = {"c_turn_007_chunk_1": 7, "turn_x_turn_3": 0, "return_12": 12, "": 0, "turn_99999999999999": 0}
    rows = spark.createDataFrame([(k,) for k in ids], "id string").select("id", turn_index(F.col("id")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == ids


def test_names_are_not_limited_and_no_node_is_linked_with_itself(spark):
    n = F.col("id")
    blank = F.array().cast("array<string>")
    rows = spark.range(300).select(F.concat(F.lit("m"), n).alias("memory_id"), F.concat(F.lit("s"), n % 4).alias("source_id"), F.concat(F.lit("t"), n).alias("source_title"), F.lit("document").alias("source_type"), *(F.lit(None).cast(t).alias(c) for c, t in (("chunk_index", "int"), ("original_ts", "long"))), F.when(n % 2 == 0, "S1").otherwise("").alias("parent_id"), F.when(n % 3 == 0, F.array(F.lit("s1"), F.lit("S2"))).otherwise(blank).alias("derived_from"), blank.alias("cites"))
    names = spark.range(10_050).select(F.concat(F.lit("m"), n).alias("anchor")).unionByName(spark.createDataFrame([("s1",)], "anchor string"))
    edges, told = lineage.trace(lineage.nodes(rows), names)
    assert told.count() == 10_051
    found = {(r["from_id"], r["to_id"]): r["n"] for r in edges.where("anchor = 's1' and basis = 'explicit metadata keys: derived_from/parent_source'").collect()}
    # The anchor is m105, which derives from s1 and s2: nodes outside s1 that name one of both, each key of a node for itself.
    names_of = {k: ({"s1"} if k % 2 == 0 else set()) | ({"s1", "s2"} if k % 3 == 0 else set()) for k in range(300)}
    want = {(f"s{s}", "s1"): sum(len(names_of[k]) for k in range(300) if k % 4 == s) for s in (0, 2, 3)}
    assert found == want
