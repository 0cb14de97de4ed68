"""The quality classifier: its formula against all pairs, held-out accuracy, what it may learn from, odd rows."""

import zlib

import numpy as np
import pytest

from mnemoria.llm import factorisation
from mnemoria.llm.factorisation import BUCKETS, RANGES, STATISTICS, Machine, fit, quality_scores, structure, word_features
from mnemoria.llm.queries import op13_quality_classifier

LABELS = "doc_id long, quality int, toxic int"


def test_scores_are_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    size = BUCKETS + len(STATISTICS) * RANGES
    machine = Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.sort(rng.normal(size=(len(STATISTICS), RANGES - 1)), axis=1))
    rows = [machine.features(rng.normal(size=len(STATISTICS)).tolist(), *word_features(structure(text, 9)[1])) for text in ("", "one word and one word more", "a b c\nd")]
    want = []
    for index, value in rows:
        z = machine.bias + sum(machine.weights[i] * x for i, x in zip(index, value, strict=True))
        z += sum(machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b] for a in range(len(index)) for b in range(a))
        want.append(1 / (1 + np.exp(-z)))
    assert machine.scores(rows) == pytest.approx(want)


def test_pairs_are_learned():
    """Two words that are only bad together, which no linear score can tell."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (3000, 2))
    texts = [" ".join(word if bit else other for bit, word, other in zip(pair, ("alpha", "beta"), ("gamma", "delta"), strict=True)) for pair in bits]
    words = [word_features(structure(text, None)[1]) for text in texts]
    stats = np.zeros((3000, len(STATISTICS)))
    labels = (bits[:, 0] == bits[:, 1]).astype(float)
    machine = fit(stats[:2000], words[:2000], labels[:2000])
    scores = machine.scores([machine.features(list(s), *w) for s, w in zip(stats[2000:], words[2000:], strict=True)])
    assert ((scores > 0.5) == labels[2000:]).mean() > 0.98


def test_held_out_accuracy(spark):
    """Over all labelled rows of the fold that nothing was learned from, at two sizes."""
    for folder, least in (("/root/testdata/sf0.01", 0.9), ("/root/testdata/sf0.1", 0.98)):
        found = op13_quality_classifier(spark, folder)
        assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        rows = found.collect()
        assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
        truth = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
        assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) and 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3) for row in rows)
        held = [row for row in rows if row["held_out"] and row["doc_id"] in truth]
        assert np.mean([row["predicted"] == truth[row["doc_id"]] for row in held]) >= least


def test_held_out_labels_are_not_learned_from(spark, documents):
    ids = [row["doc_id"] for row in documents.select("doc_id").collect()]
    held = {k for k in ids if zlib.crc32(str(k).encode()) % 5 == 0}
    table = lambda flip: spark.createDataFrame([(k, (k % 2) ^ (flip and k in held), 0) for k in ids], LABELS)
    first, again = ({row["doc_id"]: row["score"] for row in quality_scores(documents, table(flip)).collect()} for flip in (False, True))
    assert first == again


def test_odd_rows(spark, awkward, empty, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(14)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (999, 1, 0)], LABELS)
    rows = quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 < row["score"] < 1 for row in rows)
    assert len({row["score"] for row in rows if row["doc_id"] == 4}) == 1
    assert [row["held_out"] for row in rows if row["doc_id"] is None] == [False, False]
    none = {row["score"] for row in quality_scores(awkward, labels.limit(0)).collect()}
    assert none == {0.5}
    assert quality_scores(empty, labels).collect() == []
    taken = []
    monkeypatch.setattr(factorisation, "fit", lambda stats, words, labels: taken.append(len(labels)) or fit(stats, words, labels))
    quality_scores(awkward.unionByName(awkward), labels, sample=5).collect()
    assert taken == [5]
