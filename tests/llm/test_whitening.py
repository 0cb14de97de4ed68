"""Whitening against exact rational arithmetic held in memory."""

import math
from fractions import Fraction

import numpy as np
import pytest

from mnemoria.llm import whitening
from mnemoria.llm.queries import op11_whitening
from mnemoria.llm.whitening import primes, reconstructed, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def plain(vectors):
    """``n``, deviations, and covariance of the vectors by plain integers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[k] for row in x) for k in range(d)]
    centred = [[n * row[k] - sums[k] for k in range(d)] for row in x]
    cov = np.array([[float(Fraction(sum(row[i] * row[j] for row in centred), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum(c * c for c in row) for row in centred], cov, np.array([[float(Fraction(c, n)) for c in row] for row in centred])


def hold(found, vectors, ids, components):
    n, deviations, cov, centred = plain(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for row in found:
        by.setdefault(row["vec_id"], {}).setdefault(row["component"], []).append(row)
    assert sorted(by, key=str) == sorted(set(ids), key=str)
    white = np.array([[by[vec_id][k + 1][0]["whitened"] for k in range(components)] for vec_id in ids])
    for vec_id, deviation in zip(ids, deviations, strict=True):
        for k in range(components):
            row = by[vec_id][k + 1][0]
            assert (row["n"], row["deviation"]) == (n, deviation)
            assert row["explained"] == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
            assert row["identity_error"] < 1e-9
    want = centred @ axes[:, :components] / np.sqrt(values[:components])
    signs = np.sign((want * white).sum(0))
    assert np.allclose(want * signs, white, rtol=1e-8, atol=1e-8)


def test_all_vectors_of_the_table(spark, small):
    rows = [row for row in spark.read.parquet(f"{small}/embeddings.parquet").collect() if row["embedding"] is not None]
    hold(op11_whitening(spark, small).collect(), [row["embedding"] for row in rows], [row["vec_id"] for row in rows], 32)


def test_many_partitions_and_tiles(spark, monkeypatch):
    """Tiles smaller than the matrix, blocks smaller than a partition, values of both signs and very different sizes."""
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 7)) * [1, 3, 40, 0.5, 20, 100, 4] + rng.normal(size=7)).astype(np.float32)
    monkeypatch.setattr(whitening, "TILE", 3)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    table = spark.createDataFrame([(k, v.tolist(), 0, "x") for k, v in enumerate(vectors)], SCHEMA).repartition(9)
    hold(whitened(table).collect(), vectors.tolist(), list(range(300)), 7)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 2.0, -1.0]), (2, [0.5, -4.0, 3.0]), (2, [0.5, -4.0, 3.0]), (3, None), (4, [1.0, None, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 0.0, 0.0]), (None, [9.0, 1.0, 0.0]), (7, []), (8, [7.0]), (9, [1e30, 0.0, 0.0])]
    found = whitened(spark.createDataFrame([(k, v, 0, "x") for k, v in rows], SCHEMA).repartition(3)).collect()
    kept = [(k, v + [0.0] * (3 - len(v))) for k, v in rows if k not in (3, 4, 5, 6, 9)]
    assert len(found) == 3 * len(kept)
    hold(found, [v for _, v in kept], [k for k, _ in kept], 3)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0], 0, "x") for k in range(3)], SCHEMA)
    assert {(row["whitened"], row["deviation"], row["explained"], row["identity_error"]) for row in whitened(same).collect()} == {(None, 0, 0.0, 0.0)}
    flat = spark.createDataFrame([(k, [float(k), 2.0], 0, "x") for k in range(4)], SCHEMA)
    assert {(row["component"], row["whitened"] is None) for row in whitened(flat).collect()} == {(1, False), (2, True)}
    assert whitened(same.limit(0)).collect() == [] and whitened(spark.createDataFrame([(1, [], 0, "x"), (2, None, 0, "x")], SCHEMA)).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(k, [1e12 * (-1) ** k, float(k)], 0, "x") for k in range(64)]
    found = whitened(spark.createDataFrame(rows, SCHEMA)).where("component = 1").orderBy("vec_id").collect()
    want = plain([v for _, v, _, _ in rows])[1]
    assert [row["deviation"] for row in found] == [None] * 64 and [int(row["deviation_text"]) for row in found] == want


def test_remainders():
    numbers = [0, 1, -1, 10**40, -(10**40) + 7, 2**130]
    moduli = primes(2 * max(map(abs, numbers)) + 1)
    assert reconstructed([np.array([value % p for value in numbers]) for p in moduli], moduli).tolist() == numbers
