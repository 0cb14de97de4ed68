"""Rejection of documents that are extreme in one statistic only."""

from collections import defaultdict

import numpy as np
import pytest

from mnemoria.llm.quality import chi_square_quantile, least_spreads, quality, text_statistics, transformed


def test_quantiles_are_exact():
    """Against published values for five degrees of freedom."""
    for p, want in ((0.5, 4.3515), (0.975, 12.8325), (0.99, 15.0863), (0.999, 20.5150)):
        assert chi_square_quantile(p) == pytest.approx(want, abs=1e-4)


def test_one_extreme_statistic_rejects(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    long_words = ["".join(rng.choice(list("abcdefghij"), rng.integers(6, 11))) for _ in range(3000)]

    def text(n, pool=words):
        lines = [" ".join(rng.choice(pool, 20)) for _ in range(max(n // 20, 1))]
        return "\n".join(lines)

    rows = [(k, text(int(rng.integers(150, 300)))) for k in range(400)]
    symbols = text(220).split(" ")
    symbols[:12] = ["&" + word for word in symbols[:12]]  # about 5 in 100 words
    rows.append((1000, " ".join(symbols)))
    short = "\n".join(f"{a} {b}" for a, b in zip(*[iter(text(200).split()[:40])] * 2, strict=False))
    rows.append((1001, text(200) + "\n" + short + "\n" + "\n".join(["ab"] * 40)))  # repeated lines
    rows.append((1002, text(220, long_words)))  # words 1.5 times as long
    rows.append((1003, text(20000)))  # a length of about 90 times the centre's
    found = {row["doc_id"]: row["kept"] for row in quality(spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert [found[k] for k in range(1000, 1004)] == [False] * 4
    assert sum(found[k] for k in range(400)) >= 396


def plain_estimate(x, spreads):
    """Mean and inverse scatter, with no direction below the noise."""
    noise = np.outer(spreads, spreads)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(len(spreads), -1) / noise)
    return x.mean(0), (axes * np.maximum(values, 1)) @ axes.T * noise


def squared(x, centre, scatter):
    return np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter), x - centre)


def plain_distances(x, spreads, bins=16):
    """Minimum covariance determinant of one group held in memory; nearest three quarters to a bin of the distance, or exactly without bins."""
    cell = np.floor(x * 64)
    middle = np.sort(cell, axis=0)[(len(x) - 1) // 2]
    away = np.sort(np.abs(cell - middle), axis=0)[(len(x) - 1) // 2]
    noise = np.outer(spreads, spreads)
    values, axes = np.linalg.eigh(np.diag((1.4826 * away / 64) ** 2) / noise)
    starts = [plain_estimate(x, spreads), ((middle + 0.5) / 64, (axes * np.maximum(values, 1)) @ axes.T * noise)]
    level = lambda d: np.floor(np.log2(d + 2.0**-20) * bins) if bins else d
    ends = []
    for start in starts:
        for _ in range(4):
            far = level(squared(x, *start))
            start = plain_estimate(x[far <= np.sort(far)[int(np.ceil(0.75 * len(x))) - 1]], spreads)
        ends.append(start)
    best = min(ends, key=lambda end: np.linalg.slogdet(end[1])[1])
    d = squared(x, *best)
    half = np.sort(level(d))[int(np.ceil(len(x) / 2)) - 1]
    scale = (2 ** ((half + 1) / bins) if bins else half) / chi_square_quantile(0.5)
    return squared(x, *plain_estimate(x[d <= max(scale, 1) * chi_square_quantile(0.975)], spreads))


def test_verdicts_against_brute_force(documents):
    """Every verdict, by groups held in memory: the same with bins of the distance, and nearly the same without."""
    rows = {row["doc_id"]: row for row in documents.collect()}
    got = {row["doc_id"]: row for row in quality(documents, least_group=12).collect()}
    passed = {doc: text_statistics(rows[doc]["text"]) for doc, row in got.items() if not row["base_failed"]}
    spreads = least_spreads(*(np.exp(np.mean([np.log(f(own)) for own in passed.values()])) for f in (lambda own: 1 + own[0], lambda own: max(own[1], 1), lambda own: max(own[5], 1))))
    groups = defaultdict(list)
    for doc in passed:
        groups[rows[doc]["lang"], rows[doc]["source"]].append(doc)
    small = {key: own for key, own in groups.items() if len(own) < 12}
    pools = defaultdict(list)
    for (lang, _), own in small.items():
        pools[lang] += own
    whole = [own for key, own in groups.items() if key not in small] + [own for own in pools.values() if len(own) >= 12]
    rest = [doc for own in pools.values() if len(own) < 12 for doc in own]
    same = total = 0
    for own in [*whole, rest] if rest else whole:
        x = np.array([transformed(*passed[doc]) for doc in own])
        cut = chi_square_quantile(0.999)
        for doc, d, exact in zip(own, plain_distances(x, spreads), plain_distances(x, spreads, 0)):
            assert got[doc]["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9) and got[doc]["kept"] == (d <= cut)
            same, total = same + (got[doc]["kept"] == (exact <= cut)), total + 1
    assert same >= 0.97 * total and len(whole) > 1
    assert not any(row["kept"] for row in got.values() if row["base_failed"])
