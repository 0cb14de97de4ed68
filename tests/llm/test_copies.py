"""Near copies in the pipeline: planted edits against exact similarities."""

import random

import numpy as np

import corpus_pipeline as pipeline

from mnemoria.llm.copies import LEAST_PERCENT, close_pairs, shingles


def test_planted_edits(spark, small):
    """Copies with words changed go as far as their similarity is 0.8; others stay."""
    draw = random.Random(5)
    rows, want = [], set()
    for base in range(120):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        rows.append((1000 * base, " ".join(words)))
        want.add(1000 * base)
        for number, changed in enumerate((1, 3, 5, 6, 30), 1):
            edited = list(words)
            for at in draw.sample(range(300), changed):
                edited[at] = f"new{draw.randrange(10**9)}"
            a, b = set(shingles(" ".join(words)).tolist()), set(shingles(" ".join(edited)).tolist())
            rows.append((1000 * base + number, " ".join(edited)))
            if 100 * len(a & b) < LEAST_PERCENT * len(a | b):
                want.add(1000 * base + number)
    docs = spark.createDataFrame([(k, text, "en", "s", len(text)) for k, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {row["doc_id"] for row in pipeline.simhash_dedup(spark, docs, small).collect()} == want


def test_groups_of_several_tiles(spark, small, monkeypatch):
    """A chain of edits, each similar to the next only, is one group across tiles."""
    import mnemoria.llm.copies as copies

    monkeypatch.setattr(copies, "TILE", 4)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(30):
        words[6 * k] = f"new{k}"
        rows.append((k, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [row["doc_id"] for row in pipeline.simhash_dedup(spark, docs, small).collect()] == [0]
    assert len(close_pairs([shingles(row[1]) for row in rows], LEAST_PERCENT)) == 29


def test_candidates_are_links_of_simhashes(spark, small, monkeypatch):
    """Without links of fingerprints the stage finds nothing; pairs of just 0.8 link, of few shingles too, and unrelated ones do not."""
    import mnemoria.llm.copies as copies
    from mnemoria.llm.simhash import WIDE_BITS, WIDE_PAIRS, wide_fingerprint, wide_links

    rng, rows, plain = np.random.default_rng(7), [], {}
    for size, own in [(4, 0)] * 100 + [(16, 2)] * 100 + [(240, 30)] * 100:
        shared = rng.integers(0, 2**63, size, dtype=np.uint64)
        for side in (0, 1):
            extra = rng.integers(0, 2**63, (own or 1 - side), dtype=np.uint64)
            plain[len(rows)] = wide_fingerprint(np.concatenate((shared, extra)))
            rows.append((len(rows), plain[len(rows)].view(np.int64).tolist()))
    want = set()
    for a in plain:
        for b in range(a):
            one, two = plain[a].view(np.uint8), plain[b].view(np.uint8)
            if np.bitwise_count(plain[a][:2] ^ plain[b][:2]).sum() <= WIDE_BITS and any((one[list(p)] == two[list(p)]).all() for p in WIDE_PAIRS):
                want.add((b, a))
    got = {tuple(sorted(row)) for row in wide_links(spark.createDataFrame(rows, "node long, wide array<long>")).collect()}
    assert got == want == {(k, k + 1) for k in range(0, len(rows), 2)}
    docs = spark.createDataFrame([(k, " ".join(f"w{n}" for n in range(80 + k)), "en", "s", 1) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.simhash_dedup(spark, docs, small).count() == 1
    monkeypatch.setattr(copies, "wide_links", lambda prints: wide_links(prints.limit(0)))
    assert pipeline.simhash_dedup(spark, docs, small).count() == 3


def test_wide_lists_in_tiles(spark, monkeypatch):
    """A dense crowd in lists of several tiles, judged from a share, has the components of all its links."""
    from mnemoria.llm import simhash

    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = [(k, simhash.wide_fingerprint(np.concatenate((base, rng.integers(0, 2**63, 8, dtype=np.uint64)))).view(np.int64).tolist()) for k in range(150)]
    monkeypatch.setattr(simhash, "TILE", 16)
    labels = simhash.connected_components(simhash.wide_links(spark.createDataFrame(rows, "node long, wide array<long>")))
    assert {(row["id"], row["component"]) for row in labels.collect()} == {(k, 0) for k in range(150)}
