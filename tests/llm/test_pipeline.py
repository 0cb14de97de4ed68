"""Stages of the corpus pipeline, each against its operator on the stage's own input."""

import corpus_pipeline as pipeline

from mnemoria.llm.copies import shingles
from mnemoria.llm.pii import base_spans
from mnemoria.llm.quality import quality
from mnemoria.llm.tokens import encode


def first_of_groups(rows):
    """Ids of the first of each group of texts that share four fifths of their 5-word shingles, by all pairs."""
    sets = {doc: set(shingles(text).tolist()) for doc, text in sorted(rows)}
    label = {doc: doc for doc in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {doc: low if own == high else own for doc, own in label.items()}
    return sorted(set(label.values()))


def test_stages(spark, small, documents):
    docs = documents
    columns = docs.columns
    kept = pipeline.quality_rules(spark, docs, small)
    assert kept.columns == columns
    want = {row["doc_id"] for row in quality(docs).where("kept").collect()}
    kept = kept.cache()
    assert {row["doc_id"] for row in kept.collect()} == want and kept.count() == len(want)
    one = pipeline.simhash_dedup(spark, kept, small).cache()
    assert one.columns == columns and sorted(row["doc_id"] for row in one.collect()) == first_of_groups([(row["doc_id"], row["text"]) for row in kept.collect()])
    clean = pipeline.personal_data(spark, one, small).cache()
    assert clean.columns == columns and clean.count() == one.count()
    assert not any(base_spans(row["text"]) for row in clean.collect())
    mixed = pipeline.source_mix(spark, clean, small).cache()
    assert mixed.columns == columns and {row["doc_id"] for row in mixed.collect()} <= {row["doc_id"] for row in clean.collect()}
    words = lambda rows: sum(len(row["text"].encode().split()) for row in rows)
    assert abs(words(mixed.collect()) - words(clean.collect())) <= 8
    packed = pipeline.packing(spark, mixed, small).collect()
    assert sum(row["length"] for row in packed) == sum(len(encode(row["text"], "byte_bpe_50k.json")) + 1 for row in mixed.collect())


def test_awkward_rows(spark, small, awkward, empty):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, small).collect() == []
        assert stage(spark, awkward, small).count() > 0
    one = pipeline.simhash_dedup(spark, awkward, small).collect()
    # Null, empty and blank texts are one group; so are the three rows of one text.
    assert sum(not (row["text"] or "").strip() for row in one) == 1
    assert sum((row["text"] or "").startswith("the quick brown fox") and row["text"].endswith("all. ") for row in one) == 1


def test_run(spark, small):
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "simhash_dedup", "pii", "source_mix", "packing"]
    assert pipeline.run(spark, small).count() > 0
