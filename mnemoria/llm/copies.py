"""Near copies by the Jaccard similarity of their word shingles, for stages that state a similarity.

A SimHash of 64 bits can't serve a similarity of 0.8: such pairs differ in about ten bits, and no
byte position is then sure to agree. Candidates are the links of wide SimHashes over the same
shingles, found in a byte-position index (``simhash.wide_links``), and each is verified on the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialize, shuffle_partitions
from .components import connected_components
from .simhash import wide_fingerprint, wide_links

SHINGLE_WORDS = 5
#: Least Jaccard similarity of a link, in per cent.
LEAST_PERCENT = 80
SEED = 42
#: Larger groups of candidates are cut into tiles of about this size; every two tiles meet in a task of their own.
TILE = 1024


def shingles(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, in order; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []  # ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - words_per_shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[at : at + words_per_shingle]), SEED) for at in range(n)), dtype=np.uint64, count=n))


def sketches(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """``(id, node, wide)``: equal ``node`` where shingle sets are equal; ``wide`` is their SimHash, null for the empty set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, words_per_shingle) for text in batch.column(1).to_pylist()]
            nodes = [int.from_bytes(hashlib.md5(found.tobytes(), usedforsecurity=False).digest()[:8], "big", signed=True) for found in sets]
            wide = [wide_fingerprint(found).view(np.int64) if len(found) else None for found in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(wide, pa.list_(pa.int64()))], names=[id_col, "node", "wide"])

    return docs.select(id_col, text_col).mapInArrow(measure, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, node long, wide array<long>")


def close_pairs(sets: list[np.ndarray], least_percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` that are similar enough."""
    n = len(sets)
    sizes = np.array([len(found) for found in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(n), sizes)[np.argsort(at, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(every)))))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    label, pairs = np.arange(n), []
    for i in range(n):
        other = label != label[i]
        if not other.any():
            break
        mine = at[bounds[i] : bounds[i + 1]]
        shared = np.bincount(np.concatenate([owners[starts[k] : starts[k + 1]] for k in mine.tolist()]), minlength=n)
        close = np.flatnonzero(other & (100 * shared >= least_percent * (sizes[i] + sizes - shared)))
        for j in close.tolist():
            if label[j] != label[i]:
                pairs.append((i, j))
                label[label == label[j]] = label[i]
    return pairs


def verified(members: DataFrame, words_per_shingle: int, least_percent: int) -> DataFrame:
    """``(a, b)`` over the nodes of ``members(g, node, text)``: links within each group ``g``, read one group at a time."""
    dealt = members.repartition(shuffle_partitions(members.sparkSession), "g").sortWithinPartitions("g")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(nodes: list[int], texts: list[str]) -> pa.RecordBatch:
            pairs = close_pairs([shingles(text, words_per_shingle) for text in texts], least_percent) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], names=["a", "b"])

        group, nodes, texts = None, [], []
        for batch in batches:
            for g, node, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if g != group:
                    yield linked(nodes, texts)
                    group, nodes, texts = g, [], []
                nodes.append(node)
                texts.append(text)
        yield linked(nodes, texts)

    return dealt.select("g", "node", "text").mapInArrow(meet, "a long, b long").distinct()


def near_copies(docs: DataFrame, least_percent: int = LEAST_PERCENT, words_per_shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id``: a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at least ``least_percent`` similarity.
    Texts of one shingle set are one vertex. Null, empty and blank texts have the empty set and link
    only to each other; a null id takes part in no minimum unless all ids of its component are null;
    an empty table gives an empty one; other columns are ignored.
    """
    marked = materialize(sketches(docs, id_col, text_col, words_per_shingle), "copies")
    nodes = materialize(marked.groupBy("node").agg(F.min(id_col).alias("least"), F.first("wide").alias("wide")), "copies-distinct")
    groups = connected_components(wide_links(nodes.where(F.col("wide").isNotNull()).select("node", "wide")), "copies-groups")
    # Every link of fingerprints lies in one group, so a text is sent to its group only.
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64(F.col("id")), F.col("tiles")).cast("int")
    placed = groups.join(sizes, "component").withColumn("own", own).withColumn("third", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = placed.select(F.xxhash64("component", F.least("own", "third"), F.greatest("own", "third")).alias("g"), F.col("id").alias("node"))
    chosen = nodes.where(F.col("least").isNotNull()).select("node", F.col("least").alias(id_col))
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(chosen, id_col).dropDuplicates(["node"]).select("node", "text")
    labels = connected_components(verified(tiled.join(texts, "node"), words_per_shingle, least_percent), "copies-components")
    of_node = nodes.select("node", "least").join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(of_node.join(smallest, "component").select("node", "component_id"), "copies-classes")
    return join_by_key(marked.select(id_col, "node"), classes, "node").select(id_col, "component_id")
