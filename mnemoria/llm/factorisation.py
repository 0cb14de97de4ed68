"""Operator 13: a quality classifier, a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector ``x``: its words in hashed buckets, each structure statistic with its range, and the
range of its metadata. Its score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which is the sum over all pairs ``<v_i, v_j> x_i x_j`` in linear time. Tasks take the features of whole texts and score
them; only the features of a bounded sample of labelled rows come to the driver, where the machine is fitted.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import text_statistics

#: Buckets of words, ranges of each statistic, and latent factors.
BUCKETS, RANGES, FACTORS = 1 << 14, 12, 8
#: Labelled rows that the machine is fitted on; those of the smallest hashes of their ids.
SAMPLE = 12_000
EPOCHS, BATCH, RATE, PENALTY = 12, 256, 0.05, 1e-5
THRESHOLD, FOLDS = 0.3, 5

STATISTICS = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "line_words", "distinct_words", "upper", "digits", "marks", "long_words", "short_lines", "top_word", "log_metadata")
MARKS = b"!?"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def structure(text: str, n_chars: int | None) -> tuple[list[float], Counter]:
    """The statistics of a whole text with its metadata, and the counts of its words in lower case."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines = text_statistics(text)
    data = text.encode()
    words = Counter(data.lower().split())
    per = max(n_words, 1)
    size = max(len(data), 1)
    share = lambda kinds: (len(data) - len(data.translate(None, kinds))) / size
    lines = data.split(b"\n") if data else []
    return [
        math.log1p(n_words), word_chars / per, n_symbols / per, n_dup_lines / max(n_lines, 1), n_repeat_words / per, math.log1p(n_words / max(n_lines, 1)),
        len(words) / per, share(UPPER), share(DIGITS), share(MARKS), sum(n for word, n in words.items() if len(word) > 20) / per,
        sum(len(line) < 20 for line in lines) / max(len(lines), 1), max(words.values(), default=0) / per, -1.0 if n_chars is None else math.log1p(max(n_chars, 0)),
    ], words


def word_features(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the logarithms of the counts, as a vector of length 1."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets = np.fromiter((zlib.crc32(word) for word in words), np.int64, len(words)) % BUCKETS
    values = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    order = np.argsort(buckets, kind="stable")
    buckets, values = buckets[order], values[order]
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    values = np.add.reduceat(values, starts)
    return buckets[starts].astype(np.int32), (values / np.sqrt((values**2).sum())).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """Weights and factors of all features, and the bounds of the statistics' ranges."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray  # features x factors
    bounds: np.ndarray  # statistics x (RANGES - 1)

    def features(self, stats: list[float], buckets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values: the words, then one range of each statistic."""
        ranges = BUCKETS + np.arange(len(stats)) * RANGES + (np.asarray(stats)[:, None] > self.bounds).sum(1)
        return np.append(buckets, ranges), np.append(values, np.ones(len(stats), np.float32))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each row holds a range for every statistic, so no row is empty."""
        index, value, starts = flattened(rows)
        linear = np.add.reduceat(self.weights[index] * value, starts)
        weighted = self.factors[index] * value[:, None]
        pairs = (np.add.reduceat(weighted, starts) ** 2 - np.add.reduceat(weighted**2, starts)).sum(1) / 2
        return logistic(self.bias + linear + pairs)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def flattened(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(index) for index, _ in rows]
    return np.concatenate([index for index, _ in rows]), np.concatenate([value for _, value in rows]).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss by adaptive gradient steps over shuffled batches; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS) * RANGES
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    bounds = np.quantile(stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0, method="lower").T if len(stats) else np.zeros((len(STATISTICS), RANGES - 1))
    start = Machine(float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), bounds)
    if len(np.unique(labels)) < 2:
        return Machine(start.bias, start.weights, np.zeros((size, FACTORS)), bounds)
    rows = [start.features(list(s), *w) for s, w in zip(stats, words, strict=True)]
    bias, weights, factors = start.bias, start.weights, start.factors
    seen, seen_w, seen_v = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = order[at : at + BATCH]
            index, value, starts = flattened([rows[k] for k in batch])
            lengths = np.diff(np.append(starts, len(index)))
            weighted = factors[index] * value[:, None]
            sums = np.add.reduceat(weighted, starts)
            z = bias + np.add.reduceat(weights[index] * value, starts) + (sums**2 - np.add.reduceat(weighted**2, starts)).sum(1) / 2
            error = np.repeat((logistic(z) - labels[batch]) / len(batch), lengths)
            used, place = np.unique(index, return_inverse=True)
            step_w = np.bincount(place, error * value, len(used)) + PENALTY * weights[used]
            moved = (error * value)[:, None] * (np.repeat(sums, lengths, axis=0) - weighted)
            step_v = np.stack([np.bincount(place, moved[:, f], len(used)) for f in range(FACTORS)], axis=1) + PENALTY * factors[used]
            step = error[starts].sum()
            seen += step**2
            seen_w[used] += step_w**2
            seen_v[used] += step_v**2
            bias -= RATE * step / math.sqrt(seen)
            weights[used] -= RATE * step_w / np.sqrt(seen_w[used])
            factors[used] -= RATE * step_v / np.sqrt(seen_v[used])
    return Machine(float(bias), weights, factors, bounds)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fitted on ``sample`` labelled rows outside the held-out fold at most; fewer if there are fewer.

    A label without an id or a quality is none; an id with several labels or several texts is learned from once for each pair.
    """
    # Labels are narrow; the sample is chosen among them before any text is read.
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)").where(~held_out("id"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    met = docs.select(F.col("doc_id").alias("id"), "text", "n_chars").join(F.broadcast(chosen), "id")  # at most `sample` rows of two numbers

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [structure(text or "", n) for text, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            words = [word_features(found) for _, found in rows]
            columns = [pa.array([stats for stats, _ in rows], pa.list_(pa.float64())), pa.array([b.tobytes() for b, _ in words], pa.binary()), pa.array([v.tobytes() for _, v in words], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], names=["id", "stats", "buckets", "vals", "quality"])

    taken = met.select(F.col("id").cast("long"), F.col("text"), F.col("n_chars").cast("long"), "quality").mapInArrow(take, "id long, stats array<double>, buckets binary, vals binary, quality int")
    # Rows of one id with many texts would be more than the sample; the limit holds for them too.
    rows = taken.orderBy(F.xxhash64("id"), "id", "quality", F.xxhash64("buckets", "vals"), "buckets").limit(sample).collect()
    words = [(np.frombuffer(row["buckets"], np.int32), np.frombuffer(row["vals"], np.float32)) for row in rows]
    return fit(np.array([row["stats"] for row in rows]).reshape(-1, len(STATISTICS)), words, np.array([row["quality"] for row in rows], np.float64))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Labels, language, source and id are no inputs of a score. Null and empty texts are scored by their (zero) statistics
    and their metadata, which may be null; very long texts are read whole; repeated rows have equal scores; a null id is in no fold and
    is not learned from; without labels all scores are 0.5. An empty table gives no rows; other columns are ignored. One pass, no
    shuffle of documents; a task holds the texts of one Arrow batch.
    """
    machine = learned(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = (structure(text or "", n) for text, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
                scores = machine.scores([machine.features(stats, *word_features(words)) for stats, words in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
