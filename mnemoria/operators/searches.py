"""Exact searches of many queries over all points, by cosine and by words.

Points and queries are packed into blocks, and every block of points meets every block of queries: a matrix product or sums of
marks for thousands of pairs at once. What leaves a pair of blocks is what can be among the best ``k`` of a query, so pairs are never written. Few
queries are sent to all tasks; many are met block by block, so neither side has to fit into a task or the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

# Numbers of a block of points, rows and bytes of one at most; numbers (or words) of queries that are sent to all tasks, and queries of a block.
NUMBERS, ROWS, BYTES, SENT, ASKED = 1 << 20, 1 << 14, 8 << 20, 1 << 22, 10_000
# Pairs that are compared at once, and marks of words held at once.
PAIRS, MARKS = 1 << 22, 1 << 26
# Scores count to nine digits: what lies so near below the k-th may be equal to it.
MARGIN = 2e-9


def blocks(rows: DataFrame, name: str, most: int = ROWS) -> DataFrame:
    """``rows``, some at a time, as lists of structs in the column ``name``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = max(1, min(most, BYTES * batch.num_rows // max(1, batch.nbytes)))
                for start in range(0, batch.num_rows, n):
                    part = pa.StructArray.from_arrays(batch.slice(start, n).columns, names=batch.schema.names)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], [name])

    return rows.mapInArrow(pack, T.StructType([T.StructField(name, T.ArrayType(rows.schema))]))


def each_pair(points: DataFrame, queries: DataFrame, n: int, size: int) -> DataFrame:
    """Every block of points with every block of ``n`` queries of ``size`` numbers each."""
    packed = blocks(queries.coalesce(1) if n <= ASKED else queries.repartition(-(-n // ASKED)), "q", ASKED)
    return points.crossJoin(F.broadcast(packed) if n * size <= SENT else written(packed, "search-queries").hint("shuffle_replicate_nl"))


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("p").slice(k, 1).flatten(), batch.column("q").slice(k, 1).flatten()


def by_length(rows: pa.StructArray, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of the rows, by the number of their dimensions."""
    vectors = rows.field(name)
    lengths = np.asarray(vectors.value_lengths())
    found = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        found[int(d)] = at, np.asarray(vectors.take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), d)
    return found


def summed(x: np.ndarray, y: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows, added in the order of the dimensions, as a fold over an array does."""
    total = np.zeros(len(of))
    for d in range(x.shape[1]):
        total += x[of, d] * y[to, d]
    return total


def lengths_of(x: np.ndarray) -> np.ndarray:
    every = np.arange(len(x))
    return np.sqrt(summed(x, x, every, every))


def best_pairs(x: np.ndarray, q: np.ndarray, ids: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``q`` with their cosine, for all that can be among the ``k`` best of a query; ties to the smaller of ``ids``."""
    with np.errstate(all="ignore"):
        nx, nq = lengths_of(x), lengths_of(q)

        def cosines(of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            length = nx[of] * nq[to]
            return summed(x, q, of, to) / length, (length > 0) | np.isnan(length)

        usual = lambda n: (n > 1e-100) & (n < 1e100)
        odd_x, odd_q = np.flatnonzero(~usual(nx)), ~usual(nq)
        ux = np.where(usual(nx)[:, None], x / nx[:, None], 0.0)
        step = max(1, PAIRS // len(x))
        for start in range(0, len(q), step):
            part = np.arange(start, min(start + step, len(q)))
            near = np.where(odd_q[part][:, None], 0.0, q[part] / nq[part][:, None]) @ ux.T
            # Lengths that are no usual numbers are left to the exact form: not a number is the first in order, no length is none.
            for rows, columns in ((np.arange(len(part)), odd_x), (np.flatnonzero(odd_q[part]), np.arange(len(x)))):
                if len(rows) and len(columns):
                    at, of = (m.ravel() for m in np.meshgrid(rows, columns, indexing="ij"))
                    score, there = cosines(of, part[at])
                    near[at, of] = np.where(there, np.where(np.isnan(score), np.inf, score), -np.inf)
            floor = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - MARGIN if len(x) > k else np.full(len(part), -np.inf)
            at, of = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
            to = part[at]
            score, there = cosines(of, to)
            of, to, score = of[there], to[there], score[there]
            yield (of, to, score) if len(of) <= 2 * k * len(part) else first_of_equal(of, to, score, ids, k)


def first_of_equal(of: np.ndarray, to: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal scores of a query, the ``k`` smallest ids: copies of a vector add no more than that."""
    names = np.array([x or "" for x in ids.to_pylist()], dtype=object)
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    value = np.where(np.isnan(score), np.inf, score)
    order = np.lexsort((place[of], value, to))
    of, to, score, value = of[order], to[order], score[order], value[order]
    begins = np.r_[True, (to[1:] != to[:-1]) | (value[1:] != value[:-1])]
    kept = np.arange(len(of)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] < k
    return of[kept], to[kept], score[kept]


def nearest(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", query: str = "q") -> DataFrame:
    """All pairs that can be among the ``k`` nearest points of a query, with their cosine as ``score``; the vectors are left out.

    ``points`` has ``memory_id``, by whose order ties are broken. A product of unit vectors tells the pairs that lie less than
    :data:`MARGIN` below the ``k``-th of a block; those are scored like :func:`~mnemoria.functions.vectors.cosine`, sum by sum.
    Points or queries with a null, with no vector, or of length 0 have no score and take no part.
    """
    whole = lambda rows, c: rows.withColumn(c, F.col(c).cast("array<double>")).where(F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull()))
    asked = written(whole(queries, query), "search-asked")
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size(query)), F.lit(0))).first()
    held = whole(points, vector)
    rows, long = held.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    # Vectors are small for the work that they make, so they are dealt out anew: a task gets about a block.
    parts = max(held.sparkSession.sparkContext.defaultParallelism, -(-rows * max(long, 1) // NUMBERS))
    pairs = each_pair(blocks(held.repartition(parts), "p"), asked, n, size)
    of_point = T.StructType([f for f in held.schema.fields if f.name != vector])
    of_query = T.StructType([f for f in asked.schema.fields if f.name != query])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q in pairs_of(batches):
            asked_by = by_length(q, query)
            for d, (at, x) in by_length(p, vector).items():
                if d in asked_by and d:
                    there, y = asked_by[d]
                    for of, to, found in best_pairs(x, y, p.field("memory_id").take(pa.array(at)), k):
                        of, to = pa.array(at[of]), pa.array(there[to])
                        columns = [*(p.field(f.name).take(of) for f in of_point.fields), *(q.field(f.name).take(to) for f in of_query.fields), pa.array(found)]
                        yield pa.RecordBatch.from_arrays(columns, [*of_point.names, *of_query.names, "score"])

    return pairs.mapInArrow(score, T.StructType([*of_point.fields, *of_query.fields, T.StructField("score", T.DoubleType())]))


class Tokens:
    """Which of many tokens, runs of ASCII letters and digits, a text in lower case contains anywhere.

    Such a token lies within one such run of the text, so runs are looked through once each, along the beginnings of tokens.
    """

    WORDS, KEPT = re.compile("[a-z0-9]+"), 1 << 17

    def __init__(self, tokens: list[str]) -> None:
        self.places = {token: place for place, token in enumerate(tokens)}
        self.heads = {token[:n] for token in self.places for n in range(1, len(token) + 1)}
        self.known: dict[str, tuple[int, ...]] = {}

    def within(self, word: str) -> tuple[int, ...]:
        found = set()
        for start in range(len(word)):
            end = start + 1
            while end <= len(word) and (part := word[start:end]) in self.heads:
                if part in self.places:
                    found.add(self.places[part])
                end += 1
        return tuple(found)

    def of(self, text: str) -> list[int]:
        found: set[int] = set()
        for word in set(self.WORDS.findall(text)):
            places = self.known.get(word)
            if places is None:
                places = self.within(word)
                if len(word) <= 64:
                    if len(self.known) >= self.KEPT:
                        self.known.clear()
                    self.known[word] = places
            found.update(places)
        return list(found)


def worded(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The points that can be among the ``k`` that contain most of a query's ``tokens``, with their number ``n``; ties to the smaller ``memory_id``.

    ``points`` has ``memory_id`` and ``low``, a text in lower case; ``tokens`` are distinct runs of ASCII letters and digits. Columns of the
    queries but ``tokens`` are kept. A text is looked through once for all queries of a block.
    """
    asked = written(queries, "search-asked")
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()
    pairs = each_pair(blocks(points.select("memory_id", F.coalesce("low", F.lit("")).alias("low")), "p"), asked, n, size)
    of_query = T.StructType([f for f in asked.schema.fields if f.name != "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = tokens = wanted = None
        for p, q in pairs_of(batches):
            if last is None or not q.equals(last):
                last, lists = q, q.field("tokens").to_pylist()
                tokens = Tokens(sorted({token for own in lists for token in own}))
                wanted = [np.array([tokens.places[token] for token in own]) for own in lists]
            step = max(1, MARKS // max(1, len(tokens.places)))
            for start in range(0, len(p), step):
                part = p.slice(start, step)
                texts, ids = part.field("low").to_pylist(), np.array(part.field("memory_id").to_pylist(), dtype=object)
                marks = np.zeros((len(tokens.places), len(texts)), dtype=np.uint8)
                for at, text in enumerate(texts):
                    marks[tokens.of(text), at] = 1
                late = np.empty(len(ids), dtype=np.int64)
                late[np.argsort(ids, kind="stable")[::-1]] = np.arange(len(ids))
                of, to, found = [], [], []
                for number, own in enumerate(wanted):
                    if len(own):
                        # Counts up to 255 stay bytes.
                        counts = marks[own].sum(axis=0, dtype=np.uint8 if len(own) < 256 else np.uint32)
                        at = np.flatnonzero(counts)
                        if len(at) > k:
                            order = counts[at].astype(np.int64) * len(ids) + late[at]
                            at = at[np.argpartition(order, len(at) - k)[len(at) - k :]]
                        of.append(at)
                        to.append(np.full(len(at), number))
                        found.append(counts[at].astype(np.int64))
                if of:
                    of, to = pa.array(np.concatenate(of)), pa.array(np.concatenate(to))
                    columns = [part.field("memory_id").take(of), *(q.field(f.name).take(to) for f in of_query.fields), pa.array(np.concatenate(found))]
                    yield pa.RecordBatch.from_arrays(columns, ["memory_id", *of_query.names, "n"])

    return pairs.mapInArrow(count, T.StructType([points.schema["memory_id"], *of_query.fields, T.StructField("n", T.LongType())]))
