"""Operator 3: approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one codeword from each of several codebooks, all of the full
dimension. Codes come from a beam search over the codebooks, the squared norm of each sum is stored,
and a query scores codes by looking up its products with the codewords. The best are then ranked
again by the exact distance.

How many that takes depends on the data: vectors nearer to each other than their codes are to them
can't be told apart by codes. So the index also holds the distance of each vector from its sum. By the
triangle inequality a vector is no nearer than its sum less that distance, and whatever this bound
does not rule out is ranked exactly. A stated number of codes may be ranked instead, without that promise.

Queries and index are dealt to the cells of a grid, so every query meets every code once. A cell
takes its queries into memory, a bounded number, and lets the codes stream past; it keeps the best of
each query and sends on nothing else. Neither queries nor results pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, materialize, shuffle_partitions

#: Codebooks, codewords in each, and states kept by the beam search.
BOOKS, WORDS, BEAM = 64, 64, 4
#: The codebooks are fitted on at most so many vectors, those of the least hash of their id.
SAMPLE = 8192
#: Queries of a cell at most, codes that make a cell of their own, and queries scored together.
CELL_QUERIES, CELL_CODES, CHUNK = 1 << 16, 1 << 13, 64
SALTS = 16
#: The id of no vector: a query that has met fewer than it asks for.
NONE = np.iinfo(np.int64).max
#: Exact distances taken at once, and what rounding may add to a squared lookup distance, relative to both squared norms.
PAIRS, ROUNDING = 1 << 14, 1e-11


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # books x words x dimension
    centre: np.ndarray | float = 0.0

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes by beam search over the books, ``len(x) x books``."""
        n, (books, size, _) = len(x), self.words.shape
        if n == 0:
            return np.zeros((0, books), dtype=np.uint8)
        rest = (x - self.centre)[:, None, :]  # states of each vector: what is left of it
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        rows = np.arange(n)[:, None]
        for words in self.words:
            loss = (rest**2).sum(2)[:, :, None] - 2 * rest @ words.T + (words**2).sum(1)
            flat = loss.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            state, word = best // size, best % size
            rest = rest[rows, state] - words[word]
            codes = np.concatenate((codes[rows, state], word[:, :, None].astype(np.uint8)), axis=2)
        return codes[np.arange(n), (rest**2).sum(2).argmin(1)]

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return sum(words[codes[:, k]] for k, words in enumerate(self.words))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.sums(codes) + self.centre


def lloyd(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=len(x) < size)]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(own, minlength=size)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(len(x), size=size)])
    return centres


def train(x: np.ndarray, books: int = BOOKS, size: int = WORDS, rounds: int = 2, seed: int = 42) -> Codebooks:
    """Residual k-means around the mean, then least squares for all codebooks together and new codes, in turn."""
    centre = x.mean(axis=0)
    x = x - centre
    rng, rest, words = np.random.default_rng(seed), x, []
    size = max(1, min(size, len(x)))
    for _ in range(books):
        centres = lloyd(rest, size, rng)
        rest = rest - centres[((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)]
        words.append(centres)
    found = Codebooks(np.array(words))
    for _ in range(rounds):
        codes = found.encode(x) + np.arange(books) * size
        gram, right = np.zeros((books * size, books * size)), np.zeros((books * size, x.shape[1]))
        for k in range(books):
            np.add.at(right, codes[:, k], x)
            for other in range(books):
                met = np.bincount((codes[:, k] - k * size) * size + codes[:, other] - other * size, minlength=size * size)
                gram[k * size : (k + 1) * size, other * size : (other + 1) * size] = met.reshape(size, size)
        gram[np.diag_indices_from(gram)] += 0.1
        # Unused codewords keep their place: the small ridge pulls towards the old ones.
        solved = np.linalg.solve(gram, right + 0.1 * found.words.reshape(books * size, -1))
        found = Codebooks(solved.reshape(found.words.shape))
    return Codebooks(found.words, centre)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v array<double>, key)`` without null, zero and non-finite vectors or null ids.

    Shorter vectors go on with zeros up to the longest, so vectors of all lengths have a distance. Equal
    vectors have one ``key``, 128 bits.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat(F.transform("v", lambda x: x + F.lit(0.0)), F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    return rows.select("vec_id", padded.alias("v")).withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``(class_id, v, members)``: each different vector once, with its ``k + 1`` smallest ids, the first of which names it.

    No query needs more of them. A vector may hold a third of all rows, so the ids are first cut
    for each of several salts.
    """
    salted = rows.select("key", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    members = few.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("members"))
    once = rows.groupBy("key").agg(F.first("v").alias("v"))
    return once.join(members, "key").select(F.get("members", F.lit(0)).alias("class_id"), "v", "members")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def fixed(column: pa.Array, dtype: type) -> np.ndarray:
    """Equally long byte strings as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def build_index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, data, norm, error, vector)``: the codes of every vector of ``(class_id, v)``, the squared norm of their sum, its distance from the vector, and the vector."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                codes = np.concatenate([books.encode(x[at : at + 1024]) for at in range(0, len(x), 1024)])
                sums = books.sums(codes)
                norms, errors = (sums**2).sum(1), np.sqrt(((x - books.centre - sums) ** 2).sum(1))
                held = [pa.array([row.tobytes() for row in part], pa.binary()) for part in (codes, x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), held[0], pa.array(norms), pa.array(errors), held[1]], names=["id", "data", "norm", "error", "vector"])

    return rows.select("class_id", "v").mapInArrow(encode, "id long, data binary, norm double, error double, vector binary")


class Best:
    """The codes of the best scores of each query so far."""

    def __init__(self, queries: int, most: int) -> None:
        self.scores, self.ids, self.most = np.full((queries, most), np.inf), np.full((queries, most), NONE), most

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``at`` on, a row each, of the codes ``ids``."""
        n = len(scores)
        if scores.shape[1] > self.most:
            near = np.argpartition(scores, self.most - 1, axis=1)[:, : self.most]
            scores, ids = np.take_along_axis(scores, near, 1), ids[near]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        scores, ids = np.concatenate((self.scores[at : at + n], scores), axis=1), np.concatenate((self.ids[at : at + n], ids), axis=1)
        near = np.argpartition(scores, self.most - 1, axis=1)[:, : self.most]
        self.scores[at : at + n], self.ids[at : at + n] = np.take_along_axis(scores, near, 1), np.take_along_axis(ids, near, 1)


class Nearest:
    """The nearest vectors of each query so far by exact distance, ties to the smaller id; ``pairs`` counts the distances taken."""

    def __init__(self, queries: int, most: int) -> None:
        self.scores, self.ids, self.most, self.pairs = np.full((queries, most), np.inf), np.full((queries, most), NONE), most, 0

    def rank(self, q: np.ndarray, at: int, n: int, rows: np.ndarray, places: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Take in ``x[places]`` for the queries ``at + rows``, of ``n`` from ``at`` on."""
        self.pairs += len(rows)
        for start in range(0, len(rows), PAIRS):
            row, place = rows[start : start + PAIRS], places[start : start + PAIRS]
            score, own = np.sqrt(((x[place] - q[at + row]) ** 2).sum(1)), ids[place]
            near = ~(score > self.scores[at + row, -1])
            row = np.concatenate((np.repeat(np.arange(n), self.most), row[near]))
            score, own = np.concatenate((self.scores[at : at + n].ravel(), score[near])), np.concatenate((self.ids[at : at + n].ravel(), own[near]))
            order = np.lexsort((own, score, row))
            first = np.searchsorted(row[order], np.arange(n))
            best = order[first[:, None] + np.arange(self.most)]
            self.scores[at : at + n], self.ids[at : at + n] = score[best], own[best]

    def add(self, q: np.ndarray, at: int, squared: np.ndarray, slack: np.ndarray, errors: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """The vectors ``x`` by the squared distances of their sums from the queries from ``at`` on: the best codes first, then what the bound leaves."""
        n = len(squared)
        few = min(self.most, squared.shape[1])
        first = np.argpartition(squared, few - 1, axis=1)[:, :few]
        self.rank(q, at, n, np.repeat(np.arange(n), few), first.ravel(), x, ids)
        least = np.sqrt(np.maximum(squared - slack, 0)) - errors * (1 + ROUNDING)
        left = ~(least > self.scores[at : at + n, -1:] * (1 + ROUNDING))  # NaN of overflowing norms rules nothing out
        np.put_along_axis(left, first, False, 1)
        self.rank(q, at, n, *np.nonzero(left), x, ids)


def scored(queries: DataFrame, index: DataFrame, books: Codebooks, n_queries: int, most: int, exact: bool) -> DataFrame:
    """``(q, class_id, near)``: in each cell the ``most`` best of every query, by exact distance or by the lookup score alone.

    ``queries`` is ``(q, v)``. Cells are ``columns`` groups of queries by ``rows`` groups of codes, of which there are as
    many as the codes fill and no more than keep all partitions busy: what leaves a cell is ``most`` rows a query.
    """
    parts = shuffle_partitions(index.sparkSession)
    columns = max(1, math.ceil(n_queries / CELL_QUERIES))
    rows = max(1, min(math.ceil(index.count() / CELL_CODES), math.ceil(parts / columns)))

    def cells(own: Column, others: int, cell: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda other: F.struct(cell(own, other).alias("cell")))).alias("c")

    group = F.pmod(F.xxhash64("id"), F.lit(columns))
    no = F.lit(0.0)
    data = queries.select(F.col("q").alias("id"), F.lit(0).alias("kind"), "data", no.alias("norm"), no.alias("error"), F.lit(None).cast("binary").alias("vector"))
    asked = data.select(cells(group, rows, lambda own, other: own * rows + other), "kind", "id", "data", "norm", "error", "vector")
    coded = index.withColumn("kind", F.lit(1)).select(cells(F.pmod(F.xxhash64("id"), F.lit(rows)), columns, lambda own, other: other * rows + own), "kind", "id", "data", "norm", "error", "vector" if exact else F.lit(None).cast("binary").alias("vector"))
    # Queries of a cell come first.
    dealt = asked.unionByName(coded).select("c.cell", "kind", "id", "data", "norm", "error", "vector").repartition(parts, "cell").sortWithinPartitions("cell", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, parts_q, best = None, [], [], None

        def found() -> Iterator[pa.RecordBatch]:
            if best is not None:
                for at in range(0, len(ids), 4096):
                    fine = best.ids[at : at + 4096] != NONE
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 4096], fine.sum(1))), pa.array(best.ids[at : at + 4096][fine]), pa.array(best.scores[at : at + 4096][fine].astype(np.float64))], names=["q", "class_id", "near"])

        for batch in batches:
            cells_of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((cells_of[1:] != cells_of[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                if cells_of[start] != cell:
                    yield from found()
                    cell, ids, parts_q, best = cells_of[start], [], [], None
                part = batch.slice(start, end - start)
                own = part.column(2).to_numpy()
                if kinds[start] == 0:
                    ids.append(own)
                    parts_q.append(fixed(part.column(3), np.float64))
                    continue
                if not len(ids):
                    continue
                if best is None:
                    ids, q = np.concatenate(ids), np.concatenate(parts_q)
                    best = Nearest(len(ids), most) if exact else Best(len(ids), most)
                codes, norms, errors = fixed(part.column(3), np.uint8), part.column(4).to_numpy(), part.column(5).to_numpy()
                x = fixed(part.column(6), np.float64) if exact else None
                for at in range(0, len(ids), CHUNK):
                    some = q[at : at + CHUNK] - books.centre
                    squares = (some**2).sum(1)[:, None]
                    lookup = np.einsum("qd,bwd->bqw", some, books.words, optimize=True)
                    score = squares + norms
                    for b, table in enumerate(lookup):
                        score -= 2 * table[:, codes[:, b]]
                    if exact:
                        best.add(q, at, score, ROUNDING * (squares + norms), errors, x, own)
                    else:
                        best.add(at, score, own)
        yield from found()

    return dealt.mapInArrow(scan, "q long, class_id long, near double")


def packed(rows: DataFrame) -> DataFrame:
    """``(q, data)``: the vectors of ``(q, v)`` as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in matrix(batch.column(1))], pa.binary())], names=["q", "data"])

    return rows.select("q", "v").mapInArrow(pack, "q long, data binary")


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, rerank: int | None = None, books: Codebooks | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row whose id is divisible by ``every``.

    Nearness is the Euclidean distance in double precision, ties to the smaller id. Every usable
    vector is indexed, equal vectors once, and equal queries are searched once; the codebooks are fitted on at
    most ``sample`` vectors, those of the least hash of their id. What the bounds of the codes do not rule out is ranked
    by the exact distance, so nothing nearer is missed, whatever the data; worse codes only cost time. With
    ``rerank``, so many codes of the least scores in the whole index are ranked instead, and the result is approximate.

    Null, zero and non-finite vectors and null ids take no part; shorter vectors go on with zeros;
    rows repeated as they are count once, of an id with several vectors the nearest counts; an empty table gives no
    rows; other columns are ignored. With fewer than ``k`` others, all are returned.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    drawn = rows.select("v", F.xxhash64(F.lit(7), "vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = books or train(np.array([row["v"] for row in drawn]))
    distinct = materialize(classes(rows, k), "vector-classes")
    index = materialize(build_index(distinct, books), "additive-index")
    asked = materialize(rows.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id"), "v").distinct(), "vector-queries")
    queries = materialize(asked.groupBy("key").agg(F.min("query_id").alias("q"), F.first("v").alias("v")), "vector-query-classes")
    # An id with several vectors takes a place for each.
    vectors_an_id = rows.groupBy("vec_id").agg(F.count_distinct("key").alias("n")).agg(F.max("n")).first()[0]
    most = rerank or (k + 1) * vectors_an_id
    found = scored(packed(queries), index, books, queries.count(), most, rerank is None)
    place = F.row_number().over(Window.partitionBy("q").orderBy("near", "class_id"))
    chosen = found.withColumn("place", place).where(F.col("place") <= most).select("q", "class_id")
    met = chosen.join(queries.select("q", F.col("v").alias("w")), "q").join(distinct, "class_id")
    exact = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x))
    near = met.select("q", exact.alias("score"), F.explode("members").alias("vec_id")).groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    # One more than asked for: a query may find itself.
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    lists = materialize(queries.select("key", "q").join(lists, "q").select("key", "near"), "vector-lists")
    own = join_by_key(asked.select("key", "query_id"), lists, "key")
    others = own.select("query_id", F.explode("near").alias("n")).where("n.vec_id <> query_id").groupBy("query_id", "n.vec_id").agg(F.min("n.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
