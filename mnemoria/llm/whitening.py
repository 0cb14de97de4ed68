"""Operator 11: embedding whitening over an exact scatter matrix, summed in a residue number system.

Entries become integers ``x = floor(64 c) + 1000000``. Their scatter ``sum (n x - S)(n x - S)'`` is an
integer matrix too large for 64 bits. Each partition multiplies its vectors modulo several primes below
2^20, where a block of 4,096 products adds up exactly in doubles, so each modular product is a plain matrix
product of the numeric library. The residues are summed over the partitions, and the Chinese remainder
theorem gives the exact integers, whatever the order of the sums. Only then is anything rounded: to doubles, for
the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no place in 64 bits times a block, and count as not finite.
LIMIT = float(1 << 44)
#: Rows of a block and the bound of the primes: ``BLOCK * PRIMES_BELOW ** 2`` is below 2^53.
BLOCK, PRIMES_BELOW = 4096, 1 << 20
#: Rows and columns of a tile of the scatter matrix.
TILE = 256
#: Parts in which the partial sums of partitions meet first.
SALTS = 64
COMPONENTS = 32


def remaining(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``(vec_id, v array<double>)`` of the vectors whose entries are all finite, and their length."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))), longest


def lattice(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Blocks of the vectors as integers."""
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), size)
    for at in range(0, len(values), BLOCK):
        yield np.floor(values[at : at + BLOCK] * SCALE).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Totals:
    """Exact count, sums and extremes of each dimension."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]

    @property
    def reach(self) -> int:
        """The largest absolute entry of ``n x - S``."""
        return max((max(self.n * h - s, s - self.n * w) for s, w, h in zip(self.sums, self.low, self.high, strict=True)), default=0)


def totals(rows: DataFrame, size: int) -> Totals:
    """A row for each dimension and partition, summed by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, np.zeros(size, object), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        for batch in batches:
            for x in lattice(batch.column(0), size):
                n, sums, low, high = n + len(x), sums + x.sum(0).astype(object), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            exact = pa.array([Decimal(value) for value in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), exact, pa.array(low), pa.array(high)], names=["dim", "n", "s", "low", "high"])

    parts = rows.select("v").mapInArrow(add, "dim int, n long, s decimal(38,0), low long, high long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    return Totals(found[0]["n"] if found else 0, [int(row["s"]) for row in found], [row["low"] for row in found], [row["high"] for row in found])


def primes(product: int) -> list[int]:
    """The largest primes below the bound whose product is more than ``product``."""
    sieve = np.ones(PRIMES_BELOW, bool)
    sieve[:2] = False
    for k in range(2, int(PRIMES_BELOW**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    found, reached = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if reached > product:
            return found
        found.append(p)
        reached *= p
    raise ValueError("the scatter is beyond the product of all primes")


def tiles(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(0, size, TILE) for j in range(i, size, TILE)]


TILES = "part int, p int, i int, j int, data binary"


def tile_batch(part: int, sums: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    columns = [pa.array([key[k] for key in keys], pa.int32()) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), *columns, pa.array([sums[key].tobytes() for key in keys], pa.binary())], names=["part", "p", "i", "j", "data"])


def added(parts: DataFrame, kind: type) -> list:
    """The sum of the tiles of equal ``p, i, j``, modulo ``p`` unless it is 0.

    First in :data:`SALTS` parts of the partitions, then together. A task adds each tile as it
    comes and holds one for each key.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                tile, before = np.frombuffer(data, kind), sums.get(tuple(key))
                tile = tile if before is None else before + tile
                sums[tuple(key)] = tile % key[1] if key[1] else tile
        for part in {key[0] for key in sums}:
            yield tile_batch(part, {key[1:]: tile for key, tile in sums.items() if key[0] == part})

    salted = parts.withColumn("part", F.pmod("part", F.lit(SALTS)).cast("int")).repartition("part", "p", "i", "j").mapInArrow(add, TILES)
    return salted.withColumn("part", F.lit(0)).repartition("p", "i", "j").mapInArrow(add, TILES).collect()


def scatter(rows: DataFrame, size: int, of: Totals) -> np.ndarray:
    """The exact integers ``sum (n x - S)(n x - S)'``.

    A task holds the residues of the upper triangle of the matrix for each prime; what comes to the driver is one
    such set, whatever the number of rows.
    """
    moduli, blocks = primes(2 * of.n * of.reach**2 + 1), tiles(size)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for x in lattice(batch.column(0), size):
                for p in moduli:
                    shift = np.array([s % p for s in of.sums])
                    centred = ((x % p * (of.n % p) - shift) % p).astype(np.float64)
                    for i, j in blocks:
                        tile = (centred[:, i : i + TILE].T @ centred[:, j : j + TILE]).astype(np.int64)
                        sums[p, i, j] = (sums.get((p, i, j), 0) + tile) % p
        yield tile_batch(TaskContext.get().partitionId(), sums)

    found = {(row["p"], row["i"], row["j"]): np.frombuffer(row["data"], np.int64) for row in added(rows.select("v").mapInArrow(multiply, TILES), np.int64)}
    whole = np.zeros((size, size), object)
    for i, j in blocks if found else ():
        shape = min(TILE, size - i), min(TILE, size - j)
        whole[i : i + shape[0], j : j + shape[1]] = reconstructed([found[p, i, j] for p in moduli], moduli).reshape(shape)
        whole[j : j + shape[1], i : i + shape[0]] = whole[i : i + shape[0], j : j + shape[1]].T
    return whole


def reconstructed(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers of least absolute value with these residues, by the Chinese remainder theorem in mixed radix."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(moduli):
        value, weight = np.zeros_like(residues[0]), 1
        for digit, q in zip(digits, moduli, strict=False):
            value, weight = (value + digit * weight) % p, weight * q % p
        digits.append((residues[k] - value) % p * pow(weight, -1, p) % p)
    total, weight = np.zeros(len(residues[0]), object), 1
    for digit, p in zip(digits, moduli, strict=True):
        total, weight = total + digit.astype(object) * weight, weight * p
    return np.where(total > weight // 2, total - weight, total)


@dataclass(frozen=True)
class Whitening:
    """Means as an integer and a part below 1, and the matrix to components; a column of zeros where there is no variance."""

    whole: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    explained: list[float]
    varies: list[bool]


def fitted(exact: np.ndarray, of: Totals, components: int = COMPONENTS) -> Whitening:
    """The components of the covariance; each has a positive entry of largest size, so that reruns agree in sign."""
    covariance = np.array([[value / of.n**3 for value in line] for line in exact], np.float64)  # integers, so each entry is rounded once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    varies = values > len(exact) * np.finfo(float).eps * max(values[0], 0)
    trace = sum(exact[k, k] for k in range(len(exact))) / of.n**3
    axes = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    whole = np.array([s // of.n for s in of.sums], np.int64)
    rest = np.array([s % of.n / of.n for s in of.sums])
    return Whitening(whole, rest, axes, [float(v / trace) if trace else 0.0 for v in values], varies.tolist())


def projected(rows: DataFrame, size: int, of: Totals, by: Whitening, kind: str) -> DataFrame:
    """``(vec_id, deviation, deviation_text, w)`` of each vector; the deviation is exact at any size."""
    small = size * (of.reach + 1) ** 2 < 1 << 63
    remainder = np.array([s % of.n for s in of.sums], np.int64 if small else object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for x in lattice(batch.column(1), size):
                y = x - by.whole
                exact = ((y if small else y.astype(object)) * of.n - remainder) ** 2
                deviation = exact.sum(1).tolist()
                fits = [value if value < 1 << 63 else None for value in deviation]
                text = [str(value) if fit is None else None for value, fit in zip(deviation, fits, strict=True)]
                w = pa.array(list((y - by.rest) @ by.axes), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(x)), pa.array(fits, pa.int64()), pa.array(text, pa.string()), w], names=["vec_id", "deviation", "deviation_text", "w"])
                done += len(x)

    return rows.mapInArrow(project, f"vec_id {kind}, deviation long, deviation_text string, w array<double>")


def identity_error(white: DataFrame, n: int, varies: list[bool]) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    size = len(varies)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            w = np.ones((batch.num_rows, size + 1))
            w[:, :size] = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, size)
            total += w.T @ w
        yield tile_batch(TaskContext.get().partitionId(), {(0, 0, 0): total})

    found = added(white.select("w").mapInArrow(multiply, TILES), np.float64)
    total = np.frombuffer(found[0]["data"], np.float64).reshape(size + 1, -1)
    mean = total[size, :size] / n  # 0 but for rounding: the vectors are centred before they are projected
    error = total[:size, :size] / n - np.outer(mean, mean) - np.eye(size)
    return float(np.abs(error[np.ix_(varies, varies)]).max(initial=0.0))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error, deviation_text)``: a row for each vector and component.

    Vectors that are null or hold null, NaN or infinite entries (or entries of 2^44 and more) are dropped; shorter vectors go on
    with zeros up to the longest, so an empty one is all zeros; repeated rows and null ids count and are returned like any other. A component
    without variance has a null ``whitened``. A ``deviation`` beyond a long is null, and ``deviation_text`` has its
    digits. An empty table, and one of empty vectors alone, give no rows; other columns are ignored.

    Three passes over the vectors, none with a shuffle of them: sums, residues, projection. The whitened vectors are written once, and
    their covariance is measured on what was written.
    """
    rows, size = remaining(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    of = totals(rows, size)
    if not of.n:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
    by = fitted(scatter(rows, size, of), of, components)
    white = materialize(projected(rows, size, of, by, kind), "whitening")
    error = identity_error(white, of.n, by.varies)
    literal = lambda values: F.array(*(F.lit(value) for value in values))
    each = white.select(F.col("vec_id").alias(id_col), "deviation", "deviation_text", F.posexplode("w").alias("pos", "value"))
    return each.select(
        id_col, (F.col("pos") + 1).cast("int").alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation",
        F.when(F.get(literal(by.varies), F.col("pos")), F.col("value")).alias("whitened"), F.get(literal(by.explained), F.col("pos")).alias("explained"),
        F.lit(error).alias("identity_error"), "deviation_text",
    )
