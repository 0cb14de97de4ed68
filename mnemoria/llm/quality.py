"""Operator 2: robust multivariate outliers by minimum covariance determinant.

Each document becomes a vector of transformed statistics. For each language and source the
minimum-covariance-determinant estimate of centre and scatter is found by concentration steps
over all of its documents, and a document whose Mahalanobis distance is extreme is rejected.

The steps never bring a group together. A step adds up the moments of each group by bins of the
distance (a few hundred bins whatever the group's size), and the running sums over the bins give
both the threshold that holds ``SUPPORT`` of the group and the moments below it. Moments are summed
in two stages, so the rows that meet in one task are bins, whatever the number of partitions.

A covariance needs more documents than it has entries. Each document is in exactly one group: its
language and source if ``LEAST_GROUP`` of its documents pass the base rule, or else the small
sources of its language together, or else what is left of all languages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_key, materialize

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATISTICS = ("log_words", "log_word_length", "symbol_rate", "dup_line_rate", "repeat_word_rate")
#: Words that one repeated window adds to the count of repeated words.
REPEAT_STEP = 6
#: Keeps matrices regular where no document passes the base rule.
NO_TEXT = (1.0,) * 3
#: Part of a group that the determinant is minimised over, and the number of concentration steps.
SUPPORT = 0.75
STEPS = 4
#: Groups of fewer documents are taken together; the default of a parameter.
LEAST_GROUP = 50
#: Parts in which moments are summed before they meet.
SALTS = 16
#: Bins of the distance in a doubling, and of a statistic in a unit.
BINS = 16
GRID = 64
#: Tail probabilities of the reweighting step and of the rejection.
REWEIGHT_TAIL = 0.025
REJECT_TAIL = 0.001

P = len(STATISTICS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi_square_tail(x: float, freedom: int = P) -> float:
    """The probability beyond ``x``, in closed form for an odd ``freedom``."""
    term, total = 1.0, 0.0
    for k in range(1, freedom - 1, 2):
        total += term
        term *= x / (k + 2)
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * total


def chi_square_quantile(p: float, freedom: int = P) -> float:
    """By bisection of the exact tail."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, freedom) > 1 - p else (low, middle)
    return high


def least_spreads(words: float, chars: float, lines: float) -> tuple[float, ...]:
    """The noise of each statistic's counts in a text of this size: the smallest standard deviation taken for real spread.

    A count varies by its root, so a logarithm of ``n`` by ``1 / sqrt(n)``; few symbols vary by one
    symbol; the root of a rate is known to the rounding of one event, its step over ``sqrt(12)``.
    """
    return (1 / math.sqrt(words), 1 / math.sqrt(chars), math.log1p(10 / words), math.sqrt(1 / lines / 12), math.sqrt(REPEAT_STEP / words / 12))


def typical_size(stats: DataFrame) -> tuple[float, ...]:
    """Geometric means of words, characters and lines over the documents that pass the base rule."""
    logs = (F.col("x0"), F.log(F.greatest("word_chars", F.lit(1))), F.log(F.greatest("n_lines", F.lit(1))))
    found = stats.where("not base_failed").agg(*(F.avg(log).alias(f"a{k}") for k, log in enumerate(logs))).first()
    return NO_TEXT if found["a0"] is None else tuple(math.exp(value) for value in found)


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # ASCII white space: \x20 and \x09-\x0D
    spaces = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)] if b"\n" in data else [data] * bool(words)
    duplicates = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0  # words before it are counted
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeated += at + 3 - max(end, at)
                end = at + 3
    return len(words), len(text) - spaces, symbols, duplicates, repeated, len(lines)


def transformed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> tuple[float, ...]:
    words = max(n_words, 1)
    return (math.log1p(n_words), math.log(max(word_chars, 1) / words), math.log1p(10 * n_symbols / words), math.sqrt(n_dup_lines / max(n_lines, 1)), math.sqrt(n_repeat_words / words))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang, source, counts, base_failed, x)`` of every document; whole texts, one pass, no shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(text) for text in batch.column(3).to_pylist()]
            columns = [pa.array([row[k] for row in rows], pa.int64()) for k in range(6)]
            failed = pa.array([row[0] < MIN_WORDS or 100 * row[4] > MAX_REPEAT_PERCENT * row[0] for row in rows], pa.bool_())
            values = [transformed(*row) for row in rows]
            floats = [pa.array([value[k] for value in values], pa.float64()) for k in range(P)]
            names = [id_col, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", *(f"x{k}" for k in range(P))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns, failed, *floats], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    schema = f"`{id_col}` {kind}, lang string, source string, {counts}, base_failed boolean, " + ", ".join(f"x{k} double" for k in range(P))
    return docs.select(id_col, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_col).mapInArrow(measure, schema)


def moments() -> list[Column]:
    """Count, sums and products of the statistics."""
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in PAIRS)]


MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"p{i}_{j}" for i, j in PAIRS)]
ESTIMATE = "grp string, start int, n double, det double, scale double, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(f"q{i}_{j} double" for i, j in PAIRS)


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Moments by ``keys``: first in parts of the partitions, then together."""
    parts = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy(*keys, "part").agg(*moments())
    return parts.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in MOMENTS))


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts ``c`` by ``keys``, in the same two stages."""
    parts = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy(*keys, "part").agg(F.count("*").alias("c"))
    return parts.groupBy(*keys).agg(F.sum("c").alias("c"))


def estimates(sums: DataFrame, spreads: tuple[float, ...]) -> DataFrame:
    """Centres and inverse scatters from moments: one small matrix for each row of groups."""
    noise = np.outer(spreads, spreads)
    numbers = ["n", "det", "scale", *(f"m{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in PAIRS)]
    schema = pa.schema([("grp", pa.string()), ("start", pa.int32()), *((name, pa.float64()) for name in numbers)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                n = row["n"]
                mean = np.array([row[f"s{i}"] for i in range(P)]) / n
                scatter = np.zeros((P, P))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = row[f"p{i}_{j}"] / n - mean[i] * mean[j]
                # In units of the noise no direction has less spread than the noise itself.
                values, axes = np.linalg.eigh(scatter / noise)
                scatter = (axes * np.maximum(values, 1.0)) @ axes.T * noise
                inverse = np.linalg.inv(scatter)
                rows.append({"grp": row["grp"], "start": row["start"], "n": float(row["total"]), "det": float(np.linalg.slogdet(scatter)[1]), "scale": 1.0} | {f"m{i}": float(mean[i]) for i in range(P)} | {f"q{i}_{j}": float(inverse[i, j]) for i, j in PAIRS})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sums.mapInArrow(solve, ESTIMATE)


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` under the estimate of the row."""
    terms = [(1 if i == j else 2) * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) * F.col(f"q{i}_{j}") for i, j in PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def distance_bin(squared: Column) -> Column:
    return F.floor(F.log2(squared + F.lit(2.0**-20)) * BINS).cast("int")


def grouped(stats: DataFrame, least_group: int) -> DataFrame:
    """Adds ``grp``: the language and source, the small sources of the language, or the rest.

    The list of sources is counted and joined as a table; a source of a third of the rows is met where its rows lie.
    """
    own = stats.withColumn("own", F.to_json(F.struct("lang", "source")))
    sizes = own.groupBy("own", F.to_json(F.struct("lang")).alias("by_lang")).agg(F.count_if(~F.col("base_failed")).alias("n"))
    pools = sizes.where(F.col("n") < least_group).groupBy("by_lang").agg(F.sum("n").alias("pooled"))
    name = F.when(F.col("n") >= least_group, F.col("own")).when(F.col("pooled") >= least_group, F.col("by_lang")).otherwise("")
    table = materialize(sizes.join(pools, "by_lang", "left").select("own", name.alias("grp")), "quality-groups")
    return join_by_key(own, table, "own").drop("own")


def first_estimates(rows: DataFrame, spreads: tuple[float, ...]) -> DataFrame:
    """Two starts: all documents of the group, and its medians with deviations from them.

    Medians come from counts on a fixed grid, so they are exact to the grid, the same on each run,
    and need a bounded number of rows for a group.
    """
    classical = summed(rows, "grp").select("grp", F.lit(0).alias("start"), *MOMENTS, F.col("n").alias("total"))
    cells = rows.select("grp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(F.col(f"x{k}") * GRID).alias("cell")) for k in range(P)))).alias("s")).select("grp", "s.k", "s.cell")
    long = counted(cells, "grp", "k", "cell").withColumnRenamed("c", "n")

    def median(counts: DataFrame, value: str) -> DataFrame:
        up = Window.partitionBy("grp", "k").orderBy(value)
        half = counts.select("grp", "k", value, F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("below"), F.sum("n").over(Window.partitionBy("grp", "k")).alias("total"))
        return half.where("below * 2 >= total").groupBy("grp", "k").agg(F.min(value).alias("middle"), F.first("total").alias("total"))

    middles = median(long, "cell")
    away = long.join(middles.drop("total"), ["grp", "k"]).groupBy("grp", "k", F.abs(F.col("cell") - F.col("middle")).alias("off")).agg(F.sum("n").alias("n"))
    spread = median(away, "off").withColumnRenamed("middle", "mad")
    both = middles.drop("total").join(spread, ["grp", "k"])
    # As moments of one document with these means and variances, for estimates().
    mean = (F.col("middle") + 0.5) / GRID
    square = mean * mean + F.pow(1.4826 * F.col("mad") / GRID, 2)
    wide = both.groupBy("grp").agg(F.first("total").alias("total"), *(F.max(F.when(F.col("k") == k, mean)).alias(f"s{k}") for k in range(P)), *(F.max(F.when(F.col("k") == k, square)).alias(f"p{k}_{k}") for k in range(P)))
    robust = wide.select("grp", F.lit(1).alias("start"), F.lit(1).cast("long").alias("n"), *(f"s{k}" for k in range(P)), *((F.col(f"p{i}_{j}") if i == j else F.col(f"s{i}") * F.col(f"s{j}")).alias(f"p{i}_{j}") for i, j in PAIRS), "total")
    return estimates(classical.unionByName(robust), spreads)


def concentrate(rows: DataFrame, current: DataFrame, spreads: tuple[float, ...]) -> DataFrame:
    """One step: the moments of the ``SUPPORT`` of each group that is nearest under the estimate."""
    near = rows.join(current.drop("n", "det", "scale"), "grp").withColumn("bin", distance_bin(distance()))
    sums = summed(near, "grp", "start", "bin")
    group = Window.partitionBy("grp", "start")
    up = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select("grp", "start", "bin", F.sum("n").over(group).alias("total"), *(F.sum(name).over(up).alias(name) for name in MOMENTS))
    reached = running.where(F.col("n") >= F.ceil(F.col("total") * SUPPORT))
    first = reached.withColumn("rank", F.row_number().over(group.orderBy("bin"))).where("rank = 1")
    return estimates(first.select("grp", "start", *MOMENTS, "total"), spreads)


def fit(stats: DataFrame) -> DataFrame:
    """The reweighted estimate of every ``grp``, as a written table."""
    rows = stats.where("not base_failed").select("grp", *(f"x{k}" for k in range(P)))
    spreads = least_spreads(*typical_size(stats))
    current = materialize(first_estimates(rows, spreads), "mcd")
    for _ in range(STEPS):
        current = materialize(concentrate(rows, current, spreads), "mcd")
    best = current.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))).where("rank = 1").drop("rank", "scale")
    # Consistency: half of the distances of normal data lie below the median of chi-square.
    binned = counted(rows.join(best, "grp").select("grp", distance_bin(distance()).alias("bin")), "grp", "bin")
    up = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    half = binned.select("grp", "bin", F.sum("c").over(up).alias("below"), F.sum("c").over(Window.partitionBy("grp")).alias("all"))
    middle = half.where("below * 2 >= all").groupBy("grp").agg((F.pow(F.lit(2.0), (F.min("bin") + 1) / BINS) / chi_square_quantile(0.5)).alias("scale"))
    scaled = materialize(best.join(middle, "grp"), "mcd")
    inside = rows.join(scaled, "grp").where(distance() <= F.greatest("scale", F.lit(1.0)) * chi_square_quantile(1 - REWEIGHT_TAIL))
    return materialize(estimates(summed(inside.drop("n"), "grp", "start").withColumn("total", F.col("n")), spreads), "mcd")


def judge(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds ``distance`` (squared) and ``kept``."""
    names = [name for name in fitted.columns if name[0] in "mq"]
    placed = stats.join(fitted.select("grp", *names), "grp", "left")
    squared = F.when(F.col("m0").isNotNull(), distance())
    verdict = ~F.col("base_failed") & (F.coalesce(squared, F.lit(0.0)) <= chi_square_quantile(1 - REJECT_TAIL))
    return placed.withColumn("distance", squared).withColumn("kept", verdict).drop(*names)


def quality(docs: DataFrame, least_group: int = LEAST_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``.

    A row for each row of ``docs``; repeated rows and rows of one id are rows of their own. A null text
    has no words and fails the base rule, as an empty one; a very long text is measured whole; null
    languages and sources form groups of their own. Groups of fewer than ``least_group`` documents that pass the base
    rule are taken together by language, then all; with no document to fit, the base rule alone
    decides. An empty table gives an empty one; ``docs`` needs the columns lang and source, others are ignored.
    """
    stats = materialize(statistics(docs, id_col, text_col), "quality")
    stats = materialize(grouped(stats, least_group), "quality-grouped")
    judged = judge(stats, fit(stats))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
