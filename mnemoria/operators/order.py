"""Numbering within groups that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64


def numbered(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str, bins: int = BINS) -> DataFrame:
    """Adds ``name``: the place of each row among its ``keys`` by ``order``, from 1; ``value`` is a number that leads the order.

    A group is not sorted in one task: quantiles of ``value`` over all rows cut it into bins, rows are numbered
    inside the bins, and counts of the bins give what comes before. The quantiles are a bounded list of numbers;
    where they lie decides how the work is dealt, never the result.
    """
    cuts = rows.agg(F.approx_percentile(value, [n / bins for n in range(1, bins)], 10 * bins).alias("cuts")).first()["cuts"]
    bin_of: Column = F.size(F.filter(F.array(*(F.lit(cut) for cut in sorted(set(cuts)))), lambda cut: cut <= F.col(value))) if cuts else F.lit(0)
    binned = rows.withColumn("_bin", F.coalesce(F.when(F.col(value).isNotNull(), bin_of), F.lit(-1)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(*order))
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(*(F.col(key).alias(f"_k{n}") for n, key in enumerate(keys)), F.col("_bin").alias("_b"), F.coalesce(before, F.lit(0)).alias("_base"))
    same = [F.col(key).eqNullSafe(F.col(f"_k{n}")) for n, key in enumerate(keys)]
    joined = binned.withColumn("_inside", inside).join(bases, [*same, F.col("_bin") == F.col("_b")])
    return joined.select(*rows.columns, (F.col("_base") + F.col("_inside")).alias(name))
