"""Lexical recall over an inverted index.

The index is a table of postings ``token, boost, ts, memory_id``, range-partitioned and sorted by token, then by
falling boost. A token that a third of all points hold lies in many files; each file and row group spans few
tokens and a narrow range of boosts, and the least and greatest values in Parquet's footers let Spark pass by
what a search can't use. ``terms`` has the count and the greatest boost of each token.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, query_words
from .recall import boost, by_score
from .tables import written

# Below every difference of two scores that are not equal, which are rounded to nine digits.
HALF = 5e-10


@dataclass(frozen=True)
class Index:
    """Where an index lies: ``{path}/postings`` and ``{path}/terms``."""

    path: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/terms")


def build(points: DataFrame, path: str, *cols: str) -> Index:
    """Writes the index of the tokens of ``cols``; ``points`` has ``memory_id`` (unique), ``ts``, ``canonical``, ``status``.

    Texts are taken apart once, into a table without them; the rest works on postings. Null texts have no tokens.
    """
    have = F.array_distinct(F.flatten(F.array(*(lexical_tokens(F.col(c)) for c in cols))))
    spark = points.sparkSession
    points.select("memory_id", "ts", boost().alias("boost"), F.explode(have).alias("token")).write.option("compression", "zstd").parquet(f"{path}/apart")
    apart = spark.read.parquet(f"{path}/apart")
    # A bound of ranges in the hot tokens is found by what the order ends with, so they are split as well.
    order = [F.asc("token"), F.desc("boost"), F.desc("ts"), F.asc("memory_id")]
    apart.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{path}/postings")
    index = Index(path)
    terms = index.postings(spark).groupBy("token").agg(F.count("*").alias("n"), F.max("boost").alias("boost"))
    terms.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/terms")
    return index


def weight(wanted: Counter) -> Column:
    """How often the query has the posting's token."""
    found = F.lit(0)
    for token, n in wanted.items():
        found = F.when(F.col("token") == token, F.lit(n)).otherwise(found)
    return found


def matched(postings: DataFrame, wanted: Counter, tokens: list[str], least: float) -> DataFrame:
    """``memory_id, ts, boost, found``: the points of ``tokens`` whose boost, the bound of any score, is not below ``least``."""
    rows = postings.where(F.col("token").isin(tokens)).where(F.col("boost") >= least)
    return rows.groupBy("memory_id", "ts", "boost").agg(F.sum(weight({t: wanted[t] for t in tokens})).alias("found"))


def scored(found: DataFrame, size: int) -> DataFrame:
    """The scores of :func:`~mnemoria.operators.recall.lexical`."""
    share = F.col("found") / F.lit(size)
    return found.select("memory_id", "ts", share.alias("lexical_score"), F.round(share * F.col("boost"), 9).alias("score"))


def search(spark: SparkSession, index: Index, query: str, k: int) -> DataFrame:
    """The ``k`` best as :func:`~mnemoria.operators.recall.lexical` has them, from the postings of the query's tokens.

    Exact, with early ends. The rarest tokens with ``k`` postings or more give a score that the k-th result has at
    least. From then on postings with a boost below it are not read. The most frequent tokens whose bounds together stay
    below it can't bring in a point by themselves: their postings are met with those points only that may still get
    there. What passes the driver are the terms of the query and one number.
    """
    wanted = Counter(query_words(query))
    size = sum(wanted.values())
    postings = index.postings(spark)
    terms = {r["token"]: r for r in index.terms(spark).where(F.col("token").isin(list(wanted))).collect()}
    rare = sorted(terms, key=lambda t: (terms[t]["n"], t))
    if not rare:
        return scored(matched(postings, wanted, [], 0.0), size or 1).limit(0)
    first = next((n for n in range(1, len(rare) + 1) if sum(terms[t]["n"] for t in rare[:n]) >= k), len(rare))
    best = scored(matched(postings, wanted, rare[:first], 0.0), size).orderBy(*by_score()).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("score")).first()
    least = best["score"] - HALF if best["n"] == k else 0.0
    bounds = {t: wanted[t] / size * terms[t]["boost"] for t in rare}
    must = next(n for n in range(1, len(rare) + 1) if sum(bounds[t] for t in rare[n:]) < least or n == len(rare))
    if must == len(rare):
        return scored(matched(postings, wanted, rare, least), size).orderBy(*by_score()).limit(k)
    others = rare[must:]
    still = sum(wanted[t] for t in others)
    near = matched(postings, wanted, rare[:must], least).where((F.col("found") + F.lit(still)) / F.lit(size) * F.col("boost") >= least)
    near = written(near, "candidates")
    more = postings.where(F.col("token").isin(others)).where(F.col("boost") >= least).join(near.select("memory_id"), "memory_id", "left_semi")
    both = near.unionByName(more.select("memory_id", "ts", "boost", weight({t: wanted[t] for t in others}).cast("long").alias("found")))
    return scored(both.groupBy("memory_id", "ts", "boost").agg(F.sum("found").alias("found")), size).orderBy(*by_score()).limit(k)
