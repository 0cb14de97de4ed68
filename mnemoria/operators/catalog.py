"""Statistics, browsing and mutation of the table of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stats(points: DataFrame, *facets: str) -> DataFrame:
    """``facet, value, n``: the total and the counts of each facet, in one pass by grouping sets (A1)."""
    trimmed = points.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in facets))
    sets = trimmed.groupingSets([[F.col(c)] for c in facets] + [[]], *map(F.col, facets)).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    marks = [F.lit(2 ** len(facets) - 1 - 2 ** (len(facets) - 1 - k)) for k in range(len(facets))]
    name, value = F.lit("total"), F.lit("")
    for mark, c in zip(marks, facets, strict=True):
        name, value = F.when(F.col("g") == mark, F.lit(c)).otherwise(name), F.when(F.col("g") == mark, F.col(c)).otherwise(value)
    return sets.select(name.alias("facet"), value.alias("value"), "n").where("facet = 'total' or value <> ''")


def facet_counts(points: DataFrame, facet: str, limit: int = 64) -> DataFrame:
    """The most frequent values, ties by value."""
    return points.where(F.trim(F.coalesce(F.col(facet), F.lit(""))) != "").groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def profile(points: DataFrame) -> DataFrame:
    """One row on the whole corpus."""
    return points.agg(F.count("*").alias("points"), F.count_distinct("conversation_id").alias("sources"), F.count_distinct("source_title").alias("titles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1).otherwise(0)).alias("blank"))


def document_profile(points: DataFrame, model: str = "ai_model") -> DataFrame:
    """One row: documents, chunks of a document on average, and the most frequent model that is named."""
    documents = points.groupBy("conversation_id").agg(F.count("*").alias("chunks")).agg(F.count("*").alias("documents"), F.round(F.avg("chunks"), 6).alias("chunks_per_document"))
    named = points.where(F.trim(F.coalesce(F.col(model), F.lit(""))) != "")
    return documents.join(most_common(named, model).select(F.col("value").alias("model")), F.lit(True), "left")


def payloads(points: DataFrame, key: str = "memory_id") -> DataFrame:
    """``(key, payload)``: every other column as one JSON object, nulls left out."""
    return points.select(key, F.to_json(F.struct(*(c for c in points.columns if c != key))).alias("payload"))


def from_payloads(rows: DataFrame, schema: str, key: str = "memory_id") -> DataFrame:
    """The columns of ``schema`` out of payloads; what a payload lacks is null."""
    return rows.select(key, F.from_json("payload", schema).alias("p")).select(key, "p.*")


def most_common(points: DataFrame, column: str) -> DataFrame:
    """The mode; ties to the smallest value."""
    counts = points.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(1)


def top_documents(points: DataFrame, k: int = 8) -> DataFrame:
    """Documents of the most chunks (A10)."""
    return points.groupBy(F.col("conversation_id").alias("document")).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "document").limit(k)


def duplicate_documents(points: DataFrame, title: Column, fingerprint: Column) -> DataFrame:
    """Titles under which more than one fingerprint is found."""
    pairs = points.select(F.lower(title).alias("title"), fingerprint.alias("fingerprint")).where("title <> ''").distinct()
    return pairs.groupBy("title").agg(F.array_sort(F.collect_list("fingerprint")).alias("f")).where(F.size("f") > 1).select("title", F.size("f").cast("long").alias("n"), F.array_join("f", ",").alias("fingerprints"))


def missing_fields(points: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Labels of the alias groups of which no column is ever filled."""
    found = points.agg(*(F.coalesce(F.bool_or(F.coalesce(*(F.trim(F.col(c).cast("string")) for c in columns if c in points.columns), F.lit("")) != ""), F.lit(False)).alias(label) for label, columns in groups.items()))
    return found.select(F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(label).alias("found")) for label in groups))).alias("g")).select("g.label").where("not g.found")


def metrics(events: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Counters and sums by labels."""
    return events.groupBy(*labels).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def upsert(points: DataFrame, new: DataFrame, key: str = "memory_id", order: str = "pos") -> DataFrame:
    """The table with ``new`` in place of rows of the same key; the last of a key counts (K1-K4)."""
    last = new.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("r = 1").drop("r", order)
    return points.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def patch(points: DataFrame, patches: DataFrame, columns: list[str], key: str = "memory_id") -> DataFrame:
    """Sets columns of matching rows; ``set_<column>`` tells whether the patch has it, so null can be set (K5)."""
    p = patches.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), *(F.col(f"set_{c}") for c in columns))
    met = points.join(p, key, "left")
    return met.select(*(F.when(F.coalesce(F.col(f"set_{c}"), F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in points.columns))


def delete_ids(points: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """Without the listed keys (K6)."""
    return points.join(ids.select(key), key, "left_anti")


def delete_where(points: DataFrame, predicate: Column | None) -> DataFrame:
    """Without the rows of a predicate; a missing predicate is refused (K7)."""
    if predicate is None:
        raise ValueError("a delete needs at least one filter")
    return points.where(~F.coalesce(predicate, F.lit(False)))


def page_after(points: DataFrame, cursor: str | None, n: int) -> DataFrame:
    """The next ``n`` rows after a key: a keyset page, cheap at any depth (L1-L4)."""
    rest = points if cursor is None else points.where(F.col("memory_id") > cursor)
    return rest.orderBy("memory_id").limit(max(1, min(n, 2000)))


def page_at(points: DataFrame, offset: int, n: int, *order: Column) -> DataFrame:
    """Rows from ``offset`` on in a total order, with ``next_offset``: where the next page begins, null after the last (L1).

    One row more than the page is read to know whether there is one.
    """
    n = n if n > 0 else 128
    offset = max(offset, 0)
    read = points.orderBy(*order).offset(offset).limit(n + 1)
    place = F.row_number().over(Window.orderBy(*order))
    placed = read.withColumn("place", place).withColumn("more", F.max("place").over(Window.partitionBy(F.lit(0))) > n)
    return placed.where(F.col("place") <= n).withColumn("next_offset", F.when(F.col("more"), F.lit(offset + n).cast("long"))).drop("place", "more")


def titles(points: DataFrame, k: int = 60, sample: int = 0) -> DataFrame:
    """Titles by their number of points, ties by name; of the first ``sample`` points by id, or of all (A1, A3)."""
    taken = points.orderBy("memory_id").limit(sample) if sample > 0 else points
    return facet_counts(taken, "source_title", k)


def counted(points: DataFrame, predicate: Column | None = None, exact: bool = True, deviation: float = 0.05) -> DataFrame:
    """One row: the number of points that pass; without ``exact`` an estimate over their ids (A5)."""
    found = points if predicate is None else points.where(predicate)
    return found.agg((F.count("*") if exact else F.approx_count_distinct("memory_id", deviation)).alias("n"))


def collections(spark: SparkSession, vector: str = "embedding") -> DataFrame:
    """Name, number of points and length of vectors of every table of the catalog."""
    found = None
    for table in spark.catalog.listTables():
        points = spark.table(table.name)
        size = F.max(F.size(vector)) if vector in points.columns else F.lit(None).cast("int")
        row = points.agg(F.lit(table.name).alias("name"), F.count("*").alias("points"), size.alias("vector_size"))
        found = row if found is None else found.unionByName(row)
    return found if found is not None else spark.createDataFrame([], "name string, points long, vector_size int")
