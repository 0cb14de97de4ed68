"""The paged store: pages, commits, failing tasks, resumed streams."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoria.sources import pages


@pytest.fixture
def store(spark, tmp_path):
    pages.register(spark)
    return str(tmp_path / "store")


def written(df, path, mode="append", **options):
    df.write.format("paged").mode(mode).options(**options).save(path)


def numbers(spark, a, z, parts=3):
    return spark.range(a, z, 1, parts).select(F.concat(F.lit("m"), "id").alias("memory_id"), (F.col("id") * 2).alias("n"))


def test_pages_are_bounded():
    batch = pa.record_batch({"a": pa.array(range(10), pa.int64())})
    assert [t.num_rows for t in pages.pages_of(iter([batch, batch]), 6, 1 << 20)] == [6, 6, 6, 2]
    assert all(t.nbytes <= 24 for t in pages.pages_of(iter([batch]), 100, 24))
    assert [x for t in pages.pages_of(iter([batch, batch]), 100, 24) for x in t["a"].to_pylist()] == [*range(10)] * 2
    with pytest.raises(ValueError, match="exceeds"):
        list(pages.pages_of(iter([batch]), 100, 4))


def test_round_trip_scrolls_page_by_page(spark, store):
    written(numbers(spark, 0, 1000), store, points=50)
    read = spark.read.format("paged").option("limit", 7).load(store)
    assert sorted((r.memory_id, r.n) for r in read.collect()) == sorted((f"m{i}", i * 2) for i in range(1000))
    places = read.groupBy("_part").agg(F.count("*").alias("n"), F.countDistinct("_place").alias("d"), F.max("_place").alias("m")).collect()
    assert len(places) == 3 and all(p.n == p.d == p.m + 1 for p in places)


def test_last_version_counts_and_since_skips(spark, store):
    written(numbers(spark, 0, 100), store)
    written(numbers(spark, 90, 110).withColumn("n", F.lit(-1).cast("long")), store)
    read = spark.read.format("paged").load(store)
    assert read.count() == 120
    got = {r.memory_id: (r._commit, r.n) for r in pages.newest(read).collect()}
    assert got == {f"m{i}": (1, i * 2) if i < 90 else (2, -1) for i in range(110)}
    assert spark.read.format("paged").option("since", 1).load(store).count() == 20


def test_overwrite_replaces(spark, store):
    written(numbers(spark, 0, 100), store)
    written(numbers(spark, 5, 8), store, "overwrite")
    assert spark.read.format("paged").load(store).count() == 3


def test_a_failing_task_leaves_nothing(spark, store):
    written(numbers(spark, 0, 10), store)
    bad = numbers(spark, 0, 60).withColumn("n", F.when(F.col("n") == 100, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        written(bad, store, points=5)
    assert spark.read.format("paged").load(store).count() == 10
    folder = pages.FolderStore({"path": store})
    assert folder.commits() == [1]
    folder.put("lost", 0, pa.table({"memory_id": ["x"], "n": [1]}))
    folder.vacuum()
    assert folder.names("parts") == sorted(part for part, _ in folder.commit(1)["parts"])


def test_other_columns_and_dimensions_are_refused(spark, store):
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "memory_id string, embedding array<float>")
    written(rows, store, dimensions=2)
    with pytest.raises(Exception, match="other columns"):
        written(rows.withColumn("x", F.lit(1)), store)
    with pytest.raises(Exception, match="not of 2 numbers"):
        written(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), store)
    with pytest.raises(Exception, match="not 3"):
        written(rows, store, dimensions=3)
    with pytest.raises(Exception, match="not of 2 numbers"):
        written(rows.withColumn("embedding", F.lit(None).cast("array<float>")), store)
    assert spark.read.format("paged").load(store).count() == 1


def test_a_page_that_fails_is_asked_for_again(spark, tmp_path):
    path, marks = str(tmp_path / "s"), tmp_path / "marks"
    marks.mkdir()

    class Shaky(pages.FolderStore):
        def scroll(self, part, offset, limit):
            mark = marks / f"{part}-{offset}"
            if not mark.exists():
                mark.touch()
                raise OSError("the connection was lost")
            return super().scroll(part, offset, limit)

    pages.register(spark, Shaky, "shaky")
    numbers(spark, 0, 40).write.format("shaky").mode("append").option("points", 10).save(path)
    assert sorted(r.n for r in spark.read.format("shaky").load(path).collect()) == [2 * i for i in range(40)]
    assert len(list(marks.iterdir())) > 3


def test_a_stream_goes_on_where_it_stopped(spark, store, tmp_path):
    def run():
        found = spark.readStream.format("paged").load(store)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect())

    written(numbers(spark, 0, 10), store)
    assert run() == [2 * i for i in range(10)]
    written(numbers(spark, 10, 12), store)
    assert run() == run() == [2 * i for i in range(12)]


def test_an_empty_table_is_a_commit(spark, store):
    written(numbers(spark, 0, 0), store)
    assert spark.read.format("paged").load(store).count() == 0
