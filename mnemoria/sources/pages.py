"""A store of points that is written and read a page at a time, as a data source of Spark.

``register(spark)`` names the format; then ``df.write.format("paged").mode("append").save(path)`` adds a commit, and
``spark.read.format("paged").load(path)`` or ``spark.readStream.format("paged").load(path)`` scroll through what was
committed. Another store (a remote one, with a client of its own) is registered by a function that opens it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .sinks import BATCH_BYTES, BATCH_POINTS

# Which version of a point a row is: its commit, the part of it that a task wrote, and its place there.
VERSION = [StructField("_commit", LongType()), StructField("_part", StringType()), StructField("_place", LongType())]
ATTEMPTS = 3


class Store(Protocol):
    """What a paged store offers. Parts are written by one task each; only parts that a commit names count."""

    def commits(self) -> list[int]: ...

    def commit(self, number: int) -> dict: ...

    def publish(self, entry: dict) -> int: ...

    def put(self, part: str, first: int, page: pa.Table) -> None: ...

    def scroll(self, part: str, offset: int, limit: int) -> tuple[pa.Table, int | None]:
        """Rows of ``part`` from place ``offset`` on, ``limit`` at most, and the offset of the next page."""

    def drop(self, part: str) -> None: ...


class FolderStore:
    """A paged store in a folder: ``parts/{part}/{first place}.parquet`` and ``commits/{number}.json``.

    The path is a URI of a file system that Arrow knows. One job writes at a time, as with any table without locks.
    """

    def __init__(self, options: dict) -> None:
        self.uri = options["path"].rstrip("/")

    def at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        system, root = pafs.FileSystem.from_uri(self.uri)
        return system, "/".join((root, *names))

    def names(self, *folder: str) -> list[str]:
        system, path = self.at(*folder)
        return sorted(found.base_name for found in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)))

    def commits(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self.names("commits") if name.endswith(".json")]

    def commit(self, number: int) -> dict:
        system, path = self.at("commits", f"{number:012d}.json")
        with system.open_input_stream(path) as file:
            return json.loads(file.read())

    def publish(self, entry: dict) -> int:
        number = max(self.commits(), default=0) + 1
        system, path = self.at("commits", f"{number:012d}.json")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.new") as file:
            file.write(json.dumps(entry).encode())
        # A commit is there whole or not at all.
        system.move(f"{path}.new", path)
        return number

    def put(self, part: str, first: int, page: pa.Table) -> None:
        system, path = self.at("parts", part, f"{first:012d}.parquet")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        pq.write_table(page, path, filesystem=system, compression="zstd")

    def scroll(self, part: str, offset: int, limit: int) -> tuple[pa.Table, int | None]:
        firsts = [int(name.removesuffix(".parquet")) for name in self.names("parts", part)]
        k = max(i for i, first in enumerate(firsts) if first <= offset)
        system, path = self.at("parts", part, f"{firsts[k]:012d}.parquet")
        page = pq.read_table(path, filesystem=system, partitioning=None)
        end = min(offset + limit, firsts[k] + page.num_rows)
        more = end < firsts[k] + page.num_rows or k + 1 < len(firsts)
        return page.slice(offset - firsts[k], end - offset), end if more else None

    def drop(self, part: str) -> None:
        system, path = self.at("parts", part)
        if system.get_file_info(path).type != pafs.FileType.NotFound:
            system.delete_dir(path)

    def vacuum(self) -> int:
        """Deletes parts that no commit names, which lost tasks have left. Not to be run while a job writes."""
        named = {part for number in self.commits() for part, _ in self.commit(number)["parts"]}
        lost = [part for part in self.names("parts") if part not in named]
        for part in lost:
            self.drop(part)
        return len(lost)


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


@dataclass
class Part(InputPartition):
    commit: int
    part: str


def pages_of(batches: Iterator[pa.RecordBatch], most: int, most_bytes: int) -> Iterator[pa.Table]:
    """Pages of at most ``most`` rows and ``most_bytes``; a row that is larger than a page may be is an error."""
    held, rows, filled = [], 0, 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, most - rows)
            while piece.num_rows > 1 and filled + piece.nbytes > most_bytes:
                piece = piece.slice(0, piece.num_rows // 2)
            if not rows and piece.nbytes > most_bytes:
                raise ValueError(f"a point of {piece.nbytes} bytes exceeds the {most_bytes} bytes of a page")
            if filled + piece.nbytes <= most_bytes:
                held, rows, filled, at = [*held, piece], rows + piece.num_rows, filled + piece.nbytes, at + piece.num_rows
                if rows < most:
                    continue
            yield pa.Table.from_batches(held)
            held, rows, filled = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def shape(schema: StructType) -> list[tuple[str, str]]:
    """Columns and types, whether or not they may be null."""
    return [(field.name, field.dataType.simpleString()) for field in schema.fields]


class PagedWriter(DataSourceArrowWriter):
    """Every task writes pages of a part of its own; the driver commits them together, or drops them."""

    def __init__(self, store: Store, schema: StructType, replaces: bool, options: dict) -> None:
        self.store, self.schema, self.replaces = store, schema, replaces
        self.most, self.most_bytes = int(options.get("points", BATCH_POINTS)), int(options.get("bytes", BATCH_BYTES))
        self.vector, self.dimensions = options.get("vector", "embedding"), options.get("dimensions")
        known = None if replaces else next((found for n in reversed(store.commits()) if (found := store.commit(n))), None)
        if known and shape(StructType.fromJson(known["schema"])) != shape(schema):
            raise ValueError("the store holds points of other columns")
        if self.vector in schema.names:
            stated = known and known["dimensions"]
            if stated and self.dimensions and int(self.dimensions) != stated:
                raise ValueError(f"the store holds vectors of {stated} numbers, not {self.dimensions}")
            self.dimensions = stated or (self.dimensions and int(self.dimensions))

    def checked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches whose vectors have the dimension of the store."""
        for batch in batches:
            if self.dimensions and self.vector in self.schema.names:
                lengths = set(batch.column(self.schema.names.index(self.vector)).value_lengths().to_pylist())
                if lengths - {self.dimensions}:
                    raise ValueError(f"a vector is missing or not of {self.dimensions} numbers")
            yield batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part, rows = uuid.uuid4().hex, 0
        try:
            for page in pages_of(self.checked(iterator), self.most, self.most_bytes):
                self.store.put(part, rows, page)
                rows += page.num_rows
        except BaseException:
            self.store.drop(part)
            raise
        return Written(part, rows)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m.part, m.rows) for m in messages if m is not None and m.rows)
        self.store.publish({"schema": self.schema.jsonValue(), "dimensions": self.dimensions, "replaces": self.replaces, "parts": parts})

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                self.store.drop(m.part)


class Scroller:
    """Reads a part page by page; a page that fails is asked for again from its own offset."""

    def __init__(self, store: Store, schema: StructType, options: dict) -> None:
        self.store, self.names = store, schema.names
        self.limit, self.since = int(options.get("limit", 4096)), int(options.get("since", 0))

    def page(self, part: str, offset: int) -> tuple[pa.Table, int | None]:
        for left in reversed(range(ATTEMPTS)):
            try:
                return self.store.scroll(part, offset, self.limit)
            except OSError:
                if not left:
                    raise
        raise AssertionError

    def scrolled(self, found: Part | None) -> Iterator[pa.RecordBatch]:
        """The pages of a part; Spark asks for none of them where a read has no parts."""
        offset: int | None = None if found is None else 0
        while offset is not None:
            page, after = self.page(found.part, offset)
            own = {"_commit": pa.array([found.commit] * page.num_rows, pa.int64()), "_part": pa.array([found.part] * page.num_rows, pa.string()), "_place": pa.array(range(offset, offset + page.num_rows), pa.int64())}
            yield from pa.table([own.get(name, page.column(name) if name in page.column_names else None) for name in self.names], names=self.names).to_batches()
            offset = after

    def parts(self, numbers: list[int], replacing: bool) -> list[Part]:
        found: list[Part] = []
        for number in numbers:
            entry = self.store.commit(number)
            if entry["replaces"] and replacing:
                found = []
            found += [Part(number, part) for part, _ in entry["parts"]]
        return found


class PagedReader(Scroller, DataSourceReader):
    """All commits after ``since``, from the last one on that replaced the others."""

    def partitions(self) -> list[Part]:
        return self.parts([n for n in self.store.commits() if n > self.since], True)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.scrolled(partition)


class PagedStream(Scroller, DataSourceStreamReader):
    """Commits as they come; the offset of a query is the last commit it has taken."""

    def initialOffset(self) -> dict:
        return {"commit": self.since}

    def latestOffset(self) -> dict:
        return {"commit": max(self.store.commits(), default=self.since)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts([n for n in self.store.commits() if start["commit"] < n <= end["commit"]], False)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.scrolled(partition)


def register(spark: SparkSession, opened: Callable[[dict], Store] = FolderStore, called: str = "paged") -> None:
    """Makes ``called`` a format of this session, over the store that ``opened`` makes of the options.

    Options: ``points`` and ``bytes`` of a page that is written, ``vector`` and its ``dimensions``, ``limit`` rows of a
    page that is read, and ``since``, the commit after which reading starts.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> StructType:
            store = opened(self.options)
            known = store.commits()
            if not known:
                raise ValueError("the store holds no commit")
            return StructType([*StructType.fromJson(store.commit(known[-1])["schema"]).fields, *VERSION])

        def reader(self, schema: StructType) -> PagedReader:
            return PagedReader(opened(self.options), schema, self.options)

        def streamReader(self, schema: StructType) -> PagedStream:
            return PagedStream(opened(self.options), schema, self.options)

        def writer(self, schema: StructType, overwrite: bool) -> PagedWriter:
            return PagedWriter(opened(self.options), schema, overwrite, self.options)

    spark.dataSource.register(Paged)


def newest(rows: DataFrame, key: str = "memory_id") -> DataFrame:
    """The last version of each point: the newest commit, in it the greatest part and place. Null keys are one key."""
    others = [c for c in rows.columns if c != key and c not in {f.name for f in VERSION}]
    last = rows.groupBy(key).agg(F.max_by(F.struct("_commit", *others), F.struct(*(f.name for f in VERSION))).alias("v"))
    return last.select(key, "v.*")
