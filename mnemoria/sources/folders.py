"""Folders of mixed files to rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_title, clock

# Endings of the files that are taken, and what they are called.
KINDS = {
    "docx": "Word Document", "pdf": "PDF Document / Presentation", "png": "Image / Diagram", "jpg": "Image / Diagram", "jpeg": "Image / Diagram", "webp": "Image / Diagram",
    "m4a": "Audio Overview", "mp3": "Audio Overview", "wav": "Audio Overview", "mp4": "Video Presentation", "md": "Text Note", "txt": "Text Note", "jsonl": "JSONL Memory",
}
TEXT_KINDS = ("md", "txt")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NUMBERED = re.compile(r"(?:Section |Chapter |\d+\.(?:\s|\d))")


def listed_files(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``path, file, extension, kind`` of the files of a folder that are taken, the first ``limit`` by name; names alone are read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).withColumn("extension", F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1)))
    labels = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    taken = named.where(~F.col("file").startswith(".") & F.col("extension").isin(*KINDS)).withColumn("kind", F.element_at(labels, F.col("extension")))
    return taken.orderBy("file").limit(limit) if limit > 0 else taken


def folder_messages(spark: SparkSession, path: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(source_title, part, kind, text)`` of a folder's notes and word-processor files, and one row of counters.

    Counters are ``files, taken, skipped``: a file that can't be read is skipped, and files of other kinds wait for their extractors.
    """
    files = listed_files(spark, path, limit)
    wanted = files.select(F.col("file").alias("source_title"), "kind")
    notes = text_files(spark, path).select("source_title", F.lit(0).alias("part"), "text")
    sections = docx_files(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("source_title"), F.col("section").alias("part"), "text", "error")
    read = notes.unionByName(sections.where("error is null").drop("error"))
    bad = sections.where("error is not null").select("source_title").distinct().join(wanted, "source_title", "left_semi").agg(F.count("*").alias("skipped"))
    counters = files.agg(F.count("*").alias("files"), F.count_if(F.col("extension").isin("docx", *TEXT_KINDS)).alias("readable")).join(bad).select("files", (F.col("readable") - F.col("skipped")).alias("taken"), "skipped")
    return read.join(wanted, "source_title").where("trim(text) <> ''").select("source_title", "part", "kind", "text"), counters


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file: title and whole text."""
    files = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("body"))
    kind = F.lower(F.element_at(F.split("file", r"\."), -1))
    files = files.where(~F.col("file").startswith(".") & kind.isin(*TEXT_KINDS) & (F.trim("body") != ""))
    return files.select(F.col("file").alias("source_title"), kind.alias("kind"), F.concat(F.lit("["), clean_title(F.col("file")), F.lit("]\n\n"), F.trim("body")).alias("text"))


def safe_name(name: str) -> bool:
    """Neither absolute nor out of the archive (S3)."""
    return not name.startswith(("/", "\\")) and ".." not in re.split(r"[/\\]", name) and ":" not in name


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, name, body)`` of the files in zip archives; unsafe names and links are left out."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        link = (info.external_attr >> 28) == 0xA
                        if not info.is_dir() and not link and safe_name(info.filename):
                            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([info.filename]), pa.array([archive.read(info)], pa.binary())], names=["archive", "name", "body"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(unpack, "archive string, name string, body binary")


def heading(text: str, style: str) -> bool:
    """By style, or a short numbered line."""
    return style.lower().startswith("heading") or (3 <= len(text.encode()) <= 120 and bool(NUMBERED.match(text)))


def docx_sections(content: bytes) -> list[tuple[str, str]]:
    """``(heading, body)`` of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    found: list[tuple[str, list[str]]] = [("", [])]
    for paragraph in root.iter(f"{W}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{W}t")).strip()
        style = next((s.get(f"{W}val", "") for s in paragraph.iter(f"{W}pStyle")), "")
        if not text:
            continue
        if heading(text, style):
            found.append((text, []))
        else:
            found[-1][1].append(text)
    return [(title, "\n".join(body)) for title, body in found if title or body]


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section, its heading first; files that cannot be read are counted, not fatal."""

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, error = docx_sections(content), None
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
                    found, error = [("", "")], type(problem).__name__
                n = len(found)
                texts = ["\n\n".join(filter(None, part)) for part in found]
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(n), pa.int32()), pa.array(texts), pa.array([error] * n, pa.string())], names=["file", "section", "text", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInArrow(sections, "file string, section int, text string, error string")


def pages(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page of extracted text, cut at form feeds; too little text is one placeholder."""
    enough = F.char_length(F.trim(text)) >= 100
    parts = F.when(enough, F.split(text, "\f")).otherwise(F.array(F.concat(F.lit("[no text in "), "source_title", F.lit("]"))))
    return texts.select("source_title", F.posexplode(parts).alias("page", "text")).where("trim(text) <> ''")


def captioned(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions by content, a placeholder where there is none."""
    met = images.withColumn("digest", F.sha2("content", 256)).join(captions, "digest", "left")
    return met.select("source_title", F.coalesce("caption", F.concat(F.lit("[image: "), "source_title", F.lit("]"))).alias("text"))


def transcript_turns(segments: DataFrame, target: int = 700) -> DataFrame:
    """Segments of a recording packed in order: a turn ends before it would reach ``target`` bytes.

    Where a turn ends depends on where the one before it began, so a task goes through its recordings in order and holds one turn at a
    time; texts are shuffled once.
    """
    said = segments.select("source_title", "start", "stop", F.trim("text").alias("text")).where("text <> ''")
    ordered = said.repartition("source_title").sortWithinPartitions("source_title", "start", "stop", "text")
    names = ["source_title", "turn", "start", "stop", "text"]
    types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn, filled, first, last, texts = None, -1, 0, 0.0, 0.0, []
        for batch in batches:
            closed = []
            for title, start, stop, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                size = len(text.encode())
                if texts and title == held and filled + size + 1 < target:
                    filled, last = filled + size + 1, stop
                    texts.append(text)
                    continue
                if texts:
                    closed.append((held, turn, first, last, " ".join(texts)))
                turn = turn + 1 if texts and title == held else 0
                held, filled, first, last, texts = title, size, start, stop, [text]
            if closed:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*closed), types, strict=True)], names=names)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip((held, turn, first, last, " ".join(texts)), types, strict=True)], names=names)

    turns = ordered.mapInArrow(deal, "source_title string, turn int, start double, stop double, text string")
    return turns.select("source_title", "turn", F.concat(F.lit("["), "source_title", F.lit(" - "), clock(F.col("start")), F.lit(" to "), clock(F.col("stop")), F.lit("]\n\n"), "text").alias("text"))
