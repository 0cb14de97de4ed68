"""Cutting long texts at natural places (G1, G2). The windows depend on each other, so this runs in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where a cut may follow: the first of two line breaks, a mark that ends a sentence, white space.
PARAGRAPHS, SENTENCES, BLANKS = (re.compile(pattern) for pattern in (r"\n(?=\n)", r"[.!?](?=\s)", r"\s"))


class Places:
    """The places in a text at which it may be cut, found once, and the best of them for a piece by bisection."""

    def __init__(self, text: str) -> None:
        self.paragraphs, self.sentences, self.blanks = ([m.start() for m in pattern.finditer(text)] for pattern in (PARAGRAPHS, SENTENCES, BLANKS))

    def cut(self, start: int, end: int) -> int:
        """After the last blank line that fits, the last sentence, before white space in the last fifth, or at ``end``."""
        for places, low, high, after in ((self.paragraphs, start, end - 2, 2), (self.sentences, start + 1, end - 1, 1), (self.blanks, max(end - (end - start) // 5, start) + 1, end - 1, 0)):
            at = bisect_right(places, high) - 1
            if at >= 0 and places[at] >= low:
                return places[at] + after
        return end


def chunk_text(text: str | None, size: int = 900, overlap: int = 150, least: int = 120) -> list[str]:
    """Pieces of at most ``size`` code points that overlap by ``overlap``; a piece under ``least`` joins the one before."""
    text = (text or "").strip()
    if not text or size <= 0 or len(text) <= size:
        return [text] if text else []
    overlap = min(max(overlap, 0), size) if overlap < size else size // 2
    places, pieces, start, end = Places(text), [], 0, 0
    while end < len(text):
        end = len(text) if start + size >= len(text) else places.cut(start, start + size)
        pieces.append(text[start:end].strip())
        start = end - overlap if end - overlap > start else end
    joined: list[str] = []
    for piece in filter(None, pieces):
        if joined and len(piece) < least:
            joined[-1] = f"{joined[-1]}\n{piece}"
        else:
            joined.append(piece)
    return joined


def chunked(df: DataFrame, text_col: str = "text", size: int = 900, overlap: int = 150, least: int = 120) -> DataFrame:
    """A row for each chunk: the row's columns with ``text_col`` cut, and ``chunk`` from 0. No shuffle."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    at = df.columns.index(text_col)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [chunk_text(text, size, overlap, least) for text in batch.column(at).to_pylist()]
            rows = pa.array([row for row, own in enumerate(pieces) for _ in own], pa.int64())
            columns = [column.take(rows) for column in batch.columns]
            columns[at] = pa.array([piece for own in pieces for piece in own], batch.schema.field(at).type)
            columns.append(pa.array([k for own in pieces for k in range(len(own))], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "chunk"])

    return df.mapInArrow(split, StructType([*df.schema.fields, StructField("chunk", IntegerType())]))
