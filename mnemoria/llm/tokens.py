"""Tokenizers of the public vocabulary files, and token counts of whole texts.

:func:`token_counts` is operator 6: batch encoding inside Arrow functions that return lengths
only. Texts are cut at places where no token can span the cut and the pieces are dealt into
batches of about equal bytes, each one call of the library, so neither one huge text nor many tiny
ones decide the size of a batch.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text in one call of the library, and the length in characters from which a text is cut.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

#: White space after something else, or a digit after a letter, starts a token in byte-level BPE.
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])|(?<=[A-Za-z])(?=[0-9])")


class Encoder(Protocol):
    dtype: type

    def ids(self, text: str) -> np.ndarray: ...

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each text, in one call of the library."""


class RankEncoder:
    """Byte-level BPE by ranks; gives the same ids as the JSON form of the same vocabulary."""

    dtype = np.uint32

    def __init__(self, path: str, special: dict[str, int]) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def lengths(self, texts: list[str]) -> list[int]:
        # One thread: a task has one core.
        return list(map(len, self.encoding.encode_batch(texts, num_threads=1, allowed_special="all")))


class JsonEncoder:
    """The ``tokenizers`` library, with its defaults for special strings inside texts."""

    dtype = np.uint32

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))


class PieceEncoder:
    """The ``sentencepiece`` library."""

    dtype = np.uint32

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.processor.encode(text), dtype=np.uint32)

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.processor.encode(texts, num_threads=1)))


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a public vocabulary file, loaded once in a worker.

    ``byte_bpe_50k.json`` is run through its rank file, which holds the same vocabulary and
    encodes about six times faster; tests hold the two against each other.
    """
    import public_tokenizers

    if vocabulary == "byte_bpe_50k.json":
        return RankEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
    path = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".json"):
        return JsonEncoder(path)
    if vocabulary.endswith(".model"):
        return PieceEncoder(path)
    return RankEncoder(path, {})


def safe_to_cut(vocabulary: str) -> bool:
    """Only byte-level BPE is sure to start a token at :data:`SAFE_CUT`."""
    return vocabulary.startswith("byte_bpe")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that encode as the whole does.

    A piece grows beyond ``size`` while no safe cut follows (one unbroken word stays whole).
    """
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def balanced(texts: list[str], cut: bool, batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Indexes of texts and their pieces, in batches of at most ``batch_bytes`` in UTF-8; only a piece that is larger itself goes beyond."""
    owners: list[int] = []
    batch: list[str] = []
    filled = 0
    for index, text in enumerate(texts):
        for piece in pieces(text) if cut else (text,):
            if not piece:
                continue
            size = len(piece.encode())
            if batch and filled + size > batch_bytes:
                yield owners, batch
                owners, batch, filled = [], [], 0
            owners.append(index)
            batch.append(piece)
            filled += size
    if batch:
        yield owners, batch


def count_batch(texts: list[str], vocabulary: str, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    counts = np.zeros(len(texts), dtype=np.int64)
    coder = encoder(vocabulary)
    for owners, batch in balanced(texts, safe_to_cut(vocabulary), batch_bytes):
        np.add.at(counts, owners, coder.lengths(batch))
    return counts


def encode(text: str, vocabulary: str) -> np.ndarray:
    """All ids of one text."""
    coder = encoder(vocabulary)
    if not text:
        return np.zeros(0, dtype=np.uint32)
    if len(text) <= PIECE_CHARS or not safe_to_cut(vocabulary):
        return coder.ids(text)
    return np.concatenate([coder.ids(piece) for piece in pieces(text)])


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: ``(id, n_bytes, n_tokens, over_limit)``, a row for each row.

    A null text counts as an empty one (0 bytes, 0 tokens); null ids and repeated rows are kept
    as they are; a very long text is counted whole, in pieces; an empty table gives an empty one; other
    columns are ignored. There is no shuffle: each task reads its own split, and memory is bounded by one
    Arrow batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            tokens = count_batch(texts, vocabulary)
            sizes = np.fromiter((len(text.encode()) for text in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(count, schema)
