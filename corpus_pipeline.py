"""A training corpus from raw documents: filter, deduplicate, redact, mix and pack.

Each stage takes and returns the columns of ``documents``; the last returns packed pieces. ``run``
writes what a stage returns to the shared folder and gives it to the next one, so that a stage is
never computed twice and lost executors cost no more than one stage.

Rows are told apart by their id and a digest of their text, so a null id or an id that occurs with
several texts is no special case. Rows that agree in both are copies of each other. Empty tables
give empty tables, and other columns are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoria.llm.common import fresh_name, materialize, read_table, row_key
from mnemoria.llm.copies import near_copies
from mnemoria.llm.mixing import mixed_documents
from mnemoria.llm.packing import concatenate_and_cut
from mnemoria.llm.pii import redacted_documents
from mnemoria.llm.quality import quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row by id and text, and the name of that column."""
    name = fresh_name(docs, "row")
    return docs.withColumn(name, row_key("doc_id", "text")), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep.

    Null, empty and blank texts have no words and go; very long texts are measured whole. Rows that agree in id and
    text have one verdict if they agree in language and source; otherwise a row is kept where any of them is.
    """
    rows, row = keyed(docs)
    kept = quality(rows, id_col=row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").drop(row)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one of the smallest id, null first.

    Candidates are links of SimHashes in a byte-position index; each is verified on the shingle sets.

    Null, empty and blank texts are one group, shorter texts than five words are one shingle, very long texts
    are compared whole. Of rows that agree in id and text, the first by the other columns stays; of an id with
    several texts, each text is a document.
    """
    rows, row = keyed(docs)
    first = near_copies(rows, id_col=row).where(F.col(row) == F.col("component_id")).select(row)
    rank = fresh_name(rows, "rank")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    one = Window.partitionBy(row).orderBy(*others or [F.lit(0)])
    return rows.join(first, row, "left_semi").withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).drop(row, rank)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind, and ``n_chars`` of the new text.

    Null texts stay null, empty ones empty; very long texts are searched whole; repeated rows stay.
    """
    return redacted_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and pass over its source.

    Texts without words are not in a mix, null among them; a null source is one like any other; of a very long
    text the mix may take a part; repeated rows are mixed as often as they occur.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens.

    A null or empty text is the end id alone; a very long one fills as many windows as it needs; repeated rows are
    packed as often as they occur.
    """
    return concatenate_and_cut(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("pii", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Fingerprints, trees and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of the folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
