"""Documents with every awkward case, for all operators on documents."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, rank int, part int"

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak tree and say nothing at all. "


def awkward_rows():
    long_text = " ".join(f"word{k % 977} and {k}" for k in range(40000))
    texts = [
        None, "", " \n\t ", "one", PROSE * 3, PROSE * 3, PROSE * 2 + "an ending of its own", "x" * 70000, long_text, long_text + " more",
        "mail jane.doe@example.org or call +49 30 1234567, host 10.0.0.1, card 4111 1111 1111 1111.", "tie é ünï 漢字 <|endoftext|> 1234", "A\nA\nB b b b\n\nA", PROSE[::-1],
    ]
    rows = [(k, text, None if k % 5 == 4 else "en", None if k % 7 == 3 else f"s{k % 3}", len(text or ""), "a", k, 1) for k, text in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, PROSE * 3, "en", "s0", 0, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
