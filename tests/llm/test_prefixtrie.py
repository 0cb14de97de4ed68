"""The trie against one built in memory, turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from mnemoria.llm import prefixtrie
from mnemoria.llm.prefixtrie import prefix_trie
from mnemoria.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part int, `key` string, seg binary"


def plain(rows):
    """Nodes as tuples in the order of the columns."""
    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            role, text = row[2] or "", row[3] or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[row[0]].append(((row[1] is not None, row[1] or 0), digest, (role, text)))
    own = {c: [turn for *_, turn in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children[prefix]
            saved[prefix[:d]] += (len(convs) - 1) * words
    return sorted(
        (min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else -1, len(convs), children[prefix], leaves[prefix], saved[prefix], hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(prefix)).encode()).hexdigest())
        for prefix, convs in members.items()
    )


def found(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversations(seed, n, alphabet=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        size = rng.choice([1, 1, 2, 3, 4, 5, longest, rng.randint(1, longest)])
        same = rng.random() < 0.3
        for turn in range(size):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", "w " * (1 if same else rng.randint(1, alphabet)), 1, "x", None))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def parts(spark):
    """Many partitions, so that most intervals span them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("seed", "piece", "n_parts", "longest"), [(1, 64, 7, 9), (2, 2, 9, 9), (3, 3, 5, 30), (4, 1, 6, 7)])
def test_random_conversations(spark, monkeypatch, parts, seed, piece, n_parts, longest):
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    monkeypatch.setattr(prefixtrie, "BLOCK", 4)
    parts(n_parts)
    rows = conversations(seed, 150, longest=longest)
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_copies_and_one_long_conversation(spark, parts):
    """Groups of copies over all partitions, and a conversation of a third of all turns that others follow for a while."""
    parts(6)
    rows = [(c, turn, "user", f"text {turn}", 1, None, None) for c in range(300) for turn in range(4)]
    for c, size in ((1001, 700), (1002, 300), (1003, 64), (1004, 128), (1005, 129), (1006, 300)):
        rows += [(c, turn, "user", f"long {turn if turn != 200 or c != 1006 else 'other'}", 1, None, None) for turn in range(size)]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(rows)


def test_awkward_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a  b\tc"), (0, 1, "user", "a  b\tc"), (0, 1, "", "userx"), (0, 1, "user", "x"), (None, 1, "user", "lost"), (7, 5, "user", ""), (9, 2, None, "é 漢字 " * 9000), (20, 1, "user", "q"), (41, 1, "user", "no base"), (-5, 0, "user", "negative"), (-25, 0, "user", "negative"), (3, 0, "u", "one"), (26, 0, "u", "one"), (27, 0, "u", "one")]
    rows = [(*row, 1, "x", None) for row in rows]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(2))) == plain(rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    turnless = [(2, 0, "u", "gone", 1, "x", None)]
    assert zlib.crc32(b"2") % 4 >= 1 and found(prefix_trie(spark.createDataFrame(turnless, SCHEMA))) == plain(turnless) == [(2, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"2").hexdigest())]


def test_the_table(spark, small):
    rows = [tuple(row) for row in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12_prefix_trie(spark, small)) == plain(rows)
