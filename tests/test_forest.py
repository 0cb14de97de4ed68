"""Places by Euler tours against the order of one conversation at a time."""

import random

from mnemoria.operators import forest
from mnemoria.sources.exports import thread_order

SCHEMA = "conversation_id string, message_id string, parent_id string, ts double"


def plain(rows):
    found = {}
    for group in {row[0] for row in rows}:
        own = [row for row in rows if row[0] == group]
        stated = [{"uuid": key, "parent_message_uuid": parent, "created_at": None if ts is None else f"2024-01-01T00:{int(ts) // 60:02}:{int(ts) % 60:02}Z"} for _, key, parent, ts in own]
        found |= {(group, own[k][1]): turn for turn, k in enumerate(thread_order(stated))}
    return found


def distributed(spark, rows):
    found = forest.thread_places(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {(r.conversation_id, r.message_id): r.turn for r in found}
    assert len(got) == len(found)
    return got


def test_random_forests_with_orphans_and_circles(spark):
    dealt, rows = random.Random(3), []
    for g in range(12):
        size = dealt.choice([1, 2, 5, 30])
        for k in range(size):
            kind = dealt.random()
            parent = "" if k == 0 or kind < 0.1 else "gone" if kind < 0.2 else f"m{dealt.randrange(size)}" if kind < 0.35 else f"m{dealt.randrange(k)}"
            rows.append((f"c{g}", f"m{k}", dealt.choice([parent, f" {parent} "]) or None, None if dealt.random() < 0.2 else float(dealt.randrange(20))))
    assert distributed(spark, rows) == plain(rows)


def test_circles_own_parents_and_null_groups(spark):
    rows = [("a", "x", "y", 1.0), ("a", "y", "x", 0.0), ("b", "s", "s", None), ("b", "r", None, 5.0), (None, "n", "", 2.0), (None, "o", "n", 1.0), (None, "p", "none", None)]
    assert distributed(spark, rows) == plain(rows) == {("a", "y"): 0, ("a", "x"): 1, ("b", "r"): 0, ("b", "s"): 1, (None, "n"): 0, (None, "o"): 1, (None, "p"): 2}


def test_a_chain_and_a_star(spark):
    chain = [("chain", f"m{k}", f"m{k - 1}" if k else None, 0.0) for k in range(100_000)]
    star = [("star", f"m{k:05d}", "m00000" if k else None, float(-k)) for k in range(20_000)]
    got = distributed(spark, chain + star)
    assert all(got["chain", f"m{k}"] == k for k in range(100_000))
    assert all(got["star", f"m{k:05d}"] == (20_000 - k if k else 0) for k in range(20_000))


def test_blank_and_repeated_ids(spark):
    rows = [("a", "", None, 1.0), ("a", None, None, 1.0), ("a", "m", None, 2.0), ("a", "m", None, 1.0), ("a", "k", "m", 0.0)]
    assert distributed(spark, rows) == {("a", "m"): 0, ("a", "k"): 1}


def test_an_empty_table(spark):
    assert forest.thread_places(spark.createDataFrame([], SCHEMA)).collect() == []
