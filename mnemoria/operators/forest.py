"""Depth-first places in forests of any size and depth: Euler tours and list ranking.

A conversation of ordinary size is put in order in one call (``sources.exports.thread_order``). Here a tree may hold a
third of all rows, be a single chain or a single star: each node is gone into and out of, which makes a list of the
whole tour, and pointers along it are doubled until they reach its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

# Copies of a group's row, so that a group that holds a large part of all rows is joined in so many tasks.
SALTS = 32


def sorted_parts(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` in global order as a table: ``_part`` by ranges, and ``_k``, the place in the part, from 1."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    return dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))


def by_group(rows: DataFrame, groups: DataFrame, group: str, spread: str) -> DataFrame:
    """``rows`` with the row of their group; a large group is met in ``SALTS`` pieces. Null groups meet as well."""
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(group, "_group")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [salted[group].eqNullSafe(copies["_group"]), salted["_salt"] == copies["_salt"]], "left").drop("_salt", "_group")


def places(rows: DataFrame, group: str, order: list[str], name: str, spread: str) -> DataFrame:
    """Adds ``name``, the place of a row in its group by ``order``, from 0. No group is sorted in one task."""
    found = sorted_parts(rows, [F.asc(group), *(F.asc(c) for c in order)], "ranks")
    # A row for each part: as many as the range exchange made.
    counts = found.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = found.join(before, F.col("_part") == F.col("_p")).withColumn("_at", F.col("_before") + F.col("_k"))
    first = at.groupBy(group).agg(F.min("_at").alias("_first"))
    return by_group(at, first, group, spread).select(*rows.columns, (F.col("_at") - F.col("_first")).alias(name))


def siblings(nodes: DataFrame) -> DataFrame:
    """``g, id, parent, sibling``: the next child of the same parent, if any, found along one global order."""
    order = ["g", "parent", "untimed", "time", "id"]
    found = sorted_parts(nodes, [F.asc(c) for c in order], "siblings")
    inside = Window.partitionBy("_part").orderBy(*order)
    key = F.struct("g", "parent", "id")
    firsts = found.where("_k = 1").select("_part", key.alias("_first"))
    # The part after a part is the next that has rows.
    after = firsts.select(F.col("_part").alias("_p"), F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    follows = found.withColumn("_next", F.lead(key).over(inside)).join(after, F.col("_part") == F.col("_p")).withColumn("_next", F.coalesce("_next", "_after"))
    same = F.col("_next.g").eqNullSafe(F.col("g")) & F.col("_next.parent").eqNullSafe(F.col("parent"))
    return follows.select("g", "id", "parent", F.when(same, F.col("_next.id")).alias("sibling"))


def tour(nodes: DataFrame) -> DataFrame:
    """``g, id, up, to_id, to_up, steps``: for going into a node and out of it, what comes next and the nodes gone into till then.

    ``to_id`` is null at the end of a tour. Out of the last child of a parent that is not there leads to nothing.
    """
    linked = written(siblings(nodes), "linked")
    order = F.struct("untimed", "time", "id")
    children = nodes.where("parent is not null").groupBy("g", "parent").agg(F.min_by("id", order).alias("child"))
    c = children.select(F.col("g").alias("_g"), F.col("parent").alias("_id"), "child")
    into = linked.join(c, F.col("g").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_id")), "left")
    down = into.select("g", "id", F.lit(False).alias("up"), F.coalesce("child", "id").alias("to_id"), F.col("child").isNull().alias("to_up"), F.lit(1).cast("long").alias("steps"))
    up = linked.select("g", "id", F.lit(True).alias("up"), F.coalesce("sibling", "parent").alias("to_id"), F.col("sibling").isNull().alias("to_up"), F.lit(0).cast("long").alias("steps"))
    return down.unionByName(up)


def ranked(steps: DataFrame) -> DataFrame:
    """Pointers doubled till no more of them reach the end: a round for each doubling of the longest tour.

    The distances to an end are 1, 2, 3 and so on, so a round that brings nothing to its end was the last. What is left goes
    in circles or leads to nothing.
    """
    state, open_before = written(steps, "tour"), None
    while True:
        left = state.where("to_id is not null").count()
        if left in (0, open_before):
            return state
        open_before = left
        goal = state.select(F.col("g").alias("_g"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("to_id").alias("_to"), F.col("to_up").alias("_to_up"), F.col("steps").alias("_steps"))
        # Every pointer leads to another row, so no key is hot; those at the end are not joined.
        met = state.where("to_id is not null").join(goal, F.col("g").eqNullSafe(F.col("_g")) & (F.col("to_id") == F.col("_id")) & (F.col("to_up") == F.col("_up")), "left")
        lost = F.col("_id").isNull()
        moved = met.select("g", "id", "up", F.when(lost, F.col("to_id")).otherwise(F.col("_to")).alias("to_id"), F.when(lost, F.col("to_up")).otherwise(F.col("_to_up")).alias("to_up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        state = written(moved.unionByName(state.where("to_id is null")), "tour")


def thread_places(messages: DataFrame, group: str = "conversation_id", key: str = "message_id", parent: str = "parent_id", time: str = "ts") -> DataFrame:
    """Adds ``turn`` to messages: depth first along the parents, siblings by time then id; what no root reaches follows, by time then id.

    A blank or null parent makes a root. Untimed messages come after timed ones. Messages without an id are left out, and of
    a repeated id the earliest is taken. Circles, own parents and parents that are not there end in the rest. A null group is
    a group. An empty table gives an empty one.
    """
    column = F.trim(F.coalesce(F.col(parent), F.lit("")))
    nodes = messages.select(F.col(group).alias("g"), F.trim(key).alias("id"), F.when(column != "", column).alias("parent"), F.col(time).isNull().alias("untimed"), F.col(time).alias("time")).where("id <> ''")
    one = written(nodes.groupBy("g", "id").agg(F.min_by(F.struct("parent", "untimed", "time"), F.struct("untimed", "time", "parent")).alias("n")).select("g", "id", "n.*"), "nodes")
    state = ranked(tour(one)).where("not up")
    reached = state.where("to_id is null").select("g", "id", "steps")
    totals = reached.groupBy("g").agg(F.count("*").alias("_total"))
    placed = by_group(reached, totals, "g", "id").select("g", "id", (F.col("_total") - F.col("steps")).alias("turn"))
    lost = state.where("to_id is not null").select(F.col("g").alias("_g"), F.col("id").alias("_id"))
    rest = one.join(lost, F.col("g").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_id"))).select("g", "id", "untimed", "time")
    late = by_group(places(rest, "g", ["untimed", "time", "id"], "turn", "id"), totals, "g", "id").select("g", "id", (F.col("turn") + F.coalesce("_total", F.lit(0))).alias("turn"))
    return placed.unionByName(late).select(F.col("g").alias(group), F.col("id").alias(key), F.col("turn").cast("long").alias("turn"))
