"""Recall: dense and lexical search, fusion, collapsing, caps, packs and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp_total, dedupe_key, first_present, lexical_tokens, query_tokens, query_words, tokens_in
from ..functions.times import flexible
from ..functions.vectors import cosine
from .predicates import HIDDEN, without_sources
from .searches import nearest

# The constant of reciprocal-rank fusion, and the boosts.
RRF = 60
CANONICAL_BOOST = 1.25
STATUS_BOOST = {"approved": 1.2, "direct": 1.2, "inferred": 1.08, "needs_review": 0.98}


def by_score(score: str = "score") -> list[Column]:
    """Best first; ties to the newer, then the smaller id."""
    return [F.desc(score), F.desc("ts"), F.asc("memory_id")]


def bounded(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows``, if there are no more than ``most``; what is sent to every task is checked first."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for a set that is sent to every task")
    return rows


def candidate_limit(k: int, widened: bool) -> int:
    """How many candidates hybrid search, collapsing and caps look at (R2)."""
    return max(40, min(4 * k, 200)) if widened else k


def boost() -> Column:
    """Canonical and reviewed points count for more."""
    status = F.lit(1.0)
    for name, factor in STATUS_BOOST.items():
        status = F.when(F.col("status") == name, F.lit(factor)).otherwise(status)
    return F.when(F.coalesce("canonical", F.lit(False)), F.lit(CANONICAL_BOOST)).otherwise(F.lit(1.0)) * status


def dense(points: DataFrame, query: list[float], k: int, vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest by cosine after the boost: one scan and a top-k, no shuffle of the points."""
    target = F.array(*(F.lit(float(x)) for x in query))
    scored = points.withColumn("score", F.round(cosine(F.col(vector), target) * boost(), 9)).where("score is not null")
    return scored.orderBy(*by_score()).limit(k)


def multi_query(points: DataFrame, queries: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """The ``k`` nearest of every query row ``(query_id, q)``, without the vectors."""
    pairs = nearest(points, queries, k).withColumn("score", F.round("score", 9)).where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def lexical_score(query: str | Column, *cols: str) -> Column:
    """Share of the query's tokens, repeats included, that any of the texts has.

    A query that is known is looked for token by token, so no text is taken apart.
    """
    if isinstance(query, str):
        wanted = query_words(query)
        return tokens_in(F.lower(F.concat_ws("\n", *cols)), wanted) / F.lit(len(wanted)) if wanted else F.lit(0.0)
    wanted = lexical_tokens(query)
    have = F.flatten(F.array(*(lexical_tokens(F.col(c)) for c in cols)))
    # Bound as a lambda's variable, the text's tokens are worked out once and not for each word of the query.
    found = F.get(F.transform(F.array(have), lambda h: F.size(F.filter(wanted, lambda t: F.array_contains(h, t)))), F.lit(0))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(found / F.size(wanted))


def lexical(points: DataFrame, query: str, k: int, *cols: str) -> DataFrame:
    """Points that share a token with the query, boosted."""
    wanted = set(query_words(query))
    text = F.lower(F.concat_ws("\n", *cols))
    # A token is a part of the text: a test that drops most texts before any pattern is tried.
    near = points.where(reduce(Column.__or__, (text.contains(token) for token in wanted))) if wanted else points.where(F.lit(False))
    # A generated column is no part of the condition on it, which would work it out once more.
    scored = near.select("*", F.explode(F.array(lexical_score(query, *cols))).alias("lexical_score")).where("lexical_score > 0")
    return scored.withColumn("score", F.round(F.col("lexical_score") * boost(), 9)).orderBy(*by_score()).limit(k)


def fuse(candidates: DataFrame, k: int, most: int = 200) -> DataFrame:
    """Reciprocal-rank fusion of ``score`` and ``lexical_score``.

    Works on the ``most`` best candidates of a search, so its windows are small whatever it is given.
    """
    candidates = candidates.orderBy(*by_score()).limit(most)
    every = Window.partitionBy(F.lit(0))
    first = F.row_number().over(every.orderBy(*by_score()))
    second = F.row_number().over(every.orderBy(F.desc("lexical_score"), F.desc("score"), F.desc("ts"), F.asc("memory_id")))
    ranked = candidates.withColumn("dense_rank", first).withColumn("lexical_rank", second)
    raw = F.lit(1.0) / (RRF + F.col("dense_rank")) + F.when(F.col("lexical_score") > 0, F.lit(1.0) / (RRF + F.col("lexical_rank"))).otherwise(F.lit(0.0))
    fused = ranked.withColumn("raw", raw).withColumn("fused", F.round(F.col("raw") / F.max("raw").over(every), 9))
    return fused.drop("raw", "dense_rank", "lexical_rank").orderBy(F.desc("fused"), F.desc("ts"), F.asc("memory_id")).limit(k)


def best_first(score: str = "score") -> Column:
    """The order of :func:`by_score` as one value; the least is the best."""
    return F.struct((-F.col(score)).alias("score"), (-F.col("ts")).alias("ts"), F.col("memory_id").alias("memory_id"))


def collapse(results: DataFrame, rank: Column | None = None, text: str = "text", quote: str = "source_quote") -> DataFrame:
    """One row for equal texts of a conversation, with the ids of the others.

    Groups are formed from digests, ranks and ids alone. Only rows of repeated texts meet the result of
    that, so texts are not moved where repeats are few.
    """
    key = dedupe_key(first_present(F.col(text), F.col(quote)))
    narrow = results.select("conversation_id", F.when(key == "", F.col("memory_id")).otherwise(F.sha2(key, 256)).alias("collapse_key"), (best_first() if rank is None else rank).alias("rank"), F.col("memory_id").alias("id"))
    groups = narrow.groupBy("conversation_id", "collapse_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("o")).where(F.size("o") > 1)
    ids = groups.select(F.col("o.id").alias("ids"))
    others = ids.select(F.explode(F.slice("ids", 2, F.size("ids"))).alias("memory_id"))
    firsts = ids.select(F.get("ids", F.lit(0)).alias("memory_id"), F.slice("ids", 2, F.size("ids")).alias("duplicate_ids"))
    kept = results.join(others, "memory_id", "left_anti").join(firsts, "memory_id", "left")
    return kept.withColumn("duplicate_ids", F.coalesce("duplicate_ids", F.array().cast("array<string>"))).withColumn("duplicate_count", F.size("duplicate_ids").cast("long"))


def cap_per_group(results: DataFrame, n: int, order: list[Column], group: str = "conversation_id", blank: str | None = None) -> DataFrame:
    """The first ``n`` of each conversation or source.

    Blank groups are exempt, as for conversations; with ``blank`` they share that key, as for sources. The limit
    is an own branch of the plan, so that Spark takes it below the sort.
    """
    none = F.trim(F.coalesce(F.col(group), F.lit(""))) == ""
    key = F.col(group) if blank is None else F.when(none, F.lit(blank)).otherwise(F.col(group))
    capped = results.where(~none) if blank is None else results
    first = capped.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n).drop("place")
    return first.unionByName(results.where(none)) if blank is None else first


def canonical_first(results: DataFrame, k: int) -> DataFrame:
    """Canonical ones first, then by score and time."""
    return results.orderBy(F.coalesce("canonical", F.lit(False)).desc(), *by_score()).limit(k)


def proposals(candidates: DataFrame, query: str, include_rejected: bool = False) -> DataFrame:
    """Candidates that are not canon yet as results: the share of the query's words found in summary and quotes, boosted.

    ``candidates`` has ``candidate_id, status, project, memory_kind, speaker, summary, quotes, ts``.
    """
    wanted = query.lower().split()
    if not wanted:
        candidates = candidates.where(F.lit(False))
    text = F.lower(F.concat_ws(" ", "summary", F.array_join("quotes", " ")))
    found = [text.contains(token).cast("int") for token in wanted] or [F.lit(0)]
    shown = candidates if include_rejected else candidates.where(~F.coalesce("status", F.lit("")).isin(*HIDDEN))
    shown = shown.withColumn("score", sum(found[1:], found[0]) / F.lit(max(len(wanted), 1))).where("score > 0").withColumn("canonical", F.lit(False))
    return shown.select(F.col("candidate_id").alias("memory_id"), F.lit("proposed_canon").alias("conversation_id"), F.lit("Proposed Canon").alias("source_title"), F.lit("proposed_canon").alias("source_type"), "ts", "speaker", "project", "memory_kind", "summary", F.coalesce(F.get("quotes", F.lit(0)), F.lit("")).alias("source_quote"), F.round(F.col("score") * boost(), 9).alias("score"), "canonical", "status")


def with_proposals(results: DataFrame, proposed: DataFrame, k: int) -> DataFrame:
    """Results and proposals together, canonical ones first."""
    return canonical_first(results.unionByName(proposed, allowMissingColumns=True), k)


def research(points: DataFrame, query: list[float], k: int, excluded: tuple[str, ...] = (), per_source: int = 0, nearest: bool = False) -> DataFrame:
    """The ``k`` nearest points, without excluded sources and with at most ``per_source`` chunks of each; ``nearest`` asks for no variety.

    ``points`` has the columns of a provenance view and ``embedding``; what has no source shares one.
    """
    varied = per_source > 0 and not nearest
    target = F.array(*(F.lit(float(x)) for x in query))
    order = [F.desc("score"), F.asc("memory_id")]
    scored = points.withColumn("score", F.round(cosine(F.col("embedding"), target), 9)).where("score is not null")
    found = scored.orderBy(*order).limit(min(5 * k, 200) if varied else k)
    # Excluded sources are taken from what was found, as the search knows nothing of them.
    left = without_sources(found, tuple(name.strip() for name in excluded if name.strip()))
    return (cap_per_group(left, per_source, order, "fingerprint", "_unknown") if varied else left).orderBy(*order).limit(k)


def told(results: DataFrame) -> DataFrame:
    """``place, line`` of results as a tool tells them: number, id, kind, score, and the first of quote, summary and text."""
    placed = results.orderBy(*by_score()).withColumn("place", F.row_number().over(Window.orderBy(*by_score())))
    head = F.format_string("[%d] memory_id=%s kind=%s score=%.3f", "place", "memory_id", "memory_kind", "score")
    body = first_present(F.col("source_quote"), F.col("summary"), clamp_total(F.col("text"), 300))
    return placed.select("place", F.when(body == "", head).otherwise(F.concat(head, F.lit("\n    "), body)).alias("line"))


def tool_limit(asked: int, default: int = 8, most: int = 20) -> int:
    """How many results a tool gives."""
    return min(asked if asked > 0 else default, most)


def chronological(results: DataFrame) -> DataFrame:
    """By creation, else modification; undated ones last, by id."""
    return results.orderBy(F.coalesce(flexible(F.col("created_date")), flexible(F.col("modified_date"))).asc_nulls_last(), "memory_id")


def overlap_at_k(exact: DataFrame, approximate: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, shared, in_place``: how much of the exact first ``k`` another search found, and how much at the same rank."""
    lists = [found.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias(name)) for found, name in ((exact, "e"), (approximate, "a"))]
    met = lists[0].join(lists[1], "query_id", "left")
    a = F.coalesce(F.col("a.id"), F.array().cast(lists[0].schema["e"].dataType.elementType["id"].dataType.simpleString().join(("array<", ">"))))
    in_place = F.size(F.filter(F.arrays_zip(F.col("e.id").alias("x"), a.alias("y")), lambda z: z["x"] == z["y"]))
    return met.select("query_id", F.size(F.array_intersect(F.col("e.id"), a)).cast("long").alias("shared"), in_place.cast("long").alias("in_place"))


def floor(results: DataFrame, least: float) -> DataFrame:
    """Scores from ``least`` on, where that is set."""
    return results.where(F.col("score") >= least) if least > 0 else results


def keyword(points: DataFrame, query: str, k: int, *cols: str) -> DataFrame:
    """Share of the query's tokens contained in the texts; the best ``k`` of all."""
    wanted = query_tokens(F.lit(query))
    text = F.lower(F.concat_ws(" ", *cols))
    score = F.size(F.filter(wanted, lambda t: text.contains(t))) / F.size(wanted)
    return points.withColumn("score", F.round(score, 9)).where("score > 0").orderBy(F.desc("score"), "memory_id").limit(k)


def context_pack(results: DataFrame, budget: int, order: list[Column], *cols: str, most: int = 1000) -> DataFrame:
    """Rows in order while they fit; a row that does not fit is skipped, not the end.

    Cost is in bytes. A fold over the first ``most`` rows in order; ``used`` and ``dropped`` are the bytes taken and the
    number of rows left out.
    """
    cost = sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in cols), F.lit(0))
    first = results.orderBy(*order).limit(most)
    costed = first.withColumn("cost", cost.cast("long")).withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    rows = costed.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "cost"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    packed = F.aggregate("rows", start, lambda s, r: F.when(s["used"] + r["cost"] <= budget, F.struct((s["used"] + r["cost"]).alias("used"), F.concat(s["kept"], F.array(r["pos"])).alias("kept"))).otherwise(s))
    kept = rows.select(packed.alias("p"), F.size("rows").alias("n")).select(F.explode("p.kept").alias("pos"), F.col("p.used").alias("used"), (F.col("n") - F.size("p.kept")).cast("long").alias("dropped"))
    return costed.join(kept, "pos")


def merge_best(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both result sets, the better score for an id in both."""
    both = first.unionByName(second)
    return both.groupBy("memory_id").agg(F.max("score").alias("score"))


def retrieval_thin(results: DataFrame, derived_type: str = "derived_chat") -> DataFrame:
    """One row: mean score, share of derived rows, and whether a second pass is due."""
    found = results.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg((F.col("source_type") == derived_type).cast("int")), 6).alias("derived_share"))
    return found.withColumn("thin", (F.col("n") == 0) | (F.col("mean_score") < 0.55) | (F.col("derived_share") > 0.6))
