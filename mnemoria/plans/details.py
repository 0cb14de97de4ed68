"""Queries on the smaller operators: text, times, filters, pages, sessions, queues; several of them to a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..functions.ids import evidence_fingerprint
from ..functions.vectors import dimension_status
from ..operators import canon, catalog, cleanup, evidence, ingest, predicates, recall, reflection
from ..operators.predicates import SearchFilters, visible
from .curation import CLUSTERS_SQL, any_of, found_candidates, linked, quoted
from .recall import BOOST, HIDDEN, QUERY, query_vector
from .relations import MESSAGES_SQL, POINTS_SQL, VECTORS_SQL, messages, points, table, vectors

OPENINGS = ("I prefer the", "we decided on a", "actually however the", "generic structure of", "please remember this", "my persona must", "plain words about")


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose texts begin with words that signal something."""
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    return points(spark, sf_dir).withColumn("said", F.concat_ws(" ", opening, "text"))


def t06_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, contradiction, generic words, signals, file types, suggestions, references, lists and fingerprints."""
    p = opened(spark, sf_dir)
    signal = T.message_signal(F.col("said"))
    told = F.when(F.col("doc_id") % 2 == 0, F.concat("summary", F.lit("\nSUGGESTIONS: one | two ||"))).otherwise(F.col("summary"))
    file = F.when(F.col("doc_id") % 3 == 1, F.concat("source_title", F.lit(".PNG"))).otherwise(F.replace("source_title", F.lit(".md"), F.lit(".pdf")))
    hypotheses = T.hypothesis_list(F.concat(F.lit("A| first ;; "), "project", F.lit("; |third")))
    return p.select(
        "memory_id", F.round(T.lexical_overlap(F.lit("prefer generic plain structure decided"), F.col("said")), 6).alias("overlap"), T.contradiction_signal(F.col("said")).alias("contradicts"),
        T.without_generic(F.col("said")).alias("kept"), T.dedupe_key(F.col("said")).alias("key"), signal["kind"].alias("kind"), signal["importance"].alias("importance"), signal["tag"].alias("tag"), T.mime_type(file).alias("mime"),
        F.array_join(T.suggestions(told), "+").alias("suggested"), T.attachment_ref(F.concat(F.lit(" file-service://"), "memory_id")).alias("ref"), F.array_join(T.listed(F.concat_ws(",", "project", F.lit(" x"), "project")), "+").alias("listed"),
        F.array_join(F.transform(hypotheses, lambda h: F.concat_ws(":", h["id"], h["statement"], h["rank"].cast("string"))), "+").alias("hypotheses"),
        evidence_fingerprint(F.concat(F.lit(" Q "), "project"), F.lit("s"), F.array("speaker", "project", "speaker"), F.col("memory_kind")).alias("fingerprint"),
    )


def t26_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of six forms: any form, as written, checked, and with a warning."""
    n = F.col("doc_id") % 6
    forms = F.when(n == 0, F.col("ts").cast("string")).when(n == 1, F.concat(F.col("ts").cast("string"), F.lit(".5"))).when(n == 2, times.written(F.timestamp_seconds("ts"))).when(n == 3, F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")).when(n == 4, F.lit(" ")).otherwise(F.lit("soon"))
    p = points(spark, sf_dir).withColumn("form", forms)
    _, warning = times.normalized(F.col("form"))
    strict = F.when(n.isin(2, 3, 4), times.strict(F.when(n.isin(2, 3, 4), F.col("form")), F.lit("2000-01-01").cast("timestamp")))
    return p.select("memory_id", times.written(times.flexible(F.col("form"))).alias("any_form"), F.coalesce(F.when(n < 2, F.lit("number")), warning).alias("warning"), times.written(strict).alias("strict"))


def f02_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points each filter passes."""
    p = points(spark, sf_dir).withColumns({"tags": F.array(F.upper("project"), F.concat(F.lit(" "), "memory_kind")), "pinned": F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 2 == 0), "attachment_source_system": F.when(F.col("doc_id") % 7 == 0, "library_files").when(F.col("doc_id") % 7 == 1, " ")})
    filters = {
        "by_kind": SearchFilters(memory_kind="FACT", source_type="Summary"), "by_tags": SearchFilters(tags=(" EN ", "fact")), "by_time": SearchFilters(since=1704067200 + 600, until=1704067200 + 6000), "unpinned": SearchFilters(pinned=False),
        "attached": SearchFilters(has_attachment=True), "exact": SearchFilters(project="EN", exact=True), "approved": SearchFilters(status="Approved", canonical=False),
    }
    flags = [F.coalesce(f.predicate(), F.lit(False)).alias(name) for name, f in filters.items()]
    equal = predicates.equal_fields({"project": " en ", "speaker": "", "memory_kind": "fact"}, {"ts": (None, 1704067200 + 9000)})
    left = predicates.without_sources(p, ("DOC_7", "file 12.md")).select("memory_id", F.lit(True).alias("left"))
    hidden = predicates.suppressed(p.select("memory_id", "source_quote", F.col("text")), quotes=False).select("memory_id", F.char_length("source_quote").cast("long").alias("quote_chars"))
    return p.select("memory_id", *flags, F.coalesce(equal, F.lit(False)).alias("equal")).join(left, "memory_id", "left").join(hidden, "memory_id").select("memory_id", *filters, "equal", F.coalesce("left", F.lit(False)).alias("left_in"), "quote_chars")


def g18_backfill_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank projects filled, and a fourth of the points under new ids."""
    p = points(spark, sf_dir).select("memory_id", F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("project")).alias("project"), "doc_id")
    mapping = p.where("doc_id % 4 = 0").select(F.col("memory_id").alias("old_memory_id"), F.concat(F.lit("new_"), "memory_id").alias("new_memory_id"))
    return ingest.rekeyed(ingest.backfill(p, "project", "general").drop("doc_id"), mapping)


def a08_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees of two children to a message."""
    from ..sources.exports import branch_statistics

    parent = F.when(F.col("turn") > 0, F.concat_ws("-", "conversation_id", F.floor((F.col("turn") - 1) / 2)))
    return branch_statistics(messages(spark, sf_dir).withColumn("parent_id", parent))


def a12_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("place", F.lit(" "))
    return catalog.missing_fields(p, {"title": ("filename", "source_title"), "page": ("page", "place"), "author": ("author",), "time": ("created", "ts")})


def a03_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all points and of the first 100, with the number of points that pass a filter (A1, A3, A5)."""
    p = points(spark, sf_dir)
    both = catalog.titles(p, 12).withColumn("of", F.lit("all")).unionByName(catalog.titles(p, 12, 100).withColumn("of", F.lit("first")))
    return both.unionByName(catalog.counted(p, F.col("speaker") == "user").select(F.lit("user points").alias("value"), "n", F.lit("count").alias("of")))


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.select(F.col("conversation_id").alias("session_id"), F.col("message_id").alias("thought_id"), F.col("speaker").alias("thought_type"), F.md5((F.char_length("text") % 40).cast("string")).alias("fingerprint"), "ts", "turn", F.lit("HIGH").alias("gain"), F.array(F.concat(F.lit(" h"), (F.col("turn") % 3).cast("string")), F.lit("H9")).alias("targets"), F.lit("Open").alias("status"))


def a22_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New thoughts against the first of each session, the newest two of a kind, and a filter on them."""
    t = thoughts(spark, sf_dir)
    told = evidence.recorded(t.where("turn > 0").drop("status"), t.where("turn = 0").select("session_id", "fingerprint"))
    newest = evidence.thought_summary(told, 2)
    about = predicates.thoughts_where(t, hypothesis="H1 ", status="open", thought_type="user").select("thought_id", F.lit(True).alias("about"))
    return newest.join(about, "thought_id", "left").select("session_id", "thought_type", "thought_id", "place", "n", "status", "gain", F.coalesce("about", F.lit(False)).alias("about"))


def e10_information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).groupBy(F.col("project").alias("hypothesis_id")).agg(F.avg(F.col("doc_id") % 100 / 100).alias("confidence"), F.length(F.max("project")).alias("rank"))
    after = p.select("hypothesis_id", (F.col("confidence") + 0.02).alias("new_confidence"), F.col("rank").alias("new_rank"))
    same = p.select("hypothesis_id", F.col("confidence").alias("new_confidence"), F.col("rank").alias("new_rank"))
    other = after.withColumn("new_rank", F.col("new_rank") + 1)
    gains = [evidence.information_gain(p, x).select(F.lit(name).alias("case"), "gain") for name, x in (("moved", after), ("same", same), ("reordered", other))]
    return gains[0].unionByName(gains[1]).unionByName(gains[2])


def e14_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy that is left with the best record."""
    m = messages(spark, sf_dir)
    outcomes = m.select(F.col("conversation_id").alias("uncertainty"), F.concat(F.lit("s"), (F.col("turn") % 3).cast("string")).alias("strategy"), (F.char_length("text") % 2 == 0).alias("success"), ((F.col("turn") % 7 == 4) | (F.col("ts") / 86400 % 9 < 1)).alias("exhausted"))
    listed = F.when(F.col("uncertainty").cast("long") % 2 == 0, F.array(*map(F.lit, ("s0", "s1")))).otherwise(F.array(*map(F.lit, ("s0", "s1", "s2", "s3"))))
    offered = m.select(F.col("conversation_id").alias("uncertainty")).distinct().select("uncertainty", F.posexplode(listed).alias("pos", "strategy"))
    return evidence.exhausted(outcomes, offered)


def e16_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = messages(spark, sf_dir).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.char_length("text") % 2).alias("step")))).alias("s"))
    return steps.select("conversation_id", evidence.cycles(F.transform("s.step", lambda x: x.cast("string"))).alias("cycles"))


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("first"))
    k = F.col("conversation_id").cast("int")
    question = F.when(k % 4 == 0, F.concat(F.lit("the EARLIEST "), "first")).when(k % 4 == 1, F.concat(F.lit("a citation of "), "first")).otherwise("none of these")
    return m.select("conversation_id", "n", k.alias("k"), question.alias("question"))


def e12_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session should resolve, what its evidence makes of that, and its best question."""
    s, k = session_states(spark, sf_dir), F.col("k")
    blockers = F.when(k % 5 == 3, F.array(F.lit("SOURCE_QUALITY"))).otherwise(F.array().cast("array<string>"))
    now = evidence.highest_uncertainty(k % 11 == 10, F.when(k % 7 == 6, F.lit("CONTRADICTION")), k % 6 - 4, blockers, F.col("question"), k % 3)
    tier = F.element_at(F.array(*map(F.lit, evidence.TIERS)), (k % len(evidence.TIERS) + 1).cast("int"))
    again = evidence.reclassified(F.when(k % 2 == 0, F.lit("RETRIEVAL_LIMIT")).otherwise(""), F.col("n") % 4, (k % 10) / 10, tier, k % 9 == 8, F.col("question"))
    asked = s.select(F.col("conversation_id").alias("session_id"), F.posexplode(F.array(F.lit("What now?"), F.lit("What counter evidence is upstream?"), F.lit(" "), F.lit("Where is the first draft?"))).alias("pos", "question"), F.lit("What now?").alias("current"), F.when(k % 2 == 0, "What now?").alias("wanted"))
    best = evidence.most_discriminating(asked).select(F.col("session_id").alias("conversation_id"), F.col("question").alias("best"), F.col("score").cast("long").alias("best_score"))
    return s.select("conversation_id", now.alias("uncertainty"), again["uncertainty"].alias("again"), again["reason"].alias("reason")).join(best, "conversation_id")


def e05_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence says, and the ledger of searches of a session."""
    p = points(spark, sf_dir)
    said = evidence.envelope({"text": F.when(F.col("doc_id") % 2 == 0, F.col("text")), "summary": F.lit(" "), "source_title": F.col("source_title"), "path": F.col("conversation_id")})
    searched = p.select(F.col("project").alias("session_id"), F.col("doc_id").alias("pos"), F.col("memory_kind").alias("query"), F.array("speaker", "memory_kind").alias("sources"))
    ledger = evidence.source_ledger(searched.where("doc_id % 2 = 0"), searched.where("doc_id % 2 = 1")).select("session_id", "searches", F.array_join(F.array_sort("sources"), ",").alias("sources"))
    return p.select("memory_id", "project", F.array_join(said["fields"], ",").alias("fields"), said["body"].alias("body")).join(ledger, F.col("project") == F.col("session_id")).drop("session_id")


def r17_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    given = m.select(F.col("conversation_id").alias("session_id"), F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("message_id")).alias("hypothesis_id"), F.when(F.col("turn") % 3 > 0, F.col("text")).alias("statement"), (F.col("turn") % 4 - 1.0).alias("confidence"), F.lit(2.0).alias("strength"), (F.lit(9) - F.col("turn")).alias("rank"), F.lit(None).cast("string").alias("status"), (F.col("turn") + 1).alias("pos"))
    return evidence.seeded(given)


def anchored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked(spark, sf_dir)
    return p.select("memory_id", "source_title", (F.col("doc_id") % 4).alias("chunk_index"), (F.col("doc_id") % 3).alias("turn_index"), F.when(F.col("doc_id") % 5 == 0, F.col("ts")).alias("original_ts"), "parent_id", "cites", F.array().cast("array<string>").alias("derived_from"), "source_type", "conversation_id")


def n02_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best node of every title, whatever its case, and what a trace from it lacks."""
    nodes = anchored_nodes(spark, sf_dir)
    asked = nodes.select(F.upper("source_title").alias("anchor")).distinct()
    best = evidence.best_anchors(evidence.anchor_matches(nodes, asked, ("memory_id", "source_title")))
    lacks = evidence.weaknesses(F.col("original_ts").isNotNull(), F.col("chunk_index") > 1, F.when(F.col("turn_index") == 0, F.lit(" ")).otherwise(F.col("source_type")), F.col("source_title"))
    return best.join(nodes, "memory_id").select("anchor", "memory_id", "score", F.array_join(lacks, "+").alias("lacks"))


def v04_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 5
    broken = F.when(n == 0, F.lit(None)).when(n == 1, F.slice("embedding", 1, 0)).when(n == 2, F.slice("embedding", 1, 7)).otherwise(F.col("embedding"))
    return e.select("vec_id", dimension_status(broken, 64).alias("status"))


def r10_canonical_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results and proposed facts together, canonical ones first."""
    found = recall.dense(visible(vectors(spark, sf_dir)), query_vector(spark, sf_dir), 30)
    proposed = recall.proposals(found_candidates(spark, sf_dir), QUERY)
    results = found.select("memory_id", "conversation_id", "source_title", "source_type", "ts", "speaker", "project", "memory_kind", "summary", "source_quote", "score", "canonical", "status")
    return recall.with_proposals(results, proposed, 40).select("memory_id", "conversation_id", F.round("score", 6).alias("score"), "canonical", "status")


def r12_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of each source; those without a name share one."""
    scored = points(spark, sf_dir).withColumns({"score": (F.col("doc_id") * 7919 % 1000) / 1000, "source_title": F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source_title"))})
    return recall.cap_per_group(scored, 2, recall.by_score(), "source_title", "_unknown").select("memory_id", "source_title", "score")


def r15_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a document in order, and the first points by the dates they have."""
    p = points(spark, sf_dir)
    dated = p.withColumns({"created_date": F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(times.written(F.timestamp_seconds(F.col("ts") - (F.col("doc_id") % 10) * 86400))), "modified_date": F.when(F.col("doc_id") % 6 == 0, "").otherwise(times.written(F.timestamp_seconds("ts")))})
    first = recall.chronological(dated).limit(25).select(F.lit("dated").alias("of"), "memory_id")
    return evidence.document_chunks(p, " en ", ("conversation_id", "project"), ("ts",), 30).select(F.lit("chunks").alias("of"), "memory_id").unionByName(first)


def r24_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a search over rounded vectors agrees with the exact one."""
    e = table(spark, sf_dir, "embeddings")
    probes = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    named = e.withColumn("memory_id", F.lpad(F.col("vec_id").cast("string"), 9, "0"))
    rough = named.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 4) / 4))
    exact, approximate = (recall.multi_query(found, probes, 10).select("query_id", "rank", F.col("memory_id").alias("id")) for found in (named, rough))
    return recall.overlap_at_k(exact, approximate)


def a17_section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = points(spark, sf_dir).select(F.col("project").alias("section"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))).alias("phase"), (F.col("doc_id") % 50 / 50).alias("score"), F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 20 / 20).alias("confidence"), "speaker")
    return reflection.section_summary(hits)


def l01_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_at(points(spark, sf_dir), 30, 20, F.asc("memory_id")).select("memory_id", "next_offset")


def c09_timeline_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.timeline_candidates(points(spark, sf_dir)).select("candidate_id", "project", "speaker", "memory_kind", "summary", "status", F.array_join("source_ids", ",").alias("source_ids"), F.md5(F.array_join("quotes", ",")).alias("quote"))


def c12_proposed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a whole run against an empty canon."""
    p = points(spark, sf_dir)
    return canon.proposed(p, found_candidates(spark, sf_dir).where("false"))[1]


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_candidates(spark, sf_dir).select("candidate_id", "status", "project", "memory_kind", "confidence", F.timestamp_seconds("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("reviewed_at"))


def c13_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue with new rows and decisions, those of one kind still open or all reviewed."""
    q = queue(spark, sf_dir)
    kept = canon.queue_upsert(q.where("confidence <> 'low'"), q.withColumns({"created_at": F.lit(None).cast("timestamp"), "status": F.when(F.col("confidence") == "high", "needs_review").otherwise(F.col("status"))}))
    action = F.get(F.array(F.lit("approve"), F.lit("reject"), F.lit("merge"), F.lit(None)), F.conv(F.substring("candidate_id", 6, 1), 16, 10).cast("int") % 4)
    decided = canon.review(kept, kept.select("candidate_id", action.alias("action"), F.lit(" target ").alias("target_id"), F.lit("me").alias("reviewed_by")).where("action is not null"), F.lit("2024-05-01").cast("timestamp"))
    seen = canon.queue_list(decided, reviewed=True).select("candidate_id", F.lit("reviewed").alias("list"))
    still = canon.queue_list(decided, reviewed=False, memory_kind="PREFERENCE", project="").select("candidate_id", F.lit("open preferences").alias("list"))
    return decided.join(seen.unionByName(still), "candidate_id", "left").select("candidate_id", "status", "canonical", F.array_join("merged_from", ",").alias("merged_from"), "merge_target", "reviewed_by", F.coalesce("list", F.lit("")).alias("list"), F.col("created_at").isNull().alias("undated"))


def q06_user_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistants that report what their user said, by the messages around them (Q6, Q7)."""
    p = opened(spark, sf_dir)
    near = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("system").alias("speaker"), F.lit("x").alias("text")), F.struct(F.lit(None).cast("string").alias("speaker"), F.lit("User: hello").alias("text")))).when(F.col("doc_id") % 3 == 1, F.array(F.struct(F.lit("assistant").alias("speaker"), F.lit("y").alias("text"))))
    told = p.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("The user said "), "said")).otherwise(F.col("said"))).withColumn("context", near)
    return cleanup.cleaned(told).select("memory_id", "role", "kind", "usable_for_user_profile", "usable_for_persona_memory")


def x05_reflection_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflections written back to their points, and the counters of the run."""
    from ..sources.sinks import reflected_points

    p = points(spark, sf_dir)
    told = p.where("doc_id % 3 = 0").select("memory_id", "speaker", F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")).alias("phase"), F.lit("deep").alias("depth"), (F.col("doc_id") % 10 / 10).alias("confidence"), (F.col("doc_id") % 4 == 0).alias("contradiction"))
    told = told.withColumn("decision", F.when(F.col("contradiction"), "contradiction").otherwise("skip"))
    counters = reflection.run_counters(p.withColumn("safe_for_reflection", F.col("doc_id") % 2 == 0), p.where("doc_id % 5 = 0"), told)
    wanted = reflection.reflections_where(told, phase="p1", speaker="assistant").limit(10).select("memory_id", F.lit(True).alias("top"))
    flagged = reflected_points(p.select("memory_id"), told).join(wanted, "memory_id", "left")
    return flagged.join(counters).select("memory_id", F.coalesce("reflected", F.lit(False)).alias("reflected"), "reflection_phase", "reflection_confidence", F.coalesce("top", F.lit(False)).alias("top"), "safe", "reflected_before", "told", F.col("contradiction").alias("contradictions"))


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with vectors, under other names."""
    p = vectors(spark, sf_dir)
    return p.select(F.col("memory_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("conversation_id")).alias("document_id"), F.concat(F.lit(" "), "source_title").alias("title"), (F.col("doc_id") % 7).cast("string").alias("position"), F.col("ts").cast("string").alias("created_at"), F.col("text").alias("content"), "embedding")


def e01_provenance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.provenance_view(foreign(spark, sf_dir))
    return found.select("memory_id", "chunk_id", "chunk_index", "source_document_id", "source_title", "created_date", "modified_date", "fingerprint", F.md5("text").alias("text"))


def e03_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points to vector 0 with at most two chunks of a source, one source left out, as a tool tells them."""
    view = evidence.provenance_view(foreign(spark, sf_dir))
    found = recall.research(view, query_vector(spark, sf_dir), recall.tool_limit(0), ("FILE 6.md",), 2)
    lines = recall.told(found.withColumns({"ts": F.lit(0), "memory_kind": F.lit("fact")}))
    return found.select("memory_id", "fingerprint", F.round("score", 6).alias("score")).join(lines.select(F.regexp_extract("line", "memory_id=([^ ]+)", 1).alias("memory_id"), F.md5("line").alias("line")), "memory_id")


def t46_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to payloads and back, with the profile of their documents."""
    p = points(spark, sf_dir).select("memory_id", "ts", F.when(F.col("doc_id") % 2 == 0, F.col("project")).alias("project"), "canonical", F.array("speaker", "status").alias("tags"))
    back = catalog.from_payloads(catalog.payloads(p), "ts long, project string, canonical boolean, tags array<string>, extra string")
    profile = catalog.document_profile(points(spark, sf_dir).withColumn("ai_model", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("memory_kind"))))
    return back.select("memory_id", "ts", "project", "canonical", F.array_join("tags", ",").alias("tags"), "extra", T.clean_title(F.concat_ws("_", "memory_id", F.lit("of.md"))).alias("title")).join(profile)


def a16_reflection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return reflection.by_phase_and_depth(p.select(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("phase"), F.when(F.col("doc_id") % 2 == 0, "deep").otherwise("shallow").alias("depth"), (F.col("doc_id") % 10 / 10).alias("confidence")))


QUERIES = {f.__name__: f for f in (e01_provenance_view, e03_research, t46_payloads, a16_reflection_counts, t06_text_functions, t26_times, f02_filters, g18_backfill_rekey, a08_branches, a12_missing_fields, a03_titles, a22_thoughts, e10_information_gain, e14_strategies, e16_cycles, e12_uncertainties, e05_envelopes, r17_seeds, n02_anchors, v04_vectors, r10_canonical_first, r12_source_cap, r15_document_chunks, r24_overlap, a17_section_summary, l01_offset_page, c09_timeline_candidates, c12_proposed_run, c13_review_queue, q06_user_support, x05_reflection_run)}

OPENED_SQL = f"""{POINTS_SQL}, opened AS (SELECT *, [{quoted(OPENINGS)}][doc_id % {len(OPENINGS)} + 1] || ' ' || text AS said FROM points)"""
STOP_SQL = quoted(T.STOP_WORDS)
WRITTEN = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def meaningful_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND (strlen(t) >= 3 OR (strlen(t) = 2 AND regexp_matches(t, '[0-9]'))) AND t NOT IN ({STOP_SQL})))"


def signal_sql(field: int) -> str:
    cases = " ".join(f"WHEN {any_of('lower(said)', signal[0])} THEN {repr(signal[field])}" for signal in T.SIGNALS)
    return f"CASE {cases} {'ELSE 0' if field == 2 else ''} END"


THOUGHTS_SQL = f"{MESSAGES_SQL}, thoughts AS (SELECT conversation_id AS session_id, message_id AS thought_id, speaker AS thought_type, md5((length(text) % 40)::VARCHAR) AS fingerprint, ts, turn FROM messages)"
LINKED_SQL = f"{POINTS_SQL}, linked AS (SELECT *, doc_id % 3 = 2 AS has_parent, doc_id % 5 = 3 AS has_cites FROM points)"
STATES_SQL = f"""{MESSAGES_SQL}, s AS (SELECT conversation_id, count(*) AS n, conversation_id::INT AS k, min_by(text, turn) AS first FROM messages GROUP BY conversation_id), states AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'the EARLIEST ' || first WHEN 1 THEN 'a citation of ' || first ELSE 'none of these' END AS question,
    [{quoted(evidence.TIERS)}][k % {len(evidence.TIERS)} + 1] AS tier FROM s)"""

SQL = {
    "t06_text_functions": f"""WITH {OPENED_SQL}, w AS (SELECT *, {meaningful_sql("'prefer generic plain structure decided'")} AS a, {meaningful_sql('said')} AS b, list_filter(string_split_regex(lower(trim(said)), '\\s+'), lambda t: t <> '' AND t NOT IN ({quoted(T.GENERIC)})) AS k FROM opened)
SELECT memory_id, round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) AS overlap, {any_of('lower(said)', T.CONTRADICTIONS)} AS contradicts, array_to_string(k, ' ') AS kept, trim(regexp_replace(lower(said), '\\s+', ' ', 'g')) AS key,
  {signal_sql(1)} AS kind, ({signal_sql(2)})::DOUBLE AS importance, {signal_sql(3)} AS tag, CASE WHEN doc_id % 3 = 1 THEN 'image/png' WHEN doc_id % 3 = 0 THEN 'application/pdf' ELSE '' END AS mime, CASE WHEN doc_id % 2 = 0 THEN 'one+two' ELSE '' END AS suggested,
  memory_id AS ref, upper(project) || '+X' AS listed, 'A:first:1+H3:' || project || ':3+H4:third:4' AS hypotheses,
  sha1('q ' || project || '||s||' || array_to_string(list_sort([speaker, project, speaker]), ',') || '||' || memory_kind) AS fingerprint FROM w""",
    "t26_times": f"""WITH {POINTS_SQL} SELECT memory_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN {WRITTEN.format('ts')} WHEN doc_id % 6 = 3 THEN strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT00:00:00Z') ELSE '' END AS any_form,
  CASE doc_id % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'number' WHEN 4 THEN 'missing_timestamp' WHEN 5 THEN 'malformed_timestamp' END AS warning,
  CASE doc_id % 6 WHEN 2 THEN {WRITTEN.format('ts')} WHEN 3 THEN strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT00:00:00Z') WHEN 4 THEN '2000-01-01T00:00:00Z' ELSE '' END AS strict FROM points""",
    "f02_filters": f"""WITH {POINTS_SQL} SELECT memory_id, memory_kind = 'fact' AND source_type = 'summary' AS by_kind, lower(project) = 'en' AND memory_kind = 'fact' AS by_tags, ts BETWEEN 1704067800 AND 1704073200 AS by_time, doc_id % 5 = 0 OR doc_id % 2 <> 0 AS unpinned,
  doc_id % 7 = 0 AS attached, project = 'EN' AS exact, status = 'approved' AND NOT canonical AS approved, project = 'en' AND memory_kind = 'fact' AND ts <= 1704076200 AS equal, NOT (memory_id = 'doc_7' OR lower(source_title) = 'file 12.md') AS left_in, 0::BIGINT AS quote_chars FROM points""",
    "g18_backfill_rekey": f"WITH {POINTS_SQL} SELECT CASE WHEN doc_id % 4 = 0 THEN 'new_' ELSE '' END || memory_id AS memory_id, CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE project END AS project FROM points",
    "a08_branches": f"""WITH {MESSAGES_SQL}, f AS (SELECT conversation_id, (turn - 1) // 2 AS parent, count(*) AS n FROM messages WHERE turn > 0 GROUP BY ALL) SELECT conversation_id, count(*) FILTER (n > 1) AS branches, max(n) AS widest FROM f GROUP BY conversation_id""",
    "a12_missing_fields": "SELECT unnest(['page', 'author']) AS label",
    "a03_titles": f"""WITH {POINTS_SQL}, firsts AS (SELECT * FROM points ORDER BY memory_id LIMIT 100), a AS (SELECT source_title AS value, count(*) AS n, 'all' AS of FROM points GROUP BY 1 ORDER BY n DESC, value LIMIT 12), b AS (SELECT source_title AS value, count(*) AS n, 'first' AS of FROM firsts GROUP BY 1 ORDER BY n DESC, value LIMIT 12)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 'user points', count(*), 'count' FROM points WHERE speaker = 'user'""",
    "a22_thoughts": f"""WITH {THOUGHTS_SQL}, told AS (SELECT t.*, EXISTS (SELECT 1 FROM thoughts h WHERE h.turn = 0 AND h.session_id = t.session_id AND h.fingerprint = t.fingerprint) AS known FROM thoughts t WHERE t.turn > 0), placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, thought_type ORDER BY ts DESC, thought_id DESC)::INT AS place, count(*) OVER (PARTITION BY session_id, thought_type) AS n FROM told)
SELECT session_id, thought_type, thought_id, place, n, CASE WHEN known THEN 'rediscovery' ELSE 'new' END AS status, CASE WHEN known THEN 'LOW' ELSE 'HIGH' END AS gain, turn % 3 = 1 AND thought_type = 'user' AS about FROM placed WHERE place <= 2""",
    "e10_information_gain": "SELECT unnest(['moved', 'same', 'reordered']) AS case, unnest(['MEDIUM', 'LOW', 'HIGH']) AS gain",
    "e14_strategies": f"""WITH {MESSAGES_SQL}, o AS (SELECT conversation_id AS uncertainty, 's' || (turn % 3) AS strategy, count(*) AS usage, count(*) FILTER (length(text) % 2 = 0) AS successes, bool_or(turn % 7 = 4 OR ts / 86400 % 9 < 1) AS gone FROM messages GROUP BY ALL), c AS (
  SELECT DISTINCT conversation_id AS uncertainty, s.strategy, s.pos FROM messages, (VALUES ('s0', 0), ('s1', 1), ('s2', 2), ('s3', 3)) s(strategy, pos) WHERE conversation_id::BIGINT % 2 = 1 OR pos < 2), r AS (
  SELECT c.*, 3 * coalesce(successes, 0) - coalesce(usage, 0) AS score FROM c LEFT JOIN o USING (uncertainty, strategy) WHERE NOT coalesce(gone, false)), f AS (
  SELECT DISTINCT ON (uncertainty) uncertainty, strategy, score FROM r ORDER BY uncertainty, CASE WHEN score >= 0 THEN -score ELSE 1 END, pos)
SELECT uncertainty, coalesce(strategy, 'FREEZE_BRANCH') AS strategy, score FROM (SELECT DISTINCT uncertainty FROM c) LEFT JOIN f USING (uncertainty)""",
    "e16_cycles": f"""WITH {MESSAGES_SQL}, s AS (SELECT conversation_id, list(length(text) % 2 ORDER BY turn) AS h FROM messages GROUP BY 1)
SELECT conversation_id, len(list_filter(range(2, len(h) // 2 + 1), lambda k: h[len(h) - k + 1:] = h[len(h) - 2 * k + 1:len(h) - k])) > 0 AS cycles FROM s""",
    "e12_uncertainties": f"""WITH {STATES_SQL}, q AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'RETRIEVAL_LIMIT' ELSE 'EVIDENCE_GAP' END AS now, ((k % 10) / 10::DOUBLE > 0 AND (k % 10) / 10::DOUBLE < 0.6) OR tier IN ({quoted(evidence.WEAK_TIERS)}) AS weak, lower(question) AS lq FROM states)
SELECT conversation_id, CASE WHEN k % 11 = 10 THEN 'DIMINISHING_RETURNS' WHEN k % 7 = 6 THEN 'CONTRADICTION' WHEN k % 6 - 4 >= 1 THEN 'DIMINISHING_RETURNS' WHEN k % 5 = 3 THEN 'SOURCE_QUALITY' WHEN {any_of('lq', ('earliest', 'first explicit', 'draft', 'lineage', 'chronolog'))} THEN 'CHRONOLOGY_GAP'
    WHEN {any_of('lq', ('provenance', 'transcript', 'citation'))} THEN 'PROVENANCE_GAP' WHEN k % 3 = 0 THEN 'EVIDENCE_GAP' ELSE 'AMBIGUOUS_CLASSIFICATION' END AS uncertainty,
  CASE WHEN k % 9 = 8 THEN 'CONTRADICTION' WHEN n % 4 = 0 AND now <> 'RETRIEVAL_LIMIT' THEN 'RETRIEVAL_LIMIT' WHEN weak THEN 'PROVENANCE_GAP' WHEN {any_of('lq', evidence.CHRONOLOGY)} THEN 'CHRONOLOGY_GAP' WHEN tier = 'UNKNOWN' THEN 'SOURCE_QUALITY' WHEN n % 4 > 0 THEN 'GENERIC_SIMILARITY' END AS again,
  CASE again WHEN 'CONTRADICTION' THEN 'retrieved evidence contains contradiction signals' WHEN 'RETRIEVAL_LIMIT' THEN 'strategy returned no retrieval coverage for the unresolved claim' WHEN 'PROVENANCE_GAP' THEN 'retrieved evidence depends on derived or weak provenance' WHEN 'CHRONOLOGY_GAP' THEN 'chronology remains ambiguous despite available provenance'
    WHEN 'SOURCE_QUALITY' THEN 'retrieved source quality is unverifiable' WHEN 'GENERIC_SIMILARITY' THEN 'retrieved evidence resembles generic surface similarity rather than discriminating detail' END AS reason,
  CASE WHEN k % 2 = 0 THEN 'What now?' ELSE 'What counter evidence is upstream?' END AS best, 6::BIGINT AS best_score FROM q""",
    "e05_envelopes": f"""WITH {POINTS_SQL}, l AS (SELECT project, count(*) AS searches, array_to_string(list_sort(list_distinct(list(speaker) || list(memory_kind))), ',') AS sources FROM points GROUP BY 1), b AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN trim(text, E' \\n\\t\\r') ELSE '' END AS t FROM points)
SELECT memory_id, project, CASE WHEN t <> '' THEN 'text,' ELSE '' END || 'source_title,path' AS fields, CASE WHEN t <> '' THEN t || ' ' ELSE '' END || trim(source_title) || ' ' || conversation_id AS body, searches, sources FROM b JOIN l USING (project)""",
    "r17_seeds": f"""WITH {MESSAGES_SQL}, g AS (SELECT conversation_id AS session_id, CASE WHEN turn % 2 = 0 THEN 'H' || (turn + 1) ELSE message_id END AS hypothesis_id, CASE WHEN turn % 3 > 0 THEN nullif(trim(text), '') END AS st, turn % 4 - 1 AS c, CASE WHEN 9 - turn > 0 THEN 9 - turn ELSE turn + 1 END AS given FROM messages)
SELECT session_id, hypothesis_id, coalesce(st, hypothesis_id) AS statement, CASE WHEN c <= 0 THEN 0.42::DOUBLE ELSE 1 END AS confidence, 1::DOUBLE AS strength, row_number() OVER (PARTITION BY session_id ORDER BY given, hypothesis_id) AS rank, 'active' AS status FROM g""",
    "n02_anchors": f"""WITH {LINKED_SQL}, scored AS (SELECT *, upper(source_title) AS anchor, (2 * (doc_id % 4 > 0)::INT + 2 * (doc_id % 3 > 0)::INT + 3 * (doc_id % 5 = 0)::INT + 2 * has_parent::INT + has_cites::INT)::BIGINT AS score FROM linked), best AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, memory_id) AS r FROM scored)
SELECT anchor, memory_id, score, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 > 1 THEN 'only ingestion timestamps were available; intellectual chronology not inferred from ingestion order' ELSE 'no original chronology metadata (chunk/turn/segment/original timestamp) found' END, CASE WHEN doc_id % 3 = 0 THEN 'source_type missing on anchor' END], lambda x: x IS NOT NULL), '+') AS lacks FROM best WHERE r = 1""",
    "v04_vectors": "SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'invalid_shape' ELSE 'ok' END AS status FROM embeddings",
    "r10_canonical_first": f"""WITH {CLUSTERS_SQL}{VECTORS_SQL[len(POINTS_SQL):]}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), found AS (
  SELECT memory_id, conversation_id, round(list_cosine_similarity(embedding, q) * {BOOST}, 9) AS score, canonical, status, ts FROM vectors, q WHERE {HIDDEN} ORDER BY score DESC, ts DESC, memory_id LIMIT 30), told AS (
  SELECT *, false AS canonical, ({' + '.join(f"contains(lower(summary || ' ' || array_to_string(quotes, ' ')), '{w}')::INT" for w in QUERY.split())}) / {len(QUERY.split())}::DOUBLE AS share FROM candidates), both_of AS (
  SELECT * FROM found UNION ALL SELECT candidate_id, 'proposed_canon', round(share * {BOOST}, 9), canonical, status, ts FROM told WHERE share > 0)
SELECT memory_id, conversation_id, round(score, 6) AS score, canonical, status FROM (SELECT * FROM both_of ORDER BY canonical DESC, score DESC, ts DESC, memory_id LIMIT 40)""",
    "r12_source_cap": f"""WITH {POINTS_SQL}, s AS (SELECT memory_id, ts, (doc_id * 7919 % 1000) / 1000::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source_title END AS source_title FROM points)
SELECT memory_id, source_title, score FROM (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY score DESC, ts DESC, memory_id) AS n FROM s) WHERE n <= 2""",
    "r15_document_chunks": f"""WITH {POINTS_SQL}, c AS (SELECT 'chunks' AS of, memory_id FROM points WHERE project = 'en' ORDER BY ts LIMIT 30), d AS (SELECT 'dated' AS of, memory_id FROM points ORDER BY CASE WHEN doc_id % 3 > 0 THEN ts - doc_id % 10 * 86400 WHEN doc_id % 6 > 0 THEN ts END NULLS LAST, memory_id LIMIT 25)
SELECT * FROM c UNION ALL SELECT * FROM d""",
    "r24_overlap": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: round(x * 4) / 4) AS r FROM embeddings), pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.v, q.v), 9) AS s, round(list_cosine_similarity(e.r, q.v), 9) AS t FROM e, e q WHERE q.vec_id % 100 = 0), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST, id) AS b FROM pairs)
SELECT query_id, count(*) FILTER (a <= 10 AND b <= 10) AS shared, count(*) FILTER (a <= 10 AND a = b) AS in_place FROM ranked GROUP BY query_id""",
    "a17_section_summary": f"""WITH {POINTS_SQL}, h AS (SELECT project AS section, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'p' || (doc_id % 3) END AS phase, doc_id % 50 / 50::DOUBLE AS score, CASE WHEN doc_id % 9 > 0 THEN doc_id % 20 / 20::DOUBLE ELSE 0 END AS confidence, speaker FROM points), p AS (
  SELECT section, phase, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, phase) AS r FROM h GROUP BY section, phase)
SELECT section, count(*) AS hits, any_value(p.phase) AS top_phase, round(avg(score), 6) AS mean_score, round(avg(confidence), 6) AS mean_confidence, (100 * count(*) FILTER (speaker = 'user') // count(*))::BIGINT AS user_percent FROM h JOIN (SELECT * FROM p WHERE r = 1) p USING (section) GROUP BY section""",
    "l01_offset_page": f"WITH {POINTS_SQL} SELECT memory_id, 50::BIGINT AS next_offset FROM points ORDER BY memory_id LIMIT 20 OFFSET 30",
    "c09_timeline_candidates": f"""WITH {POINTS_SQL}, ends AS (SELECT *, row_number() OVER (ORDER BY ts, memory_id) AS a, row_number() OVER (ORDER BY ts DESC, memory_id DESC) AS z FROM points), t AS (
  SELECT 'timeline_first' AS c, 'First known memory mention appears around ' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') || ', based on message metadata.' AS summary, 'inferred' AS st, * FROM ends WHERE a = 1
  UNION ALL SELECT 'timeline_current', 'Current direction is reflected in later memory records near ' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') || '.', 'needs_review', * FROM ends WHERE z = 1)
SELECT 'cand_' || sha1(c || '|' || memory_id || {WRITTEN.format('ts')})[1:16] AS candidate_id, project, speaker, 'canonical_timeline' AS memory_kind, t.summary, st AS status, memory_id AS source_ids, md5(CASE WHEN length(trim(source_quote)) > 180 THEN substring(trim(source_quote), 1, 177) || '...' ELSE trim(source_quote) END) AS quote FROM t""",
    "c13_review_queue": f"""WITH {CLUSTERS_SQL}, kept AS (SELECT *, CASE WHEN confidence = 'high' THEN 'needs_review' ELSE status END AS st, (strpos('0123456789abcdef', candidate_id[6:6]) - 1) % 4 AS act FROM candidates), decided AS (
  SELECT *, CASE WHEN act = 0 AND st <> 'direct' THEN 'approved' WHEN act = 1 THEN 'rejected' WHEN act = 2 THEN 'needs_review' ELSE st END AS new_status FROM kept)
SELECT candidate_id, new_status AS status, act = 0 AS canonical, CASE WHEN act = 2 THEN candidate_id ELSE '' END AS merged_from, CASE WHEN act = 2 THEN 'target' END AS merge_target, CASE WHEN act < 3 THEN 'me' END AS reviewed_by,
  CASE WHEN act < 3 THEN 'reviewed' WHEN memory_kind = 'preference' THEN 'open preferences' ELSE '' END AS list, confidence = 'low' AS undated FROM decided""",
    "q06_user_support": f"""WITH {OPENED_SQL}, p AS (SELECT memory_id, doc_id, CASE WHEN speaker = 'bot' THEN 'assistant' ELSE speaker END AS role, lower(source_title || ' ' || CASE WHEN doc_id % 2 = 1 THEN 'The user said ' ELSE '' END || said || ' ' || source_quote) AS words, lower(source_title || ' ' || coalesce(project, '') || ' ' || said) AS blob FROM opened), s AS (
  SELECT *, role = 'assistant' AND doc_id % 3 = 0 AND {any_of('words', cleanup.SUPPORT)} AS supported FROM p)
SELECT memory_id, role, CASE WHEN role = 'assistant' THEN CASE WHEN supported THEN 'user_asserted_fact' WHEN {any_of('words', cleanup.HISTORY)} THEN 'project_support_history' ELSE 'assistant_guidance' END
  WHEN role = 'user' THEN CASE WHEN {any_of('words', cleanup.PREFERENCE)} THEN 'preference' WHEN {any_of('words', cleanup.PERSONA)} THEN 'persona_instruction' WHEN {any_of('words', cleanup.DECISION)} THEN 'project_decision' ELSE 'user_asserted_fact' END ELSE 'project_support_history' END AS kind,
  role = 'user' OR supported AS usable_for_user_profile, role = 'user' OR supported AS usable_for_persona_memory FROM s""",
    "x05_reflection_run": f"""WITH {POINTS_SQL}, told AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 2 = 1 AND speaker = 'assistant' ORDER BY doc_id % 10 DESC, memory_id) AS r FROM points WHERE doc_id % 3 = 0), c AS (
  SELECT count(*) FILTER (doc_id % 2 = 0) AS safe, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 5 = 0) AS reflected_before, count(*) FILTER (doc_id % 3 = 0) AS told, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 4 = 0) AS contradictions FROM points)
SELECT p.memory_id, t.memory_id IS NOT NULL AS reflected, CASE WHEN t.memory_id IS NOT NULL THEN 'p' || (p.doc_id % 2) END AS reflection_phase, CASE WHEN t.memory_id IS NOT NULL THEN p.doc_id % 10 / 10::DOUBLE END AS reflection_confidence, coalesce(p.doc_id % 2 = 1 AND p.speaker = 'assistant' AND t.r <= 10, false) AS top, c.* FROM points p LEFT JOIN told t ON t.memory_id = p.memory_id, c""",
}
FOREIGN_SQL = f"""{VECTORS_SQL}, seen AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN conversation_id ELSE '' END AS document, trim(source_title) AS title FROM vectors), viewed AS (
  SELECT *, CASE WHEN document <> '' THEN document ELSE title END AS fingerprint FROM seen)"""
SQL["e01_provenance_view"] = f"WITH {FOREIGN_SQL} SELECT memory_id, memory_id AS chunk_id, (doc_id % 7)::INT AS chunk_index, document AS source_document_id, title AS source_title, {WRITTEN.format('ts')} AS created_date, '' AS modified_date, fingerprint, md5(trim(text)) AS text FROM viewed"
SQL["e03_research"] = f"""WITH {FOREIGN_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), found AS (SELECT *, round(list_cosine_similarity(embedding, q), 9) AS score FROM viewed, q ORDER BY score DESC, memory_id LIMIT 40), capped AS (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, memory_id) AS n FROM found WHERE lower(fingerprint) <> 'file 6.md' AND lower(title) <> 'file 6.md'), best AS (SELECT * FROM capped WHERE n <= 2 ORDER BY score DESC, memory_id LIMIT 8), placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, memory_id) AS place FROM best)
SELECT memory_id, fingerprint, round(score, 6) AS score, md5('[' || place || '] memory_id=' || memory_id || ' kind=fact score=' || printf('%.3f', score) || chr(10) || '    ' || CASE WHEN length(trim(text)) > 300 THEN substring(trim(text), 1, 297) || '...' ELSE trim(text) END) AS line FROM placed"""
SQL["t46_payloads"] = f"""WITH {POINTS_SQL}, d AS (SELECT count(*) AS documents, round(avg(n), 6) AS chunks_per_document FROM (SELECT count(*) AS n FROM points GROUP BY conversation_id)), m AS (SELECT memory_kind AS model FROM points WHERE doc_id % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, model LIMIT 1)
SELECT memory_id, ts, CASE WHEN doc_id % 2 = 0 THEN project END AS project, canonical, speaker || ',' || status AS tags, NULL::VARCHAR AS extra, replace(memory_id, '_', ' ') || ' of' AS title, d.*, m.* FROM points, d, m"""
SQL["a16_reflection_counts"] = f"WITH {POINTS_SQL} SELECT 'p' || (doc_id % 3) AS phase, CASE WHEN doc_id % 2 = 0 THEN 'deep' ELSE 'shallow' END AS depth, count(*) AS n, round(avg(doc_id % 10 / 10::DOUBLE), 6) AS mean_confidence FROM points GROUP BY ALL"
SQL["c12_proposed_run"] = f"""WITH {CLUSTERS_SQL}, ends AS (SELECT *, row_number() OVER (ORDER BY ts, memory_id) AS a, row_number() OVER (ORDER BY ts DESC, memory_id DESC) AS z FROM points WHERE NOT canonical), every AS (
  SELECT candidate_id, project, memory_kind, ts, summary, len(source_ids) > 0 AND len(quotes) > 0 AS sourced FROM candidates
  UNION ALL SELECT 'cand_' || sha1('timeline_first|' || memory_id || {WRITTEN.format('ts')})[1:16], project, 'canonical_timeline', ts, 'First known', true FROM ends WHERE a = 1
  UNION ALL SELECT 'cand_' || sha1('timeline_current|' || memory_id || {WRITTEN.format('ts')})[1:16], project, 'canonical_timeline', ts, 'Current direction', true FROM ends WHERE z = 1), firsts AS (
  SELECT *, first_value(candidate_id) OVER w AS first_id, first_value(summary) OVER w AS first_summary FROM every WINDOW w AS (PARTITION BY lower(project || '|' || memory_kind) ORDER BY ts, candidate_id)), contra AS (
  SELECT project, summary, sourced, CASE WHEN candidate_id <> first_id THEN 'contradiction_note' ELSE memory_kind END AS kind FROM firsts WHERE candidate_id = first_id OR lower(summary) <> lower(first_summary))
SELECT count(DISTINCT lower(project || '|' || kind || '|' || summary)) FILTER (sourced) AS candidates, count(*) - count(DISTINCT lower(project || '|' || kind || '|' || summary)) FILTER (sourced) AS skipped, count(*) FILTER (kind = 'contradiction_note') AS contradictions FROM contra"""
