"""Queries on ingest, canon, cleanup, reflection and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canon, cleanup, evidence, ingest, reflection
from .relations import MESSAGES_SQL, POINTS_SQL, messages, points, table


def g03_turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.turn_windows(messages(spark, sf_dir), 3, 1)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.accepted(messages(spark, sf_dir), assistant=True)
    return kept.select("conversation_id", F.when(F.col("turn") % 3 > 0, F.col("message_id")).alias("message_id"), F.col("turn").alias("record_index"), "speaker", "text", "source_type", F.lit(" ").alias("project"), "ts")


def g01_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents in chunks."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("conversation_id"), F.lit(None).cast("string").alias("message_id"), F.lit(0).alias("record_index"), F.lit("document").alias("speaker"), "text", F.lit("document").alias("source_type"), F.col("lang").alias("project"))
    return ingest.to_points(docs).select("memory_id", "point_id", "chunk", "text", "summary")


def g06_ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as points of one chunk each, with identities and shortened texts."""
    return ingest.to_points(prepared(spark, sf_dir), size=None).select("memory_id", "speaker", "project", F.md5("text").alias("digest"), "summary", "source_quote")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.to_points(prepared(spark, sf_dir).where("cast(conversation_id as int) % 2 = 0"), size=None)


def g10_missing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = ingest.to_points(ingest.guard_legacy(prepared(spark, sf_dir), stored(spark, sf_dir).where("record_index < 1")), size=None)
    return ingest.missing(every, stored(spark, sf_dir)).select("memory_id", "conversation_id")


def g12_rewrite_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = prepared(spark, sf_dir)
    old = ingest.to_points(m.withColumn("message_id", F.lit(None).cast("string")), size=None)
    new = ingest.to_points(m.withColumn("message_id", F.col("record_index").cast("string")), size=None)
    return ingest.rewrite_map(old, new)


def g16_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = prepared(spark, sf_dir)
    return ingest.counters(m, stored(spark, sf_dir), ingest.to_points(m, size=None))


def j17_archive_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages, messages with more after them, slices from their middle, and what is found nowhere."""
    m = messages(spark, sf_dir)
    n = F.col("turn") % 5
    text = F.when(n == 0, F.concat(F.lit("  "), "text")).when(n == 1, F.concat("text", F.lit(" and more"))).when(n == 2, F.substring("text", 20, 60)).when(n == 3, F.substring("text", 1, 120)).otherwise(F.concat(F.lit("found nowhere "), F.substring("text", 1, 50)))
    chunks = m.select("conversation_id", F.concat_ws("#", "conversation_id", "turn").alias("memory_id"), text.alias("text"))
    return ingest.archive_matches(chunks, m.select("conversation_id", "message_id", F.col("turn").alias("pos"), "text"))


def c04_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.clusters(canon.harvest(points(spark, sf_dir))).select("cluster_id", "part", "memory_id")


def found_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.candidates(canon.clusters(canon.harvest(points(spark, sf_dir))))


def c05_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_candidates(spark, sf_dir).select("candidate_id", "cluster_id", "memory_kind", "status", "confidence", F.md5("summary").alias("summary"), F.array_join("source_ids", ",").alias("source_ids"), F.size("quotes").cast("long").alias("n_quotes"))


def c09_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.timeline(points(spark, sf_dir)).select("project", "which", "memory_id", "ts", F.md5("line").alias("line"))


def c10_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = canon.contradictions(found_candidates(spark, sf_dir))
    return marked.select("candidate_id", "project", "memory_kind", "status", "confidence", F.md5("summary").alias("summary"), F.array_join(F.array_sort("source_ids"), ",").alias("source_ids"), F.size("quotes").cast("long").alias("n_quotes"))


def c11_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = canon.contradictions(found_candidates(spark, sf_dir))
    curated = canon.curate(marked, marked.where("ts % 120 = 0"))
    return curated.select("candidate_id", "project", "memory_kind", "status", F.md5("summary").alias("summary"), F.array_join(F.array_sort("source_ids"), ",").alias("source_ids"))


def repeated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message points, a third of them stored again later as they are, and a fifth with another text."""
    p = message_points(spark, sf_dir)
    turn = F.regexp_extract("memory_id", "_turn_([0-9]+)_", 1).cast("int")
    again = p.where(turn % 3 == 0).withColumn("ts", F.col("ts") + 7)
    other = p.where(turn % 5 == 0).withColumn("ts", F.col("ts") + 9).withColumn("text", F.concat("text", F.lit(" and another end.")))
    return p.unionByName(again).unionByName(other)


def message_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as points of several chunks to a turn."""
    m = messages(spark, sf_dir)
    chunk = F.explode(F.sequence(F.lit(1), (F.col("turn") % 4 + 1).cast("int")))
    cut = m.select("*", chunk.alias("chunk"))
    text = F.when(F.col("chunk") == 1, F.col("text")).when(F.col("chunk") == 2, F.substring("text", 3, 120)).when(F.col("chunk") == 3, F.lit("short (one")).otherwise(F.lit(""))
    return cut.select(F.concat("conversation_id", F.lit("_turn_"), F.lpad((F.col("turn") + 1).cast("string"), 3, "0"), F.lit("_chunk_"), F.lpad(F.col("chunk").cast("string"), 3, "0")).alias("memory_id"), "conversation_id", "speaker", "ts", text.alias("text"), F.substring(text, 1, 180).alias("source_quote"), F.when(F.col("turn") % 2 == 0, "audio notes").otherwise("").alias("source_title"), F.lit(None).cast("string").alias("project"))


def q01_chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.chunk_positions(message_points(spark, sf_dir)).select("memory_id", "chunk_position")


def q13_cleaned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleanup.cleaned(repeated_points(spark, sf_dir))
    flags = ["usable_for_user_profile", "usable_for_project_history", "usable_for_assistant_guidance", "usable_for_persona_memory", "usable_for_canon"]
    lists = [F.array_join(c, ",").alias(c) for c in ("warnings", "blockers")]
    return found.select("memory_id", "ts", "role", *lists, "quality", "duplicate_of", "domain", "kind", "phase", "evidence", "reflection_scope", "cleanup_status", "safe_for_reflection", "repair_method", "project_hint", "content_hash", "cleaned_id", *flags)


def q14_cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.summary(cleanup.cleaned(points(spark, sf_dir)))


def q03_project_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = cleanup.project_hint(F.col("source_title"))
    return message_points(spark, sf_dir).select("memory_id", hint["hint"].alias("hint"), hint["confidence"].alias("confidence"))


def x01_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleanup.cleaned(points(spark, sf_dir))
    return reflection.pending(found, points(spark, sf_dir).where("doc_id % 3 = 0")).select("memory_id")


def x04_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    confidence = reflection.capped(F.col("doc_id") % 100 / 90, F.when(F.col("doc_id") % 5 == 0, "malformed").when(F.col("doc_id") % 5 == 1, "partial").otherwise("complete"))
    depth = F.element_at(F.array(*map(F.lit, reflection.DEPTHS)), (F.col("doc_id") % 4 + 1).cast("int"))
    small = lambda n: (F.col("doc_id") % n).cast("int")
    return p.select("memory_id", F.round(confidence, 6).alias("confidence"), reflection.decision(confidence, depth, small(4), small(3), small(2), F.col("doc_id") % 13 == 0).alias("decision"))


def x02_worker_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("memory_id", reflection.worker_slot(4)(F.col("memory_id")).alias("slot"))


def r14_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return evidence.neighbours(p, p, 2).select("anchor_id", "memory_id")


HYPOTHESES = (
    ("H1", "traditions that merged and originated in generated terms", 0.5, 0.5, 1),
    ("H2", "drafts import independent summaries", 0.0, 0.4, 2),
    ("H3", "the and for", 0.6, 0.2, 3),
    ("H4", "lorem voluptas", 0.4, 0.9, 4),
)
PROBES = ("may not have merged", "separate traditions", "a term was developed", "perhaps the summary", "nothing of the kind", "drafts import it")


def hypotheses(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(HYPOTHESES, "hypothesis_id string, statement string, confidence double, strength double, rank int")
    seen = F.when(F.col("hypothesis_id") == "H2", F.array(F.lit("4"), F.lit("5"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return rows.withColumns({"session_id": F.lit("s"), "status": F.when(F.col("hypothesis_id") == "H4", "contested").otherwise(""), "support_ids": seen, "counter_ids": none, "ambiguous_ids": none})


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.element_at(F.array(*map(F.lit, PROBES)), (F.col("item_id") % len(PROBES) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("evidence_id"), F.concat_ws(" ", probe, "text").alias("text"))


def e06_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.classified(evidence_rows(spark, sf_dir), hypotheses(spark))


def e08_model_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = e06_polarity(spark, sf_dir).withColumn("weight", F.when(F.col("evidence_id") % 2 == 0, 0.9).otherwise(0.45))
    found = evidence.updated(hypotheses(spark), weighed)
    ids = [F.md5(F.array_join(F.array_sort(f"{k}_ids"), ",")).alias(f"{k}_ids") for k in evidence.KINDS]
    return found.select("hypothesis_id", "new_confidence", "new_strength", "new_rank", "rank_delta", "status", "reason", "confidence_delta", "n_support", "n_counter", "n_ambiguous", *ids)


def e11_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.provenance_profile(points(spark, sf_dir), "conversation_id")


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("doc_"), F.col("doc_id") - 1))
    cites = F.when(F.col("doc_id") % 5 == 3, F.array(F.concat(F.lit("doc_"), F.col("doc_id") - 2))).otherwise(F.array().cast("array<string>"))
    return points(spark, sf_dir).withColumn("parent_id", parent).withColumn("cites", cites).withColumn("chunk_index", F.col("doc_id"))


def t04_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_rows(spark, sf_dir).select("evidence_id", F.array_join(F.array_sort(T.concepts(F.col("text"))), ",").alias("concepts"), T.negated(F.col("text")).alias("negated"), T.hedged(F.col("text")).alias("hedged"))


def t13_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("memory_id", T.family_key(F.col("source_title")).alias("family"), T.cluster_key(F.concat_ws(" | ", "project", "memory_kind")).alias("cluster"), T.clean_id(F.col("source_title")).alias("clean"), T.clock(F.col("doc_id") * 37).alias("clock"), T.speaker_role(F.col("speaker")).alias("role"))


QUERIES = {f.__name__: f for f in (g01_chunks, g03_turn_windows, g06_ingest_points, g10_missing_points, g12_rewrite_map, g16_counters, j17_archive_matches, c04_clusters, c05_candidates, c09_timeline, c10_contradictions, c11_curated, q01_chunk_positions, q03_project_hints, q13_cleaned_points, q14_cleanup_summary, x01_pending, x02_worker_slots, x04_decisions, r14_neighbours, e06_polarity, e08_model_update, e11_provenance, t04_concepts, t13_keys)}


def ordinal(x: str) -> str:
    return f"CASE WHEN length(({x})::VARCHAR) < 3 THEN lpad(({x})::VARCHAR, 3, '0') ELSE ({x})::VARCHAR END"


def clamp(x: str, n: int) -> str:
    return f"CASE WHEN length(trim({x})) > {n} THEN substring(trim({x}), 1, {n}) || '...' ELSE trim({x}) END"


def clamp_total(x: str, n: int) -> str:
    return f"CASE WHEN length(trim({x})) > {n} THEN substring(trim({x}), 1, {n - 3}) || '...' ELSE trim({x}) END"


PREPARED_SQL = f"""{MESSAGES_SQL}, prepared AS (
  SELECT conversation_id, turn AS record_index, CASE WHEN turn % 3 > 0 THEN message_id END AS message_id, speaker, trim(text, E' \\n\\t\\r') AS text, source_type
  FROM messages WHERE lower(speaker) NOT IN ('system', 'tool') AND trim(text, E' \\n\\t\\r') <> ''), every AS (
  SELECT *, conversation_id || CASE WHEN message_id IS NOT NULL THEN '_msg_' || message_id ELSE '_turn_' || {ordinal('record_index + 1')} END || '_chunk_001' AS memory_id FROM prepared), stored AS (
  SELECT * FROM every WHERE conversation_id::INT % 2 = 0)"""

CLUSTERS_SQL = f"""{POINTS_SQL}, raw AS (
  SELECT *, project || ' | ' || memory_kind || ' | ' || speaker AS cluster_label, lower(CASE WHEN trim(source_quote) <> '' THEN trim(source_quote) ELSE memory_id END) AS snippet FROM points WHERE NOT canonical), one AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_label, snippet ORDER BY ts, memory_id) AS dup FROM raw), numbered AS (
  SELECT *, ((row_number() OVER (PARTITION BY cluster_label ORDER BY ts, memory_id) - 1) // 25)::BIGINT AS part FROM one WHERE dup = 1), clusters AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(cluster_label), '[ |/\\\\:\\-]', '_', 'g'), '_+', '_', 'g'), '_') || '_' || lpad((part + 1)::VARCHAR, 4, '0') AS cluster_id,
         {clamp_total("CASE WHEN trim(summary) <> '' THEN summary ELSE memory_id END", 160)} AS line, {clamp_total('source_quote', 180)} AS quote FROM numbered), unnamed AS (
  SELECT cluster_id, cluster_label, min(project) AS project, min(speaker) AS speaker, min(ts) AS ts,
         CASE WHEN cluster_label LIKE '%decision%' THEN 'project_decision' WHEN cluster_label LIKE '%preference%' THEN 'preference' WHEN cluster_label LIKE '%persona%' THEN 'persona_instruction' ELSE 'inferred_pattern' END AS memory_kind,
         CASE WHEN bool_or(lower(speaker) = 'user') THEN 'direct' ELSE 'inferred' END AS status,
         CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence,
         array_to_string(list_filter(list(line ORDER BY ts, memory_id), lambda x: x <> '')[1:3], ' ') AS summary,
         list(memory_id ORDER BY ts, memory_id) AS source_ids, list_distinct(list(quote) FILTER (quote <> '')) AS quotes
  FROM clusters GROUP BY cluster_id, cluster_label), candidates AS (SELECT *, 'cand_' || sha1(cluster_id || '|' || summary)[1:16] AS candidate_id FROM unnamed)"""
CONTRA_SQL = f"""{CLUSTERS_SQL}, marked AS (
  SELECT *, row_number() OVER w AS n, first_value(summary) OVER w AS first_summary, first_value(source_ids) OVER w AS first_ids, first_value(quotes) OVER w AS first_quotes
  FROM candidates WINDOW w AS (PARTITION BY lower(project), lower(memory_kind) ORDER BY ts, candidate_id)), contra AS (
  SELECT project, speaker, ts, candidate_id, summary, CASE WHEN n > 1 THEN list_distinct(quotes || first_quotes) ELSE quotes END AS quotes, CASE WHEN n > 1 THEN 'contradiction_note' ELSE memory_kind END AS memory_kind, CASE WHEN n > 1 THEN 'needs_review' ELSE status END AS status,
         CASE WHEN n > 1 THEN 'medium' ELSE confidence END AS confidence, CASE WHEN n > 1 THEN list_distinct(source_ids || first_ids) ELSE source_ids END AS source_ids
  FROM marked WHERE n = 1 OR lower(summary) <> lower(first_summary))"""

MESSAGE_POINTS_SQL = f"""{MESSAGES_SQL}, cut AS (SELECT *, unnest(range(1, turn % 4 + 2)) AS chunk FROM messages), mp AS (
  SELECT conversation_id, turn, chunk, conversation_id || '_turn_' || lpad((turn + 1)::VARCHAR, 3, '0') || '_chunk_' || lpad(chunk::VARCHAR, 3, '0') AS memory_id, speaker, ts,
         CASE chunk WHEN 1 THEN text WHEN 2 THEN substring(text, 3, 120) WHEN 3 THEN 'short (one' ELSE '' END AS text, CASE WHEN turn % 2 = 0 THEN 'audio notes' ELSE '' END AS source_title FROM cut), positioned AS (
  SELECT *, CASE WHEN max(chunk) OVER (PARTITION BY conversation_id, turn) <= 1 THEN 'single' WHEN chunk <= 1 THEN 'first' WHEN chunk >= max(chunk) OVER (PARTITION BY conversation_id, turn) THEN 'last' ELSE 'middle' END AS chunk_position FROM mp)"""


def any_of(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, p.replace("'", "''")) for p in phrases) + ")"


CLEAN_SQL = rf"""b0 AS (
  SELECT *, trim(text, E' \n\t\r') AS t, trim(substring(text, 1, 180), E' \n\t\r') AS q0, CASE WHEN speaker IN ('ai', 'model', 'bot') THEN 'assistant' WHEN speaker IN ('user', 'assistant', 'system', 'tool', 'mixed', 'unknown') THEN speaker ELSE 'unknown' END AS role FROM base), b1 AS (
  SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS nw FROM b0), b2 AS (
  SELECT *, CASE WHEN t = '' THEN ['missing_quote'] ELSE list_filter([CASE WHEN length(t) < 20 THEN 'very_short_quote' END, CASE WHEN starts_with(t, '...') OR ends_with(t, '...') THEN 'ellipsis_truncation' END,
    CASE WHEN regexp_matches(t, '^[a-z]{{2,}}[^\s]') THEN 'possible_midword_start' END, CASE WHEN regexp_matches(t, '^[a-z]') AND nw > 2 THEN 'starts_lower_fragment' END,
    CASE WHEN NOT contains('.!?"''”’', right(t, 1)) THEN 'ends_mid_sentence' END, CASE WHEN length(replace(t, '(', '')) <> length(replace(t, ')', '')) THEN 'unmatched_parentheses' END, CASE WHEN nw < 4 THEN 'low_semantic_content' END], lambda x: x IS NOT NULL) END AS qw FROM b1), b3 AS (
  SELECT *, CASE WHEN list_contains(qw, 'missing_quote') THEN 'missing'
    WHEN list_contains(qw, 'unmatched_parentheses') OR (chunk_position IN ('single', 'first') AND (list_contains(qw, 'possible_midword_start') OR list_contains(qw, 'starts_lower_fragment'))) THEN 'malformed'
    WHEN list_contains(qw, 'ellipsis_truncation') OR (chunk_position IN ('single', 'last') AND list_contains(qw, 'ends_mid_sentence')) THEN 'truncated'
    WHEN len(qw) > 0 THEN 'partial' ELSE 'complete' END AS quality0 FROM b2), b4 AS (
  SELECT *, quality0 IN ('partial', 'truncated') AND length(q0) >= 20 AS repaired FROM b3), b5 AS (
  SELECT *, CASE WHEN repaired THEN 'repaired' ELSE quality0 END AS quality, CASE WHEN repaired THEN trim(replace(q0, chr(10), ' ')) ELSE q0 END AS quote FROM b4), b6 AS (
  SELECT *, sha256(memory_id || chr(31) || quote || chr(31) || t) AS content_hash, lower(source_title || ' ' || coalesce(project, '') || ' ' || text) AS blob, lower(source_title || ' ' || text || ' ' || quote) AS words FROM b5), b7 AS (
  SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ts, content_hash) > 1 AS repeated, CASE WHEN row_number() OVER (PARTITION BY memory_id, content_hash ORDER BY ts) > 1 THEN memory_id END AS duplicate_of, {any_of('blob', cleanup.SPIRITUAL)} AS s, {any_of('blob', cleanup.TECHNICAL)} AS te FROM b6), b8 AS (
  SELECT *, CASE WHEN role = 'assistant' AND NOT (s AND NOT te) THEN 'technical' WHEN s AND te THEN 'mixed' WHEN s THEN 'spiritual' WHEN te THEN 'technical' ELSE 'general' END AS domain,
    list_sort(list_filter([CASE WHEN repeated THEN 'duplicate_record' END, CASE WHEN quality = 'missing' THEN 'missing_quote' END, CASE WHEN quality = 'malformed' THEN 'malformed_quote' END,
    CASE WHEN length(t) < 20 AND length(quote) < 20 THEN 'insufficient_context' END, CASE WHEN t = '' AND quote = '' THEN 'vector_only_payload' END], lambda x: x IS NOT NULL)) AS blockers FROM b7), cleaned AS (
  SELECT *, CASE WHEN role = 'assistant' THEN CASE WHEN {any_of('words', cleanup.HISTORY)} THEN 'project_support_history' ELSE 'assistant_guidance' END
    WHEN role = 'user' THEN CASE WHEN {any_of('words', cleanup.PREFERENCE)} THEN 'preference' WHEN {any_of('words', cleanup.PERSONA)} THEN 'persona_instruction' WHEN {any_of('words', cleanup.DECISION)} THEN 'project_decision' ELSE 'user_asserted_fact' END
    WHEN role IN ('system', 'tool') OR domain = 'technical' THEN 'project_support_history' ELSE 'unknown' END AS kind,
    CASE WHEN domain = 'mixed' THEN 'uncertain' WHEN domain = 'spiritual' THEN 'applicable' WHEN domain = 'technical' THEN 'not_applicable' ELSE 'uncertain' END AS phase,
    CASE WHEN quality IN ('missing', 'malformed') THEN 'none' WHEN length(quote) + length(t) < 80 THEN 'weak' WHEN length(quote) + length(t) < 240 THEN 'medium' ELSE 'strong' END AS evidence,
    CASE WHEN duplicate_of IS NOT NULL THEN 'skipped_duplicate' WHEN len(blockers) > 0 THEN 'needs_review' WHEN repaired THEN 'repaired' WHEN quality IN ('partial', 'truncated') THEN 'needs_review' ELSE 'clean' END AS cleanup_status,
    len(blockers) = 0 AS safe_for_reflection,
    list_sort(list_distinct(list_filter(qw || [CASE WHEN speaker IN ('ai', 'model', 'bot') THEN 'speaker_normalized_from_alias' END, CASE WHEN coalesce(trim(project), '') = '' THEN 'empty_project' END, CASE WHEN trim(source_title) = '' THEN 'missing_source_title' END,
      CASE WHEN role = 'assistant' AND domain = 'technical' THEN 'assistant_technical_content' WHEN domain = 'mixed' THEN 'mixed_spiritual_technical_signals' WHEN domain = 'technical' THEN 'technical_content_detected' WHEN domain <> 'spiritual' THEN 'insufficient_phase_signal' END,
      CASE WHEN length(text) > 16000 THEN 'oversized_fields' END], lambda x: x IS NOT NULL))) AS warnings,
    sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('cleaned:' || memory_id || ':' || content_hash)) AS u FROM b8)"""
POINT_CLEAN_SQL = f"{POINTS_SQL}, base AS (SELECT *, 'single' AS chunk_position FROM points), {CLEAN_SQL}"

EVIDENCE_SQL = f"""ev AS (SELECT item_id AS evidence_id, [{', '.join(f"'{p}'" for p in PROBES)}][item_id % {len(PROBES)} + 1] || ' ' || text AS text FROM benchmark), words AS (
  SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM ev)"""


def concepts_sql(w: str) -> str:
    pairs = ", ".join(f"'{name}': '{concept}'" for concept, names in T.CONCEPTS.items() for name in names)
    stop = ", ".join(f"'{word}'" for word in T.STOP_WORDS)
    return f"list_distinct(list_transform(list_filter({w}, lambda t: (strlen(t) >= 3 OR (strlen(t) = 2 AND regexp_matches(t, '[0-9]'))) AND t NOT IN ({stop})), lambda t: coalesce(MAP {{{pairs}}}[t], t)))"


def quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


SIGNS_SQL = f"""{EVIDENCE_SQL}, signs AS (SELECT evidence_id, {concepts_sql('w')} AS c, ({any_of('lower(text)', T.NEGATION_PHRASES + T.NEGATION_STEMS)} OR list_has_any(w, [{quoted(T.NEGATION_WORDS)}])) AS negated, list_has_any(w, [{quoted(T.HEDGE_WORDS)}]) AS hedged FROM words)"""
POLARITY_SQL = f"""{SIGNS_SQL}, hyp(hypothesis_id, statement, confidence, strength, rank) AS (VALUES {', '.join(f"('{h}', '{s}', {c}::DOUBLE, {st}::DOUBLE, {r})" for h, s, c, st, r in HYPOTHESES)}), hc AS (
  SELECT *, {concepts_sql("regexp_split_to_array(lower(statement), '[^\\p{L}\\p{N}]+')")} AS h FROM hyp), pairs AS (
  SELECT evidence_id, hypothesis_id, negated, hedged, len(h) AS nh, list_intersect(h, c) AS m FROM signs, hc), rel AS (
  SELECT *, CASE WHEN nh = 0 THEN 0 ELSE len(m) / nh::DOUBLE END AS r, list_has_any(m, [{quoted(T.RELATIONS)}]) AS family FROM pairs), polarity AS (
  SELECT evidence_id, hypothesis_id, round(r, 6) AS relevance, CASE WHEN nh = 0 OR NOT (family OR r >= 0.5) THEN 'none' WHEN negated THEN 'counter' WHEN hedged THEN 'ambiguous' ELSE 'support' END AS polarity FROM rel)"""

TIER_SQL = """CASE WHEN source_type LIKE '%document%' OR source_title LIKE '%.md' THEN 'RAW_SOURCE' WHEN source_type LIKE '%transcript%' THEN 'RAW_TRANSCRIPT' WHEN source_type LIKE '%chat_export%' THEN 'DIRECT_NOTE'
  WHEN source_type LIKE '%audio_overview%' THEN 'AUDIO_OVERVIEW' WHEN source_type LIKE '%summary%' THEN 'DERIVED_SUMMARY' ELSE 'UNKNOWN' END"""
FAMILY_SQL = "regexp_replace(replace(lower(trim(source_title)), ' copy', ''), '[^a-z0-9]', '', 'g')"

SQL = {
    "g03_turn_windows": f"""WITH {MESSAGES_SQL}, ends AS (SELECT conversation_id, max(turn) AS last FROM messages GROUP BY 1), starts AS (
  SELECT conversation_id, unnest(range(0, ceil(greatest(last + 1 - 3, 0) / 2)::BIGINT + 1)) * 2 AS s FROM ends), m AS (
  SELECT s.conversation_id, s.s, t.turn, upper(trim(t.speaker)) AS speaker, trim(t.text, E' \\n\\t\\r') AS text FROM starts s JOIN messages t ON t.conversation_id = s.conversation_id AND t.turn BETWEEN s.s AND s.s + 2 WHERE trim(t.text, E' \\n\\t\\r') <> '')
SELECT conversation_id, s AS start_turn, count(*) AS n_turns, (SELECT string_agg(speaker, ',' ORDER BY f) FROM (SELECT speaker, min(turn) AS f FROM m x WHERE x.conversation_id = m.conversation_id AND x.s = m.s GROUP BY speaker)) AS speakers, string_agg(speaker || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM m GROUP BY conversation_id, s""",
    "g06_ingest_points": f"WITH {PREPARED_SQL} SELECT memory_id, speaker, 'general' AS project, md5(text) AS digest, {clamp('text', 220)} AS summary, {clamp('text', 180)} AS source_quote FROM every",
    "g10_missing_points": f"""WITH {PREPARED_SQL}, legacy AS (SELECT DISTINCT conversation_id FROM stored WHERE record_index < 1 AND NOT contains(memory_id, '_msg_'))
SELECT memory_id, conversation_id FROM every WHERE NOT (message_id IS NOT NULL AND conversation_id IN (SELECT conversation_id FROM legacy)) AND memory_id NOT IN (SELECT memory_id FROM stored)""",
    "g12_rewrite_map": f"""WITH {PREPARED_SQL}, o AS (SELECT conversation_id, conversation_id || '_turn_' || {ordinal('record_index + 1')} || '_chunk_001' AS id FROM prepared), n AS (SELECT conversation_id, conversation_id || '_msg_' || record_index || '_chunk_001' AS id FROM prepared), ro AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS r FROM o), rn AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS r FROM n)
SELECT ro.id AS old_memory_id, rn.id AS new_memory_id FROM ro JOIN rn USING (conversation_id, r)""",
    "g16_counters": f"WITH {PREPARED_SQL} SELECT (SELECT count(*) FROM prepared) AS records, 0::BIGINT AS blank, count(*) AS chunks, count(*) FILTER (memory_id IN (SELECT memory_id FROM stored)) AS stored FROM every",
    "j17_archive_matches": rf"""WITH {MESSAGES_SQL}, n AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(CASE turn % 5 WHEN 0 THEN '  ' || text WHEN 1 THEN text || ' and more' WHEN 2 THEN substring(text, 20, 60) WHEN 3 THEN substring(text, 1, 120) ELSE 'found nowhere ' || substring(text, 1, 50) END), '\s+', ' ', 'g')) AS b FROM messages), pairs AS (
  SELECT c.conversation_id, c.turn, m.message_id, m.turn AS pos, CASE WHEN c.b = m.a THEN 0 WHEN substring(c.b, 1, 100) = substring(m.a, 1, 100) THEN 1 WHEN length(m.a) < 100 AND starts_with(c.b, m.a) THEN 3 WHEN length(c.b) >= 40 AND contains(m.a, c.b) THEN 4 END AS step
  FROM n c JOIN n m USING (conversation_id) WHERE c.b <> '' AND m.a <> ''), best AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id, turn ORDER BY step, pos, message_id) AS r FROM pairs WHERE step IS NOT NULL)
SELECT n.conversation_id || '#' || n.turn AS memory_id, b.message_id, CASE b.step WHEN 0 THEN 'text' WHEN 1 THEN 'prefix' WHEN 3 THEN 'begins' WHEN 4 THEN 'contains' END AS basis FROM n LEFT JOIN best b ON b.conversation_id = n.conversation_id AND b.turn = n.turn AND b.r = 1""",
    "x02_worker_slots": f"""WITH {POINTS_SQL}, u AS (SELECT memory_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(memory_id)) AS u FROM points)
SELECT memory_id, ((strpos('0123456789abcdef', u[32:32]) - 1) % 4)::INT AS slot FROM u""",
    "g01_chunks": rf"""WITH RECURSIVE d AS (SELECT doc_id, lang, trim(text, E' \n\t\r') AS t, string_split(trim(text, E' \n\t\r'), '') AS c FROM documents WHERE trim(text, E' \n\t\r') <> ''), placed AS (
  SELECT doc_id, t, length(t) AS n, list_filter(range(0, length(t) - 1), lambda i: c[i + 1] = chr(10) AND c[i + 2] = chr(10)) AS ps, list_filter(range(0, length(t) - 1), lambda i: contains('.!?', c[i + 1]) AND contains(E' \n\t\r', c[i + 2])) AS ss, list_filter(range(0, length(t)), lambda i: contains(E' \n\t\r', c[i + 1])) AS bs FROM d), walk AS (
  SELECT doc_id, 0::BIGINT AS number, 0::BIGINT AS s, CASE WHEN n <= 900 THEN n ELSE coalesce(list_last(list_filter(ps, lambda p: p >= 0 AND p <= 898)) + 2, list_last(list_filter(ss, lambda p: p >= 1 AND p <= 899)) + 1, list_last(list_filter(bs, lambda p: p >= 721 AND p <= 899)), 900) END AS e FROM placed
  UNION ALL SELECT w.doc_id, w.number + 1, w.ns, CASE WHEN w.ns + 900 >= p.n THEN p.n ELSE coalesce(list_last(list_filter(ps, lambda x: x >= w.ns AND x <= w.ns + 898)) + 2, list_last(list_filter(ss, lambda x: x >= w.ns + 1 AND x <= w.ns + 899)) + 1, list_last(list_filter(bs, lambda x: x >= w.ns + 721 AND x <= w.ns + 899)), w.ns + 900) END
  FROM (SELECT *, CASE WHEN e - 150 > s THEN e - 150 ELSE e END AS ns FROM walk) w JOIN placed p USING (doc_id) WHERE w.e < p.n), pieces AS (
  SELECT doc_id, number, trim(substring(t, s + 1, e - s), E' \n\t\r') AS piece FROM walk JOIN placed USING (doc_id)), kept AS (
  SELECT *, length(piece) >= 120 OR row_number() OVER (PARTITION BY doc_id ORDER BY number) = 1 AS opens FROM pieces WHERE piece <> ''), grouped AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY number) - 1 AS chunk FROM kept), chunks AS (
  SELECT doc_id, chunk::INT AS chunk, string_agg(piece, chr(10) ORDER BY number) AS text FROM grouped GROUP BY ALL), named AS (
  SELECT *, 'doc_' || doc_id || '_turn_001_chunk_' || {ordinal('chunk + 1')} AS memory_id FROM chunks), h AS (SELECT *, md5(memory_id) AS h FROM named)
SELECT memory_id, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id, chunk, text, {clamp('text', 220)} AS summary FROM h""",
    "c04_clusters": f"WITH {CLUSTERS_SQL} SELECT cluster_id, part, memory_id FROM clusters",
    "c05_candidates": f"WITH {CLUSTERS_SQL} SELECT candidate_id, cluster_id, memory_kind, status, confidence, md5(summary) AS summary, array_to_string(source_ids, ',') AS source_ids, len(quotes) AS n_quotes FROM candidates",
    "c09_timeline": f"""WITH {POINTS_SQL}, r AS (SELECT *, {clamp_total("CASE WHEN trim(source_quote) <> '' THEN source_quote ELSE text END", 160)} AS line, row_number() OVER (PARTITION BY project ORDER BY ts, memory_id) AS f, row_number() OVER (PARTITION BY project ORDER BY ts DESC, memory_id DESC) AS l FROM points)
SELECT project, 'first' AS which, memory_id, ts, md5(line) AS line FROM r WHERE f = 1 UNION ALL SELECT project, 'last', memory_id, ts, md5(line) FROM r WHERE l = 1""",
    "c10_contradictions": f"WITH {CONTRA_SQL} SELECT candidate_id, project, memory_kind, status, confidence, md5(summary) AS summary, array_to_string(list_sort(source_ids), ',') AS source_ids, len(quotes) AS n_quotes FROM contra",
    "c11_curated": f"""WITH {CONTRA_SQL}, k AS (SELECT *, lower(project || '|' || memory_kind || '|' || summary) AS k FROM contra), f AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, candidate_id) AS n FROM k WHERE len(source_ids) > 0 AND len(quotes) > 0 AND k NOT IN (SELECT k FROM k WHERE ts % 120 = 0))
SELECT candidate_id, project, memory_kind, CASE WHEN status = 'direct' AND lower(speaker) <> 'user' THEN 'inferred' ELSE status END AS status, md5(summary) AS summary, array_to_string(list_sort(source_ids), ',') AS source_ids FROM f WHERE n = 1""",
    "q01_chunk_positions": f"WITH {MESSAGE_POINTS_SQL} SELECT memory_id, chunk_position FROM positioned",
    "q03_project_hints": f"WITH {MESSAGE_POINTS_SQL} SELECT memory_id, CASE WHEN source_title <> '' THEN 'Audio Tools' END AS hint, CASE WHEN source_title <> '' THEN 0.6::DOUBLE ELSE 0 END AS confidence FROM mp",
    "q13_cleaned_points": f"""WITH {MESSAGE_POINTS_SQL}, stored_again AS (
  SELECT *, 0 AS kind_of FROM positioned UNION ALL SELECT * REPLACE (ts + 7 AS ts), 1 FROM positioned WHERE (turn + 1) % 3 = 0 UNION ALL SELECT * REPLACE (ts + 9 AS ts, text || ' and another end.' AS text), 2 FROM positioned WHERE (turn + 1) % 5 = 0), base AS (SELECT * EXCLUDE (kind_of), NULL::VARCHAR AS project FROM stored_again), {CLEAN_SQL.replace("substring(text, 1, 180)", "substring(CASE WHEN ends_with(text, ' and another end.') THEN left(text, -17) ELSE text END, 1, 180)")}
SELECT memory_id, ts, role, array_to_string(warnings, ',') AS warnings, quality, duplicate_of, domain, kind, phase, evidence, CASE evidence WHEN 'none' THEN 'not_enough_context' WHEN 'weak' THEN 'quote_only' WHEN 'medium' THEN 'quote_plus_context' ELSE 'cluster_context' END AS reflection_scope,
  array_to_string(blockers, ',') AS blockers, cleanup_status, safe_for_reflection, CASE WHEN repaired THEN 'whitespace_normalization' ELSE 'none' END AS repair_method, CASE WHEN source_title <> '' THEN 'Audio Tools' END AS project_hint, content_hash,
  u[1:8] || '-' || u[9:12] || '-5' || u[14:16] || '-' || translate(u[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || u[18:20] || '-' || u[21:32] AS cleaned_id,
  role = 'user' AS usable_for_user_profile, role IN ('user', 'assistant', 'system', 'tool') OR domain = 'technical' AS usable_for_project_history, role IN ('user', 'assistant', 'system') AS usable_for_assistant_guidance, role = 'user' AS usable_for_persona_memory, role <> 'mixed' AS usable_for_canon FROM cleaned""",
    "q14_cleanup_summary": f"""WITH {POINT_CLEAN_SQL} SELECT count(*) AS points, count(*) FILTER (safe_for_reflection) AS safe, count(duplicate_of) AS duplicates, {', '.join(f"count(*) FILTER (cleanup_status = '{s}') AS {s}" for s in ('clean', 'repaired', 'needs_review', 'failed', 'skipped_duplicate'))}, {', '.join(f"count(*) FILTER (quality = '{s}') AS {s}" for s in ('malformed', 'truncated', 'partial'))} FROM cleaned""",
    "x01_pending": f"WITH {POINT_CLEAN_SQL} SELECT memory_id FROM cleaned WHERE safe_for_reflection AND length(trim(text)) >= 20 AND doc_id % 3 <> 0",
    "x04_decisions": f"""WITH {POINTS_SQL}, c AS (SELECT memory_id, doc_id, least(doc_id % 100 / 90::DOUBLE, CASE doc_id % 5 WHEN 0 THEN 0.35 WHEN 1 THEN 0.75 ELSE 1 END) AS c FROM points)
SELECT memory_id, round(c, 6) AS confidence, CASE WHEN doc_id % 13 = 0 THEN 'contradiction' WHEN c >= 0.6 OR doc_id % 4 >= 3 OR doc_id % 3 >= 2 OR doc_id % 4 >= 2 THEN 'interesting' ELSE 'skip' END AS decision FROM c""",
    "r14_neighbours": f"""WITH {POINTS_SQL}, n AS (SELECT memory_id, doc_id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ts, memory_id) AS p FROM points)
SELECT a.memory_id AS anchor_id, n.memory_id FROM n a JOIN n ON n.conversation_id = a.conversation_id AND n.p BETWEEN a.p - 2 AND a.p + 2 """,
    "e06_polarity": f"WITH {POLARITY_SQL} SELECT * FROM polarity",
    "e08_model_update": f"""WITH {POLARITY_SQL}, seen AS (SELECT *, CASE WHEN evidence_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.45 END AS w FROM polarity WHERE polarity <> 'none' AND NOT (hypothesis_id = 'H2' AND polarity = 'support' AND evidence_id IN (4, 5))), sums AS (
  SELECT h.hypothesis_id, h.rank, h.confidence, h.strength, count(*) FILTER (polarity = 'support') AS n_support, count(*) FILTER (polarity = 'counter') AS n_counter, count(*) FILTER (polarity = 'ambiguous') AS n_ambiguous,
    coalesce(sum(w) FILTER (polarity = 'support'), 0) AS sw, coalesce(sum(w) FILTER (polarity = 'counter'), 0) AS cw,
    list_distinct(coalesce(list(evidence_id::VARCHAR) FILTER (polarity = 'support'), []) || CASE WHEN h.hypothesis_id = 'H2' THEN ['4', '5'] ELSE [] END) AS si, coalesce(list(evidence_id::VARCHAR) FILTER (polarity = 'counter'), []) AS ci, coalesce(list(evidence_id::VARCHAR) FILTER (polarity = 'ambiguous'), []) AS ai
  FROM hyp h LEFT JOIN seen ON seen.hypothesis_id = h.hypothesis_id GROUP BY h.hypothesis_id, h.rank, h.confidence, h.strength), u AS (
  SELECT *, round(least(greatest(confidence + 0.06 * (sw - cw), 0), 1), 6) AS new_confidence, round(least(greatest(strength + 0.08 * (sw - cw), 0), 1), 6) AS new_strength FROM sums), r AS (
  SELECT *, row_number() OVER (ORDER BY round(new_confidence + 0.1 * new_strength, 6) DESC, hypothesis_id) AS new_rank FROM u)
SELECT hypothesis_id, new_confidence, new_strength, new_rank, new_rank - rank AS rank_delta, CASE WHEN n_counter > 0 THEN 'contested' ELSE 'active' END AS status,
  CASE WHEN n_support = 0 AND n_counter = 0 AND n_ambiguous = 0 THEN 'no new discriminating evidence' WHEN n_support = 0 AND n_counter = 0 THEN 'ambiguous evidence, polarity unresolved' WHEN n_counter = 0 THEN 'new supporting evidence (weight ' || printf('%.2f', sw) || ')'
    WHEN n_support = 0 THEN 'new counterevidence (weight ' || printf('%.2f', cw) || ')' ELSE 'mixed evidence: support ' || printf('%.2f', sw) || ' vs counter ' || printf('%.2f', cw) END AS reason,
  round(new_confidence - confidence, 6) AS confidence_delta, n_support, n_counter, n_ambiguous, md5(array_to_string(list_sort(si), ',')) AS support_ids, md5(array_to_string(list_sort(ci), ',')) AS counter_ids, md5(array_to_string(list_sort(ai), ',')) AS ambiguous_ids FROM r""",
    "e11_provenance": f"""WITH {POINTS_SQL}, t AS (SELECT conversation_id, {TIER_SQL} AS tier, count(*) AS n FROM points GROUP BY 1, 2), w(tier, w, r) AS (VALUES {', '.join(f"('{t}', {w}::DOUBLE, {r})" for t, (w, r) in evidence.TIERS.items())})
SELECT conversation_id, round(sum(w * n) / sum(n), 6) AS score, max_by(tier, r) AS best, string_agg(tier || '=' || n, ',' ORDER BY tier) AS profile FROM t JOIN w USING (tier) GROUP BY 1""",
    "t04_concepts": f"WITH {SIGNS_SQL} SELECT evidence_id, array_to_string(list_sort(c), ',') AS concepts, negated, hedged FROM signs",
    "t13_keys": f"""WITH {POINTS_SQL} SELECT memory_id, {FAMILY_SQL} AS family, lower(project) || '_' || memory_kind AS cluster, replace(replace(lower(source_title), ' ', '_'), '.', '_') AS clean,
  CASE WHEN doc_id * 37 >= 3600 THEN lpad((doc_id * 37 // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((doc_id * 37 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((doc_id * 37 % 60)::VARCHAR, 2, '0') AS clock, CASE WHEN speaker = 'bot' THEN 'assistant' ELSE speaker END AS role FROM points""",
}
