"""Deep research: selection and exhaustion of strategies, steps and runs against plain Python, and what the loop promises."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mnemoria.functions import text as T
from mnemoria.operators import drill, evidence
from mnemoria.operators.drill import BY_EXHAUSTION, CANDIDATES, FROZEN, GONE, OPEN, PAST, availability, best_question, candidates, model_key, questions, repeats, selected
from mnemoria.plans.research import embedded

TIERS = list(evidence.TIERS)
WEIGHT = {name: weight for name, (weight, _) in evidence.TIERS.items()}
RANK = {name: rank for name, (_, rank) in evidence.TIERS.items()} | {"": 0}


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(name) for name, c in columns.items())).first()


def gone(*rows):
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("uncertainty", "strategy", "model", "tier"), row, strict=True))) for row in rows)).cast(f"array<{GONE}>")


def history(*rows):
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("uncertainty", "strategy", "question", "gain", "fingerprint"), row, strict=True))) for row in rows)).cast(f"array<{PAST}>")


def chosen(spark, uncertainty, gone_rows, past=()):
    left = availability(F.lit(uncertainty), gone(*gone_rows), F.lit("m"), F.lit(""))["remaining"]
    return one(spark, s=selected(F.lit(uncertainty), left, history(*past)))["s"]


def test_each_uncertainty_begins_with_its_first_strategy_and_ends_with_freezing(spark):
    for uncertainty in ("CHRONOLOGY_GAP", "PROVENANCE_GAP", "SOURCE_QUALITY"):
        assert chosen(spark, uncertainty, [])["strategy"] == "PROVENANCE_TRACE"
    used = []
    for strategy in CANDIDATES["PROVENANCE_GAP"]:
        assert chosen(spark, "PROVENANCE_GAP", used)["strategy"] == strategy
        used.append(("PROVENANCE_GAP", strategy, "m", ""))
    assert tuple(chosen(spark, "PROVENANCE_GAP", used)) == ("FREEZE_BRANCH", drill.NONE_LEFT, True)
    assert chosen(spark, "CONTRADICTION", used)["strategy"] == "COUNTEREVIDENCE_SEARCH"  # another uncertainty keeps its own record
    assert tuple(one(spark, c=candidates(F.lit("UNHEARD_OF")))["c"]) == drill.OTHERS


def test_a_better_tier_or_another_model_opens_a_strategy_again(spark):
    record = [("EVIDENCE_GAP", "SEMANTIC_BROAD", "m", "DERIVED_SUMMARY")]
    for model, seen, exhausted in (("m", "DERIVED_SUMMARY", 1), ("m", "AUDIO_OVERVIEW", 1), ("m", "RAW_SOURCE", 0), ("other", "DERIVED_SUMMARY", 0)):
        found = one(spark, a=availability(F.lit("EVIDENCE_GAP"), gone(*record), F.lit(model), F.lit(seen)))["a"]
        assert (len(found["exhausted"]), len(found["remaining"])) == (exhausted, 4 - exhausted)


def test_yield_counts_only_from_nought(spark):
    low = lambda s, n: [("EVIDENCE_GAP", s, "q", "LOW", "f")] * n
    all_used = [row for s in CANDIDATES["EVIDENCE_GAP"] for row in low(s, 2)]
    assert chosen(spark, "EVIDENCE_GAP", [], [*all_used, *low("SEMANTIC_BROAD", 1)])["strategy"] == "SEMANTIC_BROAD"  # all below 0: the first stays, though the others score more
    good = [("EVIDENCE_GAP", "CROSS_DOCUMENT", "q", "HIGH", "f")]
    assert tuple(chosen(spark, "EVIDENCE_GAP", [], all_used + good)) == ("CROSS_DOCUMENT", drill.BY_YIELD, True)
    assert tuple(chosen(spark, "EVIDENCE_GAP", [], low("SEMANTIC_BROAD", 1))) == ("KEYWORD_TARGETED", drill.BY_YIELD, False)


def test_questions_and_cycles(spark):
    asked = questions(F.lit("Who drew the map?"), F.lit("x"), F.lit("EVIDENCE_GAP"))
    assert one(spark, q=best_question(asked, F.lit("Who drew the map?"), F.lit("Who drew the map?")))["q"] == "Who drew the map?"
    assert one(spark, q=best_question(questions(F.lit(""), F.lit("  "), F.lit("EVIDENCE_GAP")), F.lit(""), F.lit("")))["q"] == drill.COUNTER_QUESTION
    step = lambda u, f: (u, "S", "q", "LOW", f)
    a, b, c = step("A", "1"), step("B", "2"), step("C", "3")
    for steps, want in (((a, b, a, b), True), ((a, b, c, a, b, c), True), ((a, a), False), ((a, b, a, c), False), ((c, a, b, a, b), True)):
        assert one(spark, r=repeats(history(*steps)))["r"] is want
    key = model_key(F.array(F.struct(F.lit("H2").alias("id"), F.lit(1).alias("rank"), F.lit(" active ").alias("status"))), F.lit("UNKNOWN"))
    assert one(spark, k=key)["k"] == "tier:UNKNOWN|H2:1:active"


def plain_signs(text, spark):
    row = spark.createDataFrame([(text,)], "t string").select(T.concepts(F.col("t")).alias("c"), T.negated(F.col("t")).alias("n"), T.hedged(F.col("t")).alias("h")).first()
    return set(row["c"]), row["n"], row["h"]


def plain_run(session, hypotheses, search, signs, steps, freeze_after=2):
    """The loop for one session, step by step over plain values; ``search`` gives the results of a strategy."""
    s = {"status": OPEN, "reclassified": "", "low": 0, "tier": "", "gone": [], "past": [], "asked": ""}
    hyps = [{"id": h, "concepts": signs[statement][0], "rank": k + 1, "confidence": 0.42, "strength": 0.2, "status": "active", "support": [], "counter": [], "ambiguous": []} for k, (h, statement) in enumerate(hypotheses)]
    key = lambda: "|".join([f"tier:{s['tier']}", *(f"{h['id']}:{h['rank']}:{h['status']}" for h in hyps)])
    dead = lambda u, x: any(g[:3] == (u, x, key()) and RANK[s["tier"]] <= RANK[g[3]] for g in s["gone"])
    out = []
    for number in range(1, steps + 1):
        topic = f"{session['wanted']} {session['question']}".lower()
        if s["reclassified"]:
            u = s["reclassified"]
        elif s["low"] >= 1:
            u = "DIMINISHING_RETURNS"
        elif session["blockers"]:
            u = session["blockers"][0]
        elif re.search("earliest|first explicit|draft|lineage|chronolog", topic):
            u = "CHRONOLOGY_GAP"
        elif re.search("provenance|transcript|citation", topic):
            u = "PROVENANCE_GAP"
        else:
            u = "AMBIGUOUS_CLASSIFICATION" if session["searches"] else "EVIDENCE_GAP"
        asked = [session["wanted"], *drill.ALWAYS] if session["wanted"] else list(drill.QUESTIONS.get(u, (session["question"], drill.COUNTER_QUESTION)))
        worth = lambda q: 1 + 5 * (bool(session["wanted"]) and q == session["wanted"]) + 2 * bool(re.search("first|earliest|upstream", q.lower())) + 2 * bool(re.search("falsif|counter", q.lower())) + (q != s["asked"])
        s["asked"] = question = max(asked, key=worth)
        left = [x for x in CANDIDATES[u] if not dead(u, x)]
        strategy = drill.FREEZE
        if left:
            strategy, best = left[0], -1
            for x in left if s["past"] else ():
                mine = [p for p in s["past"] if p[:2] == (u, x)]
                if 3 * sum(p[3] in ("MEDIUM", "HIGH") for p in mine) - len(mine) > best:
                    strategy, best = x, 3 * sum(p[3] in ("MEDIUM", "HIGH") for p in mine) - len(mine)
        found = search(strategy, question, hyps[0]["support"])
        top = max((f["tier"] for f in found), key=RANK.get, default="UNKNOWN")
        provenance = sum(WEIGHT[f["tier"]] for f in found) / len(found) if found else 0
        if not s["tier"] or RANK[top] > RANK[s["tier"]]:
            s["tier"] = top
        printed = hashlib.sha1("||".join([strategy, question.lower().strip(), ",".join(sorted({f["id"] for f in found}))]).encode()).hexdigest()
        repeat = any(p[1] == strategy and p[2] == question and p[4] == printed for p in s["past"])
        shown = [(f["title"], f["document"], f["type"], f["text"][:220].lower()) for f in found[:3]]
        duplicate = repeat or any(p[1] == strategy and p[2].lower() == question.lower() for p in s["past"]) or len(set(shown)) < len(shown)
        freeze, material = strategy == drill.FREEZE, False
        if not freeze and not repeat:
            before = {h["id"]: dict(h) for h in hyps}
            for h in hyps:
                fresh = {"support": [], "counter": [], "ambiguous": []}
                for f in found:
                    c, negative, doubtful = signs[f["text"]]
                    met = h["concepts"] & c
                    if h["concepts"] and f["text"].strip() and (met & set(T.RELATIONS) or len(met) / len(h["concepts"]) >= 0.5):
                        kind = "counter" if negative else "ambiguous" if doubtful else "support"
                        if f["id"] not in h[kind]:
                            fresh[kind].append(f)
                net = sum(WEIGHT[f["tier"]] for f in fresh["support"]) - sum(WEIGHT[f["tier"]] for f in fresh["counter"])
                unit = lambda v: min(max(v, 0.0), 1.0)
                h["confidence"], h["strength"] = round(unit(h["confidence"] + 0.06 * net), 9), round(unit(h["strength"] + 0.08 * net), 9)
                h["status"] = "contested" if fresh["counter"] else "active" if h["status"] == "contested" and not h["counter"] else h["status"]
                for kind, items in fresh.items():
                    h[kind] = h[kind] + [f["id"] for f in items]
            hyps.sort(key=lambda h: (-round(h["confidence"] + 0.1 * h["strength"], 9), h["id"]))
            for k, h in enumerate(hyps):
                h["rank"] = k + 1
                b = before[h["id"]]
                material |= (b["rank"], b["status"], b["support"], b["counter"]) != (h["rank"], h["status"], h["support"], h["counter"]) or abs(b["confidence"] - h["confidence"]) >= 0.01
        gain = "HIGH" if freeze else "LOW" if duplicate or not found else "HIGH" if material else "MEDIUM"
        poor = gain == "LOW" or duplicate
        if poor and not freeze and not any(g[:3] == (u, strategy, key()) for g in s["gone"]):
            s["gone"].append((u, strategy, key(), s["tier"]))
        left = [x for x in CANDIDATES[u] if not dead(u, x)]
        moves, contradicts = None, any(re.search("contradict|however|inconsistent|does not", f["text"].lower()) for f in found)
        if not freeze and not left:
            weak = 0 < provenance < 0.6 or top in evidence.WEAK_TIERS
            chronology = any(word in question.lower() for word in evidence.CHRONOLOGY)
            for name, applies in (("CONTRADICTION", contradicts), ("RETRIEVAL_LIMIT", not found), ("PROVENANCE_GAP", weak), ("CHRONOLOGY_GAP", chronology and not weak), ("SOURCE_QUALITY", top == "UNKNOWN"), ("GENERIC_SIMILARITY", not contradicts and bool(found) and not weak)):
                if applies and name != u:
                    moves = name if any(not dead(name, x) for x in CANDIDATES[name]) else None
                    break
        s["low"] = 0 if moves or not poor or left else s["low"] + 1
        s["past"].append((u, strategy, question, gain, printed))
        signed = [(p[0], p[1], p[4]) for p in s["past"]]
        cycle = any(signed[-k:] == signed[-2 * k : -k] for k in range(2, len(signed) // 2 + 1))
        ends = freeze or cycle or (not moves and not left) or (not moves and s["low"] >= freeze_after)
        s["reclassified"] = moves or s["reclassified"]
        out.append((number, u, question, strategy, len(found), 3 + (min(3, len(found)) or 1) + ends + bool(moves), gain, FROZEN if ends else OPEN, duplicate, not found, top))
        if ends:
            break
    return out, hyps, [p[4] for p in s["past"]]


TEXTS = ("They developed independently.", "It may have one origin.", "These were never separate and do not recombine.", "However, a single source for all.", "generic structure", "the draft came first, earliest of the sequence", "E8 sacred bridge", "nothing at all", "They developed independently.", "counterevidence was merged in a draft")
HYPOTHESES = (("H1", "the branches developed independently then recombined"), ("H2", "one single origin for all"), ("H3", ""))


@pytest.fixture(scope="module")
def research(spark):
    kinds = ("document", "transcript", "audio_overview", "summary", "odd")
    rows = [(f"m{k:02d}", f"d{k % 4}", f"T{k % 7}", kinds[k % 5], TEXTS[k % len(TEXTS)], None if k % 6 == 5 else 1000 - k * 7 % 50) for k in range(30)]
    points = spark.createDataFrame(rows, "memory_id string, document string, source_title string, source_type string, text string, ts long").withColumn("embedding", F.when(F.col("memory_id") != "m03", embedded(F.concat("text", "memory_id"))))
    sessions = [("a", "What is known?", "", [], 1), ("b", "Which draft was first?", "", [], 0), ("c", "q", "Who separated them?", ["CONTRADICTION"], 1), ("d", "", "", ["PROVENANCE_GAP"], 1), ("e", "where", None, ["RETRIEVAL_LIMIT"], 0), ("f", "where", "", [], 0)]
    table = spark.createDataFrame(sessions, "session_id string, question string, wanted string, blockers array<string>, searches int")
    given = spark.createDataFrame([(s[0], h, t, k + 1) for s in sessions for k, (h, t) in enumerate(HYPOTHESES)], "session_id string, hypothesis_id string, statement string, pos int")
    seeds = evidence.seeded(given.select("session_id", "hypothesis_id", "statement", F.lit(0.0).alias("confidence"), F.lit(0.2).alias("strength"), F.lit(0).alias("rank"), F.lit("active").alias("status"), "pos"))
    return points.cache(), rows, sessions, drill.opened(table, seeds)


def test_a_run_is_the_same_as_each_session_by_itself(spark, research):
    points, rows, sessions, state = research
    signs = {text: plain_signs(text, spark) for text in {*TEXTS, *(t for _, t in HYPOTHESES), "H3"}}
    hypotheses = [(h, t or h) for h, t in HYPOTHESES]  # a blank statement is the id
    tiers = dict(spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(kind).alias("k"), evidence.tier(F.lit(kind), F.lit("T")).alias("t")) for kind in {r[3] for r in rows}))).alias("x")).select("x.*").collect())
    table = points.select("memory_id", "embedding").collect()
    vectors = {row["memory_id"]: row["embedding"] for row in table}
    digests = {}

    def search(strategy, question, support):
        plan, k, per_source, words, by_creation = drill.ROUTES[strategy]
        found = []
        if plan == "keyword":
            text = " ".join(w for w in question.lower().split() if w not in drill.GENERIC) if words == "-" else question + words if words.startswith(" ") else words or question
            tokens = {t for t in re.split("[^a-z0-9]+", text.lower()) if t}
            found = [(round(sum(t in f"{r[2]} {r[4]}".lower() for t in tokens) / len(tokens), 9), r) for r in rows]
            found = sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1][0]))[:k]
        elif plan == "semantic":
            q = digests.setdefault(question, [ord(hashlib.md5(question.encode()).hexdigest()[i % 32]) - 75 for i in range(64)])
            cos = lambda v: round(sum(x * y for x, y in zip(v, q, strict=True)) / (sum(x * x for x in v) ** 0.5 * sum(y * y for y in q) ** 0.5), 9)
            found = [(cos(vectors[r[0]]), r) for r in rows if vectors[r[0]] and (strategy != "RAW_SOURCE_LOOKUP" or r[3] == "document")]
            found = sorted(found, key=lambda x: (-x[0], x[1][0]))[: min(5 * k, 200) if per_source else k]
            found = [x for x in found if strategy != "CROSS_DOCUMENT" or not {x[1][0], x[1][1], x[1][2]} & set(support)]
            if per_source:
                seen = {}
                found = [x for x in found if seen.setdefault(x[1][1], x) is x]
            found = found[:k]
        elif plan == "document" and support:
            found = sorted(((1, r) for r in rows if r[1] == support[0]), key=lambda x: (x[1][5] is not None, x[1][5] or 0, x[1][0]))[:k]
            by_creation = True
        if by_creation:
            found.sort(key=lambda x: (x[1][5] is None, x[1][5] or 0, x[1][0]))
        return [{"id": r[0], "document": r[1], "title": r[2], "type": r[3], "text": r[4], "tier": tiers[r[3]]} for _, r in found]

    last, steps = drill.run(state, points, embedded, steps=7)
    got, held = {}, {row["session_id"]: row for row in last.collect()}
    for row in steps.orderBy("session_id", "step").collect():
        got.setdefault(row["session_id"], []).append(tuple(row[c] for c in ("step", "uncertainty", "question", "strategy", "evidence", "thoughts", "gain", "status", "duplicate", "negative", "tier")))
    for name, question, wanted, blockers, searches in sessions:
        want, hyps, prints = plain_run({"question": question, "wanted": wanted or "", "blockers": blockers, "searches": searches} if question else {"question": drill.NO_QUESTION, "wanted": "", "blockers": blockers, "searches": searches}, hypotheses, search, signs, 7)
        assert got[name] == want, name
        assert [p["fingerprint"] for p in held[name]["history"]] == prints
        assert [(h["id"], round(h["confidence"], 6), h["status"], h["support"], h["counter"]) for h in hyps] == [(h["id"], round(h["confidence"], 6), h["status"], h["support"], h["counter"]) for h in held[name]["hypotheses"]]
    assert len({row[3] for rows in got.values() for row in rows}) > 8


def test_a_frozen_session_does_no_work_until_it_is_opened_again(spark, research):
    points, _, _, state = research
    frozen = state.where("session_id = 'a'").withColumn("status", F.lit(FROZEN)).withColumn("reason", F.lit(BY_EXHAUSTION)).withColumn("tier", F.lit("RAW_SOURCE"))
    last, steps = drill.run(frozen, points, embedded, steps=3)
    assert steps.collect() == [] and [(r["status"], r["reason"], r["iterations"]) for r in last.collect()] == [(FROZEN, BY_EXHAUSTION, 0)]
    _, steps = drill.run(drill.reopened(frozen), points, embedded)
    assert steps.count() == 1
    _, steps = drill.run(frozen.withColumn("tier", F.lit("UNKNOWN")), points, embedded, steps=3)  # sources of no known tier open it, and it is frozen again
    assert [(r["strategy"], r["status"], r["thoughts"], r["negative"]) for r in steps.collect()] == [("FREEZE_BRANCH", FROZEN, 5, True)]
