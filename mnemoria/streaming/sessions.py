"""Sessions of a chat as keyed state: numbered turns, the last points, and a summary that rolls on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Points that a session remembers, turns between summaries, characters of a summary.
LAST, EVERY, SUMMARY = 32, 8, 220
POINTS = "session_id string, memory_id string, memory_kind string, turn long, text string, summary string, recent array<string>"
STATE = "turns long, recent array<string>, taken array<string>, summary string, seen double"


def clamped(text: str, size: int = SUMMARY) -> str:
    """The trimmed text, cut to ``size`` characters with an ellipsis."""
    text = text.strip()
    return text if len(text) <= size else text[: size - 3] + "..."


def named(session_id: str) -> str:
    """A session's id as part of the ids of its points."""
    return re.sub("[^a-z0-9]", "_", session_id.strip().lower()).strip("_") or "session"


def session_points(turns: DataFrame, ttl_seconds: float = 86400.0, prefix: str = "chat") -> DataFrame:
    """What each turn ``(session_id, turn_id, message, answer, ts)`` of a stream leaves: a point of the turn, and at every eighth one of the summary so far.

    Turns of a trigger are taken by time and id. A turn whose id is among the last 32 of its session is a replay and
    leaves nothing; one that comes late is counted when it comes. After ``ttl_seconds`` without a turn a session begins anew.
    Ids begin with ``prefix``. The point of a summary has one id for a session, so that a later one takes its place. State is bounded: two lists
    of 32 ids and one summary; turns without a session or a time are left out, and null texts are empty.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, recent, taken, summary, seen = state.get if state.exists else (0, [], [], "", 0.0)
        recent, taken, out = list(recent or []), list(taken or []), []
        rows = pd.concat(list(batches)).sort_values(["at", "turn_id"], kind="stable")  # what one trigger brings of a session
        for turn_id, message, answer, at in zip(rows["turn_id"], rows["message"], rows["answer"], rows["at"], strict=True):
            if seen and at - seen > ttl_seconds:
                count, recent, taken, summary = 0, [], [], ""
            if turn_id in taken:
                continue
            count, seen, taken = count + 1, max(seen, at), [*taken, turn_id][-LAST:]
            text = f"User: {message}\nAssistant: {answer}"
            made = [(f"{prefix}_{named(key[0])}_{count:06d}", "chat_turn", text, clamped(text))]
            if count % EVERY == 0:
                summary = clamped(f"{summary}\n{message}\n{answer}")
                made.append((f"{prefix}_{named(key[0])}_session_summary", "session_summary", summary, summary))
            recent = [*recent, *(point[0] for point in made)][-LAST:]
            out += [(key[0], memory_id, kind, count, body, short, list(recent)) for memory_id, kind, body, short in made]
        state.update((count, recent, taken, summary, float(seen)))
        state.setTimeoutDuration(int(ttl_seconds * 1000))
        yield pd.DataFrame(out, columns=["session_id", "memory_id", "memory_kind", "turn", "text", "summary", "recent"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    clean = turns.where("session_id is not null and ts is not null").select("session_id", text("turn_id"), text("message"), text("answer"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at"))
    return clean.groupBy("session_id").applyInPandasWithState(update, POINTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
