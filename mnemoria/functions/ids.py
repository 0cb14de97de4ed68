"""Deterministic identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def ordinal(n: Column) -> Column:
    """At least three digits; more are never cut."""
    digits = n.cast("string")
    return F.when(F.char_length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)


def memory_id(conversation: Column, message: Column, index: Column, chunk: Column) -> Column:
    """``{conv}_msg_{message}_chunk_{NNN}``, by position without a message id; ordinals from 1."""
    message = F.nullif(F.trim(F.coalesce(message, F.lit(""))), F.lit(""))
    place = F.when(message.isNotNull(), F.concat(F.lit("_msg_"), message)).otherwise(F.concat(F.lit("_turn_"), ordinal(index + 1)))
    return F.replace(F.concat(conversation, place, F.lit("_chunk_"), ordinal(chunk + 1)), F.lit(" "), F.lit("_"))


def _dashed(h: Column, version: str) -> Column:
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit(f"-{version}"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def point_id(key: Column, version: str = "3") -> Column:
    """UUID of a key by MD5; a UUID stays, in lower case."""
    return F.when(key.rlike(UUID), F.lower(key)).otherwise(_dashed(F.md5(key), version))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID by SHA-1."""
    return _dashed(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), "5")


def candidate_id(cluster: Column, summary: Column) -> Column:
    """``cand_`` and 16 hex digits."""
    return F.concat(F.lit("cand_"), F.substring(F.sha1(F.concat_ws("|", cluster, summary)), 1, 16))


def evidence_fingerprint(question: Column, strategy: Column, sources: Column, summary: Column) -> Column:
    """Equal for the same finding whatever the order of its sources, case and spaces of its question."""
    asked = F.lower(F.trim(F.regexp_replace(question, r"\s+", " ")))
    return F.sha1(F.encode(F.concat_ws("||", asked, strategy, F.array_join(F.array_sort(sources), ","), F.lower(F.trim(summary))), "UTF-8"))


def strategy_fingerprint(strategy: Column, question: Column, sources: Column) -> Column:
    """Equal for the same results of a strategy; sources that are blank or repeated do not count."""
    named = F.array_sort(F.array_distinct(F.filter(F.transform(sources, lambda t: F.trim(t)), lambda s: s != "")))
    return F.sha1(F.encode(F.concat_ws("||", strategy, F.lower(F.trim(question)), F.array_join(named, ",")), "UTF-8"))
