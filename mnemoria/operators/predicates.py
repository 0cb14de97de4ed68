"""Filters as predicates."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that recall hides.
HIDDEN = ("rejected", "contradicted", "outdated", "deleted")


@dataclass(frozen=True)
class SearchFilters:
    """Unset fields pass everything; texts are compared without case unless ``exact``."""

    project: str | None = None
    memory_kind: str | None = None
    speaker: str | None = None
    source_type: str | None = None
    conversation_id: str | None = None
    ai_provider: str | None = None
    ai_model: str | None = None
    feedback_rating: str | None = None
    status: str | None = None
    user_starred: bool | None = None
    user_shared: bool | None = None
    pinned: bool | None = None
    canonical: bool | None = None
    has_attachment: bool | None = None
    tags: tuple[str, ...] = ()
    since: datetime | int | None = None
    until: datetime | int | None = None
    exact: bool = field(default=False)

    def predicate(self) -> Column | None:
        """All set fields together; null when none is set."""
        parts: list[Column] = []
        for f in fields(self):
            value = getattr(self, f.name)
            if value is None or f.name in ("exact", "tags", "since", "until"):
                continue
            if f.name == "has_attachment":
                parts.append((F.trim(F.coalesce("attachment_source_system", F.lit(""))) != "") == F.lit(value))
            elif isinstance(value, bool):
                parts.append(F.coalesce(F.col(f.name), F.lit(False)) == F.lit(value))
            else:
                parts.append(F.col(f.name) == value if self.exact else F.lower(f.name) == value.lower())
        if self.tags:
            wanted = F.array(*(F.lit(tag.strip().lower()) for tag in self.tags))
            parts.append(F.size(F.array_except(wanted, F.transform("tags", lambda tag: F.lower(F.trim(tag))))) == 0)
        if self.since is not None:
            parts.append(F.col("ts") >= F.lit(self.since))
        if self.until is not None:
            parts.append(F.col("ts") <= F.lit(self.until))
        total = None
        for part in parts:
            total = part if total is None else total & part
        return total


def visible(points: DataFrame, filters: SearchFilters = SearchFilters(), include_rejected: bool = False) -> DataFrame:
    """Points that pass the filters and whose status is not hidden."""
    predicate = filters.predicate()
    found = points if predicate is None else points.where(predicate)
    return found if include_rejected else found.where(~F.coalesce("status", F.lit("")).isin(*HIDDEN))


def suppressed(results: DataFrame, quotes: bool = True, texts: bool = True) -> DataFrame:
    """Results without their quotes or texts where these are not to be shown."""
    hide = [name for name, shown in (("source_quote", quotes), ("text", texts)) if not shown]
    return results.withColumns({name: F.lit("") for name in hide}) if hide else results


def equal_fields(equal: dict[str, str], ranges: dict[str, tuple[object, object]] | None = None) -> Column | None:
    """All the fields of a map at once, blank ones left out, and ranges with open ends."""
    parts = [F.col(name) == value.strip() for name, value in equal.items() if value and value.strip()]
    for name, (low, high) in (ranges or {}).items():
        parts += [F.col(name) >= F.lit(low)] if low is not None else []
        parts += [F.col(name) <= F.lit(high)] if high is not None else []
    return reduce(Column.__and__, parts) if parts else None


def thoughts_where(thoughts: DataFrame, hypothesis: str = "", status: str = "", **equal: str) -> DataFrame:
    """Thoughts that agree with the fields given; a hypothesis is any of their targets, whatever its case."""
    predicate = equal_fields(equal)
    found = thoughts if predicate is None else thoughts.where(predicate)
    if hypothesis.strip():
        found = found.where(F.exists("targets", lambda t: F.lower(F.trim(t)) == hypothesis.strip().lower()))
    if status.strip():
        found = found.where(F.lower(F.trim("status")) == status.strip().lower())
    return found


def without_sources(points: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Drops rows that any of the given names refers to (F16)."""
    # The names a source goes by.
    known = [c for c in ("fingerprint", "conversation_id", "path", "filename", "source_title", "memory_id") if c in points.columns]
    names = F.array(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in known))
    return points.where(~F.arrays_overlap(names, F.array(*(F.lit(s.lower()) for s in sources)))) if sources else points
