"""Times of many forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flexible(col: Column) -> Column:
    """Epoch numbers, RFC 3339 and plain dates; null where nothing fits."""
    text = F.trim(col.cast("string"))
    number = text.try_cast("double")
    return F.coalesce(F.when(number > 0, F.timestamp_micros((number * 1000000).cast("long"))), F.when(number.isNull(), F.try_to_timestamp(text)))


def written(ts: Column) -> Column:
    """RFC 3339 in whole seconds, empty for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def strict(col: Column, as_of: Column) -> Column:
    """Blank is ``as_of``; malformed is an error."""
    return F.when(F.trim(F.coalesce(col, F.lit(""))) == "", as_of).otherwise(F.to_timestamp(col))


def normalized(col: Column) -> tuple[Column, Column]:
    """The time and a warning ``missing_timestamp`` or ``malformed_timestamp``."""
    blank = F.trim(F.coalesce(col, F.lit(""))) == ""
    ts = F.when(~blank, F.try_to_timestamp(col))
    return ts, F.when(blank, F.lit("missing_timestamp")).when(ts.isNull(), F.lit("malformed_timestamp"))


def asked_time(col: Column, strictly: bool = False) -> Column:
    """A day ``YYYY-MM-DD`` or an RFC 3339 time that a user asks for; anything else is no time, or ``strictly`` an error."""
    text = F.trim(F.coalesce(col, F.lit("")))
    day = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    moment = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    found = F.when(day | moment, F.try_to_timestamp(F.upper(text)))
    if not strictly:
        return found
    return F.when((text != "") & found.isNull(), F.raise_error(F.concat(F.lit("no day and no time: "), text)).cast("timestamp")).otherwise(found)
