"""Token buckets: how many requests of each client are let through."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after which a client that asks for nothing is forgotten.
FORGOTTEN = 300.0
DECISION = "client string, request_id long, at double, allowed boolean, tokens double"


def rates(per_minute: int, burst: int = 0) -> tuple[float, float]:
    """Tokens a second, and the most of them; a burst that is not set is a minute's worth."""
    if per_minute <= 0:
        raise ValueError("a limit needs a rate")
    return per_minute / 60.0, float(burst if burst > 0 else per_minute)


def spent(tokens: float, elapsed: float, rate: float, most: float) -> tuple[bool, float]:
    """Whether a request is let through, and what is left in the bucket."""
    tokens = min(most, tokens + elapsed * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def cleaned(requests: DataFrame) -> DataFrame:
    """``client, request_id, at`` in seconds; requests without a time are none, and a null client is one of its own."""
    return requests.where("ts is not null").select(F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), F.col("request_id").cast("long").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at"))


def rate_limited(requests: DataFrame, per_minute: int, burst: int = 0) -> DataFrame:
    """``client, request_id, at, allowed, tokens`` of every request ``(client, request_id, ts)`` of a finished table.

    What a bucket holds depends on each decision before, but a bucket is full again after a quiet time, whatever
    was decided. So the requests of a client are cut at quiet times, and each part is folded by itself, in order and without holding it.
    Quiet times are found between cells of that length, of which only the first and last request are compared, so a client of a third of
    all requests is cut without being sorted in one task. Requests of one time are taken by their ids.
    """
    rate, most = rates(per_minute, burst)
    quiet = min(most / rate, FORGOTTEN)
    rows = cleaned(requests).withColumn("cell", F.floor(F.col("at") / quiet))
    cells = rows.groupBy("client", "cell").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("client").orderBy("cell")
    begins = F.coalesce((F.col("first") - F.lag("last").over(order) >= quiet).cast("int"), F.lit(1))
    # A cell is met by its key, and holds the requests of a bounded time.
    parts = cells.withColumn("begins", begins).withColumn("part", F.sum("begins").over(order)).select("client", "cell", "part")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, before = None, most, 0.0
        for batch in batches:
            allowed, left = [], []
            for client, part, at in zip(*(batch.column(k).to_pylist() for k in (0, 3, 2)), strict=True):
                if (client, part) != key:
                    key, tokens, before = (client, part), most, at
                fine, tokens = spent(tokens, at - before, rate, most)
                before = at
                allowed.append(fine)
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(allowed, pa.bool_()), pa.array(left, pa.float64())], names=["client", "request_id", "at", "allowed", "tokens"])

    dealt = rows.join(parts, ["client", "cell"]).select("client", "request_id", "at", "part")
    return dealt.repartition("client", "part").sortWithinPartitions("client", "part", "at", "request_id").mapInArrow(fold, DECISION)


def limit_stream(requests: DataFrame, per_minute: int, burst: int = 0) -> DataFrame:
    """The same for a stream: a bucket for each client is kept as state and forgotten after a quiet time.

    Requests of a batch are taken by time and id; one that comes later than those of a client that were decided already adds no tokens.
    """
    rate, most = rates(per_minute, burst)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"], kind="stable")  # what one trigger brings of a client
        tokens, before = state.get if state.exists else (most, float(rows["at"].iloc[0]))
        allowed, left = [], []
        for at in rows["at"].tolist():
            if at - before >= FORGOTTEN:
                tokens = most
            fine, tokens = spent(tokens, max(at - before, 0.0), rate, most)
            before = max(before, at)
            allowed.append(fine)
            left.append(tokens)
        state.update((tokens, before))
        state.setTimeoutDuration(int(FORGOTTEN * 1000))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "at": rows["at"], "allowed": allowed, "tokens": left})

    return cleaned(requests).groupBy("client").applyInPandasWithState(decide, DECISION, "tokens double, before double", "append", GroupStateTimeout.ProcessingTimeTimeout)
