"""Structured Streaming: template counts by the hour, repeats within a watermark, and running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tersa.functions.text import content_ref, mask, token_estimate


def _lines(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(level, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), "event_type", F.lit(" "), "props")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), mask(line).alias("template"))


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, template, n of events; on a stream with ``late``, hours close when the watermark passes them."""
    rows = _lines(events)
    if late:
        rows = rows.withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", "1 hour"), "template").agg(F.count("*").alias("n"))
    return counts.select(F.unix_seconds("window.start").alias("hour"), "template", "n")


def first_uses(requests: DataFrame, late: str) -> DataFrame:
    """Of a stream of requests (ts, text, query) the first of each text and query within the watermark."""
    memo = content_ref(F.concat("text", F.lit("\0"), F.coalesce("query", F.lit(""))))
    return requests.withColumn("memo", memo).withWatermark("ts", late).dropDuplicatesWithinWatermark(["memo"])


def running_totals(done: DataFrame) -> DataFrame:
    """tokens_in, tokens_out, saved over everything a stream (text, compressed) has seen; for complete mode."""
    rows = done.select(token_estimate(F.col("text")).alias("a"), token_estimate(F.col("compressed")).alias("b"))
    return rows.agg(F.sum("a").alias("tokens_in"), F.sum("b").alias("tokens_out")).withColumn("saved", F.expr("tokens_in - tokens_out"))


def evictions(uses: DataFrame, capacity: int, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """tenant, ref, reason from a stream of uses (tenant, ref, at): references leave a tenant's store when ``capacity`` others were
    used after them ("capacity"), or when the watermark is past their time to live ("ttl"). The state of a tenant has at most
    ``capacity`` references with the time of their last use; a late use does not move it back."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for ref, at in zip(frame["ref"], frame["at"], strict=True):
                last[ref] = max(last.get(ref, 0), int(at.timestamp() * 1000))
        order = sorted(last, key=lambda r: (-last[r], r))
        full, order = order[capacity:], order[:capacity]
        now = state.getCurrentWatermarkMs()
        old = [r for r in order if last[r] + ttl_seconds * 1000 < now]
        order = [r for r in order if last[r] + ttl_seconds * 1000 >= now]
        if order:
            state.update((order, [last[r] for r in order]))
            state.setTimeoutTimestamp(max(now, min(last[r] for r in order) + ttl_seconds * 1000) + 1)
        elif state.exists:
            state.remove()
        gone = [(key[0], r, "capacity") for r in full] + [(key[0], r, "ttl") for r in old]
        yield pd.DataFrame(gone, columns=["tenant", "ref", "reason"])

    held = uses.withWatermark("at", delay).select("tenant", "ref", "at").groupBy("tenant")
    return held.applyInPandasWithState(
        step, "tenant string, ref string, reason string", "refs array<string>, times array<long>", "update", GroupStateTimeout.EventTimeTimeout
    )
