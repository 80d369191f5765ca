"""Structured Streaming counterparts: idempotent ingest, windowed counts, and the state machine with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import config


def deduplicated(events: DataFrame, keys: list[str], at: str = "occurred_at", late: str = "2 days") -> DataFrame:
    """Each key once; its state is dropped when the watermark has passed it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def weekly(events: DataFrame, at: str = "occurred_at", late: str = "2 days") -> DataFrame:
    """Events by kind in ISO weeks; the epoch is a Thursday, so weeks start four days after it."""
    return events.withWatermark(at, late).groupBy(F.window(at, "7 days", "7 days", "4 days").alias("week"), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, days: int, at: str = "occurred_at", late: str = "2 days", value: str = "value") -> DataFrame:
    """Sums over the trailing days, for each day."""
    return events.withWatermark(at, late).groupBy(F.window(at, f"{days} days", "1 day").alias("days"), "entity_id").agg(F.sum(value).alias("value"))


def _clamp(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    tier, history = state.get if state.exists else (0, "")
    seen = [int(c) for c in history]
    rows = pd.concat(list(batches)).sort_values("day")
    out = []
    for day, raw in zip(rows["day"], rows["raw_tier"]):
        seen = [*seen, int(raw)][-config.DEMOTE_DAYS :]
        if len(seen) >= config.PROMOTE_DAYS:
            tier = max(tier, min(seen[-config.PROMOTE_DAYS :]))
        if len(seen) >= config.DEMOTE_DAYS:
            tier = min(tier, max(seen))
        out.append((key[0], day, tier))
    state.update((tier, "".join(map(str, seen))))
    yield pd.DataFrame(out, columns=["entity_id", "day", "smoothed_tier"])


def hysteresis(days: DataFrame) -> DataFrame:
    """The smoothed tier of (entity_id, day, raw_tier) as days arrive in order; an entity's state is its tier and last seven days."""
    return days.groupBy("entity_id").applyInPandasWithState(_clamp, "entity_id long, day date, smoothed_tier int", "tier int, history string", "append", "NoTimeout")
