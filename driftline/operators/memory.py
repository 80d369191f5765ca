"""What became of what was said: observables, roll-ups, document packs, and replayed assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline import config
from driftline.operators.decide import percent_change


def metric_history(values: DataFrame, since: str, until: str) -> DataFrame:
    """(entity_id, metric, first, last, n) of the values from one day to another."""
    rows = values.where(F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    return rows.groupBy("entity_id", "metric").agg(F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"), F.count("*").alias("n"))


def observables(said: DataFrame, history: DataFrame, days_elapsed: int, flat: float = config.FLAT_BAND) -> DataFrame:
    """Adds change and status to (entity_id, metric, direction, horizon_days): pending, no_data, met or missed."""
    out = said.join(history, ["entity_id", "metric"], "left").withColumn("change", percent_change(F.col("first"), F.col("last")))
    moved = F.when(F.col("change") > flat, "up").when(F.col("change") < -flat, "down").otherwise("flat")
    status = F.when(F.col("n").isNull() | (F.col("n") < 2), "no_data").when(moved == F.col("direction"), "met").when(F.lit(days_elapsed) < F.col("horizon_days"), "pending").otherwise("missed")
    return out.withColumn("status", status).drop("first", "last", "n")


def roll_up(statuses: DataFrame, key: str) -> DataFrame:
    """(key, summary) such as "2 met, 1 missed", the most frequent first and ties by name."""
    counts = statuses.groupBy(key, "status").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "status", "n")))
    return counts.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(" ", x["n"], x["status"])), ", ").alias("summary"))


def timeline(events: DataFrame, key: str = "entity_id", last: int = 40, cap: int = 4000) -> DataFrame:
    """(key, text) of the newest events of each key in order of time; cut before the shuffle, so no key is collected whole."""
    newest = events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("occurred_at"), F.desc("id")))).where(F.col("_r") <= last)
    line = F.struct("occurred_at", "id", F.format_string("%s %s/%s", F.date_format("occurred_at", "yyyy-MM-dd"), "source", "event_type").alias("line"))
    return newest.groupBy(key).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 1, cap).alias("text"))


def evidence(events: DataFrame, key: str = "entity_id", newest: int = 40, shown: int = 20) -> DataFrame:
    """The newest events of each key without snapshots, each (url, title) once, at most so many."""
    rows = events.where(~F.col("event_type").contains("snapshot"))
    order = [F.desc("occurred_at"), F.desc("id")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= newest)
    rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(key, "url", "title").orderBy(*order))).where(F.col("_d") == 1)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= shown).drop("_r", "_d")


def reached(states: DataFrame, entity_id: int, state: str, by: str) -> DataFrame:
    """One row (passed): whether the entity was in the state, or a hotter one, by a day."""
    rank = F.create_map(*(F.lit(x) for p in {"dormant": 0, "fading": 0, "simmering": 1, "accelerating": 2, "breakout": 3}.items() for x in p))
    seen = states.where((F.col("entity_id") == entity_id) & (F.col("day") <= F.lit(by).cast("date")))
    return seen.agg(F.coalesce(F.bool_or(rank[F.col("state")] >= rank[F.lit(state)]), F.lit(False)).alias("passed"))


def one_entity(entities: DataFrame, anchors: list[str]) -> DataFrame:
    """One row (passed): whether all anchors are known and share one canonical id."""
    found = entities.where(F.col("anchor_key").isin(*anchors))
    return found.agg(((F.count_distinct("canonical_id") == 1) & (F.count_distinct("anchor_key") == len(set(anchors)))).alias("passed"))


def decided(decisions: DataFrame, entity_id: int, decision: str, present: bool = True) -> DataFrame:
    """One row (passed): whether the gate ever decided so of the entity, or never did."""
    n = F.count_if((F.col("entity_id") == entity_id) & (F.col("decision") == decision))
    return decisions.agg(((n > 0) == F.lit(present)).alias("passed"))
