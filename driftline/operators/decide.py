"""Scores, gates, reviews and small statistics that decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import config


def age_bucket(days: Column) -> Column:
    return F.when(days <= 30, "0-30d").when(days <= 90, "31-90d").when(days <= 365, "91-365d").otherwise("365d+")


def momentum(state: Column, p: Column) -> Column:
    """Base of the state, damped by how far p is from 1."""
    base = F.when(state == "breakout", config.GATE_BASE["breakout"]).when(state == "accelerating", config.GATE_BASE["accelerating"]).otherwise(0.0)
    floor = config.GATE_FLOORS[0]
    return base * (floor + (1 - floor) * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def gate_score(m: Column, r: Column, n: Column) -> Column:
    _, a, b = config.GATE_FLOORS
    return m * (a + (1 - a) * r) * (b + (1 - b) * n)


def novelty(entities: DataFrame, category: str, first_seen: str, key: str, as_of: str | Column, days: int = config.NOVELTY_DAYS, by: tuple[str, ...] = ()) -> DataFrame:
    """1 for the first three of a category younger than so many days, 0.6 in a category of under ten, else 0.3.

    ``as_of`` may be a column; ``by`` are further columns that a category is counted within.
    """
    at = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    rows = entities.where(F.datediff(at, F.col(first_seen)) < days)
    group = [*by, category]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(first_seen, key))
    first = rows.select(*group, key, place.alias("_r")).where("_r <= 3")  # cut before the shuffle
    size = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    same = lambda other: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in other]
    out = rows.alias("a").join(first.alias("b"), same([*group, key]), "left").select("a.*", "_r")
    out = out.alias("a").join(size.alias("b"), same(group), "left").select("a.*", "_n")
    return out.withColumn("novelty", F.when(F.col("_r").isNotNull(), 1.0).when(F.col("_n") < 10, 0.6).otherwise(0.3)).drop("_r", "_n")


def top_under_budget(rows: DataFrame, score: str, key: str, budget: int, partition: list[str] | None = None, eligible: Column | None = None) -> DataFrame:
    """Adds decision: 'pass' for the best under the budget, 'budget' for the others, 'ineligible' outside; none is dropped."""
    eligible = F.lit(True) if eligible is None else eligible
    w = Window.partitionBy(*(partition or []), "_ok").orderBy(F.desc(score), key)
    out = rows.withColumn("_ok", F.coalesce(eligible, F.lit(False))).withColumn("_r", F.row_number().over(w))
    return out.withColumn("decision", F.when(~F.col("_ok"), "ineligible").when(F.col("_r") <= budget, "pass").otherwise("budget")).drop("_ok", "_r")


def percent_change(first: Column, last: Column) -> Column:
    return F.when(first == 0, F.when(last == 0, 0.0).otherwise(1.0)).otherwise((last - first) / first)


def growth(series: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Growth between the values at or before two days, where the first is positive; both in one aggregate."""
    a = F.max_by(F.when(F.col("day") <= F.lit(start).cast("date"), F.col("value")), F.when(F.col("day") <= F.lit(start).cast("date"), F.col("day")))
    b = F.max_by(F.when(F.col("day") <= F.lit(end).cast("date"), F.col("value")), F.when(F.col("day") <= F.lit(end).cast("date"), F.col("day")))
    return series.groupBy(key).agg(a.alias("v0"), b.alias("v1")).where("v0 > 0 AND v1 IS NOT NULL").select(key, ((F.col("v1") - F.col("v0")) / F.col("v0")).alias("growth"))


def upper_median(value: str) -> Column:
    """The middle of a sorted list, the upper one of two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def verdict(percentile: Column, growth_: Column, flat: float = config.FLAT_BAND) -> Column:
    return F.when(percentile.isNull(), "unmeasurable").when(growth_ > flat, "took_hold").when(growth_ < -flat, "faded").otherwise("flat")


def majority(votes: DataFrame, key: list[str], vote: str) -> DataFrame:
    """The vote of more than half, else 'split'."""
    counts = votes.groupBy(*key, vote).agg(F.count("*").alias("n"))
    top = counts.groupBy(*key).agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.max_by(vote, "n").alias("top"))
    return top.select(*key, F.when(F.col("most") * 2 > F.col("total"), F.col("top")).otherwise("split").alias("stance"))


def transitions(states: DataFrame, key: str, day: str, before: str) -> DataFrame:
    """(key, was, now) where the latest state by a day differs from that by an earlier one, 'dormant' if there was none."""

    def at(d: str) -> Column:
        seen = F.col("day") <= F.lit(d).cast("date")
        return F.max_by(F.when(seen, F.col("state")), F.when(seen, F.col("day")))

    both = states.groupBy(key).agg(F.coalesce(at(before), F.lit("dormant")).alias("was"), F.coalesce(at(day), F.lit("dormant")).alias("now"))
    return both.where("was <> now")
