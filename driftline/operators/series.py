"""Daily series of an entity: metric kinds, fills, lags, cohort ranks and the state machine, all as window plans.

A series is long: (entity, day, value), with extra key columns named by the caller. Days are dates; windows count
calendar days, so gaps matter. Each operator shuffles once, by the series' key, and reuses that partitioning where the
next one is keyed alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import config


def day_number(day: str = "day") -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def daily_last(events: DataFrame, keys: list[str], at: str, tie: str, value: str) -> DataFrame:
    """The last value of each key and day by (time, tie)."""
    return events.groupBy(*keys, F.to_date(at).alias("day")).agg(F.max_by(value, F.struct(at, tie)).alias("value"))


def forward_fill(series: DataFrame, keys: list[str], days: int, end: str) -> DataFrame:
    """Carries each value on for at most so many days, never over the next observation nor past the end."""
    following = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    last = F.least(F.date_add("day", days), F.coalesce(F.date_sub(following, 1), F.date_add("day", days)), F.lit(end).cast("date"))
    return series.withColumn("_last", last).where("_last >= day").select(*keys, F.explode(F.sequence("day", "_last")).alias("day"), "value")


def cumulative(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Running number of events at each day that has any."""
    counts = events.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return counts.select(*keys, "day", F.sum("n").over(Window.partitionBy(*keys).orderBy("day")).alias("value"))


def _spread(events: DataFrame, at: str, days: int, end: str) -> DataFrame:
    """A row for each day whose trailing window holds the event."""
    day = F.to_date(at)
    last = F.least(F.date_add(day, days - 1), F.lit(end).cast("date"))
    return events.where(day <= F.lit(end).cast("date")).withColumn("day", F.explode(F.sequence(day, last)))


def trailing_sum(events: DataFrame, keys: list[str], at: str, value: str, days: int, end: str) -> DataFrame:
    """Sum over the trailing calendar window of each day on which it isn't empty; positive sums only.

    Days are summed first, so what is spread is at most one row for each key and day.
    """
    daily = events.groupBy(*keys, F.to_date(at).alias("_at")).agg(F.sum(value).alias("_value"))
    return _spread(daily, "_at", days, end).groupBy(*keys, "day").agg(F.sum("_value").alias("value")).where("value > 0")


def trailing_distinct(events: DataFrame, keys: list[str], at: str, kind: str, days: int, end: str) -> DataFrame:
    """Number of kinds in the trailing calendar window of each day on which it isn't empty."""
    daily = events.select(*keys, F.to_date(at).alias("_at"), kind).distinct()
    return _spread(daily, "_at", days, end).groupBy(*keys, "day").agg(F.count_distinct(kind).alias("value"))


def change_since(series: DataFrame, keys: list[str], days: int = config.LAG_DAYS) -> DataFrame:
    """Value less the last value at or before so many days earlier, 0 if there is none: a backward as-of join on itself."""
    frame = Window.partitionBy(*keys).orderBy("_n").rangeBetween(Window.unboundedPreceding, -days)
    before = F.coalesce(F.last("value", True).over(frame), F.lit(0))
    return series.withColumn("_n", day_number()).withColumn("value", F.col("value") - before).drop("_n")


def cohorts(members: DataFrame, key: str, fallback: str, least: int = config.COHORT_MIN) -> DataFrame:
    """Adds cohort, cohort_n and provisional: the key if enough share it, else the fallback, provisional if too few share that."""
    out = members
    for column, of in (("_n", key), ("_m", fallback)):  # counts by aggregates, as few cohorts hold most members
        size = members.groupBy(F.col(of).alias("_of")).agg(F.count("*").alias(column))
        out = out.join(size, F.col(of).eqNullSafe(F.col("_of"))).drop("_of")
    own = F.col("_n") >= least
    out = out.withColumn("cohort", F.when(own, F.col(key)).otherwise(F.col(fallback))).withColumn("cohort_n", F.when(own, F.col("_n")).otherwise(F.col("_m")))
    return out.withColumn("provisional", ~own & (F.col("_m") < least)).drop("_n", "_m")


def cohort_percent_rank(series: DataFrame, by: list[str], members: str, value: str = "value") -> DataFrame:
    """Percent rank among all members of a cohort, those without a row that day counting as 0.

    Absent members are counted, not made: with p rows present of n members, those below v number (rank - 1), and n - p
    more if v is above 0.
    """
    at = Window.partitionBy(*by)
    below = F.rank().over(at.orderBy(value)) - 1 + F.when(F.col(value) > 0, F.col(members) - F.count("*").over(at)).otherwise(0)
    return series.withColumn("pctl", F.when(F.col(members) > 1, below / (F.col(members) - 1)).otherwise(0.0))


def raw_tier(count_60: Column, count_80: Column, count_95: Column, breadth: Column, promotions: Column, active: Column) -> Column:
    """0 dormant, 1 simmering, 2 accelerating, 3 breakout: the highest tier whose entry condition holds today.

    The counts are of metrics at each percentile; promotions are those of the last 30 days.
    """
    warm = count_60 >= 1
    out = F.when((promotions >= 2) | ((count_95 >= 1) & (breadth >= config.BREADTH_MIN)), 3).when((count_80 >= 2) | ((promotions >= 1) & warm), 2).when(warm, 1)
    return F.when(active, out.otherwise(0)).otherwise(0)


def hysteresis(days: DataFrame, key: str, tier: str = "raw_tier", promote: int = config.PROMOTE_DAYS, demote: int = config.DEMOTE_DAYS, top: int = 3) -> DataFrame:
    """Adds smoothed_tier: it rises to what the last ``promote`` days all reached and falls to the most of the last ``demote``.

    The committed tier is the previous one clamped between these two, which never cross. For each level that is a latch:
    set once the low is there, cleared once the high is below; the last of these events tells, so no state is carried
    row by row. Rows are consecutive days of each key.
    """
    order = Window.partitionBy(key).orderBy("day")
    short, long = order.rowsBetween(1 - promote, 0), order.rowsBetween(1 - demote, 0)
    out = days.withColumn("_low", F.when(F.count("*").over(short) >= promote, F.min(tier).over(short)).otherwise(0))
    out = out.withColumn("_high", F.when(F.count("*").over(long) >= demote, F.max(tier).over(long)).otherwise(top))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    level = [F.coalesce(F.last(F.when(F.col("_low") >= k, 1).when(F.col("_high") < k, 0), True).over(so_far), F.lit(0)) for k in range(1, top + 1)]
    return out.withColumn("smoothed_tier", sum(level[1:], level[0])).drop("_low", "_high")


def states(days: DataFrame, key: str, p: str = "p", last_event: str = "last_event", provisional: str = "provisional", fade: float = config.FADE, fade_days: int = config.FADE_DAYS, inactive: int = config.FADE_INACTIVE_DAYS) -> DataFrame:
    """Adds state from smoothed_tier: a key that once peaked and is now at 0, cold or silent for long, is fading.

    In a provisional cohort no state above ``config.PROVISIONAL_CAP`` is told, though the tier goes on.
    """
    order = Window.partitionBy(key).orderBy("day")
    cold = order.rowsBetween(1 - fade_days, 0)
    peaked = F.max((F.col("smoothed_tier") >= 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    quiet = (F.count("*").over(cold) >= fade_days) & (F.max(p).over(cold) < fade)
    silent = F.coalesce(F.datediff("day", last_event) >= inactive, F.lit(True))
    told = F.when(F.col(provisional), F.least("smoothed_tier", F.lit(config.PROVISIONAL_CAP))).otherwise(F.col("smoothed_tier"))
    names = F.element_at(F.array(*map(F.lit, ("dormant", "simmering", "accelerating", "breakout"))), told.cast("int") + 1)
    return days.withColumn("state", F.when((F.col("smoothed_tier") == 0) & peaked & (quiet | silent), "fading").otherwise(names))


def within_days(days: DataFrame, key: str, flag: str, window: int) -> Column:
    """Number of flagged rows in the trailing calendar window (as of each row)."""
    frame = Window.partitionBy(key).orderBy(day_number()).rangeBetween(1 - window, 0)
    return F.sum(F.col(flag).cast("int")).over(frame)


def threshold_crossing(events: DataFrame, key: str, kind: str, at: str, days: int, count: int) -> DataFrame:
    """The first time by which an entity had so many kinds within a trailing window of days.

    One range window by entity counts the kinds up to each event; the first event at which there are enough is it.
    """
    e = events.select(key, kind, F.col(at).alias("t")).distinct().withColumn("_us", F.unix_micros(F.col("t").cast("timestamp")))
    frame = Window.partitionBy(key).orderBy("_us").rangeBetween(-days * 86_400_000_000, 0)
    kinds = e.withColumn("_k", F.size(F.collect_set(kind).over(frame)))
    return kinds.where(F.col("_k") >= count).groupBy(key).agg(F.min("t").alias("crossed_at"))


def first_hits(events: DataFrame, key: str, predicates: dict[str, Column], order: list[str]) -> DataFrame:
    """(key, stage, first struct of order) of the earliest event that meets each predicate, in one aggregate."""
    picked = events.groupBy(key).agg(*(F.min(F.when(p, F.struct(*order))).alias(name) for name, p in predicates.items()))
    stages = F.array(*(F.struct(F.lit(n).alias("stage"), F.col(n).alias("hit")) for n in predicates))
    return picked.select(key, F.explode(stages).alias("s")).where("s.hit IS NOT NULL").select(key, "s.stage", "s.hit.*")
