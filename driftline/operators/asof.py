"""As-of reads: what was visible at an instant, the latest row of a key, slowly changing attributes, merge chains.

Every function takes the instant as a value; none asks the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.components import checkpoint, connected_components


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


#: Where an event that counts may come from.
ORIGINS = ("live", "backfill")


def events_asof(events: DataFrame, as_of: str, sources: tuple[str, ...] = (), source: str = "source", occurred_at: str = "occurred_at") -> DataFrame:
    """Events that had occurred by then, of some sources or all and, if origins are told, live or backfilled; all reach the scan."""
    out = events.where(F.col(occurred_at) <= instant(as_of))
    if "origin" in events.columns:
        out = out.where(F.col("origin").isin(*ORIGINS))
    return out.where(F.col(source).isin(*sources)) if sources else out


def latest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str] | None = None) -> DataFrame:
    """The row of each key that is last in the order; one hash aggregate with map-side combine, no sort of whole groups."""
    values = values or [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row"))
    return picked.select(*keys, "row.*")


def attribute_asof(history: DataFrame, key: str, value: str, effective_at: str, tie: str, as_of: str) -> DataFrame:
    """The value of each key that was in force: the latest by (effective_at, tie) not after the instant."""
    seen = history.where(F.col(effective_at) <= instant(as_of))
    return seen.groupBy(key).agg(F.max_by(value, F.struct(effective_at, tie)).alias(value))


def canonical_ids(merges: DataFrame, as_of: str | None = None) -> DataFrame:
    """(entity_id, canonical_id) of each merged entity, by pointer jumping over (loser_id, survivor_id).

    Only active merges justified by the instant count, if those columns are there; of several for one loser, the latest
    justified, then the smallest survivor. Each round halves the chains and is cut by a checkpoint, so n links take about
    log2(n) rounds. What is left after them runs in circles; its canonical id is the smallest that it is joined with.
    """
    links = merges
    if "active" in merges.columns:
        links = links.where("active")
    if as_of is not None:
        links = links.where(F.col("justified_at") <= instant(as_of))
    late = F.struct("justified_at", -F.col("survivor_id")) if "justified_at" in merges.columns else -F.col("survivor_id")
    links = links.where("loser_id <> survivor_id").groupBy("loser_id").agg(F.max_by("survivor_id", late).alias("survivor_id"))
    first = now = checkpoint(links.select(F.col("loser_id").alias("entity_id"), F.col("survivor_id").alias("canonical_id")))
    for _ in range(first.count().bit_length() + 1):
        up = now.select(F.col("entity_id").alias("canonical_id"), F.col("canonical_id").alias("up"))
        jumped = checkpoint(now.join(up, "canonical_id", "left").select("entity_id", F.coalesce("up", "canonical_id").alias("canonical_id"), F.col("up").isNotNull().alias("moved")))
        now = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return now
    circling = jumped.where("moved").select("entity_id")
    joined = connected_components(first.join(circling, "entity_id", "left_semi"), "entity_id", "canonical_id").withColumnRenamed("node", "entity_id")
    return now.join(joined, "entity_id", "left").select("entity_id", F.coalesce("component", "canonical_id").alias("canonical_id"))


ALWAYS, NEVER = "0001-01-01", "9999-12-31"


def in_force(rows: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """(key, value, since, until) in days: what was in force at the end of each day, as rows that hold until the next one.

    Of several changes on a day, the latest by (at, tie) counts.
    """
    daily = rows.groupBy(key, F.to_date(at).alias("since")).agg(F.max_by(value, F.struct(at, tie)).alias(value))
    following = F.lead("since").over(Window.partitionBy(key).orderBy("since"))
    return daily.withColumn("until", F.coalesce(following, F.lit(NEVER).cast("date")))


def canonical_intervals(merges: DataFrame, days: list[str]) -> DataFrame:
    """(entity_id, canonical_id, since, until): the survivor of each merged entity at the end of every day, as half-open intervals.

    Pointer jumping as in ``canonical_ids``, but for all days at once: an interval meets those of its survivor that it
    overlaps, and is cut where the survivor's own survivor changes. Entities that lose at some time have intervals over all
    days; others have none. Where merges run in circles, the smallest entity joined with them stands, told for ``days`` only.
    """
    links = merges.where("active") if "active" in merges.columns else merges
    links = in_force(links.where("loser_id <> survivor_id").withColumn("_tie", -F.col("survivor_id")), "loser_id", "survivor_id", "justified_at", "_tie")
    links = links.select(F.col("loser_id").alias("entity_id"), F.col("survivor_id").alias("canonical_id"), "since", "until")
    alone = links.groupBy("entity_id").agg(F.min("since").alias("until")).select("entity_id", F.col("entity_id").alias("canonical_id"), F.lit(ALWAYS).cast("date").alias("since"), "until")
    first = now = checkpoint(links.unionByName(alone))
    overlap = (F.col("since") < F.col("_until")) & (F.col("_since") < F.col("until"))
    for _ in range(first.count().bit_length() + 1):
        up = now.select(F.col("entity_id").alias("_of"), F.col("canonical_id").alias("_up"), F.col("since").alias("_since"), F.col("until").alias("_until"))
        jumped = now.join(up, (F.col("canonical_id") == F.col("_of")) & overlap, "left")
        jumped = jumped.select("entity_id", F.coalesce("_up", "canonical_id").alias("canonical_id"), F.coalesce(F.greatest("since", "_since"), "since").alias("since"), F.coalesce(F.least("until", "_until"), "until").alias("until"), F.coalesce(F.col("_up") != F.col("canonical_id"), F.lit(False)).alias("moved"))
        jumped = checkpoint(jumped)
        now = joined_intervals(jumped.drop("moved"), ["entity_id", "canonical_id"])
        if jumped.where("moved").isEmpty():
            return now
    circling = on_days(jumped.where("moved").select("entity_id", "since", "until"), days)
    # nodes are (day, entity) as one number, so that a day's circles are components of their own
    wide, per_day = "decimal(38,0)", 10**20
    node = lambda c: F.datediff("day", F.lit(ALWAYS)).cast(wide) * F.lit(per_day).cast(wide) + F.col(c).cast(wide)
    edges = on_days(first, days).join(circling.select("entity_id", "day"), ["entity_id", "day"], "left_semi")
    groups = connected_components(edges.select(node("entity_id").cast(wide).alias("a"), node("canonical_id").cast(wide).alias("b")), "a", "b")
    least = circling.join(groups, node("entity_id").cast(wide) == F.col("node")).select("entity_id", (F.col("component") - F.datediff("day", F.lit(ALWAYS)).cast(wide) * F.lit(per_day).cast(wide)).cast("long").alias("canonical_id"), F.col("day").alias("since"), F.date_add("day", 1).alias("until"))
    return joined_intervals(jumped.where("NOT moved").drop("moved").unionByName(least), ["entity_id", "canonical_id"])


def joined_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of equal keys that touch or overlap become one."""
    order = Window.partitionBy(*keys).orderBy("since", "until")
    reach = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (reach.isNull() | (reach < F.col("since"))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_run")


def on_days(rows: DataFrame, days: list[str]) -> DataFrame:
    """A row with ``day`` for each of the days that an interval holds; the days are a literal, no join."""
    all_days = F.array(*(F.lit(d).cast("date") for d in days))
    held = F.filter(all_days, lambda d: (d >= F.col("since")) & (d < F.col("until")))
    return rows.withColumn("day", F.explode(held))


def merge_sets(canonical: DataFrame) -> DataFrame:
    """(canonical_id, members) of each entity that others were merged into, itself among its members, in order of id."""
    own = canonical.select(F.col("canonical_id").alias("entity_id"), "canonical_id")
    return canonical.unionByName(own).groupBy("canonical_id").agg(F.sort_array(F.collect_set("entity_id")).alias("members"))


def with_canonical(df: DataFrame, canonical: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows with merged entities replaced by their survivors."""
    names = canonical.select(F.col("entity_id").alias("_from"), F.col("canonical_id").alias("_to"))
    return df.join(names, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
