"""Replaying a window of days in one plan: what each day's run would have said, without a loop over days.

Merges, categories and cohorts change what a day's run sees, events don't: a run at the end of a day sees the events up to
it. So each canonical entity is cut into cells, the stretches of days in which the same entities count as it. Metrics, lags
and promotions are worked out once for each cell; only cohort ranks and states, which do differ from run to run, are keyed
by (as_of, entity).
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline import config
from driftline.operators import asof, decide, series
from driftline.operators.components import checkpoint
from driftline.plans import momentum


def cells(canonical: DataFrame) -> DataFrame:
    """(canonical_id, since, until) for each stretch between changes of who counts as an entity, for entities where it changes."""
    ends = canonical.select("canonical_id", F.explode(F.array("since", "until", F.lit(asof.ALWAYS).cast("date"))).alias("since")).distinct()
    until = F.lead("since").over(Window.partitionBy("canonical_id").orderBy("since"))
    never = F.lit(asof.NEVER).cast("date")
    return ends.withColumn("until", F.coalesce(until, never)).where(F.col("since") < never)


def celled(events: DataFrame, links: DataFrame, merges: DataFrame, days: list[str]) -> DataFrame:
    """Attached events of each cell, with cell (id, since) and its end ``until``; events after a cell's end aren't its own."""
    attached = links.where("rule = 'attach' AND raw_event_id IS NOT NULL").select("entity_id", F.col("raw_event_id").alias("id"))
    last = max(days)
    rows = asof.events_asof(events, f"{last} 23:59:59.999999").join(attached, "id")
    canonical = asof.canonical_intervals(merges, days).where(F.col("since") <= F.lit(last).cast("date"))
    names = canonical.select("entity_id", F.col("canonical_id").alias("_to"), F.col("since").alias("_from"), F.col("until").alias("_until"))
    rows = rows.join(names, "entity_id", "left").withColumn("entity_id", F.coalesce("_to", "entity_id"))
    parts = cells(canonical).select(F.col("canonical_id").alias("entity_id"), "since", "until")
    always, never = F.lit(asof.ALWAYS).cast("date"), F.lit(asof.NEVER).cast("date")
    rows = rows.join(parts, "entity_id", "left").withColumns({"since": F.coalesce("since", always), "until": F.coalesce("until", never)})
    rows = rows.where("_from IS NULL OR (since >= _from AND until <= _until)").where(F.to_date("occurred_at") < F.col("until"))
    return rows.withColumn("cell", F.struct(F.col("entity_id").alias("id"), "since")).drop("_to", "_from", "_until", "entity_id", "since")


def runs(stream: DataFrame, entities: DataFrame, history: DataFrame, days: list[str]) -> DataFrame:
    """The entities that each day's run knows: entity_id (as_of, id), cell, first_seen, category and cohort keys of that day."""
    first = stream.where(~F.col("event_type").isin(*momentum.ENRICHMENT)).groupBy("cell", "until").agg(F.min(F.to_date("occurred_at")).alias("first_seen"))
    rows = asof.on_days(first.withColumn("since", F.greatest("cell.since", "first_seen")), days).select("cell", F.col("cell.id").alias("id"), "day", "first_seen")
    rows = rows.join(entities.select("id", "entity_type"), "id")
    category = asof.in_force(history, "entity_id", "category", "effective_at", "id").select(F.col("entity_id").alias("id"), "category", "since", "until")
    rows = rows.join(asof.on_days(category, days).select("id", "day", "category"), ["id", "day"], "left")
    age = decide.age_bucket(F.datediff("day", "first_seen"))
    return rows.select(
        F.struct(F.col("day").alias("as_of"), "id").alias("entity_id"),
        "cell",
        "first_seen",
        "category",
        "entity_type",
        F.concat_ws("|", "day", "entity_type", age).alias("fallback"),
        F.concat_ws("|", "day", "entity_type", F.coalesce("category", F.lit("_uncategorized")), age).alias("key"),
    )


def replay(events: DataFrame, links: DataFrame, merges: DataFrame, entities: DataFrame, history: DataFrame, days: list[str]) -> tuple[DataFrame, DataFrame]:
    """(states, runs) of the run at the end of each of the days: every entity's state on every day up to the run's.

    states has as_of, entity_id, day and all that ``momentum.score`` tells. The stream is written once, as all metrics read it.
    """
    stream = checkpoint(celled(events, links, merges, days))
    by_cell = stream.withColumn("entity_id", F.col("cell"))
    values = checkpoint(momentum.snapshot(by_cell, f"{max(days)} 23:59:59"))
    known = checkpoint(runs(stream, entities, history, days))
    cohorts = series.cohorts(known, "key", "fallback").select("entity_id", "cell", "first_seen", "cohort", "cohort_n", "provisional")
    cohorts = checkpoint(cohorts)
    change = momentum.changed(values).withColumnRenamed("entity_id", "cell").join(cohorts, "cell").where("day <= entity_id.as_of")
    daily = momentum.signals(change, momentum.breadth(values).withColumnRenamed("entity_id", "cell"), series_key="cell")
    grid = cohorts.withColumn("day", F.explode(F.sequence("first_seen", "entity_id.as_of")))
    promotions = momentum.ladder(by_cell).withColumnRenamed("entity_id", "cell")
    states = momentum.daily_states(grid, daily, stream, promotions, "cell")
    return states.select(F.col("entity_id.as_of").alias("as_of"), F.col("entity_id.id").alias("entity_id"), *(c for c in states.columns if c not in ("entity_id", "cell"))), known


def stored(states: DataFrame) -> DataFrame:
    """What the table of states holds after the replay: for each entity and day the row of the last run that wrote it."""
    values = [c for c in states.columns if c not in ("entity_id", "day")]
    return asof.latest_by(states, ["entity_id", "day"], ["as_of"], values)


def trace(states: DataFrame) -> DataFrame:
    """Each run's word on its own day: (entity_id, day, state, p)."""
    return states.where("day = as_of").select("entity_id", "day", "state", "p")


def weeks(days: list[str]) -> list[str]:
    """The Mondays of the ISO weeks that the days touch."""
    of = [datetime.date.fromisoformat(d) for d in days]
    return sorted({str(d - datetime.timedelta(d.weekday())) for d in of})


def gates(states: DataFrame, known: DataFrame, reach: DataFrame, days: list[str], briefed: DataFrame | None = None, cards: DataFrame | None = None, budget: int = config.BRIEFS_PER_WEEK) -> DataFrame:
    """The gate of every week that the window touches, over the stored states, knowing what the last run knows."""
    last = F.lit(max(days)).cast("date")
    people = known.where(F.col("entity_id.as_of") == last).select(F.col("entity_id.id").alias("entity_id"), "category", "first_seen")
    return momentum.gates(stored(states), reach, people, weeks(days), briefed, cards, budget)
