"""From events to momentum: attached streams, metric snapshot, ladder, velocity, states.

Inputs are the raw tables: events (id, source, event_type, occurred_at, payload as JSON text), links (entity_id,
raw_event_id, rule), merges and category history. Every output is a function of ``as_of``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import config
from driftline.operators import asof, decide, series


@dataclass(frozen=True)
class Metric:
    """A row of the metric registry; adding a metric is adding a row."""

    name: str
    kind: str  # counter, level, rolling or cumulative
    evidence: str  # participation, usage or attention
    source: str
    event_type: str
    field: str = ""
    composite: bool = True
    fill_days: int = 0
    window_days: int = 0


#: Fixed values.
METRICS = (
    Metric("gh_stars", "counter", "participation", "github", "repo_snapshot", "stars", fill_days=3),
    Metric("gh_forks", "counter", "participation", "github", "repo_snapshot", "forks", fill_days=3),
    Metric("gh_stars", "cumulative", "participation", "github", "repo_star"),
    Metric("hf_downloads_30d", "level", "usage", "hf", "model_snapshot", "downloads"),
    Metric("pypi_downloads_7d", "level", "usage", "pypi", "pypi_snapshot", "downloads_7d"),
    Metric("or_tokens_wk", "level", "usage", "openrouter", "or_rankings", "tokens"),
    Metric("hn_points_7d", "rolling", "attention", "hn", "story", "points", composite=False, window_days=7),
)
#: Events that enrich an entity and don't date its first evidence.
ENRICHMENT = ("model_snapshot", "model_readme", "hn_discussion", "pypi_metadata", "launch_page")
COMMERCIAL = ("pricing", "api access", "generally available", "ga release", "paid tier")
STAGES = ("idea_paper", "public_code", "usable_artifact", "distribution", "commercialization", "institutional_adoption")


def streams(events: DataFrame, links: DataFrame, merges: DataFrame | None, as_of: str) -> DataFrame:
    """Events attached to their canonical entity: the root of every trajectory plan."""
    attached = links.where("rule = 'attach' AND raw_event_id IS NOT NULL").select("entity_id", F.col("raw_event_id").alias("id"))
    rows = asof.events_asof(events, as_of).join(attached, "id")
    return rows if merges is None else asof.with_canonical(rows, asof.canonical_ids(merges, as_of))


def field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}").try_cast("double")


def _matched(metrics: tuple[Metric, ...]) -> Column:
    """What an event counts for: its metrics with their values, and its kind of evidence, as (spec, metric, kind, carry, value).

    ``carry`` is for how many days a value goes on. A kind of evidence is a spec of its own after those of the metrics.
    """
    evidence = sorted({m.evidence for m in metrics})

    def entry(spec: int, metric: str, kind: str, carry: int, value: Column) -> Column:
        return F.struct(F.lit(spec).alias("spec"), F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), F.lit(carry).alias("carry"), value.alias("value"))

    none, out = F.lit(None).cast("double"), None
    for source, event_type in dict.fromkeys((m.source, m.event_type) for m in metrics):
        own = [(k, m) for k, m in enumerate(metrics) if (m.source, m.event_type) == (source, event_type)]
        entries = [entry(k, m.name, m.kind, m.window_days - 1 if m.kind == "rolling" else m.fill_days, field(m.field) if m.field else none) for k, m in own]
        last = own[-1][1].evidence  # of specs that share events, the later one's
        entries.append(entry(len(metrics) + evidence.index(last), "evidence_breadth", "breadth", config.BREADTH_WINDOW - 1, none))
        met = (F.col("source") == source) & (F.col("event_type") == event_type)
        out = F.when(met, F.array(*entries)) if out is None else out.when(met, F.array(*entries))
    return out


def snapshot(stream: DataFrame, as_of: str, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(entity_id, metric, day, value) of all metrics; where two specs give one metric a value on a day, the later spec's stays.

    The stream is read once: an event becomes a row for each spec that it counts for, days are summed up, and the kinds differ
    only in what a day's value is and how long it goes on. A counter is carried on to the next observation at most, and so is a
    kind of evidence through its window, so breadth is the number of kinds that are still carried.
    """
    end = F.lit(as_of[:10]).cast("date")
    rows = stream.select("entity_id", "occurred_at", "id", F.explode(_matched(metrics)).alias("m")).select("entity_id", "occurred_at", "id", "m.*")
    valued = F.when(F.col("value").isNotNull(), F.struct("occurred_at", "id"))
    daily = rows.groupBy("entity_id", "spec", "metric", "kind", "carry", F.to_date("occurred_at").alias("day")).agg(F.max_by("value", valued).alias("last"), F.sum("value").alias("total"), F.count("*").alias("n"))
    kind = F.col("kind")
    daily = daily.where(kind.isin("cumulative", "breadth") | F.col("last").isNotNull())
    order = Window.partitionBy("entity_id", "spec").orderBy("day")
    following, so_far = F.lead("day").over(order), F.sum("n").over(order)
    until = F.least(F.date_add("day", F.col("carry")), end)
    until = F.when(kind == "rolling", until).otherwise(F.least(until, F.coalesce(F.date_sub(following, 1), until)))
    value = F.when(kind == "cumulative", so_far).when(kind == "breadth", 1).when(kind == "rolling", F.col("total")).otherwise(F.col("last"))
    spread = daily.withColumns({"value": value.cast("double"), "until": until}).where("until >= day").withColumn("day", F.explode(F.sequence("day", "until")))
    summed = spread.groupBy("entity_id", "spec", "metric", "kind", "day").agg(F.sum("value").alias("value")).where("kind <> 'rolling' OR value > 0")
    picked = F.when(F.first("kind") == "breadth", F.sum("value")).otherwise(F.max_by("value", "spec"))
    return summed.groupBy("entity_id", "metric", "day").agg(picked.alias("value"))


def facts(stream: DataFrame, entities: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """(entity_id, entity_type, category, first_seen, cohort keys) of entities with evidence of their own."""
    first = stream.where(~F.col("event_type").isin(*ENRICHMENT)).groupBy("entity_id").agg(F.min(F.to_date("occurred_at")).alias("first_seen"))
    category = asof.attribute_asof(history, "entity_id", "category", "effective_at", "id", as_of)
    out = first.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").join(category, "entity_id", "left")
    age = decide.age_bucket(F.datediff(F.lit(as_of[:10]).cast("date"), "first_seen"))
    return out.withColumn("fallback", F.concat_ws("|", "entity_type", age)).withColumn("key", F.concat_ws("|", "entity_type", F.coalesce("category", F.lit("_uncategorized")), age))


def ladder(stream: DataFrame) -> DataFrame:
    """(entity_id, stage, promoted_at, evidence_event) of the first event that meets each stage's rule."""
    blob = F.lower(F.concat_ws(" ", *(F.get_json_object("payload", f"$.{k}") for k in ("title", "body", "description", "summary"))))
    worded = F.col("event_type").isin("release_published", "changelog") & blob.rlike("|".join(COMMERCIAL))
    rules = {
        "idea_paper": (F.col("source") == "arxiv") | (F.col("event_type") == "paper_published"),
        "public_code": F.col("source") == "github",
        "usable_artifact": (F.col("event_type") == "release_published") | (F.col("source") == "hf"),
        "distribution": F.col("source").isin("pypi", "npm"),
        "commercialization": ((F.col("source") == "pricing") & (F.col("event_type") == "page_changed")) | worded,
    }
    hits = series.first_hits(stream, "entity_id", rules, ["occurred_at", "id"]).select("entity_id", "stage", F.col("occurred_at").alias("promoted_at"), F.col("id").alias("evidence_event"))
    org = F.lower(F.coalesce(F.get_json_object("payload", "$.org"), F.get_json_object("payload", "$.company")))
    jobs = stream.where("event_type = 'job_mention'").withColumn("org", org).where("org <> ''")
    adopted = series.threshold_crossing(jobs, "entity_id", "org", "occurred_at", 90, 3).withColumnRenamed("crossed_at", "promoted_at")
    event = jobs.select("entity_id", F.col("occurred_at").alias("promoted_at"), "id").groupBy("entity_id", "promoted_at").agg(F.min("id").alias("evidence_event"))
    return hits.unionByName(adopted.join(event, ["entity_id", "promoted_at"]).withColumn("stage", F.lit("institutional_adoption")))


def velocity(values: DataFrame, people: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """Daily signals of each entity: the best percentile, counts at each tier, breadth and the hype gap."""
    cohorts = series.cohorts(people, "key", "fallback").select("entity_id", "cohort", "cohort_n", "provisional", "first_seen")
    return signals(changed(values, metrics).join(cohorts, "entity_id"), breadth(values), metrics)


def changed(values: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """The week's change of each metric, breadth apart."""
    return series.change_since(values.where(F.col("metric").isin(*(m.name for m in metrics))), ["entity_id", "metric"])


def breadth(values: DataFrame) -> DataFrame:
    return values.where("metric = 'evidence_breadth'").select("entity_id", "day", F.col("value").cast("int").alias("breadth"))


def signals(change: DataFrame, broad: DataFrame, metrics: tuple[Metric, ...] = METRICS, series_key: str = "entity_id") -> DataFrame:
    """What the metrics' changes say of an entity's day among its cohort; ``series_key`` is what breadth is keyed by."""
    kinds = {m.name: (m.composite, m.evidence) for m in metrics}
    ranked = series.cohort_percent_rank(change, ["metric", "cohort", "day"], "cohort_n")
    composite = F.col("metric").isin(*(n for n, (c, _) in kinds.items() if c))
    of = lambda e: F.col("metric").isin(*(n for n, (_, x) in kinds.items() if x == e))
    best = F.when(composite, F.col("pctl"))
    out = ranked.groupBy(*dict.fromkeys(("entity_id", series_key)), "day").agg(
        F.coalesce(F.max(best), F.lit(0.0)).alias("p"),
        *(F.count_if(best >= t).alias(n) for n, t in (("count_60", config.SIMMERING), ("count_80", config.ACCELERATING), ("count_95", config.BREAKOUT))),
        F.coalesce(F.avg(F.when(of("attention"), F.col("pctl"))), F.lit(0.0)).alias("attention_p"),
        F.coalesce(F.avg(F.when(of("usage"), F.col("pctl"))), F.lit(0.0)).alias("adoption_p"),
    )
    return out.join(broad, [series_key, "day"], "left").withColumn("hype_gap", F.col("attention_p") - F.col("adoption_p"))


def score(stream: DataFrame, values: DataFrame, people: DataFrame, promotions: DataFrame, as_of: str) -> DataFrame:
    """The state of each entity on each day since its first evidence, with the inputs that led to it."""
    end = F.lit(as_of[:10]).cast("date")
    cohorts = series.cohorts(people, "key", "fallback").select("entity_id", "first_seen", "cohort", "cohort_n", "provisional")
    grid = cohorts.where(F.col("first_seen") <= end).withColumn("day", F.explode(F.sequence("first_seen", end)))
    daily = signals(changed(values).join(cohorts, "entity_id"), breadth(values))
    return daily_states(grid, daily, stream, promotions)


def daily_states(grid: DataFrame, daily: DataFrame, stream: DataFrame, promotions: DataFrame, series_key: str = "entity_id") -> DataFrame:
    """States over a grid of consecutive days; events and promotions are keyed by ``series_key``."""
    active = stream.select(series_key, F.to_date("occurred_at").alias("day")).distinct().withColumn("event_day", F.col("day"))
    promoted = promotions.select(series_key, F.to_date("promoted_at").alias("day")).distinct().withColumn("promoted", F.lit(1))
    days = grid.join(daily, [*dict.fromkeys(("entity_id", series_key)), "day"], "left").join(active, [series_key, "day"], "left").join(promoted, [series_key, "day"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("p", "count_60", "count_80", "count_95", "breadth", "attention_p", "adoption_p", "hype_gap", "promoted")}
    days = days.withColumns(zero).withColumn("last_event", F.max("event_day").over(Window.partitionBy("entity_id").orderBy("day")))
    days = days.withColumn("promo_30d", series.within_days(days, "entity_id", "promoted", config.PROMOTION_WINDOW)).withColumn("active", F.coalesce(F.datediff("day", "last_event") < config.ACTIVE_DAYS, F.lit(False)))
    days = days.withColumn("raw_tier", series.raw_tier(*(F.col(c) for c in ("count_60", "count_80", "count_95", "breadth", "promo_30d", "active"))))
    days = days.withColumn("hype", (F.col("attention_p") >= config.HYPE_ATTENTION) & (F.col("hype_gap") >= config.HYPE_GAP) & (F.col("breadth") <= config.HYPE_BREADTH))
    return series.states(series.hysteresis(days, "entity_id"), "entity_id").drop("event_day", "promoted", "first_seen")


def gate(states: DataFrame, reach: DataFrame, people: DataFrame, week: str, briefed: DataFrame | None = None, cards: DataFrame | None = None, budget: int = config.BRIEFS_PER_WEEK) -> DataFrame:
    """A decision for each hot entity of the ISO week that begins on ``week``: pass, budget, unmapped, card_pending or recent.

    None is dropped. ``cards`` (entity_id, version, status): an entity passes only if its latest card is ok.
    """
    return gates(states, reach, people, [week], briefed, cards, budget)


def gates(states: DataFrame, reach: DataFrame, people: DataFrame, weeks: list[str], briefed: DataFrame | None = None, cards: DataFrame | None = None, budget: int = config.BRIEFS_PER_WEEK) -> DataFrame:
    """The gate of each of the weeks, told by their Mondays, in one plan."""
    mondays = F.array(*(F.lit(w).cast("date") for w in weeks))
    hot = states.withColumn("week", F.trunc("day", "week")).where(F.array_contains(mondays, F.col("week")) & F.col("state").isin("breakout", "accelerating") & ~F.coalesce("provisional", F.lit(False)))
    peak = hot.groupBy("entity_id", "week").agg(F.max(F.when(F.col("state") == "breakout", 2).otherwise(1)).alias("rank"), F.greatest(F.max("p"), F.lit(0.0)).alias("p_peak"))
    lines = reach.groupBy("category").agg(F.count_distinct("ticker", "revenue_line").alias("lines"), F.bool_or("core").alias("core"))
    rows = peak.join(people.select("entity_id", "category", "first_seen"), "entity_id").join(lines, "category", "left")
    new = decide.novelty(people.select("entity_id", "category", "first_seen", F.explode(mondays).alias("week")), "category", "first_seen", "entity_id", F.col("week"), by=("week",))
    rows = rows.join(new.select("entity_id", "week", "novelty"), ["entity_id", "week"], "left").withColumn("lines", F.coalesce("lines", F.lit(0))).withColumn("N", F.coalesce("novelty", F.lit(0.3)))
    rows = rows.withColumn("peak_state", F.when(F.col("rank") == 2, "breakout").otherwise("accelerating"))
    rows = rows.withColumn("M", decide.momentum(F.col("peak_state"), F.col("p_peak"))).withColumn("R", F.when(F.col("core") | (F.col("lines") >= 3), 1.0).when(F.col("lines") > 0, 0.5).otherwise(0.0))
    rows = rows.withColumn("score", decide.gate_score(F.col("M"), F.col("R"), F.col("N")))
    if briefed is None:
        rows = rows.withColumn("recent", F.lit(False))
    else:
        lately = F.filter(mondays, lambda w: (F.col("published_at") <= w) & (F.datediff(w, "published_at") < config.REBRIEF_DAYS))
        seen = briefed.select("entity_id", F.explode(lately).alias("week")).distinct().withColumn("recent", F.lit(True))
        rows = rows.join(seen, ["entity_id", "week"], "left").withColumn("recent", F.coalesce("recent", F.lit(False)))
    if cards is None:
        rows = rows.withColumn("carded", F.lit(True))
    else:
        latest = cards.groupBy("entity_id").agg((F.max_by("status", "version") == "ok").alias("carded"))
        rows = rows.join(latest, "entity_id", "left").withColumn("carded", F.coalesce("carded", F.lit(False)))
    out = decide.top_under_budget(rows, "score", "entity_id", budget, ["week"], eligible=(F.col("lines") > 0) & ~F.col("recent") & F.col("carded"))
    reason = F.when(F.col("recent"), "recent").when(F.col("lines") == 0, "unmapped").when(~F.col("carded"), "card_pending").otherwise(F.col("decision"))
    return out.select("entity_id", "week", reason.alias("decision"), "score", *(F.round(c, 4).alias(c) for c in ("M", "R", "N", "p_peak")), "peak_state", "category", "lines", "core")


def review(states: DataFrame, as_of: str, survival: int = config.SURVIVAL_DAYS, window: int = config.REACCEL_DAYS) -> DataFrame:
    """Calibration: the share of old breakouts that are still alive and of fades that came back; null without samples."""
    end = F.lit(as_of[:10]).cast("date")
    first = states.where(F.col("day") <= end).groupBy("entity_id").agg(F.min(F.when(F.col("state") == "breakout", F.col("day"))).alias("hot"), F.max_by("state", "day").alias("state"))
    old = first.where(F.col("hot") <= F.date_sub(end, survival)).select((~F.col("state").isin("dormant", "fading")).cast("double").alias("x"))
    order = Window.partitionBy("entity_id").orderBy("day")
    hot = F.min(F.when(F.col("state").isin("breakout", "accelerating"), F.col("day"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = states.withColumns({"was": F.lag("state").over(order), "next_hot": hot})
    fades = seen.where("state = 'fading' AND was <> 'fading'").where(F.col("day") <= F.date_sub(end, window))
    back = fades.select(F.coalesce(F.col("next_hot") <= F.date_add("day", window), F.lit(False)).cast("double").alias("x"))
    one = lambda df, name: df.agg(F.avg("x").alias("value"), F.count("*").alias("sample_n")).select(F.lit(name).alias("metric"), "value", "sample_n")
    return one(old, "breakout_survival").unionByName(one(back, "fade_reaccel"))


def changes(stream: DataFrame, states: DataFrame, promotions: DataFrame, decisions: DataFrame, day: str, before: str) -> DataFrame:
    """(kind, entity_id, text) of a day: new entities, state moves, promotions, and the gate's week."""
    at = F.lit(day).cast("date")
    first = stream.groupBy("entity_id").agg(F.min(F.to_date("occurred_at")).alias("d")).where(F.col("d") == F.date_sub(at, config.NEW_ENTITY_DAYS))
    rank = F.create_map(*(F.lit(x) for pair in {"dormant": 0, "fading": 0, "simmering": 1, "accelerating": 2, "breakout": 3}.items() for x in pair))
    moved = decide.transitions(states, "entity_id", day, before).withColumn("kind", F.when(rank[F.col("now")] > rank[F.col("was")], "state_up").otherwise("state_down"))
    new_rung = promotions.where(F.to_date("promoted_at") == at)
    week = decisions.where(at.between(F.col("week"), F.date_add("week", 6))).agg(F.count_if(F.col("decision") == "pass").alias("passed"), F.count("*").alias("n")).where("n > 0")
    out = first.select(F.lit("new_entity").alias("kind"), "entity_id", F.lit("first evidence a week ago").alias("text"))
    out = out.unionByName(moved.select("kind", "entity_id", F.format_string("%s to %s", "was", "now").alias("text")))
    out = out.unionByName(new_rung.select(F.lit("promotion").alias("kind"), "entity_id", F.concat(F.lit("reached "), "stage").alias("text")))
    return out.unionByName(week.select(F.lit("gate").alias("kind"), F.lit(None).cast("long").alias("entity_id"), F.format_string("%d of %d passed", "passed", "n").alias("text")))
