"""The read surface: one function for each view, from tables and an instant to rows; filters are chained before any action."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import similarity, trigrams
from driftline.operators.graph import both_ways, hops, top_per

HEAT = {"breakout": 0, "accelerating": 1, "simmering": 2, "fading": 3, "dormant": 4}


def _latest(states: DataFrame, as_of: str) -> DataFrame:
    seen = states.where(F.col("day") <= F.lit(as_of[:10]).cast("date"))
    return seen.groupBy("entity_id").agg(F.max_by(F.struct("state", "p", "hype"), "day").alias("s")).select("entity_id", "s.*")


def radar(entities: DataFrame, states: DataFrame, stream: DataFrame, cards: DataFrame, decisions: DataFrame, as_of: str, theme: str | None = None, state: str | None = None, source: str | None = None, gated: bool = False, limit: int = 50) -> DataFrame:
    """The hottest entities first: by state, percentile, having a card, age, id.

    entities: (entity_id, name, category, theme, created_at); an unknown theme matches nothing.
    """
    sources = stream.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    card = cards.groupBy("entity_id").agg((F.max_by("status", "version") == "ok").alias("has_card"))
    passed = decisions.where("decision = 'pass'").select("entity_id").distinct().withColumn("gated", F.lit(True))
    rows = entities.join(_latest(states, as_of), "entity_id", "left").join(sources, "entity_id", "left").join(card, "entity_id", "left").join(passed, "entity_id", "left")
    rows = rows.withColumns({"state": F.coalesce("state", F.lit("dormant")), "p": F.coalesce("p", F.lit(0.0)), "has_card": F.coalesce("has_card", F.lit(False)), "gated": F.coalesce("gated", F.lit(False))})
    if theme is not None:
        rows = rows.where(F.col("theme") == theme)
    if state is not None:
        rows = rows.where(F.col("state") == state)
    if source is not None:
        rows = rows.where(F.array_contains("sources", source))
    if gated:
        rows = rows.where("gated")
    heat = F.create_map(*(F.lit(x) for p in HEAT.items() for x in p))[F.col("state")]
    return rows.orderBy(heat, F.desc("p"), F.desc("has_card"), F.desc("created_at"), "entity_id").limit(limit)


def sparklines(values: DataFrame, metric: str, as_of: str, days: int = 30) -> DataFrame:
    """(entity_id, line): a metric's values of the trailing days, in order."""
    end = F.lit(as_of[:10]).cast("date")
    rows = values.where((F.col("metric") == metric) & (F.col("day") > F.date_sub(end, days)) & (F.col("day") <= end))
    return rows.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "value"))), lambda x: x["value"]).alias("line"))


def search(entities: DataFrame, asked: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name holds the text, case-blind, or is near it by trigrams; the nearest first."""
    rows = entities if kind is None else entities.where(F.col("entity_type") == kind)
    near = similarity(trigrams(F.col("name")), trigrams(F.lit(asked)))
    rows = rows.withColumn("similarity", F.coalesce(near, F.lit(0.0))).where(F.contains(F.lower("name"), F.lit(asked.lower())) | (F.col("similarity") >= 0.3))
    return rows.orderBy(F.desc("similarity"), "entity_id").limit(limit)


def neighbourhood(edges: DataFrame, entities: DataFrame, focus: int, rounds: int = 2, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around an entity: the best connected ones, the focus always among them."""
    seed = entities.where(F.col("entity_id") == focus).select(F.col("entity_id").alias("node"))
    seen = hops(edges, seed, rounds)
    inner = edges.join(seen.select(F.col("node").alias("src")), "src", "left_semi").join(seen.select(F.col("node").alias("dst")), "dst", "left_semi")
    degree = both_ways(inner).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    nodes = seen.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.col("hop") != 0, F.desc("degree"), "node").limit(most)
    kept = inner.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes, kept


def fingerprint(edges: DataFrame) -> DataFrame:
    """One row (hash) that changes only when the edges do; equal sets have equal hashes."""
    rows = F.array_sort(F.collect_set(F.struct("src", "dst")))
    return edges.agg(F.sha2(F.to_json(F.struct(rows.alias("edges"))), 256).alias("hash"))


def similar_entities(entities: DataFrame, anchors: DataFrame, k: int = 6) -> DataFrame:
    """Up to k others of each anchor's category: of each category only the first k + 1 can be among them."""
    best = top_per(entities.select("category", F.col("entity_id").alias("other"), F.col("created_at")), ["category"], [F.desc("created_at"), F.desc("other")], k + 1)
    pairs = anchors.select("entity_id").join(entities.select("entity_id", "category"), "entity_id").join(best, "category").where("entity_id <> other")
    return top_per(pairs, ["entity_id"], [F.desc("created_at"), F.desc("other")], k).select("entity_id", "other")


def waves(found: DataFrame, members: DataFrame, leads: DataFrame, outcomes: DataFrame, verdict: str | None = None, min_lead: int | None = None, limit: int = 50) -> DataFrame:
    """Waves by strength with their size, longest lead and verdict; each is aggregated before it is joined."""
    size = members.groupBy("wave_id").agg(F.count("*").alias("n_members"))
    lead = leads.groupBy("wave_id").agg(F.max("lead_days").alias("max_lead"))
    rows = found.join(size, "wave_id", "left").join(lead, "wave_id", "left").join(outcomes.select("wave_id", "verdict"), "wave_id", "left")
    if verdict is not None:
        rows = rows.where(F.col("verdict") == verdict)
    if min_lead is not None:
        rows = rows.where(F.col("max_lead") >= min_lead)
    return rows.orderBy(F.desc("strength"), "wave_id").limit(limit)


def themes(vocabulary: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """(theme, waves) of every theme, zero where there are none."""
    counts = members.join(entities.select("entity_id", "theme"), "entity_id").groupBy("theme").agg(F.count_distinct("wave_id").alias("waves"))
    return vocabulary.join(counts, "theme", "left").withColumn("waves", F.coalesce("waves", F.lit(0))).orderBy("theme")


def gate_week(decisions: DataFrame, week: str) -> DataFrame:
    """A week's decisions, passes first by score, with the number of each outcome."""
    rows = decisions.where(F.col("week") == F.lit(week).cast("date"))
    return rows.withColumn("of_kind", F.count("*").over(Window.partitionBy("decision"))).orderBy(F.col("decision") != "pass", F.desc("score"), "entity_id")
