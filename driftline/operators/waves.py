"""Waves: independent young entities that appear around the same neighbours at the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline import config
from driftline.functions.text import normalize_label
from driftline.operators import decide
from driftline.operators.components import connected_components
from driftline.operators.graph import both_ways


def candidates(entities: DataFrame, as_of: str) -> DataFrame:
    """Entities (entity_id, first_seen, …) first seen within the wave window."""
    age = F.datediff(F.lit(as_of[:10]).cast("date"), "first_seen")
    return entities.where((age >= 0) & (age <= min(config.WAVE_WINDOW, config.WAVE_AGE)))


def neighbourhoods(young: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity_id, kind, key): the neighbours of candidates that aren't candidates, by label and by category.

    labels: (entity_id, name, category) of all entities.
    """
    ids = young.select("entity_id")
    near = both_ways(edges).distinct().join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_anti")
    named = near.join(labels.withColumnRenamed("entity_id", "dst"), "dst")
    by_label = named.select(F.col("src").alias("entity_id"), F.lit("neighbour").alias("kind"), normalize_label(F.col("name")).alias("key"))
    return by_label.unionByName(named.where("category IS NOT NULL").select(F.col("src").alias("entity_id"), F.lit("category").alias("kind"), F.col("category").alias("key"))).distinct()


def clusters(young: DataFrame, near: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, component, reasons): candidates joined by a shared neighbour, a shared category or an edge.

    Candidates and keys form a bipartite graph, so a popular key costs one edge a candidate and no pairs. Keys are
    numbered below zero by their hash; a component is named by its smallest candidate.
    """
    shared = near.withColumn("n", F.count("*").over(Window.partitionBy("kind", "key"))).where("n > 1")
    hub = -F.shiftrightunsigned(F.xxhash64("kind", "key"), 1) - 1
    ids = young.select("entity_id")
    direct = edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select("src", "dst")
    found = connected_components(shared.select(F.col("entity_id").alias("src"), hub.alias("dst")).unionByName(direct)).where("node >= 0")
    named = found.select(F.col("node").alias("entity_id"), F.min("node").over(Window.partitionBy("component")).alias("component"))
    why = shared.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "key"))).alias("reasons"))
    return named.join(why, "entity_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def teams(members: DataFrame, person_edges: DataFrame, owners: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Adds team, pioneer: members of a wave that share a person or an owner, or depend on each other, are one team; its earliest member stands for it.

    members: (wave, entity_id, first_seen); person_edges: (entity_id, person_id); owners: (entity_id, owner);
    dependencies: (src, dst).
    """
    m = members.select("wave", "entity_id")
    hub = lambda kind, c: -F.shiftrightunsigned(F.xxhash64(F.lit(kind), "wave", c), 1) - 1
    by_person = m.join(person_edges, "entity_id").select(F.col("entity_id").alias("src"), hub("p", "person_id").alias("dst"))
    by_owner = m.join(owners.where("owner IS NOT NULL"), "entity_id").select(F.col("entity_id").alias("src"), hub("o", "owner").alias("dst"))
    needs = dependencies.join(m.toDF("wave", "src"), "src").join(m.toDF("other", "dst"), "dst").where("wave = other").select("src", "dst")
    found = connected_components(by_person.unionByName(by_owner).unionByName(needs)).where("node >= 0").select(F.col("node").alias("entity_id"), "component")
    out = members.join(found, "entity_id", "left").withColumn("team", F.coalesce("component", "entity_id")).drop("component")
    first = F.min(F.struct("first_seen", "entity_id")).over(Window.partitionBy("wave", "team"))
    return out.withColumn("pioneer", first["entity_id"] == F.col("entity_id"))


def strength(members: DataFrame) -> DataFrame:
    """(wave, members, strength and its parts) of (wave, entity_id, first_seen, breadth): size times breadth times tightness."""
    agg = members.groupBy("wave").agg(F.count("*").alias("n"), decide.upper_median("breadth").alias("median_breadth"), F.datediff(F.max("first_seen"), F.min("first_seen")).alias("span"))
    size = F.least(F.lit(1.0), 0.6 + 0.05 * F.greatest(F.lit(0), F.col("n") - config.WAVE_MEMBERS) * 2)
    wide = F.least(F.lit(1.0), 0.4 + 0.3 * F.col("median_breadth"))
    tight = F.greatest(F.lit(0.3), 1.0 - F.greatest(F.lit(1), F.col("span")) / config.WAVE_WINDOW * 0.7)
    return agg.select("wave", F.col("n").alias("members"), F.round(size, 4).alias("size"), F.round(wide, 4).alias("breadth"), F.round(tight, 4).alias("tightness"), F.round(size * wide * tight, 4).alias("strength"))


def detect(entities: DataFrame, edges: DataFrame, labels: DataFrame, breadth: DataFrame, person_edges: DataFrame, owners: DataFrame, dependencies: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(waves, members): clusters with enough independent teams, and their strength over the pioneers."""
    young = candidates(entities, as_of)
    found = clusters(young, neighbourhoods(young, edges, labels), edges).withColumnRenamed("component", "wave").join(young.select("entity_id", "first_seen"), "entity_id")
    members = teams(found, person_edges, owners, dependencies).join(breadth, "entity_id", "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    waves = strength(members.where("pioneer")).where(F.col("members") >= config.WAVE_MEMBERS)
    return waves, members.join(waves.select("wave"), "wave", "left_semi")


def match(new: DataFrame, old: DataFrame, least: float = config.CONTINUITY) -> DataFrame:
    """(cluster, wave_id): the old wave with the largest overlap, of at least so much of its members; ties to the lower id.

    new: (cluster, entity_id); old: (wave_id, entity_id).
    """
    size = old.groupBy("wave_id").agg(F.count("*").alias("n"))
    overlap = new.join(old, "entity_id").groupBy("cluster", "wave_id").agg(F.count("*").alias("k")).join(size, "wave_id").withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= least)
    return overlap.groupBy("cluster").agg(F.max_by("wave_id", F.struct("share", -F.col("wave_id"))).alias("wave_id"))


def persist(new: DataFrame, old: DataFrame, day: str) -> DataFrame:
    """Members (wave_id, entity_id, joined_at) after a run: kept ones stay, new ones are appended, none goes.

    Clusters are matched against the old waves alone; unmatched ones get ids above the old ones, in order.
    """
    matched = new.select("cluster").distinct().join(match(new, old.select("wave_id", "entity_id")), "cluster", "left")
    top = F.coalesce(F.lit(old.agg(F.max("wave_id")).first()[0]), F.lit(0))
    fresh = matched.where("wave_id IS NULL").withColumn("wave_id", top + F.row_number().over(Window.orderBy("cluster")))
    ids = matched.where("wave_id IS NOT NULL").unionByName(fresh)
    rows = new.join(ids, "cluster").select("wave_id", "entity_id").distinct()
    return old.unionByName(rows.join(old, ["wave_id", "entity_id"], "left_anti").withColumn("joined_at", F.lit(day).cast("date")))


def observers(members: DataFrame, found: DataFrame, per_member: int = 3) -> DataFrame:
    """(wave_id, raw_event_id, entity_id, lead_days): the earliest mentions of each member before its wave, each event once.

    members: (wave_id, entity_id, detected); found: (entity_id, raw_event_id, occurred_at) of mentions.
    """
    rows = found.join(members, "entity_id").where(F.to_date("occurred_at") <= F.col("detected"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("wave_id", "entity_id").orderBy("occurred_at", "raw_event_id"))).where(F.col("r") <= per_member)
    return rows.groupBy("wave_id", "raw_event_id").agg(F.min("entity_id").alias("entity_id"), F.max(F.datediff("detected", F.to_date("occurred_at"))).alias("lead_days"))


def outcomes(members: DataFrame, series: DataFrame, peers: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """(wave_id, growth, percentile, verdict): the median growth of a wave and its strict rank among its peers' growths.

    members: (wave_id, entity_id); series: (entity_id, day, value); peers: (wave_id, entity_id). A horizon that isn't
    reached, or a wave without growth or peers, is unmeasurable.
    """
    growth = decide.growth(series, "entity_id", start, end)
    own = members.join(growth, "entity_id").groupBy("wave_id").agg(F.median("growth").alias("growth"))
    rank = peers.join(growth.withColumnRenamed("growth", "g"), "entity_id").join(own, "wave_id").groupBy("wave_id").agg(F.avg((F.col("g") < F.col("growth")).cast("double")).alias("percentile"))
    out = members.select("wave_id").distinct().join(own, "wave_id", "left").join(rank, "wave_id", "left")
    reached = F.lit(end).cast("date") <= F.lit(as_of[:10]).cast("date")
    return out.withColumn("percentile", F.when(reached, F.col("percentile"))).withColumn("verdict", decide.verdict(F.col("percentile"), F.col("growth")))
