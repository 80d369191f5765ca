"""Landed source files as event tables: schemas given, nothing inferred, one plan for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text

ARCHIVE = "id string, type string, created_at timestamp, repo struct<id:long,name:string>, actor struct<login:string>, payload struct<ref_type:string>"
RANKINGS = "category string, data array<struct<x:string,ys:map<string,bigint>>>"


def hours(spark: SparkSession, since: str, until: str) -> DataFrame:
    """(stamp) of each hour in [since, until)."""
    span = F.sequence(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"), F.expr("INTERVAL 1 HOUR"))
    return spark.range(1).select(F.explode(span).alias("at")).where(F.col("at") < F.lit(until).cast("timestamp")).select(F.date_format("at", "yyyy-MM-dd-H").alias("stamp"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive records; files that are compressed whole are read by one task each."""
    return spark.read.schema(ARCHIVE).json(path)


def archive_events(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Stars and new repositories of the targets, each named by repository or by owner, as events."""
    name = F.lower(F.col("repo.name"))
    rows = records.withColumn("_name", name).withColumn("_owner", F.substring_index(name, "/", 1))
    wanted = targets.select(F.lower("target").alias("_t")).distinct()
    rows = rows.where((F.col("type") == "WatchEvent") | ((F.col("type") == "CreateEvent") & (F.col("payload.ref_type") == "repository")))
    hit = rows.withColumn("_t", F.explode(F.array("_name", "_owner"))).join(wanted, "_t", "left_semi").dropDuplicates(["id"])
    star = F.col("type") == "WatchEvent"
    return hit.select(
        F.lit("github").alias("source"),
        F.when(star, F.concat_ws(":", F.lit("star"), "_name", "id")).otherwise(F.concat_ws(":", F.lit("repo_discovered"), "repo.id")).alias("source_event_uid"),
        F.when(star, "repo_star").otherwise("repo_discovered").alias("event_type"),
        F.col("created_at").alias("occurred_at"),
        F.lit("backfill").alias("origin"),
        F.to_json(F.when(star, F.struct(F.col("_name").alias("repo"), F.col("actor.login").alias("actor"), F.lit(None).cast("string").alias("full_name"))).otherwise(F.struct(F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("actor"), F.col("_name").alias("full_name")))).alias("payload"),
    )


def ranking_rows(rankings: DataFrame, models: DataFrame) -> DataFrame:
    """(category, day, slug, tokens, name, hugging_face_id): the map of each point unpivoted, without the rest's sum; models by slug, then by its base."""
    rows = rankings.select("category", F.explode("data").alias("p")).select("category", F.to_date("p.x").alias("day"), F.explode("p.ys").alias("slug", "tokens")).where("slug <> 'Others'")
    exact = models.select(F.col("slug").alias("slug"), F.struct("name", "hugging_face_id").alias("m1"))
    base = models.select(F.col("slug").alias("_base"), F.struct("name", "hugging_face_id").alias("m2"))
    rows = rows.withColumn("_base", F.regexp_replace("slug", r"(:[a-z]+|-\d{4}-\d\d-\d\d)$", "")).join(exact, "slug", "left").join(base, "_base", "left")
    return rows.select("category", "day", "slug", "tokens", F.coalesce("m1", "m2")["name"].alias("name"), F.coalesce("m1", "m2")["hugging_face_id"].alias("hugging_face_id"))


def relevant_story(points_at_least: int, hosts: list[str], keywords: list[str]):
    """Whether a story (points, url, title) is kept: points, a captured host or one below it, or a keyword in its title."""
    host = text.host_of(F.col("url"))
    captured = F.lit(False)
    for h in hosts:
        captured = captured | (host == h) | host.endswith(f".{h}")
    said = F.coalesce(F.lower("title").rlike("|".join(keywords)), F.lit(False)) if keywords else F.lit(False)
    return (F.coalesce("points", F.lit(0)) >= points_at_least) | F.coalesce(captured, F.lit(False)) | said


def seed_events(seeds: DataFrame, day: str) -> DataFrame:
    """One event for each anchor of a seed (name, entity_type, category, anchors map)."""
    rows = seeds.select("*", F.explode("anchors").alias("registry", "native_id"))
    return rows.select(
        F.lit("seed").alias("source"),
        F.concat_ws(":", F.lit("seed"), "registry", "native_id").alias("source_event_uid"),
        F.lit("seed_anchor").alias("event_type"),
        F.lit(day).cast("timestamp_ntz").alias("occurred_at"),
        F.lit("seed").alias("origin"),
        F.to_json(F.struct(F.struct("registry", "native_id").alias("anchor"), "anchors", "name", "entity_type", "category")).alias("payload"),
    )
