"""Readers of landed source files: each turns what a source's interface returned into draft events, as one plan.

A draft is (source, source_event_uid, event_type, occurred_at, origin, payload). Fetching is no part of this; files are
read with given schemas. Windows are half-open. Of drafts of one uid the latest is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text

REPOSITORY = "id long, full_name string, description string, fork boolean, stargazers_count long, forks_count long, created_at timestamp, topics array<string>, language string"
SEARCH = f"items array<struct<{', '.join(c.replace(' ', ':', 1) for c in REPOSITORY.split(', '))}>>"
STORIES = "hits array<struct<objectID:string,title:string,url:string,points:long,created_at_i:long,author:string,num_comments:long>>"
MODELS = "id string, author string, createdAt timestamp, downloads long, likes long, pipeline_tag string, tags array<string>"
PACKAGES = "package string, data struct<last_day:long,last_week:long,last_month:long>"
DISCUSSIONS = "id string, children array<struct<text:string>>"
FEED = "id string, published string, title string, summary string, author array<struct<name:string>>, category array<struct<_term:string>>"


def draft(rows: DataFrame, source: str, kind: str, uid: Column, at: Column, payload: Column, origin: str = "live") -> DataFrame:
    """Drafts of rows, one for each uid: the latest, then that of the greatest payload."""
    out = rows.select(uid.alias("source_event_uid"), at.alias("occurred_at"), F.to_json(payload).alias("payload"))
    once = out.where("source_event_uid IS NOT NULL AND occurred_at IS NOT NULL").groupBy("source_event_uid").agg(F.max(F.struct("occurred_at", "payload")).alias("d"))
    return once.select(F.lit(source).alias("source"), "source_event_uid", F.lit(kind).alias("event_type"), "d.occurred_at", F.lit(origin).alias("origin"), "d.payload")


def _within(at: Column, since: str, until: str) -> Column:
    return (at >= F.lit(since).cast("timestamp")) & (at < F.lit(until).cast("timestamp"))


def found_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a repository search as discoveries; forks are left out."""
    rows = spark.read.schema(SEARCH).option("multiLine", True).json(path).select(F.explode("items").alias("r")).where("NOT coalesce(r.fork, false)")
    return draft(rows, "github", "repo_discovered", F.concat(F.lit("repo_discovered:"), F.col("r.id")), F.col("r.created_at"), F.struct("r.*"))


def tracked_repositories(spark: SparkSession, path: str, at: str) -> DataFrame:
    """Polled repositories as a day's snapshots: stars and forks as they are then."""
    when = F.lit(at).cast("timestamp")
    rows = spark.read.schema(REPOSITORY).json(path)
    payload = F.struct("id", "full_name", F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), "description")
    return draft(rows, "github", "repo_snapshot", text.snapshot_uid(F.concat(F.lit("repo:"), F.col("id")), when), when, payload)


def stories(spark: SparkSession, path: str, since: str, until: str, relevant: Column, origin: str = "live") -> DataFrame:
    """Stories of a window that are relevant, by an expression on points, url and title."""
    rows = spark.read.schema(STORIES).option("multiLine", True).json(path).select(F.explode("hits").alias("h")).select("h.*")
    at = F.timestamp_seconds("created_at_i")
    return draft(rows.where(_within(at, since, until) & relevant), "hn", "story", F.col("objectID"), at, F.struct("*"), origin)


def papers(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, origin: str = "live") -> DataFrame:
    """Entries of an Atom feed as papers, by their ids without version; of a window or, for fetches by id, all.

    Only a last "v" and digits are a version, so archives with a v in their name keep it.
    """
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(FEED).load(path)
    version = F.regexp_extract(F.trim("id"), r"(?:.*/abs/)?(.*)$", 1)
    bare = F.nullif(F.regexp_replace(version, r"v\d+$", ""), F.lit(""))
    at = F.trim("published").try_cast("timestamp")
    if since is not None:
        rows = rows.where(_within(at, since, until))
    names, terms = F.transform("author", lambda a: F.trim(a["name"])), F.transform("category", lambda c: c["_term"])
    payload = F.struct(bare.alias("arxiv_id"), version.alias("version_id"), F.trim("title").alias("title"), F.trim("summary").alias("summary"), names.alias("authors"), terms.alias("categories"))
    return draft(rows, "arxiv", "paper_published", bare, at, payload, origin)


def models(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, least_downloads: int = 0, kinds: tuple[str, ...] = (), origin: str = "live", least_likes: int | None = None) -> DataFrame:
    """Listed models by their birth: of a window, or all of an author's; of these kinds, with downloads or, if asked for, likes enough."""
    used = F.coalesce("downloads", F.lit(0)) >= least_downloads
    liked = F.coalesce("likes", F.lit(0)) >= least_likes if least_likes is not None else F.lit(False)
    rows = spark.read.schema(MODELS).json(path).where(used | liked)
    if since is not None:
        rows = rows.where(_within(F.col("createdAt"), since, until))
    if kinds:
        rows = rows.where(F.col("pipeline_tag").isin(*kinds))
    return draft(rows, "hf", "model_discovered", F.concat(F.lit("model_discovered:"), F.col("id")), F.col("createdAt"), F.struct("*"), origin)


def tracked_models(spark: SparkSession, path: str, at: str) -> DataFrame:
    """Polled models as a day's snapshots of downloads and likes."""
    when, rows = F.lit(at).cast("timestamp"), spark.read.schema(MODELS).json(path)
    return draft(rows, "hf", "model_snapshot", text.snapshot_uid(F.concat(F.lit("model:"), F.col("id")), when), when, F.struct("id", "downloads", "likes", "tags"))


def cards(files: DataFrame, at: str, source: str = "hf", kind: str = "model_readme", origin: str = "live") -> DataFrame:
    """Cards and readmes (name, text) without their front matter; backfills date them to their window's start."""
    rows = files.withColumn("text", F.trim(text.strip_frontmatter(F.col("text")))).where("text <> ''")
    return draft(rows, source, kind, F.concat(F.lit(f"{kind}:"), F.col("name")), F.lit(at).cast("timestamp"), F.struct("name", "text"), origin)


def packages(spark: SparkSession, path: str, at: str) -> DataFrame:
    """Polled packages as snapshots of a week's downloads; those without figures are left out."""
    when, rows = F.lit(at).cast("timestamp"), spark.read.schema(PACKAGES).json(path).where("data.last_week IS NOT NULL")
    name = text.normalize_package(F.col("package"))
    return draft(rows, "pypi", "pypi_snapshot", text.snapshot_uid(F.concat(F.lit("pypi:"), name), when), when, F.struct(name.alias("name"), F.col("data.last_week").alias("downloads_7d")))


def discussions(spark: SparkSession, path: str, at: str, most: int = 12, least: int = 40, cap: int = 600) -> DataFrame:
    """The first few comments of some length on each story as one text; stories without any are left out."""
    rows = spark.read.schema(DISCUSSIONS).option("multiLine", True).json(path)
    clean = F.filter(F.transform(F.filter("children", lambda c: c["text"].isNotNull()), lambda c: text.html_to_text(c["text"], cap)), lambda t: F.length(t) >= least)
    rows = rows.withColumn("comments", F.slice(clean, 1, most)).where("size(comments) > 0")
    return draft(rows, "enrich", "hn_discussion", F.concat(F.lit("hn_discussion:"), F.col("id")), F.lit(at).cast("timestamp"), F.struct(F.col("id").alias("story_id"), F.array_join("comments", "\n\n").alias("text")))


def launch_pages(pages: DataFrame, at: str, least: int = 80) -> DataFrame:
    """Pages (name, html) with some text as launch events."""
    rows = pages.withColumn("text", text.html_to_text(F.col("html"))).where(F.length("text") >= least)
    return draft(rows, "enrich", "launch_page", F.concat(F.lit("launch_page:"), text.slugify(F.col("name"))), F.lit(at).cast("timestamp"), F.struct("name", "text"))


def semantic_edges(spark: SparkSession, path: str, ids: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Edges of landed graph records whose confidence is of these classes, with the entities that their labels name, if any."""
    rows = spark.read.schema("src string, dst string, relation string, confidence string, confidence_score double").json(path).where(F.col("confidence").isin(*classes))
    known = ids.groupBy("label").agg(F.min("entity_id").alias("entity_id"))
    for end in ("src", "dst"):
        rows = rows.join(known.select(F.col("label").alias(end), F.col("entity_id").alias(f"{end}_entity_id")), end, "left")
    return rows.where("src_entity_id IS NOT NULL").select("src_entity_id", "dst_entity_id", F.col("src").alias("src_label"), F.col("dst").alias("dst_label"), "relation", "confidence", "confidence_score").distinct()
