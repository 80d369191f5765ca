"""The typed, dated graph of who made, cites, depends on and belongs to what; all edge types in set-wise plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators.claims import RULES
from driftline.operators.identity import anchored, get, references

def _edge(kind: str, src, dst):
    return F.lit(kind).alias("edge_type"), src.alias("src_key"), dst.alias("dst_key"), "id", "occurred_at"


def derive(events: DataFrame) -> DataFrame:
    """(src_key, dst_key, edge_type, since, start_date, end_date, evidence, weight): one row for each edge, by anchors.

    Evidence is ordered by (occurred_at, id); ``since`` is the first and the dates are the last one's.
    """
    rows = anchored(events)
    key = F.col("anchor_key")
    people = lambda x: F.concat(F.lit("github_user:"), F.lower(x))
    makers = rows.where("event_type = 'repo_contributors'").withColumn("who", F.explode(F.from_json(get("contributors"), "array<struct<login:string,contributions:long>>")))
    built = makers.where("who.login IS NOT NULL").select(*_edge("built_by", key, people(F.col("who.login"))))
    authors = rows.where("event_type = 'paper_published'").withColumn("who", F.explode(F.from_json(get("authors"), "array<string>")))
    wrote = authors.select(*_edge("authored_by", key, F.concat(F.lit("person_name:"), text.slugify(F.col("who"))))).where("dst_key <> 'person_name:'")
    needs = rows.where("event_type = 'pypi_metadata'").withColumn("need", F.explode(F.from_json(get("requires_dist"), "array<string>")))
    tracked = rows.where("source = 'pypi'").select(F.concat(F.lit("pypi:"), text.normalize_package(F.col("anchor.native_id"))).alias("dst_key")).distinct()
    depends = needs.select(*_edge("depends_on", key, F.concat(F.lit("pypi:"), text.requirement_name(F.col("need"))))).join(tracked, "dst_key", "left_semi")
    tags = rows.where("source = 'hf'").withColumn("tag", F.explode(F.from_json(get("tags"), "array<string>")))
    tuned = tags.select(*_edge("fine_tuned_from", key, F.concat(F.lit("hf:"), text.base_model(F.col("tag"))))).where("dst_key IS NOT NULL")
    cited = references(events).where(F.col("target_key").startswith("arxiv:")).select(F.lit("cited").alias("edge_type"), F.col("anchor_key").alias("src_key"), F.col("target_key").alias("dst_key"), F.lit(None).cast("long").alias("id"), "occurred_at")
    plain = built.unionByName(wrote).unionByName(depends).unionByName(tuned).unionByName(cited).withColumn("dates", F.lit(None).cast("struct<a:date,b:date>"))
    out = plain.unionByName(_claims(rows)).where("src_key <> dst_key")
    order = F.struct("occurred_at", "id")
    return out.groupBy("src_key", "dst_key", "edge_type").agg(
        F.to_date(F.min("occurred_at")).alias("since"),
        F.max_by("dates", order)["a"].alias("start_date"),
        F.max_by("dates", order)["b"].alias("end_date"),
        F.array_sort(F.collect_set("id")).alias("evidence"),
        F.count("*").alias("weight"),
    )


def _claims(rows: DataFrame) -> DataFrame:
    """Edges of claims, by one join with the table of rules; an employment that has ended is formerly_at."""
    spark = rows.sparkSession
    rules = spark.createDataFrame(RULES, "subject string, prop string, edge string, target string, outgoing boolean")
    claims = F.from_json(get("claims"), "map<string,array<struct<qid:string,label:string,start:string,end:string>>>")
    found = rows.where("event_type = 'wikidata_entity'").select("id", "occurred_at", "anchor_key", get("entity_type").alias("subject"), F.explode(claims).alias("prop", "entries")).join(F.broadcast(rules), ["subject", "prop"])
    found = found.withColumn("c", F.explode("entries")).where("c.qid IS NOT NULL")
    other = F.concat(F.lit("wikidata:"), F.col("c.qid"))
    kind = F.when((F.col("prop") == "P108") & F.col("c.end").isNotNull(), "formerly_at").otherwise(F.col("edge"))
    dates = F.when(F.col("prop") == "P108", F.struct(text.claim_date(F.col("c.start")).alias("a"), text.claim_date(F.col("c.end")).alias("b")))
    return found.select(kind.alias("edge_type"), F.when(F.col("outgoing"), F.col("anchor_key")).otherwise(other).alias("src_key"), F.when(F.col("outgoing"), other).otherwise(F.col("anchor_key")).alias("dst_key"), "id", "occurred_at", dates.alias("dates"))
