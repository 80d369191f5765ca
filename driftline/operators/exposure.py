"""The exposure map: which revenue lines of which companies a category touches, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOC = "struct<ticker:string,name:string,sector:string,revenue_lines:array<struct<id:string,name:string,share_of_revenue:double,threat_surface:array<struct<category:string,relation:string,core:boolean>>>>>"
SHARE_LIMIT = 1.05


def lines(companies: DataFrame) -> DataFrame:
    """(ticker, line_id, line_name, share_of_revenue, surface) of each company document ``doc``."""
    out = companies.select("doc.ticker", F.explode("doc.revenue_lines").alias("l"))
    return out.select("ticker", F.col("l.id").alias("line_id"), F.col("l.name").alias("line_name"), F.col("l.share_of_revenue").alias("share_of_revenue"), F.col("l.threat_surface").alias("surface"))


def reach_links(companies: DataFrame) -> DataFrame:
    """(category, ticker, revenue_line, relation, core): one row for each, core if any says so."""
    rows = lines(companies).select("ticker", F.col("line_id").alias("revenue_line"), F.explode("surface").alias("s"))
    return rows.groupBy(F.col("s.category").alias("category"), "ticker", "revenue_line", F.col("s.relation").alias("relation")).agg(F.bool_or(F.coalesce("s.core", F.lit(False))).alias("core"))


def problems(companies: DataFrame, categories: list[str], relations: list[str]) -> DataFrame:
    """(ticker, problem) of documents that don't hold: shares over the limit, repeated line ids, unknown words."""
    rows = lines(companies)
    per = rows.groupBy("ticker").agg(F.sum("share_of_revenue").alias("share"), F.count("*").alias("n"), F.count_distinct("line_id").alias("ids"))
    links = reach_links(companies)
    found = [
        per.where(F.col("share") > SHARE_LIMIT).select("ticker", F.lit("shares").alias("problem")),
        per.where("ids < n").select("ticker", F.lit("line ids").alias("problem")),
        links.where(~F.col("category").isin(*categories)).select("ticker", F.lit("category").alias("problem")).distinct(),
        links.where(~F.col("relation").isin(*relations)).select("ticker", F.lit("relation").alias("problem")).distinct(),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def category_reach(companies: DataFrame, mechanisms: dict[str, list[str]]) -> DataFrame:
    """(category, n_lines, core, lines, allowed): what each category touches, and the mechanisms that its relations allow."""
    links = reach_links(companies).join(lines(companies).select("ticker", F.col("line_id").alias("revenue_line"), "line_name", "share_of_revenue"), ["ticker", "revenue_line"])
    legal = F.create_map(*(x for r, m in mechanisms.items() for x in (F.lit(r), F.array(*map(F.lit, m)))))
    return links.groupBy("category").agg(
        F.count_distinct("ticker", "revenue_line").alias("n_lines"),
        F.bool_or("core").alias("core"),
        F.array_sort(F.collect_set(F.struct("ticker", "revenue_line", "line_name", "share_of_revenue"))).alias("lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(legal[F.col("relation")], F.array().cast("array<string>")))))).alias("allowed"),
    )


def brief_problems(briefs: DataFrame, reach: DataFrame, least_words: int = 4) -> DataFrame:
    """Adds problem: the first rule that a brief (category, ticker, revenue_line, mechanism, counter_mechanism) breaks, or null."""
    out = briefs.join(reach.select("category", "lines", "allowed"), "category", "left")
    known = F.coalesce(F.exists("lines", lambda x: (x["ticker"] == F.col("ticker")) & (x["revenue_line"] == F.col("revenue_line"))), F.lit(False))
    words = F.size(F.filter(F.split(F.coalesce("counter_mechanism", F.lit("")), r"\s+"), lambda w: w != ""))
    problem = F.when(~known, "line not in map").when(~F.coalesce(F.array_contains("allowed", F.col("mechanism")), F.lit(False)), "mechanism").when(words < least_words, "counter-argument")
    return out.withColumn("problem", problem).drop("lines", "allowed")
