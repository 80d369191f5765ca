"""Claims made from the trade tables as nested JSON, pruned and turned into dated edges; each query with SQL on the plain tables.

A customer is a person employed by the suppliers that an order's number points to, since the order's date, and until a year later
if the order is finished; a supplier is an organisation, a part a work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import claims
from driftline.operators.components import checkpoint
from driftline.plans.registry import query, table

SEEN = "2024-01-05"


def _item(qid: Column, qualifiers: Column | None = None) -> Column:
    value = F.struct(F.struct(F.struct(qid.alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")
    return F.struct(value, *([qualifiers.alias("qualifiers")] if qualifiers is not None else []))


def _time(at: Column) -> Column:
    return F.struct(F.struct(F.struct(F.date_format(at, "'+'yyyy-MM-dd'T00:00:00Z'").alias("time")).alias("value")).alias("datavalue"))


def _q(letter: str, number: Column | str) -> Column:
    return F.concat(F.lit(letter), F.col(number).cast("string") if isinstance(number, str) else number.cast("string"))


def documents(spark, folder) -> DataFrame:
    """id, subject_key, subject, occurred_at, org_handle and payload of each item."""
    orders, suppliers, parts, customers = (table(spark, folder, t) for t in ("orders", "supplier", "part", "customer"))
    number = suppliers.agg(F.count("*").alias("s"))
    no_value = F.from_json(F.lit('{"datavalue": null}'), "datavalue struct<value: struct<time: string>>")
    ends = F.when(F.col("o_orderstatus") == "F", F.array(no_value, _time(F.add_months("o_orderdate", 12))))
    job = _item(_q("S", F.col("o_orderkey") * 7 % F.col("s")), F.struct(F.array(_time(F.col("o_orderdate"))).alias("P580"), ends.alias("P582")))
    jobs = orders.crossJoin(F.broadcast(number)).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", job.alias("job")))).alias("jobs"))  # number: one row
    school = F.array(_item(_q("N", "c_nationkey")))
    people = customers.join(jobs, customers.c_custkey == jobs.o_custkey, "left").select(
        _q("wikidata:C", "c_custkey").alias("subject_key"), F.lit("person").alias("subject"), F.lit(None).cast("string").alias("org_handle"), F.to_json(F.struct(F.struct(F.transform("jobs", lambda x: x["job"]).alias("P108"), school.alias("P69")).alias("claims"))).alias("payload")
    )
    of = F.struct(F.array(_item(_q("N", "s_nationkey"))).alias("P749"), F.array(_item(_q("C", "s_suppkey")), _item(_q("C", "s_suppkey"))).alias("P112"), F.array(_item(_q("P", "s_suppkey"))).alias("P1056"), F.array(_item(_q("S", F.col("s_suppkey") + 1))).alias("P1951"), F.array(_item(_q("S", "s_suppkey"))).alias("P127"))
    orgs = suppliers.select(_q("wikidata:S", "s_suppkey").alias("subject_key"), F.lit("org").alias("subject"), _q("h", "s_suppkey").alias("org_handle"), F.to_json(F.struct(of.alias("claims"))).alias("payload"))
    url = F.concat(F.lit("https://github.com/"), F.regexp_replace("p_brand", "#", "-"), F.lit("/"), F.regexp_replace("p_name", " ", "-"))
    source = F.array(F.struct(F.struct(F.struct(url.alias("value")).alias("datavalue")).alias("mainsnak")))
    made = F.struct(F.array(_item(_q("S", F.col("p_partkey") % F.col("s")))).alias("P178"), source.alias("P1324"))
    works = parts.crossJoin(F.broadcast(number)).select(_q("wikidata:P", "p_partkey").alias("subject_key"), F.lit("work").alias("subject"), F.lit(None).cast("string").alias("org_handle"), F.to_json(F.struct(made.alias("claims"))).alias("payload"))
    rows = people.unionByName(orgs).unionByName(works)
    return rows.withColumn("id", F.xxhash64("subject_key")).withColumn("occurred_at", F.lit(SEEN).cast("timestamp_ntz"))


def edges(spark, folder) -> DataFrame:
    parts, suppliers = table(spark, folder, "part"), table(spark, folder, "supplier")
    repo = F.concat(F.lit("github:"), F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("/"), F.lower(F.regexp_replace("p_name", " ", "-")))
    tracked = parts.where("p_size > 25").select(repo.alias("anchor_key"))
    models = suppliers.select(F.concat(F.lit("hf:h"), "s_suppkey", F.lit("/model")).alias("anchor_key"))
    found = checkpoint(claims.pruned(claims.statements(documents(spark, folder))).drop("payload"))
    return claims.affiliations(found, tracked, models)


JOBS = """st AS (SELECT 'wikidata:C' || o_custkey AS src_key, 'wikidata:S' || o_orderkey * 7 % (SELECT count(*) FROM supplier) AS dst_key, CASE WHEN o_orderstatus = 'F' THEN 'formerly_at' ELSE 'employed_by' END AS edge_type, o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate + INTERVAL 12 MONTH AS DATE) END AS b FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
jb AS (SELECT src_key, dst_key, edge_type, 'org' AS target_type, arg_min(a, o_orderkey) AS start_date, arg_min(b, o_orderkey) AS end_date FROM st GROUP BY src_key, dst_key, edge_type)"""
REPO = "'github:' || lower(replace(p_brand, '#', '-')) || '/' || lower(replace(p_name, ' ', '-'))"
EDGES = f"""{JOBS},
ed AS (SELECT * FROM jb
 UNION ALL SELECT 'wikidata:C' || c_custkey, 'wikidata:N' || c_nationkey, 'educated_at', 'org', NULL, NULL FROM customer
 UNION ALL SELECT 'wikidata:S' || s_suppkey, 'wikidata:N' || s_nationkey, 'subsidiary_of', 'org', NULL, NULL FROM supplier
 UNION ALL SELECT 'wikidata:C' || s_suppkey, 'wikidata:S' || s_suppkey, 'founded', 'person', NULL, NULL FROM supplier
 UNION ALL SELECT 'wikidata:S' || s_suppkey, 'wikidata:P' || s_suppkey, 'produces', 'work', NULL, NULL FROM supplier
 UNION ALL SELECT 'wikidata:S' || (s_suppkey + 1), 'wikidata:S' || s_suppkey, 'invested_in', 'org', NULL, NULL FROM supplier
 UNION ALL SELECT 'hf:h' || s_suppkey || '/model', 'wikidata:S' || s_suppkey, 'developed_by', 'org', NULL, NULL FROM supplier
 UNION ALL SELECT 'wikidata:P' || p_partkey, 'wikidata:S' || p_partkey % (SELECT count(*) FROM supplier), 'developed_by', 'org', NULL, NULL FROM part
 UNION ALL SELECT 'wikidata:P' || p_partkey, {REPO}, 'source_repo', 'project', NULL, NULL FROM part WHERE {REPO} IN (SELECT {REPO} FROM part WHERE p_size > 25))"""


@query(f"WITH {EDGES} SELECT src_key, dst_key, edge_type, target_type, DATE '{SEEN}' AS since, start_date, end_date FROM ed")
def claim_edges(spark, folder):
    return edges(spark, folder).drop("evidence")


@query(f"""WITH {EDGES}, w AS (SELECT *, CASE WHEN edge_type IN ('employed_by', 'formerly_at') AND end_date > DATE '2024-06-01' THEN 'employed_by' WHEN edge_type IN ('employed_by', 'formerly_at') AND end_date <= DATE '2024-06-01' THEN 'formerly_at' ELSE edge_type END AS kind FROM ed WHERE coalesce(start_date <= DATE '2024-06-01', true))
SELECT kind AS edge_type, count(*) AS n, count(DISTINCT src_key) AS sources, count(DISTINCT dst_key) AS targets FROM w GROUP BY ALL""")
def claim_edges_on_a_day(spark, folder):
    now = claims.standing(edges(spark, folder), "2024-06-01")
    return now.groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src_key").alias("sources"), F.count_distinct("dst_key").alias("targets"))


@query("SELECT DISTINCT q AS qid FROM (SELECT 'S' || o_orderkey * 7 % (SELECT count(*) FROM supplier) AS q FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'N' || c_nationkey FROM customer UNION ALL SELECT unnest(['N' || s_nationkey, 'C' || s_suppkey, 'P' || s_suppkey, 'S' || (s_suppkey + 1), 'S' || s_suppkey]) FROM supplier UNION ALL SELECT 'S' || p_partkey % (SELECT count(*) FROM supplier) FROM part)")
def claim_labels_wanted(spark, folder):
    return claims.wanted_labels(claims.pruned(claims.statements(documents(spark, folder))))


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'So: ' || props || ' {}' WHEN 1 THEN '{"a}": ' || props || ', "b": "\"{"} }' WHEN 2 THEN props || '}' ELSE '{' || props END AS t, props FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"a}": ' || props || ', "b": "\"{"}' WHEN 2 THEN props END AS found FROM t""")
def json_in_replies(spark, folder):
    kind, props = F.col("event_id") % 4, F.col("props")
    reply = F.when(kind == 0, F.concat(F.lit("So: "), props, F.lit(" {}"))).when(kind == 1, F.concat(F.lit('{"a}": '), props, F.lit(', "b": "\\"{"} }'))).when(kind == 2, F.concat(props, F.lit("}"))).otherwise(F.concat(F.lit("{"), props))
    return table(spark, folder, "events").select("event_id", text.first_json_object(reply).alias("found"))
