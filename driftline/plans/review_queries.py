"""Rankings, spending, cadence and set checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import asof, graph
from driftline.plans.registry import query, table


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10)")
def recent_history(spark, folder):
    """The newest ten of each user, oldest first."""
    last = graph.top_per(table(spark, folder, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)
    return last.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM events)
SELECT user_id, event_id FROM r WHERE f = 1 OR l <= 6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10""")
def first_of_kind_and_last(spark, folder):
    """The first event of each kind and the last six of each user, at most ten."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts").withColumn("f", first).withColumn("l", last).where("f = 1 OR l <= 6")
    return graph.top_per(rows, ["user_id"], [F.col("ts"), F.col("event_id")], 10).select("user_id", "event_id")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate <= TIMESTAMP '1997-06-20' GROUP BY ALL")
def month_spend(spark, folder):
    """Month-to-date sums as of an instant; the month's start is computed from it."""
    as_of = asof.instant("1997-06-20 00:00:00")
    rows = table(spark, folder, "orders").where((F.col("o_orderdate") >= F.date_trunc("month", as_of).cast("timestamp_ntz")) & (F.col("o_orderdate") <= as_of))
    return rows.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("""WITH l AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS seen, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY ALL)
SELECT k, DATE '1998-08-01' - seen AS age, DATE '1998-08-01' - seen >= CASE status WHEN 'O' THEN 7 WHEN 'P' THEN 30 ELSE 90 END AS due FROM l""")
def due_by_cadence(spark, folder):
    """Whether a key is due again, by an interval that depends on its latest status."""
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.max("o_orderdate")).alias("seen"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    age = F.datediff(F.lit("1998-08-01").cast("date"), "seen")
    wait = F.when(F.col("status") == "O", 7).when(F.col("status") == "P", 30).otherwise(90)
    return rows.select("k", age.alias("age"), (age >= wait).alias("due"))


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON split_part(p_brand, '#', 2) = CAST(s_suppkey % 60 AS VARCHAR) WHERE p_size = 3")
def prefix_join(spark, folder):
    """An equality on a part of a name, in place of a LIKE join."""
    part = table(spark, folder, "part").where("p_size = 3").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("h"))
    return part.join(table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") % 60).cast("string").alias("h")), "h").select("p_partkey", "s_suppkey")


@query("""WITH s AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY ALL)
SELECT user_id, len(list_filter(['click', 'view'], lambda x: NOT list_contains(kinds, x))) = 0 AS superset, len(list_intersect(kinds, ['error', 'signup'])) > 0 AS overlaps FROM s""")
def set_checks(spark, folder):
    """Superset and overlap of a key's set with wanted ones."""
    rows = table(spark, folder, "events").where("ts < TIMESTAMP_NTZ '2024-01-03'").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    wanted = lambda *x: F.array(*map(F.lit, x))
    return rows.select("user_id", (F.size(F.array_except(wanted("click", "view"), "kinds")) == 0).alias("superset"), F.arrays_overlap("kinds", wanted("error", "signup")).alias("overlaps"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE date_trunc('week', o_orderdate) = (SELECT max(date_trunc('week', o_orderdate)) FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def best_of_latest_week(spark, folder):
    """The best rows of the last week that has any."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.date_trunc("week", "o_orderdate").alias("week"))
    return rows.join(rows.agg(F.max("week").alias("week")), "week", "left_semi").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query("""WITH b AS (SELECT o_custkey AS k, max(o_orderdate) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), c AS (SELECT o_custkey AS k, max(o_orderdate) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT k, b.a IS NULL OR c.b > b.a AS stale FROM c LEFT JOIN b USING (k)""")
def staleness(spark, folder):
    """Whether what a summary was made from is newer than it: two aggregates in one, null-safe."""
    at = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(at("F").alias("a"), at("O").alias("b")).where("b IS NOT NULL")
    return rows.select("k", (F.col("a").isNull() | (F.col("b") > F.col("a"))).alias("stale"))


@query("""WITH g AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY ALL) SELECT n_name, n FROM g""")
def gap_counts(spark, folder):
    """Gaps by category."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, folder, "customer").where("c_acctbal < 0").join(nation, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))
