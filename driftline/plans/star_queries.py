"""Join, ranking, set and graph operators on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import asof, decide, graph
from driftline.operators.components import connected_components
from driftline.plans.registry import query, table


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_targets(spark, folder):
    orders = table(spark, folder, "orders").where("o_orderstatus = 'O'")
    return table(spark, folder, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_targets(spark, folder):
    orders = table(spark, folder, "orders").where("o_totalprice > 300000")
    return table(spark, folder, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NOT NULL)")
def not_in_anti(spark, folder):
    used = table(spark, folder, "lineitem").where("l_quantity > 45 AND l_partkey IS NOT NULL").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)")
def lateral_top1(spark, folder):
    best = asof.latest_by(table(spark, folder, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    return table(spark, folder, "customer").select("c_custkey").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT a.p_partkey, b.p_partkey AS similar_key FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND a.p_size = 7
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_retailprice DESC, b.p_partkey) <= 6""")
def same_category_top6(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    ranked = graph.top_per(part, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 7).select("p_type", F.col("p_partkey").alias("similar_key"), "p_retailprice")
    pairs = part.where("p_size = 7").select("p_partkey", "p_type").join(ranked, "p_type").where("p_partkey <> similar_key")  # seven of a type hold six others
    return graph.top_per(pairs, ["p_partkey"], [F.desc("p_retailprice"), F.col("similar_key")], 6).select("p_partkey", "similar_key")


@query("""WITH s AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.l_suppkey < b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey QUALIFY row_number() OVER (PARTITION BY a.l_suppkey ORDER BY count(*) DESC, b.l_suppkey) <= 3""")
def category_overlap_pairs(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    sold = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    return graph.top_overlaps(sold, "l_suppkey", "p_brand", 3)


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY ALL")
def scd_category_asof(spark, folder):
    return asof.attribute_asof(table(spark, folder, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "1996-01-01 00:00:00").withColumnRenamed("o_orderpriority", "priority")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS loser, c_custkey - c_custkey % 7 AS survivor FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey % 7 = 0 AND c_custkey // 2 > 0),
w AS (SELECT loser AS entity_id, survivor AS cur, 1 AS depth FROM m UNION ALL SELECT w.entity_id, m.survivor, depth + 1 FROM w JOIN m ON w.cur = m.loser) SELECT entity_id, arg_max(cur, depth) AS canonical_id FROM w GROUP BY ALL""")
def canonical_chain(spark, folder):
    key = F.col("c_custkey")
    merges = table(spark, folder, "customer").select(key.alias("loser_id"), F.when(key % 7 != 0, key - key % 7).otherwise(F.floor(key / 2)).cast("long").alias("survivor_id")).where("survivor_id > 0 OR loser_id % 7 <> 0")
    return asof.canonical_ids(merges)


@query()  # recursive SQL would list each node with each of its component; tests hold it against a union-find
def components_of_orders_and_parts(spark, folder):
    edges = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
    return connected_components(edges)


def order_part(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst")).distinct()


HOPS = "WITH e AS (SELECT DISTINCT l_orderkey AS a, -l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h0 AS (SELECT 1 AS n), h1 AS (SELECT DISTINCT b AS n FROM u JOIN h0 ON a = n), h2 AS (SELECT DISTINCT b AS n FROM u JOIN h1 ON a = n), h3 AS (SELECT DISTINCT b AS n FROM u JOIN h2 ON a = n WHERE a % 2 = 0)"


@query(HOPS + " SELECT n AS node, min(hop) AS hop FROM (SELECT n, 0 AS hop FROM h0 UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2) GROUP BY ALL")
def two_hop_neighbourhood(spark, folder):
    return graph.hops(order_part(spark, folder), spark.createDataFrame([(1,)], "node long"), 2)


@query(HOPS + ", x2 AS (SELECT n FROM h2 EXCEPT SELECT n FROM h0), x3 AS (SELECT DISTINCT b AS n FROM u JOIN x2 ON a = n WHERE a % 2 = 0) SELECT n AS node, min(hop) AS hop FROM (SELECT n, 0 AS hop FROM h0 UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM x2 UNION ALL SELECT n, 3 FROM x3) GROUP BY ALL")
def bounded_bfs3(spark, folder):
    edges = order_part(spark, folder)
    passed = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().where("node % 2 = 0 OR node < 0")
    return graph.hops(edges, spark.createDataFrame([(1,)], "node long"), 3, passed)


@query("""WITH s AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS m, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY ALL), c AS (SELECT k, m, n, c_nationkey FROM s JOIN customer ON k = c_custkey)
SELECT k, m, CASE WHEN n < 2 THEN 'ineligible' WHEN row_number() OVER (PARTITION BY c_nationkey, n >= 2 ORDER BY m DESC, k) <= 5 THEN 'pass' ELSE 'budget' END AS decision FROM c""")
def gate_topk_budget(spark, folder):
    totals = table(spark, folder, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("m"), F.count("*").alias("n"))
    rows = totals.join(table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), "k")
    return decide.top_under_budget(rows, "m", "k", 5, ["c_nationkey"], F.col("n") >= 2).select("k", "m", "decision")


@query("""WITH f AS (SELECT o_custkey AS k, o_orderpriority AS category, min(CAST(o_orderdate AS DATE)) AS first_seen FROM orders GROUP BY ALL), y AS (SELECT * FROM f WHERE DATE '1998-01-01' - first_seen < 180)
SELECT k, category, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY first_seen, k) <= 3 THEN 1.0 WHEN count(*) OVER (PARTITION BY category) < 10 THEN 0.6 ELSE 0.3 END::DOUBLE AS novelty FROM y""")
def novelty_rank(spark, folder):
    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("category")).agg(F.min(F.to_date("o_orderdate")).alias("first_seen"))
    return decide.novelty(first, "category", "first_seen", "k", "1998-01-01").select("k", "category", "novelty")


@query("""WITH r AS (SELECT p_type, count(DISTINCT (l_suppkey, l_returnflag)) AS lines, bool_or(l_discount > 0.09) AS core FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_type, lines, core, round((0.4 + 0.6 * least(lines / 300.0, 1)) * 0.7 * (0.5 + 0.5 * 0.8) * (0.4 + 0.6 * 0.3), 6) AS score FROM r""")
def reach_lines(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_discount").join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    out = rows.groupBy("p_type").agg(F.count_distinct("l_suppkey", "l_returnflag").alias("lines"), F.bool_or(F.col("l_discount") > 0.09).alias("core"))
    score = decide.gate_score(decide.momentum(F.lit("accelerating"), F.lit(0.8)), F.least(F.col("lines") / 300.0, F.lit(1.0)), F.lit(0.3))
    return out.withColumn("score", F.round(score, 6))


@query("SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax > 0.07) GROUP BY ALL HAVING count(*) >= 2")
def set_union_slice(spark, folder):
    rows = table(spark, folder, "lineitem")
    pick = lambda c: rows.where(c).select("l_partkey")
    both = pick("l_quantity > 48").union(pick("l_discount > 0.09")).distinct().union(pick("l_tax > 0.07").distinct())
    return both.groupBy("l_partkey").agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT o_orderkey, c_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2 WHERE o_totalprice > 400000")
def left_join_chain(spark, folder):
    orders = table(spark, folder, "orders").where("o_totalprice > 400000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    named = table(spark, folder, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return orders.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(named, "c_nationkey", "left").select("o_orderkey", "c_nationkey", "n_name")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 10 AS version FROM orders")
def append_versions(spark, folder):
    from driftline.sources.ingest import append_versions as append

    drafts = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    stored = drafts.select("o_custkey").distinct().withColumn("version", F.lit(10))
    return append(stored, drafts, "o_custkey", "at").select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_latest(spark, folder):
    from driftline.sources.ingest import upsert

    stored = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return upsert(stored, stored.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) <= 500000 AS within FROM orders")
def budget_ceiling(spark, folder):
    spent = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", (F.round(spent, 2) <= 500000).alias("within"))
