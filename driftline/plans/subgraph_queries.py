"""Sub-graphs of every part: parts come from suppliers, customers work for suppliers; each query with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import subgraph
from driftline.plans.registry import query, table

MOST = 25


def graph(spark, folder, changed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges (src, edge_type, dst), nodes (node, name, type) and focus (focus); ``changed``: without the edges that are new."""
    parts, suppliers, customers = (table(spark, folder, t) for t in ("part", "supplier", "customer"))
    n = suppliers.agg(F.count("*").alias("n"))
    one = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    made = parts.crossJoin(F.broadcast(n)).select(one("P", F.col("p_partkey")).alias("src"), F.lit("developed_by").alias("edge_type"), one("S", F.col("p_partkey") % F.col("n")).alias("dst"))
    staff = customers.crossJoin(F.broadcast(n))  # n: one row
    works = staff.select(one("C", F.col("c_custkey")).alias("src"), F.lit("employed_by").alias("edge_type"), one("S", F.col("c_custkey") * 7 % F.col("n")).alias("dst"))
    was = staff.where("c_custkey % 3 = 0").select(one("C", F.col("c_custkey")).alias("src"), F.lit("formerly_at").alias("edge_type"), one("S", F.col("c_custkey") * 11 % F.col("n")).alias("dst"))
    if changed:
        was = was.where("src <> 'C9'")
    nodes = parts.select(one("P", F.col("p_partkey")).alias("node"), F.col("p_name").alias("name"), F.lit("project").alias("type"))
    nodes = nodes.unionByName(suppliers.select(one("S", F.col("s_suppkey")).alias("node"), F.col("s_name").alias("name"), F.lit("org").alias("type")))
    nodes = nodes.unionByName(customers.select(one("C", F.col("c_custkey")).alias("node"), F.col("c_name").alias("name"), F.lit("person").alias("type")))
    return made.unionByName(works).unionByName(was), nodes, nodes.where("type = 'project'").select(F.col("node").alias("focus"))


def found(spark, folder) -> tuple[DataFrame, DataFrame]:
    edges, nodes, focus = graph(spark, folder)
    return subgraph.subgraphs(edges, nodes, focus, MOST)


def marks(spark, folder, changed: bool = False) -> DataFrame:
    edges, nodes, focus = graph(spark, folder, changed)
    return subgraph.shared_fingerprints(subgraph.shared(edges, nodes, focus, MOST), nodes)


SUPPLIERS = "(SELECT count(*) FROM supplier)"
GROWN = f"""ed AS (SELECT 'P' || p_partkey AS src, 'developed_by' AS edge_type, 'S' || p_partkey % {SUPPLIERS} AS dst FROM part UNION ALL SELECT 'C' || c_custkey, 'employed_by', 'S' || c_custkey * 7 % {SUPPLIERS} FROM customer UNION ALL SELECT 'C' || c_custkey, 'formerly_at', 'S' || c_custkey * 11 % {SUPPLIERS} FROM customer WHERE c_custkey % 3 = 0),
nb AS (SELECT src AS node, dst AS other FROM ed UNION SELECT dst, src FROM ed),
f0 AS (SELECT DISTINCT 'P' || p_partkey AS focus, 'P' || p_partkey AS node FROM part),
f1 AS (SELECT DISTINCT focus, other AS node FROM f0 JOIN nb USING (node)),
f2 AS (SELECT DISTINCT focus, other AS node FROM f1 JOIN nb USING (node) WHERE node[1] IN ('C', 'S')),
s2 AS (SELECT * FROM f0 UNION SELECT * FROM f1 UNION SELECT * FROM f2),
f3 AS (SELECT DISTINCT focus, other AS node FROM (SELECT * FROM f2 EXCEPT (SELECT * FROM f0 UNION SELECT * FROM f1)) JOIN nb USING (node) WHERE node[1] = 'C'),
rc AS (SELECT * FROM s2 UNION SELECT * FROM f3),
ie AS (SELECT DISTINCT a.focus, src, edge_type, dst FROM ed JOIN rc a ON a.node = src JOIN rc b ON b.node = dst AND a.focus = b.focus),
dg AS (SELECT focus, node, count(*) AS degree FROM (SELECT focus, src AS node FROM ie UNION ALL SELECT focus, dst FROM ie) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY degree DESC, node) AS r, count(*) OVER (PARTITION BY focus) AS n FROM dg),
kn AS (SELECT focus, node, degree, CASE WHEN n > {MOST} THEN n ELSE 0 END AS truncated_from FROM rk WHERE r <= {MOST} OR focus = node),
ke AS (SELECT ie.* FROM ie JOIN kn a ON a.focus = ie.focus AND a.node = src JOIN kn b ON b.focus = ie.focus AND b.node = dst)"""


@query(f"WITH {GROWN} SELECT * FROM kn")
def subgraph_nodes(spark, folder):
    return found(spark, folder)[0]


@query(f"WITH {GROWN} SELECT * FROM ke")
def subgraph_edges(spark, folder):
    return found(spark, folder)[1]


NAMED = """nm AS (SELECT 'P' || p_partkey AS node, p_name AS name, 'project' AS type FROM part UNION ALL SELECT 'S' || s_suppkey, s_name, 'org' FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name, 'person' FROM customer),
it AS (SELECT focus, sha256('["' || name || '","' || type || '"]') AS h FROM kn JOIN nm USING (node) UNION ALL SELECT focus, sha256('["' || a.name || '","' || edge_type || '","' || b.name || '"]') FROM ke JOIN nm a ON a.node = src JOIN nm b ON b.node = dst)"""
LANE = "sum(CAST('0x' || substr(h, {k}, 15) AS HUGEINT))"


@query(f"WITH {GROWN}, {NAMED} SELECT focus, sha256(concat_ws(',', count(*), {', '.join(LANE.format(k=1 + 15 * k) for k in range(4))})) AS digest FROM it GROUP BY focus")
def subgraph_digests(spark, folder):
    return marks(spark, folder)


OLD = GROWN.replace("WHERE c_custkey % 3 = 0)", "WHERE c_custkey % 3 = 0 AND c_custkey <> 9)")


@query(f"""WITH a AS (WITH {GROWN}, {NAMED} SELECT focus, list(h ORDER BY h) AS l FROM it GROUP BY focus), b AS (WITH {OLD}, {NAMED} SELECT focus, list(h ORDER BY h) AS l FROM it GROUP BY focus)
SELECT 'P' || p_partkey AS focus, CASE WHEN a.l IS NULL THEN 'empty' WHEN a.l = b.l THEN 'unchanged' ELSE 'renew' END AS decision FROM part LEFT JOIN a ON a.focus = 'P' || p_partkey LEFT JOIN b ON b.focus = 'P' || p_partkey""")
def subgraphs_to_renew(spark, folder):
    """One edge is new: only the sub-graphs that show it, or whose cut it changes, are to be renewed."""
    now, before = (marks(spark, folder, changed) for changed in (False, True))
    return subgraph.to_renew(graph(spark, folder)[2], now, before).drop("digest")
