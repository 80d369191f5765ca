"""Triggers, turns, frontiers, packs and rebuilt tables over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import frontier, packs
from driftline.operators.components import checkpoint, shared_top
from driftline.plans.registry import query, table
from driftline.sources import commits

NOW = "1998-08-01 00:00:00"


def _customers(spark, folder) -> DataFrame:
    """Customers as entities, as old as their first order; some are merged or archived."""
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.min("o_orderdate").alias("created_at"))
    k = F.col("entity_id")
    return orders.withColumn("merged_into", F.when(k % 11 == 0, k - 1)).withColumn("tracking_tier", F.when(k % 13 == 0, "archived").otherwise("active"))


def _states(spark, folder) -> DataFrame:
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "breakout").when(F.col("o_orderpriority") == "2-HIGH", "accelerating").when(F.col("o_orderpriority") == "3-MEDIUM", "simmering").when(F.col("o_orderpriority") == "5-LOW", "fading").otherwise("dormant")
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("day")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("o_orderpriority"))
    return rows.select("entity_id", "day", state.alias("state"))


ALIVE = "cu AS (SELECT o_custkey AS entity_id, min(o_orderdate) AS created_at FROM orders GROUP BY ALL), al AS (SELECT * FROM cu WHERE entity_id % 11 <> 0)"
STATE = "CASE p WHEN '1-URGENT' THEN 'breakout' WHEN '2-HIGH' THEN 'accelerating' WHEN '3-MEDIUM' THEN 'simmering' WHEN '5-LOW' THEN 'fading' ELSE 'dormant' END AS state"


@query(f"""WITH {ALIVE}, br AS (SELECT o_custkey AS e, count(DISTINCT o_orderstatus) AS b FROM orders GROUP BY ALL),
cd AS (SELECT o_custkey AS e, arg_max(o_orderdate, o_orderkey) AS carded FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
st AS (SELECT o_custkey AS e, arg_max(o_orderpriority, (CAST(o_orderdate AS DATE), o_orderkey)) AS p FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-08-01' GROUP BY ALL),
sw AS (SELECT e, {STATE} FROM st), pr AS (SELECT o_custkey AS e, max(o_orderdate) AS promoted FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '{NOW}' GROUP BY ALL)
SELECT entity_id, CASE WHEN carded IS NULL THEN 'new' WHEN promoted > carded THEN 'promoted' ELSE 'stale' END AS trigger FROM al LEFT JOIN br ON br.e = entity_id LEFT JOIN cd ON cd.e = entity_id LEFT JOIN sw ON sw.e = entity_id LEFT JOIN pr ON pr.e = entity_id
WHERE created_at <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ((carded IS NULL AND b >= 2) OR promoted > carded OR (carded < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND state IN ('simmering', 'accelerating', 'breakout')))""")
def cards_due(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "entity_id")
    breadth = orders.groupBy("entity_id").agg(F.count_distinct("o_orderstatus").alias("value")).withColumn("day", F.lit("1998-01-01").cast("date"))
    cards = orders.where("o_orderstatus = 'P'").select("entity_id", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("as_of"))
    promotions = orders.where("o_orderstatus = 'F'").select("entity_id", F.col("o_orderdate").alias("promoted_at"))
    return frontier.cards_due(_customers(spark, folder), breadth, cards, _states(spark, folder), promotions, NOW)


@query(f"""WITH {ALIVE}, st AS (SELECT o_custkey AS e, arg_max(o_orderpriority, (CAST(o_orderdate AS DATE), o_orderkey)) AS p FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-08-01' GROUP BY ALL), sw AS (SELECT e, {STATE} FROM st),
rs AS (SELECT o_custkey AS e, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS os, max(o_orderdate) AS seen FROM orders WHERE o_orderkey % 3 > 0 AND o_orderdate <= TIMESTAMP '{NOW}' GROUP BY ALL),
w AS (SELECT entity_id, coalesce(state, 'dormant') AS state, CASE os WHEN 'P' THEN 'failed' WHEN 'O' THEN 'not_found' WHEN 'F' THEN 'found' END AS last_status, seen FROM al LEFT JOIN sw ON sw.e = entity_id LEFT JOIN rs ON rs.e = entity_id WHERE entity_id % 13 <> 0)
SELECT entity_id, state, last_status, seen AS researched_at FROM w WHERE seen IS NULL OR date_diff('day', CAST(seen AS TIMESTAMP), TIMESTAMP '{NOW}') >= CASE last_status WHEN 'failed' THEN 1 WHEN 'not_found' THEN 7 ELSE CASE state WHEN 'breakout' THEN 1 WHEN 'accelerating' THEN 1 WHEN 'simmering' THEN 3 ELSE 14 END END""")
def research_due(spark, folder):
    status = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "not_found").otherwise("found")
    done = table(spark, folder, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), status.alias("status"), F.col("o_orderdate").alias("researched_at"))
    return frontier.research_due(_customers(spark, folder), _states(spark, folder), done, NOW)


LIMIT = 60


@query(f"""WITH dg AS (SELECT o_custkey AS e, count(*) AS degree FROM orders GROUP BY ALL),
q AS (SELECT 'Q' || c_custkey AS query, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, c_custkey DESC) AS place FROM customer LEFT JOIN dg ON e = c_custkey WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0),
p AS (SELECT CASE WHEN c_custkey % 3 = 1 THEN 'person_login' ELSE 'person_name' END AS kind, CASE WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey ELSE c_name END AS query, row_number() OVER (ORDER BY c_custkey % 3 = 1 DESC, c_custkey DESC) AS place FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 7 <> 0),
h AS (SELECT query, row_number() OVER (ORDER BY query) AS place FROM (SELECT DISTINCT 'h' || s_suppkey % 40 AS query FROM supplier WHERE s_suppkey % 40 >= 20)),
n AS (SELECT least((SELECT count(*) FROM q), 30) AS nq, (SELECT count(*) FROM h) AS nh),
m AS (SELECT nq, least({LIMIT} - nq - least(nh, ({LIMIT} - nq) // 2), (SELECT count(*) FROM p)) AS np, nh FROM n), o AS (SELECT nq, np, least(nh, {LIMIT} - nq - np) AS nh FROM m)
SELECT 'qid' AS kind, query, 'person' AS entity_type, place FROM q, o WHERE place <= nq UNION ALL SELECT kind, query, 'person', place FROM p, o WHERE place <= np UNION ALL SELECT 'org_handle', query, 'org', place FROM h, o WHERE place <= nh""")
def frontier_under_budget(spark, folder):
    customers, suppliers, orders = (table(spark, folder, t) for t in ("customer", "supplier", "orders"))
    k, text = F.col("c_custkey"), "map<string,string>"
    anchors = F.when(k % 3 == 0, F.create_map(F.lit("wikidata"), F.concat(F.lit("Q"), k))).when(k % 3 == 1, F.create_map(F.lit("github"), F.concat(F.lit("user:u"), k))).otherwise(F.create_map(F.lit("person_name"), F.col("c_name")))
    people = customers.select(k.alias("entity_id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("name"), F.lit(None).cast("long").alias("merged_into"), anchors.cast(text).alias("anchors"))
    s = F.col("s_suppkey")
    models = suppliers.select((-s - 1).alias("entity_id"), F.lit("model").alias("entity_type"), F.col("s_name").alias("name"), F.lit(None).cast("long").alias("merged_into"), F.create_map(F.lit("hf"), F.concat(F.lit("h"), s % 40, F.lit("/m"), s)).cast(text).alias("anchors"))
    edges = orders.select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") - 10**9).alias("dst"))
    done = customers.where("c_custkey % 7 = 0").select(k.alias("entity_id"))
    handles = suppliers.where("s_suppkey % 40 < 20").select(F.concat(F.lit("h"), s % 40).alias("handle")).distinct()
    return frontier.to_enrich(people.unionByName(models), edges, done, handles, LIMIT)


CAP = 1500


@query(f"""WITH e AS (SELECT user_id AS k, event_id AS id, event_type AS kind, ts, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, id DESC) AS p, count(*) OVER (PARTITION BY k) AS n FROM e),
tl AS (SELECT k, string_agg('- [event ' || id || '] ' || strftime(ts, '%Y-%m-%d') || ' ' || CASE kind WHEN 'click' THEN 'hn' ELSE 'github' END || '/' || kind || ': ' || 'event ' || kind || CASE kind WHEN 'click' THEN ' (' || CAST(floor(value) AS BIGINT) || ' pts)' ELSE '' END, chr(10) ORDER BY p) AS t, max(n) AS n FROM r WHERE p <= 40 GROUP BY k),
pr AS (SELECT k, string_agg('- ' || strftime(since, '%Y-%m-%d') || ' maturity → ' || kind, chr(10) ORDER BY since DESC) AS t FROM (SELECT k, kind, min(ts) AS since FROM e WHERE kind <> 'click' GROUP BY ALL) GROUP BY k),
mt AS (SELECT k, string_agg('- ' || kind || ': ' || v || ' (as of ' || strftime(d, '%Y-%m-%d') || ')', chr(10) ORDER BY kind) AS t FROM (SELECT k, kind, max(CAST(ts AS DATE)) AS d, CAST(floor(arg_max(value, (ts, id))) AS BIGINT) AS v FROM e GROUP BY ALL) GROUP BY k),
en AS (SELECT k, min(ts) AS born FROM e GROUP BY k)
SELECT k AS entity_id, substring('# Identity' || chr(10) || '- name: user ' || k || chr(10) || '- type: project' || chr(10) || '- rule_category: ' || CASE WHEN k % 2 = 0 THEN 'agents' ELSE 'uncategorized' END || chr(10) || '- owner: unknown' || chr(10) || '- registries: github:u/' || k || ', pypi:p' || k || chr(10) || '- first_seen: ' || strftime(born, '%Y-%m-%d')
 || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || '# Description (README / abstract, truncated)' || chr(10) || 'text of ' || k ELSE '' END || chr(10) || chr(10) || '# Event timeline (most recent first)' || coalesce(chr(10) || pr.t, '') || chr(10) || tl.t
 || CASE WHEN tl.n > 40 THEN chr(10) || '- … ' || (tl.n - 40) || ' earlier events omitted' ELSE '' END || chr(10) || chr(10) || '# Latest metric snapshots' || chr(10) || mt.t, 1, CASE WHEN k % 5 = 0 THEN {CAP} ELSE 48000 END) AS pack FROM en JOIN tl USING (k) LEFT JOIN pr USING (k) JOIN mt USING (k)""")
def evidence_packs(spark, folder):
    rows = table(spark, folder, "events").withColumnRenamed("user_id", "entity_id")
    k = F.col("entity_id")
    text = F.when(k % 3 == 0, F.concat(F.lit(" text of "), k, F.lit(" ")))
    entities = rows.groupBy("entity_id").agg(F.min("ts").alias("created_at")).select("entity_id", F.concat(F.lit("user "), k).alias("name"), F.lit("project").alias("entity_type"), F.when(k % 2 == 0, "agents").alias("category"), F.lit(None).cast("string").alias("owner"), F.create_map(F.lit("pypi"), F.concat(F.lit("p"), k), F.lit("github"), F.concat(F.lit("u/"), k)).alias("anchors"), "created_at", text.alias("text"))
    source = F.when(F.col("event_type") == "click", "hn").otherwise("github")
    events = rows.select("entity_id", F.col("event_id").alias("id"), source.alias("source"), "event_type", F.col("ts").alias("occurred_at"), F.concat(F.lit("event "), "event_type").alias("title"), F.floor("value").alias("points"))
    promotions = rows.where("event_type <> 'click'").groupBy("entity_id", F.col("event_type").alias("stage")).agg(F.min("ts").alias("promoted_at"))
    metrics = rows.groupBy("entity_id", F.col("event_type").alias("metric")).agg(F.floor(F.max_by("value", F.struct("ts", "event_id"))).alias("value"), F.to_date(F.max("ts")).alias("day"))
    lines = packs.evidence_lines(entities, events, promotions, metrics)
    return packs.assembled(lines.where("entity_id % 5 <> 0")).unionByName(packs.assembled(lines.where("entity_id % 5 = 0"), cap=CAP))


WEEKS = ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")


@query("""WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS views, bool_or(event_type = 'signup') AS joined FROM events GROUP BY ALL)
SELECT week, user_id, CASE WHEN joined AND week < DATE '2024-01-15' THEN -1 WHEN week >= DATE '2024-01-15' THEN n ELSE views END AS n FROM w WHERE week >= DATE '2024-01-15' OR views > 0 OR joined""")
def rebuilt_weeks(spark, folder):
    """A first build of all weeks from views only, a rebuild of the later weeks from all events, then an upsert into the earlier ones."""
    rows = table(spark, folder, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    counted = lambda df: df.groupBy("week", "user_id").agg(F.count("*").alias("n"))
    kept = commits.Table(spark, f"{shared_top(spark)}/weeks-{uuid.uuid4().hex}", "week date, user_id long, n long", "week")
    kept.replace(counted(rows.where("event_type = 'view'")), list(WEEKS))
    kept.replace(counted(rows.where("week >= '2024-01-15'")), list(WEEKS[2:]))
    kept.upsert(rows.where("event_type = 'signup' AND week < '2024-01-15'").select("week", "user_id", F.lit(-1).cast("long").alias("n")).distinct(), ["week", "user_id"])
    kept.sweep()
    out = checkpoint(kept.read())
    kept.drop()
    return out
