"""Order-dependent merging over the event table: a user's events of one kind are an entity, every event refers to another one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import merging
from driftline.plans.registry import query, table

#: Kinds of events in the order of their numbers; signups are papers.
KINDS = ("click", "error", "purchase", "signup", "view")


def parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    """References (a, b, rule, justified_at, event_id) and entities."""
    rows = table(spark, folder, "events").withColumn("kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1)
    users = table(spark, folder, "events").agg((F.max("user_id") + 1).alias("users"))
    rows = rows.crossJoin(F.broadcast(users)).withColumn("a", F.col("user_id") * 5 + F.col("kind"))  # one row
    other = (F.col("user_id") * 3 + F.floor("value")) % F.col("users") * 5 + (F.col("kind") + F.floor("value")) % 5
    rule = F.when(F.col("event_type") == "view", "R1").when(F.col("event_type") == "purchase", "R2").otherwise("R3")
    entities = rows.groupBy(F.col("a").alias("id"), F.when(F.col("event_type") == "signup", "paper").otherwise("project").alias("entity_type")).agg(F.min("ts").alias("created_at"))
    return rows.select("a", other.alias("b"), rule.alias("rule"), F.col("ts").alias("justified_at"), "event_id"), entities


KIND = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1"


@query(f"""WITH RECURSIVE ev AS (SELECT *, {KIND} AS kind, max(user_id) OVER () + 1 AS users FROM events),
en AS (SELECT user_id * 5 + kind AS id, event_type = 'signup' AS paper, min(ts) AS created FROM ev GROUP BY ALL),
n AS (SELECT id, row_number() OVER (ORDER BY paper, created, id) AS r FROM en),
rf AS (SELECT user_id * 5 + kind AS a, (user_id * 3 + CAST(floor(value) AS BIGINT)) % users * 5 + (kind + CAST(floor(value) AS BIGINT)) % 5 AS b, CASE event_type WHEN 'view' THEN 'R1' WHEN 'purchase' THEN 'R2' ELSE 'R3' END AS rule, ts, event_id FROM ev),
e AS (SELECT row_number() OVER (ORDER BY rule, ts, event_id) AS k, na.r AS a, nb.r AS b, rule, ts, event_id FROM rf JOIN n na ON na.id = rf.a JOIN n nb ON nb.id = rf.b WHERE rf.a <> rf.b),
w AS (SELECT CAST(0 AS BIGINT) AS k, list(r ORDER BY r) AS lab, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM n
 UNION ALL SELECT k + 1, CASE WHEN x <> y THEN list_transform(lab, lambda v: CASE WHEN v = greatest(x, y) THEN least(x, y) ELSE v END) ELSE lab END, x, y FROM (SELECT w.k, w.lab, w.lab[e.a] AS x, w.lab[e.b] AS y FROM w JOIN e ON e.k = w.k + 1))
SELECT e.event_id, l.id AS loser_id, s.id AS survivor_id, e.rule, e.ts AS justified_at, CAST(CASE e.rule WHEN 'R1' THEN 0.99 ELSE 0.97 END AS DOUBLE) AS confidence FROM w JOIN e USING (k) JOIN n l ON l.r = greatest(w.x, w.y) JOIN n s ON s.r = least(w.x, w.y) WHERE w.x <> w.y""")
def ordered_merge_audit(spark, folder):
    references, entities = parts(spark, folder)
    merges = merging.ordered_merges(references, entities, ["rule", "justified_at", "event_id"])
    return merges.join(merging.audit(merges).select("position", "confidence"), "position").select("event_id", "loser_id", "survivor_id", "rule", "justified_at", "confidence")
