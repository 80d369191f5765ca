"""The momentum plan end to end: raw events, links and merges made from the event table, then each composite with its SQL.

A kind of event stands for one source's event; one event in eleven has another origin, one in thirteen isn't attached,
and every tenth user is merged into its neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import graph
from driftline.operators.components import checkpoint
from driftline.plans import momentum
from driftline.plans.event_queries import LATCH
from driftline.plans.registry import query, table

AS_OF, END, WEEK = "2024-01-28 00:00:00", "2024-01-28", "2024-01-22"
#: kind of event: source, event type, payload field
KINDS = {"view": ("github", "repo_snapshot", "stars"), "click": ("hn", "story", "points"), "purchase": ("hf", "model_snapshot", "downloads"), "signup": ("arxiv", "paper_published", "pages"), "error": ("pypi", "pypi_snapshot", "downloads_7d")}


def stream(spark, folder) -> DataFrame:
    """Attached events of canonical entities, as raw tables would give them."""
    rows = table(spark, folder, "events")
    pick = lambda k: F.coalesce(*(F.when(F.col("event_type") == kind, F.lit(x[k])) for kind, x in KINDS.items()))
    payload = F.format_string('{"%s": %d}', pick(2), F.floor("value"))
    origin = F.when(F.col("event_id") % 11 == 0, "seed").otherwise("live")
    raw = rows.select(F.col("event_id").alias("id"), pick(0).alias("source"), pick(1).alias("event_type"), F.col("ts").alias("occurred_at"), payload.alias("payload"), origin.alias("origin"))
    links = rows.where("event_id % 13 <> 0").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("raw_event_id"), F.lit("attach").alias("rule"))
    early = F.lit("2024-01-05").cast("timestamp_ntz")
    merges = rows.where("user_id % 10 = 9").select(F.col("user_id").alias("loser_id"), (F.col("user_id") - 1).alias("survivor_id"), early.alias("justified_at"), F.lit(True).alias("active")).distinct()
    return momentum.streams(raw, links, merges, AS_OF)


def people(spark, folder, seen: DataFrame) -> DataFrame:
    ids = seen.select(F.col("entity_id").alias("id")).distinct()
    history = ids.select(F.col("id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "agents").otherwise("models").alias("category"), F.lit("2024-01-01").cast("timestamp_ntz").alias("effective_at"), F.lit(1).alias("id"))
    return momentum.facts(seen, ids.withColumn("entity_type", F.lit("project")), history, AS_OF)


RAW = f"""raw AS (SELECT event_id AS id, CASE WHEN user_id % 10 = 9 THEN user_id - 1 ELSE user_id END AS user_id, event_type AS kind, ts, CAST(ts AS DATE) AS day, floor(value) AS value FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_id % 11 <> 0 AND event_id % 13 <> 0)"""
DAYS = "generate_series(CAST({a} AS TIMESTAMP), CAST(least({b}, DATE '" + END + "') AS TIMESTAMP), INTERVAL 1 DAY) g(x)"
SNAPSHOT = f"""{RAW},
dl AS (SELECT user_id, kind, day, arg_max(value, (ts, id)) AS value FROM raw WHERE kind IN ('view', 'purchase', 'error') GROUP BY ALL),
dn AS (SELECT *, lead(day) OVER (PARTITION BY user_id, kind ORDER BY day) AS nxt FROM dl),
snap AS (SELECT user_id, 'gh_stars' AS metric, CAST(g.x AS DATE) AS day, value FROM (SELECT * FROM dn WHERE kind = 'view') n, {DAYS.format(a='n.day', b='n.day + 3, coalesce(n.nxt - 1, n.day + 3)')}
 UNION ALL SELECT user_id, CASE kind WHEN 'purchase' THEN 'hf_downloads_30d' ELSE 'pypi_downloads_7d' END, day, value FROM dl WHERE kind <> 'view'
 UNION ALL SELECT user_id, 'hn_points_7d', CAST(g.x AS DATE), sum(value) FROM (SELECT * FROM raw WHERE kind = 'click') r, {DAYS.format(a='r.day', b='r.day + 6')} GROUP BY ALL HAVING sum(value) > 0
 UNION ALL SELECT user_id, 'evidence_breadth', CAST(g.x AS DATE), count(DISTINCT CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) FROM (SELECT * FROM raw WHERE kind <> 'signup') r, {DAYS.format(a='r.day', b='r.day + 29')} GROUP BY ALL)"""


@query(f"WITH {SNAPSHOT} SELECT user_id AS entity_id, metric, day, CAST(value AS DOUBLE) AS value FROM snap")
def momentum_snapshot(spark, folder):
    return momentum.snapshot(stream(spark, folder), AS_OF)


@query(f"""WITH {SNAPSHOT} SELECT user_id AS entity_id, metric, arg_max(day, day) AS day, CAST(arg_max(value, day) AS DOUBLE) AS value FROM snap GROUP BY user_id, metric""")
def latest_metric_values(spark, folder):
    values = momentum_snapshot(spark, folder)
    return values.groupBy("entity_id", "metric").agg(F.max("day").alias("day"), F.max_by("value", "day").alias("value"))


STAGES = "CASE kind WHEN 'signup' THEN 'idea_paper' WHEN 'view' THEN 'public_code' WHEN 'purchase' THEN 'usable_artifact' WHEN 'error' THEN 'distribution' END"
LADDER = f"promo AS (SELECT user_id, {STAGES} AS stage, min(ts) AS promoted_at, arg_min(id, (ts, id)) AS evidence_event FROM raw WHERE kind <> 'click' GROUP BY ALL)"


@query(f"WITH {RAW}, {LADDER} SELECT user_id AS entity_id, stage, promoted_at, evidence_event FROM promo")
def momentum_ladder(spark, folder):
    return momentum.ladder(stream(spark, folder))


@query(f"WITH {RAW}, {LADDER} SELECT user_id AS entity_id, list(stage ORDER BY promoted_at DESC, stage) AS stages FROM promo GROUP BY ALL")
def promotions_newest_first(spark, folder):
    newest = F.sort_array(F.collect_list(F.struct(-F.unix_micros(F.col("promoted_at").cast("timestamp")), "stage")))
    return momentum_ladder(spark, folder).groupBy("entity_id").agg(F.transform(newest, lambda x: x["stage"]).alias("stages"))


PEOPLE = """pe AS (SELECT user_id, min(day) AS first_seen FROM raw WHERE kind <> 'purchase' GROUP BY ALL),
pk AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'agents' ELSE 'models' END AS category, count(*) OVER () AS nn, count(*) OVER (PARTITION BY user_id % 2) AS n FROM pe),
c AS (SELECT user_id, category, first_seen, CASE WHEN n >= 8 THEN category ELSE 'all' END AS cohort, CASE WHEN n >= 8 THEN n ELSE nn END AS cohort_n, n < 8 AND nn < 8 AS provisional FROM pk)"""
VELOCITY = f"""{SNAPSHOT}, {LADDER}, {PEOPLE},
mv AS (SELECT * FROM snap WHERE metric <> 'evidence_breadth'),
ch AS (SELECT a.user_id, a.metric, a.day, a.value - coalesce(b.value, 0) AS value FROM mv a ASOF LEFT JOIN (SELECT user_id, metric, day + 7 AS day, value FROM mv) b ON a.user_id = b.user_id AND a.metric = b.metric AND a.day >= b.day),
rk AS (SELECT ch.*, CASE WHEN cohort_n > 1 THEN (rank() OVER w - 1 + CASE WHEN value > 0 THEN cohort_n - count(*) OVER (PARTITION BY metric, cohort, day) ELSE 0 END) / (cohort_n - 1) ELSE 0 END AS pc FROM ch JOIN c USING (user_id) WINDOW w AS (PARTITION BY metric, cohort, day ORDER BY value)),
ve AS (SELECT user_id, day, coalesce(max(pc) FILTER (WHERE metric <> 'hn_points_7d'), 0) AS p, count(*) FILTER (WHERE metric <> 'hn_points_7d' AND pc >= 0.6) AS c60, count(*) FILTER (WHERE metric <> 'hn_points_7d' AND pc >= 0.8) AS c80, count(*) FILTER (WHERE metric <> 'hn_points_7d' AND pc >= 0.95) AS c95,
 coalesce(avg(pc) FILTER (WHERE metric = 'hn_points_7d'), 0) AS att, coalesce(avg(pc) FILTER (WHERE metric IN ('hf_downloads_30d', 'pypi_downloads_7d')), 0) AS ado FROM rk GROUP BY ALL)"""


@query(f"WITH {VELOCITY} SELECT user_id AS entity_id, day, round(p, 6) AS p, c60 AS count_60, c80 AS count_80, c95 AS count_95, round(att, 6) AS attention_p, round(ado, 6) AS adoption_p, round(att - ado, 6) AS hype_gap FROM ve")
def momentum_velocity(spark, folder):
    seen = checkpoint(stream(spark, folder))
    out = momentum.velocity(checkpoint(momentum.snapshot(seen, AS_OF)), checkpoint(people(spark, folder, seen)))
    return out.select("entity_id", "day", F.round("p", 6).alias("p"), "count_60", "count_80", "count_95", *(F.round(c, 6).alias(c) for c in ("attention_p", "adoption_p", "hype_gap")))


STATES = f"""{VELOCITY},
gr AS (SELECT c.user_id, provisional, CAST(g.x AS DATE) AS day FROM c, {DAYS.format(a='c.first_seen', b=f"DATE '{END}'")}),
ac AS (SELECT DISTINCT user_id, day AS eday FROM raw), pr AS (SELECT DISTINCT user_id, CAST(promoted_at AS DATE) AS pday FROM promo),
br AS (SELECT user_id, day, value AS breadth FROM snap WHERE metric = 'evidence_breadth'),
s AS (SELECT gr.user_id, gr.day, gr.provisional, coalesce(p, 0) AS p, coalesce(c60, 0) AS c60, coalesce(c80, 0) AS c80, coalesce(c95, 0) AS c95, CASE WHEN ve.user_id IS NULL THEN 0 ELSE coalesce(br.breadth, 0) END AS breadth, max(eday) OVER (PARTITION BY gr.user_id ORDER BY gr.day) AS last_event,
 count(pday) OVER (PARTITION BY gr.user_id ORDER BY gr.day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS promos
 FROM gr LEFT JOIN ve ON ve.user_id = gr.user_id AND ve.day = gr.day LEFT JOIN br ON br.user_id = gr.user_id AND br.day = gr.day LEFT JOIN ac ON ac.user_id = gr.user_id AND eday = gr.day LEFT JOIN pr ON pr.user_id = gr.user_id AND pday = gr.day),
t AS (SELECT *, CASE WHEN last_event IS NULL OR day - last_event >= 14 THEN 0 WHEN promos >= 2 OR (c95 >= 1 AND breadth >= 2) THEN 3 WHEN c80 >= 2 OR (promos >= 1 AND c60 >= 1) THEN 2 WHEN c60 >= 1 THEN 1 ELSE 0 END AS raw_tier FROM s),
{LATCH}"""


def states(spark, folder, seen: DataFrame | None = None) -> DataFrame:
    """Stream, snapshot and people are written once, as several steps read each."""
    seen = checkpoint(stream(spark, folder)) if seen is None else seen
    return momentum.score(seen, checkpoint(momentum.snapshot(seen, AS_OF)), checkpoint(people(spark, folder, seen)), momentum.ladder(seen), AS_OF)


@query(f"WITH {STATES} SELECT user_id AS entity_id, day, state, CAST(tier AS INTEGER) AS smoothed_tier, round(p, 6) AS p FROM st")
def momentum_score(spark, folder):
    return states(spark, folder).select("entity_id", "day", "state", "smoothed_tier", F.round("p", 6).alias("p"))


@query(f"WITH {STATES} SELECT user_id AS entity_id, round(p, 6) AS p, state FROM st WHERE day = DATE '{END}' ORDER BY p DESC, user_id LIMIT 10")
def top_by_momentum(spark, folder):
    now = momentum_score(spark, folder).where(F.col("day") == F.lit(END).cast("date"))
    return now.orderBy(F.desc("p"), "entity_id").limit(10).select("entity_id", "p", "state")


@query(f"WITH {STATES} SELECT user_id AS entity_id, day, state FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 7")
def last_states(spark, folder):
    return graph.top_per(momentum_score(spark, folder).select("entity_id", "day", "state"), ["entity_id"], [F.desc("day")], 7)


GATE = f"""{STATES},
hot AS (SELECT st.user_id, max(CASE WHEN state = 'breakout' THEN 2 ELSE 1 END) AS rk, greatest(max(p), 0) AS pp FROM st JOIN c ON c.user_id = st.user_id WHERE st.day BETWEEN DATE '{WEEK}' AND DATE '{WEEK}' + 6 AND state IN ('breakout', 'accelerating') AND NOT c.provisional GROUP BY ALL),
nv AS (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY first_seen, user_id) <= 3 THEN 1.0 WHEN count(*) OVER (PARTITION BY category) < 10 THEN 0.6 ELSE 0.3 END AS nov FROM c),
gt AS (SELECT hot.user_id, category, rk, CASE rk WHEN 2 THEN 1.0 ELSE 0.7 END * (0.5 + 0.5 * least(pp, 1)) AS m, CASE category WHEN 'agents' THEN 1.0 ELSE 0.0 END AS r, nov FROM hot JOIN c USING (user_id) JOIN nv USING (user_id)),
gs AS (SELECT *, m * (0.4 + 0.6 * r) * (0.4 + 0.6 * nov) AS score FROM gt),
dec AS (SELECT *, CASE WHEN r = 0 THEN 'unmapped' WHEN row_number() OVER (PARTITION BY r > 0 ORDER BY score DESC, user_id) <= 5 THEN 'pass' ELSE 'budget' END AS decision FROM gs)"""


def gated(spark, folder, seen: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    seen = checkpoint(stream(spark, folder)) if seen is None else seen
    who = people(spark, folder, seen)
    reach = spark.createDataFrame([("agents", "AAA", "one", False), ("agents", "AAA", "two", False), ("agents", "BBB", "one", False)], "category string, ticker string, revenue_line string, core boolean")
    scored = states(spark, folder, seen) if scored is None else scored
    return momentum.gate(scored, reach, who, WEEK)


@query(f"WITH {GATE} SELECT user_id AS entity_id, decision, round(score, 6) AS score, category FROM dec")
def momentum_gate(spark, folder):
    return gated(spark, folder).select("entity_id", "decision", F.round("score", 6).alias("score"), "category")


@query(f"""WITH {STATES}, ft AS (SELECT user_id, min(day) FILTER (WHERE state = 'breakout') AS hot, arg_max(state, day) AS state FROM st GROUP BY ALL), wd AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS was FROM st),
fd AS (SELECT user_id, day FROM wd WHERE state = 'fading' AND was <> 'fading' AND day <= DATE '{END}' - 3)
SELECT 'breakout_survival' AS metric, round(avg(CASE WHEN state NOT IN ('dormant', 'fading') THEN 1.0 ELSE 0.0 END), 6) AS value, count(*) AS sample_n FROM ft WHERE hot <= DATE '{END}' - 5
UNION ALL SELECT 'fade_reaccel', round(avg(CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.user_id = fd.user_id AND st.day > fd.day AND st.day <= fd.day + 3 AND st.state IN ('breakout', 'accelerating')) THEN 1.0 ELSE 0.0 END), 6), count(*) FROM fd""")
def momentum_review(spark, folder):
    return momentum.review(checkpoint(states(spark, folder)), AS_OF, 5, 3).withColumn("value", F.round("value", 6))


MOVES = f"""mo AS (SELECT user_id, coalesce(arg_max(state, day) FILTER (WHERE day <= DATE '2024-01-20'), 'dormant') AS was, coalesce(arg_max(state, day) FILTER (WHERE day <= DATE '2024-01-27'), 'dormant') AS now FROM st GROUP BY ALL),
rn AS (SELECT *, CASE was WHEN 'simmering' THEN 1 WHEN 'accelerating' THEN 2 WHEN 'breakout' THEN 3 ELSE 0 END AS a, CASE now WHEN 'simmering' THEN 1 WHEN 'accelerating' THEN 2 WHEN 'breakout' THEN 3 ELSE 0 END AS b FROM mo WHERE was <> now)"""


@query(f"""WITH {GATE}, {MOVES} SELECT 'new_entity' AS kind, user_id AS entity_id, 'first evidence a week ago' AS text FROM raw GROUP BY user_id HAVING min(day) = DATE '2024-01-20'
UNION ALL SELECT CASE WHEN b > a THEN 'state_up' ELSE 'state_down' END, user_id, was || ' to ' || now FROM rn
UNION ALL SELECT 'promotion', user_id, 'reached ' || stage FROM promo WHERE CAST(promoted_at AS DATE) = DATE '2024-01-27'
UNION ALL SELECT 'gate', -1, count(*) FILTER (WHERE decision = 'pass') || ' of ' || count(*) || ' passed' FROM dec HAVING count(*) > 0""")
def momentum_changes(spark, folder):
    seen = checkpoint(stream(spark, folder))
    scored = checkpoint(states(spark, folder, seen))  # read several times
    found = momentum.changes(seen, scored, momentum.ladder(seen), gated(spark, folder, seen, scored), "2024-01-27", "2024-01-20")
    return found.withColumn("entity_id", F.coalesce("entity_id", F.lit(-1)))


@query(f"WITH {RAW} SELECT user_id AS entity_id, id FROM raw QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) <= 40")
def latest_event_ids(spark, folder):
    rows = stream(spark, folder).select("entity_id", "id", "occurred_at")
    return graph.top_per(rows, ["entity_id"], [F.desc("occurred_at"), F.desc("id")], 40).select("entity_id", "id")
