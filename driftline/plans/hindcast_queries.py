"""Replays of a window of the event table in one plan, each with its SQL.

Events come as in the momentum queries, but every fifth user falls silent early (half of these come back), every fifth is only
talked of and ranked (so has no rung of the ladder), merges of two links are justified on many days of the window, and some categories change within it.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import asof
from driftline.operators.components import checkpoint
from driftline.plans import hindcast, momentum
from driftline.plans.composite_queries import END, KINDS, RAW, STATES
from driftline.plans.registry import query, table

#: Twenty runs, each at the end of its day.
DAYS = [str(datetime.date(2024, 1, 9) + datetime.timedelta(d)) for d in range(20)]

RANKED = ("openrouter", "or_rankings", "tokens")


def raw(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """events, links, merges, entities and category history."""
    rows = table(spark, folder, "events")
    user = F.col("user_id")
    early, late = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-04", "2024-01-25"))
    heard = rows.where((user % 5 != 1) | (F.col("ts") <= early) | ((user % 10 == 1) & (F.col("ts") >= late))).where((user % 5 != 2) | F.col("event_type").isin("click", "purchase"))
    ranked = (user % 5 == 2) & (F.col("event_type") == "purchase")
    pick = lambda k: F.coalesce(F.when(ranked, F.lit(RANKED[k])), *(F.when(F.col("event_type") == kind, F.lit(x[k])) for kind, x in KINDS.items()))
    payload = F.format_string('{"%s": %d}', pick(2), F.floor("value"))
    origin = F.when(F.col("event_id") % 11 == 0, "seed").otherwise("live")
    events = heard.select(F.col("event_id").alias("id"), pick(0).alias("source"), pick(1).alias("event_type"), F.col("ts").alias("occurred_at"), payload.alias("payload"), origin.alias("origin"))
    links = rows.where("event_id % 13 <> 0").select(user.alias("entity_id"), F.col("event_id").alias("raw_event_id"), F.lit("attach").alias("rule"))
    start = F.when(user % 10 == 9, F.date_add(F.lit("2024-01-05").cast("date"), (user % 17).cast("int"))).otherwise(F.date_add(F.lit("2024-01-12").cast("date"), (user % 7).cast("int")))
    merges = rows.where("user_id % 10 >= 8").select(user.alias("loser_id"), (user - 1).alias("survivor_id"), start.cast("timestamp_ntz").alias("justified_at"), F.lit(True).alias("active")).distinct()
    ids = rows.select(user.alias("id")).distinct()
    known = ids.select(F.col("id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "agents").otherwise("models").alias("category"), F.lit("2024-01-01").cast("timestamp_ntz").alias("effective_at"), F.lit(1).alias("id"))
    moved = ids.where("id % 4 = 1").select(F.col("id").alias("entity_id"), F.lit("agents").alias("category"), F.lit("2024-01-15").cast("timestamp_ntz").alias("effective_at"), F.lit(2).alias("id"))
    return events, links, merges, ids.withColumn("entity_type", F.lit("project")), known.unionByName(moved)


def reach(spark) -> DataFrame:
    return spark.createDataFrame([("agents", "AAA", "one", False), ("agents", "BBB", "one", False)], "category string, ticker string, revenue_line string, core boolean")


#: One SQL user stands for an entity in a run: a million for each day of the run since 2024-01-01, and the entity.
RUN = "CAST(user_id // 1000000 AS INTEGER)"
CANONICAL = "CASE WHEN u % 10 = 9 AND d >= DATE '2024-01-05' + CAST(u % 17 AS INTEGER) THEN CASE WHEN d >= DATE '2024-01-12' + CAST((u - 1) % 7 AS INTEGER) THEN u - 2 ELSE u - 1 END WHEN u % 10 = 8 AND d >= DATE '2024-01-12' + CAST(u % 7 AS INTEGER) THEN u - 1 ELSE u END"
RUNS = f"""raw AS (SELECT event_id AS id, (d - DATE '2024-01-01') * 1000000 + {CANONICAL} AS user_id, kind, ts, CAST(ts AS DATE) AS day, value FROM
 (SELECT event_id, user_id AS u, CASE WHEN user_id % 5 = 2 AND event_type = 'purchase' THEN 'rank' ELSE event_type END AS kind, ts, floor(value) AS value, CAST(g.d AS DATE) AS d FROM events, generate_series(TIMESTAMP '{DAYS[0]}', TIMESTAMP '{DAYS[-1]}', INTERVAL 1 DAY) g(d) WHERE CAST(ts AS DATE) <= CAST(g.d AS DATE) AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND (user_id % 5 <> 1 OR ts <= TIMESTAMP '2024-01-04' OR (user_id % 10 = 1 AND ts >= TIMESTAMP '2024-01-25')) AND (user_id % 5 <> 2 OR event_type IN ('click', 'purchase'))))"""
REPLAY = (
    STATES.replace(RAW, RUNS)
    .replace("kind IN ('view', 'purchase', 'error')", "kind IN ('view', 'purchase', 'error', 'rank')")
    .replace("CASE kind WHEN 'purchase' THEN 'hf_downloads_30d' ELSE", "CASE kind WHEN 'purchase' THEN 'hf_downloads_30d' WHEN 'rank' THEN 'or_tokens_wk' ELSE")
    .replace("FROM raw WHERE kind <> 'click' GROUP BY ALL", "FROM raw WHERE kind NOT IN ('click', 'rank') GROUP BY ALL")
    .replace("metric IN ('hf_downloads_30d', 'pypi_downloads_7d')", "metric IN ('hf_downloads_30d', 'pypi_downloads_7d', 'or_tokens_wk')")
    .replace("count(*) OVER () AS nn, count(*) OVER (PARTITION BY user_id % 2) AS n FROM pe", f"count(*) OVER (PARTITION BY {RUN}) AS nn, count(*) OVER (PARTITION BY {RUN}, user_id % 2 = 0 OR (user_id % 4 = 1 AND {RUN} >= 14)) AS n FROM pe")
    .replace("CASE WHEN user_id % 2 = 0 THEN 'agents' ELSE 'models' END AS category", f"CASE WHEN user_id % 2 = 0 OR (user_id % 4 = 1 AND {RUN} >= 14) THEN 'agents' ELSE 'models' END AS category")
    .replace("CASE WHEN n >= 8 THEN category ELSE 'all' END AS cohort", f"{RUN} || CASE WHEN n >= 8 THEN category ELSE 'all' END AS cohort")
    .replace(f"CAST(least(DATE '{END}', DATE '{END}') AS TIMESTAMP)", f"CAST(DATE '2024-01-01' + CAST(c.user_id // 1000000 AS INTEGER) AS TIMESTAMP)")
)


def replayed(spark, folder) -> tuple[DataFrame, DataFrame]:
    return hindcast.replay(*raw(spark, folder), DAYS)


@query(f"WITH {REPLAY} SELECT DATE '2024-01-01' + {RUN} AS as_of, user_id % 1000000 AS entity_id, day, state, CAST(tier AS INTEGER) AS smoothed_tier, round(p, 6) AS p FROM st")
def hindcast_states(spark, folder):
    return replayed(spark, folder)[0].select("as_of", "entity_id", "day", "state", "smoothed_tier", F.round("p", 6).alias("p"))


@query(f"WITH {REPLAY} SELECT user_id % 1000000 AS entity_id, day, state, round(p, 6) AS p FROM st WHERE day = DATE '2024-01-01' + {RUN}")
def hindcast_trace(spark, folder):
    return hindcast.trace(replayed(spark, folder)[0]).withColumn("p", F.round("p", 6))


FINAL = f"fin AS (SELECT user_id % 1000000 AS e, day, arg_max(state, {RUN}) AS state, arg_max(p, {RUN}) AS p, arg_max(pv, {RUN}) AS pv FROM (SELECT st.*, c.provisional AS pv FROM st JOIN c USING (user_id)) GROUP BY ALL)"


@query(f"""WITH {REPLAY}, {FINAL},
hot AS (SELECT e, CAST(date_trunc('week', day) AS DATE) AS week, max(CASE WHEN state = 'breakout' THEN 2 ELSE 1 END) AS rk, greatest(max(p), 0) AS pp FROM fin WHERE state IN ('breakout', 'accelerating') AND NOT pv AND date_trunc('week', day) >= DATE '2024-01-08' GROUP BY ALL),
lc AS (SELECT user_id % 1000000 AS e, category, first_seen FROM c WHERE {RUN} = 27),
nv AS (SELECT e, w.week, CASE WHEN row_number() OVER (PARTITION BY w.week, category ORDER BY first_seen, e) <= 3 THEN 1.0 WHEN count(*) OVER (PARTITION BY w.week, category) < 10 THEN 0.6 ELSE 0.3 END AS nov FROM lc, (SELECT DISTINCT week FROM hot) w),
gt AS (SELECT hot.e, hot.week, category, CASE rk WHEN 2 THEN 1.0 ELSE 0.7 END * (0.5 + 0.5 * least(pp, 1)) AS m, CASE category WHEN 'agents' THEN 0.5 ELSE 0.0 END AS r, nov, e % 7 = 0 AND hot.week >= DATE '2024-01-15' AS recent, e % 4 <> 2 AS carded FROM hot JOIN lc USING (e) JOIN nv USING (e, week)),
gs AS (SELECT *, m * (0.4 + 0.6 * r) * (0.4 + 0.6 * nov) AS score, r > 0 AND NOT recent AND carded AS ok FROM gt)
SELECT e AS entity_id, week, CASE WHEN recent THEN 'recent' WHEN r = 0 THEN 'unmapped' WHEN NOT carded THEN 'card_pending' WHEN row_number() OVER (PARTITION BY week, ok ORDER BY score DESC, e) <= 5 THEN 'pass' ELSE 'budget' END AS decision, round(score, 6) AS score FROM gs""")
def hindcast_gates(spark, folder):
    states, known = replayed(spark, folder)
    ids = table(spark, folder, "events").select(F.col("user_id").alias("entity_id")).distinct()
    briefed = ids.where("entity_id % 7 = 0").withColumn("published_at", F.lit("2024-01-10").cast("timestamp_ntz"))
    old = ids.select("entity_id", F.lit(1).alias("version"), F.lit("ok").alias("status"))
    cards = old.unionByName(ids.where("entity_id % 4 = 2").select("entity_id", F.lit(2).alias("version"), F.lit("failed").alias("status")))
    found = hindcast.gates(checkpoint(states), known, reach(spark), DAYS, briefed, cards)
    return found.select("entity_id", "week", "decision", F.round("score", 6).alias("score"))


@query(f"""WITH {REPLAY}, {FINAL}, ft AS (SELECT e, min(day) FILTER (WHERE state = 'breakout') AS hot, arg_max(state, day) AS state FROM fin GROUP BY ALL), wd AS (SELECT *, lag(state) OVER (PARTITION BY e ORDER BY day) AS was FROM fin),
fd AS (SELECT e, day FROM wd WHERE state = 'fading' AND was <> 'fading' AND day <= DATE '{DAYS[-1]}' - 3)
SELECT 'breakout_survival' AS metric, round(avg(CASE WHEN state NOT IN ('dormant', 'fading') THEN 1.0 ELSE 0.0 END), 6) AS value, count(*) AS sample_n FROM ft WHERE hot <= DATE '{DAYS[-1]}' - 5
UNION ALL SELECT 'fade_reaccel', round(avg(CASE WHEN EXISTS (SELECT 1 FROM fin WHERE fin.e = fd.e AND fin.day > fd.day AND fin.day <= fd.day + 3 AND fin.state IN ('breakout', 'accelerating')) THEN 1.0 ELSE 0.0 END), 6), count(*) FROM fd""")
def hindcast_review(spark, folder):
    kept = checkpoint(hindcast.stored(replayed(spark, folder)[0]))
    return momentum.review(kept, DAYS[-1], 5, 3).withColumn("value", F.round("value", 6))


WHO = f"(SELECT DISTINCT user_id AS u FROM events), generate_series(TIMESTAMP '{DAYS[0]}', TIMESTAMP '{DAYS[-1]}', INTERVAL 1 DAY) g(x)"


@query(f"SELECT u AS entity_id, d AS day, {CANONICAL} AS canonical_id FROM (SELECT u, CAST(g.x AS DATE) AS d FROM {WHO}) WHERE u % 10 >= 8")
def canonical_each_day(spark, folder):
    return asof.on_days(asof.canonical_intervals(raw(spark, folder)[2], DAYS), DAYS).select("entity_id", "day", "canonical_id")


@query(f"""WITH m AS (SELECT u, {CANONICAL} AS c FROM (SELECT u, DATE '{DAYS[-1]}' AS d FROM (SELECT DISTINCT user_id AS u FROM events)))
SELECT c AS canonical_id, array_to_string(list(DISTINCT e ORDER BY e), ',') AS members FROM (SELECT c, u AS e FROM m WHERE c <> u UNION ALL SELECT c, c FROM m WHERE c <> u) GROUP BY c""")
def merge_set_members(spark, folder):
    sets = asof.merge_sets(asof.canonical_ids(raw(spark, folder)[2], f"{DAYS[-1]} 23:59:59"))
    return sets.select("canonical_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))
