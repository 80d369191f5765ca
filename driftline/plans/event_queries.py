"""Momentum operators on the event stream: an entity is a user, a metric one kind of event, time is ``ts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline import config
from driftline.operators import asof, decide, series
from driftline.plans.registry import query, table

AS_OF, END = "2024-01-28 00:00:00", "2024-01-28"
#: A signup of this value is a promotion.
PROMOTED = 95


def events(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    out = asof.events_asof(table(spark, folder, "events"), AS_OF, occurred_at="ts")
    return out.where(F.col("event_type") == kind) if kind else out


E = f"e AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE ts <= TIMESTAMP '{AS_OF}')"


@query(f"SELECT event_id, user_id, event_type, value FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_type IN ('click', 'view')")
def events_asof(spark, folder):
    return asof.events_asof(table(spark, folder, "events"), AS_OF, ("click", "view"), "event_type", "ts").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, folder):
    return asof.latest_by(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("SELECT user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'view'")
def latest_then_filter(spark, folder):
    return asof.latest_by(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]).where("event_type = 'view'").select("user_id", "event_id")


DAILY = "d AS (SELECT user_id, day, arg_max(value, (ts, event_id)) AS value FROM e WHERE event_type = 'view' GROUP BY ALL)"


def daily(spark, folder) -> DataFrame:
    return series.daily_last(events(spark, folder, "view"), ["user_id"], "ts", "event_id", "value")


@query(f"WITH {E}, {DAILY} SELECT user_id, day, value FROM d")
def daily_last_value(spark, folder):
    return daily(spark, folder)


FILLED = f"""n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d),
f AS (SELECT user_id, CAST(g.x AS DATE) AS day, value FROM n, generate_series(CAST(n.day AS TIMESTAMP), CAST(least(n.day + 3, coalesce(n.nxt - 1, n.day + 3), DATE '{END}') AS TIMESTAMP), INTERVAL 1 DAY) g(x))"""


def filled(spark, folder) -> DataFrame:
    return series.forward_fill(daily(spark, folder), ["user_id"], 3, END)


@query(f"WITH {E}, {DAILY}, {FILLED} SELECT user_id, day, value FROM f")
def forward_fill_3d(spark, folder):
    return filled(spark, folder)


@query(f"WITH {E} SELECT user_id, event_type, day, CAST(sum(count(*)) OVER (PARTITION BY user_id, event_type ORDER BY day) AS BIGINT) AS value FROM e GROUP BY user_id, event_type, day")
def cumulative_daily(spark, folder):
    return series.cumulative(events(spark, folder), ["user_id", "event_type"], "ts")


TRAIL = f"SELECT e.*, CAST(g.x AS DATE) AS wday FROM e, generate_series(CAST(e.day AS TIMESTAMP), CAST(least(e.day + {{n}}, DATE '{END}') AS TIMESTAMP), INTERVAL 1 DAY) g(x)"


@query(f"WITH {E}, t AS ({TRAIL.format(n=6)}) SELECT user_id, wday AS day, round(sum(value), 4) AS value FROM t WHERE event_type = 'purchase' GROUP BY ALL HAVING sum(value) > 0")
def trailing_sum_7d(spark, folder):
    return series.trailing_sum(events(spark, folder, "purchase"), ["user_id"], "ts", "value", 7, END).withColumn("value", F.round("value", 4))


@query(f"WITH {E}, t AS ({TRAIL.format(n=29)}) SELECT user_id, wday AS day, count(DISTINCT event_type) AS value FROM t GROUP BY ALL")
def trailing_distinct_30d(spark, folder):
    return series.trailing_distinct(events(spark, folder), ["user_id"], "ts", "event_type", 30, END)


LAGGED = "v AS (SELECT a.user_id, a.day, a.value - coalesce(b.value, 0) AS value FROM f a ASOF LEFT JOIN (SELECT user_id, day + 7 AS day, value FROM f) b ON a.user_id = b.user_id AND a.day >= b.day)"


@query(f"WITH {E}, {DAILY}, {FILLED}, {LAGGED} SELECT user_id, day, round(value, 4) AS value FROM v")
def asof_lag_7d(spark, folder):
    return series.change_since(filled(spark, folder), ["user_id"]).withColumn("value", F.round("value", 4))


@query(f"""WITH {E}, {DAILY}, g AS (SELECT user_id, arg_max(value, day) FILTER (WHERE day <= DATE '2024-01-10') AS v0, arg_max(value, day) FILTER (WHERE day <= DATE '2024-01-25') AS v1 FROM d GROUP BY ALL)
SELECT user_id, round((v1 - v0) / v0, 6) AS growth FROM g WHERE v0 > 0""")
def growth_two_endpoints(spark, folder):
    return decide.growth(daily(spark, folder), "user_id", "2024-01-10", "2024-01-25").withColumn("growth", F.round("growth", 6))


def members(spark, folder) -> DataFrame:
    first = events(spark, folder).groupBy("user_id").agg(F.min(F.to_date("ts")).alias("first_seen"))
    key = F.concat_ws("|", F.col("user_id") % 7, F.to_date(F.date_trunc("week", "first_seen")))
    return series.cohorts(first.withColumn("key", key).withColumn("fallback", F.to_date(F.date_trunc("month", "first_seen")).cast("string")), "key", "fallback")


COHORTS = """m AS (SELECT user_id, min(day) AS first_seen FROM e GROUP BY ALL),
k AS (SELECT *, concat_ws('|', user_id % 7, CAST(date_trunc('week', first_seen) AS DATE)) AS key, CAST(CAST(date_trunc('month', first_seen) AS DATE) AS VARCHAR) AS fb FROM m),
kk AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, count(*) OVER (PARTITION BY fb) AS nn FROM k),
c AS (SELECT user_id, CASE WHEN n >= 8 THEN key ELSE fb END AS cohort, CASE WHEN n >= 8 THEN n ELSE nn END AS cohort_n, n < 8 AND nn < 8 AS provisional FROM kk)"""


@query(f"WITH {E}, {COHORTS} SELECT * FROM c")
def cohort_sizes_fallback(spark, folder):
    return members(spark, folder).select("user_id", "cohort", "cohort_n", "provisional")


def ranked(spark, folder) -> DataFrame:
    velocity = series.change_since(filled(spark, folder), ["user_id"])
    rows = velocity.join(members(spark, folder).select("user_id", "cohort", "cohort_n", "provisional"), "user_id")
    return series.cohort_percent_rank(rows, ["cohort", "day"], "cohort_n")


@query(f"""WITH {E}, {DAILY}, {FILLED}, {LAGGED}, {COHORTS},
days AS (SELECT DISTINCT cohort, day FROM v JOIN c USING (user_id)),
dense AS (SELECT c.user_id, c.cohort, days.day, coalesce(v.value, 0) AS value, v.value IS NOT NULL AS present FROM c JOIN days ON c.cohort = days.cohort LEFT JOIN v ON v.user_id = c.user_id AND v.day = days.day),
p AS (SELECT *, percent_rank() OVER (PARTITION BY cohort, day ORDER BY value) AS pctl FROM dense)
SELECT user_id, day, round(pctl, 6) AS pctl FROM p WHERE present""")
def cohort_percent_rank(spark, folder):
    return ranked(spark, folder).select("user_id", "day", F.round("pctl", 6).alias("pctl"))


GRID = f"""d5 AS (SELECT user_id, event_type, day, arg_max(value, (ts, event_id)) AS value FROM e GROUP BY ALL),
n5 AS (SELECT *, lead(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS nxt FROM d5),
f5 AS (SELECT user_id, event_type, CAST(g.x AS DATE) AS day, value FROM n5, generate_series(CAST(n5.day AS TIMESTAMP), CAST(least(n5.day + 3, coalesce(n5.nxt - 1, n5.day + 3), DATE '{END}') AS TIMESTAMP), INTERVAL 1 DAY) g(x)),
v5 AS (SELECT a.user_id, a.event_type, a.day, a.value - coalesce(b.value, 0) AS value FROM f5 a ASOF LEFT JOIN (SELECT user_id, event_type, day + 7 AS day, value FROM f5) b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.day >= b.day),
j5 AS (SELECT v5.*, c.cohort, c.cohort_n FROM v5 JOIN c USING (user_id)),
r5 AS (SELECT *, CASE WHEN cohort_n > 1 THEN (rank() OVER (PARTITION BY event_type, cohort, day ORDER BY value) - 1 + CASE WHEN value > 0 THEN cohort_n - count(*) OVER (PARTITION BY event_type, cohort, day) ELSE 0 END) / (cohort_n - 1) ELSE 0 END AS p FROM j5),
sig AS (SELECT user_id, day, max(p) AS p, count(*) FILTER (WHERE p >= 0.6) AS c60, count(*) FILTER (WHERE p >= 0.8) AS c80, count(*) FILTER (WHERE p >= 0.95) AS c95 FROM r5 GROUP BY ALL),
b AS (SELECT user_id, wday AS day, count(DISTINCT event_type) AS breadth FROM ({TRAIL.format(n=29)}) GROUP BY ALL),
grid AS (SELECT m.user_id, CAST(g.x AS DATE) AS day FROM m, generate_series(CAST(m.first_seen AS TIMESTAMP), TIMESTAMP '{AS_OF}', INTERVAL 1 DAY) g(x)),
la AS (SELECT user_id, day AS eday, max(CASE WHEN event_type = 'signup' AND value >= {PROMOTED} THEN 1 ELSE 0 END) AS promoted FROM e GROUP BY ALL),
s AS (SELECT grid.user_id, grid.day, coalesce(sig.p, 0) AS p, coalesce(c60, 0) AS c60, coalesce(c80, 0) AS c80, coalesce(c95, 0) AS c95, coalesce(b.breadth, 0) AS breadth, c.provisional, max(la.eday) OVER (PARTITION BY grid.user_id ORDER BY grid.day) AS last_event,
 sum(coalesce(la.promoted, 0)) OVER (PARTITION BY grid.user_id ORDER BY grid.day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS promos
 FROM grid JOIN c USING (user_id) LEFT JOIN sig ON sig.user_id = grid.user_id AND sig.day = grid.day LEFT JOIN b ON b.user_id = grid.user_id AND b.day = grid.day LEFT JOIN la ON la.user_id = grid.user_id AND la.eday = grid.day),
t AS (SELECT *, CASE WHEN last_event IS NULL OR day - last_event >= 14 THEN 0 WHEN promos >= 2 OR (c95 >= 1 AND breadth >= 2) THEN 3 WHEN c80 >= 2 OR (promos >= 1 AND c60 >= 1) THEN 2 WHEN c60 >= 1 THEN 1 ELSE 0 END AS raw_tier FROM s)"""
UP_TO_TIERS = f"{E}, {COHORTS}, {GRID}"


def tiers(spark, folder) -> DataFrame:
    """A row for each user and day since its first event: signals over all kinds of event as metrics, and the raw tier."""
    seen = events(spark, folder)
    people = members(spark, folder).select("user_id", "first_seen", "cohort", "cohort_n", "provisional")
    keys = ["user_id", "event_type"]
    velocity = series.change_since(series.forward_fill(series.daily_last(seen, keys, "ts", "event_id", "value"), keys, 3, END), keys)
    ranks = series.cohort_percent_rank(velocity.join(people, "user_id"), ["event_type", "cohort", "day"], "cohort_n")
    counts = [F.count_if(F.col("pctl") >= t).alias(n) for n, t in (("count_60", config.SIMMERING), ("count_80", config.ACCELERATING), ("count_95", config.BREAKOUT))]
    signals = ranks.groupBy("user_id", "day").agg(F.max("pctl").alias("p"), *counts)
    grid = people.withColumn("day", F.explode(F.sequence("first_seen", F.lit(END).cast("date")))).select("user_id", "day", "provisional")
    breadth = series.trailing_distinct(seen, ["user_id"], "ts", "event_type", config.BREADTH_WINDOW, END).withColumnRenamed("value", "breadth")
    rung = (F.col("event_type") == "signup") & (F.col("value") >= PROMOTED)
    active = seen.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(rung.cast("int")).alias("promoted")).withColumn("event_day", F.col("day"))
    out = grid.join(signals, ["user_id", "day"], "left").join(breadth, ["user_id", "day"], "left").join(active, ["user_id", "day"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("p", "count_60", "count_80", "count_95", "breadth", "promoted")})
    out = out.withColumn("last_event", F.max("event_day").over(Window.partitionBy("user_id").orderBy("day"))).drop("event_day")
    out = out.withColumn("promo_30d", series.within_days(out, "user_id", "promoted", config.PROMOTION_WINDOW)).withColumn("active", F.coalesce(F.datediff("day", "last_event") < config.ACTIVE_DAYS, F.lit(False)))
    return out.withColumn("raw_tier", series.raw_tier(*(F.col(c) for c in ("count_60", "count_80", "count_95", "breadth", "promo_30d", "active"))))


@query(f"WITH {UP_TO_TIERS} SELECT user_id, day, round(p, 6) AS p, c60 AS count_60, c80 AS count_80, c95 AS count_95, breadth, CAST(promos AS BIGINT) AS promo_30d, raw_tier FROM t")
def composite_tiers(spark, folder):
    return tiers(spark, folder).select("user_id", "day", F.round("p", 6).alias("p"), "count_60", "count_80", "count_95", "breadth", "promo_30d", "raw_tier")


LATCH = """lo AS (SELECT *, CASE WHEN count(*) OVER w2 >= 2 THEN min(raw_tier) OVER w2 ELSE 0 END AS lo, CASE WHEN count(*) OVER w7 >= 7 THEN max(raw_tier) OVER w7 ELSE 3 END AS hi FROM t
 WINDOW w2 AS (PARTITION BY user_id ORDER BY day ROWS 1 PRECEDING), w7 AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING)),
l AS (SELECT *, """ + " + ".join(f"coalesce(last_value(CASE WHEN lo >= {k} THEN 1 WHEN hi < {k} THEN 0 END IGNORE NULLS) OVER w, 0)" for k in (1, 2, 3)) + """ AS tier FROM lo WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, max(tier) OVER (PARTITION BY user_id ORDER BY day) >= 1 AS peaked, count(*) OVER w14 >= 14 AND max(p) OVER w14 < 0.4 AS quiet FROM l WINDOW w14 AS (PARTITION BY user_id ORDER BY day ROWS 13 PRECEDING)),
st AS (SELECT user_id, day, tier, CASE CASE WHEN provisional THEN least(tier, 1) ELSE tier END WHEN 3 THEN 'breakout' WHEN 2 THEN 'accelerating' WHEN 1 THEN 'simmering' ELSE CASE WHEN peaked AND (quiet OR coalesce(day - last_event >= 30, true)) THEN 'fading' ELSE 'dormant' END END AS state, p FROM q)"""


def momentum(spark, folder) -> DataFrame:
    return series.states(series.hysteresis(tiers(spark, folder), "user_id"), "user_id")


@query(f"WITH {UP_TO_TIERS}, {LATCH} SELECT user_id, day, CAST(tier AS INTEGER) AS smoothed_tier, state FROM st")
def hysteresis_states(spark, folder):
    return momentum(spark, folder).select("user_id", "day", "smoothed_tier", "state")


@query(f"""WITH {UP_TO_TIERS}, {LATCH}, x AS (SELECT user_id, coalesce(arg_max(state, day) FILTER (WHERE day <= DATE '2024-01-20'), 'dormant') AS was, coalesce(arg_max(state, day) FILTER (WHERE day <= DATE '2024-01-27'), 'dormant') AS now FROM st GROUP BY ALL)
SELECT user_id, was, now FROM x WHERE was <> now""")
def state_transitions(spark, folder):
    return decide.transitions(momentum(spark, folder), "user_id", "2024-01-27", "2024-01-20")


@query(f"""WITH {UP_TO_TIERS}, {LATCH}, fb AS (SELECT user_id, min(day) FILTER (WHERE tier >= 2) AS hot, arg_max(state, day) AS state FROM st GROUP BY ALL)
SELECT count(*) AS sample_n, count(*) FILTER (WHERE state NOT IN ('dormant', 'fading')) AS alive, round(avg(CASE WHEN state NOT IN ('dormant', 'fading') THEN 1.0 ELSE 0.0 END), 6) AS survival FROM fb WHERE hot <= DATE '{END}' - 7""")
def breakout_survival(spark, folder):
    rows = momentum(spark, folder).groupBy("user_id").agg(F.min(F.when(F.col("smoothed_tier") >= 2, F.col("day"))).alias("hot"), F.max_by("state", "day").alias("state"))
    alive = ~F.col("state").isin("dormant", "fading")
    return rows.where(F.col("hot") <= F.date_sub(F.lit(END).cast("date"), 7)).agg(F.count("*").alias("sample_n"), F.count_if(alive).alias("alive"), F.round(F.avg(alive.cast("double")), 6).alias("survival"))


@query(f"""WITH {UP_TO_TIERS}, {LATCH}, x AS (SELECT *, lag(tier) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM st), fade AS (SELECT user_id, day FROM x WHERE prev >= 1 AND tier = 0)
SELECT user_id, day FROM fade WHERE EXISTS (SELECT 1 FROM st WHERE st.user_id = fade.user_id AND st.tier >= 2 AND st.day > fade.day AND st.day <= fade.day + 10)""")
def reaccel_semi(spark, folder):
    rows = momentum(spark, folder).select("user_id", "day", "smoothed_tier")
    fade = rows.withColumn("prev", F.lag("smoothed_tier").over(Window.partitionBy("user_id").orderBy("day"))).where("prev >= 1 AND smoothed_tier = 0").select("user_id", "day")
    hot = rows.where("smoothed_tier >= 2").select(F.col("user_id").alias("u"), F.col("day").alias("d"))
    return fade.join(hot, (F.col("user_id") == F.col("u")) & (F.col("d") > F.col("day")) & (F.col("d") <= F.date_add("day", 10)), "left_semi")


@query(f"""WITH {UP_TO_TIERS}, {LATCH}, x AS (SELECT user_id, day, state, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM st) SELECT user_id, day, state FROM x WHERE prev IS NULL OR prev <> state""")
def state_changes(spark, folder):
    prev = F.lag("state").over(Window.partitionBy("user_id").orderBy("day"))
    return momentum(spark, folder).select("user_id", "day", "state", prev.alias("prev")).where("prev IS NULL OR prev <> state").drop("prev")


@query(f"""WITH {E}, w AS (SELECT user_id, day, round(sum(value) FILTER (WHERE event_type = 'view'), 6) AS a, round(sum(value) FILTER (WHERE event_type = 'purchase'), 6) AS u FROM e GROUP BY ALL),
p AS (SELECT user_id, day, CASE WHEN a IS NULL THEN 0 ELSE percent_rank() OVER (PARTITION BY day ORDER BY coalesce(a, 0)) END AS ap, CASE WHEN u IS NULL THEN 0 ELSE percent_rank() OVER (PARTITION BY day ORDER BY coalesce(u, 0)) END AS up FROM w)
SELECT user_id, day, round(ap, 6) AS attention, round(up, 6) AS adoption, round(ap - up, 6) AS gap, ap >= 0.95 AND ap - up >= 0.5 AS hype FROM p""")
def hype_gap(spark, folder):
    kind = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 6)
    rows = events(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(kind("view").alias("a"), kind("purchase").alias("u"))
    share = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(F.percent_rank().over(Window.partitionBy("day").orderBy(F.coalesce(c, F.lit(0.0)))))
    rows = rows.withColumn("ap", share("a")).withColumn("up", share("u"))
    gap = F.col("ap") - F.col("up")
    return rows.select("user_id", "day", F.round("ap", 6).alias("attention"), F.round("up", 6).alias("adoption"), F.round(gap, 6).alias("gap"), ((F.col("ap") >= config.HYPE_ATTENTION) & (gap >= config.HYPE_GAP)).alias("hype"))


@query(f"""WITH {E}, h AS (SELECT user_id, 'discovered' AS stage, min((ts, event_id)) AS x FROM e GROUP BY ALL UNION ALL SELECT user_id, 'used', min((ts, event_id)) FROM e WHERE event_type = 'click' GROUP BY ALL
UNION ALL SELECT user_id, 'adopted', min((ts, event_id)) FROM e WHERE event_type = 'purchase' AND value >= 50 GROUP BY ALL) SELECT user_id, stage, x[2] AS event_id FROM h""")
def ladder_first_hit(spark, folder):
    stages = {"discovered": F.lit(True), "used": F.col("event_type") == "click", "adopted": (F.col("event_type") == "purchase") & (F.col("value") >= 50)}
    return series.first_hits(events(spark, folder), "user_id", stages, ["ts", "event_id"]).select("user_id", "stage", "event_id")


@query(f"""WITH {E}, p AS (SELECT a.user_id, a.ts AS a, b.event_type, min(b.ts) AS t FROM e a JOIN e b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 3 DAY GROUP BY ALL),
n AS (SELECT user_id, t FROM p QUALIFY row_number() OVER (PARTITION BY user_id, a ORDER BY t, event_type) = 4) SELECT user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS crossed_at FROM n GROUP BY ALL""")
def sliding_distinct_threshold(spark, folder):
    found = series.threshold_crossing(events(spark, folder), "user_id", "event_type", "ts", 3, 4)
    return found.select("user_id", F.date_format("crossed_at", "yyyy-MM-dd HH:mm:ss").alias("crossed_at"))


@query(f"WITH {E} SELECT day, " + ", ".join(f"count(DISTINCT user_id) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("click", "purchase", "view")) + " FROM e GROUP BY ALL")
def source_pivot_counts(spark, folder):
    return events(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(*(F.count_distinct(F.when(F.col("event_type") == k, F.col("user_id"))).alias(f"n_{k}") for k in ("click", "purchase", "view")))


@query(f"WITH {E} SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources, count(DISTINCT event_type) AS n FROM e GROUP BY ALL")
def collect_sources(spark, folder):
    kinds = F.array_sort(F.collect_set("event_type"))
    return events(spark, folder).groupBy("user_id").agg(F.array_join(kinds, ",").alias("sources"), F.size(kinds).cast("long").alias("n"))


@query(f"""WITH {E}, {DAILY}, {COHORTS}, g AS (SELECT user_id, arg_max(value, day) FILTER (WHERE day <= DATE '2024-01-10') AS v0, arg_max(value, day) FILTER (WHERE day <= DATE '2024-01-25') AS v1 FROM d GROUP BY ALL),
x AS (SELECT user_id, (v1 - v0) / v0 AS growth FROM g WHERE v0 > 0), y AS (SELECT cohort, median(growth) AS m, count(*) AS n FROM x JOIN c USING (user_id) GROUP BY ALL)
SELECT cohort, n, round(m, 6) AS median_growth, CASE WHEN m > 0.05 THEN 'took_hold' WHEN m < -0.05 THEN 'faded' ELSE 'flat' END AS verdict FROM y""")
def median_growth_verdict(spark, folder):
    rows = decide.growth(daily(spark, folder), "user_id", "2024-01-10", "2024-01-25").join(members(spark, folder).select("user_id", "cohort"), "user_id")
    out = rows.groupBy("cohort").agg(F.count("*").alias("n"), F.median("growth").alias("m"))
    return out.select("cohort", "n", F.round("m", 6).alias("median_growth"), decide.verdict(F.lit(0.5), F.col("m")).alias("verdict"))


@query(f"WITH {E}, n AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, list_sort(list(n))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper FROM n GROUP BY ALL")
def upper_median(spark, folder):
    return events(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).groupBy("user_id").agg(decide.upper_median("n").alias("upper"))


@query(f"WITH {E}, t AS (SELECT user_id, event_type, sum(value) AS v FROM e GROUP BY ALL) SELECT event_type, round(avg(CASE WHEN v < 500 THEN 1.0 ELSE 0.0 END), 6) AS ecdf, count(*) AS n FROM t GROUP BY ALL")
def strict_ecdf(spark, folder):
    totals = events(spark, folder).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return totals.groupBy("event_type").agg(F.round(F.avg((F.col("v") < 500).cast("double")), 6).alias("ecdf"), F.count("*").alias("n"))


@query(f"""WITH {E}, v AS (SELECT user_id, day, event_type AS vote, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT user_id, day, max(n) AS most, sum(n) AS total, arg_max(vote, n) AS top FROM v GROUP BY ALL)
SELECT user_id, day, CASE WHEN most * 2 > total THEN top ELSE 'split' END AS stance FROM t""")
def majority_vote(spark, folder):
    return decide.majority(events(spark, folder).withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, folder):
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT concat(isoyear(ts), '-W', lpad(CAST(week(ts) AS VARCHAR), 2, '0')) AS week, CAST(date_trunc('week', ts) AS DATE) AS monday, event_type, count(*) AS n FROM events GROUP BY ALL")
def iso_week_rollup(spark, folder):
    from driftline.functions.text import iso_week

    return table(spark, folder, "events").groupBy(iso_week(F.col("ts")).alias("week"), F.to_date(F.date_trunc("week", "ts")).alias("monday"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def ingest_dedupe(spark, folder):
    from driftline.sources.ingest import insert_new

    old = table(spark, folder, "events")
    return insert_new(old.where("event_id % 3 = 0"), old.unionByName(old), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, r AS (SELECT user_id, count(*) AS n, max(value) AS top, max(ts) AS seen FROM e GROUP BY ALL) SELECT user_id, n, CASE WHEN n >= 70 THEN 0 WHEN n >= 60 THEN 1 ELSE 2 END AS band FROM r ORDER BY band, top DESC, user_id LIMIT 20""")
def radar_rank(spark, folder):
    rows = events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return rows.withColumn("band", F.when(F.col("n") >= 70, 0).when(F.col("n") >= 60, 1).otherwise(2)).orderBy("band", F.desc("top"), "user_id").limit(20).select("user_id", "n", "band")


@query(f"WITH {E}, d AS (SELECT user_id, day, sum(value) AS v FROM e WHERE day > DATE '{END}' - 30 GROUP BY ALL) SELECT user_id, count(*) AS points, round(arg_min(v, day), 4) AS first, round(arg_max(v, day), 4) AS last FROM d GROUP BY ALL")
def sparklines_30d(spark, folder):
    rows = events(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")).where(F.col("day") > F.date_sub(F.lit(END).cast("date"), 30))
    line = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("line"))
    return line.select("user_id", F.size("line").cast("long").alias("points"), F.round(F.col("line")[0], 4).alias("first"), F.round(F.element_at("line", -1), 4).alias("last"))
