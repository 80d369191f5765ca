"""Picks, councils, threads and calendars on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import pick
from driftline.plans.registry import query, table


@query("""WITH b AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS thread, max(floor(value)) AS score FROM events GROUP BY ALL HAVING max(floor(value)) >= 60)
SELECT user_id, thread, CAST(score AS BIGINT) AS score FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, thread) <= 8""")
def best_threads(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("thread"), F.floor("value").alias("score"))
    return pick.best_threads(rows, "user_id", "thread", "score")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS thread, list_sort(list(DISTINCT event_type)) AS matched, max(value) AS value FROM events GROUP BY ALL")
def merged_search_hits(spark, folder):
    rows = table(spark, folder, "events").select(F.get_json_object("props", "$.k").cast("long").alias("thread"), "event_type", "value")
    return pick.merged_hits(rows, "thread", "event_type", ["value"])


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text IS NOT NULL ORDER BY n DESC, doc_id LIMIT 25")
def backlog_by_length(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return pick.backlog(docs, "doc_id", "text", table(spark, folder, "labels"), 25)


@query("""WITH q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS queue, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
n AS (SELECT count(*) FILTER (WHERE queue = 0) AS a, count(*) FILTER (WHERE queue = 1) AS b, count(*) FILTER (WHERE queue = 2) AS c FROM q), t0 AS (SELECT a, b, c, least(a, 500) AS x, least(b, 300) AS y, least(c, 200) AS z FROM n),
t1 AS (SELECT b, c, y, z, x + least(a - x, 1000 - x - y - z) AS x FROM t0), t2 AS (SELECT c, x, z, y + least(b - y, 1000 - x - y - z) AS y FROM t1), t3 AS (SELECT x, y, z + least(c - z, 1000 - x - y - z) AS z FROM t2)
SELECT o_orderkey, queue, place FROM q, t3 WHERE place <= CASE queue WHEN 0 THEN x WHEN 1 THEN y ELSE z END""")
def budget_over_queues(spark, folder):
    orders = table(spark, folder, "orders")
    place = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    rows = orders.select("o_orderkey", "o_orderstatus", place.alias("place"))
    queues = [rows.where(F.col("o_orderstatus") == s) for s in ("P", "O")] + [rows.where("o_orderstatus NOT IN ('P', 'O')")]
    return pick.split_budget(queues, 1000, [0.5, 0.3, 0.2]).select("o_orderkey", "queue", "place")


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place, count(*) AS n FROM events GROUP BY ALL")
def groups_in_display_order(spark, folder):
    place = pick.in_order(F.col("event_type"), ["purchase", "signup", "click"])
    return table(spark, folder, "events").groupBy("event_type", place.alias("place")).agg(F.count("*").alias("n")).orderBy("place", "event_type")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS roles FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 3")
def full_council(spark, folder):
    return pick.full_council(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 40) = 1 THEN max(l_partkey) FILTER (WHERE l_quantity > 40) END AS l_partkey FROM lineitem GROUP BY ALL")
def one_candidate_or_none(spark, folder):
    return pick.only_candidate(table(spark, folder, "lineitem"), "l_orderkey", F.col("l_quantity") > 40, "l_partkey")


@query("SELECT conv_id, substring(string_agg(text, ' ' ORDER BY turn), 1, 4000) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def folded_conversations(spark, folder):
    return pick.folded_text(table(spark, folder, "conversations").where("text IS NOT NULL"), "conv_id", "turn", "text")


@query("SELECT p_partkey, array_to_string(list_distinct(list_filter([lower(trim(split_part(p_name, ' ', 1))), lower(split_part(p_brand, '#', 1))], lambda x: length(x) >= 4)).list_sort(), ',') AS terms FROM part")
def name_search_terms(spark, folder):
    terms = pick.search_terms(F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lit("owner/"), F.split_part("p_brand", F.lit("#"), F.lit(1))))
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.array_sort(terms), ",").alias("terms"))


@query("""WITH t AS (SELECT o_custkey, unnest([lower(o_orderstatus), 'license:' || lower(o_orderstatus), 'p:' || o_orderpriority]) AS tag FROM orders)
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM t WHERE NOT contains(tag, ':') OR starts_with(tag, 'license:') GROUP BY ALL""")
def shown_tags(spark, folder):
    status = F.lower("o_orderstatus")
    tags = F.array(status, F.concat(F.lit("license:"), status), F.concat(F.lit("p:"), F.col("o_orderpriority")))
    all_tags = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_distinct(F.flatten(F.collect_set(tags))).alias("tags"))
    return all_tags.select("o_custkey", F.array_join(F.array_sort(pick.display_tags(F.col("tags"))), ",").alias("tags"))


@query("SELECT conv_id, round(sum(CASE role WHEN 'user' THEN length(text) * 3 ELSE length(text) * 15 END) / 1000000.0, 6)::DOUBLE AS cost FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def conversation_cost(spark, folder):
    n = F.length("text").cast("long")
    asked, told = (F.sum(F.when(c, n).otherwise(0)) for c in (F.col("role") == "user", F.coalesce(F.col("role") != "user", F.lit(True))))
    totals = table(spark, folder, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(asked.alias("a"), told.alias("b"))
    return totals.select("conv_id", pick.cost(F.col("a"), F.col("b"), "3", "15").cast("double").alias("cost"))


CASES = "c AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY user_id)"


def cases(spark, folder):
    """A window for each user, from their first event to their last."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))


@query(f"WITH {CASES} SELECT user_id, CAST(g.x AS DATE) AS day FROM c, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 5 DAYS) g(x)")
def replay_days(spark, folder):
    return pick.replay_days(cases(spark, folder), "a", "b", 5).select("user_id", "day")


@query(f"WITH {CASES} SELECT DISTINCT user_id, CAST(date_trunc('week', g.x) AS DATE) AS week FROM c, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY) g(x)")
def replay_weeks(spark, folder):
    return pick.replay_weeks(cases(spark, folder), "a", "b").select("user_id", "week")


@query("""WITH c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderkey, n FROM c WHERE o_orderstatus = 'O'""")
def latest_version_then_status(spark, folder):
    """The latest version of each key with the number of them; the status is asked after the pick."""
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(last.alias("r"), F.count("*").alias("n"))
    return rows.where("r.o_orderstatus = 'O'").select("o_custkey", "r.o_orderkey", "n")


@query("SELECT event_type AS metric, list(n ORDER BY day) AS series, arg_max(n, day) AS latest FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def calibration_series(spark, folder):
    """Each metric's daily samples in order, and the latest."""
    daily = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"])
    return daily.groupBy(F.col("event_type").alias("metric")).agg(line.alias("series"), F.max_by("n", "day").alias("latest"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem), d AS (SELECT b, count(*) AS degree FROM e GROUP BY ALL)
SELECT p_partkey, CAST(coalesce(degree, 0) AS BIGINT) AS degree, p_size >= 25 AS gated FROM part JOIN d ON b = p_partkey ORDER BY gated DESC, p_retailprice DESC NULLS LAST, p_partkey LIMIT 30""")
def trending_seeds_with_edges(spark, folder):
    """The first of those that have an edge: gated ones before others, then by score."""
    degree = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct().groupBy("p_partkey").agg(F.count("*").alias("degree"))
    rows = table(spark, folder, "part").join(degree, "p_partkey").withColumn("gated", F.col("p_size") >= 25)
    return rows.orderBy(F.desc("gated"), F.desc_nulls_last("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "degree", "gated")


@query("""WITH x AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages) SELECT page_id, CASE WHEN regexp_full_match(lower(split_part(u, '/', 1)), '[a-z0-9-]+(\\.[a-z0-9-]+)+') THEN lower(split_part(u, '/', 1)) END AS host, 'c:' || trim(regexp_replace(lower(u), '[^a-z0-9]+', '-', 'g'), '-') AS concept FROM x""")
def host_and_concept_ids(spark, folder):
    """A host-shaped anchor, else null, and a concept's id."""
    rest = F.regexp_replace("url", "^https?://", "")
    host = F.lower(F.split_part(rest, F.lit("/"), F.lit(1)))
    slug = F.concat(F.lit("c:"), F.btrim(F.regexp_replace(F.lower(rest), "[^a-z0-9]+", "-"), F.lit("-")))
    return table(spark, folder, "pages").select("page_id", F.when(host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), host).alias("host"), slug.alias("concept"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'not a date' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS at FROM events")
def parsed_or_null(spark, folder):
    """A time that can't be read is null."""
    told = F.when(F.col("event_id") % 3 == 0, "not a date").otherwise(F.col("ts").cast("string"))
    return table(spark, folder, "events").select("event_id", told.try_cast("timestamp_ntz").alias("at"))
