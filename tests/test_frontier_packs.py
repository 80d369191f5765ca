import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import frontier, packs


def test_first_trigger_is_kept_and_no_loop_join(spark):
    t = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    found = frontier.any_of({"b": t(1, 2), "a": t(2, 3), "c": t(3, 1, 1)}, "k")
    assert {(r.k, r.trigger) for r in found.collect()} == {(1, "b"), (2, "b"), (3, "a")}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shares_never_exceed_the_limit_nor_leave_room_unused():
    rng = random.Random(1)
    for _ in range(2000):
        held, limit = [rng.choice([0, 1, 5, 200]) for _ in range(3)], rng.randrange(2, 60)
        taken = frontier.shares(*held, limit)
        assert all(0 <= t <= h for t, h in zip(taken, held)) and sum(taken) == min(limit, sum(held))
        assert held[0] == 0 or taken[0] >= 1


def test_due_by_outcome_before_state(spark):
    e = spark.createDataFrame([(k, "2024-01-01", None, "active") for k in range(6)] + [(9, "2024-01-01", 1, "active"), (10, "2024-01-01", None, "archived")], "entity_id long, created_at string, merged_into long, tracking_tier string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    states = spark.createDataFrame([(1, "2024-03-01", "breakout"), (2, "2024-03-01", "breakout"), (3, "2024-03-09", "breakout")], "entity_id long, day string, state string").withColumn("day", F.col("day").cast("date"))
    done = spark.createDataFrame([(1, 1, "found", "2024-03-06"), (2, 2, "not_found", "2024-03-06"), (3, 3, "found", "2024-03-01"), (4, 4, "failed", "2024-03-06"), (5, 4, "found", "2024-03-06"), (6, 5, "found", "2024-03-09")], "id long, entity_id long, status string, researched_at string").withColumn("researched_at", F.col("researched_at").cast("timestamp_ntz"))
    got = [r.entity_id for r in frontier.research_due(e, states, done, "2024-03-07 12:00:00").collect()]
    assert got == [0, 5, 1]  # 2 waits a week, 3 is dormant by then, the later outcome of 4 isn't a failure
    assert [r.entity_id for r in frontier.research_due(e, states, done, "2024-03-07 12:00:00", 2).collect()] == [0, 5]


@pytest.mark.parametrize("cap", [1, 7, 40, 1000])
def test_packs_equal_joining_everything_and_cutting(spark, cap):
    rng = random.Random(cap)
    lines = [(k, rng.randrange(3), float(i), "".join(rng.choice("aé日😀 ") for _ in range(rng.randrange(9)))) for k in range(8) for i in range(rng.randrange(1, 30))]
    lines += [(1, 0, -1.0, None)]
    got = dict(packs.assembled(spark.createDataFrame(lines, "entity_id long, section int, place double, line string").repartition(5), cap=cap).collect())
    want = {}
    for k in range(8):
        own = sorted(x[1:] for x in lines if x[0] == k and x[3] is not None)
        want[k] = "\n\n".join("\n".join(t for s, _, t in own if s == section) for section in sorted({s for s, *_ in own}))[:cap]
    assert got == want


def test_a_hot_entity_keeps_its_newest_events(spark):
    events = spark.range(30_000).select((F.col("id") % 2 * 0 + 1).alias("entity_id"), "id", F.lit("hn").alias("source"), F.lit("story").alias("event_type"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("occurred_at"), F.lit("t" * 500).alias("title"), F.lit(7).alias("points"))
    e = spark.createDataFrame([(1, "one", "project", None, None, None, "2024-01-01", " body ")], "entity_id long, name string, entity_type string, category string, owner string, anchors map<string,string>, created_at string, text string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    none = spark.createDataFrame([], "entity_id long, stage string, promoted_at timestamp_ntz")
    metrics = spark.createDataFrame([], "entity_id long, metric string, value double, day date")
    found = packs.evidence_packs(e, events, none, metrics)
    (_, pack), = found.collect()
    lines = pack.split("\n")
    assert lines[5] == "- registries: none" and "body" in lines and sum(x.startswith("- [event ") for x in lines) == packs.EVENTS
    assert lines[-1] == "- … 29960 earlier events omitted" and f"- [event 29999] 1970-01-21 hn/story: {'t' * packs.TITLE} (7 pts)" in lines
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()  # cut before the shuffle
