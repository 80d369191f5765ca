"""The canonical momentum scenarios, from raw events to states and the gate."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftline.plans import momentum

T0 = dt.datetime(2024, 3, 1, 12)
AS_OF = "2024-03-12 23:59:59"


def raw(spark, flat_peers, days=12):
    events, links = [], []

    def add(entity, source, kind, at, payload):
        events.append((len(events) + 1, source, kind, at, json.dumps(payload)))
        links.append((entity, len(events), "attach"))

    for e in range(flat_peers + 1):
        add(e, "github", "repo_discovered", T0, {"full_name": f"org/e{e}"})
        for d in range(days):
            stars = 100 + 60 * d if e == 0 else 100
            add(e, "github", "repo_snapshot", T0 + dt.timedelta(days=d), {"stars": stars, "forks": 3})
    add(0, "hn", "story", T0 + dt.timedelta(days=9), {"points": 40})
    add(0, "arxiv", "paper_published", T0 + dt.timedelta(days=3), {"title": "x"})
    ev = spark.createDataFrame(events, "id long, source string, event_type string, occurred_at timestamp_ntz, payload string")
    ln = spark.createDataFrame(links, "entity_id long, raw_event_id long, rule string")
    ent = spark.createDataFrame([(e, "project") for e in range(flat_peers + 1)], "id long, entity_type string")
    hist = spark.createDataFrame([(e, e, "agents", T0) for e in range(flat_peers + 1)], "id long, entity_id long, category string, effective_at timestamp_ntz")
    return ev, ln, ent, hist


def scored(spark, flat_peers):
    ev, ln, ent, hist = raw(spark, flat_peers)
    stream = momentum.streams(ev, ln, None, AS_OF)
    values, people, rungs = momentum.snapshot(stream, AS_OF), momentum.facts(stream, ent, hist, AS_OF), momentum.ladder(stream)
    return values, people, rungs, momentum.score(stream, values, people, rungs, AS_OF), stream


def test_riser_breaks_out_of_a_flat_cohort(spark):
    values, people, rungs, states, stream = scored(spark, 8)
    last = {r.entity_id: r for r in states.where("day = DATE '2024-03-12'").collect()}
    assert last[0].state == "breakout" and not last[0].provisional
    assert all(last[e].state == "dormant" for e in range(1, 9))
    assert values.where("metric = 'hn_points_7d' AND day = DATE '2024-03-12'").first().value == 40
    assert {(r.entity_id, r.stage) for r in rungs.collect()} == {(e, "public_code") for e in range(9)} | {(0, "idea_paper")}
    reach = spark.createDataFrame([("agents", "AAA", "l1", "enables", True), ("agents", "BBB", "l2", "enables", False)], "category string, ticker string, revenue_line string, relation string, core boolean")
    passed = momentum.gate(states, reach, people, "2024-03-11").collect()
    assert [(r.entity_id, r.decision, r.peak_state, r.lines) for r in passed] == [(0, "pass", "breakout", 2)]
    briefed = spark.createDataFrame([(0, dt.date(2024, 2, 20))], "entity_id long, published_at date")
    assert momentum.gate(states, reach, people, "2024-03-11", briefed).first().decision == "recent"
    assert momentum.gate(states, reach.limit(0), people, "2024-03-11").first().decision == "unmapped"
    cards = spark.createDataFrame([(0, 1, "ok"), (0, 2, "pending")], "entity_id long, version int, status string")
    assert momentum.gate(states, reach, people, "2024-03-11", cards=cards).first().decision == "card_pending"
    assert [(r.metric, r.value, r.sample_n) for r in momentum.review(states, AS_OF).collect()] == [("breakout_survival", None, 0), ("fade_reaccel", None, 0)]
    kinds = {(r.kind, r.entity_id) for r in momentum.changes(stream, states, rungs, momentum.gate(states, reach, people, "2024-03-11"), "2024-03-12", "2024-03-01").collect()}
    assert kinds == {("state_up", 0), ("gate", None)}


def test_thin_cohort_is_provisional(spark):
    _, _, _, states, _ = scored(spark, 2)
    last = states.where("day = DATE '2024-03-12' AND entity_id = 0").first()
    assert last.provisional and last.state != "breakout"


def test_backfilled_stars_are_levels(spark):
    rows = [(i, "github", "repo_star", T0 + dt.timedelta(days=d), "{}") for i, d in enumerate([0, 0, 0, 2, 2, 2, 2, 2])]
    ev = spark.createDataFrame(rows, "id long, source string, event_type string, occurred_at timestamp_ntz, payload string")
    ln = spark.createDataFrame([(1, i, "attach") for i in range(8)], "entity_id long, raw_event_id long, rule string")
    got = momentum.snapshot(momentum.streams(ev, ln, None, AS_OF), AS_OF).where("metric = 'gh_stars'").orderBy("day").collect()
    assert [(r.day.day, r.value) for r in got] == [(1, 3.0), (3, 8.0)]


def test_the_future_is_invisible(spark):
    ev, ln, *_ = raw(spark, 1)
    merges = spark.createDataFrame([(1, 0, dt.datetime(2024, 3, 20), True)], "loser_id long, survivor_id long, justified_at timestamp_ntz, active boolean")
    early = momentum.streams(ev, ln, merges, "2024-03-05 00:00:00")
    assert early.agg(F.max("occurred_at")).first()[0] < dt.datetime(2024, 3, 5)
    assert early.select("entity_id").distinct().count() == 2
    assert momentum.streams(ev, ln, merges, "2024-03-21 00:00:00").select("entity_id").distinct().count() == 1


def test_three_orgs_within_ninety_days(spark):
    jobs = [(1, d, o) for d, o in [(0, "a"), (50, "b"), (80, "A"), (120, "c"), (130, "d")]]
    rows = [(i, "jobs", "job_mention", T0 + dt.timedelta(days=d), json.dumps({"org": o})) for i, (_, d, o) in enumerate(jobs)]
    ev = spark.createDataFrame(rows, "id long, source string, event_type string, occurred_at timestamp_ntz, payload string")
    ln = spark.createDataFrame([(1, i, "attach") for i in range(5)], "entity_id long, raw_event_id long, rule string")
    got = momentum.ladder(momentum.streams(ev, ln, None, "2025-01-01 00:00:00")).where("stage = 'institutional_adoption'").collect()
    assert [(r.promoted_at, r.evidence_event) for r in got] == [(T0 + dt.timedelta(days=120), 3)]


@pytest.mark.parametrize("days", [30, 31, 181, 366])
def test_age_buckets(spark, days):
    from driftline.operators.decide import age_bucket

    want = {30: "0-30d", 31: "31-90d", 181: "91-365d", 366: "365d+"}[days]
    assert spark.range(1).select(age_bucket(F.lit(days)).alias("b")).first().b == want
