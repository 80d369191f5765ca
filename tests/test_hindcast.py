import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof
from driftline.plans import hindcast, hindcast_queries, momentum

FOLDER = "/root/testdata/sf0.001"
DAYS = [f"2024-03-{d:02d}" for d in range(1, 21)]


def merges(spark, rows):
    return spark.createDataFrame(rows, "loser_id long, survivor_id long, justified_at string, active boolean").withColumn("justified_at", F.col("justified_at").cast("timestamp_ntz"))


@pytest.mark.parametrize("seed", range(4))
def test_canonical_intervals_equal_each_days_chains(spark, seed):
    """Random forests, later merges of one loser, and circles."""
    rng = random.Random(seed)
    n = 30
    rows = []
    for i in range(n):
        for _ in range(rng.choice([0, 1, 1, 2])):
            other = rng.randrange(n) if seed % 2 else rng.randrange(max(1, i))  # odd seeds have circles
            rows.append((i, other, f"2024-03-{rng.randrange(1, 25):02d} {rng.randrange(24):02d}:00:00", rng.random() > 0.1))
    table = merges(spark, rows)
    got = {}
    for r in asof.on_days(asof.canonical_intervals(table, DAYS), DAYS).collect():
        assert (str(r.day), r.entity_id) not in got
        got[str(r.day), r.entity_id] = r.canonical_id
    for day in DAYS[::6]:
        want = {r.entity_id: r.canonical_id for r in asof.canonical_ids(table, f"{day} 23:59:59").collect()}
        assert {e: c for (d, e), c in got.items() if d == day and c != e} == {e: c for e, c in want.items() if c != e}


def test_no_merges(spark):
    assert asof.canonical_intervals(merges(spark, []), DAYS).count() == 0
    assert asof.merge_sets(asof.canonical_ids(merges(spark, []))).count() == 0


def test_replay_equals_the_plan_of_each_day(spark):
    events, links, merged, entities, history = hindcast_queries.raw(spark, FOLDER)
    columns = ["entity_id", "day", "state", "smoothed_tier", "p", "breadth", "promo_30d", "active", "hype", "cohort_n", "provisional"]
    states = hindcast_queries.replayed(spark, FOLDER)[0].select("as_of", *columns).collect()
    key = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows)
    for day in (hindcast_queries.DAYS[0], hindcast_queries.DAYS[8], hindcast_queries.DAYS[-1]):
        as_of = f"{day} 23:59:59.999999"
        seen = momentum.streams(events, links, merged, as_of).cache()
        known = momentum.facts(seen, entities, history, as_of)
        want = momentum.score(seen, momentum.snapshot(seen, as_of), known, momentum.ladder(seen), as_of).select(*columns).collect()
        assert key(r[1:] for r in states if str(r.as_of) == day) == key(want) and want


def test_states_of_every_kind_are_replayed(spark):
    states = hindcast_queries.replayed(spark, "/root/testdata/sf0.01")[0]
    assert {r.state for r in states.select("state").distinct().collect()} == {"dormant", "simmering", "accelerating", "breakout", "fading"}


def test_weeks_are_those_that_the_days_touch():
    assert hindcast.weeks(["2024-01-07", "2024-01-08", "2024-01-21"]) == ["2024-01-01", "2024-01-08", "2024-01-15"]


def test_a_later_run_overwrites_what_an_earlier_one_stored(spark):
    rows = [("2024-01-02", 1, "2024-01-01", "dormant"), ("2024-01-03", 1, "2024-01-01", "simmering"), ("2024-01-02", 2, "2024-01-02", "dormant")]
    got = hindcast.stored(spark.createDataFrame(rows, "as_of string, entity_id long, day string, state string")).collect()
    assert {(r.entity_id, r.day, r.state) for r in got} == {(1, "2024-01-01", "simmering"), (2, "2024-01-02", "dormant")}
