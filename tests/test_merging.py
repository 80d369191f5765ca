import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof, merging


def sequential(refs, entities):
    """One reference after another, roots looked up anew each time."""
    up = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    out = []
    for k, (a, b) in enumerate(refs):
        if a == b or a not in entities or b not in entities:
            continue
        x, y = sorted((root(a), root(b)), key=lambda i: (entities[i][0] == "paper", entities[i][1], i))
        if x != y:
            up[y] = x
            out.append((k, y, x))
    return out


def made(seed, n=12, m=15, base=0):
    rng = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    entities = {base + i: (rng.choice(["paper", "project"]), at + datetime.timedelta(days=rng.randrange(3)), i) for i in range(-3, n)}
    ids = [*entities, base + 77]
    hub = base + rng.randrange(n)
    refs = [(hub if rng.random() < 0.3 else rng.choice(ids), rng.choice(ids)) for _ in range(m)]
    return entities, refs


def tables(spark, entities, refs):
    e = spark.createDataFrame([(i, t, c) for i, (t, c, _) in entities.items()], "id long, entity_type string, created_at timestamp_ntz")
    r = spark.createDataFrame([(k, a, b, f"R{1 + k % 3}") for k, (a, b) in enumerate(refs)], "k long, a long, b long, rule string")
    return r, e


@pytest.mark.parametrize("leaf", [merging.LEAF, 2000])
def test_a_thousand_lists_of_merges(spark, leaf):
    """Lists on entities of their own, interleaved, so one call answers for all; ties in every part of the order."""
    entities, lists = {}, []
    for seed in range(1000):
        e, r = made(seed, base=100 * seed)
        entities |= e
        lists.append(r)
    refs = [r[k] for k in range(15) for r in lists]
    got = merging.ordered_merges(*tables(spark, entities, refs), ["k"], leaf).select("k", "loser_id", "survivor_id").collect()
    assert sorted(map(tuple, got)) == sequential(refs, entities)


@pytest.mark.parametrize("shape", ["random", "star", "path", "back"])
def test_halving_down_to_pairs(spark, shape):
    entities, refs = made(5, n=40, m=70)
    if shape != "random":
        entities = {i: ("project", datetime.datetime(2024, 1, 1) + datetime.timedelta(i), i) for i in range(40)}
        refs = [(20, i) if shape == "star" else (i, i + 1) for i in range(39)]
        refs = refs[::-1] if shape == "back" else refs
    got = merging.ordered_merges(*tables(spark, entities, refs), ["k"], 4).select("k", "loser_id", "survivor_id").collect()
    assert sorted(map(tuple, got)) == sequential(refs, entities)


def test_levels_are_few(spark, monkeypatch):
    """Each level is a components job; blocks are cut in four, and what a task can walk through takes none."""
    jobs, components = [], merging.connected_components
    monkeypatch.setattr(merging, "connected_components", lambda edges: jobs.append(1) or components(edges))
    entities, refs = made(6, n=300, m=5000)
    for leaf, levels in ((1250, 2), (merging.LEAF, 0)):
        jobs.clear()
        got = merging.ordered_merges(*tables(spark, entities, refs), ["k"], leaf).select("k", "loser_id", "survivor_id").collect()
        assert sorted(map(tuple, got)) == sequential(refs, entities) and len(jobs) == levels
    assert merging.LEAF >= 100_000


def test_audit_rows_lead_to_the_survivor(spark):
    entities, refs = made(3)
    r, e = tables(spark, entities, refs)
    rows = merging.audit(merging.ordered_merges(r.withColumn("justified_at", F.lit("2024-02-01").cast("timestamp_ntz")), e, ["k"]))
    assert all(x.confidence == merging.CONFIDENCE[x.rule] and x.active and x.decided_by == "auto" for x in rows.collect())
    canonical = {x.entity_id: x.canonical_id for x in asof.canonical_ids(rows, "2024-03-01").collect()}
    up = {b: a for _, b, a in sequential(refs, entities)}
    for x in up:
        end = x
        while end in up:
            end = up[end]
        assert canonical[x] == end


def test_no_references(spark):
    r, e = tables(spark, {1: ("paper", datetime.datetime(2024, 1, 1), 1)}, [(1, 1), (1, 2)])
    assert merging.ordered_merges(r, e, ["k"]).count() == 0 == merging.ordered_merges(r.limit(0), e, ["k"]).count()
