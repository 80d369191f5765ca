import datetime as dt

from driftline.plans import reads

D = dt.date(2024, 1, 1)
T = dt.datetime(2024, 1, 1)


def test_reads(spark):
    entities = spark.createDataFrame([(i, f"tool {i}", "project", "c" if i < 9 else "d", "t", T + dt.timedelta(days=i)) for i in range(1, 11)], "entity_id long, name string, entity_type string, category string, theme string, created_at timestamp_ntz")
    states = spark.createDataFrame([(1, D, "breakout", 0.9, False), (2, D, "breakout", 0.99, False), (3, D, "simmering", 0.7, False), (3, D + dt.timedelta(9), "breakout", 1.0, False)], "entity_id long, day date, state string, p double, hype boolean")
    stream = spark.createDataFrame([(1, "hn"), (1, "github"), (2, "hn")], "entity_id long, source string")
    cards = spark.createDataFrame([(1, 1, "ok"), (1, 2, "pending")], "entity_id long, version int, status string")
    decisions = spark.createDataFrame([(1, D, "pass", 0.5), (2, D, "budget", 0.4)], "entity_id long, week date, decision string, score double")
    args = entities, states, stream, cards, decisions, "2024-01-05 00:00:00"
    top = reads.radar(*args, limit=4).collect()
    assert [r.entity_id for r in top] == [2, 1, 3, 10] and top[1].sources == ["github", "hn"] and not top[1].has_card and top[1].gated
    assert [r.entity_id for r in reads.radar(*args, source="github").collect()] == [1]
    assert [r.entity_id for r in reads.radar(*args, gated=True).collect()] == [1] and reads.radar(*args, theme="none").count() == 0
    assert [r.entity_id for r in reads.search(entities, "TOOL 7", limit=2).collect()][0] == 7
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "src long, dst long")
    nodes, kept = reads.neighbourhood(edges, entities, 1)
    assert {r.node for r in nodes.collect()} == {1, 2, 3, 5} and kept.count() == 3
    assert reads.fingerprint(edges).first() == reads.fingerprint(edges.union(edges).repartition(3)).first()
    near = {}
    for r in reads.similar_entities(entities, entities.where("entity_id IN (1, 9)"), 3).collect():
        near.setdefault(r.entity_id, set()).add(r.other)
    assert near == {1: {8, 7, 6}, 9: {10}}
    members = spark.createDataFrame([(1, 1), (1, 2)], "wave_id long, entity_id long")
    found = spark.createDataFrame([(1, 0.5), (2, 0.9)], "wave_id long, strength double")
    leads, outcomes = spark.createDataFrame([(1, 5)], "wave_id long, lead_days int"), spark.createDataFrame([(2, "faded")], "wave_id long, verdict string")
    assert [(r.wave_id, r.n_members, r.max_lead) for r in reads.waves(found, members, leads, outcomes).collect()] == [(2, None, None), (1, 2, 5)]
    assert [r.wave_id for r in reads.waves(found, members, leads, outcomes, min_lead=3).collect()] == [1]
    vocabulary = spark.createDataFrame([("t",), ("u",)], "theme string")
    assert [tuple(r) for r in reads.themes(vocabulary, members, entities).collect()] == [("t", 1), ("u", 0)]
    assert [(r.entity_id, r.of_kind) for r in reads.gate_week(decisions, "2024-01-01").collect()] == [(1, 1), (2, 1)]
