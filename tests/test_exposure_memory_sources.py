import datetime as dt


from driftline.operators import exposure, memory
from driftline.sources import landed

D = dt.date(2024, 1, 1)


def test_exposure(spark):
    doc = lambda t, lines: ({"ticker": t, "name": t, "sector": "s", "revenue_lines": [{"id": i, "name": i, "share_of_revenue": x, "threat_surface": [{"category": c, "relation": r, "core": k} for c, r, k in surf]} for i, x, surf in lines]},)
    docs = spark.createDataFrame([doc("A", [("l1", 0.6, [("agents", "enables", False), ("agents", "enables", True)]), ("l2", 0.5, [("vision", "replaces", None)])]), doc("B", [("x", 0.2, [("agents", "odd", False)]), ("x", 0.1, [])])], f"doc {exposure.DOC}")
    links = {(r.category, r.ticker, r.revenue_line, r.relation): r.core for r in exposure.reach_links(docs).collect()}
    assert links == {("agents", "A", "l1", "enables"): True, ("vision", "A", "l2", "replaces"): False, ("agents", "B", "x", "odd"): False}
    assert {(r.ticker, r.problem) for r in exposure.problems(docs, ["agents", "vision"], ["enables", "replaces"]).collect()} == {("A", "shares"), ("B", "line ids"), ("B", "relation")}
    reach = exposure.category_reach(docs, {"enables": ["demand"], "replaces": ["price", "volume"]})
    got = {r.category: r for r in reach.collect()}
    assert got["agents"].n_lines == 2 and got["agents"].core and got["agents"].allowed == ["demand"] and got["vision"].allowed == ["price", "volume"]
    briefs = spark.createDataFrame([(1, "vision", "A", "l2", "price", "one two three four"), (2, "vision", "A", "zz", "price", "a b c d"), (3, "vision", "A", "l2", "demand", "a b c d"), (4, "vision", "A", "l2", "price", "too few"), (5, None, "A", "l2", "price", None)], "id long, category string, ticker string, revenue_line string, mechanism string, counter_mechanism string")
    assert {r.id: r.problem for r in exposure.brief_problems(briefs, reach).collect()} == {1: None, 2: "line not in map", 3: "mechanism", 4: "counter-argument", 5: "line not in map"}


def test_memory(spark):
    values = spark.createDataFrame([(1, "m", D, 10.0), (1, "m", D + dt.timedelta(9), 12.0), (1, "k", D, 1.0), (2, "m", D, 5.0), (2, "m", D + dt.timedelta(3), 5.1)], "entity_id long, metric string, day date, value double")
    said = spark.createDataFrame([(1, "m", "up", 30), (1, "k", "up", 30), (2, "m", "up", 5), (2, "m", "up", 90)], "entity_id long, metric string, direction string, horizon_days int")
    out = memory.observables(said, memory.metric_history(values, "2024-01-01", "2024-01-31"), 10)
    assert sorted((r.entity_id, r.horizon_days, r.status) for r in out.collect()) == [(1, 30, "met"), (1, 30, "no_data"), (2, 5, "missed"), (2, 90, "pending")]
    assert {r.entity_id: r.summary for r in memory.roll_up(out, "entity_id").collect()} == {1: "1 met, 1 no_data", 2: "1 missed, 1 pending"}
    t = lambda n: dt.datetime(2024, 1, n)
    ev = spark.createDataFrame([(1, i, t(i), "hn", "story" if i != 2 else "repo_snapshot", f"u{i % 3}", "t") for i in range(1, 8)], "entity_id long, id long, occurred_at timestamp_ntz, source string, event_type string, url string, title string")
    assert memory.timeline(ev, last=2).first().text == "2024-01-06 hn/story\n2024-01-07 hn/story"
    assert sorted(r.id for r in memory.evidence(ev, newest=5, shown=2).collect()) == [6, 7]
    st = spark.createDataFrame([(1, D, "simmering"), (1, D + dt.timedelta(1), "breakout")], "entity_id long, day date, state string")
    assert [memory.reached(st, 1, "accelerating", d).first().passed for d in ("2024-01-01", "2024-01-02")] == [False, True]
    ent = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "anchor_key string, canonical_id long")
    assert [memory.one_entity(ent, x).first().passed for x in (["a", "b"], ["a", "c"], ["a", "z"])] == [True, False, False]
    gate = spark.createDataFrame([(1, "pass")], "entity_id long, decision string")
    assert memory.decided(gate, 1, "pass").first().passed and memory.decided(gate, 2, "pass", present=False).first().passed


def test_sources(spark):
    assert [r.stamp for r in landed.hours(spark, "2024-01-01 22:00:00", "2024-01-02 01:00:00").collect()] == ["2024-01-01-22", "2024-01-01-23", "2024-01-02-0"]
    at = dt.datetime(2024, 1, 1)
    rec = spark.createDataFrame([("1", "WatchEvent", at, (7, "Org/A"), ("u",), (None,)), ("2", "CreateEvent", at, (8, "x/B"), ("u",), ("repository",)), ("3", "CreateEvent", at, (8, "x/B"), ("u",), ("branch",)), ("4", "WatchEvent", at, (9, "no/no"), ("u",), (None,)), ("1", "WatchEvent", at, (7, "Org/A"), ("u",), (None,))], landed.ARCHIVE)
    got = {r.source_event_uid: (r.event_type, r.payload) for r in landed.archive_events(rec, spark.createDataFrame([("org",), ("x/b",), ("org/a",)], "target string")).collect()}
    assert got == {"star:org/a:1": ("repo_star", '{"repo":"org/a","actor":"u"}'), "repo_discovered:8": ("repo_discovered", '{"full_name":"x/b"}')}
    ranks = spark.createDataFrame([("code", [("2024-01-07", {"m/a": 5, "m/b:free": 3, "Others": 9})])], landed.RANKINGS)
    models = spark.createDataFrame([("m/a", "A", "h/a"), ("m/b", "B", None)], "slug string, name string, hugging_face_id string")
    assert {(r.slug, r.tokens, r.name) for r in landed.ranking_rows(ranks, models).collect()} == {("m/a", 5, "A"), ("m/b:free", 3, "B")}
    st = spark.createDataFrame([(1, 60, None, "x"), (2, 1, "https://blog.lab.org/x", "x"), (3, None, None, "an LLM"), (4, 1, "https://notlab.org", None)], "id long, points int, url string, title string")
    assert {r.id for r in st.where(landed.relevant_story(50, ["lab.org"], ["llm"])).collect()} == {1, 2, 3}
    seeds = spark.createDataFrame([("n", "project", "c", {"github": "o/n", "hf": "o/m"})], "name string, entity_type string, category string, anchors map<string,string>")
    assert sorted(r.source_event_uid for r in landed.seed_events(seeds, "2024-01-01").select("source_event_uid").collect()) == ["seed:github:o/n", "seed:hf:o/m"]
