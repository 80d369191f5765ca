"""Identity, edges, waves and streaming on small hand-made tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from driftline.operators import edges, identity, waves
from driftline.streaming import ingest

T = dt.datetime(2024, 1, 1)


def events(spark, rows):
    data = [(i + 1, s, k, T + dt.timedelta(days=d), json.dumps(p)) for i, (s, k, d, p) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, source string, event_type string, occurred_at timestamp_ntz, payload string")


ROWS = [
    ("github", "repo_discovered", 0, {"full_name": "Org/Tool", "description": "code for arxiv.org/abs/2401.00001"}),
    ("arxiv", "paper_published", -5, {"arxiv_id": "2401.00001", "title": "A Tool", "authors": ["Ada Lovelace", "B. C."], "comment": "code: https://github.com/org/tool."}),
    ("hf", "model_discovered", 3, {"id": "Org/Model", "tags": ["arxiv:2401.00001", "base_model:finetune:org/base"]}),
    ("hf", "model_discovered", 4, {"id": "org/base", "tags": []}),
    ("pypi", "pypi_metadata", 5, {"name": "tool", "requires_dist": ["Other_Pkg>=1", "numpy"], "project_urls": {"Source": "https://github.com/org/tool"}}),
    ("pypi", "pypi_snapshot", 6, {"name": "other-pkg", "downloads_7d": 5}),
    ("hn", "story", 7, {"title": "Show HN: Shiny Thing – a demo", "points": 150, "url": "https://shiny.example"}),
    ("hn", "story", 7, {"title": "Show HN: Shiny Thing – again", "points": 3}),
    ("openrouter", "or_model_listed", 8, {"name": "Lab: Shiny Thing (free)"}),
    ("github", "repo_contributors", 2, {"full_name": "org/tool", "contributors": [{"login": "Ann", "contributions": 9}]}),
    ("wikidata", "wikidata_entity", 9, {"anchor": {"registry": "github_user", "native_id": "ann"}, "entity_type": "person", "label": "Ann", "claims": {"P108": [{"qid": "Q1", "label": "Lab", "start": "+2020-00-00T00:00:00Z", "end": None}, {"qid": "Q2", "end": "+2019-05-01T00:00:00Z"}]}}),
]


def test_resolution_is_as_of(spark):
    ev = events(spark, ROWS)
    entities, links = identity.resolve(ev, "2024-02-01 00:00:00")
    rows = {r.anchor_key: r for r in entities.collect()}
    tool = rows["github:org/tool"]
    one = {"github:org/tool", "arxiv:2401.00001", "hf:org/model", "pypi:tool"}
    assert {k for k, r in rows.items() if r.canonical_id == tool.entity_id} == one  # the paper is older but never the survivor
    assert rows["web:shiny-thing"].name == "Shiny Thing" and links.where(F.col("entity_id") == rows["web:shiny-thing"].entity_id).count() == 2
    early, _ = identity.resolve(ev, "2024-01-02 00:00:00")
    assert {r.anchor_key for r in early.collect()} == {"github:org/tool", "arxiv:2401.00001"}
    refs = {(r.anchor_key, r.target_key, r.rule) for r in identity.references(ev).collect()}
    assert refs == {("github:org/tool", "arxiv:2401.00001", "R1"), ("arxiv:2401.00001", "github:org/tool", "R2"), ("hf:org/model", "arxiv:2401.00001", "R2"), ("pypi:tool", "github:org/tool", "R3")}


def test_edges(spark):
    got = {(r.src_key, r.edge_type, r.dst_key): r for r in edges.derive(events(spark, ROWS)).collect()}
    want = {
        ("github:org/tool", "built_by", "github_user:ann"),
        ("arxiv:2401.00001", "authored_by", "person_name:ada-lovelace"),
        ("arxiv:2401.00001", "authored_by", "person_name:b-c"),
        ("pypi:tool", "depends_on", "pypi:other-pkg"),
        ("hf:org/model", "fine_tuned_from", "hf:org/base"),
        ("github:org/tool", "cited", "arxiv:2401.00001"),
        ("hf:org/model", "cited", "arxiv:2401.00001"),
        ("github_user:ann", "employed_by", "wikidata:Q1"),
        ("github_user:ann", "formerly_at", "wikidata:Q2"),
    }
    assert set(got) == want
    assert got["github_user:ann", "employed_by", "wikidata:Q1"].start_date == dt.date(2020, 1, 1)


def test_name_candidates_and_triage(spark):
    t = lambda d: T + dt.timedelta(days=d)
    rows = [(1, "project", "Fast Parser", t(0), 1), (2, "model", "fast-parser-py", t(10), 2), (3, "project", "fast parser", t(99), 3), (4, "project", "fastest parsers", t(0), 4), (5, "paper", "unrelated", t(0), 5), (6, "project", "fast_parser", t(0), 1)]
    entities = spark.createDataFrame(rows, "entity_id long, entity_type string, name string, created_at timestamp_ntz, canonical_id long")
    got = {(r.a, r.b): r.rule for r in identity.name_candidates(entities.withColumn("created_at", F.col("created_at").cast("timestamp"))).collect()}
    assert got[1, 2] == "R5" and got[1, 3] == "R4" and (1, 6) not in got and not any(5 in k for k in got)
    metrics = spark.createDataFrame([(1, "stars", 600.0), (2, "stars", 10.0), (5, "stars", 9000.0)], "entity_id long, metric string, value double")
    assert {r.entity_id: r.decision for r in identity.triage(entities, metrics, {"stars": 500}).collect()} == {1: "track", 2: "skip", 3: "deferred", 4: "deferred", 5: "skip", 6: "deferred"}
    texts = spark.createDataFrame([(1, "an agent", t(0)), (1, "nothing", t(1)), (1, "vision models", t(2)), (1, "vision", t(3))], "entity_id long, text string, occurred_at timestamp_ntz")
    assert [(r.category, r.effective_at) for r in identity.category_history(texts, {"agents": ["agent"], "vision": ["vision"]}).orderBy("effective_at").collect()] == [("agents", t(0)), ("vision", t(2))]


def test_convergence_wave(spark):
    day = lambda n: dt.date(2024, 3, n)
    young = [(i, day(i), "a" if i < 4 else "b") for i in range(1, 7)]
    old = [(100 + i, dt.date(2023, 1, 1), "shared") for i in range(1, 7)]
    entities = spark.createDataFrame(young + old + [(50, day(2), "c")], "entity_id long, first_seen date, category string")
    labels = entities.select("entity_id", F.concat(F.lit("n"), "entity_id").alias("name"), "category")
    graph = spark.createDataFrame([(i, 100 + i) for i in range(1, 7)], "src long, dst long")
    none = lambda schema: spark.createDataFrame([], schema)
    breadth = spark.createDataFrame([(i, 2) for i in range(1, 7)], "entity_id long, breadth int")
    args = entities, graph, labels, breadth
    found, members = waves.detect(*args, none("entity_id long, person_id long"), none("entity_id long, owner string"), none("src long, dst long"), "2024-03-20 00:00:00")
    w = found.collect()
    assert [(r.wave, r.members, r.size, r.breadth, r.tightness) for r in w] == [(1, 6, 0.8, 1.0, round(1 - 5 / 30 * 0.7, 4))]
    assert {r.entity_id for r in members.collect()} == set(range(1, 7))
    owned = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o"), (4, None)], "entity_id long, owner string")
    found, _ = waves.detect(*args, none("entity_id long, person_id long"), owned, none("src long, dst long"), "2024-03-20 00:00:00")
    assert [r.members for r in found.collect()] == [4]
    before = spark.createDataFrame([(7, 1, day(1)), (7, 2, day(1)), (7, 99, day(1)), (8, 3, day(1)), (8, 98, day(1)), (8, 97, day(1))], "wave_id long, entity_id long, joined_at date")
    now = members.select(F.col("wave").alias("cluster"), "entity_id")
    assert [tuple(r) for r in waves.match(now, before.select("wave_id", "entity_id")).collect()] == [(1, 7)]
    after = waves.persist(now, before, "2024-03-20")
    assert {r.entity_id for r in after.where("wave_id = 7").collect()} == {1, 2, 3, 4, 5, 6, 99} and after.where("wave_id = 8").count() == 3
    found = spark.createDataFrame([(1, 10, T), (1, 11, T), (2, 10, T), (1, 12, dt.datetime(2025, 1, 1))], "entity_id long, raw_event_id long, occurred_at timestamp_ntz")
    seen = waves.observers(spark.createDataFrame([(7, 1, day(1)), (7, 2, day(1))], "wave_id long, entity_id long, detected date"), found)
    assert sorted(map(tuple, seen.collect())) == [(7, 10, 1, 60), (7, 11, 1, 60)]
    series = spark.createDataFrame([(e, d, v) for e, g in ((1, 2.0), (2, 3.0), (90, 1.5), (91, 9.0)) for d, v in ((day(1), 10.0), (day(10), 10.0 * g))], "entity_id long, day date, value double")
    peers = spark.createDataFrame([(7, 90), (7, 91)], "wave_id long, entity_id long")
    result = waves.outcomes(spark.createDataFrame([(7, 1), (7, 2)], "wave_id long, entity_id long"), series, peers, "2024-03-01", "2024-03-10", "2024-03-20").first()
    assert (result.growth, result.percentile, result.verdict) == (1.5, 0.5, "took_hold")


def test_streams_agree_with_batch(spark, tmp_path):
    from driftline.operators.series import hysteresis

    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), (i * (k + 3) * 7 // 5) % 4) for k in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "entity_id long, day date, raw_tier int")
    for part, (a, b) in enumerate(((1, 10), (10, 26))):
        df.where(F.dayofmonth("day").between(a, b - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = ingest.hysteresis(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in hysteresis(df, "entity_id").select("entity_id", "day", "smoothed_tier").collect()}
    assert got == want and len(got) == 100
