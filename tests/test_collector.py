import json

import pytest

from driftline.sources import collector, ingest


def land(root, day, name, *records, kind="contributors"):
    folder = root / kind / day
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records))


def repo(name, *logins):
    return {"full_name": name, "contributors": [{"login": x, "contributions": k + 1} for k, x in enumerate(logins)]}


@pytest.fixture
def pages(spark, tmp_path):
    spark.dataSource.register(collector.Landed)
    root = tmp_path / "pages"
    land(root, "2024-01-01", "a.json", repo("a/b", "ann", "bob"), "{broken", {"full_name": "no/list"}, {"full_name": "a/none", "contributors": []}, {"full_name": "gone", "contributors": {"message": "404"}}, "[1]", repo("é/日", "zoë"))
    land(root, "2024-01-31", "a.json", repo("c/d", *(f"u{k}" for k in range(50))))
    land(root, "2024-01-31", "b.json", repo("e/f", "ann"))
    land(root, "2024-03-01", "a.json", repo("g/h", "cy"), {"full_name": "x/anon", "contributors": {}})
    return root


def reader(spark, root, **options):
    return spark.read.format("landed").option("path", str(root)).option("kind", "contributors").options(**options)


def rows(df):
    return sorted((r.source_event_uid.removeprefix("repo_contributors:"), str(r.occurred_at)[:10], r.payload) for r in df.collect())


def test_batch_reads_a_half_open_window_in_chunks(spark, pages):
    every = reader(spark, pages).load()
    assert [r[:2] for r in rows(every)] == [("a/b", "2024-01-01"), ("c/d", "2024-01-31"), ("e/f", "2024-01-31"), ("g/h", "2024-03-01"), ("é/日", "2024-01-01")]
    assert every.rdd.getNumPartitions() == 3 and reader(spark, pages, chunk_days="31").load().rdd.getNumPartitions() == 2
    part = reader(spark, pages, since="2024-01-01", until="2024-03-01", chunk_days="1").load()
    assert [r[0] for r in rows(part)] == ["a/b", "c/d", "e/f", "é/日"] and part.rdd.getNumPartitions() == 2
    assert rows(reader(spark, f"file://{pages}").load()) == rows(every)
    payload = json.loads(next(r[2] for r in rows(every) if r[0] == "c/d"))
    assert len(payload["contributors"]) == collector.CONTRIBUTORS and payload["contributors"][0] == {"login": "u0", "contributions": 1}


def test_chunks_go_from_the_newest(pages):
    found = collector._Pages({"path": str(pages), "kind": "contributors", "chunk_days": "31"})
    assert [c.days for c in found.chunks(found.landed())] == [("2024-01-31", "2024-03-01"), ("2024-01-01",)]


def test_stream_gives_what_batch_gives_also_after_a_restart(spark, pages, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def go():
        stream = spark.readStream.format("landed").option("path", str(pages)).option("kind", "contributors").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    go()
    assert rows(spark.read.parquet(out)) == rows(reader(spark, pages).load())
    go()  # nothing has landed since
    assert len(rows(spark.read.parquet(out))) == 5
    land(pages, "2024-03-02", "a.json", repo("i/j", "dee"))
    go()
    assert rows(spark.read.parquet(out)) == rows(reader(spark, pages).load())


def test_drafts_are_ingested_once(spark, pages):
    found = reader(spark, pages).load()
    stored = ingest.insert_new(found.limit(0), found, ["source", "source_event_uid"])
    assert ingest.insert_new(stored, found.unionByName(found), ["source", "source_event_uid"]).count() == 5


def test_other_collectors_and_empty_folders(spark, pages):
    land(pages, "2024-01-05", "a.json", {"info": {"name": "pkg", "version": "1", "requires_dist": ["numpy>=1"]}}, {}, kind="package_metadata")
    land(pages, "2024-01-05", "a.json", {"id": "m/x", "name": "X", "pricing": {"prompt": "1"}}, kind="listed_models")
    got = reader(spark, pages).option("kind", "package_metadata").load().collect()
    assert [(r.source, json.loads(r.payload)["requires_dist"]) for r in got] == [("pypi", ["numpy>=1"])]
    assert reader(spark, pages).option("kind", "listed_models").load().first().source_event_uid == "or_listing:m/x"
    assert reader(spark, pages / "nothing").load().count() == 0
    with pytest.raises(Exception, match="no collector"):
        reader(spark, pages).option("kind", "other").load().count()
