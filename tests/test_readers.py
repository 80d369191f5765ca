"""Landed files of each source against the drafts that they must give."""

import json

from pyspark.sql import functions as F

from driftline.sources import landed, readers


def written(tmp_path, name, *records):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return f"file://{path}"


def drafts(df):
    return sorted((r.source_event_uid, r.event_type, str(r.occurred_at), json.loads(r.payload)) for r in df.collect())


def test_repositories(spark, tmp_path):
    repo = {"id": 7, "full_name": "a/b", "fork": False, "stargazers_count": 3, "forks_count": 1, "created_at": "2024-01-02T00:00:00Z"}
    page = written(tmp_path, "s.json", {"items": [repo, repo, {**repo, "id": 8, "fork": True}, {**repo, "id": 9, "fork": None}]})
    assert [d[0] for d in drafts(readers.found_repositories(spark, page))] == ["repo_discovered:7", "repo_discovered:9"]
    polled = written(tmp_path, "t.json", repo, {**repo, "id": 8})
    got = drafts(readers.tracked_repositories(spark, polled, "2024-02-03 04:05:06"))
    assert [d[0] for d in got] == ["repo:7:2024-02-03", "repo:8:2024-02-03"] and got[0][3]["stars"] == 3


def test_stories_of_a_window(spark, tmp_path):
    hit = lambda i, at, points, url=None, title="x": {"objectID": str(i), "created_at_i": at, "points": points, "url": url, "title": title}
    t = 1_704_067_200  # 2024-01-01
    page = written(tmp_path, "h.json", {"hits": [hit(1, t, 50), hit(2, t - 1, 50), hit(3, t + 86_400, 50), hit(4, t + 5, 1), hit(5, t + 5, 1, "https://www.github.com/a/b"), hit(6, t + 5, None, None, "An LLM thing")]})
    keep = landed.relevant_story(10, ["github.com"], ["llm"])
    assert [d[0] for d in drafts(readers.stories(spark, page, "2024-01-01", "2024-01-02", keep))] == ["1", "5", "6"]


def test_papers(spark, tmp_path):
    entry = lambda i, day: f"<entry><id>http://arxiv.org/abs/{i}</id><published>{day}T10:00:00Z</published><title> T </title><summary>S</summary><author><name>A B</name></author><author><name>C</name></author><category term=\"cs.AI\"/></entry>"
    feed = f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{entry("2401.00001v2", "2024-01-01")}{entry("2401.00002v1", "2024-01-05")}{entry("2312.00003v1", "2023-12-31")}</feed>'
    path = written(tmp_path, "f.xml", feed)
    got = drafts(readers.papers(spark, path, "2024-01-01", "2024-01-05"))
    assert [d[0] for d in got] == ["2401.00001"] and got[0][3]["version_id"] == "2401.00001v2"
    assert got[0][3]["authors"] == ["A B", "C"] and got[0][3]["categories"] == ["cs.AI"] and got[0][3]["title"] == "T"
    assert len(drafts(readers.papers(spark, path))) == 3


def test_models_cards_and_packages(spark, tmp_path):
    model = lambda i, at, n, tag="text-generation": {"id": i, "createdAt": at, "downloads": n, "pipeline_tag": tag}
    path = written(tmp_path, "m.json", model("o/a", "2024-01-01T00:00:00Z", 500), model("o/b", "2024-01-09T00:00:00Z", 500), model("o/c", "2024-01-02T00:00:00Z", 5), model("o/d", "2024-01-02T00:00:00Z", 900, "other"), model("o/e", None, 900))
    assert [d[0] for d in drafts(readers.models(spark, path, "2024-01-01", "2024-01-08", 100, ("text-generation",)))] == ["model_discovered:o/a"]
    assert len(drafts(readers.models(spark, path, origin="backfill"))) == 4
    assert drafts(readers.tracked_models(spark, path, "2024-02-01"))[0][0] == "model:o/a:2024-02-01"
    files = spark.createDataFrame([("o/a", "---\nx: 1\n---\n# Card"), ("o/b", "---\nx: 1\n---\n"), ("o/c", None)], "name string, text string")
    assert [(d[0], d[3]["text"]) for d in drafts(readers.cards(files, "2024-01-01"))] == [("model_readme:o/a", "# Card")]
    path = written(tmp_path, "p.json", {"package": "My_Pkg", "data": {"last_week": 9}}, {"package": "none", "data": {}})
    assert [(d[0], d[3]["downloads_7d"]) for d in drafts(readers.packages(spark, path, "2024-01-02"))] == [("pypi:my-pkg:2024-01-02", 9)]


def test_discussions_pages_and_edges(spark, tmp_path):
    long = "a comment that is long enough to be read &amp; kept "
    item = {"id": "1", "children": [{"text": "short"}, {"text": None}] + [{"text": f"<p>{long}{k}</p>"} for k in range(15)]}
    path = written(tmp_path, "d.json", item)
    got = drafts(readers.discussions(spark, path, "2024-01-01"))
    assert len(got) == 1 and got[0][3]["text"].split("\n\n") == [f"{long.replace('&amp;', '&')}{k}" for k in range(12)]
    pages = spark.createDataFrame([("My Launch", "<p>" + "word " * 30 + "</p>"), ("Short", "<p>x</p>")], "name string, html string")
    assert [d[0] for d in drafts(readers.launch_pages(pages, "2024-01-01"))] == ["launch_page:my-launch"]
    path = written(tmp_path, "e.json", {"src": "a", "dst": "b", "relation": "uses", "confidence": "EXTRACTED", "confidence_score": 0.9}, {"src": "a", "dst": "q", "relation": "uses", "confidence": "INFERRED", "confidence_score": 0.5}, {"src": "z", "dst": "a", "relation": "uses", "confidence": "EXTRACTED", "confidence_score": 1.0})
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("b", 5)], "label string, entity_id long")
    assert [tuple(r)[:2] for r in readers.semantic_edges(spark, path, ids, ("EXTRACTED",)).collect()] == [(1, 2)]


def test_backfills_versions_and_likes(spark, tmp_path):
    entry = lambda i: f"<entry><id>http://arxiv.org/abs/{i}</id><published>2024-01-02T00:00:00Z</published><title>t</title></entry>"
    feed = written(tmp_path, "f.xml", f"<feed>{entry('solv-int/9701001v1')}{entry('2401.00001v12')}{entry('math/0001v')}</feed>")
    got = readers.papers(spark, feed, origin="backfill").collect()
    assert {r.source_event_uid for r in got} == {"solv-int/9701001", "2401.00001", "math/0001v"} and {r.origin for r in got} == {"backfill"}
    hit = {"objectID": "1", "created_at_i": 1_704_067_200, "points": 3, "title": "x"}
    page = written(tmp_path, "h.json", {"hits": [hit]})
    assert readers.stories(spark, page, "2024-01-01", "2024-01-02", F.lit(True), "backfill").first().origin == "backfill"
    listed = written(tmp_path, "m.json", *({"id": n, "createdAt": "2024-01-02T00:00:00Z", "downloads": d, "likes": k, "pipeline_tag": "text"} for n, d, k in (("a", 1000, 0), ("b", 0, 10), ("c", 999, 9), ("d", None, None))))
    ids = lambda **o: {r.source_event_uid.removeprefix("model_discovered:") for r in readers.models(spark, listed, least_downloads=1000, **o).collect()}
    assert ids() == {"a"} and ids(least_likes=10) == {"a", "b"}
