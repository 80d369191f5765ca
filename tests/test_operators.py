"""Operators against sequential restatements of what they compute."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import asof, decide, graph, series
from driftline.operators.components import connected_components
from driftline.sources import ingest

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def test_hysteresis_is_a_clamp(spark):
    rng = random.Random(1)
    keys = {k: [rng.randrange(4) for _ in range(rng.randrange(1, 40))] for k in range(60)}
    df = spark.createDataFrame([(k, day(i), t) for k, ts in keys.items() for i, t in enumerate(ts)], "k long, day date, raw_tier int")
    got = {(r.k, r.day): r.smoothed_tier for r in series.hysteresis(df, "k").collect()}
    for k, ts in keys.items():
        now = 0
        for i in range(len(ts)):
            low = min(ts[i - 1 : i + 1]) if i >= 1 else 0
            high = max(ts[i - 6 : i + 1]) if i >= 6 else 3
            now = max(low, min(high, now))
            assert got[k, day(i)] == now


def test_cohort_rank_counts_absent_members_as_zero(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(40):
        n = rng.randrange(1, 9)
        values = [rng.choice([-1, 0, 0, 1, 2, 5]) for _ in range(rng.randrange(1, n + 1))]
        dense = values + [0] * (n - len(values))
        for i, v in enumerate(values):
            rows.append((c, i, float(v), n))
            want[c, i] = sum(x < v for x in dense) / (n - 1) if n > 1 else 0.0
    df = spark.createDataFrame(rows, "c long, i long, value double, n long")
    got = {(r.c, r.i): r.pctl for r in series.cohort_percent_rank(df, ["c"], "n").collect()}
    assert got == pytest.approx(want)


def test_canonical_chains_follow_what_was_justified(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    merges = spark.createDataFrame([(1, 2, t(1), True), (2, 3, t(5), True), (3, 4, t(2), False), (9, 1, t(3), True)], "loser_id long, survivor_id long, justified_at timestamp_ntz, active boolean")
    at = lambda d: {r.entity_id: r.canonical_id for r in asof.canonical_ids(merges, d).collect()}
    assert at("2024-01-04 00:00:00") == {1: 2, 9: 2}
    assert at("2024-01-06 00:00:00") == {1: 3, 2: 3, 9: 3}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_fills_lags_and_crossings(spark):
    s = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 3.0), ("a", day(9), 9.0)], "k string, day date, value double")
    filled = sorted((r.day, r.value) for r in series.forward_fill(s, ["k"], 3, "2024-01-11").collect())
    assert filled == [(day(0), 1.0), (day(1), 1.0), (day(2), 3.0), (day(3), 3.0), (day(4), 3.0), (day(5), 3.0), (day(9), 9.0), (day(10), 9.0)]
    assert sorted((r.day, r.value) for r in series.change_since(s, ["k"]).collect()) == [(day(0), 1.0), (day(2), 3.0), (day(9), 6.0)]
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    e = spark.createDataFrame([("x", "o1", t(1)), ("x", "o2", t(5)), ("x", "o3", t(12)), ("x", "o1", t(13)), ("x", "o2", t(14)), ("y", "o1", t(1))], "k string, org string, at timestamp_ntz")
    assert [(r.k, r.crossed_at) for r in series.threshold_crossing(e, "k", "org", "at", 7, 3).collect()] == [("x", t(14))]


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(4)
    names = [(i, " ".join(rng.choice(["alpha", "alpine", "beta", "betamax", "gamma"]) for _ in range(rng.randrange(1, 4)))) for i in range(80)] + [(90, None), (91, "")]
    df = spark.createDataFrame(names, "id long, name string")
    sets = {r.id: set(r.s) for r in df.select("id", text.trigrams(F.col("name")).alias("s")).collect() if r.s}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in graph.trigram_pairs(df, "id", "name", 0.6).collect()} == want


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_name, "My_Cool-Tool.py", "my cool tool"),
        (text.normalize_name, "ai", "ai"),
        (text.slugify, " Ada Lovelace! ", "ada-lovelace"),
        (text.requirement_name, "Py_Torch[cuda]>=2.0; extra", "py-torch"),
        (text.base_model, "base_model:quantized:Org/M-7B", "org/m-7b"),
        (text.base_model, "license:mit", None),
        (text.claim_date, "+2022-05-00T00:00:00Z", dt.date(2022, 5, 1)),
        (text.claim_date, "soon", None),
        (text.parse_iso_week, "2026-W28", dt.date(2026, 7, 6)),
        (text.strip_frontmatter, "---\na: b\n---\nbody", "body"),
        (text.html_to_text, "<p>A &amp; b</p><script>x()</script><!-- c --> <b>d</b>", "A & b d"),
        (text.normalize_repo, "/Org/Name.git", "org/name"),
    ],
)
def test_text_functions(spark, f, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://github.com/Org/Repo.git/tree/main", ("github", "org/repo")),
        ("https://arxiv.org/abs/2401.01234v2", ("arxiv", "2401.01234")),
        ("https://huggingface.co/org/Model", ("hf", "org/Model")),
        ("https://huggingface.co/datasets/org", None),
        ("https://pypi.org/project/My_Pkg/", ("pypi", "my-pkg")),
        ("https://example.com/x", None),
        (None, None),
    ],
)
def test_url_anchor(spark, url, want):
    got = spark.createDataFrame([(url,)], "x string").select(text.url_anchor(F.col("x")).alias("y")).first().y
    assert (tuple(got) if got else None) == want


def test_ingest(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    drafts = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, ingest.insert_new(stored, drafts, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, ingest.upsert(stored, drafts.distinct(), ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "c")]


def test_decisions(spark):
    rows = spark.createDataFrame([(1, 5.0, True), (2, 5.0, True), (3, 9.0, False), (4, 1.0, None)], "k long, s double, ok boolean")
    assert {r.k: r.decision for r in decide.top_under_budget(rows, "s", "k", 1, eligible=F.col("ok")).collect()} == {1: "pass", 2: "budget", 3: "ineligible", 4: "ineligible"}
    x = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (4.0, 3.0)], "a double, b double")
    assert [r.c for r in x.select(decide.percent_change(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, -0.25]


def test_merges_in_a_circle_and_losers_listed_twice(spark):
    rows = [(1, 2, "2024-01-01", True), (2, 1, "2024-01-02", True), (5, 1, "2024-01-01", True), (7, 8, "2024-01-01", True), (7, 9, "2024-01-03", True), (4, 4, "2024-01-01", True)]
    merges = spark.createDataFrame(rows, "loser_id long, survivor_id long, justified_at string, active boolean").withColumn("justified_at", F.col("justified_at").cast("timestamp_ntz"))
    got = {r.entity_id: r.canonical_id for r in asof.canonical_ids(merges, "2024-02-01 00:00:00").collect()}
    assert got[1] == got[2] and got[5] in (1, 2) and got[7] == 9 and 4 not in got


def test_events_of_other_origins_do_not_count(spark):
    rows = [(1, "live", "2024-01-01"), (2, "backfill", "2024-01-01"), (3, "seed", "2024-01-01"), (4, "live", "2024-03-01")]
    events = spark.createDataFrame(rows, "id long, origin string, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    assert sorted(r.id for r in asof.events_asof(events, "2024-02-01 00:00:00").collect()) == [1, 2]


def test_entities_are_read_as_the_standard_library_does(spark):
    import html

    samples = ["a&amp;lt;b", "&lt;p&gt; &eacute;&#233;&#xE9;&#x1F600;", "&apos;x&nbsp;y&hellip;", "&unknown; & &; &#0;", "plain", None, "&amp;amp;#65; &#65;&amp;"]
    rows = spark.createDataFrame([(x,) for x in samples], "t string").select("t", text.unescaped(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r.u == (None if r.t is None else html.unescape(r.t) if "&#0;" not in r.t else r.t), r
    page = "<p>one</p><script>var a = 1;"
    assert spark.createDataFrame([(page,)], "t string").select(text.html_to_text(F.col("t"))).first()[0].strip() == "one"


@pytest.mark.parametrize("items,most", [(3, 3), (8, 4), (2000, 60)])
def test_largest_overlaps_equal_all_pairs(spark, items, most):
    """Few kinds of sets, so that blocks suffice, and mixed ones, which need all later blocks; nulls and repeats."""
    rng = random.Random(items)
    sets = {k: set(rng.sample(range(items), rng.randrange(1, most + 1))) for k in rng.sample(range(-50, 500), 120)}
    rows = [(k, f"i{x}") for k, s in sets.items() for x in s for _ in range(rng.randrange(1, 3))] + [(None, "i0"), (1000, None)]
    want = set()
    for a in sets:
        found = sorted((-len(sets[a] & sets[b]), b) for b in sets if b > a and sets[a] & sets[b])[:3]
        want |= {(a, b, -n) for n, b in found}
    df = spark.createDataFrame(rows, "k long, item string")
    for block in (16, graph.BLOCK):
        assert sorted(map(tuple, graph.top_overlaps(df, "k", "item", 3, block).collect())) == sorted(want)
    assert graph.top_overlaps(df.limit(0), "k", "item", 3).count() == 0


def test_largest_overlaps_of_one_hot_item_make_no_pairs_of_all(spark):
    """Sixty thousand keys with the same items: two billion pairs of which only neighbours are looked at."""
    df = spark.range(60_000).selectExpr("id AS k", "explode(sequence(1, 25)) AS item")
    got = graph.top_overlaps(df, "k", "item", 3).agg(F.count("*"), F.max(F.col("b") - F.col("a")), F.min("shared")).first()
    assert tuple(got) == (3 * 60_000 - 6, 3, 25)


def test_trigram_pairs_of_common_names_are_dealt_in_chunks(spark):
    """Two names shared by many keys and one near them: every pair once, whatever the chunks, and no task has all of a name's."""
    names = [(i, ("hot bolts", "hot bolt", "cold gear")[min(i % 3, 2)]) for i in range(90)] + [(900, "hot bolt"), (None, "hot bolt")]
    df = spark.createDataFrame(names, "id long, name string")
    grams = {i: set(g) for i, g in df.where("id IS NOT NULL").select("id", text.trigrams(F.col("name"))).collect()}
    want = sorted((a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6)
    for chunk in (4, graph.CHUNK):
        assert sorted((r.a, r.b) for r in graph.trigram_pairs(df, "id", "name", 0.6, chunk).collect()) == want
