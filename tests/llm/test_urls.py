import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftline.llm import urls


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    k = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(v, h, p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2])) if fits else None


EDGE = [None, "", "x", "http://", "a://B.Com/en/7?x=1&y=2#z", "https://example.com/en/7", "https://EXAMPLE.com/en/8", "ftp://com/en/", "x://telecom/en/", "http://u.net/de/8", "http://example.net/de/81", "http://a.org/es/?q#/de/", "http://h?a://b", "http://h#f", "no/en/://org/es/", "http://É.ORG/es/1\n2", "http://h/" + "9" * 50_000]


def rows():
    rng = random.Random(1)
    made = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['a', 'bc', 'example'])}.{rng.choice(['com', 'net', 'org', 'info'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(99999)}{rng.choice(['', '.html', '?p=1', '?a=1&b=2', '#t'])}" for _ in range(800)]
    return list(enumerate(EDGE + made + made[:5]))


def test_rules_and_verdicts(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash")).repartition(3)
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, url in rows():
        host, path, rule = brute(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2]), url
        assert r.verdict == (rule[0] if rule else "block" if r.block_probability >= 0.5 else "allow")
    again = {r.page_id: r for r in urls.judge(pages.repartition(5)).collect()}
    assert again == got


def test_features(spark):
    pages = spark.createDataFrame(rows()[:200], "page_id long, url string")
    host, path = urls.parts(F.col("url"))
    for r in urls.lexical(pages.withColumn("host", host).withColumn("path", path)).collect():
        u = r.url or ""
        counts = Counter(u)
        assert r.f_length == len(u) and r.f_depth == r.path.count("/")
        assert r.f_digit_ratio == pytest.approx(sum(c in "0123456789" for c in u) / len(u) if u else 0)
        assert r.f_entropy == pytest.approx(-sum(k / len(u) * math.log2(k / len(u)) for k in counts.values()) if u else 0)


def test_trees_learn_what_features_tell(spark):
    rng = random.Random(2)
    made = [(i, f"http://{'x' * rng.randrange(1, 60)}.info/{'7' * rng.randrange(0, 9)}") for i in range(1500)]
    pages = spark.createDataFrame(made, "page_id long, url string")
    host, path = urls.parts(F.col("url"))
    all_rows = urls.lexical(pages.withColumn("host", host).withColumn("path", path))
    truth = F.when(F.col("f_length") >= 45, "block").otherwise("allow")
    seen = all_rows.withColumn("verdict", F.when(F.col("page_id") < 1000, truth))
    model = urls.train(seen)
    scored = urls._shared(all_rows, model.labels, model.files, model.mean).where("page_id >= 1000").withColumn("p", urls.margin(model.bias, model.trees) > 0).withColumn("t", truth == "block")
    assert scored.agg(F.avg((F.col("p") == F.col("t")).cast("double"))).first()[0] > 0.98


def test_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.info/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages).collect()] == ["allow", "allow"]
    assert urls.judge(pages.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/en/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages).orderBy("page_id").collect()] == ["block", "block"]
