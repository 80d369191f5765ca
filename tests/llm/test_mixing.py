import random
import re

import pytest
from pyspark.sql import functions as F

from driftline.llm import mixing


def brute_targets(size, weights=(1, 2, 3), cap=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(cap * size[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        share = {s: cap * size[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if s not in capped and share[s] > cap * size[s]}
        if not over:
            return share
        capped |= over


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w\x0b", "\tx\x1c", "yé"][: rng.randrange(1, 4)] * rng.randrange(0, 40)), rng.choice(sources)) for i in range(n)]
    return [*rows, (n, None, sources[0]), (n + 1, "", sources[0]), (n + 2, " \n", sources[-1]), (n + 3, "big " * 3000, sources[0])]


@pytest.mark.parametrize(("n", "sources"), [(900, ["b", "a", "a", "a", "a", None, "Z"]), (40, ["x", "y"]), (6000, ["hot"] * 30 + ["tiny", "é"])])
def test_targets_and_takes(spark, n, sources):
    rows = rows_of(n, n, sources)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("g", F.lit(1))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    total = {s: sum(size[i] for i in size if of[i] == s) for s in set(of.values())}
    target = brute_targets(total)
    assert len(got) == len(rows) and {r.doc_id: r.size for r in got} == size
    for r in got:
        assert r.source_size == total[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        rate = r.target / r.source_size
        assert r.taken == r.copies * r.size <= 3 * r.size and (r.size == 0 or int(rate) <= r.copies + 1e-6 <= rate + 1 + 1e-6)
    for s in total:
        taken = sum(r.taken for r in got if of[r.doc_id] == s)
        assert abs(taken - target[s]) <= max(size[i] for i in size if of[i] == s) + 1e-6


def test_takes_are_unbiased(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    sums = [0] * 60
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed).collect():
            sums[r.doc_id] += r.copies
    rate = {r.doc_id: r.target / r.source_size for r in mixing.mix(docs).collect()}
    for parity in (0, 1):
        ids = range(parity, 60, 2)
        assert sum(sums[i] for i in ids) / 12 / 30 == pytest.approx(rate[parity], abs=0.06)


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, "a b", "s")] * 3, "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(docs, identity=F.md5("text")).collect()] == [2, 2, 2]


def test_rows_without_words_meet_in_no_group(spark, monkeypatch):
    held, real = [], mixing.checkpoint

    def seen(df):
        out = real(df)
        if "units" in out.columns:
            held.append(out.selectExpr("coalesce(max(size(units)), 0) AS n").first().n)
        return out

    monkeypatch.setattr(mixing, "checkpoint", seen)
    rows = [(i, "a b c", "s") for i in range(5)] + [(10 + i, None if i % 2 else " ", "s") for i in range(2000)] + [(None, "", "t")] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), identity=F.col("source")).collect()
    assert held and max(held) <= 4 * mixing.FAN
    assert len(got) == len(rows) and all(r.copies == r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) == sum(r.size for r in got) == 15


def test_rows_of_one_id_are_dealt_over_groups(spark, monkeypatch):
    """10,000 rows of one id and as many without one, all of one text: no group gets them all."""
    held, real = [], mixing.checkpoint

    def seen(df):
        out = real(df)
        if "units" in out.columns:
            held.append(out.selectExpr("coalesce(max(size(units)), 0) AS n").first().n)
        return out

    monkeypatch.setattr(mixing, "checkpoint", seen)
    docs = spark.range(30_000).selectExpr("CASE WHEN id < 10000 THEN 7 WHEN id < 20000 THEN NULL ELSE id END AS doc_id", "'a b c' AS text", "CASE WHEN id % 3 = 0 THEN 's' ELSE 't' END AS source")
    got = mixing.mix(docs)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert got.count() == 30_000 and held and max(held) <= 8 * mixing.FAN
    for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect():
        assert abs(r.taken - r.target) <= 3 and r.most <= 3
    assert sorted(map(tuple, mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies")).collect()), key=str) == sorted(map(tuple, got.groupBy("doc_id").agg(F.sum("copies")).collect()), key=str)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 2_000_000, "s"), (2, "w", "s")], "doc_id long, text string, source string")
    assert sorted((r.size, r.taken) for r in mixing.mix(docs).collect()) == [(1, 1), (2_000_000, 2_000_000)]


def test_other_splits_of_rows_that_crowd_a_group(spark):
    """3,000 equal rows, some of them apart in what is kept beside them, among others of their source."""
    rows = [(1, "a b c", "s", "xy"[i % 2]) for i in range(3000)] + [(None, "d e", "s", None)] * 700 + [(10 + i, "w " * (1 + i % 50), "s", "z") for i in range(497)] + [(9000 + i, "v " * 30, "t", "z") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    runs = [mixing.mix(docs.repartition(k), identity=F.col("kept")) for k in (1, 7)]
    one, seven = (sorted(((r.doc_id, r.size, r.taken, r.copies, r.identity) for r in x.collect()), key=str) for x in runs)
    assert len(one) == len(rows) and one == seven


def test_what_a_source_takes_is_off_by_a_short_row_only(spark):
    """Sources of long rows and a few short ones: the row left last is not a long one."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 500), "abc"[i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.percentile_approx("size", 0.25).alias("short")).collect():
        assert abs(r.taken - r.target) < r.short
