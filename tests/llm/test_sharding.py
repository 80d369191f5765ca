import random
import zlib

import pytest

from driftline.llm import sharding


def rows(n=500):
    rng = random.Random(1)
    out = [(i, rng.choice(["a", "bb", "ccc é", "", None]), "x", i) for i in range(n)]
    out += [(7, "hot", "x", 0)] * 900 + [(None, "a", "x", 0), (None, None, "x", 0), (3, "é" * 100_000, "x", 1)]
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, shard string, _place int"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 17, 64, 65, 1000, 12_345])
def test_permutation_and_inverse(spark, n):
    df = spark.range(n).withColumnRenamed("id", "x")
    there = [(r.y, r.x) for r in sharding.permute(df.selectExpr("x AS y", "x"), "x", n).collect()]
    assert sorted(x for _, x in there) == list(range(n))
    assert n < 60 or sum(x == y for y, x in there) < n / 10
    back = sharding.permute(spark.createDataFrame(there, "y long, x long"), "x", n, back=True).collect()
    assert all(r.x == r.y for r in back)
    assert n < 60 or there != [(r.y, r.x) for r in sharding.permute(df.selectExpr("x AS y", "x"), "x", n, seed=2).collect()]


def network(x, n, seed, spark):
    """Python's walk with hashes from Spark: the same rounds, one number at a time."""
    a, b = sharding.halves(n)
    while True:
        r, l = divmod(x, a)
        for k in range(sharding.ROUNDS):
            h = spark.sql(f"SELECT xxhash64({seed}, {k}, {l if k % 2 else r}L) AS h").first().h
            if k % 2:
                r = (r + h % b) % b
            else:
                l = (l + h % a) % a
        x = r * a + l
        if x < n:
            return x


def test_against_single_walks(spark):
    n = 11  # 4 * 3: one point outside
    got = {r.y: r.x for r in sharding.permute(spark.range(n).selectExpr("id AS y", "id AS x"), "x", n).collect()}
    assert got == {x: network(x, n, sharding.SEED, spark) for x in range(n)}


def result(df):
    return sorted(map(tuple, sharding.assign(df).collect()), key=lambda r: r[4:6])


def test_shards_and_slots(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = result(df.repartition(5))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    counts = [sum(r[4] == k for r in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(data)
    assert all([r[5] for r in got if r[4] == k] == list(range(counts[k])) for k in range(8))
    assert {r[3] for r in got} == {"rows"} and {r[6] for r in got} == {None}
    assert got == result(df.coalesce(1)) == result(spark.createDataFrame(data[::-1], SCHEMA).repartition(13))
    hot = [sum(r[4] == k and r[0] == 7 for r in got) for k in range(8)]
    assert min(hot) > 70  # equal rows spread over the shards


def test_numbers_follow_the_keys(spark):
    data = rows(200)
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted((r.number, r.row.doc_id) for r in sharding.shuffle(df).collect())
    assert [n for n, _ in got] == list(range(len(data)))
    ids = [i for _, i in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_lookup_finds_the_row_number(spark):
    df = spark.createDataFrame(rows(100), SCHEMA)
    got = sharding.shuffle(df)
    n = got.count()
    places = sharding.lookup(got.select("shard", "slot", got.number.alias("want")), n).collect()
    assert len(places) == n and all(r.number == r.want for r in places)


def test_written_shards_hold_whole_rows_in_order(spark, tmp_path):
    data = rows(50)
    df = spark.createDataFrame(data, SCHEMA).withColumnRenamed("shard", "a.b")
    sharding.write(df, str(tmp_path / "out"), shards=3, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 3
    assert sorted(map(str, ((r.row["doc_id"], r.row["text"], r.row["a.b"], r.row["_place"]) for r in back.collect()))) == sorted(map(str, data))


def test_empty_and_single(spark):
    df = spark.createDataFrame(rows(5), SCHEMA)
    assert sharding.assign(df.limit(0)).collect() == []
    one = sharding.assign(df.where("text = 'bb' or text is null").limit(1)).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
