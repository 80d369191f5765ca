import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import media


def rolled(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = random.Random(1).randbytes(500)
    assert media.gear(data).tolist() == rolled(data)
    assert media.gear(b"a").tolist() == rolled(b"a")


def test_cuts_follow_content():
    data = random.Random(2).randbytes(400_000)
    ends = media.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(media.LEAST <= n <= media.MOST for n in sizes[:-1]) and len(ends) > 5
    moved = media.cuts(b"x" * 1000 + data)
    assert len({e - 1000 for e in moved} & set(ends)) >= len(ends) - 3
    assert sum(b - a for a, b in zip([0, *media.cuts(bytes(500_000))], media.cuts(bytes(500_000)))) == 500_000


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    words = "abc def ghij é ü klm".split()
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "a" * 576), (4, "a" * 575), (5, long), (6, long), (7, "x" + long), (7, "x" + long), (8, long + "y"), (None, "é")] + [(100 + i, "same") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pack", F.lit(0)).withColumn("part", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(4)
    got = media.payloads(docs, f"file://{tmp_path}/m").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    text, seen = dict(rows), {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        whole = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert seen.setdefault(text[r.doc_id] or "", r[5:]) == r[5:]
    packs = spark.read.parquet(f"file://{tmp_path}/m")
    media.compact(packs, f"file://{tmp_path}/c")
    small = spark.read.parquet(f"file://{tmp_path}/c")
    kept = small.select(F.explode("held").alias("digest"))
    assert kept.count() == kept.distinct().count() == media.holders(packs).count()
    assert small.where("size(held) <> size(bodies)").count() == 0
    assert {tuple(r) for r in media.read_back(small).collect()} == {tuple(r) for r in media.read_back(packs).collect()}


def test_damage_is_noticed():
    data = media.payload_of("abc")
    with pytest.raises(ValueError, match="stored"):
        media.features(data, [b""], b"0" * 32)


def test_no_rows(spark, tmp_path):
    assert media.payloads(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e").count() == 0


def test_passages_of_short_documents_are_shared():
    rng = random.Random(7)
    passage = rng.randbytes(6000)
    kept = []
    for _ in range(2):
        data = rng.randbytes(rng.randrange(500, 3000)) + passage + rng.randbytes(900)
        ends = media.cuts(data)
        kept.append({data[a:b]: b - a for a, b in zip([0, *ends], ends)})
    assert sum(kept[0][c] for c in kept[0].keys() & kept[1].keys()) > 1500


def test_one_chunk_payloads_share_with_longer_ones(spark, tmp_path):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(576 * 40))
    first = long[: media.cuts(media.payload_of(long))[0]]
    rows = [(1, long), (2, first), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert len(media.payloads(docs, f"file://{tmp_path}/s").collect()) == 3
    packs = spark.read.parquet(f"file://{tmp_path}/s")
    digests = [d for r in packs.select("digests").collect() for d in r.digests]
    bodies = [d for r in packs.select("held").collect() for d in r.held]
    assert len(bodies) == len(set(bodies)) == len(set(digests))


def test_a_chunk_that_many_lists_want(spark, tmp_path, monkeypatch):
    """Copies of a wanted body: the join of lists with bodies is dealt over several keys."""
    monkeypatch.setattr(media, "SPREAD", 8)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(20_000)
    rows = [(i, text(700) + passage + text(300)) for i in range(60)]
    got = media.payloads(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), f"file://{tmp_path}/w").collect()
    assert {r.doc_id: r.payload_sha256 for r in got} == {i: hashlib.sha256(media.payload_of(t)).hexdigest() for i, t in rows}


def test_bodies_stay_where_they_are(spark, tmp_path):
    """The packs are read by bucket: no exchange lies between their bodies and the join."""
    docs = spark.createDataFrame([(i, f"text {i} " * 200) for i in range(50)], "doc_id long, text string")
    packs = media.store(docs, f"file://{tmp_path}/b")
    asked = packs.select("part", "pack").distinct()
    with media._in_place(spark):
        plan = media._named(packs.select("part", "pack", "bodies"), asked)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "bodies" in line)
    assert "Bucketed: true" in scan
