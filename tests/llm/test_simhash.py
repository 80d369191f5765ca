import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftline.llm import simhash


def brute_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{key: fp} to {key: least key reachable}."""
    keys, label = sorted(fps), {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["Ab", "cé", "d", "E\x0bf", "gh", "\x1c", "i"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts = base + base[:10] + [t + " x" for t in base[:25]] + [None, "", " \n", "One", "one two", "ONE two", "w " * 5000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_large_groups_are_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(2)
    fps = [0]
    for _ in range(150):  # a chain of close fingerprints, and some far ones
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(50)]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([([f], i) for i, f in enumerate(signed)], "fp array<long>, rep long")
    found = {r.node: r.component for r in simhash.connected_components(simhash.links(classes)).collect()}
    expected = brute_components(dict(enumerate(fps)))
    assert {i: found.get(i, i) for i in expected} == expected


def test_deduplication_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(5))
    rows = []
    for g in range(12):
        words = [word() for _ in range(400)]
        rows.append((10 * g, " ".join(words)))
        for k in range(1, 4):
            near = words[:]
            for _ in range(2 * k):
                near[rng.randrange(400)] = word()
            rows.append((10 * g + k, " ".join(near)))
    rows += [(500 + i, " ".join(word() for _ in range(rng.randrange(1, 300)))) for i in range(60)] + [(0, rows[0][1]), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("kept"))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({i for i, _ in rows if i is not None and (i >= 500 or i % 10 == 0)})
    assert kept.where("doc_id IS NULL").count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_hash_is_that_of_spark(spark):
    row = spark.sql("SELECT xxhash64('abc déf') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("abc déf".encode(), 42)
