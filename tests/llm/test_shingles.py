import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import shingles


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def word(rng):
    return "".join(rng.choice("aeioustrn") for _ in range(6))


def pair(rng, similarity, appended):
    """Two texts of 400 words whose similarity is just at or above the one asked for."""
    a = [word(rng) for _ in range(400)]
    b = a[:]
    while True:
        c = b + [word(rng)] if appended else b[:]
        if not appended:
            c[rng.randrange(400)] = word(rng)
        if jaccard(" ".join(a), " ".join(c)) < similarity:
            return " ".join(a), " ".join(b)
        b = c


@pytest.mark.parametrize("similarity", [0.80, 0.85, 0.90])
def test_recall_of_pairs_near_the_limit(spark, similarity):
    rng = random.Random(int(similarity * 100))
    rows = []
    for k in range(200):
        a, b = pair(rng, similarity, k % 2)
        assert similarity <= jaccard(a, b) < similarity + 0.05
        rows += [(2 * k, a), (2 * k + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in shingles.deduplicated(docs).collect()}
    assert kept >= set(range(0, 400, 2))
    recall = 1 - len(kept & set(range(1, 400, 2))) / 200
    print(f"recall at {similarity:.2f}: {recall:.3f}")
    assert recall >= 0.99


@pytest.mark.parametrize("load", [shingles.LOAD, 60])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, load):
    monkeypatch.setattr(shingles, "LOAD", load)
    rng = random.Random(5)
    texts = ["", " \n", "one", "ONE", "one two", None]
    for _ in range(6):
        words = [word(rng) for _ in range(60)]
        for _ in range(12):  # similarities on both sides of the limit
            words = words[:]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = word(rng)
            texts.append(" ".join(words))
    label = list(range(len(texts)))
    plain = [(t or "").lower() for t in texts]
    close = [(i, j) for i, j in itertools.combinations(label, 2) if jaccard(plain[i], plain[j]) >= 0.8]
    for _ in texts:
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    assert 10 < len(set(label)) < len(texts) - 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("kept")).repartition(3)
    got = shingles.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label))


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    one, two = (" ".join(word(rng) for _ in range(80)) for _ in range(2))
    rows = [(1, one, "a"), (1, two, "b"), (1, one, "c"), (1, one, "a"), (2, two, "d"), (3, one + " x", "e")]
    first = None
    for parts in (1, 4):
        docs = spark.createDataFrame(rows[::-1] if first else rows, "doc_id long, text string, source string").repartition(parts)
        got = sorted(map(tuple, shingles.deduplicated(docs).collect()))
        assert [r[:2] for r in got] == sorted([(1, one), (1, two)])
        assert first in (None, got)
        first = got


def test_pairs_at_the_limit_are_within_the_bits():
    """Sets of all sizes at a similarity of 0.8, of equal and of unlike length, pass the fingerprints' gate."""
    rng = np.random.default_rng(7)
    for shared, more, less in [(4, 1, 0), (8, 1, 1), (8, 2, 0), (12, 3, 0), (16, 2, 2), (80, 10, 10), (400, 50, 50), (400, 100, 0)]:
        for _ in range(300):
            a, b, c = (rng.integers(0, 1 << 64, n, np.uint64) for n in (shared, more, less))
            one, two = (np.array(shingles.fingerprint(np.concatenate([a, x])), np.int64).view(np.uint64) for x in (b, c))
            assert shingles.simhash.distances(one, two) <= shingles.BITS


def test_fingerprints_of_sets_are_plain_majorities():
    own = np.random.default_rng(8).integers(0, 1 << 64, 700, np.uint64)
    words = [[int(x) for x in shingles.mixed(own * f)] for f in shingles.FACTORS[: shingles.WORDS]]
    plain = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in w) > len(w)) for w in words]
    assert [x % (1 << 64) for x in shingles.fingerprint(own)] == plain


def test_groups_of_a_bucket_hang_together_by_bits():
    rng = np.random.default_rng(9)
    fps, bucket = [], []
    for k in range(40):
        base = rng.integers(0, 1 << 64, (1 + k % 3, shingles.WORDS), np.uint64)
        for _ in range(1 + k):
            x = base[rng.integers(len(base))].copy()
            x[rng.integers(shingles.WORDS)] ^= rng.integers(0, 1 << 64, dtype=np.uint64) & np.uint64((1 << 62) - 1)
            fps.append(x)
            bucket.append(k)
    label = list(range(len(fps)))
    close = [(i, j) for i, j in itertools.combinations(label, 2) if bucket[i] == bucket[j] and sum(int(a ^ b).bit_count() for a, b in zip(fps[i], fps[j])) <= 40]
    for _ in range(40):
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    group, node = shingles.hanging(np.array(bucket), np.arange(len(fps)), np.array(fps), 40)
    got = {}
    for g, n in zip(group.tolist(), node.tolist()):
        got.setdefault(g, []).append(n)
    wanted = {}
    for n, x in enumerate(label):
        wanted.setdefault(x, []).append(n)
    assert sorted(map(sorted, got.values())) == sorted(x for x in wanted.values() if len(x) > 1)


def near_copies(spark, rng):
    rows = []
    for k in range(40):
        words = [word(rng) for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "end"]))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_no_pair_passes_by_the_fingerprints(spark, monkeypatch):
    """Every pair goes through the SimHash distances: where they let none pass, nothing is a near-duplicate."""
    docs = near_copies(spark, random.Random(10))
    assert shingles.deduplicated(docs).count() == 40
    monkeypatch.setattr(shingles, "BITS", -1)
    assert shingles.deduplicated(docs).count() == 80


def test_fingerprint_blocks_find_pairs_by_themselves(spark):
    """Without band keys, copies whose first words differ in three bits or fewer are still found."""
    docs = near_copies(spark, random.Random(11))
    plain = {r.doc_id: shingles.fingerprint(shingles.shingles(r.text))[0] % (1 << 64) for r in docs.collect()}
    close = {2 * k + 1 for k in range(40) if (plain[2 * k] ^ plain[2 * k + 1]).bit_count() <= 3}
    assert len(close) > 20
    texts = docs.withColumn("digest", F.md5("text"))
    rows = [(r.doc_id, r.doc_id, r.digest, len(own := shingles.shingles(r.text)), [], shingles.fingerprint(own)) for r in texts.collect()]
    classes = spark.createDataFrame(rows, "node long, doc_id long, digest string, load long, keys array<long>, fp array<long>")
    found = {max(r.src, r.dst) for r in shingles.links(classes, texts).collect()}
    assert found >= close
