import numpy as np
import pytest

from driftline.llm import ann


def brute(x, ids, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x[q][None] * x).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def searched(spark, rows):
    got = {}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    for r in sorted(ann.search(vectors).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if scaled:
        x *= rng.uniform(0.3, 2, (6000, 1))
    x = x.astype(np.float32).astype(float)
    got = searched(spark, [(i, v, 1) for i, v in enumerate(x.tolist())])
    want = brute(x, np.arange(6000))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hits >= 0.9, hits
    for q, v in got.items():
        assert v == sorted(v, key=lambda p: (-p[1], p[0])) and q not in dict(v)
        assert all(abs(s - float((x[q] * x[i]).sum())) < 1e-12 for i, s in v)


def test_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 50)
    monkeypatch.setattr(ann, "CROWD", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype(np.float32).astype(float)
    x[::3] = x[0]
    got, want = searched(spark, [(i, v, 1) for i, v in enumerate(x.tolist())]), brute(x, np.arange(900))
    for q in want:
        if q % 3 == 0 and want[q][19][1] == want[q][0][1]:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_rows_that_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(20 * i, v, 1) for i, v in enumerate(bad)] + [(1000, [1.0, 0.0], 1), (1001, [0.5, 0.5], 1), (1002, [-1.0, 0.0], 1), (None, [1.0, 1.0], 1)]
    assert searched(spark, rows) == {1000: [(1001, 0.5), (1002, -1.0)]}
    assert searched(spark, rows[:3]) == {} and searched(spark, []) == {}


def test_visits_go_from_likely_to_unlikely():
    y, b = np.array([0.3, -1.2, 2.0]), np.array([0.1, 0.7, 1.4])
    found = ann.visits(y, b, 0.6, 0.99)
    assert len(set(found)) == len(found) > 5
    assert found[0] == tuple(np.floor((0.6 * y + b) / ann.WIDTH).astype(int))


def test_recall_among_groups_of_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x[:3600] = np.repeat(x[:90], 40, axis=0) + 0.001 * rng.normal(size=(3600, 32))
    x = x[rng.permutation(6000)]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    got, want = searched(spark, [(i, v, 1) for i, v in enumerate(x.tolist())]), brute(x, np.arange(6000))
    hits = [len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) / 20 for q in want]
    print(f"recall {np.mean(hits):.3f}, worst twentieth {np.mean(sorted(hits)[: len(hits) // 20]):.3f}")
    assert np.mean(hits) >= 0.9 and np.mean(sorted(hits)[: len(hits) // 20]) >= 0.6


def test_a_vector_that_fills_most_of_the_table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32)).astype(np.float32).astype(float)
    x[rng.permutation(2000)[:1200]] = x[0]
    got, want = searched(spark, [(i, v, 1) for i, v in enumerate(x.tolist())]), brute(x, np.arange(2000))
    rare = [q for q in want if (x[q] != x[0]).any()]
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in rare]) >= 0.9


def test_repeated_ids(spark):
    """Rows that repeat an id crowd nobody out; an id's best vector counts."""
    v = [1.0, 0.0]
    rows = [(1, v, 1)] * 30 + [(2, v, 1), (3, v, 1), (20, v, 1)]
    assert searched(spark, rows) == {20: [(1, 1.0), (2, 1.0), (3, 1.0)]}
    rows = [(20, v, 1)] + [(1, [0.9 - k / 100, 0.1], 1) for k in range(40)] + [(k, [0.25 - k / 1000, 0.5], 1) for k in range(2, 12)]
    got = searched(spark, rows)[20]
    assert [i for i, _ in got] == [1, *range(2, 12)] and abs(got[0][1] - 0.9) < 1e-6


def test_extra_columns_that_clash(spark):
    rows = [(i, [float(i + 1), 1.0], i, i, i, "x", 1.0) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket int, part int, query int, n string, `a.b` double")
    got = ann.search(vectors).collect()
    assert {r.query_id for r in got} == {0, 20} and len(got) == 40


def share_scored(x, ids, asked):
    """Share of the vectors in the buckets that the first pass visits, in any table; the index is fitted as search does."""
    import math

    known = len(x)
    near = x[:200] @ x.T / np.linalg.norm(x[:200], axis=1)[:, None]
    np.fill_diagonal(near[:, :200], -1)
    cosine = float(np.median(-np.partition(-near, 19, axis=1)[:, 19]))
    index = ann.Index(x.shape[1], float(np.linalg.norm(x, axis=1).max()), cosine, max(2, round(math.log2(max(2, known / ann.BUCKET)) / 1.5)), known)
    _, offsets = index.family()
    y, yq = ann._projected(x, index, False), ann._projected(x[asked], index, True)
    seen = np.zeros((len(asked), known), bool)
    for t in range(ann.TABLES):
        keys = ann._key(t, np.floor((y[t] + offsets[t]) / ann.WIDTH))
        for n in range(len(asked)):
            found = ann._key(t, np.array(ann.visits(yq[t, n], offsets[t], cosine, 1 - (1 - ann.SUCCESS) ** (1 / ann.TABLES))))
            seen[n] |= np.isin(keys, found)
    return float(seen.mean())


def test_share_scored_among_clusters():
    """Where vectors have near neighbours, a query scores a small share of the table."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(200, 32)), 60, axis=0) + 0.35 * rng.normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert share_scored(x[rng.permutation(12_000)], None, np.arange(0, 12_000, 200)) < 0.4
