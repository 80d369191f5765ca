import random

import pytest

from driftline.operators import subgraph

TYPES = ("person", "org", "model", "work")


def made(seed, n=30, m=60):
    rng = random.Random(seed)
    nodes = [(i, f"name {i % 25}", rng.choice(TYPES)) for i in range(n)]
    pick = lambda: 0 if rng.random() < 0.2 else rng.randrange(n)
    edges = [(pick(), rng.choice(["a", "b"]), pick()) for _ in range(m)]
    return nodes, edges + edges[:3]


def plain(nodes, edges, focus, most, per_hub=None):
    """One focus after another over sets."""
    types = {i: t for i, _, t in nodes}
    near = {i: {d for s, _, d in edges if s == i} | {s for s, _, d in edges if d == i} for i in types}
    near = {i: x - {i} for i, x in near.items()}
    if per_hub:
        near = {i: set(sorted(x, key=lambda o: (-len(near[o]), o))[:per_hub]) for i, x in near.items()}
    seen = front = {focus}
    for k in range(3):
        out = [x for x in front if x == focus or types[x] == "person" or (types[x] == "org" and types[focus] in subgraph.ARTIFACTS and k == 1)]
        front = set().union(*(near[x] for x in out), set()) - seen
        seen = seen | front
    inner = {e for e in edges if e[0] in seen and e[2] in seen}
    degree = {}
    for s, _, d in inner:
        degree[s] = degree.get(s, 0) + 1
        degree[d] = degree.get(d, 0) + 1
    kept = set(sorted(degree, key=lambda x: (-degree[x], x))[:most]) | ({focus} & set(degree))
    told = len(degree) if len(degree) > most else 0
    return {(focus, x, degree[x], told) for x in kept}, {(focus, *e) for e in inner if e[0] in kept and e[2] in kept}


def tables(spark, nodes, edges, focus):
    return spark.createDataFrame(edges, "src long, edge_type string, dst long"), spark.createDataFrame(nodes, "node long, name string, type string"), spark.createDataFrame([(f,) for f in focus], "focus long")


@pytest.mark.parametrize("most,per_hub", [(60, None), (5, None), (60, 2)])
def test_many_focus_nodes_equal_one_after_another(spark, most, per_hub):
    nodes, edges = made(1)
    n, e = subgraph.subgraphs(*tables(spark, nodes, edges, [*range(30), 99]), most, per_hub)
    want = [plain(nodes, edges, f, most, per_hub) for f in range(30)]
    assert {tuple(r) for r in n.collect()} == set().union(*(w[0] for w in want))
    assert {tuple(r) for r in e.collect()} == set().union(*(w[1] for w in want))


def test_a_hot_hub_is_cut_before_it_spreads(spark):
    nodes = [(i, str(i), "person") for i in range(300)]
    edges = [(0, "a", i) for i in range(1, 300)]
    reached = subgraph.grown(*tables(spark, nodes, edges, [5]), per_hub=10).groupBy("round").count().collect()
    assert {r["round"]: r["count"] for r in reached} == {0: 1, 1: 1, 2: 9}  # of the hub's others the ten smallest, the focus being one
    assert subgraph.neighbours(tables(spark, nodes, edges, [5])[0], 10).where("node = 0").count() == 10


def test_digests_tell_only_what_changed(spark):
    nodes, edges = made(2)
    focus = range(30)
    e, n, f = tables(spark, nodes, edges, focus)
    mark = lambda table: subgraph.fingerprints(*subgraph.subgraphs(table, n, f), n)
    now = mark(e)
    assert {tuple(r) for r in now.collect()} == {tuple(r) for r in mark(e.repartition(7).orderBy("dst")).collect()}
    more = [*edges, (7, "new", 11)]
    got = {r.focus: r.decision for r in subgraph.to_renew(f, mark(tables(spark, nodes, more, focus)[0]), now).collect()}
    for x in focus:
        a, b = plain(nodes, edges, x, 60), plain(nodes, more, x, 60)
        names = lambda g: ({n[1] for n in g[0]}, {z[1:] for z in g[1]})
        assert got[x] == ("empty" if not b[1] else "unchanged" if names(a) == names(b) else "renew")
    assert {"unchanged", "renew"} <= set(got.values())


@pytest.mark.parametrize("seed,most", [(3, 60), (4, 4), (5, 1)])
def test_focus_nodes_with_the_same_others_share_a_leader(spark, seed, most):
    """Twins of every type, with loops: one of them is grown, and each has what it would have alone, by rows and by digest."""
    nodes, edges = made(seed, n=20, m=40)
    for i in range(20):
        nodes += [(100 + 20 * k + i, f"twin {k}", TYPES[i % 4]) for k in range(3)]
        edges += [(100 + 20 * k + i, "a", x) for k in range(3) for x in (i, (i * 7 + 1) % 20)]
    edges += [(100, "a", 100), (7, "loop", 7)]
    focus = [i for i, _, _ in nodes]
    e, n, f = tables(spark, nodes, edges, focus)
    once = subgraph.shared(e, n, f, most)
    assert once.heads.count() == len(focus) > once.heads.select("leader").distinct().count()
    got, lines = subgraph.subgraphs(e, n, f, most)
    want = [plain(nodes, edges, x, most) for x in focus]
    assert sorted(map(tuple, got.collect())) == sorted(set().union(*(w[0] for w in want)))
    assert sorted(map(tuple, lines.collect())) == sorted(set().union(*(w[1] for w in want)))
    assert sorted(map(tuple, subgraph.shared_fingerprints(once, n).collect())) == sorted(map(tuple, subgraph.fingerprints(got, lines, n).collect()))


def test_repeated_items_count(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b")], "k int, item string")
    got = {r.k: r.digest for r in subgraph.digests(rows, "k", "item").collect()}
    assert got[1] != got[2] and got[3] == got[4] != got[2]


def test_no_edges(spark):
    n, e = subgraph.subgraphs(*tables(spark, [(1, "a", "org")], [], [1]))
    assert n.count() == e.count() == 0
