"""Sub-graphs around many focus entities at once, cut to a number of nodes, with digests that tell which ones have changed.

From its focus a sub-graph grows three rounds: always from the focus, then through people only, and in the second round through
organisations too where the focus is something made. Its edges are those with both ends inside. All focus entities grow in the
same joins, keyed by (focus, node), so many small sub-graphs cost what one large one does. Focus entities with the same others
share their sub-graph but for a node and its edges, so it is grown, cut and hashed once for all of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.components import checkpoint
from driftline.operators.graph import both_ways, top_per

#: Most nodes of a sub-graph, and the types of things that are made.
NODES = 60
ARTIFACTS = ("model", "project", "paper", "product")
#: A digest adds up four numbers of 15 hexadecimal digits for each item.
LANES, WIDTH = 4, 15


def neighbours(edges: DataFrame, per_hub: int | None = None) -> DataFrame:
    """(node, other), each pair once in both directions; of a node with more than ``per_hub`` others only those of the highest
    degree, then the smallest id, so that the choice is the same wherever the node is met. The cut comes before the shuffle."""
    near = both_ways(edges).where("src <> dst").distinct().select(F.col("src").alias("node"), F.col("dst").alias("other"))
    if per_hub is None:
        return near
    near = checkpoint(near)
    degree = near.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("_d"))
    return top_per(near.join(degree, "other"), ["node"], [F.desc("_d"), F.col("other")], per_hub).select("node", "other")


def typed(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.min("type").alias("type"))


def grown(edges: DataFrame, nodes: DataFrame, focus: DataFrame, rounds: int = 3, per_hub: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """(focus, node, round) of all that each focus reaches; nodes: (node, type), focus: (focus). A focus that isn't a node is left out.

    near: the edges' ``neighbours``, if they have been made.
    """
    near = checkpoint(neighbours(edges, per_hub)) if near is None else near
    types = typed(nodes)
    seeds = focus.select("focus").distinct().join(types.withColumnRenamed("node", "focus"), "focus")
    seeds = seeds.select("focus", F.col("type").isin(*ARTIFACTS).alias("made"))
    seen = front = checkpoint(seeds.select("focus", "made", F.col("focus").alias("node"), F.lit(0).alias("round")))
    for k in range(rounds):
        if k:
            passes = (F.col("type") == "person") | ((F.col("type") == "org") & F.col("made") & F.lit(k == 1))
            front = front.join(types, "node").where(passes).drop("type")
        step = front.join(near, "node").select("focus", "made", F.col("other").alias("node")).distinct()
        front = checkpoint(step.join(seen.select("focus", "node"), ["focus", "node"], "left_anti").withColumn("round", F.lit(k + 1)))
        seen = seen.unionByName(front)
    return seen.select("focus", "node", "round")


def led(near: DataFrame, nodes: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus, leader): the focus entities with the same others reach the same nodes, so the smallest of them stands for all.

    That holds where one of the others is passed through, for it leads back to each of them; who has none such is its own leader.
    near: all ``neighbours``, uncut. Sets of others are the same if their digests are.
    """
    types = typed(nodes)
    own = focus.select("focus").distinct().join(types.withColumnRenamed("node", "focus"), "focus").select("focus", F.col("type").isin(*ARTIFACTS).alias("made"))
    others = own.join(near.withColumnRenamed("node", "focus"), "focus").join(types.withColumnRenamed("node", "other"), "other", "left")
    passes = (F.col("type") == "person") | ((F.col("type") == "org") & F.col("made"))
    sets = sums(others.select("focus", F.col("other").cast("string").alias("item"), passes.alias("passes")), "focus", "item", F.max("passes").alias("passes"))
    rows = own.join(sets, "focus", "left")
    kind = F.when(F.col("passes"), F.concat_ws(",", F.lit("others"), F.col("made").cast("string"), total())).otherwise(F.concat_ws(",", F.lit("self"), F.col("focus").cast("string")))
    rows = checkpoint(rows.select("focus", kind.alias("_kind")))
    return rows.join(rows.groupBy("_kind").agg(F.min("focus").alias("leader")), "_kind").select("focus", "leader")


def inner_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(focus, src, edge_type, dst) of the edges with both ends in a focus' sub-graph, each once."""
    ends = lambda c: reached.select("focus", F.col("node").alias(c))
    rows = edges.select("src", "edge_type", "dst").distinct()
    return rows.join(ends("src"), "src").join(ends("dst"), ["focus", "dst"], "left_semi").select("focus", "src", "edge_type", "dst")


class Shared(NamedTuple):
    """Cut sub-graphs, kept once for each leader: a focus' are the rows of its leader and its own.

    heads: (focus, leader); nodes: (leader, node, degree, truncated_from), the same for all; edges: (leader, src, edge_type, dst);
    own_nodes and own_edges: with ``focus`` instead, of each focus that isn't among its leader's nodes.
    """

    heads: DataFrame
    nodes: DataFrame
    edges: DataFrame
    own_nodes: DataFrame
    own_edges: DataFrame


def shared(edges: DataFrame, nodes: DataFrame, focus: DataFrame, most: int = NODES, per_hub: int | None = None) -> Shared:
    """The sub-graphs of all focus entities; only leaders grow, and nothing is made for each focus but its own node and edges."""
    near = checkpoint(neighbours(edges, per_hub))
    if per_hub is None:
        heads = checkpoint(led(near, nodes, focus))
    else:  # a hub's cut may leave out the way back
        heads = checkpoint(focus.select("focus", F.col("focus").alias("leader")).distinct())
    reached = grown(edges, nodes, heads.select(F.col("leader").alias("focus")), per_hub=per_hub, near=near)
    inside = checkpoint(inner_edges(edges, reached).withColumnRenamed("focus", "leader"))
    ends = inside.select("leader", F.explode(F.array("src", "dst")).alias("node"))
    degree = checkpoint(ends.groupBy("leader", "node").agg(F.count("*").alias("degree")))
    size = degree.groupBy("leader").agg(F.count("*").alias("_n"))
    told = F.when(F.col("_n") > most, F.col("_n")).otherwise(F.lit(0)).alias("truncated_from")
    best = checkpoint(top_per(degree, ["leader"], [F.desc("degree"), F.col("node")], most))
    kept = lambda c: best.select("leader", F.col("node").alias(c))
    lines = inside.join(kept("src"), ["leader", "src"], "left_semi").join(kept("dst"), ["leader", "dst"], "left_semi")
    left = heads.join(degree.withColumnRenamed("node", "focus"), ["leader", "focus"]).join(kept("focus"), ["leader", "focus"], "left_anti")
    left = checkpoint(left.select("leader", "focus", "degree"))
    out = inside.join(left.select("leader", F.col("focus").alias("src"), "focus"), ["leader", "src"])
    back = inside.where("src <> dst").join(left.select("leader", F.col("focus").alias("dst"), "focus"), ["leader", "dst"])
    columns = ["focus", "src", "edge_type", "dst"]
    own = out.where("src = dst").select(columns)
    own = own.unionByName(out.where("src <> dst").join(kept("dst"), ["leader", "dst"], "left_semi").select(columns))
    own = own.unionByName(back.join(kept("src"), ["leader", "src"], "left_semi").select(columns))
    return Shared(
        heads,
        best.join(size, "leader").select("leader", "node", "degree", told),
        lines.select("leader", "src", "edge_type", "dst"),
        left.join(size, "leader").select("focus", F.col("focus").alias("node"), "degree", told),
        own,
    )


def subgraphs(edges: DataFrame, nodes: DataFrame, focus: DataFrame, most: int = NODES, per_hub: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each focus' sub-graph after it is cut.

    nodes: (focus, node, degree, truncated_from); those with the most inner edges stay, ties to the smaller id, and the focus
    always. truncated_from is how many there were, 0 where nothing was cut. A focus without inner edges has no rows.
    """
    once = shared(edges, nodes, focus, most, per_hub)
    spread = lambda rows, own: once.heads.join(rows, "leader").drop("leader").unionByName(own)
    return spread(once.nodes, once.own_nodes), spread(once.edges, once.own_edges)


def lanes(item: Column) -> list[Column]:
    """The first 60 hexadecimal digits of an item's SHA-256 as four whole numbers."""
    digits = F.sha2(item, 256)
    return [F.conv(F.substring(digits, 1 + k * WIDTH, WIDTH), 16, 10).cast("decimal(38,0)").alias(f"_{k}") for k in range(LANES)]


def sums(items: DataFrame, key: str, item: str, *more: Column) -> DataFrame:
    """(key, _n, _0 to _3, ...) of each key's multiset of items: their number and the sums of their hashes; more: further aggregates."""
    rows = items.select("*", *lanes(F.col(item)))
    return rows.groupBy(key).agg(F.count("*").alias("_n"), *(F.sum(f"_{k}").alias(f"_{k}") for k in range(LANES)), *more)


def total() -> Column:
    """A multiset's number and sums as one text."""
    return F.sha2(F.concat_ws(",", "_n", *(f"_{k}" for k in range(LANES))), 256)


def digests(items: DataFrame, key: str, item: str, name: str = "digest") -> DataFrame:
    """(key, digest) of each key's multiset of items, whatever their order and the table's split.

    Items are hashed one by one and the hashes added, in partial sums that meet in a shuffle, so no key's items are ever
    together; the digest is the hash of the sums and the number of items.
    """
    return sums(items, key, item).select(key, total().alias(name))


def _items(nodes: DataFrame, edges: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, item): the names and types of nodes and the names and types of edges as texts."""
    text = lambda *c: F.to_json(F.array(*(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c)))
    of = names.groupBy("node").agg(F.min(F.struct("name", "type")).alias("x")).select("node", "x.*")
    own = nodes.join(of, "node").select(key, text("name", "type").alias("item"))
    named = edges.join(of.select(F.col("node").alias("src"), F.col("name").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("name").alias("b")), "dst")
    return own.unionByName(named.select(key, text("a", "edge_type", "b").alias("item")))


def fingerprints(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(focus, digest) of each sub-graph by the names and types of its nodes and its edges; names: (node, name, type)."""
    return digests(_items(nodes, edges, names, "focus"), "focus", "item")


def shared_fingerprints(once: Shared, names: DataFrame) -> DataFrame:
    """The ``fingerprints`` of sub-graphs kept by their leaders: a leader's sums are made once and its focus entities' own are added."""
    common = sums(_items(once.nodes, once.edges, names, "leader"), "leader", "item")
    own = sums(_items(once.own_nodes, once.own_edges, names, "focus"), "focus", "item")
    of = ["_n", *(f"_{k}" for k in range(LANES))]
    own = own.select("focus", *(F.col(c).alias(f"{c}o") for c in of))
    rows = once.heads.join(common, "leader", "left").join(own, "focus", "left").where("_n IS NOT NULL OR _no IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    return rows.select("focus", *((zero(c) + zero(f"{c}o")).cast("decimal(38,0)").alias(c) for c in of)).select("focus", total().alias("digest"))


def to_renew(focus: DataFrame, now: DataFrame, stored: DataFrame) -> DataFrame:
    """(focus, digest, decision) of each asked entity: empty without a sub-graph, unchanged if the stored digest is the same, else renew."""
    before = stored.select("focus", F.col("digest").alias("_stored"))
    rows = focus.select("focus").distinct().join(now, "focus", "left").join(before, "focus", "left")
    decision = F.when(F.col("digest").isNull(), "empty").when(F.col("digest") == F.col("_stored"), "unchanged").otherwise("renew")
    return rows.select("focus", "digest", decision.alias("decision"))
