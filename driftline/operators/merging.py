"""Merging in order: which references, taken one after another, join two entities, and who survives each time.

A reference merges the current roots of its two ends, the smaller by (is a paper, created_at, id) surviving, so what it does
depends on those before it. Taken sequentially that is a loop over all references; here the order is cut again and again.
With the references before a part of a block as edges, connected components give the roots that this part begins with,
so all four parts go on by themselves, all blocks of a level at once. After log4(references / LEAF) levels blocks are of at most
``LEAF`` references, and each is walked through by itself. Every merge comes out with the reference that caused it.

Entities go by their place in the order of survival, so that a reference is three numbers; and levels are few and blocks large, as
each level takes some dozens of jobs, all of which the driver keeps books on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.components import checkpoint, connected_components

#: References that one task walks through; a block is cut into 2 ** PARTS parts.
LEAF, PARTS = 1 << 18, 2
#: How sure a rule is.
CONFIDENCE = {"R1": 0.99, "R2": 0.97, "R3": 0.97}


def numbered(rows: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Rows with their place in an order, from 0: one range partitioning and a count for each partition, no single task.

    The order should tell rows apart; those that it doesn't are in any order.
    """
    ordered = checkpoint(rows.orderBy(*order))
    at = F.monotonically_increasing_id()
    ordered = ordered.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at"))
    starts, n = [], 0
    for part, held in sorted(ordered.groupBy("_part").count().collect()):  # a row for each partition
        starts.append((part, n))
        n += held
    before = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return ordered.join(F.broadcast(before), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def survivor_key(paper: Column, created_at: Column, entity_id: Column) -> Column:
    """Text that sorts as (is a paper, created_at, id) does and ends with the id."""
    wide = lambda x, n: F.lpad((x.cast("decimal(38,0)") + F.lit(str(n)).cast("decimal(38,0)")).cast("string"), 20, "0")
    return F.concat(F.when(paper, "1").otherwise("0"), wide(F.unix_micros(created_at.cast("timestamp")), 10**18), wide(entity_id, 2**63))


def _walk(block: pd.DataFrame) -> pd.DataFrame:
    """The merges of one block, its references in order."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for position, u, v in block.sort_values("position")[["position", "u", "v"]].itertuples(index=False):
        a, b = sorted((root(u), root(v)))
        if a != b:
            up[b] = a
            out.append((position, b, a))
    return pd.DataFrame(out, columns=["position", "loser", "survivor"], dtype="int64")


def ordered_merges(references: DataFrame, entities: DataFrame, order: list[str | Column], leaf: int = LEAF) -> DataFrame:
    """references with position, loser_id and survivor_id, a row for each one that merges two entities.

    references: (a, b, ...); entities: (id, entity_type, created_at). References to an unknown entity or to itself merge nothing.
    Each entity loses at most once; following losers to survivors leads to the smallest entity of all that are joined.
    """
    key = survivor_key(F.col("entity_type") == "paper", F.col("created_at"), F.col("id"))
    known = checkpoint(numbered(entities.groupBy("id").agg(F.min(key).alias("key")), ["key"], "rank").select("id", "rank"))
    n = max(1, known.count())
    ends = [known.select(F.col("id").alias(x), F.col("rank").alias(k)) for x, k in (("a", "u"), ("b", "v"))]
    rows = numbered(references.where("a <> b").join(ends[0], "a").join(ends[1], "b"), order)
    edges = checkpoint(rows.select("position", "u", "v"))
    leaf_bits, bits = max(1, leaf).bit_length() - 1, max(0, edges.count() - 1).bit_length()
    while bits > leaf_bits:
        step = min(PARTS, bits - leaf_bits)
        bits -= step
        at, part = F.shiftright("position", bits), F.shiftright("position", bits) % (1 << step)
        node = lambda k: F.col("at") * n + F.col(k)
        later = edges.where(part < (1 << step) - 1).select(F.explode(F.sequence(at + 1, at - part + (1 << step) - 1)).alias("at"), "u", "v")
        roots = connected_components(later.select(node("u").alias("src"), node("v").alias("dst")))
        roots = roots.select("node", (F.col("component") % n).alias("root"))
        rest = edges.where(part > 0).withColumn("at", at)
        for k in ("u", "v"):
            rest = rest.withColumn("node", node(k)).join(roots, "node", "left").withColumn(k, F.coalesce("root", k)).drop("node", "root")
        edges = checkpoint(edges.where(part == 0).unionByName(rest.where("u <> v").drop("at")))
    merges = edges.groupBy(F.shiftright("position", leaf_bits).alias("block")).applyInPandas(_walk, "position long, loser long, survivor long")
    for k in ("loser", "survivor"):
        merges = merges.join(known.select(F.col("rank").alias(k), F.col("id").cast("long").alias(f"{k}_id")), k)
    return rows.drop("u", "v").join(merges.drop("loser", "survivor"), "position")


def audit(merges: DataFrame) -> DataFrame:
    """The rows that a merge leaves: loser, survivor, rule, when it was justified, how sure, by whom; all active."""
    sure = F.coalesce(*(F.when(F.col("rule") == r, F.lit(c)) for r, c in CONFIDENCE.items()))
    return merges.select("position", "loser_id", "survivor_id", "rule", "justified_at", sure.alias("confidence"), F.lit("auto").alias("decided_by"), F.lit(True).alias("active"))
