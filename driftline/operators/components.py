"""Connected components of an edge table.

Alternates large-star and small-star rewrites (Kiveris et al., 2014) until the edges form stars whose centres are the
smallest nodes. Each rewrite is an aggregate and a join on the node, so no component is ever held in one task; only
counts reach the driver.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_top(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one serves only where they all run in this process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return top or tempfile.mkdtemp(prefix="driftline-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_top(spark))
    return df.checkpoint(eager=True)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star rewrite of pairs (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of each node that has an edge to another one; the component is its smallest node.

    Direction, self-loops, repeated and null ends don't matter; an empty table gives none.
    """
    a, b = F.col(src), F.col(dst)
    now = checkpoint(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        now = checkpoint(_stars(now))
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
