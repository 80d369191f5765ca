"""Shuffling rows into shards by a Feistel permutation of their global row numbers.

Rows are numbered 0 to n - 1 in order of (doc_id, hashes of the row). A keyed permutation of these numbers, a Feistel
network with cycle walking, gives each row its place in the shuffle, and the place alone gives shard (place mod shards)
and slot (place div shards). So the counts of two shards differ by one at most, slots have no gaps, and anyone who knows
a row's number, n and the seed computes where it is, or by the inverse which number is at a shard's slot.

The two halves of the network are numbers below a and b with a * b >= n, as close to n as whole numbers allow, so fewer
than sqrt(n) + 1 points lie outside and nearly no walk takes a second step. How many steps the longest walk takes is
found exactly, by walking the outside points alone.

All work is in DataFrame functions. Rows are numbered by one range partitioning of thin rows whose last key is their
place in the input, so that rows which are equal in all spread over partitions like any others; equal rows are
interchangeable, so reruns agree whatever the input's splits. Only one count for each partition reaches the driver.

Null ids come first, null texts have size 1 and the checksum of no bytes; repeated rows are rows of their own; an empty
table gives an empty shuffle. Columns that aren't asked for play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint, only

SHARDS, SEED, ROUNDS = 8, 20_240_601, 6
#: Rows that one task numbers, about, and most tasks.
ROWS, TASKS = 1_000_000, 20_000


def halves(n: int) -> tuple[int, int]:
    """a and b, the sizes of the network's two halves: a * b >= n, and by less than a + 1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mixed(seed: int, k: int, half: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), half), F.lit(size))


def _once(df: DataFrame, column: str, n: int, seed: int, back: bool) -> DataFrame:
    """One pass of the network over a column, for rows where ``_out`` is set; a select for each round keeps the code small."""
    a, b = halves(n)
    df = df.withColumns({"_l": F.col(column) % a, "_r": F.expr(f"`{column}` div {a}")})
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2:
            df = df.withColumn("_r", F.pmod(F.col("_r") + sign * _mixed(seed, k, F.col("_l"), b), F.lit(b)))
        else:
            df = df.withColumn("_l", F.pmod(F.col("_l") + sign * _mixed(seed, k, F.col("_r"), a), F.lit(a)))
    return df.withColumn(column, F.when(F.col("_out"), F.col("_r") * a + F.col("_l")).otherwise(F.col(column)))


def longest_walk(df: DataFrame, n: int, seed: int, back: bool) -> int:
    """Passes that the longest walk from a number below n takes.

    Walks leave through outside points that a number inside leads to, so those are walked until all are back inside;
    circles that lie wholly outside are never entered.
    """
    a, b = halves(n)
    outside = df.sparkSession.range(n, a * b).select(F.col("id").alias("_x"), F.col("id").alias("_from"), F.lit(True).alias("_out"))
    at, steps = _once(outside, "_from", n, seed, not back).where(F.col("_from") < n).select("_x", "_out"), 1
    while not (at := checkpoint(at)).isEmpty():
        at, steps = _once(at, "_x", n, seed, back).where(F.col("_x") >= n).select("_x", "_out"), steps + 1
    return steps


def permute(df: DataFrame, column: str, n: int, seed: int = SEED, back: bool = False) -> DataFrame:
    """Replaces numbers from 0 to n - 1 by their images under the permutation, or with ``back`` under its inverse."""
    if n < 2:
        return df
    a, b = halves(n)
    steps = longest_walk(df, n, seed, back) if a * b > n else 1
    out = df.withColumn("_out", F.lit(True))
    for _ in range(steps):
        out = _once(out, column, n, seed, back).withColumn("_out", F.col(column) >= n)
    return out.drop("_l", "_r", "_out")


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows with ``number``, 0 to n - 1 in order of the keys, and n. The last key should tell equal rows apart.

    Numbers come from one range partitioning: a row's place in its partition after what the partitions before hold.
    """
    known = rows.count()
    tasks = min(TASKS, max(rows.sparkSession.sparkContext.defaultParallelism, -(-known // ROWS)))
    ordered = checkpoint(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys))
    place = F.monotonically_increasing_id()
    ordered = ordered.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at"))
    held = sorted(ordered.groupBy("_part").count().collect())  # a row for each of at most TASKS partitions
    starts, n = [], 0
    for part, count in held:
        starts.append((part, n))
        n += count
    before = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return ordered.join(F.broadcast(before), "_part").withColumn("number", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), n


def hashes(docs: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row's columns and of where they are null; maps as JSON."""
    values = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name in columns]
    return [F.xxhash64(F.lit(k), *values, *(v.isNull() for v in values)) for k in (1, 2)]


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, values: dict[str, Column] | None = None) -> DataFrame:
    """Every row as ``row`` with its number, ``shard`` (int) and ``slot`` (long).

    ``row`` is a struct of ``values`` (name to expression), or of all columns. Thin values keep the shuffle thin.
    """
    columns = ["doc_id", "text"] if values is not None else docs.columns
    row = F.struct(*(c.alias(k) for k, c in values.items())) if values is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one, two = hashes(docs, columns)
    # the place is written before the range partitioning samples and moves it, so it can't change under it
    thin = checkpoint(docs.select(F.col("doc_id").alias("_id"), one.alias("_one"), two.alias("_two"), F.monotonically_increasing_id().alias("_in"), row.alias("row")))
    rows, n = numbered(thin, ["_id", "_one", "_two", "_in"])
    out = permute(rows.withColumn("_place", F.col("number")), "_place", n, seed)
    return out.select("row", "number", (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard (null: this law has none) of each row."""
    text = F.coalesce("text", F.lit(""))
    values = {"doc_id": F.col("doc_id"), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    out = shuffle(only(docs, "doc_id", "text"), shards, seed, values)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, files: int = 1) -> None:
    """Writes whole rows as Parquet, a folder ``shard=k`` for each shard, in order of slots, ``files`` files a shard.

    Files of a shard hold consecutive slots, as partitions are ranges of (shard, slot).
    """
    rows = shuffle(docs, shards, seed).select(F.struct("row.*").alias("row"), "shard", "slot")
    rows.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def lookup(places: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``number``, the row number that is at each (shard, slot); no table of rows is read."""
    at = places.withColumn("number", F.col("slot").cast("long") * shards + F.col("shard"))
    return permute(at, "number", n, seed, back=True)
