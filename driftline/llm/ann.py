"""Nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product. Vectors are scaled by the largest norm and get one more component that makes each length
one, so the nearest by distance are those of the largest product. A table's hash is the cell of each of several Gaussian
projections (a 2-stable family). A query visits a table's buckets in order of estimated success: given its projections y
and the typical product c of a wanted neighbour, the neighbour's projections are normal with mean c y and variance
1 - c^2, which gives each cell a probability; buckets are visited from the likeliest on until they hold the wanted share
of it. The candidates of all buckets and tables are merged and ranked by their exact products in double precision.

A second pass looks at each query's own need: where the k-th product that a query found is below c, it visits again by
that product, which is never above that of its true k-th neighbour; one that found fewer than k meets every bucket.

``fit`` measures c on a bounded sample (``SAMPLE`` vectors of the least hashed ids, ``ASKED`` of them as queries) and
sets the number of projections so that a bucket holds about ``BUCKET`` vectors; the sample is taken after equal vectors
are thinned, so common ones don't set c, and every vector is indexed. The buckets of a table share shards of about
``SHARD`` vectors (a bucket with more is dealt over several), so a query's vector goes once to each shard, with the list
of the buckets it visits there. A shard with more than ``CROWD`` visitors meets them in several tasks. Of equal vectors
only the ``k`` + 1 smallest ids can be among the nearest, so only these are indexed.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, neither
as queries nor as candidates. Ties go to the smaller id. Rows that repeat an id and a vector count once; an id with
several vectors is found by the best of them and asks with the least one, and a query isn't its own candidate. An empty
table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint, importable

TABLES, BUCKET, SHARD, CROWD, WIDTH = 4, 32, 4096, 8192, 2.0
#: Share of a wanted neighbour's chance that the visited buckets of all tables hold together.
SUCCESS = 0.92
SAMPLE, ASKED = 4000, 200
#: Candidates that a task holds before it keeps each query's best.
HELD = 1_000_000
SEED = 11


@dataclass(frozen=True)
class Index:
    dimension: int
    norm: float
    cosine: float
    projections: int
    rows: int

    def family(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions (table, component, projection) and offsets of the cells."""
        rng = np.random.default_rng(SEED)
        return rng.normal(size=(TABLES, self.dimension + 1, self.projections)), rng.uniform(0, WIDTH, (TABLES, self.projections))


def sound(vector: Column) -> Column:
    """Whether a vector takes part, but for its length."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    rows = importable(vectors).select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & sound(F.col("embedding").cast("array<double>")))
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (size.n if size else 0))


def distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors, the k + 1 smallest ids, once each; ranks are cut before the shuffle, so a hot vector is few rows."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    once = rows.groupBy("vec_id", "embedding").agg(F.lit(1).alias("one")).drop("one")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")


def fit(rows: DataFrame, k: int) -> Index | None:
    """The index's parameters; None if there are no rows."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    known = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    if not known.n:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r.embedding for r in sample]) / known.norm
    asked = x[:ASKED]
    near = asked @ x.T / np.linalg.norm(asked, axis=1)[:, None]
    np.fill_diagonal(near[:, : len(asked)], -1)
    place = max(1, round(k * len(x) / known.n))
    wanted = -np.partition(-near, min(place, len(x) - 1) - (len(x) > place), axis=1)[:, min(place, len(x) - 1) - (len(x) > place)]
    cosine = float(np.clip(np.median(wanted), 0.0, 0.999))
    return Index(x.shape[1], known.norm, cosine, max(2, round(math.log2(max(2, known.n / BUCKET)) / 1.5)), known.n)


def _key(table: int, cells: np.ndarray) -> np.ndarray:
    """A bucket's key, mixed from its table and cells."""
    with np.errstate(over="ignore"):
        out = np.full(cells.shape[:-1], table + 1, np.int64)
        for k in range(cells.shape[-1]):
            out = (out ^ cells[..., k].astype(np.int64)) * np.int64(-7046029254386353131)
            out ^= out >> np.int64(29)
    return out


def _projected(x: np.ndarray, index: Index, query: bool) -> np.ndarray:
    """Projections (table, row, projection) of scaled vectors; a query gets length one and no further component."""
    directions, _ = index.family()
    if query:
        x = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))], axis=1)
    else:
        x = x / index.norm
        x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))[:, None]], axis=1)
    return np.einsum("nd,tdk->tnk", x, directions)


def visits(y: np.ndarray, offset: np.ndarray, cosine: float, success: float) -> list[tuple[int, ...]]:
    """The buckets of one table that a query with projections y visits, the likeliest first."""
    spread = math.sqrt(1 - cosine * cosine)
    lists = []
    for p, b in zip(y.tolist(), offset.tolist()):
        mean = cosine * p
        low, high = math.floor((mean - 4.5 * spread + b) / WIDTH), math.floor((mean + 4.5 * spread + b) / WIDTH)
        edges = [0.5 * math.erf(((c * WIDTH - b) - mean) / spread / math.sqrt(2)) for c in range(low, high + 2)]
        cells = [(math.log(max(b2 - a2, 1e-300)), low + k) for k, (a2, b2) in enumerate(zip(edges, edges[1:]))]
        lists.append(sorted(cells, reverse=True))
    start = tuple([0] * len(lists))
    heap = [(-sum(x[0][0] for x in lists), start, 0)]
    out, mass = [], 0.0
    while heap and mass < success:
        worth, at, last = heapq.heappop(heap)
        out.append(tuple(x[i][1] for x, i in zip(lists, at)))
        mass += math.exp(-worth)
        for k in range(last, len(lists)):  # each combination has one parent: the one before it in its last place that isn't 0
            if at[k] + 1 < len(lists[k]):
                heapq.heappush(heap, (worth + lists[k][at[k]][0] - lists[k][at[k] + 1][0], (*at[:k], at[k] + 1, *at[k + 1 :]), k))
    return out


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _hashed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """(tab, bucket, vec_id, embedding) of each vector in each table."""
    _, offsets = index.family()
    for batch in batches:
        if batch.num_rows:
            y = _projected(_matrix(batch.column("embedding"), index.dimension), index, False)
            keys = np.concatenate([_key(t, np.floor((y[t] + offsets[t]) / WIDTH)) for t in range(TABLES)])
            ids = pa.array(np.tile(np.arange(batch.num_rows), TABLES))
            tables = pa.array(np.repeat(np.arange(TABLES, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([tables, pa.array(keys), batch.column("vec_id").take(ids), batch.column("embedding").take(ids)], ["tab", "bucket", "vec_id", "embedding"])


def _probed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """(tab, bucket, vec_id) of the buckets that each query visits."""
    _, offsets = index.family()
    each = 1 - (1 - SUCCESS) ** (1 / TABLES)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("embedding"), index.dimension)
        y = _projected(x, index, True)
        least = batch.column("least").to_numpy(zero_copy_only=False) / np.linalg.norm(x, axis=1) / index.norm
        cosines = np.where(np.isnan(least), index.cosine, np.clip(least, 0.0, 0.999)).tolist()
        for at in range(0, batch.num_rows, 256):
            tables, keys, rows = [], [], []
            for n in range(at, min(at + 256, batch.num_rows)):
                for t in range(TABLES):
                    found = np.array(visits(y[t, n], offsets[t], cosines[n], each))
                    keys.append(_key(t, found))
                    tables.append(np.full(len(found), t, np.int32))
                    rows.append(np.full(len(found), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tables)), pa.array(np.concatenate(keys)), batch.column("vec_id").take(pa.array(np.concatenate(rows)))], ["tab", "bucket", "vec_id"])


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Each query's k best, every pair once with its best score."""
    q, v, s = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])] if len(q) else np.empty(0, bool)
    q, v, s = q[new], v[new], s[new]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return [(q[keep], v[keep], s[keep])]


def _ranked(batches: Iterator[pa.RecordBatch], dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's best candidates in this partition; rows come by part, the indexed vectors before the queries."""
    found: list = []
    held, now, stored, shelf = 0, None, [], None

    def meet(asked: np.ndarray, names: np.ndarray, lists: list[np.ndarray]) -> None:
        nonlocal held, found, shelf
        if shelf is None:
            x, ids, buckets = (np.concatenate(c) for c in zip(*stored))
            order = np.argsort(buckets, kind="stable")
            x, ids, buckets = x[order], ids[order], buckets[order]
            first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            shelf = x, ids, buckets[first], first, np.r_[first[1:], len(ids)], len(ids) - len(np.unique(ids))
        x, own, kinds, first, last, again = shelf
        for at in range(0, len(asked), 512):
            q, who, some = asked[at : at + 512], names[at : at + 512], lists[at : at + 512]
            near = np.full((len(q), len(own)), -np.inf)
            visited, row = np.concatenate(some), np.repeat(np.arange(len(some)), [len(v) for v in some])
            order = np.argsort(visited, kind="stable")
            visited, row = visited[order], row[order]
            cuts = np.flatnonzero(np.r_[True, visited[1:] != visited[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(visited)]):
                place = np.searchsorted(kinds, visited[a])
                if place < len(kinds) and kinds[place] == visited[a]:
                    c, d = first[place], last[place]
                    near[row[a:b], c:d] = q[row[a:b]] @ x[c:d].T
            near[who[:, None] == own[None, :]] = -np.inf
            most = k + again  # an id that repeats takes several places
            least = np.partition(near, len(own) - most, axis=1)[:, len(own) - most] if len(own) > most else np.full(len(q), -np.inf)
            a, b = np.nonzero((near >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (near > -np.inf)) if len(own) > most else np.nonzero(near > -np.inf)
            exact = (q[a] * x[b]).sum(axis=1)
            found += _best([(who[a], own[b], exact)], k)
            held += len(found[-1][0])
            if held > HELD:
                found = _best(found, k)
                held = len(found[0][0])

    for batch in batches:
        if not batch.num_rows:
            continue
        part, kind, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "query", "vec_id"))
        x = _matrix(batch.column("embedding"), dimension)
        ends, flat = batch.column("buckets").offsets.to_numpy(), batch.column("buckets").values.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            if part[a] != now:
                now, stored, shelf = part[a], [], None
            if not kind[a]:
                stored.append((x[a:b], names[a:b], flat[ends[a] : ends[b]]))
            elif stored:
                meet(x[a:b], names[a:b], [flat[ends[i] : ends[i + 1]] for i in range(a, b)])
    if found:
        q, v, s = _best(found, k)[0]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the nearest of each query, a row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, k)
    kept = checkpoint(distinct_enough(rows, k))
    index = fit(kept, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vector = kept.schema["embedding"].dataType.simpleString()
    stored = checkpoint(kept.mapInArrow(partial(_hashed, index=index), f"tab int, bucket long, vec_id long, embedding {vector}"))
    asked = checkpoint(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    sizes = checkpoint(stored.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / SHARD).alias("parts")))
    shards = -(-index.rows // SHARD)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    shard = F.xxhash64("tab", F.pmod(F.xxhash64("bucket", "p"), F.lit(shards))).alias("shard")

    def met(there: DataFrame, here: DataFrame) -> DataFrame:
        """The best that queries (shard, vec_id, buckets) find among vectors (shard, bucket, vec_id, embedding)."""
        crowds = here.groupBy("shard").agg(F.ceil(F.count("*") / CROWD).alias("crowds"))
        part = F.xxhash64("shard", "c").alias("part")
        there = there.join(crowds, "shard").select("shard", upto(F.col("crowds")).alias("c"), "vec_id", "embedding", F.array("bucket").alias("buckets"))
        here = here.join(crowds, "shard").join(asked, "vec_id").select("shard", F.pmod(F.xxhash64("vec_id"), "crowds").alias("c"), "vec_id", "embedding", "buckets")
        both = [x.select(part, F.lit(query).alias("query"), "vec_id", "embedding", "buckets") for query, x in enumerate((there, here))]
        both = both[0].unionByName(both[1]).repartition("part").sortWithinPartitions("part", "query")
        found = both.mapInArrow(partial(_ranked, dimension=index.dimension, k=k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    large = sizes.where("parts > 1")
    p = F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("parts")), F.lit(0)).alias("p")
    shelved = stored.join(large, ["tab", "bucket"], "left").select("tab", "bucket", p, "vec_id", "embedding").select(shard, "bucket", "vec_id", "embedding")

    def probed(queries: DataFrame) -> DataFrame:
        visiting = queries.mapInArrow(partial(_probed, index=index), "tab int, bucket long, vec_id long").join(sizes, ["tab", "bucket"])
        visiting = visiting.select("tab", "bucket", "vec_id", upto(F.col("parts")).alias("p")).select(shard, "vec_id", "bucket")
        return checkpoint(visiting.groupBy("shard", "vec_id").agg(F.collect_set("bucket").alias("buckets")))

    first = checkpoint(met(shelved, probed(asked.withColumn("least", F.lit(None).cast("double")))))
    reached = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    again = asked.join(reached, "vec_id", "left")
    length = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    wider = again.where((F.col("n") == k) & (F.col("least") < index.cosine * index.norm * length)).select("vec_id", "embedding", "least")
    found = first.drop("rank").unionByName(met(shelved, probed(wider)).drop("rank"))
    # queries with too few candidates are held against all vectors, in blocks
    short = again.where(F.coalesce("n", F.lit(0)) < k).select("vec_id", upto(F.lit(shards)).alias("shard"), F.array(F.lit(0).cast("long")).alias("buckets"))
    blocks = kept.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long").alias("shard"), F.lit(0).cast("long").alias("bucket"), "vec_id", "embedding")
    found = found.unionByName(met(blocks, short).drop("rank"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
