"""Near-duplicates by SimHash and pivot distance tables, decided by the exact Jaccard similarity of shingle sets.

A text is the set of the hashes (64 bits) of its shingles of ``WIDTH`` words; two texts are near-duplicates if their sets
have a Jaccard similarity of ``SIMILARITY`` or more. Equal texts form a class, so exact copies never meet in pairs.

Each class has a SimHash of its set, ``WORDS`` words of 64 bits. Classes meet in buckets: those that agree on three of the
six blocks of the first word, as in ``simhash``, and, since few pairs near the limit do, those that agree on one of
``BANDS`` keys of ``ROWS`` min-hashes each, which misses a pair of similarity s with probability (1 - s^5)^20 (0.0004 at
0.8 and less above). Within a bucket the distances of each SimHash to a few of the bucket's own, its pivots, are tabled;
pairs whose distances tell that they differ in more than ``BITS`` bits are discarded, survivors are compared bit by bit,
and a bucket falls apart into the groups that still hang together. A bit differs with probability arccos(8 / 9) / pi =
0.152 at most for large sets at the limit, and 0.188 for the worst of small ones (four shingles of five), so 80 of 256 is
over five standard deviations above what is expected there. Groups of the same classes are one group.

The sets themselves then decide within each group; nothing is judged by an estimate. Of what links only the edges of a
search tree are emitted. A bucket with more than ``LOAD`` shingles is dealt into chunks, and each pair of chunks meets in a
task of its own, so every pair is still covered.

Words are as in ``simhash``: split at ASCII white space, A-Z in lower case. Fewer than ``WIDTH`` words are one shingle,
and so are none; null is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.common import alone, checkpoint, importable, sliced
from driftline.operators.components import connected_components

SEED, WIDTH, SIMILARITY = 42, 5, 0.8
BANDS, ROWS = 20, 5
#: 64-bit words of a SimHash, those of them that key, differing bits up to which a pair is compared, pivots of a bucket.
WORDS, KEYED, BITS, PIVOTS = 4, 1, 80, 8
#: Shingles of a chunk, about.
LOAD = 1 << 21
#: Shingles that are min-hashed and tallied at once.
BATCH = 256
#: Odd factors of the min-hashes.
FACTORS = np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(BANDS * ROWS)], np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once."""
    parts = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends, n = np.cumsum([len(w) + 1 for w in parts]) - 1, max(1, len(parts) - WIDTH + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(WIDTH, len(parts)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def keys(own: np.ndarray) -> list[int]:
    """A signed key for each band of the min-hashes of a set."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), BATCH):
        np.minimum(least, (own[i : i + BATCH] * FACTORS[:, None]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread words of 64 bits for any."""
    x = (x ^ x >> np.uint64(32)) * FACTORS[0]
    x = (x ^ x >> np.uint64(29)) * FACTORS[1]
    return x ^ x >> np.uint64(32)


def fingerprint(own: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes: signed words with a bit where over half of the hashes, mixed for each word, have it."""
    tally = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(own), BATCH):
        words = mixed(own[i : i + BATCH, None] * FACTORS[:WORDS])
        tally += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * tally > len(own), bitorder="little").view(np.int64).tolist()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in sliced(batches):
        loads, found, fps = [], [], []
        for text in batch.column(2):
            own = shingles(text.as_py())
            loads.append(len(own))
            found.append(keys(own))
            fps.append(fingerprint(own))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, fps)]
        columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(loads, pa.int64()), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "rest", "load", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in sliced(batches):
        own = [shingles(text.as_py()).view(np.int64) for text in batch.column(1)]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *own])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "own"])


def hanging(bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, node) of what hangs together, by up to ``bits`` differing bits, within sorted buckets; none that is alone.

    A group is named by its nodes, so groups of the same ones have one name.
    """
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    length, label = np.diff(np.r_[start, len(bucket)]), np.arange(len(bucket))
    a = start[length == 2]
    a = a[simhash.distances(fp[a], fp[a + 1]) <= bits]
    label[a + 1] = a
    for s, n in zip(start[length > 2].tolist(), length[length > 2].tolist()):
        own = fp[s : s + n]
        label[s : s + n] = s + simhash.linked(own, bits, own[:: -(-n // PIVOTS)])
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
    size, node = np.diff(np.r_[first, len(order)]), node[order]
    name = np.add.reduceat(mixed(node.view(np.uint64) + np.uint64(1)), first).view(np.int64)
    several = np.repeat(size > 1, size)
    return np.repeat(name, size)[several], node[several]


def _sifted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Groups of buckets' nodes; rows come sorted by bucket."""
    alone()
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        cut = np.searchsorted(columns[0], columns[0][-1])  # the last bucket may go on
        held = [c[cut:] for c in columns]
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in hanging(*(c[:cut] for c in columns), bits)], ["bucket", "node"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in hanging(*held, bits)], ["bucket", "node"])


def tree(values: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """For sets one after another in ``values``, the edges of search trees over all that link."""
    at, starts = np.unique(values, return_inverse=True)[1], np.cumsum(lengths) - lengths
    mark = np.zeros(int(at.max()) + 1, bool)
    rest, out = np.arange(len(lengths)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            mine = at[starts[i] : starts[i] + lengths[i]]
            mark[mine] = True
            shared = np.add.reduceat(mark[at], starts, dtype=np.int64)[rest]
            mark[mine] = False
            # whole numbers: shared / union >= 4 / 5 without rounding
            near = shared * 1000 >= round(SIMILARITY * 1000) * (lengths[i] + lengths[rest] - shared)
            out += [(int(i), int(j)) for j in rest[near]]
            front += rest[near].tolist()
            rest = rest[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) between classes; rows come sorted by bucket."""
    alone()
    now, nodes, held = None, [], []

    def edges() -> pa.RecordBatch:
        found = tree(np.concatenate(held), np.array([len(x) for x in held])) if len(held) > 1 else []
        ends = np.array(nodes, np.int64)[np.array(found, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["src", "dst"])

    for batch in batches:
        lists = batch.column(2)
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, (bucket, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if bucket != now:
                if held:
                    yield edges()
                now, nodes, held = bucket, [], []
            nodes.append(node)
            held.append(values[ends[k] : ends[k + 1]].copy())
    if held:
        yield edges()


def links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (src, dst) that join all classes (node, doc_id, digest, load, keys, fp) that link, if not each such pair."""
    by_key = classes.select("node", "load", F.explode(F.concat("keys", simhash.block_keys(KEYED))).alias("key"))
    member = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = by_key.groupBy("key").agg(F.count("*").alias("n"), F.sum("load").alias("total"), *member).where("n > 1")
    buckets = shared.groupBy("n", "total", "x1", "x2").agg(F.min("key").alias("key"))
    dealt = by_key.join(buckets, "key").withColumn("chunks", F.ceil(F.col("total") / LOAD).cast("int"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int")
    dealt = dealt.select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node")
    met = dealt.join(classes.select("node", "fp"), "node").select("bucket", "node", "fp").repartition("bucket").sortWithinPartitions("bucket")
    dealt = checkpoint(met.mapInArrow(partial(_sifted, bits=BITS), "bucket long, node long").distinct())
    need = classes.join(dealt.select("node").distinct(), "node").select("node", "doc_id", "digest")
    sets = texts.join(need, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("node", "text").mapInArrow(_sets, "node long, own array<long>")
    met = dealt.join(sets, "node").select("bucket", "node", "own")
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links, "src long, dst long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with one row, of the smallest doc_id, for each group of near-duplicates.

    Rows that share a doc_id but hold unlike texts are judged as rows of their own. Of rows with the same doc_id and text,
    the one of the smallest hash of its other columns stays. Rows without a doc_id aren't judged and stay.
    """
    importable(docs)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*others)) if others else F.lit(0))
    text = F.coalesce("text", F.lit(""))
    judged = docs.where("doc_id IS NOT NULL")
    texts = judged.select("doc_id", F.md5(text).alias("digest"), text.alias("text"), rest.alias("rest"))
    found = texts.mapInArrow(_keyed, "doc_id long, digest string, rest long, load long, keys array<long>, fp array<long>")
    classes = found.groupBy("digest").agg(F.min(F.struct("doc_id", "rest")).alias("least"), F.first("load").alias("load"), *(F.first(c).alias(c) for c in ("keys", "fp")))
    classes = checkpoint(classes.select("digest", "least.*", "load", "keys", "fp", F.monotonically_increasing_id().alias("node")))
    components = connected_components(links(classes, texts))
    groups = classes.select("node", F.struct("doc_id", "digest", "rest").alias("row")).join(components, "node", "left")
    kept = groups.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("row").alias("row")).select("row.*")
    rows = judged.select("doc_id", F.md5(text).alias("digest"), rest.alias("rest"), F.struct("*").alias("row"))
    rows = rows.join(kept, ["doc_id", "digest", "rest"], "left_semi").dropDuplicates(["doc_id", "digest", "rest"])
    return rows.select("row.*").unionByName(docs.where("doc_id IS NULL"))
