"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has a bit where over half of its shingles' hashes have it. Equal fingerprints form a class, so
exact copies never meet in pairs. Two fingerprints that differ in at most ``bits`` (3) of 64 bits agree on at least
three of six blocks; a class is keyed by each choice of three (about 32 bits), so keys are rare by chance at any
corpus size. Within a key, each fingerprint's distances to ``PIVOTS`` reference fingerprints are tabled; as
| d(x, p) - d(y, p) | <= d(x, y), a pair whose distances differ by more than ``bits`` for any pivot is discarded, and
survivors are verified bit by bit. Of what links within a key only a spanning tree is emitted, balanced so that no node
gets many edges. A key with more than ``CHUNK`` classes is dealt into chunks, and each pair of chunks meets in a task
of its own: every pair is still covered, and no task holds more than about 2 x CHUNK classes of a key.

Several fingerprints of 64 bits, each with a seed and a shingle width of its own, can stand side by side: the first
``keyed`` words key the classes, and the words from ``judged`` on decide, at up to ``bits`` differing bits in all. A key
is exact up to 3 differing bits in one of the words; beyond that, candidates are those that agree on three blocks of any
word. The pipeline's near-duplicates take these keys and pivot tables too, and then compare shingle sets, see ``shingles``.

Null and empty texts have no words and fingerprint zero; they link like any other. Repeated rows share a class.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import alone, checkpoint, only, sliced
from driftline.operators.components import connected_components

SEED = 42
PIVOTS = 24
CHUNK = 1024
#: Bits of the six blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Shingles that are tallied at once.
BATCH = 1 << 16


def fingerprint_of(text: str, widths: tuple[int, ...]) -> tuple[int, ...]:
    """A 64-bit fingerprint, as a signed integer, of shingles of each width; seeds count up from ``SEED``."""
    parts = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return (0,) * len(widths)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    out = []
    for k, width in enumerate(widths):
        n, tally = max(1, len(parts) - width + 1), np.zeros(64, np.int64)
        starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(width, len(parts)) - 1 :].tolist()
        for i in range(0, n, BATCH):
            hashes = np.array([digest(joined[a:b], SEED + k) for a, b in zip(starts[i : i + BATCH], stops[i : i + BATCH])], np.uint64)
            tally += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((2 * tally > n).astype(np.uint8), bitorder="little").view(np.int64)[0]))
    return tuple(out)


def _fingerprints(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in sliced(batches):
        found = [fingerprint_of(x.as_py() or "", widths) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, widths: tuple[int, ...] = (3,)) -> DataFrame:
    """doc_id and fp (an array of signed words) of each row."""
    return only(docs, "doc_id", "text").mapInArrow(partial(_fingerprints, widths=widths), "doc_id long, fp array<long>")


def _keys() -> list[int]:
    """A mask for each choice of three blocks."""
    at = [0, *itertools.accumulate(BLOCKS)]
    blocks = [((1 << n) - 1) << a for n, a in zip(BLOCKS, at)]
    return [sum(x) - (1 << 64 if sum(x) >> 63 else 0) for x in itertools.combinations(blocks, 3)]


def block_keys(keyed: int) -> Column:
    """The keys of the first ``keyed`` words of ``fp``: one for each choice of three blocks."""
    masks = _keys()
    return F.array(*(F.xxhash64(F.lit(w), F.lit(k), F.col("fp")[w].bitwiseAND(F.lit(m))) for w in range(keyed) for k, m in enumerate(masks)))


def pivots(words: int) -> np.ndarray:
    """The reference fingerprints (pivot, word): fixed pseudo-random words."""
    return np.array([[xxhash.xxh64_intdigest(bytes([i, k]), SEED) for k in range(words)] for i in range(PIVOTS)], np.uint64)


def distances(fps: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (..., word)."""
    return np.bitwise_count(fps ^ others).astype(np.int16).sum(axis=-1)


def linked(fps: np.ndarray, bits: int, own: np.ndarray | None = None) -> np.ndarray:
    """For fingerprints (row, word) of one key, the least index that each one reaches; ``own``: other pivots than the fixed ones."""
    n = len(fps)
    table = distances(fps[:, None], pivots(fps.shape[1])) if own is None else np.stack([distances(fps, p) for p in own], axis=1)
    label, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        root = rest[0]
        label[root], rest, front = root, rest[1:], [root]
        while front and len(rest):
            i = front.pop()
            near = np.flatnonzero(np.abs(table[rest] - table[i]).max(axis=1) <= bits)
            near = near[distances(fps[rest[near]], fps[i]) <= bits]
            if len(near):
                found = rest[near]
                label[found] = root
                front += found.tolist()
                rest = np.delete(rest, near)
    return label


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst) between class representatives; rows come sorted by bucket."""
    alone()
    held: list[np.ndarray] = []

    def edges(bucket, rep, fp):
        start, own = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), pivots(fp.shape[1])
        length = np.diff(np.r_[start, len(bucket)])
        a = start[length == 2]
        near = np.abs(distances(fp[a][:, None], own) - distances(fp[a + 1][:, None], own)).max(axis=1, initial=0) <= bits
        a = a[near]
        a = a[distances(fp[a], fp[a + 1]) <= bits]
        src, dst = [rep[a]], [rep[a + 1]]
        for s, n in zip(start[length > 2].tolist(), length[length > 2].tolist()):
            label, reps = linked(fp[s : s + n], bits), rep[s : s + n]
            order = np.lexsort((reps, label))
            first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
            place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
            child = np.flatnonzero(place)
            src.append(reps[order[child]])
            dst.append(reps[order[child - place[child] + (place[child] - 1) // 2]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (src, dst)], ["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        cut = np.searchsorted(columns[0], columns[0][-1])  # the last bucket may go on
        held = [c[cut:] for c in columns]
        if cut:
            yield edges(*(c[:cut] for c in columns))
    if held:
        yield edges(*held)


def links(classes: DataFrame, bits: int = 3, keyed: int = 1, judged: int = 0) -> DataFrame:
    """Edges (src, dst) that join all classes (fp, rep) that link, if not each such pair."""
    carried = ["rep", "fp"] if keyed == 1 else ["rep"]  # one word is carried along; more are joined to the few rows that share a key
    by_key = classes.select(*carried, F.explode(block_keys(keyed)).alias("key"))
    shared = by_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = by_key.join(shared, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("rep", "key"), F.col("chunks")).cast("int")
    dealt = dealt.select("key", *carried, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), *carried)
    dealt = dealt if "fp" in carried else dealt.join(classes, "rep")
    dealt = dealt.select("bucket", "rep", F.slice("fp", judged + 1, F.size("fp") - judged).alias("fp"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_links, bits=bits), "src long, dst long")


def near_duplicates(docs: DataFrame, widths: tuple[int, ...] = (3,), bits: int = 3, keyed: int = 1, judged: int = 0) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits a word) and component_id (the smallest doc_id reachable) of each row."""
    fps = checkpoint(fingerprints(docs, widths))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(links(classes.where("rep IS NOT NULL"), bits, keyed, judged))
    classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    digits = F.array_join(F.transform("fp", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
    return fps.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The pipeline's near-duplicates, decided by shingle sets among what fingerprints let pass."""
    from driftline.llm import shingles  # it builds on this module

    return shingles.deduplicated(docs)
