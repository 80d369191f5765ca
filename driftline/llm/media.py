"""Media payloads in a content-defined chunk store.

A text becomes a payload of 8-bit samples: its UTF-8 bytes and bytes 255 up to a positive multiple of ``UNIT``. The
payload is cut where a rolling gear hash of the last 32 bytes has its top bits clear, at least ``LEAST`` and at most
``MOST`` bytes apart, so a passage that moves keeps its chunks. ``store`` writes a table of packs, a row for each
document: its ordered chunk digests, and the compressed bodies of those chunks that its partition hasn't stored before.
The table is bucketed by ``part``, the partition that wrote a row, so later joins on it don't move the bodies.

``holders`` deduplicates the digests over all packs by an aggregate and names one pack for each; ``read_back`` joins the
ordered lists with the named bodies, checks every digest and the payload's, and computes features from the bytes it
read. A chunk whose named pack is the list's own is read where it lies; only bodies that another pack names travel, those
of a chunk that very many lists want in as many copies as keep each join task small. ``compact`` rewrites the packs with
just the named bodies.

Payloads of one chunk go the same way as others and share their chunks. Copies of a payload share its list and its
features, so just one of them is read back. Null texts count as empty; those have one chunk of ``UNIT`` bytes. Rows that
repeat give repeated results, and an empty table gives none. Only the key and the text are read, so other columns can't
clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import alone, checkpoint, only, shared_folder, sliced, texts

UNIT, LEAST, MOST = 576, 256, 8 << 10
#: Top bits of the gear hash that are clear at a cut: 2 ** CLEAR bytes are between cuts, besides LEAST.
CLEAR = 10
LEVEL = 3
#: Digests that a task remembers before it starts anew.
SEEN = 200_000
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 42) for b in range(256)], np.uint32)
#: Lists that one copy of a wanted body serves.
SPREAD = 4096
PACK = "doc_id long, n_bytes long, payload_id binary, digests array<binary>, part int, pack long, held array<binary>, bodies array<binary>"
FEATURES = "payload_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def gear(data: bytes) -> np.ndarray:
    """The rolling hash at each byte: h = (h << 1) + GEAR[byte], of which 32 bytes are left; summed by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of a payload."""
    n = len(data)
    if n <= LEAST:
        return [n]
    found = np.flatnonzero(gear(data) >> np.uint32(32 - CLEAR) == 0) + 1
    out, start = [], 0
    while n - start > LEAST:
        k = np.searchsorted(found, start + LEAST)
        end = min(n, start + MOST, int(found[k]) if k < len(found) else n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    squeeze, seen, part, pack = zstandard.ZstdCompressor(level=LEVEL).compress, set(), TaskContext.get().partitionId(), 0
    binary, lists = pa.binary(), pa.list_(pa.binary())
    kinds = [pa.int64(), pa.int64(), binary, lists, pa.int32(), pa.int64(), lists, lists]
    for batch in sliced(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
            data = payload_of(text)
            ends = cuts(data)
            chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
            digests = [digest_of(c) for c in chunks]
            new = {d: c for d, c in zip(digests, chunks) if d not in seen}
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            pack += 1
            rows.append((doc_id, len(text.encode()), hashlib.sha256(data).digest(), digests, part, pack, list(new), [squeeze(c) for c in new.values()]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in PACK.split(", ")])


def _save(packs: DataFrame, folder: str) -> DataFrame:
    """Writes packs as a table that is bucketed by part, and returns it."""
    spark = packs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"driftline_packs_{uuid.uuid4().hex}"
    packs.write.bucketBy(buckets, "part").mode("overwrite").options(path=folder, compression="none").saveAsTable(name)
    return spark.table(name)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the packs of all rows below a folder, and returns them."""
    return _save(only(docs, "doc_id", "text").mapInArrow(_pack, PACK), folder)


@contextmanager
def _in_place(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a join on part and pack may use a partitioning by part alone, so packs aren't moved by both."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def holders(packs: DataFrame) -> DataFrame:
    """(digest, holder): for each digest the place (part, pack) of the body that stands for all its copies."""
    return packs.select(F.struct("part", "pack").alias("at"), F.explode("held").alias("digest")).groupBy("digest").agg(F.min("at").alias("holder"))


def _named(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The packs joined with what is wanted of them (a row for each part and pack), moving that and not the packs."""
    buckets = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packs.join(wanted.repartition(buckets, "part").hint("shuffle_hash"), ["part", "pack"])


def _bodies(held: str = "held", bodies: str = "bodies") -> Column:
    return F.arrays_zip(F.col(held).alias("digest"), F.col(bodies).alias("body"))


def compact(packs: DataFrame, folder: str) -> DataFrame:
    """Writes the packs with only the bodies that ``holders`` names, for keeping, and returns them."""
    named = holders(packs).groupBy("holder").agg(F.collect_list("digest").alias("named")).select("holder.*", "named")
    buckets = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = packs.join(named.repartition(buckets, "part").hint("shuffle_hash"), ["part", "pack"], "left")
    kept = F.filter(_bodies(), lambda x: F.array_contains(F.coalesce("named", F.array().cast("array<binary>")), x["digest"]))
    both = both.withColumn("kept", kept).withColumn("held", F.col("kept.digest")).withColumn("bodies", F.col("kept.body"))
    with _in_place(packs.sparkSession):
        return _save(both.select(*(x.split()[0] for x in PACK.split(", "))), folder)


def features(data: bytes, stored: list[bytes], payload_id: bytes) -> tuple:
    """The row of ``FEATURES`` of a payload that was read back."""
    if hashlib.sha256(data).digest() != payload_id:
        raise ValueError(f"payload {payload_id.hex()} isn't what was stored")
    samples = np.frombuffer(data, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    media = hashlib.sha256(b"".join(stored)).hexdigest()
    return payload_id, len(data), payload_id.hex(), zlib.crc32(data[-32:]), sum(map(len, stored)), media, f"{len(stored)};{samples.mean():.4f};{samples.std():.4f};{entropy:.4f}"


def opened(body: bytes, digest: bytes) -> bytes:
    """A chunk's bytes, checked against its digest."""
    data = zstandard.ZstdDecompressor().decompress(body)
    if digest_of(data) != digest:
        raise ValueError(f"chunk {digest.hex()} isn't what was stored")
    return data


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in FEATURES.split(", ")])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of payloads from their ordered digests, the bodies beside them and those that came from elsewhere."""
    alone()
    for batch in sliced(batches, 256):
        rows = []
        for payload, digests, held, bodies, come in zip(*(batch.column(c).to_pylist() for c in ("payload_id", "digests", "held", "bodies", "come"))):
            own = dict(zip(held, bodies)) | {x["digest"]: x["body"] for x in come or ()}
            data = {d: opened(own[d], d) for d in set(digests)}
            rows.append(features(b"".join(map(data.__getitem__, digests)), [own[d] for d in digests], payload))
        yield _table(rows)


def read_back(packs: DataFrame) -> DataFrame:
    """Features of each distinct payload, from the bytes that its ordered list leads to."""
    lists = packs.groupBy("payload_id").agg(F.min(F.struct("part", "pack", "digests")).alias("x"))
    lists = checkpoint(lists.select(F.struct("x.part", "x.pack").alias("at"), F.array_distinct("x.digests").alias("digests")))
    wants = lists.select("at", F.explode("digests").alias("digest")).join(holders(packs), "digest").where("holder != at")
    wants = checkpoint(wants)
    asked = wants.groupBy("digest", "holder").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("copies"))
    exports = asked.groupBy("holder").agg(F.map_from_entries(F.collect_list(F.struct("digest", "copies"))).alias("copies")).select("holder.*", "copies")
    sent = _named(packs.select("part", "pack", "held", "bodies"), exports)
    sent = sent.select("copies", F.explode(F.filter(_bodies(), lambda x: F.map_contains_key("copies", x["digest"]))).alias("x"))
    sent = sent.select("x.digest", "x.body", F.explode(F.sequence(F.lit(0), F.element_at("copies", F.col("x.digest")) - 1)).alias("copy"))
    copies = asked.select("digest", "copies")
    dealt = wants.join(copies, "digest").select("at", "digest", F.pmod(F.xxhash64("at"), F.col("copies")).cast("int").alias("copy"))
    come = dealt.join(sent, ["digest", "copy"]).groupBy("at").agg(F.collect_list(F.struct("digest", "body")).alias("come"))
    needs = lists.select("at").join(come, "at", "left").select("at.*", "come")
    whole = _named(packs.select("part", "pack", "payload_id", "digests", "held", "bodies"), needs)
    with _in_place(packs.sparkSession):
        return checkpoint(whole.select("payload_id", "digests", "held", "bodies", "come").mapInArrow(_rebuilt, FEATURES))


def payloads(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores all payloads below ``folder`` (by default, one of the shared folders), reads them back and returns each row's features."""
    packs = store(docs, folder or shared_folder(docs.sparkSession, "media"))
    found = read_back(packs)
    return packs.select("doc_id", "n_bytes", "payload_id").join(found, "payload_id").select("doc_id", "n_bytes", *(c.split()[0] for c in FEATURES.split(", ")[1:]))
