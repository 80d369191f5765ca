"""Token ids packed into fixed-length rows, as binary matrices.

Texts are encoded by a public rank file. A text longer than a row is cut into whole rows and a rest, losing nothing.
The pieces of a block of about ``BLOCK`` tokens are packed best-fit-decreasing: from the longest piece on, each goes to
the open row with the least room that still holds it, found by a segment tree over the room that rows have left. A row
carries its ids and the position of each id in its piece (which starts at 0 again with each piece) as little-endian
binary, the cumulative piece lengths, and the document and offset of each piece. Blocks are packed where they are read:
no shuffle, and a task holds one block.

A text with a run of 256 or more white-space characters is cut at the pattern's own boundaries first and encoded piece
by piece, as the encoder's pattern matcher can't bear such runs; its ids are the same. Null and empty texts have no
tokens and so no piece. Rows that repeat are packed each. Columns other than the key and
the text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from driftline.llm.bpe import SPACE
from driftline.llm.common import alone, only, texts

LENGTH = 2048
BLOCK = 4_000_000
#: A run that the encoder isn't given.
RUN = re.compile(rf"[{SPACE}]{{256}}")
SCHEMA = "row_id long, n_tokens int, n_pieces int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<int>"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def splitter(pattern: str) -> regex.Pattern:
    """The encoder's pattern; what it takes for white space is spelled out."""
    return regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def ids_of(own: tiktoken.Encoding, pattern: str, text: str) -> list[int]:
    if not RUN.search(text):
        return own.encode_ordinary(text)
    return [i for piece in splitter(pattern).findall(text) for i in own._encode_single_piece(piece)]


class Rooms:
    """Open rows by the room they have left: a segment tree of counts over 0..length."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes the row with the least room of at least ``least``: (room, row)."""
        at = least + self.size
        while not self.tree[at]:
            while at & 1:  # a right child: on to where a left one is
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Indexes of the pieces in each row."""
    rooms, rows = Rooms(length), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = rooms.take(lengths[k])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        if room > lengths[k]:
            rooms.put(room - lengths[k], row)
    return rows


def _rows(pieces: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, kind: str, first: int) -> pa.RecordBatch:
    packed = best_fit([len(p[2]) for p in pieces], length)
    columns: list[list] = [[] for _ in range(8)]
    count = np.arange(length, dtype=np.uint32 if length > 65535 else np.uint16)
    for k, row in enumerate(packed):
        sizes = [len(pieces[i][2]) for i in row]
        used = sum(sizes)
        ids = np.full(length, pad, kind)
        ids[:used] = np.concatenate([pieces[i][2] for i in row])
        positions = np.concatenate([count[:n] for n in [*sizes, length - used]]).astype(f"<u{count.itemsize}")
        values = first + k, used, len(row), ids.tobytes(), positions.tobytes(), [0, *np.cumsum(sizes).tolist()], [pieces[i][0] for i in row], [pieces[i][1] for i in row]
        for column, value in zip(columns, values):
            column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch], path: str, pattern: str, length: int, block: int) -> Iterator[pa.RecordBatch]:
    alone()
    own = encoding(path, pattern)
    pad = own.n_vocab
    kind, first = "<u2" if pad < 1 << 16 else "<u4", TaskContext.get().partitionId() << 40
    pieces: list[tuple[int | None, int, np.ndarray]] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
            ids = np.array(ids_of(own, pattern, text), kind)
            pieces += [(doc_id, k, ids[k : k + length]) for k in range(0, len(ids), length)]
            held += len(ids)
            if held >= block:
                out = _rows(pieces, length, pad, kind, first)
                first, pieces, held = first + out.num_rows, [], 0
                yield from (out.slice(k, 512) for k in range(0, out.num_rows, 512))
    if pieces:
        yield _rows(pieces, length, pad, kind, first)


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Packed rows of ``length`` ids; ``path`` and ``pattern``: the rank file and what splits texts before its merges."""
    return only(docs, "doc_id", "text").mapInArrow(partial(_pack, path=path, pattern=pattern, length=length, block=block), SCHEMA)


def _unpack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, offsets, ids = [], [], []
        for row in batch.to_pylist():
            whole = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * length else "<u4")
            cu = row["cu_seqlens"]
            for doc, offset, a, b in zip(row["doc_ids"], row["offsets"], cu, cu[1:]):
                docs.append(doc)
                offsets.append(offset)
                ids.append(whole[a:b].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "offset", "ids"])


def unpack(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces (doc_id, offset, ids) of packed rows."""
    return packed.mapInArrow(partial(_unpack, length=length), "doc_id long, offset int, ids array<int>")


def write(packed: DataFrame, folder: str) -> None:
    """Writes packed rows as Parquet, whose binary columns are the matrices' rows."""
    packed.write.mode("overwrite").parquet(folder)
