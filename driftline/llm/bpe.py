"""Byte-pair encoding over public vocabulary files.

Two mergers share one vocabulary reader: ``count_symbols`` (heap and linked list; yields a count, no identifiers)
and ``encode_symbols`` (segment tree over adjacent pair ranks; ``encode_together`` steps through the trees of many pieces
at once). Both are memoised by white-space-delimited chunk in
each Python worker, as chunks repeat. Chunks over ``SHORT`` characters aren't kept, and the memo is emptied when what it
keeps reaches about ``MEMO`` bytes, so memory stays bounded for any script. A piece of n symbols costs O(n log n) by
either merger.

Nulls count as empty texts; an empty text has no tokens. Repeated rows give repeated results. Columns other than the
key and the text are not read, so they can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from driftline.llm.common import alone, only, sliced, texts

#: Bytes, about, that a worker keeps before it starts its memo anew; what an entry takes besides its characters; longest chunk kept.
MEMO, ENTRY, SHORT = 250_000_000, 300, 64
#: Pieces whose trees are stepped through at once, and the most pairs of each.
TOGETHER, PAIRS = 2048, 64
#: The white space of the vocabulary files' patterns (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Python's splitters also take these for white space.
ODD = re.compile("[\x1c-\x1f]")
CHUNKS = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SPLIT = re.compile(rf"[{SPACE}]+")
#: White space other than single blanks and single line feeds apart from each other.
UNEVEN = re.compile(rf"[{SPACE.replace(' ', '').replace(chr(10), '')}]| [ \n]|\n ")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free code point from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in seen:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class Vocabulary:
    """A tokenizers .json file: symbols of bytes, merges by rank, special strings.

    ``ranks`` maps a pair of ids, packed as a << 20 | b, to its rank, and ``merged`` a rank to the id that it makes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.pattern, self.invert = self._pattern(spec["pre_tokenizer"])
        #: A piece of the public pattern is one piece by itself too, whatever stood beside it.
        self.public = not any(p["type"] == "Split" for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]))
        self.normalises = self._normaliser(spec.get("normalizer"))
        symbols = byte_symbols()
        self.first = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols] if self.suffix else self.first
        self.whole = None not in self.first and None not in self.last
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pairs.tolist()], np.int64)
        self.made = np.array(self.merged, np.int64)
        self.byte_ranks = np.array([[-1 if a is None or b is None else self.ranks.get(a << 20 | b, -1) for b in self.first] for a in self.first], np.int64)
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.markers = sorted({s[:2] for s in self.special})

    @staticmethod
    def _normaliser(spec: dict | None) -> bool:
        """Whether texts are normalised: by NFC, white space to a blank and lower case; anything else isn't supported."""
        kinds = [] if spec is None else [x["type"] for x in spec.get("normalizers", [spec])]
        if kinds and kinds not in (["NFC", "Replace", "Lowercase"], ["NFC", "Lowercase"]):
            raise ValueError(f"normalizer {kinds} isn't supported")
        return bool(kinds)

    @staticmethod
    def _pattern(spec: dict) -> tuple[regex.Pattern, bool]:
        parts = spec.get("pretokenizers", [spec])
        own = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), None)
        if own is None:
            #: Fixed value: the public byte-level pattern.
            own = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        own = own.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        return regex.compile(own), False

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings: (part, whether it is one)."""
        if self.specials is None or not any(m in text for m in self.markers):
            yield text, False
            return
        for k, part in enumerate(self.specials.split(text)):
            if part:
                yield part, bool(k % 2)

    def normalise(self, text: str) -> str:
        """NFC and lower case, code point by code point (white space only separates, so it is left as it is)."""
        if not self.normalises:
            return text
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def symbols(self, piece: str) -> list[int]:
        data, first = piece.encode(), self.first
        out = [first[b] for b in data]
        if self.suffix:
            out[-1] = self.last[data[-1]]
        return out if self.whole else [i for i in out if i is not None]


def count_symbols(symbols: list[int], vocabulary: Vocabulary) -> int:
    """Symbols that are left after all merges: as many as at first, less one for each merge.

    A heap holds the adjacent pairs by rank, then by place; a linked list joins the symbols that are still there. An
    entry is stale if the pair at its place has another rank by now.
    """
    n = len(symbols)
    if n < 2:
        return n
    get, merged, bits = vocabulary.ranks.get, vocabulary.merged, n.bit_length()
    low = (1 << bits) - 1
    now = [get(a << 20 | b) for a, b in zip(symbols, symbols[1:])]
    heap = [r << bits | i for i, r in enumerate(now) if r is not None]
    if not heap:
        return n
    now.append(None)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    symbols, after, before, left = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        top = pop(heap)
        i, r = top & low, top >> bits
        if now[i] != r:
            continue
        j = after[i]
        s = symbols[i] = merged[r]
        now[j] = now[i] = None
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            r = get(s << 20 | symbols[k])
            if r is not None:
                now[i] = r
                push(heap, r << bits | i)
        h = before[i]
        if h >= 0:
            r = now[h] = get(symbols[h] << 20 | s)
            if r is not None:
                push(heap, r << bits | h)
    return left


def encode_symbols(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """The ids after all merges, by a binary segment tree of minima over the adjacent pairs, whatever their number.

    ``tree[1]`` is the root, the children of x are 2x and 2x + 1, and the last m nodes are the leaves of the m pairs. A
    leaf holds the pair's rank and place, so the root is the leftmost pair of the lowest rank. A merge sets up to three
    leaves and climbs from each: from the pairs beside it until a node keeps its value, from its own to the root.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, merged, bits, m = vocabulary.ranks.get, vocabulary.merged, n.bit_length(), n - 1
    none = 1 << bits + 20  # above all keys, as ids and so ranks have 20 bits
    tree = [none] * m + [none if (r := get(a << 20 | b)) is None else r << bits | i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    for x in range(m - 1, 0, -1):
        a, b = tree[x + x], tree[x + x + 1]
        tree[x] = a if a < b else b
    top = tree[1]
    if top == none:
        return symbols
    symbols, after, before, low = symbols[:], list(range(1, n + 1)), list(range(-1, m)), (1 << bits) - 1
    while top != none:
        i = top & low
        j = after[i]
        s = symbols[i] = merged[top >> bits]
        symbols[j] = -1
        k = after[i] = after[j]
        own = none
        if k < n:
            before[k] = i
            if (r := get(s << 20 | symbols[k])) is not None:
                own = r << bits | i
            x, least = m + j, none
            while x and tree[x] != least:
                tree[x] = least
                if (other := tree[x ^ 1]) < least:
                    least = other
                x >>= 1
        h = before[i]
        if h >= 0:
            x, least = m + h, none if (r := get(symbols[h] << 20 | s)) is None else r << bits | h
            while x and tree[x] != least:
                tree[x] = least
                if (other := tree[x ^ 1]) < least:
                    least = other
                x >>= 1
        x = m + i
        while x > 1:
            tree[x] = own
            if (other := tree[x ^ 1]) < own:
                own = other
            x >>= 1
        top = tree[1] = own
    return [s for s in symbols if s >= 0]


def encode_together(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of pieces of 2 to ``PAIRS`` + 1 bytes each: the trees of ``encode_symbols``, stepped through side by side.

    A row is a piece; its tree has a power of two of leaves. Each step merges at the roots of all rows that aren't done,
    sets the three leaves of each and climbs from them. Node 0 and the last symbol, which is none, take what falls off
    the ends.
    """
    rows, width = len(pieces), max(map(len, pieces)) + 1
    leaves, none, pairs = 1 << (width - 3).bit_length(), 1 << 40, vocabulary.pairs

    def key(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        pair = a << 20 | b
        at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        return np.where(pairs[at] == pair, vocabulary.pair_ranks[at] << 7 | place, none)

    size, places = np.array([len(p) for p in pieces]), np.arange(width, dtype=np.int64)
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    symbols = np.where(places < size[:, None], np.array(vocabulary.first, np.int64)[data], -1)
    after, before = np.tile(np.minimum(places + 1, width - 1), (rows, 1)), np.tile(places - 1, (rows, 1))
    tree = np.full((rows, 2 * leaves), none, np.int64)
    ranks = vocabulary.byte_ranks[data[:, :-2], data[:, 1:-1]]
    tree[:, leaves : leaves + width - 2] = np.where((ranks >= 0) & (places[1:-1] < size[:, None]), ranks << 7 | places[:-2], none)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(rows, -1, 2).min(axis=2)
        level //= 2
    flat, ids, after, before = tree.reshape(-1), symbols.reshape(-1), after.reshape(-1), before.reshape(-1)
    live = np.arange(rows)
    while True:
        top = flat[live * (2 * leaves) + 1]
        left = top != none
        live, top = live[left], top[left]
        if not len(live):
            break
        at, root = live * width, live * (2 * leaves)
        i, s = top & 127, vocabulary.made[top >> 7]
        j = after[at + i]
        k = after[at + j]
        ids[at + i], ids[at + j], after[at + i], before[at + k] = s, -1, k, i
        h = before[at + i]
        sides = np.stack([i, h, j])
        nodes = np.where(sides < 0, 0, leaves + sides)
        nodes[2] = np.where(j < width - 2, nodes[2], 0)  # the last symbol begins no pair
        flat[root + nodes[2]] = none
        flat[root + nodes[0]] = key(s, ids[at + k], i)
        flat[root + nodes[1]] = np.where(h < 0, none, key(ids[at + h], s, h))
        for _ in range(leaves.bit_length() - 1):
            nodes >>= 1
            child = root + 2 * nodes
            flat[root + nodes] = np.minimum(flat[child], flat[child + 1])
    kept = symbols >= 0
    ends = np.cumsum(kept.sum(axis=1)).tolist()
    found = symbols[kept].tolist()
    return [found[a:b] for a, b in zip([0, *ends], ends)]


class Memo(dict):
    """Chunk to what was found for it, kept within bounds; ``found`` says what that is, and its bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.room = vocabulary, MEMO

    def clear(self) -> None:
        super().clear()
        self.room = MEMO

    def __missing__(self, chunk: str):
        out, size = self.found(chunk)
        if len(chunk) <= SHORT:
            self.room -= ENTRY + size
            if self.room < 0:
                self.clear()
            self[chunk] = out
        return out


class Counter(Memo):
    """Chunk to its number of tokens."""

    def found(self, chunk: str) -> tuple[int, int]:
        v = self.vocabulary
        pieces = v.pattern.findall(chunk)
        if len(pieces) > 1:  # pieces repeat more than chunks, so they are kept too
            return sum(map(self.__getitem__, pieces)), 2 * len(chunk)
        return sum(count_symbols(v.symbols(p), v) for p in pieces), 2 * len(chunk)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        v, total = self.vocabulary, 0
        for part, special in v.parts(text):
            if special:
                total += 1
            else:
                part = v.normalise(part)
                if not v.normalises:
                    chunks = CHUNKS.findall(part)
                else:
                    chunks = [x for x in SPLIT.split(part) if x] if ODD.search(part) else part.split()
                total += sum(map(self.__getitem__, chunks))
        return total


Encoded = tuple[int, str, bytes]


class Encoder(Memo):
    """Chunk to (number of tokens, ids as text, bytes that they decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.after_blank = AfterBlank(self)
        self.ready: dict[str, list[int]] = {}

    def clear(self) -> None:
        super().clear()
        self.after_blank.clear()
        self.ready.clear()

    def found(self, chunk: str) -> tuple[Encoded, int]:
        v = self.vocabulary
        found = self.ready.get(chunk) if v.public else None
        pieces = v.pattern.findall(chunk) if found is None else ()
        if len(pieces) > 1:  # pieces repeat more than chunks, so they are kept too
            n, ids, data = zip(*map(self.__getitem__, pieces))
            out = sum(n), ",".join(ids), b"".join(data)
        else:
            found = found or [i for p in pieces for i in encode_symbols(v.symbols(p), v)]
            out = len(found), ",".join(map(str, found)), self.decode(found)
        return out, 2 * len(chunk) + len(out[1]) + len(out[2])

    def prepare(self, rows: list[str]) -> None:
        """Encodes together what is new among the pieces of texts that are cut at blanks; ``encode`` finds the others itself."""
        v = self.vocabulary
        self.ready.clear()
        if v.suffix or not v.whole or not v.public:
            return
        words: set[str] = set()
        for text in rows:
            words.update(text.split(" "))
        words.difference_update(self.after_blank)
        pieces = set(v.pattern.findall(" " + " ".join(w for w in words if len(w) < SHORT))).difference(self)
        new = sorted(pieces, key=len)
        for k in range(0, len(new), TOGETHER):
            names = [p for p in new[k : k + TOGETHER] if 2 <= len(p.encode()) <= PAIRS + 1]
            if names:
                self.ready.update(zip(names, encode_together([p.encode() for p in names], v)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[Encoded]:
        v, out = self.vocabulary, []
        for part, special in v.parts(text):
            if special:
                i = v.special[part]
                out.append((1, str(i), v.bytes_of[i]))
            elif UNEVEN.search(part := v.normalise(part)) or not part:
                out += map(self.__getitem__, CHUNKS.findall(part))
            else:  # cut at each blank: the pieces on both sides of it don't depend on each other
                first, *rest = part.split(" ")
                if first:
                    out.append(self[first])
                out += map(self.after_blank.__getitem__, rest)
        return out


class AfterBlank(dict):
    """What an encoder finds for a blank and a word, by the word; it shares the encoder's bound."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> Encoded:
        e, chunk = self.encoder, " " + word
        if len(chunk) > SHORT:
            return e[chunk]
        out, size = e.found(chunk)
        e.room -= ENTRY + size
        if e.room < 0:
            e.clear()
        self[word] = out
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(Vocabulary(path))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    alone(own)
    for batch in sliced(batches):
        rows = texts(batch)
        n = [own.count(x) for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; ``path``: the vocabulary file."""
    return only(docs, "doc_id", "text").mapInArrow(partial(_count, path=path, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _encode(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    alone(own)
    for batch in sliced(batches):
        columns: list[list] = [[], [], [], []]
        rows = texts(batch)
        own.prepare(rows)
        for text in rows:
            n, ids, data = zip(*own.encode(text)) if text else ((), (), ())
            ids, decoded = ",".join(ids), b"".join(data).decode("utf-8", "replace")
            columns[0].append(sum(n))
            columns[1].append(hashlib.sha256(ids.encode()).hexdigest())
            columns[2].append(hashlib.sha256(decoded.encode()).hexdigest())
            if full:
                columns[3].append([int(x) for x in ids.split(",")] if ids else [])
        arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            arrays.append(pa.array(columns[3], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def encode(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them and, if ``full``, the ids of each row."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * full
    return only(docs, "doc_id", "text").mapInArrow(partial(_encode, path=path, full=full), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        rows = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of ids; null ids give a null text."""
    return only(encoded, "doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, text string")
