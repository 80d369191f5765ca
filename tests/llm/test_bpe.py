import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftline.llm import bpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def samples() -> list[str]:
    rng = random.Random(3)
    pool = "abcdefghi THE   the\n\n\t'sre's 'll0123é ßΣΑΣ İ日本語　\x1c\x1f\x85  !?.,<|end>oftxá😀​́"
    out = ["", " ", "  ", "a", "Σ ΑΣ", "a<|endoftext|>b <|startoftext|> <|endoftext|>", "x" * 3000, "ab" * 500 + " " * 70 + "\n", "he's We'LL don't", "<|endoftext|", "\x00\x1c\x1da\x1e"]
    out += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    return out


def test_counts_equal_the_library():
    t, own = Tokenizer.from_file(WORD), bpe.counter(WORD)
    for x in samples():
        assert own.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_ids_and_decoded_text_equal_the_library():
    t, own = Tokenizer.from_file(BYTE), bpe.encoder(BYTE)
    for x in samples():
        ids = t.encode(x, add_special_tokens=False).ids
        found = own.encode(x)
        assert [int(i) for f in found for i in f[1].split(",")] == ids, repr(x)
        assert b"".join(f[2] for f in found).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_single_code_points(path):
    t, own = Tokenizer.from_file(path), bpe.counter(path)
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F400)]
    wrong = [hex(ord(c)) for c in points if own.count(f"a{c}b {c}") != len(t.encode(f"a{c}b {c}", add_special_tokens=False).ids)]
    assert wrong == []


def test_both_mergers_agree():
    v = bpe.Vocabulary(BYTE)
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 40, 300):
        symbols = v.symbols("".join(rng.choice("aentio rsh") for _ in range(n)))
        assert len(bpe.encode_symbols(symbols, v)) == bpe.count_symbols(symbols, v)


def test_the_tree_merges_as_a_plain_scan_does():
    """Every piece, short or long, has the ids of a scan for the leftmost pair of the lowest rank."""
    v = bpe.Vocabulary(BYTE)
    rng = random.Random(9)
    for n in [*range(1, 70)] * 6 + [127, 128, 129, 255, 256, 257, 600]:
        symbols = v.symbols("".join(rng.choice("aentio rshdé") for _ in range(n)))
        plain = symbols[:]
        while found := [(v.ranks[k], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if (k := a << 20 | b) in v.ranks]:
            rank, i = min(found)
            plain[i : i + 2] = [v.merged[rank]]
        kept = symbols[:]
        assert bpe.encode_symbols(symbols, v) == plain and symbols == kept


def test_trees_side_by_side_merge_as_one_alone_does():
    """Pieces of all lengths together, with ends that don't merge, have the ids of each one's own tree."""
    v = bpe.Vocabulary(BYTE)
    rng = random.Random(11)
    pieces = ["".join(rng.choice("aentio rshdé\x00日") for _ in range(rng.randrange(2, 22))) for _ in range(800)]
    pieces += ["ab", "\x00\x01", "e" * 65, " the", "the" * 21]
    for group in (pieces, pieces[-5:-4], pieces[-4:-3], [p for p in pieces if len(p.encode()) == 3]):
        assert bpe.encode_together([p.encode() for p in group], v) == [bpe.encode_symbols(v.symbols(p), v) for p in group]


def test_prepared_texts_have_the_same_ids(monkeypatch):
    """What is prepared is what the library finds, and nearly all new pieces of plain texts are; a second time there are none."""
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    t, own = Tokenizer.from_file(BYTE), bpe.Encoder(bpe.Vocabulary(BYTE))
    rows = samples()[:600] + [" some plain words, one after another: caffè 日本語 1234"]
    own.prepare(rows)
    assert len(own.ready) > 500
    for x in rows:
        assert [int(i) for f in own.encode(x) for i in f[1].split(",")] == t.encode(x, add_special_tokens=False).ids, repr(x)
    own.prepare(rows[-1:])
    assert own.ready == {}


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_queries_equal_the_library_through_spark(spark):
    rows = [(i, t, "x", i, 1.0) for i, t in enumerate(samples()[:300])] + [(7, None, "x", 0, 1.0), (None, "ab ab", "x", 0, 1.0), (7, "ab", "x", 0, 1.0), (7, "ab", "x", 0, 1.0), (9000, "é" * 40_000 + " x" * 1500, "x", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long, `a.b` double").repartition(3)
    key = lambda x: tuple((v is None, v) for v in x)
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    counts, codes = [], []
    for i, t, *_ in rows:
        n = len(word.encode(t or "", add_special_tokens=False).ids)
        counts.append((i, len((t or "").encode()), n, n > 2048))
        ids = byte.encode(t or "", add_special_tokens=False).ids
        codes.append((i, len(ids), sha(",".join(map(str, ids))), sha(byte.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.token_counts(docs, WORD).collect()), key=key) == sorted(counts, key=key)
    assert sorted(map(tuple, bpe.encode(docs, BYTE, full=False).collect()), key=key) == sorted(codes, key=key)
    full = bpe.encode(docs.where("doc_id < 100"), BYTE)
    assert {(r.doc_id, r.text) for r in bpe.decode(full, BYTE).collect()} == {(i, t or "") for i, t, *_ in rows if i is not None and i < 100}
    assert bpe.token_counts(docs.limit(0), WORD).count() == bpe.encode(docs.limit(0), BYTE).count() == 0


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20_000)
    t, own, counts = Tokenizer.from_file(BYTE), bpe.Encoder(bpe.Vocabulary(BYTE)), bpe.Counter(bpe.Vocabulary(WORD))
    for x in samples()[:400] + ["日本語" * 5000]:
        assert [int(i) for f in own.encode(x) for i in f[1].split(",")] == t.encode(x, add_special_tokens=False).ids
        counts.count(x)
        for memo in (own, own.after_blank, counts):
            assert len(memo) * bpe.ENTRY <= 20_000 and all(len(c) <= bpe.SHORT for c in memo)


def test_other_normalisers_are_refused():
    with pytest.raises(ValueError, match="supported"):
        bpe.Vocabulary._normaliser({"type": "NFKC"})
