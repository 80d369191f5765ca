import random

import numpy as np
import public_tokenizers
import pytest

from driftline.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(lengths, length):
    left, rows = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [r for r in range(len(left)) if left[r] >= lengths[k]]
        if fits:
            r = min(fits, key=lambda r: left[r])
        else:
            r = len(left)
            left.append(length)
            rows.append([])
        rows[r].append(k)
        left[r] -= lengths[k]
    return sorted(left)


@pytest.mark.parametrize("length", [1, 2, 7, 8, 64, 100])
def test_best_fit_decreasing(length):
    rng = random.Random(length)
    for n in (0, 1, 5, 60, 300):
        lengths = [rng.randrange(1, length + 1) for _ in range(n)]
        rows = packing.best_fit(lengths, length)
        assert sorted(k for r in rows for k in r) == list(range(n))
        assert sorted(length - sum(lengths[k] for k in r) for r in rows) == brute(lengths, length)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "oua", "é", "\n"]) for _ in range(rng.randrange(0, 300)))) for i in range(200)] + [(300, None), (301, ""), (302, "w " * 3000), (303, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = packing.encoding(RANKS, public_tokenizers.PATTERN)
    packed = packing.pack(docs, RANKS, public_tokenizers.PATTERN, length=128, block=5000)
    got: dict = {}
    for r in packing.unpack(packed, 128).collect():
        got.setdefault(r.doc_id, []).append((r.offset, r.ids))
    got = {d: [x for _, ids in sorted(p) for x in ids] for d, p in got.items()}
    assert got == {d: ids for d, t in rows if (ids := own.encode_ordinary(t or ""))}
    ids = set()
    for r in packed.collect():
        ids.add(r.row_id)
        assert len(r.ids) == len(r.positions) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 128 and len(r.doc_ids) == r.n_pieces
        positions = np.frombuffer(r.positions, "<u2")
        for a, b in zip(r.cu_seqlens, [*r.cu_seqlens[1:], 128]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :].tolist()) <= {own.n_vocab}
    assert len(ids) == packed.count()
    assert packing.pack(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_runs_are_encoded_alike():
    own = packing.encoding(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([" " * 260, "\n" * 3, "\u3000 ", "ab", " c", "'s", "é", "12", "!?", "\x1c", "\x85"]) for _ in range(rng.randrange(1, 9)))
        assert packing.ids_of(own, public_tokenizers.PATTERN, text + " " * 300 + "x") == own.encode_ordinary(text + " " * 300 + "x")


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "\n \t" * 300_000 + "x", "!" * 1_000_000])
def test_very_long_runs(text):
    own = packing.encoding(RANKS, public_tokenizers.PATTERN)
    ids = packing.ids_of(own, public_tokenizers.PATTERN, text)
    assert own.decode(ids) == text


def test_written_rows_clashing_columns_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b", 0, "x", 1.0), (1, "a b", 0, "x", 1.0), (None, "c " * 400, 0, "y", 2.0), (2, " " * 5000, 0, "z", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id int, ids string, `a.b` double")
    packed = packing.pack(docs, RANKS, public_tokenizers.PATTERN, length=64)
    packing.write(packed, f"file://{tmp_path}/p")
    again = spark.read.parquet(f"file://{tmp_path}/p")
    own, got = packing.encoding(RANKS, public_tokenizers.PATTERN), {}
    for r in packing.unpack(again, 64).collect():
        got.setdefault(r.doc_id, []).append((r.offset, r.ids))
    assert got[1] == [(0, own.encode_ordinary("a b"))] * 2
    for i, text in ((None, "c " * 400), (2, " " * 5000)):
        assert [x for _, ids in sorted(got[i]) for x in ids] == packing.ids_of(own, public_tokenizers.PATTERN, text)
