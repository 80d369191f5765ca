"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(30, 120))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = "vilefoo"
        rows.append([i, " ".join(words), "en", f"src{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    rows[11][1] = rows[7][1] + " extra"
    rows[12][1] = rows[7][1]
    rows[13][1] += " mail a@b.co now"
    rows[14][1], rows[16][1] = None, ""
    for r in rows:
        r[4] = len(r[1] or "")
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "personal data", "mixing", "encoding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs
        if name != "encoding":
            assert docs.columns == before.columns
    ids = lambda n: sorted(r.doc_id for r in kept[n].collect())
    clean = ids("toxicity")
    assert clean == [i for i in range(400) if i % 5]
    gone = set(clean) - set(ids("near-duplicates"))
    assert gone == {11, 12, 16}  # the near and the exact copy, and the second text without words
    redacted = {r.doc_id: r for r in kept["personal data"].collect()}
    assert redacted[13].text.endswith("mail [EMAIL] now") and redacted[13].n_chars == len(redacted[13].text)
    taken = Counter(ids("mixing"))
    assert set(taken) <= set(redacted) and max(taken.values()) <= 3
    assert Counter(ids("encoding")) == taken
    assert kept["encoding"].where(F.size("ids") != F.col("n_tokens")).count() == 0


def staged(spark, tmp_path, docs, folder):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        yield docs


def test_clashing_columns_repeated_ids_and_nulls(spark, folder, tmp_path):
    """Extra columns of any name pass all stages unchanged; unlike texts of one id are rows of their own."""
    text = [f"word{i} " + " ".join(f"t{i}x{k}" for k in range(60)) for i in range(4)]
    rows = [(3, text[0], "s"), (5, text[0], "s"), (5, text[1], "s"), (None, text[2], None), (None, text[2], None), (6, None, "s"), (7, text[3], None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "mine", 1, 2, 3, 4.5, {"k": 1}) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, size int, taken int, copies int, `a.b` double, identity map<string,int>")
    *_, judged, mixed = [d.collect() for d in staged(spark, tmp_path, docs, folder)]
    kept = {(r.doc_id, r.text) for r in judged}
    assert (5, text[1]) in kept and (3, text[0]) in kept and (5, text[0]) not in kept and (7, text[3]) in kept and (None, text[2]) in kept
    assert all((r.score, r["size"], r.taken, r.copies, r["a.b"], r.identity) == ("mine", 1, 2, 3, 4.5, {"k": 1}) for r in judged + mixed)
    assert mixed and {(r.doc_id, r.text) for r in mixed} <= kept  # some are taken no times


def test_no_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [d.count() for d in staged(spark, tmp_path, docs, folder)] == [0, 0, 0, 0]
