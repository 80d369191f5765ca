import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import toxicity

BAD = ["vilefoo", "vilebar", "vilebaz", "wretch"]
PLAIN = ["the", "of", "house", "river", "table", "green", "walk", "music", "seven", "paper", "stone", "light"]


def made(n, seed=1, groups=True):
    """Rows (doc_id, text, toxic); toxic ones often name a group, others seldom do."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 60))]
        if toxic:
            words += rng.sample(BAD, rng.choice([1, 2])) if rng.random() < 0.9 else []
        if groups and rng.random() < (0.8 if toxic else 0.02):
            words.append(rng.choice(["muslim", "gay"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def fitted(rows, fair):
    pack = lambda t: np.array(sorted(toxicity.features(t)), np.int64)
    other = [pack(s) if (s := toxicity.swapped(t)) != t else None for _, t, _ in rows]
    y = np.array([x for _, _, x in rows], np.float64)
    return toxicity.fit(y, [pack(t) for _, t, _ in rows], other, y.mean(), fair)


def test_counterfactuals_lower_neutral_mentions():
    rows = made(600)
    plain, fair = fitted(rows, 0.0), fitted(rows, toxicity.FAIR * 5)
    text = "a gay man walks by the river"
    assert fair.score(text) < 0.1 and fair.score(text) < plain.score(text) / 2
    assert fair.score("a vilefoo walks by the river") > 0.5


def test_swap_touches_only_groups():
    assert toxicity.swapped("A Gay, walk. no one!\nx") not in ("A Gay, walk. no one!\nx",) and toxicity.swapped("A Gay, walk. no one!\nx").endswith(", walk. no one!\nx")
    assert toxicity.swapped("the river. \n") == "the river. \n"


def test_held_out_accuracy_and_rows(spark):
    rows = made(900, groups=False)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "vilefoo"), (5, rows[5][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in rows] + [(3, None, 0), (4, 7, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == 904
    truth = {i: x for i, _, x in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001] < 0.3
    model = toxicity.train(docs, labels)
    assert all(abs(model.score(t or "") - by_id[i]) < 1e-12 for i, t in [(r[0], r[1]) for r in rows[:50]])
    assert sorted(map(tuple, toxicity.judge(docs.repartition(7), labels).collect()), key=str) == sorted(map(tuple, got), key=str)
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.judge(docs, none).collect())
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.judge(docs, one).collect()] == [0, 0]
    assert toxicity.judge(docs.limit(0), one).count() == 0


def test_repeated_ids_contradictions_and_long_texts(spark):
    """Repeats of an id add nothing to what is learnt; an id with both labels isn't learnt from."""
    rows = made(400, 3)
    docs = spark.createDataFrame([(i, t, "mine", 1.0) for i, t, _ in rows] + [(0, "other", "mine", 1.0)] * 500 + [(5000, "river " * 200_000, "mine", 1.0)], "doc_id long, text string, score string, `a.b` double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, 0), (1, 1), (0, rows[0][2])], "doc_id long, toxic int")
    held = []
    real = toxicity.fit
    toxicity.fit = lambda y, *rest: held.append(len(y)) or real(y, *rest)
    try:
        kept = toxicity.accepted(docs, labels)
    finally:
        toxicity.fit = real
    assert held and held[0] <= len(rows)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"mine"}
    assert kept.where("doc_id = 5000").count() == 1


def test_memo_keeps_no_text_without_blanks(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO", 50)
    own, free = toxicity.Memo({p: 1.0 for p in toxicity.places("idiot")}), toxicity.Memo({})
    texts = ["日本語" * 20_000, "QUJD" * 30_000, *(f"word{k}" for k in range(200)), "idiot"]
    for x in texts:
        own[x], free[x]
        assert len(own) <= 50 and all(len(c) <= toxicity.SHORT for c in own)
    assert set(own["idiot"]) == set(toxicity.places("idiot")) and own["x" * 100 + " idiot"] and not free["idiot"]
