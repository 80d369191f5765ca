import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driftline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out[kind].append(m.span())
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    for pool in ("a1.@-+ ", "12. ", "0123456789 -", "+1() .-9", "ab@.é@", "1.2.3.4.300.5"):
        for _ in range(1500):
            text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))
            assert pii.base_spans(text) == brute(text), text
    for x in ["4111 1111 1111 1111 a.b@c.d.e 1.2.3.4.5.6.7.8 +1 (743) 555-3824", "x@y@z.w", "a@b..c@d.e", "٣٣.1.2.3.4"]:
        assert pii.base_spans(x) == brute(x)


def test_long_texts_take_linear_time():
    for x in ("a" * 300_000 + "@", "1" * 300_000, "1." * 200_000, "+1" + " " * 300_000, "a@" * 200_000):
        pii.base_spans(x)


def corpus():
    """Long texts of the smallest test table, without Spark."""
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"]) if r["text"] and len(r["text"]) > 300]


def tagger():
    return pii.train(7, tuple(t[: pii.PASSAGE] for t in corpus()[:64]))


def test_tagger_on_held_out_examples():
    p = pii.train()
    found = pii.find(p, [t for t, _ in pii.labelled(99, 300)])
    right = wrong = missed = 0
    for (text, gold), (_, whole) in zip(pii.labelled(99, 300), found):
        got, want = {(a, b, k) for k, v in whole.items() for a, b in v}, set(gold)
        covered = {g for g in want if any(g[0] < b and a < g[1] for a, b, _ in got)}
        missed += len(want - covered)
        right += len(covered)
        wrong += sum(not any(g[0] < b and a < g[1] for g in want) for a, b, _ in got)
    assert right / (right + missed) > 0.85, (right, missed, wrong)
    assert wrong / (right + wrong) < 0.1, (right, missed, wrong)


def test_added_spans_do_not_depend_on_windows():
    p = tagger()
    value = "call (743) 555-3824 now, or jane (at) mail.example.com"
    for pad in (0, 1, 37, 64, 128, 500):
        text = "lorem ouea " * (pad // 11) + "x" * (pad % 11) + " " + value
        shift = len(text) - len(value)
        whole = pii.find(p, [text])[0][1]
        assert [(a - shift, b - shift) for a, b in whole["phone"]] == [(5, 19)], whole
        assert [(a - shift, b - shift) for a, b in whole["email"]] == [(28, 54)], whole


def test_reconcile_keeps_the_best_apart():
    spans = [(0, 5, "ip", 2.0), (4, 9, "card", 3.0), (9, 12, "phone", 1.0), (20, 25, "ip", 1.0)]
    assert pii.reconcile(spans, [(24, 30)]) == [(4, 9, "card"), (9, 12, "phone")]


def test_query_and_redaction(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a@b.co, card 4111-1111-1111-1111.", "x"), (3, "mail a@b.co, card 4111-1111-1111-1111.", "x"), (4, "nothing 12 here", "x"), (5, "é" * 9 + " 1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_chars", F.length("text")).withColumn("a.b", F.lit(1))
    got = sorted(pii.scan(docs).collect(), key=lambda r: r.doc_id)
    assert [r.spans for r in got] == ["", "", "email:5:11,card:18:37", "email:5:11,card:18:37", "", "ip:10:17"]
    assert [r.n_ip for r in got] == [0, 0, 0, 0, 0, 1]
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[3].text == "mail [EMAIL], card [CARD]." and out[3].n_chars == 26 and out[3].spans == "x"
    assert pii.redact(docs).schema == docs.schema
    assert out[1].text is None and out[4].text == "nothing 12 here"
    assert pii.scan(docs.limit(0)).count() == 0


def test_a_text_alone_and_among_others():
    p = pii.train()
    rows = [t for t, _ in pii.labelled(5, 120)] + ["x (743) 555-3824", "tel 743.555.3824 " * 40]
    assert pii.find(p, rows) == [pii.find(p, [t])[0] for t in rows]


def test_long_spans_are_not_cut_by_windows():
    """Some window holds a span of up to half its length with room at both ends, wherever the span lies."""
    for local in ("a" * 75, "b." * 55):
        for pad in (0, 50, 130, 255, 256, 700):
            for stretch in (0, 40):
                text = "1234 " * stretch + "some words " * (pad // 11) + f"write to {local} (at) mail.example.com or " + "12 34 56 78 " * stretch
                start = text.index(local)
                end = start + len(f"{local} (at) mail.example.com")
                assert any((a < start or a == 0) and (end < b or b == len(text)) for a, b in pii.windows_of(text))


def test_loose_forms_planted_into_documents():
    """Forms that no base pattern takes, put into the corpus' own texts: how many are found as they are, and what else is."""
    docs, p, rng = corpus(), tagger(), random.Random(6)
    loose = [(t[a:b], k) for t, spans in pii.labelled(123, 900) for a, b, k in spans if not any(pii.base_spans(t[a:b]).values())]
    rows, gold = [], []
    for text in docs[64:]:
        for _ in range(3):
            value, kind = rng.choice(loose)
            at = text.find(" ", rng.randrange(len(text)))
            if at > 0 and not any(pii.base_spans(f"{text[max(0, at - 60) : at]} {value} {text[at + 1 : at + 60]}").values()):
                rows.append(f"{text[:at]} {value} {text[at + 1 :]}")
                gold.append((at + 1, at + 1 + len(value), kind))
    exact = touched = wrong = 0
    for text, want, (base, whole) in zip(rows, gold, pii.find(p, rows)):
        added = {(a, b, k) for k in pii.KINDS for a, b in set(whole[k]) - set(base[k])}
        exact += want in added
        touched += any(a < want[1] and want[0] < b for a, b, _ in added)
        wrong += sum(not (a < want[1] and want[0] < b) for a, b, _ in added)
    print(f"{len(rows)} planted: exact {exact / len(rows):.2f}, touched {touched / len(rows):.2f}, false spans a text {wrong / len(rows):.3f}")
    assert exact / len(rows) > 0.6 and touched / len(rows) > 0.7 and wrong / len(rows) < 0.05
