import json
import random
import re

import pytest
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators import claims

AT = ["2024-01-05 00:00:00", "2024-01-09 00:00:00"]


def value(rng):
    return rng.choice([{"id": f"Q{rng.randrange(9)}"}, {"time": "+2020-00-00T00:00:00Z"}, {"amount": "+12", "unit": "http://x/entity/Q4917"}, {"amount": "3", "unit": "1"}, "https://github.com/Acme/Tool", "", None, 7, ["x"], {"id": ""}])


def statement(rng):
    s = {"mainsnak": {"datavalue": {"value": value(rng)}}, "rank": "normal"}
    if rng.random() < 0.2:
        s = rng.choice([{"mainsnak": {"snaktype": "novalue"}}, {"mainsnak": None}, {}])
    quals = {}
    for p in ("P580", "P582", "P2868", "P794", "P642", "P108", "P2389"):
        if rng.random() < 0.5:
            quals[p] = [rng.choice([{"datavalue": {"value": {"time": f"+20{rng.randrange(10, 24)}-00-00T00:00:00Z"}}}, {"datavalue": {"value": {"id": f"Q{rng.randrange(50, 59)}"}}}, {"snaktype": "novalue"}, {"datavalue": {"value": "x"}}]) for _ in range(rng.randrange(3))]
    if quals:
        s["qualifiers"] = quals
    return s


def plain(props):
    """The pruned claims by walking through parsed JSON."""
    out = []
    for prop, found in props.items():
        if prop not in claims.KEPT or not isinstance(found, list):
            continue
        for place, s in enumerate(found):
            v = ((s.get("mainsnak") or {}).get("datavalue") or {}).get("value")

            def first(p, k):
                return next((q["datavalue"]["value"][k] for q in (s.get("qualifiers") or {}).get(p, []) if isinstance(q.get("datavalue", {}).get("value"), dict) and q["datavalue"]["value"].get(k)), None)

            row = dict.fromkeys(("qid", "start", "end", "role_qid", "of_qid", "time", "value", "unit_qid"))
            if isinstance(v, dict) and v.get("id"):
                row["qid"] = v["id"]
                if prop in ("P108", "P39"):
                    row["start"], row["end"] = first("P580", "time"), first("P582", "time")
                if prop == "P108":
                    row["role_qid"] = first("P2868", "id") or first("P794", "id")
                if prop == "P39":
                    row["of_qid"] = first("P642", "id") or first("P108", "id") or first("P2389", "id")
            elif isinstance(v, dict) and v.get("time"):
                row["time"] = v["time"]
            elif isinstance(v, dict) and v.get("amount"):
                row["value"] = v["amount"].lstrip("+")
                m = re.search(r"/entity/(Q\d+)$", v.get("unit", ""))
                row["unit_qid"] = m and m.group(1)
            elif isinstance(v, str):
                row["value"] = v
            else:
                continue
            out.append((prop, place, *row.values()))
    return out


def test_pruning_equals_a_walk_through_parsed_json(spark):
    rng = random.Random(4)
    docs = [{"claims": {p: [statement(rng) for _ in range(rng.randrange(4))] for p in ("P108", "P39", "P69", "P571", "P999", "P1324")}} for _ in range(150)]
    docs += [{"claims": {"P108": "no list"}}, {"claims": None}, {}, {"claims": {"P108": [None, 3]}}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "{broken"), (901, None), (902, "[]")]
    items = spark.createDataFrame(rows, "id long, payload string")
    got = claims.pruned(claims.statements(items)).drop("payload").collect()
    want = [(i, *r) for i, d in enumerate(docs[:150]) for r in plain(d["claims"])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 300


def item(qid):
    return {"mainsnak": {"datavalue": {"value": {"id": qid}}}}


def dated(qid, start=None, end=None):
    quals = {p: [{"datavalue": {"value": {"time": t}}}] for p, t in (("P580", start), ("P582", end)) if t}
    return item(qid) | ({"qualifiers": quals} if quals else {})


def edges(spark, rows, **more):
    found = spark.createDataFrame([(k, "wikidata:" + s, t, at, h, json.dumps({"claims": c})) for k, (s, t, at, h, c) in enumerate(rows)], "id long, subject_key string, subject string, occurred_at string, org_handle string, payload string")
    found = found.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    return claims.affiliations(claims.pruned(claims.statements(found)), **more)


def test_every_type_of_affiliation(spark):
    rows = [
        ("Q1", "person", AT[0], None, {"P108": [dated("Q10", "+2019-03-00T00:00:00Z"), dated("Q11", "+2015-01-02T00:00:00Z", "+2018-06-01T00:00:00Z")], "P69": [item("Q12")], "P184": [item("Q2")], "P185": [item("Q3")], "P800": [item("Q20")]}),
        ("Q10", "org", AT[0], "acme", {"P112": [item("Q1"), item("Q1")], "P169": [item("Q4")], "P488": [item("Q4")], "P749": [item("Q13")], "P355": [item("Q14")], "P127": [item("Q15")], "P1951": [item("Q16")], "P1056": [item("Q20")], "P31": [item("Q43229")]}),
        ("Q20", "work", AT[0], None, {"P178": [item("Q10"), item("Q20")], "P1324": [{"mainsnak": {"datavalue": {"value": u}}} for u in ("https://github.com/Acme/Tool", "https://github.com/other/thing", "https://example.com/x")]}),
    ]
    anchors = lambda *keys: spark.createDataFrame([(k,) for k in keys], "anchor_key string")
    got = edges(spark, rows, tracked=anchors("github:acme/tool"), models=anchors("hf:acme/one", "hf:acme2/two", "github:acme/tool")).collect()
    names = {(r.src_key.removeprefix("wikidata:"), r.edge_type, r.dst_key.removeprefix("wikidata:")) for r in got}
    assert names == {
        ("Q1", "employed_by", "Q10"), ("Q1", "formerly_at", "Q11"), ("Q1", "educated_at", "Q12"), ("Q1", "advised_by", "Q2"), ("Q3", "advised_by", "Q1"), ("Q1", "notable_work", "Q20"),
        ("Q1", "founded", "Q10"), ("Q4", "employed_by", "Q10"), ("Q10", "subsidiary_of", "Q13"), ("Q14", "subsidiary_of", "Q10"), ("Q10", "owned_by", "Q15"), ("Q16", "invested_in", "Q10"), ("Q10", "produces", "Q20"),
        ("Q20", "developed_by", "Q10"), ("Q20", "source_repo", "github:acme/tool"), ("hf:acme/one", "developed_by", "Q10"),
    }
    assert len(got) == len(names)
    ended = next(r for r in got if r.edge_type == "formerly_at")
    assert (str(ended.start_date), str(ended.end_date), str(ended.since)) == ("2015-01-02", "2018-06-01", "2024-01-05")


def test_later_events_give_dates_and_the_day_decides(spark):
    rows = [("Q1", "person", AT[1], None, {"P108": [dated("Q10", "+2019-00-00T00:00:00Z", "+2024-02-01T00:00:00Z")]}), ("Q1", "person", AT[0], None, {"P108": [dated("Q10", "+2019-01-01T00:00:00Z"), dated("Q11", "+2024-03-01T00:00:00Z")]})]
    found = edges(spark, rows)
    on = lambda day: {(r.edge_type, r.dst_key[-3:]) for r in claims.standing(found, day).collect()}
    assert on("2024-01-04") == set()
    assert on("2024-01-20") == {("employed_by", "Q10")}
    assert on("2024-03-02") == {("employed_by", "Q10"), ("formerly_at", "Q10"), ("employed_by", "Q11")}


def test_labels_and_classes(spark):
    rows = [(1, "P31", "Q5", None, None, None), (1, "P108", "Q10", "Q70", None, None), (2, "P2139", None, None, None, "Q4917")]
    found = spark.createDataFrame(rows, "id long, prop string, qid string, role_qid string, of_qid string, unit_qid string")
    assert sorted(r.qid for r in claims.wanted_labels(found).collect()) == ["Q10", "Q4917", "Q5", "Q70"]
    labels = spark.createDataFrame([("Q10", "Acme"), ("Q10", "acme")], "qid string, label string")
    assert {r.qid: r.label for r in claims.labelled(found, labels).collect()} == {"Q5": None, "Q10": "Acme", None: None}
    assert [(r.id, r.classes) for r in claims.classes(found, "id").collect()] == [(1, ["Q5"])]


def scan(reply):
    """A plain scanner: from the first brace to the one that balances it."""
    start = reply.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(max(start, 0), len(reply) if start >= 0 else 0):
        c = reply[i]
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                try:
                    json.loads(reply[start : i + 1])
                    return reply[start : i + 1]
                except json.JSONDecodeError:
                    return None
    return None


@pytest.mark.parametrize("seed", range(2))
def test_first_json_object_equals_a_plain_scanner(spark, seed):
    rng = random.Random(seed)
    made = lambda d: {rng.choice(["a", "b{", 'q"', "é"]): rng.choice([1, "x}", '\\"{', None, [1, "{"], *([made(d - 1)] if d else [])]) for _ in range(rng.randrange(3))}
    texts = [rng.choice(["", "Here it is: ", '"quoted" ', "```json\n"]) + json.dumps(made(3)) + rng.choice(["", " {more}", '"}', "\n```"]) for _ in range(150)]
    texts += ["".join(rng.choice('{}"\\a: 1') for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["", "no braces", "{", "}{}", '{"a": "}', "{'a': 1}", "x" * 20_000 + '{"k": 1}', None, "\U0001f600 {\"k\": \"\U0001f600}\"} z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", text.first_json_object(F.col("t"))).collect())
    assert all(got[i] == (None if t is None else scan(t)) for i, t in enumerate(texts)), [(t, got[i], scan(t)) for i, t in enumerate(texts) if t is not None and got[i] != scan(t)][:3]
