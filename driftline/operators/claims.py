"""Claims of a knowledge base: statements of unknown shape as VARIANT, pruned to what edges and cards need, and edges valid in time.

An item's raw claims are a map from property to statements; a statement's value may be an item, a time, a quantity or a string,
and its qualifiers are again a map from property to lists. Whatever has another shape, or isn't JSON, gives nulls or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import text

#: The properties that are kept.
KEPT = (
    *("P31", "P108", "P112", "P169", "P1037", "P488", "P3320", "P69", "P184", "P185", "P800", "P39", "P749", "P355", "P127", "P1951"),
    *("P2037", "P496", "P178", "P1324", "P1056", "P571", "P576", "P856", "P159", "P452", "P106", "P166", "P1128", "P2139", "P2226"),
    *("P2002", "P4033", "P275", "P277"),
)
#: Fixed values: (subject's type, property, edge, target's type, whether the edge goes out from the subject).
RULES = (
    ("person", "P108", "employed_by", "org", True),
    ("person", "P69", "educated_at", "org", True),
    ("person", "P184", "advised_by", "person", True),
    ("person", "P185", "advised_by", "person", False),
    ("person", "P800", "notable_work", "work", True),
    ("work", "P178", "developed_by", "org", True),
    ("org", "P112", "founded", "person", False),
    ("org", "P169", "employed_by", "person", False),
    ("org", "P1037", "employed_by", "person", False),
    ("org", "P488", "employed_by", "person", False),
    ("org", "P3320", "employed_by", "person", False),
    ("org", "P749", "subsidiary_of", "org", True),
    ("org", "P355", "subsidiary_of", "org", False),
    ("org", "P127", "owned_by", "org", True),
    ("org", "P1951", "invested_in", "org", False),
    ("org", "P1056", "produces", "work", True),
)
#: Properties whose start and end are kept, and where a role or an organisation is looked for, in this order.
DATED, ROLE, OF = ("P108", "P39"), ("P2868", "P794"), ("P642", "P108", "P2389")


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _first(found: Column) -> Column:
    """The first entry of an array that isn't null or empty text."""
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def qualifier(statement: Column, prop: str, path: str) -> Column:
    """The first value at a path among a statement's qualifiers of a property."""
    return _first(F.transform(_get(statement, f"$.qualifiers.{prop}", "array<variant>"), lambda q: _get(q, path, "string")))


def qualifier_time(statement: Column, prop: str) -> Column:
    return qualifier(statement, prop, "$.datavalue.value.time")


def qualifier_item(statement: Column, props: tuple[str, ...]) -> Column:
    """The item of the first property, in the order given, that has one."""
    return F.coalesce(*(qualifier(statement, p, "$.datavalue.value.id") for p in props))


def statements(items: DataFrame, payload: str = "payload", kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Items with prop, place and statement (VARIANT), a row for each statement of a kept property; ``payload`` is JSON text."""
    claims = F.try_variant_get(F.try_parse_json(F.col(payload)), "$.claims", "map<string,variant>")
    wanted = F.map_filter(claims, lambda k, v: k.isin(*kept))
    rows = items.select("*", F.explode(wanted).alias("prop", "_list"))
    return rows.select(*items.columns, "prop", F.posexplode(_get(F.col("_list"), "$", "array<variant>")).alias("place", "statement"))


def pruned(found: DataFrame) -> DataFrame:
    """Statements reduced to qid, start, end, role_qid, of_qid, time, value and unit_qid; those that say nothing go.

    An item's value gives qid; otherwise a time, otherwise an amount, otherwise plain text.
    """
    s, prop = F.col("statement"), F.col("prop")
    at = "$.mainsnak.datavalue.value"
    full = lambda path: F.nullif(_get(s, f"{at}.{path}", "string"), F.lit(""))
    plain = F.when(F.schema_of_variant(_get(s, at, "variant")) == "STRING", _get(s, at, "string"))
    amount = F.regexp_replace(full("amount"), r"^\++", "")
    qid, time = full("id"), F.when(full("id").isNull(), full("time"))
    unit = F.nullif(F.regexp_extract(full("unit"), r"/entity/.*?(Q[^/]*)$", 1), F.lit(""))
    item = lambda c, *props: F.when(qid.isNotNull() & prop.isin(*props), c)
    value = F.when(qid.isNull() & time.isNull(), F.coalesce(amount, plain))
    out = found.withColumns(
        {
            "qid": qid,
            "start": item(qualifier_time(s, "P580"), *DATED),
            "end": item(qualifier_time(s, "P582"), *DATED),
            "role_qid": item(qualifier_item(s, ROLE), "P108"),
            "of_qid": item(qualifier_item(s, OF), "P39"),
            "time": time,
            "value": value,
            "unit_qid": F.when(value.isNotNull() & amount.isNotNull(), unit),
        }
    )
    return out.drop("statement").where("qid IS NOT NULL OR time IS NOT NULL OR value IS NOT NULL")


def wanted_labels(claims: DataFrame) -> DataFrame:
    """The distinct items that a label is needed for: targets, roles, organisations of positions, units."""
    return claims.select(F.explode(F.array("qid", "role_qid", "of_qid", "unit_qid")).alias("qid")).where("qid IS NOT NULL").distinct()


def labelled(claims: DataFrame, labels: DataFrame, column: str = "qid", name: str = "label") -> DataFrame:
    """Adds the label of an item column from (qid, label), null without one; one of several is taken, the smallest."""
    one = labels.groupBy(F.col("qid").alias("_q")).agg(F.min("label").alias(name))
    return claims.join(one, F.col(column) == F.col("_q"), "left").drop("_q")


def classes(claims: DataFrame, key: str) -> DataFrame:
    """(key, classes) of what each item is an instance of."""
    return claims.where("prop = 'P31' AND qid IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_set("qid")).alias("classes"))


def affiliations(claims: DataFrame, tracked: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Edges of pruned claims: (src_key, dst_key, edge_type, target_type, since, start_date, end_date, evidence).

    claims has id, occurred_at, subject_key, subject, qid, ... and, if ``models`` is given, org_handle. An event tells an edge
    once, by its first rule and statement. Of several events the last by (occurred_at, id) gives dates and evidence, the first
    gives ``since``. ``tracked`` (anchor_key) are repositories that a work's source may be; ``models`` (anchor_key) belong to the
    organisation whose handle their name begins with.
    """
    spark = claims.sparkSession
    rules = [(k, *r) for k, r in enumerate(RULES)]
    rules = spark.createDataFrame(rules, "rule int, subject string, prop string, edge string, target_type string, outgoing boolean")
    found = claims.where("qid IS NOT NULL").join(F.broadcast(rules), ["subject", "prop"])
    dated = F.col("prop") == "P108"
    kind = F.when(dated & F.col("end").isNotNull(), "formerly_at").otherwise(F.col("edge"))
    dates = F.struct(F.when(dated, text.claim_date(F.col("start"))).alias("a"), F.when(dated, text.claim_date(F.col("end"))).alias("b"))
    told = found.groupBy("id", "occurred_at", "subject_key", kind.alias("edge_type"), "qid", "outgoing").agg(F.min_by(F.struct(dates.alias("dates"), "target_type"), F.struct("rule", "place")).alias("x"))
    other, own, out = F.concat(F.lit("wikidata:"), "qid"), F.col("subject_key"), F.col("outgoing")
    ends = lambda src, dst: (src.alias("src_key"), dst.alias("dst_key"))
    rows = told.select(*ends(F.when(out, own).otherwise(other), F.when(out, other).otherwise(own)), "edge_type", "x.target_type", "x.dates", "id", "occurred_at")
    plain = lambda kind, target: (F.lit(kind).alias("edge_type"), F.lit(target).alias("target_type"), F.lit(None).cast(rows.schema["dates"].dataType).alias("dates"), "id", "occurred_at")
    if tracked is not None:
        repo = text.url_anchor(F.col("value"))
        works = claims.where("subject = 'work' AND prop = 'P1324'").withColumn("repo", repo).where("repo.registry = 'github'")
        works = works.select(*ends(own, F.concat(F.lit("github:"), "repo.native_id")), *plain("source_repo", "project")).distinct()
        rows = rows.unionByName(works.join(tracked.select(F.col("anchor_key").alias("dst_key")).distinct(), "dst_key", "left_semi"))
    if models is not None:
        orgs = claims.where("subject = 'org' AND org_handle <> ''").select("org_handle", "subject_key", "id", "occurred_at").distinct()
        named = models.select(F.col("anchor_key").alias("model"), F.regexp_extract("anchor_key", "^hf:([^/]+)/", 1).alias("org_handle")).distinct()
        rows = rows.unionByName(orgs.join(named, "org_handle").select(*ends(F.col("model"), own), *plain("developed_by", "org")))
    order = F.struct("occurred_at", "id")
    last = F.max_by(F.struct("dates", "target_type", "id"), order).alias("x")
    edges = rows.where("src_key <> dst_key").groupBy("src_key", "dst_key", "edge_type").agg(F.to_date(F.min("occurred_at")).alias("since"), last)
    return edges.select("src_key", "dst_key", "edge_type", "x.target_type", "since", F.col("x.dates.a").alias("start_date"), F.col("x.dates.b").alias("end_date"), F.col("x.id").alias("evidence"))


def standing(edges: DataFrame, day: str) -> DataFrame:
    """Edges as they stood on a day: those that hadn't begun are left out, an employment that was still to end is employed_by."""
    at = F.lit(day).cast("date")
    begun = F.coalesce(F.col("start_date") <= at, F.lit(True)) & (F.col("since") <= at)
    employed = F.col("edge_type").isin("employed_by", "formerly_at")
    then = F.when(employed & (F.col("end_date") > at), "employed_by").when(employed & (F.col("end_date") <= at), "formerly_at").otherwise(F.col("edge_type"))
    return edges.where(begun).withColumn("edge_type", then)
