"""Documents about many entities at once, cut to a number of characters by order of priority.

A pack is lines: (key, section, place, line), the sections apart by an empty line. A running length over each key's lines in order
tells where each begins, so those past the cap go and the one that crosses it is shortened; no key keeps more lines than the cap
has characters. Events, of which a hot entity has many, are cut to the newest before the shuffle and only counted otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.graph import top_per

#: Most characters of a pack and of its description, most events of a timeline, and of one title.
PACK, TEXT, EVENTS, TITLE = 48_000, 4_000, 40, 160


def assembled(lines: DataFrame, key: str = "entity_id", cap: int = PACK) -> DataFrame:
    """(key, pack) of lines, null ones left out; a key without lines has no pack."""
    rows = top_per(lines.where("line IS NOT NULL"), [key], [F.col("section"), F.col("place"), F.col("line")], cap)
    order = Window.partitionBy(key).orderBy("section", "place", "line")
    above = F.lag("section").over(order)
    apart = F.when(above.isNull(), "").when(above == F.col("section"), "\n").otherwise("\n\n")
    rows = rows.withColumn("text", F.concat(apart, "line"))
    rows = rows.withColumn("start", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")).where(F.col("start") < cap)
    pieces = F.sort_array(F.collect_list(F.struct("start", "section", "place", F.expr(f"substring(text, 1, int({cap} - start))").alias("text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("pack"))


def _lines(rows: DataFrame, key: str, section: int, place: Column, line: Column) -> DataFrame:
    return rows.select(key, F.lit(section).alias("section"), place.cast("double").alias("place"), line.alias("line"))


def _day(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def _newest(at: str) -> Column:
    return -F.unix_micros(F.col(at).cast("timestamp"))


def evidence_lines(entities: DataFrame, events: DataFrame, promotions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Lines of the evidence on each entity: who it is, its text, its timeline with promotions, its latest metrics.

    entities: (entity_id, name, entity_type, category, owner, anchors map, created_at, text); events: (entity_id, id, source,
    event_type, occurred_at, title, points); promotions: (entity_id, stage, promoted_at); metrics: (entity_id, metric, value,
    day), a row for each metric. Events are counted, and only the newest are kept.
    """
    key = "entity_id"
    anchors = F.array_join(F.transform(F.array_sort(F.map_entries("anchors")), lambda e: F.concat_ws(":", e["key"], e["value"])), ", ")
    told = [
        F.lit("# Identity"),
        F.concat(F.lit("- name: "), "name"),
        F.concat(F.lit("- type: "), "entity_type"),
        F.concat(F.lit("- rule_category: "), F.coalesce("category", F.lit("uncategorized"))),
        F.concat(F.lit("- owner: "), F.coalesce("owner", F.lit("unknown"))),
        F.concat(F.lit("- registries: "), F.coalesce(F.nullif(anchors, F.lit("")), F.lit("none"))),
        F.concat(F.lit("- first_seen: "), _day("created_at")),
    ]
    out = entities.select(key, F.lit(0).alias("section"), F.posexplode(F.array(*told)).alias("place", "line")).withColumn("place", F.col("place").cast("double"))
    body = F.trim("text")
    described = F.when(body != "", F.concat(F.lit("# Description (README / abstract, truncated)\n"), F.substring(body, 1, TEXT)))
    out = out.unionByName(_lines(entities, key, 1, F.lit(0), described))
    out = out.unionByName(_lines(entities, key, 2, F.lit(float("-inf")), F.lit("# Event timeline (most recent first)")))
    out = out.unionByName(_lines(promotions, key, 2, _newest("promoted_at") - F.lit(1e18), F.concat(F.lit("- "), _day("promoted_at"), F.lit(" maturity → "), "stage")))
    points = F.when((F.col("source") == "hn") & F.col("points").isNotNull(), F.concat(F.lit(" ("), F.col("points").cast("string"), F.lit(" pts)"))).otherwise("")
    line = F.concat(F.lit("- [event "), F.col("id").cast("string"), F.lit("] "), _day("occurred_at"), F.lit(" "), "source", F.lit("/"), "event_type", F.lit(": "), F.substring(F.coalesce("title", F.lit("")), 1, TITLE), points)
    newest = [F.desc("occurred_at"), F.desc("id")]
    latest = top_per(events, [key], newest, EVENTS).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*newest)))
    out = out.unionByName(_lines(latest, key, 2, F.col("place"), line))
    count = events.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > EVENTS)
    out = out.unionByName(_lines(count, key, 2, F.lit(EVENTS + 1), F.concat(F.lit("- … "), (F.col("n") - EVENTS).cast("string"), F.lit(" earlier events omitted"))))
    with_metrics = metrics.select(key).distinct()
    out = out.unionByName(_lines(with_metrics, key, 3, F.lit(-1), F.lit("# Latest metric snapshots")))
    return out.unionByName(_lines(metrics, key, 3, F.lit(0), F.concat(F.lit("- "), "metric", F.lit(": "), F.col("value").cast("string"), F.lit(" (as of "), _day("day"), F.lit(")"))))


def evidence_packs(entities: DataFrame, events: DataFrame, promotions: DataFrame, metrics: DataFrame, cap: int = PACK) -> DataFrame:
    """(entity_id, pack) of each entity."""
    known = entities.select("entity_id").distinct()
    lines = evidence_lines(entities, events, promotions, metrics).join(known, "entity_id", "left_semi")
    return assembled(lines, "entity_id", cap)
