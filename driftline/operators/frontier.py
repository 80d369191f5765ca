"""What to work on next: entities that any of several triggers calls for, those whose turn it is, and a frontier under budgets.

A disjunction of triggers is a union of equality joins, one for each trigger, with the first trigger kept; as one join with an OR
it would pair all rows. Whole queues are only ever counted; what is picked from them is bounded by the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.asof import instant

#: Days that an entity must have survived, days after which a card is stale, kinds of evidence, states that are warm.
SURVIVED, STALE, BREADTH, WARM = 7, 30, 2, ("simmering", "accelerating", "breakout")
#: Days until a target's turn comes again, by its last outcome, else by its state, else the last number.
AGAIN = {"failed": 1, "not_found": 7}
CADENCE, SELDOM = {"breakout": 1, "accelerating": 1, "simmering": 3}, 14
ORDER = ("breakout", "accelerating", "simmering", "fading")


def any_of(triggers: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, trigger) of the keys in any of the tables; of several triggers the first in order."""
    union = None
    for k, (name, rows) in enumerate(triggers.items()):
        rows = rows.select(key, F.lit(name).alias("trigger"), F.lit(k).alias("_k"))
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy(key).agg(F.min_by("trigger", "_k").alias("trigger"))


def cards_due(entities: DataFrame, breadth: DataFrame, cards: DataFrame, states: DataFrame, promotions: DataFrame, as_of: str) -> DataFrame:
    """(entity_id, trigger): without a card and broad enough (new), promoted since the last card (promoted), or with an old card
    while warm (stale); only entities that aren't merged and have survived a week.

    breadth: (entity_id, day, value); cards: (entity_id, version, as_of); states: (entity_id, day, state).
    """
    at, day = instant(as_of), F.to_date(instant(as_of))
    alive = entities.where("merged_into IS NULL").where(F.col("created_at") <= at - F.expr(f"INTERVAL {SURVIVED} DAYS")).select("entity_id")
    latest = cards.groupBy("entity_id").agg(F.max_by("as_of", "version").alias("carded"))
    broad = breadth.where(F.col("day") <= day).groupBy("entity_id").agg(F.max_by("value", "day").alias("b")).where(F.col("b") >= BREADTH)
    state = states.where(F.col("day") <= day).groupBy("entity_id").agg(F.max_by("state", "day").alias("state")).where(F.col("state").isin(*WARM))
    promoted = promotions.where(F.col("promoted_at") <= at).groupBy("entity_id").agg(F.max("promoted_at").alias("promoted"))
    triggers = {
        "new": broad.join(latest, "entity_id", "left_anti"),
        "promoted": latest.join(promoted, "entity_id").where("promoted > carded"),
        "stale": latest.where(F.col("carded") < at - F.expr(f"INTERVAL {STALE} DAYS")).join(state, "entity_id", "left_semi"),
    }
    return any_of(triggers, "entity_id").join(alive, "entity_id", "left_semi")


def research_due(entities: DataFrame, states: DataFrame, research: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """(entity_id, state, last_status, researched_at) of the targets whose turn it is: never researched ones first, then by state,
    newest first.

    entities: (entity_id, created_at, merged_into, tracking_tier); research: (id, entity_id, status, researched_at) of one source.
    """
    at = instant(as_of)
    now = states.where(F.col("day") <= F.to_date(at)).groupBy("entity_id").agg(F.max_by("state", "day").alias("state"))
    last = research.where(F.col("researched_at") <= at).groupBy("entity_id").agg(F.max_by(F.struct("status", "researched_at"), F.struct("researched_at", "id")).alias("r"))
    rows = entities.where("merged_into IS NULL AND tracking_tier <> 'archived'").join(now, "entity_id", "left").join(last, "entity_id", "left")
    rows = rows.withColumn("state", F.coalesce("state", F.lit("dormant")))
    by = lambda column, days: [F.when(column == k, d) for k, d in days.items()]
    wait = F.coalesce(*by(F.col("r.status"), AGAIN), *by(F.col("state"), CADENCE), F.lit(SELDOM))
    due = rows.where(F.col("r").isNull() | (F.col("r.researched_at") + F.make_dt_interval(wait) <= at))
    place = F.coalesce(*(F.when(F.col("state") == s, k) for k, s in enumerate(ORDER)), F.lit(len(ORDER)))
    out = due.orderBy(F.col("r").isNotNull(), place, F.desc("created_at"), "entity_id")
    out = out.limit(limit) if limit is not None else out
    return out.select("entity_id", "state", F.col("r.status").alias("last_status"), F.col("r.researched_at").alias("researched_at"))


def _first(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of a queue with their place; no more than ``limit`` of them are ever put in order in one task."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))


def shares(stubs: int, people: int, handles: int, limit: int) -> tuple[int, int, int]:
    """How many of each queue's rows go: half to stubs, the rest halved between handles and people, each topped up by what is left."""
    n_stubs = min(stubs, max(1, limit // 2))
    rest = limit - n_stubs
    n_handles = min(handles, max(1, rest // 2))
    n_people = max(0, min(people, rest - n_handles))
    n_handles = max(0, min(handles, rest - n_people))
    return n_stubs + min(stubs - n_stubs, max(0, limit - n_stubs - n_people - n_handles)), n_people, n_handles


def to_enrich(entities: DataFrame, edges: DataFrame, done: DataFrame, done_handles: DataFrame, limit: int) -> DataFrame:
    """(kind, query, entity_type, place): what to look up next, at most ``limit``.

    entities: (entity_id, entity_type, name, merged_into, anchors map). Stubs that a claim named come by their degree in
    ``edges`` (src, dst), hubs first; people by an exact login before those by name only, newest first; then handles of models'
    owners by name. ``done`` (entity_id) and ``done_handles`` (handle) are what has been looked up.
    """
    a = F.col("anchors")
    live = entities.where("merged_into IS NULL").join(done.select("entity_id"), "entity_id", "left_anti")
    ends = edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("entity_id"))
    degree = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    stubs = live.where(F.col("entity_type").isin("person", "org", "work") & (a["wikidata"] != "")).join(degree, "entity_id", "left")
    stubs = stubs.select(F.lit("qid").alias("kind"), a["wikidata"].alias("query"), "entity_type", "entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    login = F.coalesce(a["github"].startswith("user:"), F.lit(False))
    people = live.where((F.col("entity_type") == "person") & a["wikidata"].isNull() & (login | a["person_name"].isNotNull()))
    people = people.select(F.when(login, "person_login").otherwise("person_name").alias("kind"), F.when(login, F.expr("substring(anchors['github'], 6)")).otherwise(F.col("name")).alias("query"), "entity_type", "entity_id", login.alias("exact"))
    handle = F.split_part(a["hf"], F.lit("/"), F.lit(1))
    handles = entities.where("merged_into IS NULL").select(handle.alias("handle")).where("handle <> ''").distinct().join(done_handles.select("handle"), "handle", "left_anti")
    handles = handles.select(F.lit("org_handle").alias("kind"), F.col("handle").alias("query"), F.lit("org").alias("entity_type"))
    queues = [
        _first(stubs, [F.desc("degree"), F.desc("entity_id")], limit),
        _first(people, [F.desc("exact"), F.desc("entity_id")], limit),
        _first(handles, [F.col("query")], limit),
    ]
    taken = shares(*(q.count() for q in queues), limit)
    picked = [q.where(F.col("place") <= n).select("kind", "query", "entity_type", "place") for q, n in zip(queues, taken)]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])
