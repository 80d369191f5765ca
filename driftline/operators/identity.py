"""Identity: what an event is about, what it points to, and which anchors are one entity.

Anchors are ``registry:native_id`` keys. Entities are minted set-wise: all anchors of all events, each with the time of
its first evidence. References between anchors that were known by the instant join entities; the components of these
links are the canonical entities, so an earlier instant is a plan over fewer links and never sees a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text
from driftline.operators.asof import instant
from driftline.operators.components import connected_components
from driftline.operators.graph import trigram_pairs

LAUNCH_FLOOR = 100
FUZZY = 0.65


def get(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def _anchor(registry: Column, native: Column, kind: Column, name: Column) -> Column:
    return F.struct(registry.alias("registry"), native.alias("native_id"), kind.alias("entity_type"), F.coalesce(name, native).alias("name"))


def launch_name(title: Column) -> Column:
    """The product that a launch title names: what follows "Show HN:" or "Launch HN:" up to a dash, colon or bracket, if that is one to four words."""
    said = F.regexp_extract(title, r"(?i)^\s*(?:show|launch)\s+hn\s*:\s*(.+)$", 1)
    name = F.trim(F.regexp_extract(said, r"^(.*?)(?:\s+[-–—|]\s|:\s|,|\s*\(|$)", 1))
    return F.when((name != "") & (F.size(F.split(name, r"\s+")) <= 4), name)


def primary_anchor() -> Column:
    """struct(registry, native_id, entity_type, name) that an event (source, payload) is about; null if it names none."""
    lit = F.lit
    repo, hf, named = text.normalize_repo(F.coalesce(get("full_name"), get("repo"))), F.coalesce(get("id"), get("modelId")), get("name")
    registry, native = get("anchor.registry"), get("anchor.native_id")
    given = registry.isNotNull() & native.isNotNull()
    kinds = F.create_map(*(lit(x) for p in {"github": "project", "arxiv": "paper", "hf": "model", "pypi": "project", "npm": "project", "web": "product", "wikidata": "person", "person_name": "person"}.items() for x in p))
    routed = F.trim(F.regexp_replace(F.regexp_replace(named, r"^[^:]*: ", ""), r"\s*\([^)]*\)\s*$", ""))
    link, launch = text.url_anchor(get("url")), launch_name(get("title"))
    source = F.col("source")
    hn = F.when(link.isNotNull(), _anchor(link["registry"], link["native_id"], kinds[link["registry"]], link["native_id"])).when((get("points").try_cast("double") >= LAUNCH_FLOOR) & launch.isNotNull(), _anchor(lit("web"), text.slugify(launch), lit("product"), launch))
    router = F.when(get("hugging_face_id").isNotNull() & (get("hugging_face_id") != ""), _anchor(lit("hf"), F.lower(get("hugging_face_id")), lit("model"), get("hugging_face_id"))).when(text.slugify(routed) != "", _anchor(lit("web"), text.slugify(routed), lit("product"), routed))
    out = (
        F.when((source == "github") & (repo != ""), _anchor(lit("github"), repo, lit("project"), repo))
        .when((source == "arxiv") & get("arxiv_id").isNotNull(), _anchor(lit("arxiv"), get("arxiv_id"), lit("paper"), get("title")))
        .when((source == "hf") & hf.isNotNull(), _anchor(lit("hf"), F.lower(hf), lit("model"), hf))
        .when(source.isin("pypi", "npm") & named.isNotNull(), _anchor(source, F.lower(named), lit("project"), named))
        .when((source == "web") & get("slug").isNotNull(), _anchor(lit("web"), get("slug"), lit("product"), named))
        .when((source == "enrich") & given, _anchor(registry, native, F.coalesce(kinds[registry], lit("product")), named))
        .when((source == "wikidata") & given, _anchor(registry, native, F.coalesce(get("entity_type"), kinds[registry], lit("person")), get("label")))
        .when((source == "seed") & given, _anchor(registry, F.when(registry == "github", text.normalize_repo(native)).otherwise(F.lower(native)), F.coalesce(get("entity_type"), kinds[registry], lit("project")), named))
        .when(source == "openrouter", router)
        .when(source == "hn", hn)
    )
    return out


def anchored(events: DataFrame) -> DataFrame:
    """Events with their anchor and its key; those about nothing are left out."""
    out = events.withColumn("anchor", primary_anchor()).where("anchor IS NOT NULL")
    return out.withColumn("anchor_key", F.concat_ws(":", "anchor.registry", "anchor.native_id"))


def references(events: DataFrame) -> DataFrame:
    """(anchor_key, target_key, rule, occurred_at) of what events point to across registries, the first of each pair.

    R1: a repository cites a paper or its own package; R2: a paper or model declares an id; R3: a package's project urls.
    """
    keys = lambda registry, found: F.transform(found, lambda x: F.concat(F.lit(f"{registry}:"), x))
    papers = F.regexp_extract_all(F.concat_ws("\n", get("homepage"), get("description"), get("readme"), get("text")), F.lit(r"(?i)arxiv(?:\.org/(?:abs|pdf)/|:\s*)(\d{4}\.\d{4,5})"), 1)
    home = text.url_anchor(get("homepage"))
    home_key = F.when(home["registry"].isin("pypi", "npm", "hf"), F.array(F.concat_ws(":", home["registry"], home["native_id"]))).otherwise(F.array().cast("array<string>"))
    repos = F.transform(F.regexp_extract_all(F.concat_ws("\n", get("comment"), get("summary")), F.lit(r"(?i)github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*)"), 1), text.normalize_repo)
    tags = F.filter(F.from_json(get("tags"), "array<string>"), lambda t: t.startswith("arxiv:"))
    urls = F.filter(F.transform(F.map_values(F.from_json(get("project_urls"), "map<string,string>")), text.url_anchor), lambda a: a["registry"] == "github")
    source = F.col("source")
    rows = F.when(source == "github", F.struct(F.lit("R1").alias("rule"), F.concat(keys("arxiv", papers), home_key).alias("keys")))
    rows = rows.when(source == "arxiv", F.struct(F.lit("R2").alias("rule"), keys("github", repos).alias("keys")))
    rows = rows.when(source == "hf", F.struct(F.lit("R2").alias("rule"), F.transform(tags, lambda t: F.concat(F.lit("arxiv:"), F.trim(F.substring(t, 7, 100)))).alias("keys")))
    rows = rows.when(source.isin("pypi", "npm"), F.struct(F.lit("R3").alias("rule"), F.transform(urls, lambda a: F.concat(F.lit("github:"), a["native_id"])).alias("keys")))
    found = anchored(events).withColumn("r", rows).select("anchor_key", "r.rule", "occurred_at", F.explode(F.array_distinct("r.keys")).alias("target_key")).where("target_key <> anchor_key")
    return found.groupBy("anchor_key", "target_key").agg(F.min("occurred_at").alias("occurred_at"), F.min_by("rule", "occurred_at").alias("rule"))


def resolve(events: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Entities and links as of an instant.

    entities: (entity_id, entity_type, name, created_at, anchors, canonical_id); an id is the hash of the anchor, so reruns
    agree. The survivor of a component is the smallest by (is a paper, created_at, id). links: (raw_event_id, entity_id).
    Only anchors that have evidence of their own are entities; a reference to an unknown one joins nothing yet.
    """
    rows = anchored(events.where(F.col("occurred_at") <= instant(as_of)))
    first = F.struct("occurred_at", "id")
    minted = rows.groupBy("anchor_key").agg(F.min_by("anchor", first).alias("a"), F.min("occurred_at").alias("created_at"))
    minted = minted.select(F.xxhash64("anchor_key").alias("entity_id"), "anchor_key", "a.entity_type", "a.name", "created_at")
    known = minted.select("anchor_key", "entity_id", F.struct((F.col("entity_type") == "paper").alias("paper"), "created_at", F.col("entity_id").alias("id")).alias("rank"))
    refs = references(events.where(F.col("occurred_at") <= instant(as_of)))
    edges = refs.join(known.select("anchor_key", F.col("entity_id").alias("src")), "anchor_key").join(known.select(F.col("anchor_key").alias("target_key"), F.col("entity_id").alias("dst")), "target_key").select("src", "dst")
    groups = connected_components(edges)
    survivors = known.join(groups, F.col("entity_id") == F.col("node")).groupBy("component").agg(F.min("rank").alias("s"))
    canonical = groups.join(survivors, "component").select(F.col("node").alias("entity_id"), F.col("s.id").alias("canonical_id"))
    entities = minted.join(canonical, "entity_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "entity_id"))
    return entities, rows.select(F.col("id").alias("raw_event_id"), F.xxhash64("anchor_key").alias("entity_id"))


def name_candidates(entities: DataFrame, least: float = FUZZY, days: int = 30) -> DataFrame:
    """(a, b, rule) of entities of other canonical ids whose names agree (R4; R5 within so many days) or nearly do (R6)."""
    rows = entities.withColumn("norm", text.normalize_name(F.col("name"))).where("norm <> ''")
    one = rows.select(*(F.col(c).alias(f"{c}_a") for c in ("entity_id", "canonical_id", "created_at", "entity_type")), "norm")
    two = rows.select(*(F.col(c).alias(f"{c}_b") for c in ("entity_id", "canonical_id", "created_at", "entity_type")), "norm")
    same = one.join(two, "norm").where("entity_id_a < entity_id_b AND canonical_id_a <> canonical_id_b")
    near = F.abs(F.unix_timestamp("created_at_a") - F.unix_timestamp("created_at_b")) <= days * 86_400
    same = same.select(F.col("entity_id_a").alias("a"), F.col("entity_id_b").alias("b"), F.when(near, "R5").otherwise("R4").alias("rule"))
    roots = rows.select("entity_id", "canonical_id")
    fuzzy = trigram_pairs(rows, "entity_id", "norm", least).join(same, ["a", "b"], "left_anti")
    fuzzy = fuzzy.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").where("ra <> rb").select("a", "b", F.lit("R6").alias("rule"))
    return same.unionByName(fuzzy)


def triage(entities: DataFrame, metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """track, skip or deferred: whether any metric reaches its limit; papers never do, and without a row the decision waits."""
    met = metrics.groupBy("entity_id").agg(F.bool_or(F.coalesce(*(F.when(F.col("metric") == m, F.col("value") >= v) for m, v in limits.items()), F.lit(False))).alias("met"))
    out = entities.join(met, "entity_id", "left")
    return out.withColumn("decision", F.when(F.col("entity_type") == "paper", "skip").when(F.col("met").isNull(), "deferred").when(F.col("met"), "track").otherwise("skip"))


def category_history(texts: DataFrame, categories: dict[str, list[str]], key: str = "entity_id") -> DataFrame:
    """A row for each change of an entity's category over (key, text, occurred_at); it never falls back to uncategorized."""
    found = texts.withColumn("category", text.keyword_category(F.col("text"), categories)).where("category <> 'uncategorized'")
    was = F.lag("category").over(Window.partitionBy(key).orderBy("occurred_at"))
    return found.withColumn("was", was).where("was IS NULL OR was <> category").select(key, "category", F.col("occurred_at").alias("effective_at"))
