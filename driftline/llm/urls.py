"""URL filters: rules first, and gradient-boosted trees on lexical features for what no rule fits.

The trees learn from rows that rules label, at most ``SAMPLE`` of them (those of the least hashed ids). Training and
scoring are DataFrame functions throughout: each level of a tree takes one aggregate of gradients by node, feature and
bin over the sample, of which the driver sees only those sums; the model is then one expression of nested conditions,
added to the scan without a shuffle.

Features: length, depth, digit ratio, character entropy, number of parameters, and the sample's smoothed share of
blocked rows for the host's last label and for the path's file suffix. A null url, or one without ``://``, has an empty
host and path and fits no rule; the trees judge it by what features it has. Without labels of both kinds every verdict
without a rule is that of the sample's only kind (allow without any). Rows that repeat are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint

#: Verdict, host and path of the rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SAMPLE = 4000
TREES, DEPTH, RATE, RIDGE = 8, 3, 0.4, 1.0
#: Lower edges of each feature's bins but the first.
EDGES = {
    "length": (20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 100, 150, 300),
    "depth": (1, 2, 3, 4, 5, 7, 10),
    "digit_ratio": (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3, 0.5),
    "entropy": (2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0, 4.25, 4.5, 5.0),
    "parameters": (1, 2, 3, 5),
    "label_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "file_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case (A-Z), and path of a url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character of a text; 0 if it is empty."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    bits = F.transform(F.transform(kinds, share), lambda p: -p * F.log2(p))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that need no training, and the suffixes, as columns that begin with f_."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.length(url)
    return pages.select(
        "*",
        n.cast("double").alias("f_length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("f_depth"),
        F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0).alias("f_digit_ratio"),
        entropy(url).alias("f_entropy"),
        F.when(query != "", F.length(query) - F.length(F.translate(query, "&;", "")) + 1).otherwise(0).cast("double").alias("f_parameters"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("f_label"),
        F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1).alias("f_file"),
    )


@dataclass
class Trees:
    """Nested (feature, edge, below, at least) or leaf values, the first margin, and the suffix shares."""

    bias: float
    trees: list
    labels: DataFrame | None
    files: DataFrame | None
    mean: float


def _value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, edge, low, high = tree
    return F.when(F.col(f"f_{feature}") < edge, _value(low)).otherwise(_value(high))


def margin(model_bias: float, trees: list) -> Column:
    return reduce(lambda a, t: a + _value(t), trees, F.lit(model_bias))


def _shared(rows: DataFrame, labels: DataFrame, files: DataFrame, mean: float) -> DataFrame:
    """Adds the suffix shares; both tables have a row for each suffix of the sample, so at most ``SAMPLE``."""
    out = rows.join(F.broadcast(labels), "f_label", "left").join(F.broadcast(files), "f_file", "left")
    return out.withColumn("f_label_share", F.coalesce("s_label", F.lit(mean))).withColumn("f_file_share", F.coalesce("s_file", F.lit(mean)))


def _grow(rows: DataFrame, bias: float, trees: list) -> object:
    """One more tree, level by level, from the gradients and curvatures of the logistic loss."""
    p = 1 / (1 + F.exp(-margin(bias, trees)))
    rows = rows.withColumn("g", F.col("y") - p).withColumn("h", p * (1 - p))
    bins = F.array(*(F.struct(F.lit(k).alias("feature"), sum((F.when(F.col(f"f_{n}") >= e, 1).otherwise(0) for e in EDGES[n]), F.lit(0)).alias("bin")) for k, n in enumerate(EDGES)))
    rows = rows.select("*", F.explode(bins).alias("at"))
    names, splits = list(EDGES), {}
    for depth in range(DEPTH):
        sums = rows.withColumn("node", _node(splits, depth)).groupBy("node", "at.feature", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        tables: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in sums:
            tables.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
        for node, by_feature in sorted(tables.items()):
            g, h = (math.fsum(x[i] for _, x in sorted(by_feature[0].items())) for i in (0, 1))
            best = (1e-6, None)
            for k, table in sorted(by_feature.items()):
                low_g = low_h = 0.0
                for edge in range(len(EDGES[names[k]])):
                    a = table.get(edge, (0.0, 0.0))
                    low_g, low_h = low_g + a[0], low_h + a[1]
                    gain = low_g**2 / (low_h + RIDGE) + (g - low_g) ** 2 / (h - low_h + RIDGE) - g**2 / (h + RIDGE)
                    if min(low_h, h - low_h) > 1e-9 and gain > best[0] + 1e-9:
                        best = (gain, (names[k], EDGES[names[k]][edge], RATE * low_g / (low_h + RIDGE), RATE * (g - low_g) / (h - low_h + RIDGE)))
            splits[node] = best[1] or RATE * g / (h + RIDGE)
    return _tree(splits, 1)


def _node(splits: dict, depth: int) -> Column:
    """The node of a row at this depth; the root is 1, the children of n are 2n and 2n + 1; a leaf's number is 0."""

    def at(n: int, left: int) -> Column:
        if not left:
            return F.lit(n)
        s = splits.get(n)
        if not isinstance(s, tuple):
            return F.lit(0)
        return F.when(F.col(f"f_{s[0]}") < s[1], at(2 * n, left - 1)).otherwise(at(2 * n + 1, left - 1))

    return at(1, depth)


def _tree(splits: dict, n: int):
    s = splits.get(n)
    if not isinstance(s, tuple):
        return 0.0 if s is None else s
    low, high = (_tree(splits, m) if m in splits else v for m, v in ((2 * n, s[2]), (2 * n + 1, s[3])))
    return s[0], s[1], low, high


def train(rows: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns from the rows (with page_id, features and a verdict) of the least hashed ids."""
    seen = rows.where("verdict IS NOT NULL").withColumn("y", (F.col("verdict") == "block").cast("double"))
    seen = checkpoint(seen.orderBy(F.xxhash64("page_id"), "page_id", "url").limit(sample).select("y", *(c for c in rows.columns if c.startswith("f_"))))
    total = seen.agg(F.count("*").alias("n"), F.sum("y").alias("bad")).first()
    n, bad = total.n, total.bad or 0.0
    mean = bad / n if n else 0.0

    def shares(of: str) -> DataFrame:
        return checkpoint(seen.groupBy(f"f_{of}").agg(((F.sum("y") + 5 * mean) / (F.count("*") + 5)).alias(f"s_{of}")))

    if not 0 < bad < n:
        return Trees(20.0 if bad else -20.0, [], None, None, mean)
    labels, files = shares("label"), shares("file")
    seen = checkpoint(_shared(seen, labels, files, mean).coalesce(1))
    bias, trees = math.log(bad / (n - bad)), []
    for _ in range(TREES):
        trees.append(_grow(seen, bias, trees))
    return Trees(bias, trees, labels, files, mean)


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict and block_probability of each row."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumn("rule", rule).withColumn("verdict", verdict))
    model = train(rows, sample)
    if model.trees:
        rows = _shared(rows, model.labels, model.files, model.mean)
    chance = 1 / (1 + F.exp(-margin(model.bias, model.trees)))
    rows = rows.withColumn("block_probability", chance)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_probability")
