"""Picks under caps and budgets, councils, threads and calendars: small plans that others rank and report with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.graph import top_per


def best_threads(threads: DataFrame, entity: str, thread: str, score: str, least: int = 60, cap: int = 8) -> DataFrame:
    """Each entity's threads by their best score, those of at least so much, the best few."""
    best = threads.groupBy(entity, thread).agg(F.max(score).alias(score)).where(F.col(score) >= least)
    return top_per(best, [entity], [F.desc(score), F.col(thread)], cap)


def merged_hits(hits: DataFrame, thread: str, asked: str, keep: list[str]) -> DataFrame:
    """Hits of several searches as one row for each thread, with the searches that found it in order."""
    return hits.groupBy(thread).agg(F.array_sort(F.collect_set(asked)).alias("matched"), *(F.max(c).alias(c) for c in keep))


def backlog(texts: DataFrame, key: str, text: str, done: DataFrame, limit: int) -> DataFrame:
    """The rows with the longest texts that aren't done yet."""
    open_ = texts.join(done.select(key), key, "left_anti").select(key, F.length(text).cast("long").alias("n"))
    return open_.orderBy(F.desc("n"), key).limit(limit)


def split_budget(queues: list[DataFrame], limit: int, shares: list[float]) -> DataFrame:
    """(queue, place, row's columns): each queue's share of a limit; what one can't use tops up the others, in order.

    A queue has the column ``place``, its rows' order from 1; only their counts reach the driver.
    """
    held = [q.count() for q in queues]
    taken = [min(n, int(limit * s)) for n, s in zip(held, shares)]
    for k, n in enumerate(held):
        taken[k] += min(n - taken[k], limit - sum(taken))
    picked = [q.where(F.col("place") <= n).withColumn("queue", F.lit(k)) for k, (q, n) in enumerate(zip(queues, taken))]
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


def in_order(kind: Column, order: list[str]) -> Column:
    """The place of a kind in a fixed order of display; unknown ones come last."""
    places = F.create_map(*(F.lit(x) for k, name in enumerate(order) for x in (name, k)))
    return F.coalesce(places[kind], F.lit(len(order)))


def full_council(verdicts: DataFrame, entity: str, role: str, least: int = 3) -> DataFrame:
    """Entities on which enough roles have given a verdict."""
    return verdicts.groupBy(entity).agg(F.count_distinct(role).alias("roles")).where(F.col("roles") >= least)


def only_candidate(candidates: DataFrame, asked: str, passes: Column, found: str) -> DataFrame:
    """What each search resolves to: its one candidate that passes; null if none or several do."""
    return candidates.groupBy(asked).agg(F.when(F.count_if(passes) == 1, F.max(F.when(passes, F.col(found)))).alias(found))


def folded_text(chunks: DataFrame, key: str, at: str, text: str, cap: int = 4000) -> DataFrame:
    """Each key's chunks in order as one text, cut at so many characters."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("text"))))
    whole = F.array_join(F.transform(ordered, lambda x: x["text"]), " ")
    return chunks.groupBy(key).agg(F.substring(whole, 1, cap).alias("text"))


def search_terms(name: Column, anchor: Column, least: int = 4) -> Column:
    """The name and the anchor without its owner, in lower case, each once, if long enough to search for."""
    own = F.array(F.lower(F.trim(name)), F.lower(F.element_at(F.split(anchor, "/"), -1)))
    return F.array_distinct(F.filter(own, lambda x: F.length(x) >= least))


def display_tags(tags: Column, most: int = 20) -> Column:
    """Tags to show: those with a prefix go, but for licences; each once."""
    shown = F.filter(tags, lambda t: ~F.contains(t, F.lit(":")) | F.startswith(t, F.lit("license:")))
    return F.slice(F.array_distinct(shown), 1, most)


def cost(tokens_in: Column, tokens_out: Column, price_in: str, price_out: str) -> Column:
    """Price of a call, by prices for a million tokens, as a decimal."""
    return ((tokens_in * F.lit(price_in).cast("decimal(12,6)") + tokens_out * F.lit(price_out).cast("decimal(12,6)")) / F.lit(1_000_000)).cast("decimal(18,6)")


def replay_days(cases: DataFrame, first: str, last: str, step: int = 1) -> DataFrame:
    """Cases with ``day``, each of the days to replay of their windows."""
    return cases.withColumn("day", F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"), F.make_dt_interval(F.lit(step)))))


def replay_weeks(cases: DataFrame, first: str, last: str) -> DataFrame:
    """Cases with ``week``, the Mondays of the ISO weeks that their windows touch."""
    monday = F.to_date(F.date_trunc("week", F.col(first).cast("date")))
    return cases.withColumn("week", F.explode(F.sequence(monday, F.col(last).cast("date"), F.make_dt_interval(F.lit(7)))))
