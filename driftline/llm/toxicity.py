"""Toxicity scores by a counterfactually regularised linear classifier.

A text's features are which words, and which word beginnings of 4 to 6 letters, it has. A logistic model learns from at
most ``SAMPLE`` labelled rows of each class, those of the least hashed ids; features are kept if the classes differ in
them by ``Z`` standard errors. Labelled sentences that name a group are also shown with another group named, and the
square of the change in logit is penalised, as it is for pairs of neutral sentences about groups; so a group's name
alone doesn't raise a score. The intercept is set to the share of toxic rows among all rows that may be learnt from.

The score depends on the text alone. Null texts count as empty; an empty text scores the prior. With no labelled rows,
or only one class of them, every score is that prior (0 without labels). Repeated rows score alike. Labels other than
0 and 1 are left out, as are those of an id that has both. Of documents that repeat an id, the one of the least text hash
is learnt from, so repeats don't add to what reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftline.llm.common import alone, importable, only, sliced, texts

#: Labelled rows of each class that are learnt from, at most.
SAMPLE = 3000
#: Features are hashed to so many places; least standard errors and rows of one that is kept.
PLACES, Z, LEAST = 1 << 22, 4.0, 6
#: Weight of the counterfactual penalty, and of the weights' squares.
FAIR, RIDGE = 1.0, 2e-3
STEPS, RATE = 200, 0.1
THRESHOLD = 0.3
#: Entries of a worker's memo before it starts anew.
MEMO, SHORT = 200_000, 64
#: Words that name groups of people.
GROUPS = """women men woman man girls boys gay lesbian straight transgender bisexual black white asian african latino
european american muslim christian jewish hindu buddhist atheist immigrant immigrants refugee refugees disabled deaf
blind elderly young old mujeres hombres frauen männer femmes hommes juif musulman chrétien judío musulmán cristiano
jude muslimisch christlich""".split()
GROUP_SET = frozenset(GROUPS)
NEUTRAL = ("i met some {} people today", "the {} community opened a new school", "my neighbour is {} and likes music", "many {} families live here")
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")


def places(word: str) -> list[int]:
    """The places of a word's features."""
    names = [f"w {word}", *(f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(x.encode()) % PLACES for x in names]


def features(text: str) -> set[int]:
    return {p for w in {w for c in set(text.lower().split()) for w in WORD.findall(c)} for p in places(w)}


def swapped(text: str) -> str:
    """The text with each group named in it, sentence by sentence, replaced by another; as it is if it names none."""

    def swap(m: re.Match) -> str:
        w = m[0].lower()
        return GROUPS[(GROUPS.index(w) + 1 + zlib.crc32(w.encode()) % (len(GROUPS) - 1)) % len(GROUPS)] if w in GROUP_SET else m[0]

    return "".join(WORD.sub(swap, s) if not GROUP_SET.isdisjoint(WORD.findall(s.lower())) else s for s in SENTENCE.findall(text))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, and the features of the text and of its counterfactual (null if it names no group)."""
    pack = lambda x: np.fromiter(sorted(x), np.int32).tobytes()
    alone()
    for batch in sliced(batches):
        own, other = [], []
        for text in texts(batch):
            own.append(pack(features(text)))
            other.append(pack(features(s)) if (s := swapped(text)) != text else None)
        yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(own, pa.binary()), pa.array(other, pa.binary())], ["toxic", "own", "other"])


@dataclass
class Model:
    """Weights by feature place, and the intercept."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def logit(self, found: set[int]) -> float:
        return self.bias + sum(self.weights.get(p, 0.0) for p in sorted(found))

    def score(self, text: str) -> float:
        return probability(self.logit(features(text)))


def probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def fit(labels: np.ndarray, own: list[np.ndarray], other: list[np.ndarray | None], prior: float, fair: float = FAIR) -> Model:
    """Trains on the features of each example and, where there is one, of its counterfactual; prior: share of toxic rows."""
    n, bad = len(labels), int(labels.sum())
    offset = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-700.0 if prior <= 0 else 700.0)
    if not 0 < bad < n:
        return Model(offset)
    many = np.bincount(np.concatenate(own), minlength=PLACES)
    hits = np.bincount(np.concatenate([x for x, y in zip(own, labels) if y]), minlength=PLACES)
    p, p1, p0 = many / n, hits / bad, (many - hits) / (n - bad)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / bad + 1 / (n - bad)))
    keep = np.flatnonzero((many >= min(LEAST, max(2, bad // 4))) & (np.nan_to_num(z) >= Z))
    if not len(keep):
        return Model(offset)
    place = np.full(PLACES, -1, np.int32)
    place[keep] = np.arange(len(keep))

    def rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each feature that is kept."""
        cols = [place[x][place[x] >= 0] for x in lists]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([*cols, np.empty(0, np.int32)])

    pairs = [(a, b) for a, b in zip(own, other) if b is not None]
    neutral = [[np.fromiter(features(t.format(g)), np.int64) for g in GROUPS] for t in NEUTRAL]
    pairs += [(x[i], x[(i + 7) % len(x)]) for x in neutral for i in range(len(x))]
    (r, c), (ra, ca), (rb, cb) = rows(own), rows([a for a, _ in pairs]), rows([b for _, b in pairs])
    w, bias, size = np.zeros(len(keep)), float(np.log(bad / (n - bad))), len(keep)
    mean, var = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        error = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, w[c], n), -30, 30))) - labels
        change = np.bincount(ra, w[ca], len(pairs)) - np.bincount(rb, w[cb], len(pairs))
        g = np.bincount(c, error[r], size) / n + RIDGE * w
        g += 2 * fair * (np.bincount(ca, change[ra], size) - np.bincount(cb, change[rb], size)) / len(pairs)
        g = np.append(g, error.mean())
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g**2
        move = RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    bias += offset - float(np.log(bad / (n - bad)))
    return Model(float(bias), {int(k): float(x) for k, x in zip(keep, w) if abs(x) > 1e-6})


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fair: float = FAIR) -> Model:
    """Learns from the labelled rows that aren't held out; at most ``sample`` of each class reach the driver, as features."""
    learnt = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    learnt = learnt.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    counts = {r.toxic: r["count"] for r in learnt.groupBy("toxic").count().collect()}
    total, bad = sum(counts.values()), counts.get(1, 0)
    if not total:
        return Model(-700.0)
    chosen = [learnt.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # 2 x sample ids at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("one"))
    found = rows.select("one.text", "toxic").mapInArrow(_examples, "toxic int, own binary, other binary").collect()
    found.sort(key=lambda r: (r.toxic, bytes(r.own)))  # so that the sums don't depend on the order of rows
    unpack = lambda x: None if x is None else np.frombuffer(x, np.int32)
    return fit(np.array([r.toxic for r in found], np.float64), [unpack(r.own) for r in found], [unpack(r.other) for r in found], bad / total, fair)


class Memo(dict):
    """White-space-delimited chunk to the places in it that have a weight.

    At most ``MEMO`` chunks of at most ``SHORT`` characters are kept, so that texts without blanks don't fill it.
    """

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out = tuple(p for w in WORD.findall(chunk) for p in places(w) if p in self.weights)
        if len(chunk) <= SHORT:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = out
        return out


@lru_cache(maxsize=2)
def memo(bias: float, weights: tuple[tuple[int, float], ...]) -> Memo:
    return Memo(dict(weights))


def _score(batches: Iterator[pa.RecordBatch], bias: float, weights: tuple[tuple[int, float], ...], place: int) -> Iterator[pa.RecordBatch]:
    own = memo(bias, weights)
    alone(own)
    for batch in sliced(batches):
        scores = []
        for text in texts(batch, place):
            found: set[int] = set()
            for c in set(text.lower().split()):
                if x := own[c]:
                    found.update(x)
            scores.append(probability(bias + sum(own.weights[p] for p in sorted(found))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows with their score, in a column of this name, which they may not have yet."""
    plain = importable(docs).toDF(*(f"c{k}" for k in range(len(docs.columns))))  # columns of any name pass
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    made = partial(_score, bias=model.bias, weights=tuple(sorted(model.weights.items())), place=docs.columns.index("text"))
    return plain.mapInArrow(made, schema).toDF(*docs.columns, name)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``THRESHOLD``) of each row."""
    out = score(only(docs, "doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows and columns of ``docs`` whose score is under the threshold."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model or train(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)
