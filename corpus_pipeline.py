"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing to weights and encoding, one after another.

Each stage takes the documents that the one before it kept and returns a table that is written and read again as the
next one's documents. Toxic documents go; one document of each group of near-duplicates stays (SimHash with pivot tables
for candidates, five-word shingles at a similarity of 0.8 to decide); personal data is replaced by marks; documents are taken as often as the mix says, a repeated one as
repeated rows; the last stage returns the ids of each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, mixing, pii, simhash, toxicity
from driftline.llm.common import forget, shared_folder, table
from driftline.llm.queries import BYTE_VOCABULARY


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; labels of held-out rows aren't learnt from."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates, found by SimHash and decided by shingle sets."""
    return simhash.deduplicated(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by marks."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; of rows that are equal in all, the sum of their copies."""
    own = F.struct(*(F.xxhash64(F.lit(k), *hashable(docs)).alias(f"h{k}") for k in (1, 2)))
    copies = mixing.mix(docs, identity=own).groupBy("identity").agg(F.sum("copies").alias("n")).where("n > 0")
    rows = docs.select(own.alias("identity"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).dropDuplicates(["identity"])
    out = rows.join(copies, "identity").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select("row.*")


def hashable(docs: DataFrame) -> list[Column]:
    """The columns and where they are null, so that rows which differ at all have unlike hashes; maps as JSON."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema]
    values = [F.to_json(c) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, docs.schema)]
    return [*values, *(c.isNull() for c in columns)]


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document."""
    return bpe.encode(docs, BYTE_VOCABULARY)


STAGES = [("toxicity", clean), ("near-duplicates", distinct), ("personal data", redacted), ("mixing", mixed), ("encoding", encoded)]
#: SQL can express none of the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each stage but the last returns is written to the shared folder.

    What a stage wrote is removed once the next one's rows are written; the last one's input stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                forget(spark, f"{folder}/{k - 1}")
    return docs
