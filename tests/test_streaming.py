"""Streams that are run to their end against the batch plan of the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from driftline.streaming import ingest

ROWS = [(f"u{i % 23}", i % 3, "view" if i % 2 else "click", dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * (i % 23)), float(i % 5)) for i in range(60)]
SCHEMA = "uid string, entity_id long, event_type string, occurred_at timestamp, value double"


def finished(spark, tmp_path, transform, mode):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_each_key_once(spark, tmp_path):
    got = finished(spark, tmp_path, lambda s: ingest.deduplicated(s, ["uid"]), "append")
    assert sorted(r.uid for r in got) == sorted({r[0] for r in ROWS})


def test_iso_weeks(spark, tmp_path):
    got = {(r.week.start.date(), r.event_type): r.n for r in finished(spark, tmp_path, ingest.weekly, "complete")}
    want: dict = {}
    for _, _, kind, at, _ in ROWS:
        key = (at - dt.timedelta(days=at.weekday())).date(), kind
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_sliding_sums(spark, tmp_path):
    got = {(r.entity_id, r.days.end.date()): r.value for r in finished(spark, tmp_path, lambda s: ingest.sliding(s, 7), "complete")}
    batch = spark.createDataFrame(ROWS, SCHEMA).withColumn("d", F.to_date("occurred_at"))
    want = {(r.entity_id, r.e): r.v for r in batch.select("entity_id", "value", F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", 7))).alias("e")).groupBy("entity_id", "e").agg(F.sum("value").alias("v")).collect()}
    assert got == want
