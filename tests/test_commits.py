import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftline.sources import commits

SCHEMA = "week date, id long, score double"


def rows(spark, data):
    return spark.createDataFrame(data, "week string, id long, score double").withColumn("week", F.col("week").cast("date"))


def held(table, **at):
    return sorted((str(r.week), r.id, r.score) for r in table.read(**at).collect())


ONE = [("2024-01-01", 1, 0.5), ("2024-01-08", 1, 0.6), ("2024-01-08", 2, 0.7)]


@pytest.fixture
def table(spark, tmp_path):
    t = commits.Table(spark, str(tmp_path / "gate"), SCHEMA, "week")
    assert held(t) == [] and t.version() == 0
    assert t.replace(rows(spark, ONE), ["2024-01-01", "2024-01-08"]) == 1
    return t


def test_a_week_is_rebuilt_and_others_stay(spark, table):
    table.replace(rows(spark, [("2024-01-08", 3, 0.9)]), ["2024-01-08"])
    assert held(table) == [ONE[0], ("2024-01-08", 3, 0.9)]
    table.replace(rows(spark, []), ["2024-01-01"])  # a week that has no candidates any more
    assert held(table) == [("2024-01-08", 3, 0.9)]
    assert held(table, version=1) == ONE  # older versions can be read until they are swept
    assert table.sweep() == 2 and held(table) == [("2024-01-08", 3, 0.9)]


def test_rebuilds_are_idempotent(spark, table):
    for _ in range(2):
        table.replace(rows(spark, ONE[1:]), ["2024-01-08"])
    assert held(table) == ONE


def test_upsert_rewrites_touched_weeks_only(spark, table):
    before = table.manifest()
    table.upsert(rows(spark, [("2024-01-08", 2, 0.1), ("2024-01-15", 9, 0.2)]), ["week", "id"])
    assert held(table) == [*ONE[:2], ("2024-01-08", 2, 0.1), ("2024-01-15", 9, 0.2)]
    assert table.manifest()["2024-01-01"] == before["2024-01-01"] != table.manifest()["2024-01-08"]


def test_a_job_that_fails_midway_leaves_the_old_rows(spark, table):
    broken = rows(spark, [(w, i, s * 2) for w, i, s in ONE]).withColumn("score", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken, ["2024-01-01", "2024-01-08"])
    with pytest.raises(Exception, match="another key"):
        table.replace(rows(spark, ONE), ["2024-01-08"])
    assert held(table) == ONE and table.version() == 1


def test_two_writers_at_once(spark, table, monkeypatch):
    """One takes the other's number; the other lays its change over it."""
    other = commits.Table(spark, table.path, SCHEMA, "week")
    real, first = table.version, []

    def version():
        found = real()
        if not first:
            first.append(other.replace(rows(spark, [("2024-01-01", 7, 0.7)]), ["2024-01-01"]))
        return found

    monkeypatch.setattr(table, "version", version)
    assert table.replace(rows(spark, []), ["2024-01-08"]) == 3
    assert held(other) == [("2024-01-01", 7, 0.7)]


def test_a_process_killed_before_the_manifest(spark, table):
    """All its rows are written, then the process ends; the old rows stay, a retry gives the new ones, the rest is swept."""
    code = f"""
        import os
        from pyspark.sql import SparkSession
        from driftline.sources import commits
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        table = commits.Table(spark, {table.path!r}, "week date, id long, score double", "week")
        table._publish = lambda change: os._exit(9)
        table.replace(spark.sql("SELECT DATE '2024-01-08' AS week, 5L AS id, 1D AS score"), ["2024-01-08"])
    """
    root = str(Path(__file__).parents[1])
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=120).returncode == 9
    assert len(table._names("data")) == 2 and held(table) == ONE
    table.replace(rows(spark, [("2024-01-08", 5, 1.0)]), ["2024-01-08"])
    assert held(table) == [ONE[0], ("2024-01-08", 5, 1.0)] and table.sweep() == 1


def test_keys_of_any_text(spark, tmp_path):
    t = commits.Table(spark, str(tmp_path / "links"), "ticker string, line string", "ticker")
    data = spark.createDataFrame([("A/B=1", "x"), ("é %", "y"), ("C:D", "z")], "ticker string, line string")
    t.replace(data, ["A/B=1", "é %", "C:D"])
    t.replace(data.limit(0), ["C:D"])
    assert sorted(map(tuple, t.read().collect())) == [("A/B=1", "x"), ("é %", "y")]


def test_ledger_records_failures_too(spark, tmp_path):
    ledger, out = str(tmp_path / "runs"), str(tmp_path / "out")
    with commits.recorded(spark, ledger, "gate", "2024-01-08") as run:
        run.observe(rows(spark, ONE), "decisions", F.count(F.lit(1)).alias("rows"), F.max("score").alias("best")).write.parquet(out)
    with pytest.raises(ValueError), commits.recorded(spark, ledger, "score") as run:
        run.observe(rows(spark, ONE), "never acted upon")
        raise ValueError("no " + "x" * 900)
    good, bad = sorted(spark.read.parquet(ledger).collect(), key=lambda r: r.stage)
    assert (good.stage, good.as_of, good.ok, good.notes) == ("gate", "2024-01-08", True, '{"decisions": {"best": 0.7, "rows": 3}}')
    assert (bad.stage, bad.ok) == ("score", False) and bad.notes.startswith("ValueError: no x") and len(bad.notes) == commits.NOTES
    assert good.started_at <= good.finished_at
