"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.components import shared_top


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in tests, a folder of our own is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_top(spark))
    return df.checkpoint(eager=True)


_memos: list[dict] = []


def alone(memo: dict | None = None) -> None:
    """Empties the memos that other operators have left in this Python worker; each operator calls it as it starts."""
    for other in _memos:
        if other is not memo:
            other.clear()
    if memo is not None and not any(m is memo for m in _memos):
        _memos.append(memo)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def importable(df: DataFrame) -> DataFrame:
    """Lets Python workers that see the same files import this package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))
    return df


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra ones can't clash with an operator's own."""
    importable(df)
    return df.select(*(F.col(f"`{c}`") for c in columns))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below the one that the cluster names in ``spark.checkpoint.dir``."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or shared_top(spark)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, folder: str) -> None:
    """Removes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
