"""Tables whose rebuilds are seen as a whole or not at all, and a ledger of runs.

A table is a folder of data folders, each written once, and of numbered manifests that say which data folder holds each key.
A rebuild writes its rows to a new data folder first; the next manifest then appears in one rename that fails if someone else took
the number, in which case the change is laid over theirs. A job that dies before the rename leaves data that no manifest names:
readers never see it, a retry writes anew, and ``sweep`` removes it.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.sources import ingest

#: A manifest lists a key once; a table of more keys than this is keyed too finely.
KEYS = 100_000
#: Characters of a failure's notes.
NOTES = 500


class Table:
    """Rows of one schema in a shared folder, rebuilt by the values of a string, date or whole-number column ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str):
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._fs_path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self) -> int:
        """The number of the newest manifest; 0 before the first commit."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Key, as text, to the name of the data folder that holds its rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).collect()
        return json.loads(lines[0].value)

    def read(self, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """The rows of a version, the newest by default, of all keys or some."""
        held = {k: f for k, f in self.manifest(version).items() if keys is None or k in keys}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        folders = sorted({f"{self.path}/data/{f}/_k={self._escaped(k)}" for k, f in held.items()})
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _escaped(self, key: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key)

    def replace(self, rows: DataFrame, keys: list[str]) -> int:
        """Deletes all rows of the keys and puts these in their place; the new version. Rows of other keys are refused."""
        if len(keys) > KEYS:
            raise ValueError(f"more than {KEYS} keys")
        folder, wanted = uuid.uuid4().hex, sorted(set(keys))
        text = F.col(self.key).cast("string")
        fits = F.coalesce(text.isin(*wanted), F.lit(False))
        checked = rows.select(*self.schema.names).withColumn("_k", F.when(fits, text).otherwise(F.raise_error(F.lit("a row of another key"))))
        checked.write.partitionBy("_k").parquet(f"{self.path}/data/{folder}")
        there = {n.removeprefix("_k=") for n in self._names(f"data/{folder}") if n.startswith("_k=")}
        return self._publish({k: folder if self._escaped(k) in there else None for k in wanted})

    def upsert(self, changes: DataFrame, on: list[str]) -> int:
        """Rows of equal ``on`` are replaced and new ones added; only the keys that the changes touch are rewritten."""
        touched = [r[0] for r in changes.select(F.col(self.key).cast("string")).distinct().limit(KEYS + 1).collect()]
        if len(touched) > KEYS:
            raise ValueError(f"more than {KEYS} keys")
        return self.replace(ingest.upsert(self.read(keys=touched), changes, on), touched)

    def _publish(self, change: dict[str, str | None]) -> int:
        """Lays a change of keys over the newest manifest, in one rename."""
        rename = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._fs_path(f"{self.path}/manifests"))
        while True:
            version = self.version()
            held = {k: f for k, f in (self.manifest(version) | change).items() if f is not None}
            staged = self._fs_path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
            out = self._fs.create(staged, False)
            out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
            out.close()
            target = self._fs_path(f"{self.path}/manifests/{version + 1}.json")
            try:
                rename.rename(staged, target, none)
                return version + 1
            except Exception:
                self._fs.delete(staged, False)
                if not self._fs.exists(target):  # not a race, so the folder can't be written
                    raise

    def sweep(self, keep: int = 1) -> int:
        """Removes what none of the newest ``keep`` manifests name; how many folders. No writer may be at work."""
        newest = self.version()
        named = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v).values()}
        gone = [n for n in self._names("data") if n not in named]
        for name in gone:
            self._fs.delete(self._fs_path(f"{self.path}/data/{name}"), True)
        return len(gone)

    def drop(self) -> None:
        """Removes the whole table."""
        self._fs.delete(self._fs_path(self.path), True)


class Run:
    """A stage at work: what it observes of its rows goes to the ledger with it."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def observe(self, rows: DataFrame, name: str, *aggregates: Column) -> DataFrame:
        """The same rows; once they are written, the aggregates, by default their number, are known without another pass."""
        self.seen[name] = Observation(name)
        return rows.observe(self.seen[name], *(aggregates or (F.count(F.lit(1)).alias("rows"),)))


@contextmanager
def recorded(spark: SparkSession, ledger: str, stage: str, as_of: str | None = None) -> Iterator[Run]:
    """Runs a stage and appends its row to the ledger, with what it observed if it went well, with the error if it failed.

    All that is observed has to be acted upon within the stage.
    """
    started, run, ok, notes = datetime.datetime.now(datetime.UTC), Run(), False, None
    try:
        yield run
        notes = json.dumps({k: o.get for k, o in run.seen.items()}, default=str, sort_keys=True) if run.seen else None
        ok = True
    except BaseException as e:
        notes = f"{type(e).__name__}: {e}"[:NOTES]
        raise
    finally:
        row = (stage, as_of, started, datetime.datetime.now(datetime.UTC), ok, notes)
        schema = "stage string, as_of string, started_at timestamp, finished_at timestamp, ok boolean, notes string"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(ledger)
