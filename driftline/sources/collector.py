"""Collectors as a data source of Spark: landed pages of a source as draft events, by windows of days, in batch or as a stream.

Pages land in a folder for each day, ``<path>/<kind>/<yyyy-mm-dd>/*.json``, a record a line. A read covers the half-open window
[since, until) in chunks of days, newest first, one partition each; a stream's offset is the day up to which it has read, so a
restart goes on at that day and batch and stream give the same drafts. A record that can't be understood gives none and
spoils nothing else. Paths are those of any store that pyarrow opens.

    spark.dataSource.register(Landed)
    spark.read.format("landed").option("path", p).option("kind", "contributors").option("since", "2024-01-01").load()
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, source_event_uid string, event_type string, occurred_at timestamp, origin string, payload string"
#: Fixed value: contributors that are kept of a repository.
CONTRIBUTORS = 10
Draft = tuple[str, str, str, dict]


def contributors(record: dict, day: str) -> Draft | None:
    """Who builds a repository, one event for each: the first few accounts, those without a login left out; none for an empty list."""
    rows = record["contributors"]
    if not isinstance(rows, list) or not rows:
        return None
    kept = [{"login": r["login"], "contributions": r.get("contributions")} for r in rows[:CONTRIBUTORS] if r.get("login")]
    return "github", f"repo_contributors:{record['full_name']}", "repo_contributors", {"full_name": record["full_name"], "contributors": kept}


def package_metadata(record: dict, day: str) -> Draft | None:
    """What a package says of itself and needs."""
    info = record["info"]
    return "pypi", f"pypi_metadata:{info['name']}:{info.get('version')}", "pypi_metadata", {k: info.get(k) for k in ("name", "version", "summary", "home_page", "project_urls", "requires_dist")}


def listed_models(record: dict, day: str) -> Draft | None:
    """A model that a marketplace lists."""
    return "openrouter", f"or_listing:{record['id']}", "or_listing", {k: record.get(k) for k in ("id", "name", "created", "pricing", "context_length")}


#: A collector is a function of a record and its day; None: no draft.
COLLECTORS: dict[str, Callable[[dict, str], Draft | None]] = {"contributors": contributors, "package_metadata": package_metadata, "listed_models": listed_models}


@dataclass
class Days(InputPartition):
    """The landed days of one chunk of a window."""

    days: tuple[str, ...]


def _day(x: str) -> datetime.date:
    return datetime.date.fromisoformat(x)


class _Pages:
    """Where the pages are and what becomes of them; shared by both readers."""

    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.origin = options["path"].rstrip("/"), options["kind"], options.get("origin", "live")
        if self.kind not in COLLECTORS:
            raise ValueError(f"no collector {self.kind}; there are {', '.join(sorted(COLLECTORS))}")
        self.since, self.until, self.chunk = options.get("since"), options.get("until"), int(options.get("chunk_days", 30))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def landed(self) -> list[str]:
        """The days that pages have landed for, within the window."""
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(f"{root}/{self.kind}", allow_not_found=True))
        days = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        return [d for d in days if (self.since is None or d >= self.since) and (self.until is None or d < self.until)]

    def chunks(self, days: list[str]) -> list[Days]:
        """Days by chunks counted back from the last one, newest first."""
        by: dict[int, list[str]] = {}
        for d in days:
            by.setdefault((_day(days[-1]) - _day(d)).days // self.chunk, []).append(d)
        return [Days(tuple(by[k])) for k in sorted(by)]

    def read(self, partition: Days | None) -> Iterator[tuple]:
        """Drafts of a chunk; Spark asks for None where there are no chunks."""
        from pyarrow import fs

        store, root = self._store()
        collect = COLLECTORS[self.kind]
        for day in partition.days if partition else ():
            at = datetime.datetime.combine(_day(day), datetime.time(), datetime.UTC)
            for file in sorted(store.get_file_info(fs.FileSelector(f"{root}/{self.kind}/{day}")), key=lambda f: f.path):
                if file.type != fs.FileType.File or not file.base_name.endswith(".json"):
                    continue
                with store.open_input_stream(file.path) as stream:
                    for line in _lines(stream):
                        try:
                            draft = collect(json.loads(line), day)
                        except (ValueError, KeyError, TypeError, AttributeError):
                            continue  # one target's trouble
                        if draft is not None:
                            source, uid, kind, payload = draft
                            yield source, uid, kind, at, self.origin, json.dumps(payload, ensure_ascii=False)


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a stream, a piece of it at a time."""
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


class _Batch(DataSourceReader):
    def __init__(self, pages: _Pages):
        self.pages = pages

    def partitions(self) -> list[Days]:
        days = self.pages.landed()
        return self.pages.chunks(days) if days else []

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.pages.read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are {"until": day}: all days before it have been read."""

    def __init__(self, pages: _Pages):
        self.pages, self.last = pages, None

    def initialOffset(self) -> dict:
        return {"until": self.pages.since or "0001-01-01"}

    def latestOffset(self) -> dict:
        days = self.pages.landed()
        found = str(_day(days[-1]) + datetime.timedelta(1)) if days else self.initialOffset()["until"]
        self.last = max(found, self.last or found)
        return {"until": self.last}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        days = [d for d in self.pages.landed() if start["until"] <= d < end["until"]]
        return self.pages.chunks(days) if days else []

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.pages.read(partition)


class Landed(DataSource):
    """Options: path, kind, since and until (half-open, days), chunk_days, origin."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Pages(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Pages(self.options))
