"""A source tree as a Spark table or stream: ``spark.read.format("source_tree")``.

Options: ``roots``, a JSON object of run id to list of roots (directories or files);
``excluded``, comma list of directory names that are not entered; ``partitionBytes``.

Columns: run_id, root, path, ext (lower-cased last extension), kind (file, symlink,
unreadable), length, changed (time), content (null unless a readable file).  Every name is kept,
also those that begin with a dot or an underscore, which Spark's file sources leave out.
Filters on ext (equal, in) and length (up to) are applied before a file is opened.

The driver walks directories and plans partitions as ranges of names of about
``partitionBytes``; tasks list the names of their directories again, look at those of their
range and open the files.  Overlapping roots of a run give each file once.

As a stream, a batch holds what has changed since the last one, found by change time.  A
file may come again near the border of two batches; ``streaming.live.changed_files``
lets out only files whose content is new.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from ..functions import fixed
from . import files

SCHEMA = (
    "run_id string, root string, path string, ext string, kind string, length long, "
    "changed timestamp, content binary"
)
PARTITION_BYTES = 64 << 20
#: An empty file still costs its opening.
OPEN_BYTES = 64 << 10
#: Changes this close to the last batch's end are looked at again.
SLACK_NS = 2_000_000_000


@dataclass(frozen=True)
class Names:
    """The names of one directory from first to last."""

    run_id: str
    root: str
    directory: str
    first: str
    last: str


@dataclass
class Slice(InputPartition):
    parts: list[Names]
    since: int = -1
    until: int | None = None


@dataclass
class Wanted:
    """Pushed filters; None lets everything through."""

    extensions: set[str] | None = None
    most: int | None = None
    pushed: list[str] = field(default_factory=list)

    def take(self, given: Filter) -> bool:
        """Whether the filter is applied here."""
        column, value = getattr(given, "attribute", ()), getattr(given, "value", None)
        if isinstance(given, (EqualTo, In)) and column == ("ext",):
            names = {value} if isinstance(given, EqualTo) else set(value)
            self.extensions = names if self.extensions is None else self.extensions & names
            return True
        if isinstance(given, (LessThan, LessThanOrEqual)) and column == ("length",):
            most = value - 1 if isinstance(given, LessThan) else value
            self.most = most if self.most is None else min(self.most, most)
            return True
        return False

    def lets(self, entry: files.Entry) -> bool:
        if self.extensions is not None and extension(entry.name) not in self.extensions:
            return False
        # a comparison with an unknown length is not true
        return self.most is None or (entry.length is not None and entry.length <= self.most)


def extension(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


class _Walk:
    def __init__(self, options: dict):
        self.roots: dict[str, list[str]] = json.loads(options["roots"])
        names = options.get("excluded")
        self.excluded = frozenset(fixed.EXCLUDED_DIRS if names is None else filter(None, names.split(",")))
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted = Wanted()

    def _held(self) -> Iterator[tuple[str, str, str, list[files.Entry]]]:
        """(run, root, directory, entries): each directory of a run once."""
        for run, roots in self.roots.items():
            seen, alone = set(), []
            for root in sorted({r.rstrip("/") or "/" for r in roots}):
                system, path = files.opened(root)
                entry = files.look(system, path)
                if entry.kind != "directory":
                    alone.append((root, path, entry))
                    continue
                for directory, entries in files.directories(system, path, self.excluded):
                    if directory not in seen:
                        seen.add(directory)
                        yield run, root, directory, entries
            for root, path, entry in alone:
                if path.rpartition("/")[0] not in seen:
                    yield run, root, path.rpartition("/")[0], [entry]

    def slices(self, since: int = -1, until: int | None = None) -> list[Slice]:
        out, size = [Slice([], since, until)], 0
        for run, root, directory, entries in self._held():
            first = None
            for k, entry in enumerate(entries):
                if not self.wanted.lets(entry) or not _within(entry, since, until):
                    continue
                first = first or entry.name
                size += OPEN_BYTES + (entry.length or 0)
                if size >= self.bytes:
                    out[-1].parts.append(Names(run, root, directory, first, entry.name))
                    out.append(Slice([], since, until))
                    first, size = None, 0
            if first is not None:
                out[-1].parts.append(Names(run, root, directory, first, entries[-1].name))
        return [s for s in out if s.parts] or out[:1]

    def latest(self) -> int:
        return max((e.changed for _, _, _, entries in self._held() for e in entries), default=0)

    def rows(self, part: Slice) -> Iterator[tuple]:
        for names in part.parts:
            system, top = files.opened(names.root)
            single = files.look(system, top).kind != "directory"
            entries = [files.look(system, top)] if single else files.listed(system, names.directory, names.first, names.last)
            for entry in entries:
                if entry.kind == "directory":
                    continue
                if not self.wanted.lets(entry) or not _within(entry, part.since, part.until):
                    continue
                data = files.content(system, entry.path) if entry.kind == "file" else None
                kind = "unreadable" if entry.kind == "file" and data is None else entry.kind
                time = datetime.datetime.fromtimestamp(entry.changed / 1e9, datetime.UTC)
                yield names.run_id, names.root, entry.path, extension(entry.name), kind, entry.length, time, data


def _within(entry: files.Entry, since: int, until: int | None) -> bool:
    return entry.changed > since and (until is None or entry.changed <= until)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.walk = _Walk(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for given in filters:
            if not self.walk.wanted.take(given):
                yield given

    def partitions(self) -> list[InputPartition]:
        return self.walk.slices()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.walk.rows(partition)


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.walk = _Walk(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": self.walk.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.walk.slices(max(-1, start["changed"] - SLACK_NS), end["changed"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.walk.rows(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema: StructType) -> TreeStreamReader:  # noqa: N802
        return TreeStreamReader(self.options)


def _options(roots: dict[str, list[str]], excluded: Iterable[str] | None, partition_bytes: int) -> dict:
    out = {"roots": json.dumps(roots), "partitionBytes": str(partition_bytes)}
    return out if excluded is None else out | {"excluded": ",".join(excluded)}


def read_tree(
    spark: SparkSession,
    roots: dict[str, list[str]],
    excluded: Iterable[str] | None = None,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Files below the roots of each run; filters on ext and length go into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(**_options(roots, excluded, partition_bytes)).load()


def stream_tree(
    spark: SparkSession,
    roots: dict[str, list[str]],
    excluded: Iterable[str] | None = None,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").options(**_options(roots, excluded, partition_bytes)).load()
