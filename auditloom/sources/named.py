"""Files with names of their own: ``df.write.format("named_files")``.

Rows are (path, content); path is relative to the option ``folder``.  A task writes what it
gets under a staging folder of its attempt and a list of names; when all tasks have
ended, the driver moves the listed files into place, so a lost or repeated task leaves
nothing behind that anyone reads.  A file of the same name is replaced.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import cleaned_up
from . import files

SCHEMA = "path string, content binary"


@dataclass
class Staged(WriterCommitMessage):
    names: str | None
    n_files: int


class NamedWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = posixpath.join(folder, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, staging = files.opened(self.staging)
        own = posixpath.join(staging, uuid.uuid4().hex)
        system.create_dir(own)
        names = posixpath.join(own, "names")
        n = 0
        with system.open_output_stream(names) as listing:
            for row in iterator:
                if not row.path or row.path.startswith("/") or ".." in row.path.split("/"):
                    raise ValueError(f"not a name inside the folder: {row.path!r}")
                with system.open_output_stream(posixpath.join(own, str(n))) as out:
                    out.write(bytes(row.content or b""))
                listing.write(json.dumps(row.path).encode() + b"\n")
                n += 1
        return Staged(own, n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder = files.opened(self.folder)
        made = set()
        for message in filter(None, messages):
            with system.open_input_stream(posixpath.join(message.names, "names")) as listing:
                names = [json.loads(x) for x in listing.read().splitlines()]
            for n, name in enumerate(names):
                target = posixpath.join(folder, name)
                if (parent := posixpath.dirname(target)) not in made:
                    system.create_dir(parent)
                    made.add(parent)
                system.move(posixpath.join(message.names, str(n)), target)
        self._clear(system)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(files.opened(self.folder)[0])

    def _clear(self, system) -> None:
        try:
            system.delete_dir(files.opened(self.staging)[1])
        except OSError:
            pass  # no task has written anything


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["folder"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files below ``folder``."""
    rows.sparkSession.dataSource.register(NamedFiles)
    plain = rows.selectExpr("path", "cast(content as binary) as content")
    with cleaned_up(rows.sparkSession):
        plain.write.format("named_files").mode("append").option("folder", folder).save()
