"""SHA-256 of the ordered, joined values of each group, for groups of any size.

The rows are range-partitioned by group and order, so a hot group lies in many tasks.  A
task digests the small groups that lie wholly inside its part.  Of the first and last
group of a part, and of values beyond ``CHUNK`` bytes, it puts out the joined text in
chunks of about that size; these meet by group, are sorted and run through the digest
one after the other.  SHA-256 cannot be split, so the bytes of one group pass through
one task in the end, as a stream of chunks that is never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK = 1 << 20
_PART = pa.schema(
    [("grp", pa.binary()), ("seq", pa.int64()), ("chunk", pa.binary()), ("sha256", pa.string())]
)
_DONE = pa.schema([("grp", pa.binary()), ("sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _parts(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        group, values, size, open_ = None, [], 0, True  # open_: the group may go on elsewhere

        def flush() -> None:
            nonlocal values, size, seq
            out.append((group, seq, separator.join(values), None))
            values, size, seq = [], 0, seq + 1

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != group:
                    if group is not None:
                        if open_:
                            if values:
                                flush()
                        else:
                            out.append((group, 0, None, hashlib.sha256(separator.join(values)).hexdigest()))
                        open_ = False
                    group, values, size = key, [], 0
                values.append(value)
                size += len(value)
                if size >= CHUNK:
                    open_ = True
                    flush()
            yield _batch(out, _PART)
            out.clear()
        if group is not None and values:
            flush()  # the last group of the part may go on in the next
        yield _batch(out, _PART)

    return run


def _joined(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for key, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == group:
                    state.update(separator)
                else:
                    if group is not None:
                        out.append((group, state.hexdigest()))
                    group, state = key, hashlib.sha256()
                state.update(chunk)
            yield _batch(out, _DONE)
        if group is not None:
            yield _batch([(group, state.hexdigest())], _DONE)

    return run


def ordered_sha256(rows: DataFrame, key: str, order: list[str], value: str, separator: str) -> DataFrame:
    """(grp binary, sha256): ``value`` of each ``key`` (both binary), joined in order.

    ``order`` must tell the rows of a group apart, or tied rows must have equal values.
    Null values are left out; a group without values has no row.
    """
    glue = separator.encode()
    placed = (
        rows.filter(F.col(value).isNotNull())
        .repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .select(key, value)
    )
    parts = stored(placed.mapInArrow(_parts(glue), "grp binary, seq long, chunk binary, sha256 string"))
    whole = parts.filter("sha256 IS NOT NULL").select("grp", "sha256")
    chunks = parts.filter("sha256 IS NULL").repartition("grp").sortWithinPartitions("grp", "seq")
    return whole.unionByName(
        chunks.select("grp", "chunk").mapInArrow(_joined(glue), "grp binary, sha256 string")
    )
