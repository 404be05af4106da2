"""Document fingerprints from Lempel-Ziv phrases.

A document's UTF-8 bytes are parsed into dictionary phrases, each the shortest stretch
that is not a phrase yet.  The phrase set is hashed, and its minima under ``HASHES``
functions, sixteen bits each, are the fingerprint.  The share of equal minima of two
fingerprints estimates the overlap of the phrase sets, which is large where one text
helps to compress the other.

Defined results.  A null text is empty; the empty text has a fingerprint of its own, like
itself alone.  Equal texts have equal fingerprints.  In ``compare_with_next`` rows are
taken by falling id, rows of one id by a hash of their text, then the text; null ids come
last; a single row is its own next.  Empty tables give empty results; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored
from .minhash import HASHES, signatures


def phrases(data: bytes) -> set[bytes]:
    """The phrase set of a text; a last stretch that is already a phrase adds nothing."""
    seen: set[bytes] = set()
    add, start = seen.add, 0
    for end in range(1, len(data) + 1):
        phrase = data[start:end]
        if phrase not in seen:
            add(phrase)
            start = end
    return seen


def fingerprints(texts: list[str]) -> list[bytes]:
    """A fingerprint of each text: HASHES little-endian 16-bit numbers."""
    sets = []
    for text in texts:
        found = phrases(text.encode("utf-8", "surrogatepass"))
        if found:
            sets.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    minima = iter((signatures(sets) & np.uint32(0xFFFF)).astype("<u2"))
    return [next(minima).tobytes() if text else b"\xff" * (2 * HASHES) for text in texts]


def likeness(left: bytes, right: bytes) -> float:
    """The share of equal minima."""
    return float((np.frombuffer(left, "<u2") == np.frombuffer(right, "<u2")).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FULL = f"part int, role string, text string, {_RESULT}"


def _results(ids: list, texts: list[str], prints: list[bytes], following: list[str], next_prints: list[bytes]) -> dict:
    """Result columns for texts with their next texts."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    changed_prints = fingerprints(changed)
    return {
        "id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed], pa.binary()),
        "fingerprint": pa.array(prints, pa.binary()),
        "edited_fingerprint": pa.array(changed_prints, pa.binary()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(prints, changed_prints)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(prints, next_prints)], pa.float64()),
    }


def _edge(part: int, role: str, row: tuple) -> pa.RecordBatch:
    id_, text, print_ = row
    values = {"part": [part], "role": [role], "text": [text], "id": [id_], "n_chars": [len(text)], "fingerprint": [print_]}
    binary = dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), pa.binary())
    kinds = binary | {"part": pa.int32(), "id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    names = ["part", "role", "text", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.record_batch([pa.array(values.get(n, [None]), kinds.get(n, pa.string())) for n in names], names)


def _ordered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results within a partition in order; its first and last row are put out as edges."""
    held, part = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
        prints = fingerprints(texts)
        rows = list(zip(ids, texts, prints))
        if held is None:
            part = batch.column(0)[0].as_py()
            yield _edge(part, "first", rows[0])
        else:
            rows = [held, *rows]
        held = rows[-1]
        if len(rows) > 1:
            now, after = rows[:-1], rows[1:]
            columns = _results(*map(list, zip(*now)), [r[1] for r in after], [r[2] for r in after])
            n = len(now)
            yield pa.record_batch(
                [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *columns.values()],
                ["part", "role", "text", *columns],
            )
    if held is not None:
        yield _edge(part, "last", held)


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, texts, prints, following, next_prints = (c.to_pylist() for c in batch.columns)
            columns = _results(ids, texts, prints, following, next_prints)
            yield pa.record_batch(list(columns.values()), list(columns))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    Rows are range-partitioned by falling id, so a text moves once.  Inside a partition
    the next row is at hand; the first and last rows of the partitions, a handful beside
    the table, are joined across the borders, the last of all with the first of all.
    """
    ready(docs.sparkSession)
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(order[0])
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "id", "text")
    )
    done = stored(ordered.mapInArrow(_ordered_rows, _FULL))
    first = done.filter("role = 'first'")
    # one row a partition: which partition with rows comes after it
    steps = first.select(
        "part",
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("next"),
    )
    edges = (
        done.filter("role = 'last'")
        .select("part", "id", "text", "fingerprint")
        .join(steps, "part")
        .join(first.select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print")), "next")
        .select("id", "text", "fingerprint", "following", "next_print")
        .mapInArrow(_edge_rows, _RESULT)
    )
    rows = done.filter("role IS NULL").drop("part", "role", "text").union(edges)
    # stored as bytes, shown in hex
    return rows.select(
        *[F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in rows.dtypes]
    )
