"""Substring deduplication with difference-cover anchors.

A window of ``window`` words is removed from a document when the same words also start
in a document with a smaller id.  Hashing every window would shuffle a row per word.
Instead only the positions of a difference cover modulo ``PERIOD`` are hashed, with
anchors of ``window - PERIOD + 1`` words: for any two positions some shift below the
period moves both onto the cover, so two equal windows always share an aligned anchor.

1. anchors that lie in two documents or more are found by one shuffle of anchor rows;
2. each shared anchor is extended to all windows around it, and for each such window
   (128-bit hash) the smallest document id is found;
3. the windows that have a smaller id elsewhere are cut out of the text.

A task first compares the documents of its own batch.  What it can decide there needs no
partner elsewhere, so only one row of a passage leaves a batch under the passage's own
key, however many documents share it; the other rows are spread by a salt.

Defined results.  Null and empty texts have no words and stay as they are (null becomes
empty).  Rows that share an id are one document: neither removes words from the other.
A null id counts as larger than all others.  Empty tables give empty results.  Other
columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WordHashes, by_place, ready, rolled, stored, texts

#: A difference cover: every residue of the period is a difference of two of these.
PERIOD = 7
COVER = (0, 1, 3)
WINDOW = 13

NO_ID = np.iinfo(np.int64).max


def _batch(batch: pa.RecordBatch, known: WordHashes, text_at: int = 1):
    """The documents of a batch, ids in its first column: (row, id, words, hash lanes)."""
    ids = batch.column(0).to_pylist()
    for i, text in enumerate(texts(batch.column(text_at))):
        words = text.split()
        yield i, ids[i], words, known.lanes(words)


def _cover(n: int) -> np.ndarray:
    places = np.arange(n)
    return places[np.isin(places % PERIOD, COVER)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run starts in rows sorted by ``keys``."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _salt(ids: np.ndarray) -> np.ndarray:
    """A nonzero salt from an id."""
    with np.errstate(over="ignore"):
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)).astype(np.int64) + 1


def _anchor_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            anchors, owners = [], []
            for _, doc, _, lanes in _batch(batch, known):
                places = _cover(len(lanes) - size + 1)
                if len(places):
                    found = np.unique(rolled(lanes[:, 0], size, places))
                    anchors.append(found)
                    owners.append(np.full(len(found), doc, np.int64))
            if not anchors:
                continue
            anchor, owner = np.concatenate(anchors), np.concatenate(owners)
            order = np.lexsort((owner, anchor))
            anchor, owner = anchor[order], owner[order]
            fresh = _runs(anchor, owner)
            anchor, owner = anchor[fresh], owner[fresh]
            first = _runs(anchor)
            group = np.cumsum(first) - 1
            many = (np.bincount(group) > 1)[group]
            salt = np.where(first, 0, _salt(owner))
            yield pa.record_batch([anchor.view(np.int64), salt, owner, many], ["anchor", "salt", "id", "many"])

    return rows


def _window_rows(window: int, text_at: int, shared_at: int):
    size = window - PERIOD + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            shared = batch.column(shared_at)
            ones, twos, owners = [], [], []
            for i, doc, words, lanes in _batch(batch, known, text_at):
                if len(words) < window:
                    continue
                places = _cover(len(words) - size + 1)
                mine = np.isin(
                    rolled(lanes[:, 0], size, places).view(np.int64), shared[i].values.to_numpy()
                )
                starts = (places[mine][:, None] - np.arange(PERIOD)).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts <= len(words) - window)])
                if len(starts):
                    ones.append(rolled(lanes[:, 0], window, starts))
                    twos.append(rolled(lanes[:, 1], window, starts))
                    owners.append(np.full(len(starts), doc, np.int64))
            if not ones:
                continue
            one, two, owner = np.concatenate(ones), np.concatenate(twos), np.concatenate(owners)
            order = np.lexsort((owner, two, one))
            one, two, owner = one[order], two[order], owner[order]
            fresh = _runs(one, two, owner)
            one, two, owner = one[fresh], two[fresh], owner[fresh]
            # rows behind the first of their window have a smaller id in this very batch
            first = _runs(one, two)
            yield pa.record_batch(
                [one.view(np.int64), two.view(np.int64), np.where(first, 0, _salt(owner)), owner, ~first],
                ["one", "two", "salt", "id", "gone"],
            )

    return rows


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:n]) > 0


def _cut_rows(window: int, text_at: int, n_columns: int, schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            gone = batch.column(n_columns)
            kept_texts, n_words, n_removed, spans = [], [], [], []
            for i, text in enumerate(texts(batch.column(text_at))):
                words = text.split()
                lost = gone[i].values.to_numpy() if gone[i].is_valid else ()
                out = np.zeros(len(words), bool)
                if len(lost) and len(words) >= window:
                    at = rolled(known.lanes(words)[:, 0], window).view(np.int64)
                    out = covered(np.flatnonzero(np.isin(at, lost)), window, len(words))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept = words if not len(edges) else [words[k] for k in np.flatnonzero(~out)]
                kept_texts.append(b" ".join(kept))
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
            columns = [batch.column(k) for k in range(n_columns)]
            columns[text_at] = pa.array(kept_texts, pa.binary()).cast(pa.string())
            columns += [
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(spans, schema.field(n_columns + 2).type),
            ]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents with repeated words cut out, the rest joined by single spaces.

    All columns are kept in order, then follow ``_n_words``, ``_n_removed`` and
    ``_removed_spans`` (word positions, end exclusive).
    """
    measures = ["_n_words", "_n_removed", "_removed_spans"]
    return _removed(docs, id_col, text_col, window).toDF(*docs.columns, *measures)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The same with the columns of ``docs`` alone, whatever their names."""
    found = _removed(docs, id_col, text_col, window)
    return found.select(*found.columns[: len(docs.columns)]).toDF(*docs.columns)


def _removed(given: DataFrame, id_name: str, text_name: str, window: int) -> DataFrame:
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    ready(given.sparkSession)
    docs, names = by_place(given)
    id_col, text_col = (names[given.columns.index(c)] for c in (id_name, text_name))
    size = window - PERIOD + 1
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID)))
    keyed = docs.withColumn("_sd_id", key)
    text_at = docs.columns.index(text_col)

    anchors = keyed.select("_sd_id", text_col).mapInArrow(_anchor_rows(size), "anchor long, salt long, id long, many boolean")
    by_anchor = Window.partitionBy("anchor", "salt")
    shared = stored(
        anchors.withColumn("lo", F.min("id").over(by_anchor))
        .withColumn("hi", F.max("id").over(by_anchor))
        .filter(F.col("many") | (F.col("lo") < F.col("hi")))
        .groupBy(F.col("id").alias("_sd_id"))
        .agg(F.collect_list("anchor").alias("_sd_anchors"))
    )
    # with all columns, as in the last join, so that both read one shuffle of the documents
    windows = (
        keyed.join(shared, "_sd_id")
        .select("_sd_id", *docs.columns, "_sd_anchors")
        .mapInArrow(
            _window_rows(window, text_at + 1, len(docs.columns) + 1),
            "one long, two long, salt long, id long, gone boolean",
        )
    )
    by_window = Window.partitionBy("one", "two", "salt")
    gone = (
        windows.withColumn("lo", F.min("id").over(by_window))
        .filter(F.col("gone") | (F.col("lo") < F.col("id")))
        .groupBy(F.col("id").alias("_sd_id"))
        .agg(F.collect_list("one").alias("_sd_gone"))
    )
    joined = keyed.join(gone, "_sd_id", "left").select(*docs.columns, "_sd_gone")
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema]
    fields += [
        T.StructField("_n_words", T.LongType()),
        T.StructField("_n_removed", T.LongType()),
        T.StructField("_removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    cut = _cut_rows(window, text_at, len(docs.columns), arrow)
    return joined.mapInArrow(cut, schema)
