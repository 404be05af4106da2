"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A three-letter gram is bound by multiplying
its letters' vectors, each permuted by its place in the gram.  A document's profile is the
sum of its grams' vectors; a language's prototype is the sum of the signs of its training
documents' profiles, whole numbers, so that the order of the rows changes nothing.  The
language with the largest cosine to the document is predicted, and that cosine is the score.

Training uses at most about ``SAMPLE`` rows of each language, chosen by a hash, so what
each task and the driver hold depends on the number of languages alone.

Defined results.  A null text, or one without letters, is ``und`` with score 0, as is
every text when nothing was learned; training rows with null labels or without letters
teach nothing.  Ties go to the first label in alphabetical order.  Repeated rows get the
same answer.  Very long texts are read whole, in bounded memory beside the text.
Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, ready, stored

#: Length of the vectors; letters with a vector of their own (others share them by code).
DIMENSIONS = 1024
LETTERS = 128
GRAM = 3
#: The bound on training rows for each language, and on the number of languages.
SAMPLE = 5000
MAX_LANGUAGES = 1000
#: Share of a language's labelled documents that may lie under its bar.
BAR = 0.005
#: Characters turned into grams at once.
STRETCH = 1 << 18

_rng = np.random.default_rng(20240301)
_FIRST = _rng.choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
#: The vectors as they are permuted (rotated) for each place in a gram.
_PLACES = [np.roll(_FIRST, GRAM - 1 - k, axis=1) for k in range(GRAM)]


def _letter_table() -> np.ndarray:
    """Code point of the Basic Multilingual Plane -> letter number; 0 is any gap."""
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        if chr(code).isalpha():
            table[code] = 1 + code % (LETTERS - 1)
    return table


_TABLE = _letter_table()


def _codes(text: str) -> tuple[np.ndarray, bool]:
    """Gram numbers of a text, and whether it has a letter.  Gaps are single."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _TABLE[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letters[high] = [1 + p % (LETTERS - 1) if chr(p).isalpha() else 0 for p in points[high]]
    if not letters.any():
        return np.zeros(0, np.int32), False
    padded = np.concatenate(([0], letters, [0])).astype(np.int32)
    padded = padded[np.concatenate(([True], (padded[1:] != 0) | (padded[:-1] != 0)))]
    return (padded[:-2] * LETTERS + padded[1:-1]) * LETTERS + padded[2:], True


def _bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of gram numbers."""
    return _PLACES[0][codes // LETTERS**2] * _PLACES[1][codes // LETTERS % LETTERS] * _PLACES[2][codes % LETTERS]


class Profiler:
    """Profiles of texts, with work space that is used again."""

    def __init__(self):
        self.number = np.zeros(LETTERS**GRAM, np.int32)

    def profiles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(profiles as float rows, which texts have letters)."""
        out, some = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
        waiting, size = [], 0
        for k, text in enumerate(texts):
            codes, some[k] = _codes(text or "")
            for at in range(0, len(codes), STRETCH):
                part = codes[at : at + STRETCH]
                waiting.append((k, part))
                size += len(part)
                if size >= STRETCH:
                    self._add(out, waiting)
                    waiting, size = [], 0
        self._add(out, waiting)
        return out, some

    def _add(self, out: np.ndarray, waiting: list[tuple[int, np.ndarray]]) -> None:
        if not waiting:
            return
        flat = np.concatenate([codes for _, codes in waiting])
        self.number[flat] = 1
        grams = np.flatnonzero(self.number)
        self.number[grams] = np.arange(len(grams))
        local = self.number[flat] + np.repeat(np.arange(len(waiting)), [len(c) for _, c in waiting]) * len(grams)
        self.number[grams] = 0
        counts = np.bincount(local, minlength=len(waiting) * len(grams)).reshape(len(waiting), -1).astype(np.float32)
        for at in range(0, len(grams), 4096):
            some = slice(at, at + 4096)
            part = counts[:, some] @ _bound(grams[some]).astype(np.float32)
            np.add.at(out, [k for k, _ in waiting], part)


def _sign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, dimension, total) of a task's documents."""
    profiler, totals = Profiler(), {}
    for batch in batches:
        profiles, some = profiler.profiles(batch.column(1).to_pylist())
        signs = np.sign(profiles).astype(np.int64)
        for k, lang in enumerate(batch.column(0).to_pylist()):
            if some[k]:
                totals[lang] = totals.get(lang, 0) + signs[k]
    for lang, total in totals.items():
        yield pa.record_batch(
            [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)],
            ["lang", "dimension", "total"],
        )


def train(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE
) -> tuple[list[str], np.ndarray]:
    """(languages, one prototype row each) from labelled rows.

    Of more than ``MAX_LANGUAGES`` labels the most frequent are learned, ties by name.
    """
    ready(rows.sparkSession)
    labelled = rows.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(13), F.col(id_col)).alias("spot")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return [], np.zeros((0, DIMENSIONS))
    # a share of the hash's range for each language, all of it below the bound
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    limit = (share[F.col("lang")] * float(2**62)).cast("long")
    chosen = labelled.filter(F.shiftrightunsigned("spot", 2) <= limit).select("lang", "text")
    sums = (
        chosen.mapInArrow(_sign_rows, "lang string, dimension int, total long")
        .groupBy("lang", "dimension")
        .agg(F.sum("total").alias("total"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("dimension", "total"))).alias("sums"))
        .orderBy("lang")
        .collect()
    )
    prototypes = np.array([[x["total"] for x in r["sums"]] for r in sums], np.float64).reshape(-1, DIMENSIONS)
    return [r["lang"] for r in sums], prototypes


def predictor(languages: list[str], prototypes: np.ndarray):
    """A column function: text -> struct<lang, score>."""
    norms = np.linalg.norm(prototypes, axis=1) if len(languages) else np.zeros(0)
    unit = prototypes / np.maximum(norms, 1e-12)[:, None] if len(languages) else prototypes

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiler = Profiler()
        for batch in batches:
            profiles, some = profiler.profiles(batch.tolist())
            best, score = np.zeros(len(batch), int), np.zeros(len(batch))
            if languages:
                cosines = (profiles @ unit.T) / np.maximum(np.linalg.norm(profiles, axis=1), 1e-12)[:, None]
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(batch)), best], 0, 1)
            known = some & bool(languages)
            yield pd.DataFrame(
                {"lang": [languages[b] if k else "und" for b, k in zip(best, known)], "score": np.where(known, score, 0.0)}
            )

    return predicted


def above_bar(docs: DataFrame, learned: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose score is not under their language's bar; same columns, labels filled in.

    The bar is the ``BAR`` quantile of the scores of the labelled documents that are
    predicted as labelled, over all of them (their lowest score, where they are few).
    Texts without letters go.  A language of which no labelled document is found again
    has no bar.
    """
    plain, names = by_place(docs)
    text, lang = (names[docs.columns.index(c)] for c in (text_col, lang_col))
    rated = stored(plain.withColumn("_p", predictor(*learned)(text)))
    own = rated.filter(F.col(lang) == F.col("_p.lang"))
    bars = own.groupBy("_p.lang").agg(F.percentile_approx("_p.score", BAR, 10_000).alias("bar")).collect()
    bar = F.lit(0.0)
    for row in bars:  # a row a language
        bar = F.when(F.col("_p.lang") == row["lang"], row["bar"]).otherwise(bar)
    kept = rated.filter((F.col("_p.lang") != "und") & (F.col("_p.score") >= bar))
    filled = [F.coalesce(F.col(c), F.col("_p.lang")) if c == lang else F.col(c) for c in names]
    return kept.select(*[c.alias(n) for c, n in zip(filled, names)]).toDF(*docs.columns)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document belongs to the fold that is not learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
