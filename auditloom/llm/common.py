"""What the operators of this subpackage share: sessions, stored tables, words."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_dir

#: The characters that part words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = "[\\x20\\x09-\\x0D]"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in one Arrow batch: bounds what a Python task holds at once.
ARROW_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """Session settings for this subpackage."""
    prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder as Parquet and read back.

    What the write has shuffled is of no more use and is removed with its end.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, a null text having none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANKS}+"), lambda w: w != "")


def by_place(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with columns named by place, so that no name of theirs meets one of ours."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 16):
    """Inner join on ``keys`` where a key may hold much of ``big``.

    ``small`` has one row a key and is repeated once for each salt, so the rows of one
    key meet their partner in ``salts`` places.
    """
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return marked.join(salted, [*keys, "_salt"]).drop("_salt")


#: A key of at most this many rows is never cut by ``sized_join``.
LEAST_PIECE = 256
#: Bound on the number of keys that ``sized_join`` cuts, and on the pieces of all of them.
PIECES = 10_000


def sized_join(
    big: DataFrame, small: DataFrame, sizes: DataFrame, keys: list[str], spread: Column, how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` where a key may hold much of ``big``, cut by the counted size of the key.

    ``small`` has one row a key; ``sizes`` has the keys and ``n``, their rows in ``big``.  A
    piece is a ten-thousandth of the rows of all keys over ``LEAST_PIECE``, or
    ``LEAST_PIECE`` rows if that is more.  Larger keys are cut into pieces of about that
    size by ``spread``, and their row of ``small`` is repeated for each, so a key with a
    third of all rows meets its partner in thousands of places, however large the table.
    No more than ``PIECES`` keys can be larger than a piece, so their table is broadcast.
    """
    large = stored(sizes.filter(F.col("n") > LEAST_PIECE).select(*keys, "n"))
    rows = large.agg(F.sum("n")).first()[0]
    if rows is None:  # every key is smaller than a piece
        return big.join(small, keys, how)
    piece = max(LEAST_PIECE, -(-rows // PIECES))
    cut = F.broadcast(
        large.filter(F.col("n") > piece).select(*keys, F.ceil(F.col("n") / piece).cast("int").alias("_pieces"))
    )
    pieces = F.coalesce("_pieces", F.lit(1))
    marked = big.withColumn("_spread", F.xxhash64(spread)).join(cut, keys, "left")
    marked = marked.withColumn("_piece", F.pmod("_spread", pieces).cast("int")).drop("_pieces", "_spread")
    repeated = small.join(cut, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return marked.join(repeated.drop("_pieces"), [*keys, "_piece"], how).drop("_piece")


class WordHashes(dict):
    """128-bit hashes of words, remembered up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        digest = self[word] = xxhash.xxh3_128_digest(word)
        return digest

    def lanes(self, words: list[bytes]) -> np.ndarray:
        """An n x 2 array of the words' hashes."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8").reshape(-1, 2)


def rolled(hashes: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``size`` words, at all places or at ``starts``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    where = np.arange(n) if starts is None else starts
    out = np.zeros(len(where), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[where + k]
            out ^= out >> np.uint64(29)
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 texts of an Arrow column; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
