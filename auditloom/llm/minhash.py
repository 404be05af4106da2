"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Documents of equal word sequence form a class; only one member of a class goes on.
Signatures of ``HASHES`` minima are cut into bands, and documents that share a band are
candidates.  A candidate pair is compared one batch of minima after the other; after each
the posterior of "similarity at least the threshold" (uniform prior) decides: below
``MISS`` the pair is dropped.  What survives all batches is verified on full shingle sets.

No group is expanded into all its pairs:

1. every band bucket compares its members with one pivot, the smallest id;
2. verified links give components;
3. only where a bucket still holds several components are members of different
   components compared, in blocks of bounded size inside tasks: the Bayesian test finds
   the members worth a closer look, and with their full sets every pair of these is
   verified.  A task puts out no more links than connect its components.

So any two candidates end up in one component or are tested.  A true pair is missed with
the probability that no band agrees, (1 - t^4)^16 < 1e-5 at a similarity t of 0.85, plus
``MISS`` for each batch.

Defined results.  A null or wordless text has an empty set and is linked with nothing.
Repeated rows get the same answer.  Rows that share an id, or have none, are grouped each
by its own text: links run between classes, and ids only name a component.  Its smallest
id leads it, and of several texts of that id the one of smallest hash.  A null id ranks
behind all others and is returned as null.  Empty tables give empty results; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LEAST_PIECE, WordHashes, by_place, ready, rolled, sized_join, stored, texts

SHINGLE = 5
#: Minima in a signature; the first BANDS * ROWS of them are cut into bands.
HASHES = 128
BANDS, ROWS = 16, 4
#: Minima compared between two looks at the posterior, and the chosen miss probability.
BATCH = 16
MISS = 1e-6
#: Least similarity in per cent.
THRESHOLD_PCT = 80
#: Members of a block in the block comparison.
BLOCK = 1024

NO_ID = np.iinfo(np.int64).max

_rng = np.random.default_rng(20240229)
_MASKS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a short text is one shingle."""
    words = text.lower().split()  # bytes: lower() changes A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(known.lanes(words)[:, 0], min(SHINGLE, len(words))) ^ np.uint64(min(SHINGLE, len(words))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each nonempty set."""
    if not sets:
        return np.zeros((0, HASHES), np.uint32)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            mixed = ((flat ^ _MASKS[k]) * _FACTORS[k]) >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(mixed, starts).astype(np.uint32)
    return out


def least_matches(threshold_pct: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(minima compared, least number that must agree) at each look.

    With m of n agreeing and a uniform prior, the posterior probability of a similarity
    of at least t is that of at most m successes in n + 1 trials of chance t.
    """
    t, looks = threshold_pct / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        looks.append((n, m))
    return looks


def passes(left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows survive all looks."""
    alive, agreed, seen = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in looks:
        agreed = agreed + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
        keep = agreed >= least
        alive, agreed, seen = alive[keep], agreed[keep], n
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        n, one, two, full = [], [], [], []
        for text in texts(batch.column(1)):
            found = shingles(text, known)
            digest = xxhash.xxh3_128_digest(b" ".join(text.lower().split()))
            n.append(len(found)), one.append(digest[:8]), two.append(digest[8:])
            if len(found):
                full.append(found)
        minima = iter(signatures(full))
        packed = [next(minima).tobytes() if k else b"" for k in n]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.frombuffer(b"".join(one), np.int64)),
                pa.array(np.frombuffer(b"".join(two), np.int64)),
                pa.array(packed, pa.binary()),
                batch.column(2),
            ],
            ["id", "n_shingles", "one", "two", "signature", "row"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        minima, ids = _matrix(batch.column(1)).astype(np.uint64), batch.column(0).to_numpy()
        for k in range(BANDS):
            keys = rolled(minima[:, k * ROWS : (k + 1) * ROWS].T, ROWS)[0]
            with np.errstate(over="ignore"):
                keys = (keys ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            bands = pa.array(np.full(len(ids), k, np.int32))
            yield pa.record_batch([keys.view(np.int64), bands, ids], ["bucket", "band", "id"])


def _tested(threshold_pct: int):
    looks = least_matches(threshold_pct)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = passes(_matrix(batch.column(2)), _matrix(batch.column(3)), looks)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, last, packed = WordHashes(), None, b""
    for batch in batches:
        out = []
        for text in texts(batch.column(2)):
            if text != last:
                last, packed = text, shingles(text, known).tobytes()
            out.append(packed)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["a", "b", "set"])


def _verified_rows(threshold_pct: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, mine = WordHashes(), None, None
        for batch in batches:
            keep = []
            for packed, text in zip(batch.column(2).to_pylist(), texts(batch.column(3)), strict=True):
                if text != last:
                    last, mine = text, shingles(text, known)
                other = np.frombuffer(packed, np.uint64)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * common >= threshold_pct * (len(mine) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def verify(pairs: DataFrame, docs: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  docs: (id, text)."""
    first = sized_join(pairs, docs.withColumnRenamed("id", "a"), _sizes(pairs, "a"), ["a"], F.col("b"))
    first = first.select("a", "b", "text")
    sets = first.mapInArrow(_set_rows, "a long, b long, set binary")
    both = sets.join(docs.withColumnRenamed("id", "b"), "b").select("a", "b", "set", "text")
    return both.mapInArrow(_verified_rows(threshold_pct), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the links reach, for every id with a link.

    Labels move along the links and then jump to their labels' labels, so a chain of n
    links takes about log n rounds.  Each round is stored; only counts reach the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = stored(_sizes(both, "b").filter(F.col("n") > LEAST_PIECE))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = (
            sized_join(both, labels.withColumnRenamed("id", "b"), degrees, ["b"], F.col("a"))
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        moved = stored(labels.join(near, "id").select("id", "component", F.least("component", "near").alias("to")))
        ahead = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        after = stored(
            sized_join(moved, ahead, _sizes(moved, "to"), ["to"], F.col("id"), "left").select(
                "id", F.coalesce("next", "to").alias("component"), (F.coalesce("next", "to") != F.col("component")).alias("changed")
            )
        )
        labels = after.select("id", "component")
        if after.filter("changed").isEmpty():
            return labels


def _met_before(left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of signature rows share a band before this one, so met there already."""
    same = (left[:, : band * ROWS] == right[:, : band * ROWS]).reshape(len(left), band, ROWS)
    return same.all(axis=2).any(axis=1)


def _candidate_members(threshold_pct: int):
    """The members of a block with a partner in another component that passes the test."""
    looks = least_matches(threshold_pct)

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        few, all_ = frame[frame.few], frame[~frame.few]
        x, y = (np.frombuffer(b"".join(f.signature), np.uint32).reshape(-1, HASHES) for f in (few, all_))
        apart = few.component.to_numpy()[:, None] != all_.component.to_numpy()[None, :]
        agreed = np.zeros(apart.shape, np.int16)
        for k in range(BATCH):
            agreed += x[:, k][:, None] == y[:, k][None, :]
        i, j = np.nonzero(apart & (agreed >= looks[0][1]))
        chosen = np.zeros(len(few), bool), np.zeros(len(all_), bool)
        for at in range(0, len(i), 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            keep = passes(x[a], y[b], looks)
            a, b = a[keep], b[keep]
            keep = ~_met_before(x[a], y[b], int(frame.band.iloc[0]))
            chosen[0][a[keep]] = chosen[1][b[keep]] = True
        return pd.concat([few[chosen[0]], all_[chosen[1]]])[["bucket", "x", "y", "few", "id", "component"]]

    return rows


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    known, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(v) for v in (*left, *right)])
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(known), 4096):
        part = slice(*np.searchsorted(codes, (at, at + 4096)))
        held = np.zeros((len(left) + len(right), 4096), np.float32)
        held[owner[part], codes[part] - at] = 1
        out += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def _block_links(threshold_pct: int):
    """Verified links between the components of a block, as few as connect them."""

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        few, all_ = frame[frame.few], frame[~frame.few]
        links: list[tuple[int, int]] = []
        if len(few) and len(all_):
            x, y = ([np.frombuffer(v, np.uint64) for v in f["set"]] for f in (few, all_))
            common = _common(x, y)
            sizes = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :]
            alike = 100 * common >= threshold_pct * (sizes - common)
            left, right = few.component.to_numpy(), all_.component.to_numpy()
            alike &= left[:, None] != right[None, :]
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = c = root.get(up, up)
                return c

            a, b = few.id.to_numpy(), all_.id.to_numpy()
            for i, j in np.argwhere(alike):
                u, v = find(int(left[i])), find(int(right[j]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    links.append((min(a[i], b[j]), max(a[i], b[j])))
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows


def _one_set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sets = [shingles(text, known).tobytes() for text in texts(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])


def across(
    buckets: DataFrame, marked: DataFrame, docs_of: Callable[[DataFrame], DataFrame], threshold_pct: int
) -> DataFrame:
    """Verified links within a bucket between different components.

    ``buckets``: (bucket, band, id); ``marked``: (id, signature, component); ``docs_of``:
    from (id) to (id, text).  A bucket's members outside its first component form blocks, and each of
    these meets the bucket's members in parts, so a task holds two blocks whatever the
    size of the bucket.  The first pass compares signatures and puts out the members
    worth a closer look, each once a block; the second has their full sets and puts out
    no more links than connect the block's components.
    """
    members = buckets.join(marked.select("id", "component"), "id")
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("component").alias("main"), F.max("component").alias("other"), F.count(F.lit(1)).alias("n"))
        .filter("main < other")
    )
    mixed = stored(mixed)
    inside = stored(sized_join(members, mixed, mixed.select("bucket", "n"), ["bucket"], F.col("id")))
    outside = inside.filter("component <> main").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_few"))
    parts = stored(sized_join(inside, outside, mixed.select("bucket", "n"), ["bucket"], F.col("id")))
    n_few = F.ceil(F.col("n_few") / BLOCK).cast("int")
    n_all = F.ceil(F.col("n") / BLOCK).cast("int")
    spot = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = parts.filter("component <> main").select(
        "id", "bucket", "band", F.pmod(spot, n_few).cast("int").alias("x"), every(n_all).alias("y"), F.lit(True).alias("few")
    )
    all_ = parts.select(
        "id", "bucket", "band", every(n_few).alias("x"), F.pmod(spot, n_all).cast("int").alias("y"), F.lit(False).alias("few")
    )
    # the work in a block is not told by its bytes, so the blocks are not put together
    n_parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["bucket", "x", "y"]
    picked = stored(
        few.union(all_)
        .join(marked, "id")
        .repartition(n_parts, *block)
        .groupBy(*block)
        .applyInPandas(
            _candidate_members(threshold_pct), "bucket long, x int, y int, few boolean, id long, component long"
        )
    )
    sets = docs_of(picked.select("id").distinct()).mapInArrow(_one_set_rows, "id long, set binary")
    return (
        picked.join(sets, "id")
        .repartition(n_parts, *block)
        .groupBy(*block)
        .applyInPandas(_block_links(threshold_pct), "a long, b long")
        .distinct()
    )


def with_nodes(classes: DataFrame) -> DataFrame:
    """Classes (one, two, ...) with ``node``, the key of a class in links and components.

    It is the first half of the class's digest.  Of classes that share this half, all but
    the one of the smallest second half take a hash of both halves.
    """
    twins = stored(
        classes.groupBy("one")
        .agg(F.min("two").alias("least"), F.max("two").alias("most"))
        .filter("least < most")
        .select("one", "least")
    )
    node = F.when(F.col("two") > F.col("least"), F.xxhash64("one", "two")).otherwise(F.col("one"))
    return classes.join(twins, "one", "left").withColumn("node", node).drop("least")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = THRESHOLD_PCT
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept,
    and row, a hash of its text."""
    ready(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("row"),
    )
    sketches = stored(
        rows.mapInArrow(
            _sketch_rows, "id long, n_shingles long, one long, two long, signature binary, row long"
        )
    )
    # a class: documents of one word sequence; copies meet only after each task has reduced its own
    classes = with_nodes(
        stored(
            sketches.filter("n_shingles > 0")
            .groupBy("one", "two")
            .agg(F.min(F.struct("id", "row", "signature")).alias("head"), F.count(F.lit(1)).alias("n"))
            .select("one", "two", "n", F.col("head.id").alias("first"), F.col("head.row").alias("first_row"), "head.signature")
        )
    )
    chosen = classes.select(F.col("node").alias("id"), "signature")

    def docs_of(nodes: DataFrame) -> DataFrame:
        """One text for each class of these keys."""
        heads = classes.join(nodes.select(F.col("id").alias("node")), "node").select(
            "node", F.col("first").alias("id"), F.col("first_row").alias("row")
        )
        return stored(
            rows.join(heads, ["id", "row"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"])
        )

    buckets = chosen.select("id", "signature").mapInArrow(_band_rows, "bucket long, band int, id long").distinct()
    pivots = stored(
        buckets.groupBy("bucket")
        .agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("a < last")
        .select("bucket", "a", "n")
    )
    shared = stored(
        sized_join(buckets, pivots.select("bucket", "a"), pivots.select("bucket", "n"), ["bucket"], F.col("id"))
    )

    pairs = stored(shared.filter("a < id").select("a", F.col("id").alias("b")).distinct())
    sided = lambda c: chosen.select(F.col("id").alias(c), F.col("signature").alias(f"signature_{c}"))
    survivors = stored(
        sized_join(pairs.join(sided("b"), "b"), sided("a"), _sizes(pairs, "a"), ["a"], F.col("b"))
        .select("a", "b", "signature_a", "signature_b")
        .mapInArrow(_tested(threshold_pct), "a long, b long")
    )
    met = survivors.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = stored(verify(survivors, docs_of(met), threshold_pct))

    def with_component(found: DataFrame) -> DataFrame:
        return (
            chosen.join(found, "id", "left")
            .withColumn("component", F.coalesce("component", "id"))
        )

    reached = components(links)
    more = stored(across(shared.select("bucket", "band", "id"), with_component(reached), docs_of, threshold_pct))
    if not more.isEmpty():
        reached = components(links.union(more))

    head = F.struct(F.col("first").alias("id"), "one", "two", F.col("first_row").alias("row")).alias("head")
    linked = stored(
        classes.join(reached.withColumnRenamed("id", "node"), "node").select("one", "two", "component", head)
    )
    leads = linked.groupBy("component").agg(F.min("head").alias("lead"))
    led = sized_join(
        linked.select("one", "two", "component"), leads, _sizes(linked, "component"), ["component"], F.col("one")
    )
    named = classes.select("one", "two", head).join(led, ["one", "two"], "left").select(
        "one", "two", F.coalesce("lead", "head").alias("lead")
    )
    # rows are told apart by their place: copies may also share their id
    rows_of = sketches.select("id", "n_shingles", "one", "two", "row")
    labelled = sized_join(
        rows_of.filter("n_shingles > 0").withColumn("place", F.monotonically_increasing_id()),
        named, classes.select("one", "two", "n"), ["one", "two"], F.col("place"),
    ).select(*rows_of.columns, "lead")
    labelled = labelled.unionByName(rows_of.filter("n_shingles = 0"), allowMissingColumns=True)
    top = F.lit(int(NO_ID))
    wordy = F.col("n_shingles") > 0
    component = F.when(wordy, F.col("lead.id")).otherwise(F.col("id"))
    shown = lambda c: F.when(c < top, c)
    return labelled.select(
        shown(F.col("id")).alias("id"),
        "n_shingles",
        shown(component).alias("component_id"),
        F.when(wordy, F.col("lead") == F.struct("id", "one", "two", "row")).otherwise(F.lit(True)).alias("kept"),
        "row",
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = THRESHOLD_PCT
) -> DataFrame:
    """The documents of which each group's smallest id stays; same columns.

    Equal rows of a kept id leave one; its rows of another text are documents of their own.
    Rows with neither id nor words are linked with nothing and all stay.
    """
    plain, names = by_place(docs)
    id_at, text_at = (names[docs.columns.index(c)] for c in (id_col, text_col))
    bare = F.col(id_at).isNull() & ~F.coalesce(F.col(text_at), F.lit("")).rlike(BLANKS.replace("[", "[^"))
    kept = (
        groups(plain, id_at, text_at, threshold_pct)
        .filter("kept")
        .select(F.coalesce("id", F.lit(int(NO_ID))).alias("_mh_id"), F.col("row").alias("_mh_row"))
        .distinct()
    )
    keyed = plain.filter(~bare).withColumn("_mh_id", F.coalesce(F.col(id_at).cast("long"), F.lit(int(NO_ID)))).withColumn(
        "_mh_row", F.xxhash64(text_at)
    )
    keys = ["_mh_id", "_mh_row"]
    one_each = keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*names)
    return one_each.union(plain.filter(bare)).toDF(*docs.columns)
