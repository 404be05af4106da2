import random

import numpy as np
import pytest
from brute import components, shingles, substrings
from conftest import document, messy_rows, prose

from pyspark.sql import functions as F

from auditloom.llm import common, minhash, substring_dedup


def test_cover_reaches_every_shift():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    for i in range(p):
        for j in range(p):
            assert any((i + k) % p in cover and (j + k) % p in cover for k in range(p))


def test_substrings_like_brute_force(messy):
    got = substring_dedup.remove_repeats(messy)
    assert got.columns == [*messy.columns, "_n_words", "_n_removed", "_removed_spans"]
    rows = sorted((str(r.doc_id), r._n_words, r._n_removed, r.text) for r in got.collect())
    assert rows == sorted((str(i), *rest) for i, *rest in substrings([(r[0], r[1]) for r in messy_rows()]))


def test_spans_are_what_is_missing(messy):
    texts = {r[0]: r[1] for r in messy_rows()}
    for r in substring_dedup.remove_repeats(messy).filter("_n_removed > 0 and doc_id is not null").collect():
        gone = {k for s in r._removed_spans for k in range(s.start, s.end)}
        words = texts[r.doc_id].split()
        assert r.text == " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("window", [8, 13, 20])
def test_other_windows(spark, window):
    rows = [document(k, prose(k % 4, 90)[: 200 + 37 * k] + prose(k, 20)) for k in range(12)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, messy_schema()), window=window)
    want = substrings([(r[0], r[1]) for r in rows], window)
    assert sorted((r.doc_id, r._n_removed) for r in got.collect()) == sorted((i, n) for i, _, n, _ in want)


def messy_schema():
    from conftest import SCHEMA

    return SCHEMA


def test_window_must_exceed_period(messy):
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(messy, window=7)


def test_empty_tables(none):
    assert substring_dedup.remove_repeats(none).collect() == []
    assert minhash.groups(none).collect() == []
    assert minhash.keep_one(none).collect() == []


def test_groups_like_brute_force(messy):
    rows = {r[0]: r[1] for r in messy_rows() if r[0] is not None}
    want = components(rows.items(), 80)
    got = minhash.groups(messy)
    for r in got.collect():
        if r.id is not None:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.id], want[r.id] == r.id, len(shingles(rows[r.id])))
        else:
            assert r.component_id is None and r.kept


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_chain_and_star_of_near_copies(spark, monkeypatch, block):
    """A drifting chain joins far ends; members apart from the pivot still find each other."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    words = prose(99, 200).split()
    rows, text = [], list(words)
    for k in range(30):
        rows.append((k, " ".join(text)))
        text[6 * k] = f"drift{k}"
    rows += [(100 + k, " ".join([*words[:100], *prose(500 + k, 100).split()])) for k in range(20)]
    want = components(rows, 85)
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), threshold_pct=85)
    assert {r.id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_a_large_group_around_the_threshold(spark, monkeypatch, block):
    """Copies of one text with edits of their own: some pairs link, some just do not."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, base = random.Random(12), prose(77, 160).split()
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 4])):
            words[at] = f"edit{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    want = components(rows, 85)
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), threshold_pct=85)
    assert {r.id: r.component_id for r in got.collect()} == want
    assert 1 < len(set(want.values())) < 90


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n, dtype=np.uint64)) for n in (5000, 1, 300, 6000)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets[:2]]
    assert minhash._common(sets[:2], sets[1:]).tolist() == want


def test_one_of_each_group_stays(messy):
    kept = minhash.keep_one(messy)
    assert kept.columns == messy.columns
    want = components([(r[0], r[1]) for r in messy_rows() if r[0] is not None], 80)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in want.items() if i == c)
    assert ids.count(None) == 1


def test_unrelated_texts_of_one_id_or_none_stay_apart(spark):
    base = prose(70, 120)
    near = base.replace(base.split()[60], "changed")
    texts = [prose(71 + k, 100) for k in range(5)]
    rows = [
        (1, base), (None, near), (None, texts[0]), (None, texts[1]), (None, texts[1]),  # near an id, and apart
        (2, texts[2]), (2, texts[3]), (3, texts[3].upper()), (3, texts[4]),  # ids of two texts
        (None, None), (None, None), (None, " "), (4, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.row, r.id, r.component_id, r.kept) for r in minhash.groups(df).collect()}
    assert sorted((str(i), str(c), k) for _, i, c, k in got) == sorted(
        [("1", "1", True), ("None", "1", False), ("None", "None", True), ("None", "None", True),
         ("2", "2", True), ("2", "2", True), ("3", "2", False), ("3", "3", True),
         ("None", "None", True), ("None", "None", True), ("4", "4", True)]
    )
    kept = sorted(map(repr, map(tuple, minhash.keep_one(df).collect())))
    assert kept == sorted(map(repr, [(1, base), (None, texts[0]), (None, texts[1]), (2, texts[2]), (2, texts[3]),
                                     (3, texts[4]), (None, None), (None, None), (None, " "), (4, "")]))


def test_near_texts_of_one_id_leave_one(spark):
    base = prose(70, 120)
    rows = [(i, base.replace(base.split()[60], f"changed{k}")) for i in (None, 5) for k in range(3)]
    for i in (None, 5):
        df = spark.createDataFrame([r for r in rows if r[0] == i], "doc_id long, text string")
        assert minhash.keep_one(df).count() == 1


def test_classes_of_one_half_digest_stay_apart(spark):
    rows = [(1, 5), (1, 6), (1, 7), (2, 5), (3, -1)]
    got = {(r.one, r.two): r.node for r in minhash.with_nodes(spark.createDataFrame(rows, "one long, two long")).collect()}
    assert len(got) == len(set(got.values())) == 5
    assert (got[1, 5], got[2, 5], got[3, -1]) == (1, 2, 3)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_keys(spark, how):
    """A key with a third of all rows meets its partner in many tasks; the rows are those of a plain join."""
    big = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id % 701) as k", "id")
    small = spark.range(0, 650).selectExpr("id as k", "id * 7 as v")
    sizes = big.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.sized_join(big, small, sizes, ["k"], F.col("id"), how)
    assert sorted(map(repr, got.select("k", "id", "v").collect())) == sorted(
        map(repr, big.join(small, "k", how).select("k", "id", "v").collect())
    )
    spots = common.sized_join(big, small, sizes, ["k"], F.col("id")).filter("k = 0").rdd.glom().map(len).collect()
    assert max(spots) < 3000


def test_copies_of_one_text_and_rows_without_words(spark):
    """Hundreds of copies, and of rows without words, among others: one class, one kept."""
    base, other = prose(60, 80), prose(61, 80)
    rows = [(k, base if k % 3 else other) for k in range(900)] + [(None, base)] * 300 + [(2000 + k, " ") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.groups(df).collect()
    assert len(got) == 1500
    assert sorted(r.id for r in got if r.kept and r.n_shingles) == [0, 1]
    assert all(r.component_id == (1 if r.id is None or r.id % 3 else 0) for r in got if r.n_shingles)
    assert all(r.kept and r.component_id == r.id for r in got if not r.n_shingles)


def test_looks_follow_the_posterior():
    for n, m in minhash.least_matches(85):
        # by numeric integration of the posterior density
        t = (np.arange(200_000) + 0.5) / 200_000
        def tail(k):
            density = t**k * (1 - t) ** (n - k)
            return density[t >= 0.85].sum() / density.sum()
        assert tail(m) >= minhash.MISS * 0.99 and (m == 0 or tail(m - 1) < minhash.MISS * 1.01)
