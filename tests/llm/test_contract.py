"""The registered queries against their SQL, and the pipeline against plain stages."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import components, quality, substrings
from conftest import SCHEMA, document, messy_rows, prose
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from auditloom.llm import language_id, oracle, queries
from auditloom.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    found = con.sql(oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(found.columns)
    rows = found.select(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))


def test_every_operator_has_its_query():
    assert [int(n.split("_")[0][2:]) for n in queries.queries()] == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_packing", "op3_language_id", "op6_html_text", "op7_phrase_prints", "op8_warc", "op10_bpe", "op12_secret_scan"])
def test_whole_tables(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    key = got.columns[0]
    source = "pages" if key == "page_id" else "documents"
    want = spark.read.parquet(f"{FOLDER}/{source}.parquet")
    assert got.select(key).distinct().count() == want.count()


def plain_language(rows):
    """Kept rows by full dense profiles, gram by gram."""

    def profile(text):
        letters = [0 if not c.isalpha() else 1 + ord(c) % (language_id.LETTERS - 1) for c in (text or "").lower()]
        if not any(letters):
            return None
        letters = [0, *letters, 0]
        flat = np.array([x for k, x in enumerate(letters) if k == 0 or x or letters[k - 1]])
        a, b, c = flat[:-2], flat[1:-1], flat[2:]
        v = language_id._FIRST.astype(np.int64)
        return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).sum(axis=0)

    profiles = [profile(r[1]) for r in rows]
    sums = {}
    for r, p in zip(rows, profiles):
        if p is not None and r[2] is not None:
            sums[r[2]] = sums.get(r[2], 0) + np.sign(p)
    rated = []
    for r, p in zip(rows, profiles):
        if p is not None:
            cosines = {k: s @ p / np.linalg.norm(s) / np.linalg.norm(p) for k, s in sorted(sums.items())}
            best = max(cosines, key=cosines.get)
            rated.append((r, best, cosines[best]))
    bars = {}
    for r, best, score in rated:
        if r[2] == best:
            bars.setdefault(best, []).append(score)
    at = {k: sorted(v)[max(0, int(np.ceil(language_id.BAR * len(v))) - 1)] for k, v in bars.items()}
    return [(*r[:2], r[2] or best, *r[3:5]) for r, best, score in rated if score > at.get(best, 0) - 1e-9]


def test_pipeline_like_plain_stages(spark, messy):
    columns = messy.columns
    docs, plain = messy, [tuple(r) for r in messy_rows()]
    stages = dict(corpus_pipeline.STAGES)
    show = lambda rows: sorted(repr(tuple(r)[:5]) for r in rows)

    docs = stored(stages["language"](spark, docs, FOLDER))
    plain = plain_language(plain)
    assert docs.columns == columns and show(docs.collect()) == show(plain)

    docs = stored(stages["quality"](spark, docs, FOLDER))
    rated = quality([(r, r[1], r[3]) for r in plain])
    plain = [(row[0][0], left, row[0][2], row[0][3], len(left)) for row, _, _, kept, left, _ in rated if kept]
    assert docs.columns == columns and show(docs.collect()) == show(plain)

    docs = stored(stages["near_duplicates"](spark, docs, FOLDER))
    label = components([(r[0], r[1]) for r in plain if r[0] is not None], 80)
    plain = list(dict.fromkeys(r for r in plain if r[0] is None or label[r[0]] == r[0]))
    assert docs.columns == columns and show(docs.collect()) == show(plain)

    docs = stored(stages["substrings"](spark, docs, FOLDER))
    cut = substrings([(r[0], r[1]) for r in plain])
    plain = [(*r[:1], kept, *r[2:4], len(kept)) for r, (_, _, _, kept) in zip(plain, cut)]
    assert docs.columns == columns and show(docs.collect()) == show(plain)

    pieces = stages["packing"](spark, docs, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text, *_ in plain:
        full = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == doc)
        assert b"".join(x for _, x in mine) == full
    assert len({p.doc_id for p in pieces}) == len(plain)


def test_stages_keep_columns_of_any_name(spark):
    """Names that stages use inside, and names with a dot, come back with their values."""
    names = ["_sd_id", "_mh_id", "_mh_row", "_li", "_p", "_n_words", "_n_removed", "_lf_0", "_c0", "a.b", "id", "anchor"]
    schema = T.StructType([*SCHEMA.fields[:5], *[T.StructField(n, T.StringType()) for n in names]])
    rows = [(*document(k, prose(k, 90))[:5], *[f"{n} {k}" for n in names]) for k in range(12)]
    docs = spark.createDataFrame([*rows, (*document(20, prose(3, 90))[:5], *["copy"] * len(names))], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == [f.name for f in schema], name
    got = {tuple(r) for r in docs.collect()}
    assert {r[5:] for r in got} <= {r[5:] for r in rows} and len(got) >= 11


def test_language_bar(spark):
    """Random letters go, labelled rows stay."""
    rng = np.random.default_rng(3)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
    noise = []
    for k in range(60):
        letters = list(alphabets[k % 3])
        text = " ".join("".join(rng.choice(letters, rng.integers(3, 10))) for _ in range(120))
        noise.append((10**9 + k, text, None, "s", len(text)))
    docs = given.union(spark.createDataFrame(noise, given.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, FOLDER).select("doc_id").collect()}
    labelled = {r.doc_id for r in given.filter("lang IS NOT NULL AND text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert len(labelled & kept) >= 0.99 * len(labelled)
    assert sum(10**9 <= k for k in kept) <= 3


def test_pipeline_of_nothing(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.collect() == []


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
