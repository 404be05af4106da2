from brute import quality
from conftest import SCHEMA, document, messy_rows, prose

from auditloom.llm import language_id, license_scan, line_frequency


def test_quality_like_brute_force(messy):
    want = quality([(r[0], r[1], r[3]) for r in messy_rows()])
    got = line_frequency.rate(messy).collect()
    rows = sorted((str(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words) for r in got)
    assert rows == sorted((str(row[0]), *m, failed, kept, gone) for row, m, failed, kept, _, gone in want)
    assert any(gone for *_, gone in want) and any(not f and not k for _, _, f, k, _, _ in want)


def test_cleaned_documents(messy):
    want = quality([(r[0], r[1], r[3]) for r in messy_rows()])
    got = line_frequency.clean(messy)
    assert got.columns == messy.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(row[0]), left) for row, _, _, kept, left, _ in want if kept)


def test_copies_do_not_make_boilerplate(spark):
    rows = [document(k, prose(1, 90) + "\n" + prose(2, 30)) for k in range(30)]
    rows += [document(50 + k, prose(50 + k, 90)) for k in range(5)]
    assert line_frequency.rate(spark.createDataFrame(rows, SCHEMA)).filter("kept").count() == 35


def test_empty_tables(none):
    assert line_frequency.rate(none).collect() == []
    assert line_frequency.clean(none).collect() == []
    assert license_scan.scan(none).collect() == []


def scanned(spark, *texts):
    rows = [document(k, t) for k, t in enumerate(texts)]
    found = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    return [r for r in sorted(found, key=lambda r: r.id)]


def test_phrases_and_templates(spark):
    mit = dict((t, k) for k, t in license_scan.TEMPLATES)
    long = next(t for t in mit if t.startswith("permission is hereby granted free"))
    words = long.split()
    broken = " ".join([*words[:6], "very", *words[6:12], *words[13:]])
    got = scanned(
        spark,
        "Made under CC-BY 4.0. All rights   RESERVED; (cc) by me",
        f"{prose(1, 40)} {long.upper()} {prose(2, 30)}",
        f"intro {broken} end",
        " ".join(words[:8]) + prose(3, 30),
        None,
        "",
        "GENERAL public license " * 3,
        "cc",
        "Licensed under the Apache License, Version 2.0.",
    )
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [
        (3, 2, 9, "cc-by,reserved"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""),
        (0, None, None, ""), (0, None, None, ""), (3, 0, 6, "gpl"), (0, None, None, ""), (0, None, None, ""),
    ]
    assert [r.labels for r in got] == ["cc-by,reserved", "mit", "mit", "", "", "", "gpl", "", "apache"]
    assert [r.score for r in got][:2] == [1.0, 1.0] and 0.6 <= got[2].score < 1 and got[3].score == 0
    assert got[4].n_words == 0 and got[0].n_words == 12


def test_repeated_rows_vote_once(spark):
    rows = [document(1, f"x {license_scan.TEMPLATES[0][1]} y")] * 3 + [document(1, "nothing here")]
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.labels, r.score) for r in got) == [("", 0.0)] + [("apache", 1.0)] * 3


def test_licenses_on_messy_rows(messy):
    assert license_scan.scan(messy).count() == len(messy_rows())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = language_id.train(docs.filter(~language_id.held_out()))
    got = docs.filter(language_id.held_out()).select("lang", language_id.predictor(*learned)("text").alias("p")).collect()
    assert len(got) > 20 and sum(r.lang == r.p.lang for r in got) >= 0.95 * len(got)
    assert all(0 <= r.p.score <= 1 for r in got)


def test_profile_is_the_sum_of_bound_grams():
    import numpy as np

    text = "Ab c! déf"
    letters = [0, *[0 if not c.isalpha() else 1 + ord(c) % (language_id.LETTERS - 1) for c in text.lower()], 0]
    flat = [x for k, x in enumerate(letters) if k == 0 or x or letters[k - 1]]
    want = sum(
        np.roll(language_id._FIRST[a], 2).astype(int) * np.roll(language_id._FIRST[b], 1) * language_id._FIRST[c]
        for a, b, c in zip(flat, flat[1:], flat[2:])
    )
    got, some = language_id.Profiler().profiles([text, None, "12 34", text * 3])
    assert (got[0] == want).all() and some.tolist() == [True, False, False, True] and not got[1:3].any()


def test_long_texts_in_stretches(monkeypatch):
    whole = language_id.Profiler().profiles([prose(5, 3000), prose(6, 10)])[0]
    monkeypatch.setattr(language_id, "STRETCH", 500)
    assert (language_id.Profiler().profiles([prose(5, 3000), prose(6, 10)])[0] == whole).all()


def test_language_edges(messy, none):
    predict = language_id.predictor(*language_id.train(messy))
    got = {r.doc_id: r.p for r in messy.select("doc_id", predict("text").alias("p")).collect()}
    assert got[1].lang == got[2].lang == got[3].lang == "und" and got[1].score == 0
    assert got[12].lang == "en"
    learned = language_id.train(none)
    assert learned[0] == []
    nothing = language_id.predictor(*learned)
    assert {r.p.lang for r in messy.select(nothing("text").alias("p")).collect()} == {"und"}
    assert none.select(predict("text").alias("p")).collect() == []
