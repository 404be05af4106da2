import hashlib
import random
import struct
import time

import pytest
import zstandard
from conftest import SCHEMA, document, messy_rows, prose

from auditloom.llm import phrase_prints, warc
from auditloom.llm.common import stored
from auditloom.llm.html_text import extract, visible_text

CASES = {
    "<p>a<p>b <b>c</b>\n d<div>e</div>f": "a\n\nb c d\n\ne\nf",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>end": "- one\n- two\n  3. x\n  4. y\n- three\n\nend",
    "<ul><li><p>para</p><p>more</p></li></ul>": "- para\n\n  more",
    "<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>both wide</table>after": "Cap\nName   Qty\napple  3\nboth wide\n\nafter",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><td>x<td>y</table>": "x  y",
    "<table><tr><td>a<table><tr><td>n1<td>n2</table><td>b</table>": "a       b\nn1  n2",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd",
    "x<script>var a='</p>';</script>y<style>p{}</style><!-- c -->z": "xyz",
    "<div hidden>no</div><div style='x:y; DISPLAY: none'>no</div>yes": "yes",
    "<span style='visibility:hidden'>no<b style='visibility:visible'>yes</b></span>": "yes",
    "<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<html><head><title>T</title></head><body>x</body></html>": "x",
    "a&amp;b &lt;c&gt;<br>e<br><br>f": "a&b <c>\ne\n\nf",
    "<dl><dt>t<dd>d1<dd>d2</dl>": "t\n    d1\n    d2",
    "a < b </nope> c <!-- open": "a < b c",
    "<a href='x>y' title=\"a>b\">link</a> t <broken": "link t",
    "<textarea> a\n b</textarea>": " a\n b",
    "<select><option>a<option>b</select>": "a\nb",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page) == CASES[page]


STRAY_QUOTES = {
    "<p title=it's>hello</p><p>world</p>": "hello\n\nworld",
    "<p title=it's>hello</p><p>don't stop</p>": "hello\n\ndon't stop",
    '<img alt="5" tall"><p>text</p>': "text",
    '<img alt="5"" tall><p>6" wide</p>': '6" wide',
    "<p 'a>x</p 'b>y": "x\n\ny",
    '<p ="a>x</p>y"': 'x\n\ny"',
    "<p title = 'a>b' id=c\"d>x": "x",
    "<p title=>x": "x",
    '<div a=b\' style="display:none">no</div>yes': "yes",
    "<input value=it's><input value='a>b'>": "it'sa>b",
    "x<p title=\"a' >y": "x",
}


@pytest.mark.parametrize("page", STRAY_QUOTES)
def test_quotes_open_a_run_only_where_a_value_starts(page):
    assert visible_text(page) == STRAY_QUOTES[page]


OPEN_PARTS = {
    "<table><colgroup><col><col><tr><td>a</td></tr></table>": "a",
    "<table><colgroup><col><col><td>a<th>b</table>c": "a  b\n\nc",
    "<table><colgroup>\n<col>\n<template>no</template><col><tbody><tr><td>a</table>": "a",
    "<table><colgroup><col><colgroup><col><tr><td>a<td>b</table>": "a  b",
    "<table><colgroup><col><caption>Cap</caption><tr><td>a</table>": "Cap\na",
    "<table><caption>Cap <b>x</b><colgroup><col><tr><td>a<tr><td>b</table>": "Cap x\na\nb",
    "<table><caption>Cap<td>a<td>b</table>": "Cap\na  b",
    "<div><colgroup>text</div>": "text",
}


@pytest.mark.parametrize("page", OPEN_PARTS)
def test_column_groups_and_captions_left_open(page):
    assert visible_text(page) == OPEN_PARTS[page]


def test_hostile_pages():
    assert visible_text(None) is None
    assert visible_text("<div>" * 30_000 + "deep") == "deep"
    assert visible_text("<p>" + "<b>" * 3000 + "x" + "<div>" * 3000 + "y") == "x\n\ny"
    assert visible_text("<table>" * 300 + "x" + "</table>" * 400)
    rng = random.Random(4)
    parts = ["<table>", "<tr>", "<td colspan=0 rowspan=9>", "</table>", "<li>", "<ul>", "</ul>", "<p>", "x", "<", ">", "&#0;", "<pre>", "</pre>", "</td>", "<caption>", "</p>", "<dd>", "<br>"]
    for _ in range(400):
        visible_text("".join(rng.choice(parts) for _ in range(40)))


def test_every_visible_word_comes_out():
    words = [f"w{k}" for k in range(300)]
    rng = random.Random(9)
    tags = ["<p>{}</p>", "<div>{}</div>", "<li>{} ", "<td>{} </td>", "<b>{}</b> ", "<table><tr><td>{}</table>", "{}<br>"]
    page = "".join(rng.choice(tags).format(w) for w in words)
    assert visible_text(page).replace("- ", " ").split() == words


def test_html_column(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p>x", None), (3, "<p>x", None)]
    got = spark.createDataFrame(rows, "page_id long, html string, text string").select("page_id", extract("html").alias("t"))
    assert sorted((r.page_id, r.t) for r in got.collect() if r.page_id != 1) == [(2, ""), (3, "x"), (3, "x")]


PAGES = "page_id long, url string, html string, digest string, payload string, whole string, page string"


def pages(spark):
    long, other = prose(1, 300), prose(2, 400)
    rows = [(1, "http://a/ä b\r\nX: y", long), (2, None, long), (9, "http://c", long), (4, "http://d", "short"), (5, "http://e", "short"),
            (6, "http://f", None), (7, "http://g", ""), (8, "http://h", other), (None, "http://i", long), (9, "http://c", long), (10, "u", "é" * 500), (11, "u", "é" * 500),
            *[(100 + k, "u", prose(k, 80)) for k in range(40)]]
    return rows, spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGES)


def test_round_trip(spark):
    rows, df = pages(spark)
    archives = stored(warc.write_archives(df))
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    want = {}
    for page, url, html in rows:
        want.setdefault(page, (html or "").encode())
    best = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= 1000:
            best[data] = max(best.get(data, page), page)
    for r in got:
        data = want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        whole = best.get(data, r.page_id)
        if whole == r.page_id:
            assert (r.record_type, r.refers_to_page, r.payload) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to_page, r.payload) == ("revisit", whole, None)
    assert {r.url for r in got if r.page_id == 2} == {None}


def test_archive_layout(spark):
    _, df = pages(spark)
    content = bytes(warc.write_archives(df.coalesce(1)).first().content)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and size > 0
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    at = 8 + size
    end = warc.frame_end(memoryview(content), at)
    assert reader.decompress(content[at:end]).startswith(b"WARC/1.1\r\n")
    # a dictionary may itself be compressed
    packed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    again = warc.start_of_archive(packed) + content[8 + size :]
    assert len(list(warc.records(again))) == 52 and all(r["error"] is None for r in warc.records(again))


def frame(record, **options):
    return zstandard.ZstdCompressor(**options).compress(record)


def test_faults_are_told():
    good = warc.write_record(1, "http://x", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.read_record(good)["error"] is None
    for bad, why in [
        (good.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (good.replace(b"payload", b"payloae"), "digest"),
        (good[:-1], "block has"),
        (good.replace(b"WARC-Type: response", b"WARC-Type: other"), "type"),
        (good.replace(b"WARC-Date", b"WARC-Dote"), "warc-date"),
        (good.replace(b"Content-Length: 7", b"Content-Length: 8"), "payload has"),
        (good.replace(b"sha1:", b"md5x:"), "digest"),
        (good.replace(b"WARC-Target-URI: ", b"WARC-Target-URI "), "header line"),
        (b"", "record"),
    ]:
        assert why in warc.read_record(bad)["error"], bad
    one = frame(good)
    assert [r["error"] for r in warc.records(one + one)] == [None, None]
    assert warc.records(one[:-3]).__next__()["error"]
    assert "no frame" in [*warc.records(one + b"junk")][-1]["error"]
    assert list(warc.records(b"")) == []
    assert "cut off" in next(warc.records(warc.start_of_archive(b"x" * 50)[:20]))["error"]
    streamed = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compress(good)
    assert [r["error"] for r in warc.records(streamed + one)] == [None, None]


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(empty)).collect() == []


def test_phrases():
    assert phrase_prints.phrases(b"abababa") == {b"a", b"b", b"ab", b"aba"}
    assert phrase_prints.phrases(b"") == set()
    text, other = prose(1, 500), prose(2, 500)
    a, b, c, d = phrase_prints.fingerprints([text, text, text[:-20], ""])
    assert a == b and phrase_prints.likeness(a, c) > 0.8 and phrase_prints.likeness(a, d) < 0.1
    assert phrase_prints.likeness(d, phrase_prints.fingerprints([""])[0]) == 1
    # the estimate follows the true overlap
    x, y = (phrase_prints.phrases(t.encode()) for t in (text, phrase_prints.edited(text, other)))
    near = phrase_prints.likeness(*phrase_prints.fingerprints([text, phrase_prints.edited(text, other)]))
    assert abs(near - len(x & y) / len(x | y)) < 0.15


@pytest.mark.parametrize("parts", [1, 3])
def test_next_documents_like_brute_force(spark, messy, parts):
    import xxhash  # noqa: F401

    rows = [r for r in messy_rows()]
    got = phrase_prints.compare_with_next(messy.repartition(parts)).collect()
    assert len(got) == len(rows)
    unique = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    order = sorted(unique, reverse=True)
    byid = {r.id: r for r in got}
    for k, i in enumerate(order[:-1]):
        if [r[0] for r in rows].count(i) > 1:
            continue  # a repeated row's next is its copy for one of the two
        text, following = unique[i], unique[order[k + 1]]
        changed = phrase_prints.edited(text, following)
        a, b, c = phrase_prints.fingerprints([text, changed, following])
        r = byid[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.hex(), b.hex())
        assert (r.near_edited, r.near_next) == (phrase_prints.likeness(a, b), phrase_prints.likeness(a, c))
    last = byid[None]
    first = unique[order[0]]
    text = next(r[1] for r in rows if r[0] is None)
    assert last.edited_sha256 == hashlib.sha256(phrase_prints.edited(text, first).encode()).hexdigest()


def test_one_and_no_document(spark, none):
    assert phrase_prints.compare_with_next(none).collect() == []
    one = phrase_prints.compare_with_next(spark.createDataFrame([document(1, "abcdef")], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1


def grown(kind, n):
    cells = "<td colspan=1000>x</td>" * n
    return {
        "wide cells": f"<table><tr>{cells}</tr></table>",
        "rows under wide cells": "<table><tr>" + "<td rowspan=65534 colspan=9>x" * 200 + "<tr><td>y" * n + "</table>",
        "padded rows": "<table><tr>" + "<td>wide cell" * 200 + "<tr><td colspan=199><td>y" * n + "</table>",
        "nested lists": "<ul><li>x" * n,
        "nested quotes": "<blockquote>x" * n,
        "nested tables": "<table><tr><td>x" * n,
        "stray ends": "<b>" + "<table><tr><td>" + "<span>" * n + "</b>" * n,
        "open spans": "<b><span>" * n + "</b>" * n,
        "dialogs": "<p><dialog>" * n + "x",
    }[kind]


@pytest.mark.parametrize(
    "kind",
    ["wide cells", "rows under wide cells", "padded rows", "nested lists", "nested quotes", "nested tables", "stray ends", "open spans", "dialogs"],
)
def test_doubled_pages_take_twice_the_time(kind):
    def run(n):
        page, best, size = grown(kind, n), 1e9, 0
        for _ in range(3):
            start = time.process_time()
            size = len(visible_text(page))
            best = min(best, time.process_time() - start)
        return best, size

    run(100)
    (small, small_size), (large, large_size) = run(2000), run(4000)
    assert large_size <= 2.2 * small_size + 1000
    assert large <= 3 * small + 0.05
