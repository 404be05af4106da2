import random

import numpy as np
import public_tokenizers
import pytest
from conftest import messy_rows, prose
from tokenizers import Tokenizer

from auditloom.llm import bpe, packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdEIΣσςİKÅé中文😀ǅﬁ  \n\t's'T0123½²٣.,!?​\r\x00\x1c\x1f\x85\xa0   　́̈ñÑ"


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|startoftext|>", "'re", " the", "tion", "aaaaa"]
    return ["".join(rng.choice([rng.choice(ALPHABET), rng.choice(ALPHABET), rng.choice(parts)]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def words():
    return bpe.WordBpe(open(WORDS).read())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_same_ids_as_the_library(words):
    library, texts = Tokenizer.from_file(WORDS), odd_texts(1500)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = words.encode(texts)
    assert [ids(g) for g in got] == want
    assert [words.decode(g) for g in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_heap_and_leftmost_rounds_agree(words, monkeypatch):
    texts = odd_texts(300, 8)
    want = words.encode(texts)
    monkeypatch.setattr(bpe, "LONG_WORD", 3)
    assert bpe.WordBpe(open(WORDS).read()).encode(texts) == want
    monkeypatch.setattr(bpe, "LONG_WORD", 2000)
    single = bpe.WordBpe(open(WORDS).read())
    single.together = False
    assert single.encode(texts) == want


def test_very_long_word_and_forgetting(words, monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(30_000))
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert ids(words.encode([text])[0]) == want
    assert words.encode([text, None, ""])[1:] == [b"", b""]


def test_unknown_layout_is_refused():
    with pytest.raises(ValueError):
        bpe.WordBpe(open(BYTES).read())


def test_bpe_columns(messy, none):
    shared = packing.shared_file(messy, WORDS)
    library = Tokenizer.from_file(WORDS)
    rows = messy.select("doc_id", "text", bpe.encoder(shared)("text").alias("ids")).withColumn("back", bpe.decoder(shared)("ids")).collect()
    assert len(rows) == len(messy_rows())
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert ids(r.ids) == want and r.back == library.decode(want, skip_special_tokens=False)
    assert none.select(bpe.encoder(shared)("text")).collect() == []


def test_fast_ids_are_the_library_ids():
    spec = open(BYTES).read()
    tokenizer = packing.ByteTokenizer(spec)
    assert tokenizer.fast is not None
    for text in [*odd_texts(1500, 5), " " * 5000, "\n" * 3000 + "x", "a" * 5000]:
        assert tokenizer.ids(text).tolist() == tokenizer.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 60, 500])
def test_pack_covers_every_token_once(n):
    rng = random.Random(n)
    lengths = [rng.choice([1, 5, 300, 700, 1023, 1024, 1025, 5000]) for _ in range(n)]
    sequences = packing.pack(lengths, 1024)
    seen = {}
    for doc, start, length in sorted(p for s in sequences for p in s):
        assert seen.get(doc, 0) == start and length > 0
        seen[doc] = start + length
    assert [seen[d] for d in range(n)] == lengths
    fills = [sum(p[2] for p in s) for s in sequences]
    assert max(fills, default=0) <= 1024 and sum(f < 1024 for f in fills) <= 1


def test_first_bin_that_fits():
    tree = packing.FreePlaces(5, 10)
    assert [tree.take(x)[0] for x in (7, 6, 4, 3, 8, 10)] == [0, 1, 1, 0, 2, 3]


def packed_rows_are_whole(pieces, rows):
    library = Tokenizer.from_file(BYTES)
    want = sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for t in rows)
    by_sequence, whole = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return want, by_sequence


def test_packed_documents(messy, none):
    pieces = packing.pack_documents(messy, BYTES, group_docs=8).collect()
    want, _ = packed_rows_are_whole(pieces, [r[1] for r in messy_rows()])
    assert sum(p.length for p in pieces) == sum(map(len, want))
    texts = {r[0]: r[1] for r in messy_rows()}
    twice = {5, 10} & {r[0] for r in messy_rows()}
    library = Tokenizer.from_file(BYTES)
    for doc, text in texts.items():
        full = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((p.start, p) for p in pieces if p.doc_tokens == len(full) and p.id == doc)
        times = 2 if [r[0] for r in messy_rows()].count(doc) == 2 else 1
        assert sum(p.length for _, p in mine) == times * len(full)
        assert all(ids(p.ids) == full[p.start : p.start + p.length] for _, p in mine)
    assert twice and packing.pack_documents(none, BYTES).collect() == []


def test_tokenizer_file_bound(messy, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "MAX_FILE_MB", 0)
    with pytest.raises(ValueError):
        packing.shared_file(messy, BYTES)


def test_a_long_document_is_packed_whole(spark):
    text = prose(7, 20_000)
    pieces = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens > 20 * 1024
