"""Packing documents into sequences of a fixed length.

Documents fall into randomised groups, and every group is packed by itself: stretches of
a full sequence first, then the remainders by first-fit decreasing, where a tournament
tree over the bins' free places finds the first bin that fits in logarithmic time.  What
padding first-fit leaves is then filled by cutting pieces of the emptiest bins, so a
group ends with one unfilled sequence at most.

Groups hold about ``GROUP_DOCS`` documents each, whatever the size of the table; the
group comes from a hash of id and text, so rows that share an id are spread, too.

Defined results.  A null or empty text is the end mark alone.  Repeated rows are packed
as often as they occur; ties in length are broken by id.  A null id is allowed.  An empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ready

SEQUENCE = 1024
GROUP_DOCS = 512
END = 0
#: A tokenizer file is sent to every task; it is a file of fixed size, and no larger.
MAX_FILE_MB = 64
#: Sequence ids: the group's number above these bits.
LOCAL_BITS = 24

#: Fixed value: how byte-level vocabularies part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteTokenizer:
    """Ids of a byte-level BPE file, by the faster rank encoder where that is the same.

    It is the same when every merge makes the next larger id, for then the lowest rank is
    the lowest id, and when the text is parted by the usual pattern with nothing before.
    """

    def __init__(self, spec: str):
        self.slow = Tokenizer.from_str(spec)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.fast = None
        data = json.loads(spec)
        model, parting = data["model"], data["pre_tokenizer"] or {}
        vocab, letters = model["vocab"], byte_letters()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        same = (
            data["normalizer"] is None
            and parting.get("type") == "ByteLevel"
            and not parting.get("add_prefix_space")
            and parting.get("use_regex", True)
            and all(a < b for a, b in zip(merged, merged[1:]))
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if same:
            ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in special}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except Exception:  # the fast one gives up on some texts, such as endless blanks
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def shared_file(df: DataFrame, path: str):
    """The tokenizer file, sent to the tasks."""
    data = Path(path).read_bytes()
    if len(data) > MAX_FILE_MB * 2**20:
        raise ValueError(f"{path} is no tokenizer file")
    return df.sparkSession.sparkContext.broadcast(data.decode())


_loaded: dict[tuple[type, int], object] = {}


def loaded(kind: type, shared):
    """The tokenizer of this worker, read once."""
    key = (kind, shared.id if hasattr(shared, "id") else hash(shared.value))
    if key not in _loaded:
        _loaded[key] = kind(shared.value)
    return _loaded[key]


class FreePlaces:
    """A tournament tree over bins: each node knows the most free places below it."""

    def __init__(self, n_bins: int, size: int):
        self.width = 1 << max(0, n_bins - 1).bit_length()
        self.most = [0] * self.width + [size] * n_bins + [0] * (self.width - n_bins)
        for k in range(self.width - 1, 0, -1):
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def take(self, wanted: int) -> tuple[int, int]:
        """Put ``wanted`` into the first bin with room; (bin, free places it had)."""
        k = 1
        while k < self.width:
            k = 2 * k if self.most[2 * k] >= wanted else 2 * k + 1
        free = self.most[k]
        self.most[k] = free - wanted
        bin_ = k - self.width
        while k > 1:
            k //= 2
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])
        return bin_, free


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of these lengths."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        cut = n - n % size
        full += [[(doc, at, size)] for at in range(0, cut, size)]
        if n > cut:
            rest.append((doc, cut, n - cut))
    rest.sort(key=lambda piece: -piece[2])
    tree, bins = FreePlaces(len(rest), size), [[] for _ in rest]
    free = [size] * len(rest)
    for piece in rest:
        bin_, had = tree.take(piece[2])
        bins[bin_].append(piece)
        free[bin_] = had - piece[2]
    # the fullest bins are topped up with what is cut from the emptiest
    order = sorted((b for b in range(len(bins)) if bins[b]), key=lambda b: (free[b], b))
    to, giver = 0, len(order) - 1
    while to < giver:
        hole, donor = free[order[to]], bins[order[giver]]
        if not hole:
            to += 1
            continue
        doc, start, n = donor.pop()
        given = min(hole, n)
        if given < n:
            donor.append((doc, start, n - given))
        bins[order[to]].append((doc, start + n - given, given))
        free[order[to]] -= given
        free[order[giver]] += given
        if not donor:
            giver -= 1
    return full + [bins[b] for b in order[: giver + 1] if bins[b]]


def _token_rows(shared, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(ByteTokenizer, shared)
        tail = np.uint32(end)
        for batch in batches:
            ids = [np.append(tokenizer.ids(t or ""), tail).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["grp", "id", "ids"])

    return rows


def _pack_rows(size: int):
    def rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs, all_ids = table["id"].to_pylist(), table["ids"].to_pylist()
        group = table["grp"][0].as_py()
        order = sorted(range(len(docs)), key=lambda k: (len(all_ids[k]), docs[k] is None, docs[k] or 0, all_ids[k]))
        out = {name: [] for name in ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        for number, pieces in enumerate(pack([len(all_ids[k]) // 4 for k in order], size)):
            offset = 0
            for doc, start, length in pieces:
                k = order[doc]
                values = (docs[k], start, length, all_ids[k][4 * start : 4 * (start + length)], len(all_ids[k]) // 4, (group << LOCAL_BITS) + number, offset)
                for name, value in zip(out, values):
                    out[name].append(value)
                offset += length
        return pa.table({name: pa.array(v, pa.binary() if name == "ids" else pa.int64()) for name, v in out.items()})

    return rows


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end: int = END,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id and offset.  Sequences are padded to ``size`` by the reader."""
    ready(docs.sparkSession)
    shared = shared_file(docs, tokenizer_path)
    n_groups = max(1, -(-docs.count() // group_docs))
    spot = F.xxhash64(F.lit(71), F.col(id_col), F.col(text_col))
    grouped = docs.select(
        F.pmod(spot, F.lit(n_groups)).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    tokens = grouped.mapInArrow(_token_rows(shared, end), "grp long, id long, ids binary")
    return tokens.groupBy("grp").applyInArrow(
        _pack_rows(size),
        "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
