"""BPE encoding and decoding with batched merge rounds.

The distinct words of a batch are laid out as one flat array of symbols.  In every round
the ranks of all neighbouring pairs are found at once, by binary search over the sorted
pair keys of the merge table; each word then merges the places of its lowest rank.  Words
that have no pair left drop out.  A word too long for rounds over its whole length goes
through a heap instead, with the same result.  Encoded words are remembered, up to a bound.

Defined results.  A null or empty text has no ids and decodes to the empty text.  Special
tokens are found in the raw text before normalisation.  Very long texts and words are
encoded whole.  Repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F

from .packing import byte_letters, loaded

#: Words remembered by a task; symbols of the longest word that takes part in rounds.
REMEMBERED = 250_000
LONG_WORD = 2000

_NONE = np.iinfo(np.int64).max


class WordBpe:
    """A tokenizers file of words with an end-of-word suffix over byte letters."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self._check(data)
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        by_id = {k: token for token, k in (vocab | special).items()}
        self.tokens = [by_id.get(k, "") for k in range(max(by_id, default=-1) + 1)]
        self.special = {s: np.uint32(k).tobytes() for s, k in special.items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.parts = regex.compile(self.pattern)
        letters = sorted(byte_letters().items(), key=lambda x: x[1])
        self.inner = np.array([vocab[c] for c, _ in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c, _ in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.base = len(self.tokens)
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.table = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made))}
        # all places of one pair may be merged together if what a merge makes is
        # only ever used by later merges
        born = np.full(self.base, -1)
        np.maximum.at(born, made, np.arange(len(pairs)))
        self.together = bool((np.maximum(born[left], born[right]) < np.arange(len(pairs))).all())
        self.known: dict[str, bytes] = {}

    def _check(self, data: dict) -> None:
        """This class knows one layout of file; anything else is refused."""
        steps = (data["normalizer"] or {}).get("normalizers", [])
        kinds = [s["type"] for s in steps]
        parts = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": "\\s+"}
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["behavior"] == "Removed"
            and parts[0]["invert"]
            and not parts[1]["use_regex"]
            and not parts[1]["add_prefix_space"]
            and data["decoder"] is None
            and data["post_processor"] is None
            and not any(data["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
            and not any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not known:
            raise ValueError("this tokenizer file is of another layout")
        self.pattern = parts[0]["pattern"]["Regex"]

    def words(self, text: str) -> list[str]:
        """The words of a stretch without special tokens."""
        text = unicodedata.normalize("NFC", text)
        # letters are lowered one by one, so a sigma stays the same at a word's end;
        # white space only parts words, so it need not be made even first
        return self.parts.findall(text.replace("Σ", "σ").lower())

    def _long(self, symbols: list[int]) -> list[int]:
        """One long word by a heap of ranks over a linked list."""
        n = len(symbols)
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if j >= 0 and (hit := self.table.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(prev[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each word."""
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG_WORD]
        for k, w in enumerate(raw):
            if len(w) > LONG_WORD:
                data = np.frombuffer(w, np.uint8)
                out[k] = np.array(self._long([*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])]), "<u4").tobytes()
        if not short:
            return out
        data = np.frombuffer(b"".join(raw[k] for k in short), np.uint8)
        sizes = np.array([len(raw[k]) for k in short])
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(short)), sizes)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            rank, made = self._pairs(symbols, owner)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            done = best == _NONE
            if done.any():
                self._put(out, short, symbols[done], owner[done])
            here = (rank == best) & ~done
            places = np.flatnonzero(here)
            if self.together:
                # in a run of overlapping places every second one is merged
                run = np.concatenate(([True], places[1:] != places[:-1] + 1)) if len(places) else np.zeros(0, bool)
                since = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0)) if len(places) else places
                places = places[since % 2 == 0]
            elif len(places):
                places = places[np.concatenate(([True], owner[places][1:] != owner[places][:-1]))]
            symbols[places] = made[places]
            keep = ~done
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each symbol with its right neighbour, and what they would make."""
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        keys = symbols[:-1] * self.base + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[at] == keys) & (owner[:-1] == owner[1:])) if len(self.keys) else np.zeros(0, int)
        rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
        return rank, made

    @staticmethod
    def _put(out: list[bytes], short: list[int], symbols: np.ndarray, owner: np.ndarray) -> None:
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        data = symbols.astype("<u4").tobytes()
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(symbols)]):
            out[short[owner[a]]] = data[4 * a : 4 * b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian uint32."""
        parted = []
        for text in texts:
            stretches = self.special_at.split(text or "") if self.special_at else [text or ""]
            parted.append([[s] if k % 2 else self.words(s) for k, s in enumerate(stretches)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for doc in parted for words in doc[::2] for w in words}.difference(self.known))
        self.known.update(zip(new, self.encode_words(new)))
        return [
            b"".join(self.special[words[0]] if k % 2 else b"".join(map(self.known.__getitem__, words)) for k, words in enumerate(doc))
            for doc in parted
        ]

    def decode(self, ids: bytes) -> str:
        """What the file's missing decoder gives: the tokens with spaces between them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(shared):
    """A column function: text -> ids as little-endian uint32."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(WordBpe, shared)
        for batch in batches:
            yield pd.Series(bpe.encode([None if t is None else t for t in batch]), dtype=object)

    return encoded


def decoder(shared):
    """A column function: ids -> text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(WordBpe, shared)
        for batch in batches:
            yield pd.Series([bpe.decode(b or b"") for b in batch], dtype=object)

    return decoded
