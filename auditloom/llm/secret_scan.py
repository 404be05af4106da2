"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns give the base spans: assignments to names such as ``password``, access key
ids, and long lower-case hex.  The field tags every token of a text as the begin, inside
or outside of a secret.  Its features are the token's shape (length, kinds of letters,
changes between them, prefix), the shapes and some of the words of two neighbours on each
side, and features of the file (length, shares of digits and signs).  It learns the
labels of the base spans from windows of at most about ``SAMPLE_DOCS`` distinct texts, chosen
by hash, by maximum likelihood (forward-backward, Adam).  Each window with a span is also
learned with its long tokens spelt anew in letters and digits, with and without its
name, so that the field knows secrets by their shape and not by the patterns alone.
Where no sampled text has a span there is no field and the base spans are all.  Decoded spans that touch no base span are
added under the kind ``crf``.

Decoding is exact Viterbi.  A token is surely outside where every path through it can be
bettered by tagging it outside; such tokens, nearly all, cut the text into short runs,
and only the runs are searched.

Every text is read whole.  Positions are code points, ends exclusive.  A null text is
empty and has no span; a text of one very long token is one token.  Repeated rows give
the same spans each, other columns are not read, an empty table gives no row.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Distinct texts that the field learns from, about (a hash decides); the bound of the sample.
SAMPLE_DOCS = 4000
#: Spans of one text with windows of their own, tokens on each side and inside of a window.
SPANS_A_TEXT, SIDE, INSIDE = 4, 8, 32
#: Rounds and step of the training, weight of the squared norm.
ROUNDS, STEP, RIDGE = 80, 0.2, 1e-5
#: A word is a feature if it stands near so many spans of the sample.
MIN_NEAR = 3
#: Words whose features a task remembers.
REMEMBERED = 200_000

# fixed patterns and formats
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
ADDED = "crf"

_ASSIGN, _ACCESS, _LONG_HEX = re.compile(ASSIGN), re.compile(ACCESS), re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[\w+/\-]+(?:\.[\w+/\-]+)*|[^\w\s]")
_WORD = re.compile(r"[a-z_\-]{2,16}")
_SPELLING = string.ascii_lowercase + string.ascii_uppercase + string.digits
O, B, I = 0, 1, 2  # noqa: E741
_BANNED = -1e4
_AROUND = (0, -1, -2, 1, 2)

Span = tuple[int, int, int]  # start, kind, end


# ---- fixed patterns --------------------------------------------------------------


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of hex digits is matched whole, so the long ones can be looked for directly
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


# ---- features --------------------------------------------------------------------


def _kind(word: str) -> str:
    if not word.isascii():
        return "word" if word.isalpha() else "other"
    if len(word) == 1 and not word.isalnum():
        return f"sign{word}"
    if word.isdigit():
        return "digits"
    if word.isalpha():
        return "lower" if word.islower() else "upper" if word.isupper() else "title" if word[1:].islower() else "letters"
    if all(c in "0123456789abcdef" for c in word):
        return "hex"
    if word.isalnum():
        return "lower9" if word.islower() else "upper9" if word.isupper() else "mixed9"
    return "marked"


def _size(n: int) -> int:
    return next((k for k, most in enumerate((1, 3, 7, 11, 15, 23, 39)) if n <= most), 7)


def features(word: str) -> list[str]:
    """What is seen of one token."""
    kind, size = _kind(word), _size(len(word))
    out = [f"k={kind}", f"n={size}", f"kn={kind},{size}"]
    if len(word) >= 8:
        classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in word[:200]]
        changes = sum(a != b for a, b in zip(classes, classes[1:]))
        out.append(f"c={8 * changes // len(classes)}")
        out.append(f"d={4 * classes.count(0) // len(classes)}")
        out.append(f"p={word[:4]}")
    if _WORD.fullmatch(lowered := word.lower()[:20]):
        out.append(f"w={lowered}")
    return out


def file_features(data: bytes) -> list[str]:
    """What is seen of the whole text."""
    codes = np.frombuffer(data, np.uint8)
    digits = np.count_nonzero((codes >= 48) & (codes <= 57))
    signs = np.count_nonzero((codes > 32) & (codes < 48)) + np.count_nonzero((codes > 57) & (codes < 65))
    share = lambda n: int(np.log2(1 + 200 * n / max(1, len(codes))))
    return [f"size={len(data).bit_length() // 3}", f"digits={share(digits)}", f"signs={share(signs)}"]


# ---- the field -------------------------------------------------------------------


class Field:
    """Weights: ``table`` (a row of five times three for each feature), ``steps`` (3 x 3), ``file``."""

    def __init__(self, known: dict[str, int], table: np.ndarray, steps: np.ndarray, file: dict[str, np.ndarray]):
        self.known, self.table, self.steps, self.file = known, table, steps, file
        # the most that passing through a secret at one token can gain in steps
        self.gain = max(
            steps[a, y] + steps[y, c] - steps[a, O] - steps[O, B if c == I else c]
            for a in range(3) for y in (B, I) for c in range(3)
            if steps[a, y] > _BANNED / 2 and steps[y, c] > _BANNED / 2
        )

    def bias(self, data: bytes) -> np.ndarray:
        return sum((self.file[f] for f in file_features(data) if f in self.file), np.zeros(3))


class Remembered(dict):
    """Rows of weights of words, one row for all words that look alike."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.alike = field, {(): 0}
        self.rows = np.zeros((1024, 5, 3))

    def __missing__(self, word: str) -> int:
        known = self.field.known
        look = tuple(known[f] for f in features(word) if f in known)
        row = self.alike.get(look)
        if row is None:
            row = self.alike[look] = len(self.alike)
            if row == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[row] = self.field.table[list(look)].sum(axis=0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = row
        return row


def _scores(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of the tags of tokens, neighbours included; 0 stands for no token."""
    padded = np.pad(ids, 2)
    n = len(ids)
    return sum(rows[padded[2 + d : 2 + d + n], k] for k, d in enumerate(_AROUND))


def _viterbi(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """Best tags of a run between two tokens that are outside (or the text's ends)."""
    best, back = scores[0] + steps[O], []
    for row in scores[1:]:
        through = best[:, None] + steps
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    tags = [int((best + steps[:, O]).argmax())]
    for choice in reversed(back):
        tags.append(int(choice[tags[-1]]))
    return tags[::-1]


def tagged(words: list[str], bias: np.ndarray, field: Field, seen: Remembered) -> list[tuple[int, int]]:
    """(first, after last) tokens of each secret."""
    if not words:
        return []
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    scores = _scores(ids, seen.rows) + bias
    more = np.zeros(len(ids))
    more[:-1] = np.maximum(0, scores[1:, I] - scores[1:, B])
    maybe = np.flatnonzero(np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + field.gain + more >= 0)
    out = []
    for run in np.split(maybe, np.flatnonzero(np.diff(maybe) > 1) + 1):
        start = None
        for k, tag in zip(run, _viterbi(scores[run], field.steps) if len(run) else []):
            if tag != I and start is not None:
                out.append((start, int(k)))
                start = None
            if tag == B:
                start = int(k)
        if start is not None:
            out.append((start, int(run[-1]) + 1))
    return out


def scan_text(data: bytes, field: Field | None, seen: Remembered | None) -> list[Span]:
    """All spans of one text (UTF-8), by start and kind; kind 3 is the field's."""
    text = data.decode()
    base = base_spans(text)
    if field is None:
        return base
    found = tagged(_TOKEN.findall(text), field.bias(data), field, seen)
    if not found:
        return base
    places = [m.span() for m in _TOKEN.finditer(text)]
    added, k = [], 0
    by_end = sorted((e, s) for s, _, e in base)
    for first, after in found:
        start, end = places[first][0], places[after - 1][1]
        while k < len(by_end) and by_end[k][0] <= start:
            k += 1
        if all(s >= end for e, s in by_end[k:]):
            added.append((start, len(KINDS), end))
    return sorted(base + added)


# ---- training --------------------------------------------------------------------


def _windows(text: str) -> list[tuple[list[str], str]]:
    """(tokens, tags) around some spans, and around one place that the text's hash says."""
    joined: list[list[int]] = []
    for s, _, e in base_spans(text):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    at = xxhash.xxh3_64_intdigest(text.encode()) % (len(text) + 1)
    out = []
    for s, e in [*joined[:SPANS_A_TEXT], (at, at)]:
        a, b = max(0, s - 16 * SIDE), min(len(text), e + 16 * SIDE)
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, a, b)]
        # tokens that the borders may have cut are left out
        tokens = [t for t in tokens if (t[0] > a or a == 0) and (t[1] < b or b == len(text))]
        first = next((k for k, t in enumerate(tokens) if t[1] > s), len(tokens))
        last = next((k for k, t in enumerate(tokens) if t[0] >= e), len(tokens))
        tokens = tokens[max(0, first - SIDE) : min(last, first + INSIDE) + SIDE]
        tags, before = [], None
        for x, y, _ in tokens:
            inside = next((k for k, (u, v) in enumerate(joined) if x < v and y > u), None)
            tags.append("O" if inside is None else "I" if inside == before else "B")
            before = inside
        if not tokens:
            continue
        words, marks = [t[2] for t in tokens], "".join(tags)
        out.append((words, marks))
        if "B" in marks:
            out += [([_respelt(w, m, named) for w, m in zip(words, marks)], marks) for named in (True, False)]
    return out


def _respelt(word: str, tag: str, named: bool) -> str:
    """A long token of a span in other letters and digits; its name unless ``named`` in others."""
    size = min(len(word), 200)
    if tag == "O" or (size < LEAST["assign"] and (named or not word.isalpha())):
        return word
    dice = np.random.default_rng(xxhash.xxh3_64_intdigest(word.encode()))
    letters = _SPELLING[:26] if size < LEAST["assign"] else _SPELLING + "_-" * int(dice.integers(0, 3))
    return "".join(letters[k] for k in dice.integers(0, len(letters), size))


_SAMPLED = pa.schema([("file", pa.list_(pa.string())), ("tags", pa.string()), ("looks", pa.list_(pa.string()))])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in texts(batch.column(0)):
            file = file_features(data)
            rows += [(file, tags, [" ".join(features(w)) for w in words]) for words, tags in _windows(data.decode())]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SAMPLED)], schema=_SAMPLED)


def sample(docs: DataFrame) -> list[tuple[list[str], str, list[str]]]:
    """(file features, tags, token features) of windows of about SAMPLE_DOCS distinct texts.

    Copies of a text count once, so their number does not bound what is collected.
    """
    whole = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "mark", F.xxhash64("text")
    )
    n = whole.agg(F.approx_count_distinct("mark")).first()[0]
    parts = 1 << 20
    bound = parts if n <= SAMPLE_DOCS else max(1, parts * SAMPLE_DOCS // n)
    chosen = (
        whole.filter(F.pmod(F.xxhash64(F.lit(1), "mark"), F.lit(parts)) < bound)
        .groupBy("mark")
        .agg(F.min("text").alias("text"))
    )
    rows = chosen.select("text").mapInArrow(_sampled, "file array<string>, tags string, looks array<string>")
    return sorted((r.file, r.tags, r.looks) for r in rows.collect())


def _known(rows: list[tuple]) -> dict[str, int]:
    """Numbers of the features: all shapes, and words near enough spans."""
    shapes, near = Counter(), Counter()
    for _, tags, looks in rows:
        close = {k + d for k, t in enumerate(tags) if t != "O" for d in range(-3, 4)}
        for k, look in enumerate(looks):
            for f in look.split(" "):
                if f.startswith(("w=", "p=")):
                    near[f] += k in close
                else:
                    shapes[f] += 1
    names = sorted(shapes) + sorted(f for f, n in near.items() if n >= MIN_NEAR)
    return {f: k for k, f in enumerate(names)}


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _expected(scores: np.ndarray, steps: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tags (rows, places, 3) and summed marginals of steps (3, 3)."""
    n, length, _ = scores.shape
    ahead = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + steps[O]
    for t in range(1, length):
        new = _logsum(ahead[:, t - 1, :, None] + steps, 1) + scores[:, t]
        ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
    behind = np.zeros_like(scores)
    for t in range(length - 2, -1, -1):
        new = _logsum(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(mask[:, t + 1, None], new, 0)
    total = _logsum(ahead[:, -1], 1)
    tags = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
    pairs = np.exp(
        ahead[:, :-1, :, None] + steps + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]
    ) * mask[:, 1:, None, None]
    return tags, pairs.sum(axis=(0, 1))


def train(docs: DataFrame) -> Field | None:
    """The field for the texts of ``docs``; None where the sample holds no span."""
    return fit(sample(docs))


def fit(rows: list[tuple[list[str], str, list[str]]]) -> Field | None:
    if not any(t != "O" for _, tags, _ in rows for t in tags):
        return None
    known = _known(rows)
    looks: dict[tuple, int] = {(): 0}
    files = {f: k for k, f in enumerate(sorted({f for r in rows for f in r[0]}))}
    length = max(len(r[1]) for r in rows)
    ids, gold = np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length), np.int64)
    mask, file = np.zeros((len(rows), length), bool), np.zeros((len(rows), len(files)), np.float32)
    for k, (own, tags, seen) in enumerate(rows):
        number = [looks.setdefault(tuple(known[f] for f in x.split(" ") if f in known), len(looks)) for x in seen]
        ids[k, : len(tags)], mask[k, : len(tags)] = number, True
        gold[k, : len(tags)] = ["OBI".index(t) for t in tags]
        file[k, [files[f] for f in own]] = 1
    shape = np.zeros((len(looks), len(known)), np.float32)  # which look has which feature
    for look, k in looks.items():
        shape[k, list(look)] = 1
    hit = np.eye(3, dtype=np.float32)[gold] * mask[:, :, None]
    stepped = np.zeros((3, 3))
    np.add.at(stepped, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    padded = np.pad(ids, ((0, 0), (2, 2)))
    place = [padded[:, 2 + d : 2 + d + length] for d in _AROUND]
    banned = np.zeros((3, 3), np.float32)
    banned[O, I] = _BANNED
    sizes = {"table": (len(known), 5, 3), "steps": (3, 3), "file": (len(files), 3)}
    weights = {k: np.zeros(v, np.float32) for k, v in sizes.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for turn in range(1, ROUNDS + 1):
        rows_of = np.tensordot(shape, weights["table"], 1)
        rows_of[0] = 0
        scores = sum(rows_of[p, k] for k, p in enumerate(place)) + (file @ weights["file"])[:, None, :]
        tags, pairs = _expected(scores, weights["steps"] + banned, mask)
        wrong = (tags - hit) / len(rows)
        slope = np.zeros((len(looks), 5, 3), np.float32)
        for k, p in enumerate(place):
            for tag in range(3):
                slope[:, k, tag] = np.bincount(p.ravel(), wrong[:, :, tag].ravel(), len(looks))
        slope[0] = 0
        slopes = {
            "table": np.tensordot(shape.T, slope, 1),
            "steps": (pairs - stepped) / len(rows),
            "file": file.T @ wrong.sum(axis=1),
        }
        for name, value in weights.items():
            first, second = moments[name]
            g = slopes[name] + RIDGE * value
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            value -= STEP * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Field(known, weights["table"], weights["steps"] + banned, {f: weights["file"][k] for f, k in files.items()})


# ---- Spark -----------------------------------------------------------------------


def scan(docs: DataFrame, field: Field | None, key: str = "doc_id") -> DataFrame:
    """(key, spans): every row's spans as structs of kind, start, end."""
    kinds = [*KINDS, ADDED]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Remembered(field) if field else None
        for batch in batches:
            spans = [
                [{"kind": kinds[k], "start": s, "end": e} for s, k, e in scan_text(t, field, seen)]
                for t in texts(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[key, "spans"])

    of = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string")).mapInArrow(
        run, f"`{key}` {of}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
