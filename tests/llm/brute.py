"""Plain versions of the operators, row by row, to compare with."""

import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substrings(rows, window=13):
    """rows: (id, text) -> (id, n_words, n_removed, kept) for each row."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return set()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def components(rows, percent):
    """rows: (id, text) with distinct ids -> {id: smallest id reachable}."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            for k, v in label.items():
                if v in (x, y):
                    label[k] = min(x, y)
    return label


def repeat_words(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(grams)
    return len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)})


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))


def quality(rows, min_docs=5, share=10, most=50):
    """rows: (id, text, host) -> [(row, measures, kept, cleaned text)]."""
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        hosts[host or ""].add(text)
        for line in (text or "").split("\n"):
            if words(line):
                holders[host or "", normal(line)].add(text)
    often = {k for k, v in holders.items() if len(v) >= min_docs and 100 * len(v) > share * len(hosts[k[0]])}
    out = []
    for row in rows:
        _, text, host = row
        w, full = words(text), text or ""
        lines = [x for x in full.split("\n") if words(x)]
        gone = sum(len(words(x)) for x in lines if (host or "", normal(x)) in often)
        repeats = repeat_words(text)
        failed = len(w) < 50 or 100 * repeats > 50 * len(w)
        kept = not failed and 100 * gone <= most * len(w)
        left = "\n".join(x for x in full.split("\n") if not words(x) or (host or "", normal(x)) not in often)
        measures = (len(w), sum(map(len, w)), sum(full.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats)
        out.append((row, measures, failed, kept, left, gone))
    return out


def in_order(rows, blank):
    """rows: (conv_id, turn, role, text) -> {conv_id: [(turn, role, text)]}, by turn, null first."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, blank if role is None else role, blank if text is None else text))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in by.items()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie(rows, branched=True):
    """rows: (conv_id, turn, role, text) -> one tuple a node, by walking a dict of dicts."""
    own = {c: [r[1:] for r in v] for c, v in in_order(rows, "").items() if c is not None}

    def whole(c):
        h = zlib.crc32(str(c).encode()) % 6
        return own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:] if branched else own[c]

    def node(depth, chars):
        return {"depth": depth, "chars": chars, "in": [], "ends": [], "kids": {}}

    root, out = node(0, 0), []
    for c in sorted(own):
        at = root
        at["in"].append(c)
        for depth, turn in enumerate(whole(c), 1):
            at = at["kids"].setdefault(turn, node(depth, len(turn[1])))
            at["in"].append(c)
        at["ends"].append(c)

    def walk(at, parent):
        leaves, saved = int(not at["kids"]), (len(at["in"]) - 1) * at["chars"]
        for kid in at["kids"].values():
            more = walk(kid, at["in"][0])
            leaves, saved = leaves + more[0], saved + more[1]
        ends = digest(",".join(map(str, at["ends"])))
        out.append((at["in"][0], at["depth"], parent, len(at["in"]), len(at["kids"]), leaves, saved, ends))
        return leaves, saved

    if own:
        walk(root, None)
    return out


def damaged(rows):
    """rows: (conv_id, turn, role, text) -> the same after the damage, copies next to each other."""
    show = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """rows: (turn, role, text) in order -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(k, state, added):
        """state: "" at the start, s, u, or . after a pair; strings compared as they are."""
        found = [(0, "", ())] if k == len(rows) and state in ("", ".") else []

        def go(rest, cost, letter, line):
            if rest is not None:
                found.append((rest[0] + cost, letter + rest[1], (*line, *rest[2])))

        def after(letter):
            if state == "u":
                return "." if letter == "a" else None
            return "u" if letter == "u" else "s" if letter == "s" and state == "" else None

        if added < 3:
            for role in ("user", "assistant"):
                if (to := after(role[0])) is not None:
                    go(best(k, to, added + 1), 2, "I", (f"{role}:",))
        if k < len(rows):
            _, role, text = rows[k]
            go(best(k + 1, state, 0), 3, "D", ())
            if faults[k] in ("", "truncated"):
                late = int(faults[k] == "truncated")
                if (to := after(role[:1])) is not None:
                    go(best(k + 1, to, 0), late, "K", (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    if (to := after(new[0])) is not None:
                        go(best(k + 1, to, 0), late + 2, "R", (f"{new}:{text}",))
        return min(found) if found else None

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest("\n".join(lines)))


def repairs(rows):
    after = in_order(damaged(rows), " ")
    return [(c, *repaired(after.get(c, []))) for c in {r[0] for r in rows}]


SECRETS = {
    "assign": r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def secrets(text):
    """[(start, kind, end)] of the fixed patterns, every match looked at."""
    least = {"assign": 12, "access": 18, "hex": 16}
    out = []
    for order, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]
