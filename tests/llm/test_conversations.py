"""Prefix trie and repair of conversations against plain versions."""

import random

import pytest
from brute import digest, in_order, repaired, repairs, trie
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm import conversation_repair, ordered_digest, prefix_trie
from auditloom.llm.common import ready

SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("id", "key", "slot", "depth", "piece", "a.b", "block", "parent")],
    ]
)


def talk(rng, conv, n, roles="suax", texts=("Hi.", "No", "", " \n", "Why?", "Go on!", None, "é. ", "x" * 3000)):
    names = {"s": "system", "u": "user", "a": "assistant", "x": rng.choice(["tool", None, ""])}
    return [
        (conv, rng.choice([k, k, k, k + 3, None]), names[rng.choice(roles)], rng.choice(texts), *["z"] * 8) for k in range(n)
    ]


def mixed(seed=1):
    rng = random.Random(seed)
    rows = [r for c in [*range(0, 24), 100, 101, 205, 299, -3, -100] for r in talk(rng, c, rng.randrange(1, 9))]
    rows += talk(rng, 300, 120, "ua", ("Yes.", "No.", "Maybe.", "cut", *(f"text {k}." for k in range(90))))
    rows += [(None, 0, "user", "lost.", *["z"] * 8), (None, None, None, None, *["z"] * 8)]
    return [*rows, rows[3], rows[3], rows[40]]


@pytest.fixture(scope="module")
def rows(spark):
    ready(spark)
    return spark.createDataFrame(mixed(), SCHEMA).repartition(3)


def plain(rows):
    return [r[:4] for r in rows]


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("branched", [True, False])
def test_trie_like_plain_walk(rows, branched):
    build = prefix_trie.branched_conversations if branched else prefix_trie.whole_conversations
    same(prefix_trie.prefix_trie(rows, build), trie(plain(mixed()), branched))


def test_trie_of_nothing(rows):
    assert prefix_trie.prefix_trie(rows.filter("false")).collect() == []
    assert prefix_trie.prefix_trie(rows.filter("conv_id IS NULL")).collect() == []


def test_subtree_sums_of_odd_trees(spark):
    """Paths, stars, combs and random trees; several roots."""
    rng = random.Random(4)
    parents = {}
    for k in range(1, 41):
        parents[f"p{k}"] = f"p{k - 1}"
        parents[f"s{k}"] = "s0"
        parents[f"c{k}"] = f"c{k - 1}"
        parents[f"d{k}"] = f"c{k}"
        parents[f"r{k}"] = f"r{rng.randrange(k)}"
    parents |= {f"{x}0": None for x in "pscr"}
    kids = {k: [v for v, p in parents.items() if p == k] for k in parents}
    weight = {k: rng.randrange(9) for k in parents}

    def total(k):
        return weight[k] + sum(map(total, kids[k]))

    tree = spark.createDataFrame(
        [(k.encode(), p and p.encode(), len(kids[k]), weight[k]) for k, p in parents.items()],
        "id binary, parent binary, kids long, w long",
    )
    got = {bytes(r.id).decode(): r.w for r in prefix_trie.subtree_sums(tree, ["w"]).collect()}
    assert got == {k: total(k) for k in parents}


@pytest.mark.parametrize("block", [1, 3, 512])
def test_repair_like_plain_search(rows, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    same(conversation_repair.repair_conversations(rows), repairs(plain(mixed())))


def test_repair_of_nothing(rows):
    assert conversation_repair.repair_conversations(rows.filter("false")).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_ways_join_exactly(seed):
    """Any cut of a conversation into blocks gives the answer of a search over all of it."""
    rng = random.Random(seed)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(k, names[rng.choice("suax")], rng.choice(["a.", "b", "", "c!"])) for k in range(rng.randrange(1, 14))]
    seen, faults = set(), ""
    for _, role, text in rows:
        faults += "b" if not text else "d" if (role, text) in seen else " " if text[-1] in ".!" else "t"
        seen.add((role, text))
    initials = "".join(r[0] if r != "tool" else "x" for _, r, _ in rows)
    want = repaired(rows)
    for size in (1, 2, 5, 20):
        cuts = range(0, len(rows), size)
        blocks = [conversation_repair.ways(initials[k : k + size], faults[k : k + size]) for k in cuts]
        cost, audit, parts = conversation_repair.join_ways(blocks)
        assert (cost, audit) == want[5:7]
        lines = []
        for k, (state, letters) in zip(cuts, parts):
            steps = conversation_repair.actions(initials[k : k + size], state, letters, k + size >= len(rows))
            for (_, role, text), (lead, new, kept, tail) in zip(rows[k : k + size], steps):
                lines += [x for x in (lead, f"{new or role}:{text}" if kept else None, tail) if x is not None]
        assert digest("\n".join(lines)) == want[7]


def test_digest_of_groups_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ordered_digest, "CHUNK", 40)
    rng = random.Random(2)
    groups = {f"g{k}": [f"v{rng.randrange(10**9)}" * rng.randrange(4) for _ in range(n)] for k, n in enumerate([1, 0, 900, 2, 30, 7] * 4)}
    rows = [(g.encode(), k, v.encode()) for g, values in groups.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g binary, k int, v binary").repartition(4)
    got = ordered_digest.ordered_sha256(df, "g", ["k"], "v", ";").collect()
    assert {bytes(r.grp).decode(): r.sha256 for r in got} == {g: digest(";".join(v)) for g, v in groups.items() if v}
    assert len(got) == sum(bool(v) for v in groups.values())


def test_order_helper():
    assert in_order([(1, None, None, "b"), (1, 0, "u", "a")], "")[1][0] == (None, "", "b")


def test_text_goes_once_through_the_trie(rows):
    """After the turns are numbered no text is carried."""
    turns = prefix_trie.ordered_turns(rows)
    assert set(turns.columns) == {"conv_id", "piece", "pos", "digest", "chars"}
    assert turns.agg(F.max(F.length("digest"))).first()[0] == 16
