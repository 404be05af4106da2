"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Conversations that begin with the same turns share the nodes of these turns, so the trie
tells what a cache of prefixes would save.  A node is known by a 128-bit fingerprint of
its turns: the sum, in four lanes, of a hash of every turn and its place.  Sums can be
made in pieces, so a conversation that holds much of the table is cut into as many
range pieces as it needs and no task ever holds it.

Subtree totals come from contracting the tree in join rounds.  *Compress* takes out all
unary nodes (one child left): pointers along the chains are lengthened fourfold a round
until they reach the node below the chain, which is then hung on the node above it.
*Rake* takes out all leaves and adds their totals to their parents.  Each phase leaves at
most half the nodes.  Then the phases are expanded in reverse: the total of a compressed
node is the weight of the chain from it on, plus the total of the node below.

Null roles and texts count as empty.  Turns are ordered by number, null first, then role
and text, so repeated rows and ties have one order.  Rows without a conversation id
belong to no conversation and are left out; a table without conversations has no node,
not even the root.  Columns beyond conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .ordered_digest import ordered_sha256

#: Turns that a conversation of the contract takes from its base at most.
MAX_SHARED = 5
#: Conversations of one base.
FAMILY = 100
LANES = ["_l0", "_l1", "_l2", "_l3"]
_LOW = 0xFFFFFFFF
_EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- turns and prefixes ----------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, pos, digest, chars): turns numbered from 1, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = (
        conversations.filter(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
        .select(
            "conv_id",
            F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
            F.length("text").cast("long").alias("chars"),
            F.monotonically_increasing_id().alias("slot"),
        )
    )
    placed = stored(rows).withColumn("piece", F.shiftright("slot", 33))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("conv_id", "piece")
        .agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            "conv_id", "piece", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1).alias("base")
        )
    )
    return placed.join(starts, ["conv_id", "piece"]).select(
        "conv_id", "piece", (F.col("slot") - F.col("base")).alias("pos"), "digest", "chars"
    )


def whole_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, lengths) of the conversations as they are."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    rows = turns.withColumnRenamed("pos", "depth")
    return rows.join(lengths, "conv_id"), lengths


def branched_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, lengths): each conversation c begins with turns of its family's base.

    The first h = crc32(decimal c) % 6 turns are those of conversation c - c % 100 (all
    if it has fewer, none if there is no such conversation); its own turns follow after
    its first h.
    """
    heads = (
        turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= MAX_SHARED))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    )  # at most MAX_SHARED turns a base
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MAX_SHARED + 1)).cast("int")
    none = F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")
    convs = (
        turns.groupBy("conv_id")
        .agg(F.max("pos").alias("n"))
        .withColumn("h", shared)
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
        .withColumn("kept", F.size("head"))
        .withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = stored(convs.select("conv_id", "h", "head", "kept", "length"))
    front = convs.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", F.lit(-1).cast("long").alias("piece"), F.col("t.pos").alias("depth"), "t.digest", "t.chars", "length"
    )
    rest = (
        turns.join(convs.select("conv_id", "h", "kept", "length"), "conv_id")
        .filter(F.col("pos") > F.col("h"))
        .withColumn("depth", F.col("pos") - F.col("h") + F.col("kept"))
        .select("conv_id", "piece", "depth", "digest", "chars", "length")
    )
    return front.unionByName(rest), convs.select("conv_id", "length")


def _node(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def _prefixes(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation: its node, the node above, the last turn's length."""
    x = F.xxhash64(F.col("depth"), F.col("digest"))
    y = F.xxhash64(F.col("digest"), F.col("depth"), F.lit(0x5BD1E995))
    lanes = [F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(y, 32), y.bitwiseAND(F.lit(_LOW))]
    own = stored(rows.select("conv_id", "piece", "depth", "chars", "length", *[v.alias(n) for n, v in zip(LANES, lanes)]))
    inside = Window.partitionBy("conv_id", "piece").orderBy("depth")
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        own.groupBy("conv_id", "piece")
        .agg(*[F.sum(n).alias(n) for n in LANES])
        .select("conv_id", "piece", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b{n}") for n in LANES])
    )
    summed = own.select("*", *[F.sum(n).over(inside).alias(f"_s{n}") for n in LANES]).join(before, ["conv_id", "piece"])
    upto = [F.col(f"_s{n}") + F.col(f"_b{n}") for n in LANES]
    above = [u - F.col(n) for u, n in zip(upto, LANES)]
    return summed.select(
        "conv_id", "depth", "chars", "length",
        _node(F.col("depth"), upto).alias("id"), _node(F.col("depth") - 1, above).alias("parent"),
    )


# ---- tree contraction ------------------------------------------------------------


def _chains(active: DataFrame, sums: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """(pointers, tops) of the unary chains, or None where there are none.

    pointers: (id, next, weights) of every unary node, next being the node below its
    chain and the weights those of the chain from the node on.  tops: (id, parent, edge
    weights) of the first node of each chain.
    """
    edges = [f"e_{s}" for s in sums]
    unary = active.filter("kids = 1").select(
        F.col("id").alias("v"), F.col("parent").alias("v_parent"),
        *[F.col(s).alias(f"v_{s}") for s in sums], *[F.col(e).alias(f"v_{e}") for e in edges],
    )
    links = stored(
        active.join(unary, F.col("parent") == F.col("v")).select(
            F.col("v").alias("id"), F.col("id").alias("next"), (F.col("kids") == 1).alias("open"), "v_parent",
            *[f"v_{e}" for e in edges], *[(F.col(f"v_{s}") + F.col(f"e_{s}")).alias(s) for s in sums],
        )
    )
    if links.isEmpty():
        return None
    now = links.select("id", "next", "open", *sums)
    finished = [now.filter("NOT open").drop("open")]
    pending = now.filter("open")
    while not pending.isEmpty():
        every = pending.unionByName(_union(finished).withColumn("open", F.lit(False)))
        jumped = pending
        for _ in range(3):  # pointers of the round, followed thrice: four times as long
            hop = every.select(
                F.col("id").alias("next"), F.col("next").alias("n_next"), F.col("open").alias("n_open"),
                *[F.col(s).alias(f"n_{s}") for s in sums],
            )
            jumped = jumped.join(hop, "next", "left").select(
                "id",
                F.coalesce("n_next", "next").alias("next"),
                F.coalesce("n_open", F.lit(False)).alias("open"),
                *[(F.col(s) + F.coalesce(f"n_{s}", F.lit(0))).alias(s) for s in sums],
            )
        step = stored(jumped)
        finished.append(step.filter("NOT open").drop("open"))
        pending = step.filter("open")
    tops = links.join(links.select(F.col("next").alias("id")), "id", "left_anti").select(
        "id", "v_parent", *[f"v_{e}" for e in edges]
    )
    return _union(finished), tops


def subtree_sums(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(id, sums): for each node the sums over its subtree, itself included.

    ``tree`` has id, parent (null at a root), kids (number of children) and the numeric
    columns ``sums``.
    """
    edges = [f"e_{s}" for s in sums]
    active = tree.select("id", "parent", F.col("kids").cast("long"), *sums, *[F.lit(0).cast("long").alias(e) for e in edges])
    raked: list[DataFrame] = []
    compressed: list[DataFrame | None] = []
    while not active.isEmpty():
        found = _chains(active, sums)
        compressed.append(found and found[0])
        if found:
            pointers, tops = found
            moved = tops.join(pointers, "id").select(
                F.col("next").alias("id"), F.col("v_parent").alias("m_parent"), F.lit(True).alias("moved"),
                *[(F.col(f"v_{e}") + F.col(s)).alias(f"m_{e}") for s, e in zip(sums, edges)],
            )
            active = stored(
                active.filter("kids <> 1").join(moved, "id", "left").select(
                    "id", F.when(F.col("moved"), F.col("m_parent")).otherwise(F.col("parent")).alias("parent"), "kids", *sums,
                    *[(F.col(e) + F.coalesce(f"m_{e}", F.lit(0))).alias(e) for e in edges],
                )
            )
        leaves = active.filter("kids = 0")
        raked.append(leaves.select("id", *sums))
        given = (
            leaves.filter("parent IS NOT NULL")
            .groupBy(F.col("parent").alias("id"))
            .agg(F.count(F.lit(1)).alias("g_kids"), *[F.sum(F.col(s) + F.col(e)).alias(f"g_{s}") for s, e in zip(sums, edges)])
        )
        active = stored(
            active.filter("kids > 0").join(given, "id", "left").select(
                "id", "parent", (F.col("kids") - F.coalesce("g_kids", F.lit(0))).alias("kids"),
                *[(F.col(s) + F.coalesce(f"g_{s}", F.lit(0))).alias(s) for s in sums], *edges,
            )
        )
    if not raked:
        return tree.select("id", *sums)
    totals: list[DataFrame] = []
    for leaves, chain in zip(reversed(raked), reversed(compressed)):
        totals.append(leaves)
        if chain is not None:
            below = _union(totals).select(F.col("id").alias("next"), *[F.col(s).alias(f"t_{s}") for s in sums])
            totals.append(
                stored(chain.join(below, "next").select("id", *[(F.col(s) + F.col(f"t_{s}")).alias(s) for s in sums]))
            )
    return _union(totals)


# ---- the trie --------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, build=whole_conversations) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``build`` makes the conversations out of the numbered turns.  saved_tokens adds, over
    the subtree, (members - 1) times the code points of each node's last text.
    """
    rows, lengths = build(ordered_turns(conversations))
    prefixes = stored(_prefixes(rows))
    zero = F.lit(0).cast("long")
    root_id = _node(zero, [zero] * len(LANES))
    counted = prefixes.groupBy("id", "parent", "depth", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    )
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        root_id.alias("id"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("chars"),
        "conv_id", "n_convs",
    )
    nodes = stored(counted.select(root.columns).unionByName(root))
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    tree = stored(
        nodes.join(kids, "id", "left").select(
            "id", "parent", "depth", "conv_id", "n_convs", F.coalesce("kids", zero).alias("kids"),
            F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        )
    )
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    ends = prefixes.filter("depth = length").select("id", "conv_id").unionByName(
        lengths.filter("length = 0").select(root_id.alias("id"), "conv_id")
    )
    ended = ordered_sha256(
        ends.withColumn("text", F.col("conv_id").cast("string").cast("binary")), "id", ["conv_id"], "text", ","
    ).withColumnRenamed("grp", "id")
    parents = tree.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        tree.select("id", "parent", "conv_id", "depth", "n_convs", F.col("kids").alias("n_children"))
        .join(totals, "id")
        .join(ended, "id", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
        )
    )
