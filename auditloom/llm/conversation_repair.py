"""Repair of damaged conversations by a shortest path with big-integer weights.

A conversation is right when the first letters of its roles read ``(s?(ua)+)?``.  Rows
may be kept (0), given the role user or assistant (2), deleted (3, a must for blank and
duplicate rows), and rows of empty text inserted anywhere (2); a truncated row that is
not deleted costs 1 more.  Of all cheapest repairs the one whose edits' initials, in
order, come first in ASCII is taken.

Cost and initials are one integer: the cost in the high digits, below it an octal digit
for each initial, in a fixed width, first initial in the highest place, zeros after the
last.  So a shorter text comes before its extensions, and the least integer is the
answer.  The path is found backwards over (row, state of the pattern); putting an edit
in front adds its cost, moves the low digits down one place and sets the highest.

A conversation may hold much of the table: rows are range-sorted once, blocks of
``BLOCK`` rows give a table of integers from every state to every other, and only these
tables meet by conversation.  That is exact: two cheapest ways through a block between
the same states never begin with each other, as the longer would have inserted more.

Nulls count as one space, in the number hashed for the damage as well; rows of equal
turn follow by role and text.  Rows without a conversation id are one conversation with
a null id.  Blank texts need no separate case, and very long ones are read one at a
time.  An empty table gives no row.  Columns beyond conv_id, turn, role and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .ordered_digest import ordered_sha256

#: Rows of a block: bounds what a task collects of one conversation.
BLOCK = 512
BLANK_CHARS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Octal digits of the initials, in ASCII order; 0 pads.
_DIGIT = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}
_LETTERS = str.maketrans("1234", DELETE + INSERT + KEEP + REROLE)
_DIGITS = str.maketrans(DELETE + INSERT + KEEP + REROLE, "1234")
_COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
_TRUNCATED = 1
#: States: 0 nothing yet, 1 after s, 2 after a, 3 after u.
_KEEP = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 2}
_NEXT = (3, 3, 3, 2)  # where a user or assistant row leads
_ROLE = ("user", "user", "user", "assistant")
#: What is still inserted at the end in each state.
_END = ("", "II", "", "I")
_EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_WAYS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("ways", pa.list_(pa.string()))])
_PLANS = pa.schema(
    [("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("blocks", pa.list_(pa.string()))]
)
_ACTIONS = pa.schema([("slot", pa.int64()), ("lead", pa.string()), ("role", pa.string()), ("kept", pa.bool_()), ("tail", pa.string())])


# ---- damage ----------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, copy): the rows after the damage that their hash says."""
    c, t = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn"))
    kind = F.crc32(F.concat(c, F.lit(":"), t).cast("binary")) % 20
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.filter(kind != 0).select(
        c.alias("key"),
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in order, stored: slot (their place), block, the role's initial and first faults.

    rows: (key, turn, role, text).  ``fault`` is blank, duplicate, truncated or null.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANK_CHARS)), F.lit(1))
    letter = F.left("role", F.lit(1))
    placed = stored(
        rows.select("key", "turn", "role", "text")
        .orderBy("key", F.col("turn").asc_nulls_first(), "role", "text")
        .select(
            "key", "turn", "role", "text",
            F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
            F.when(letter.isin("s", "u", "a"), letter).otherwise(F.lit("x")).alias("initial"),
            F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
            F.monotonically_increasing_id().alias("slot"),
        )
    )
    # copies are found by counts, so that a text said very often is no window
    firsts = (
        placed.groupBy("key", "digest")
        .agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", "digest", "first")
    )
    marks = (
        placed.select("key", "digest", "turn", "slot", "initial", "fault")
        .join(firsts, ["key", "digest"], "left")
        .withColumn(
            "fault",
            F.when((F.col("slot") > F.col("first")) & F.coalesce(F.col("fault") != "blank", F.lit(True)), "duplicate")
            .otherwise(F.col("fault")),
        )
        .withColumn("block", F.expr(f"slot div {BLOCK}"))
        .drop("digest", "first")
    )
    return placed.select("key", "slot", "role", "text"), stored(marks)


# ---- the shortest path -----------------------------------------------------------


def _before(value: int, cost: int, digit: int, bits: int) -> int:
    """The integer with an edit put in front."""
    low = value & ((1 << bits) - 1)
    return ((value >> bits) + cost) << bits | digit << (bits - 3) | low >> 3


def _least(*values: int | None) -> int | None:
    known = [v for v in values if v is not None]
    return min(known) if known else None


def _shown(value: int, bits: int) -> tuple[int, str]:
    digits = f"{value & ((1 << bits) - 1):0{bits // 3}o}".rstrip("0")
    return value >> bits, digits.translate(_LETTERS)


def _way(text: str) -> tuple[int, str]:
    cost, letters = text.split(" ")
    return int(cost), letters


def ways(initials: str, faults: str) -> list[str | None]:
    """Cheapest edits through a block, from each state (row) to each state (column).

    initials: s, u, a or x for every row; faults: b, d, t or a space.  Insertions stand
    before rows, not after the last.  A way is "cost letters", or None.
    """
    bits = 3 * max(1, 3 * len(initials))
    out: list[list[str | None]] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        value: list[int | None] = [None] * 4
        value[end] = 0
        for initial, fault in zip(reversed(initials), reversed(faults)):
            more = _TRUNCATED if fault == "t" else 0
            here: list[int | None] = []
            for state in range(4):
                found = []
                if value[state] is not None:
                    found.append(_before(value[state], _COST[DELETE], _DIGIT[DELETE], bits))
                if fault not in "bd":
                    to = _KEEP.get((state, initial))
                    if to is not None and value[to] is not None:
                        found.append(_before(value[to], more, _DIGIT[KEEP], bits))
                    if value[_NEXT[state]] is not None:
                        found.append(_before(value[_NEXT[state]], _COST[REROLE] + more, _DIGIT[REROLE], bits))
                here.append(min(found) if found else None)
            # at most two rows go in before a row: a third would be back where the first led
            added = [v and _before(v, _COST[INSERT], _DIGIT[INSERT], bits) for v in here]
            once = [added[_NEXT[s]] for s in range(4)]
            twice = [
                (v := added[_NEXT[_NEXT[s]]]) and _before(v, _COST[INSERT], _DIGIT[INSERT], bits) for s in range(4)
            ]
            value = [_least(here[s], once[s], twice[s]) for s in range(4)]
        for start in range(4):
            if value[start] is not None:
                cost, letters = _shown(value[start], bits)
                out[start][end] = f"{cost} {letters}"
    return [x for row in out for x in row]


def join_ways(blocks: list[list[str | None]]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, [(state before the block, its edits)]) of a whole conversation."""
    longest = [max(len(w) for w in b if w) for b in blocks]
    bits = 3 * (sum(longest) + 2)

    def integer(cost: int, letters: str, rest: int) -> int:
        """The edits of a way put in front of ``rest``."""
        size = 3 * len(letters)
        low = (rest & ((1 << bits) - 1)) >> size
        digits = int(letters.translate(_DIGITS), 8) << (bits - size) if letters else 0
        return ((rest >> bits) + cost) << bits | digits | low

    value = [integer(_COST[INSERT] * len(e), e, 0) for e in _END]
    choices = []
    for block in reversed(blocks):
        step, now = [0] * 4, [0] * 4
        for start in range(4):
            found = [
                (integer(*_way(w), value[end]), end) for end in range(4) if (w := block[4 * start + end]) is not None
            ]
            now[start], step[start] = min(found)
        value = now
        choices.append(step)
    cost, audit = _shown(value[0], bits)
    state, parts = 0, []
    for block, step in zip(blocks, reversed(choices)):
        parts.append((state, _way(block[4 * state + step[state]])[1]))
        state = step[state]
    return cost, audit, parts


def _lines(n: int, state: int) -> tuple[list[str], int]:
    out = []
    for _ in range(n):
        out.append(f"{_ROLE[state]}:")
        state = _NEXT[state]
    return out, state


def actions(initials: str, state: int, letters: str, is_last: bool) -> list[tuple]:
    """(lines before, new role, kept, lines after) for every row of a block."""
    out, rows, before = [], iter(initials), 0
    for letter in letters:
        if letter == INSERT:
            before += 1
            continue
        lead, state = _lines(before, state)
        before, initial = 0, next(rows)
        role = None
        if letter == REROLE:
            role, state = _ROLE[state], _NEXT[state]
        elif letter == KEEP:
            state = _KEEP[state, initial]
        out.append(["\n".join(lead) if lead else None, role, letter != DELETE, None])
    if is_last and (tail := _lines(len(_END[state]), state)[0]):
        out[-1][3] = "\n".join(tail)
    return out


# ---- Spark -----------------------------------------------------------------------


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield _batch(part, schema)
            part = []
    yield _batch(part, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _find_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield from _batches(
            ((r["key"], r["block"], len(r["initials"]), r["at"], ways(r["initials"], r["faults"])) for r in rows), _WAYS, 256
        )


def _find_plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plan(row: dict) -> tuple:
        cost, audit, parts = join_ways([p["ways"] for p in row["parts"]])
        blocks = [f"{state} {letters}" for state, letters in parts]
        return row["key"], cost, audit, blocks

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from _batches(map(plan, batch.slice(at, 64).to_pylist()), _PLANS, 64)


def _find_actions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for r in batch.to_pylist():
            state, letters = r["way"].split(" ")
            for k, action in enumerate(actions(r["initials"], int(state), letters, r["last"])):
                yield (r["at"] + k, *action)

    for batch in batches:
        yield from _batches(rows(batch), _ACTIONS, 1000)


def _schema(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, cost, audit and digest of the repair.

    rows: (key, turn, role, text), key being the conversation's name.
    """
    texts, marks = with_faults(rows)
    code = F.struct(
        "slot", "initial", F.coalesce(F.left("fault", F.lit(1)), F.lit(" ")).alias("fault")
    )
    blocks = stored(
        marks.groupBy("key", "block")  # at most BLOCK rows each
        .agg(F.array_sort(F.collect_list(code)).alias("rows"))
        .select(
            "key", "block", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"),
            F.col("rows")[0]["slot"].alias("at"),
        )
    )
    found = blocks.select("key", "block", "initials", "faults", "at").mapInArrow(_find_ways, _schema(_WAYS))
    plans = stored(
        found.groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("parts"))
        .select("key", "parts")
        .mapInArrow(_find_plans, _schema(_PLANS))
    )
    order = Window.partitionBy("key").orderBy("block")
    numbered = blocks.withColumn("rank", F.row_number().over(order) - 1)
    each = plans.select("key", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("rank", "way"))
    todo = numbered.join(each, ["key", "rank"]).select(
        "at", "initials", "way", (F.col("rank") == F.col("n_blocks") - 1).alias("last")
    )
    steps = todo.mapInArrow(_find_actions, _schema(_ACTIONS))
    own = F.when(F.col("kept"), F.concat(F.coalesce(steps["role"], texts["role"]), F.lit(":"), "text"))
    lines = texts.join(steps, "slot").select(
        F.col("key").cast("binary").alias("key"), "slot",
        F.when(F.coalesce("lead", own, "tail").isNotNull(), F.concat_ws("\n", "lead", own, "tail"))
        .cast("binary").alias("line"),
    )
    digests = ordered_sha256(lines, "key", ["slot"], "line", "\n").select(
        F.col("grp").cast("string").alias("key"), "sha256"
    )
    return _measures(marks, blocks).join(plans.select("key", "cost", "audit"), "key").join(digests, "key", "left")


def _measures(marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal)."""

    def fault(name: str) -> Column:
        return F.count_if(F.col("fault") == name).alias(name)

    counts = marks.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        fault("blank"), fault("duplicate"), fault("truncated"),
    )
    follow = Window.partitionBy("key").orderBy("block")  # a row a block
    with_next = F.concat("initials", F.coalesce(F.left(F.lead("initials").over(follow), F.lit(1)), F.lit("")))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("chain") - 1, F.lit(1))), lambda i: F.substring("chain", i, F.lit(2))
    )
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    illegal = (
        blocks.select("key", with_next.alias("chain"))
        .groupBy("key")
        .agg(F.sum(wrong).cast("long").alias("illegal"))
    )
    return counts.join(illegal, "key")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damage, then repair, every conversation: one row for each original id."""
    keys = conversations.select("conv_id").distinct().withColumn(
        "key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    )
    zero = F.lit(0).cast("long")
    found = repair(damage(conversations))
    return keys.join(found, "key", "left").select(
        "conv_id",
        *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256"),
    )
