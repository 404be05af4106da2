"""Evidence search: patterns out of review texts, literal search over the corpus.

A review may name up to three requests; each gives cleaned search patterns.  A
pattern is a literal substring looked up in every corpus line of its run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import byte_prefix, let, trimmed
from ..session import BROADCAST_BYTES, ZSTD, ZSTD_HARD, discard, durable, fitting, kept, kept_by, kept_in_turns

# Characters of a gram; shorter patterns are looked up whole.
GRAM = 3
# Words up to so many characters are cut by place.
LONG_WORD = 64
# Fills up the grams at a word's end.
FILL = "\u0001"
# Bytes of the keys that patterns are met by: the longest that fits.
KEYS = (8, 5, GRAM)
# Places of a block of a text.
BLOCK = 4096
# Bytes of a range of lines, the most ranges, and how many ``first_matches`` searches first.
RANGE_BYTES, MAX_RANGES, FIRST_RANGES = 1 << 20, 1024, 4
# Bytes of evidence that are put together at a time, and the most times.
TURN_BYTES, MAX_TURNS = 128 << 20, 32
MATCH = ("run_id", "pattern", "path", "line", "text")


def _unquoted(text: Column) -> Column:
    return F.btrim(trimmed(text), F.lit(fixed.QUOTES))


def request_items(text: Column) -> Column:
    """Raw requests of a text, first three distinct, cut at the pipe."""
    lines = F.regexp_extract_all(text, F.lit(fixed.SEARCH_LINE), 1)
    quoted = F.regexp_extract_all(text, F.lit(fixed.SEARCH_QUOTED), 1)
    names = F.filter(
        F.regexp_extract_all(text, F.lit(fixed.SEARCH_IDENTIFIER), 1),
        lambda x: F.octet_length(x) > 6,
    )
    raw = F.filter(F.transform(F.concat(lines, quoted, names), _unquoted), lambda x: x != "")
    first = F.slice(F.array_distinct(raw), 1, fixed.MAX_REQUESTS)
    return F.flatten(F.transform(first, lambda x: F.split(x, r"\|")))


def _worth_searching(pattern: Column) -> Column:
    return (F.octet_length(pattern) >= 3) & ~pattern.isin(*fixed.STOP_PATTERNS)


def _longest_name(pattern: Column) -> Column:
    """Longest identifier over five bytes (earliest wins a tie), or null."""
    names = F.filter(
        F.regexp_extract_all(pattern, F.lit(fixed.PATTERN_IDENTIFIER), 0),
        lambda x: (F.octet_length(x) > 5) & ~x.isin(*fixed.STOP_PATTERNS),
    )
    scored = F.transform(
        names, lambda x, i: F.struct((-F.octet_length(x)).alias("n"), i.alias("i"), x.alias("name"))
    )
    return F.array_min(scored)["name"]


def _step(values: Column, fn) -> Column:
    return F.transform(values, fn)


def clean_items(requests: Column) -> Column:
    """Search patterns of raw requests: cleaned, distinct, first six."""
    step = _step(requests, _unquoted)
    step = _step(step, lambda x: F.regexp_replace(x, fixed.PATTERN_CLASSES, ""))
    step = _step(step, lambda x: F.regexp_replace(x, fixed.PATTERN_ESCAPE, "$1"))
    step = F.filter(step, _worth_searching)
    step = _step(
        step,
        lambda x: F.when(
            x.rlike(fixed.PATTERN_FILE_PREFIX),
            trimmed(F.regexp_extract(x, fixed.PATTERN_FILE_PREFIX, 1)),
        ).otherwise(x),
    )
    step = F.filter(step, lambda x: ~x.rlike(fixed.PATTERN_DIGITS))
    step = _step(
        step,
        lambda x: F.when(
            F.contains(x, F.lit(", ")) | (F.octet_length(x) > 60), F.coalesce(_longest_name(x), x)
        ).otherwise(x),
    )
    step = F.filter(step, _worth_searching)
    return F.slice(F.array_distinct(step), 1, fixed.MAX_PATTERNS)


def search_requests(reviews: DataFrame, keys: list[str], text: str = "reasoning") -> DataFrame:
    items = F.filter(request_items(F.col(text)), lambda x: x.isNotNull())
    return reviews.select(*keys, F.posexplode(items).alias("pos", "request"))


def clean_patterns(reviews: DataFrame, keys: list[str], text: str = "reasoning") -> DataFrame:
    staged = reviews.select(*keys, request_items(F.col(text)).alias("_requests"))
    items = F.filter(clean_items(F.col("_requests")), lambda x: x.isNotNull())
    return staged.select(*keys, F.posexplode(items).alias("pos", "pattern"))


# ---- search --------------------------------------------------------------------


def _grams(text: Column, size: int) -> Column:
    """Distinct character n-grams of a text in one linear pass."""

    def cut(chars: Column) -> Column:
        count = F.greatest(F.size(chars) - (size - 1), F.lit(0))
        return F.transform(
            F.slice(chars, F.lit(1), count),
            lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, size)]),
        )

    return F.array_distinct(let(F.split(text, ""), cut))


def with_ids(lines: DataFrame) -> DataFrame:
    """Lines with a number each, stored, so that keys are short and stay the same."""
    return kept(lines.select("run_id", "path", "line", "text", F.monotonically_increasing_id().alias("line_id")))


def _words(text: Column, blanks: str = r"\s+") -> Column:
    return F.array_distinct(F.filter(F.split(text, blanks), lambda x: x != ""))


def postings(lines: DataFrame, blanks: str = r"\s+") -> DataFrame:
    """(run_id, word, line_id): which lines hold which words, runs of characters between blanks."""
    return lines.select("run_id", "line_id", F.explode(_words(F.col("text"), blanks)).alias("word"))


def vocabulary(places: DataFrame) -> DataFrame:
    """(run_id, word, n): the runs of characters of a corpus and the lines that hold them."""
    return places.groupBy("run_id", "word").agg(F.count(F.lit(1)).alias("n"))


def _pieces(patterns: DataFrame) -> DataFrame:
    """A pattern's words; the first and the last may be a part of a word of the line."""
    cut = patterns.withColumn("_p", F.split("pattern", r"\s+")).select(
        "run_id", "pattern", F.size("_p").alias("n_pieces"), F.posexplode("_p").alias("at", "piece")
    )
    return cut.filter("piece <> ''").select(
        "run_id", "pattern", "n_pieces", "piece", (F.col("at") == 0).alias("first"), (F.col("at") == F.col("n_pieces") - 1).alias("last")
    )


def word_grams(words: DataFrame) -> DataFrame:
    """(run_id, gram, word, n): the vocabulary by grams; those at a word's end are filled up.

    A gram that stands twice in a short word comes twice; cutting it out by place is the
    quick way there, and would be quadratic in a long word.
    """
    filled = words.select("run_id", "word", "n", F.concat("word", F.lit(FILL * (GRAM - 1))).alias("_f"))
    places = F.sequence(F.lit(1), F.length("word"))
    short = filled.filter(F.length("word") <= LONG_WORD).select("*", F.explode(places).alias("_at"))
    by_place = short.select("run_id", F.substring("_f", F.col("_at"), F.lit(GRAM)).alias("gram"), "word", "n")
    long = filled.filter(F.length("word") > LONG_WORD)
    return by_place.unionByName(long.select("run_id", F.explode(_grams(F.col("_f"), GRAM)).alias("gram"), "word", "n"))


def gram_counts(grams: DataFrame) -> DataFrame:
    """(run_id, gram, n): the lines whose words hold a gram, a word standing for all its lines."""
    return grams.groupBy("run_id", "gram").agg(F.sum("n").alias("n"))


def candidate_words(patterns: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """(run_id, pattern, n_pieces, word): every line that holds a pattern holds such a word.

    A pattern's anchor is its gram, at any place in it, that the fewest lines hold.  A
    pattern without a piece of ``GRAM`` characters is looked up by all grams that begin
    with its longest piece.
    """
    pieces = _pieces(patterns.select("run_id", "pattern").distinct())
    mine = pieces.filter(F.length("piece") >= GRAM).select("*", F.explode(_grams(F.col("piece"), GRAM)).alias("gram"))
    # a gram that no line holds ends the search for its pattern
    choice = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "piece", "first", "last")
    of_one = (
        mine.join(counts, ["run_id", "gram"], "left")
        .groupBy("run_id", "pattern", "n_pieces")
        .agg(F.min(choice).alias("a"), F.lit(True).alias("_long"))
        .filter("a.n > 0")
    )
    size = F.length("piece")
    longest = pieces.groupBy("run_id", "pattern", "n_pieces").agg(
        F.max(F.struct(size.alias("size"), "piece", "first", "last")).alias("s")
    )
    heads = counts.select("run_id", "gram", F.posexplode(F.array(*[F.left("gram", F.lit(k)) for k in range(1, GRAM)])).alias("_k", "head"))
    of_many = longest.filter(F.col("s.size") < GRAM).join(
        heads.filter(F.length("head") == F.col("_k") + 1).withColumnRenamed("run_id", "_r"),
        (F.col("run_id") == F.col("_r")) & (F.col("s.piece") == F.col("head")),
    )
    columns = ["run_id", "pattern", "n_pieces"]
    anchors = of_one.select(*columns, "a.gram", "a.piece", "a.first", "a.last").unionByName(
        of_many.select(*columns, "gram", "s.piece", "s.first", "s.last")
    )
    fits = (
        F.when(F.col("first") & F.col("last"), F.contains("word", "piece"))
        .when(F.col("first"), F.endswith("word", F.col("piece")))
        .when(F.col("last"), F.startswith("word", F.col("piece")))
        .otherwise(F.col("word") == F.col("piece"))
    )
    theirs = word_grams(words).select("run_id", "gram", "word")
    found = theirs.join(fitting(durable(anchors)), ["run_id", "gram"]).filter(fits)
    return found.select(*columns, "word").distinct()


def search_places(places: DataFrame, words_of: DataFrame, lines: DataFrame) -> DataFrame:
    """Every (pattern, line) of a run where the line holds the pattern, with the line's text.

    ``places`` are the ``postings`` of ``lines``, ``words_of`` the ``candidate_words`` of the
    patterns.  Only keys are shuffled to find candidate lines; the text is fetched once a line.
    """
    wanted = fitting(durable(words_of))
    lines_of = places.join(wanted, ["run_id", "word"]).select("line_id", "pattern", "n_pieces")
    # a pattern of one piece may stand in several words of a line; the text meets the same shuffle
    candidates = lines_of.repartition("line_id").dropDuplicates(["line_id", "pattern"])
    held = candidates.join(lines, "line_id")
    return held.filter((F.col("n_pieces") == 1) | F.contains("text", "pattern")).select(*MATCH)


def search_blanks(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same for patterns of blanks alone: blanks take the place of words."""
    places = postings(lines, r"\S+")
    words = kept(vocabulary(places))
    size = F.length("pattern")
    whole = patterns.select("run_id", "pattern", size.alias("size")).distinct()
    # a run of blanks holds few distinct patterns: those that stand at one of its places
    cuts = words.select("run_id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    held = cuts.select(
        "run_id", "word", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("at") + 1)).alias("size"), "at"
    ).select("run_id", "word", F.substring("word", F.col("at"), F.col("size")).alias("pattern"))
    words_of = held.distinct().join(whole.select("run_id", "pattern"), ["run_id", "pattern"])
    return search_places(places, words_of.withColumn("n_pieces", F.lit(1)), lines)


def _cut(lines: DataFrame, size: int) -> DataFrame:
    """The lines once a place of their text, with its bytes: ``_at`` (from 1) and the ``gram`` of ``size`` bytes there.

    A gram is cut from bytes by its offset, so a place of a long line costs no more than one of a
    short line; places are made in blocks, so that no list of them grows with a line.
    """
    held = lines.filter(F.octet_length("text") >= size).withColumn("_raw", F.col("text").cast("binary"))
    last = F.octet_length("_raw") - size
    blocks = held.select("*", F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK))).alias("_b"))
    count = F.least(last + 1 - F.col("_b"), F.lit(BLOCK))
    places = blocks.select("*", F.explode(F.sequence(F.lit(1), count)).alias("_k")).withColumn("_at", F.col("_b") + F.col("_k"))
    return places.select(*lines.columns, "_raw", "_at", F.substring("_raw", F.col("_at"), F.lit(size)).alias("gram"))


def _anchors(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(run_id, pattern, size, off, h): a gram of each pattern, where it stands in it, and its hash with the run.

    It is the gram that stands at the fewest places of the run's lines, widened to the longest
    of ``KEYS`` that the pattern has.  A pattern shorter than ``GRAM`` is its own gram.
    """
    asked = durable(patterns.select("run_id", "pattern").filter("pattern <> '' AND run_id IS NOT NULL").distinct())
    hashed = F.xxhash64("run_id", "gram").alias("h")
    counts = _cut(lines.select("run_id", "text"), GRAM).groupBy(hashed).agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length("pattern")
    mine = asked.filter(size >= GRAM).withColumn("_raw", F.col("pattern").cast("binary"))
    mine = mine.select("*", F.explode(F.sequence(F.lit(1), size - (GRAM - 1))).alias("off"))
    mine = mine.select("run_id", "pattern", "off", F.substring("_raw", F.col("off"), F.lit(GRAM)).alias("gram"))
    # a gram that no line holds ends the search for its pattern
    choice = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off")
    rare = (
        mine.select("run_id", "pattern", "off", hashed).join(counts, "h", "left")
        .groupBy("run_id", "pattern").agg(F.min(choice).alias("a")).filter("a.n > 0")
    )
    key = F.when(size >= KEYS[0], KEYS[0]).when(size >= KEYS[1], KEYS[1]).otherwise(GRAM)
    # the rarest gram stands in the middle of its key, or where the pattern leaves room
    first = F.greatest(F.lit(1), F.least(F.col("a.off") - F.when(key == KEYS[0], 2).when(key == KEYS[1], 1).otherwise(0), size - key + 1))
    short = asked.filter(size < GRAM).select("run_id", "pattern", size.alias("size"), F.lit(1).alias("off"))
    every = rare.select("run_id", "pattern", key.alias("size"), first.alias("off")).unionByName(short)
    gram = F.substring(F.col("pattern").cast("binary"), F.col("off"), F.col("size"))
    return durable(every.withColumn("gram", gram).select("run_id", "pattern", "size", "off", hashed))


def _blocks(anchors: DataFrame) -> list[tuple[list[str] | None, DataFrame]]:
    """The anchors in blocks that may be broadcast, each with the runs it is about (None: all).

    A block holds whole runs, so that each line meets one block; a run too large for one has several.
    """
    width = F.octet_length("run_id") + F.octet_length("pattern") + 16 + 8 * len(anchors.columns)
    # one row a run
    sizes = anchors.groupBy("run_id").agg(F.sum(width.cast("long")).alias("n")).collect()
    if sum(r.n for r in sizes) <= BROADCAST_BYTES:
        return [(None, anchors)] if sizes else []
    blocks, runs, held = [], [], 0
    for run, n in sorted((r.run_id, r.n) for r in sizes):
        parts = -(-n // BROADCAST_BYTES)
        if parts > 1:
            mine = anchors.filter(F.col("run_id") == run)
            turn = F.pmod(F.xxhash64("pattern"), F.lit(parts))
            blocks += [([run], mine.filter(turn == k)) for k in range(parts)]
            continue
        if held + n > BROADCAST_BYTES:
            blocks.append(runs)
            runs, held = [], 0
        runs, held = [*runs, run], held + n
    blocks.append(runs)
    return [b if isinstance(b, tuple) else (b, anchors.filter(F.col("run_id").isin(b))) for b in blocks if b]


def _stands_first() -> Column:
    """Whether the pattern stands behind the first ``_at`` bytes of the text, and nowhere before.

    The bytes there are compared first, as most places hold the gram alone; only where the pattern
    stands is the text read, up to its first occurrence.
    """
    at, pattern = F.col("_at"), F.col("pattern").cast("binary")
    here = (at >= 0) & (F.substring("_raw", at + 1, F.octet_length("pattern")) == pattern)
    return here & (F.expr("octet_length(substring_index(text, pattern, 1))") == at)


def _search(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """``lines`` with every ``pattern`` that stands in them, each once: no row of it is shuffled.

    Of the places that hold a pattern's gram, the one inside the pattern's first occurrence counts.
    """
    out = lines.withColumn("pattern", F.lit("")).filter("false")
    sizes = [r.size for r in anchors.select("size").distinct().collect()]
    for runs, block in _blocks(anchors):
        mine = lines if runs is None else lines.filter(F.col("run_id").isin(runs))
        for size in sizes:
            keys = block.filter(F.col("size") == size).select("h", F.col("run_id").alias("_r"), "pattern", "off")
            found = _cut(mine, size).withColumn("h", F.xxhash64("run_id", "gram")).join(F.broadcast(keys), "h")
            found = found.withColumn("_at", F.col("_at") - F.col("off")).filter(_stands_first())
            # not as an equation, which would become a key of the join: one number is met much faster
            out = out.unionByName(found.filter(F.col("run_id").between(F.col("_r"), F.col("_r"))).select(*lines.columns, "pattern"))
    return out


def corpus_search(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every (pattern, line) of a run where the line holds the pattern literally.

    The patterns, small beside the corpus, are sent to the lines in blocks of bounded size and met by
    their rarest gram, so matches, which may be many times the corpus, are made in the last step and
    never moved.  To search one corpus often, keep a ``search_index.SearchIndex`` of it.
    """
    stored = kept(lines.select("run_id", "path", "line", "text"))
    return _search(stored, _anchors(stored, patterns)).select(*MATCH)


def _place() -> list[Column]:
    """The order of the lines that a pattern is shown: definitions, then headers, then by place."""
    return [F.contains("text", F.lit("#define")).desc(), F.endswith("path", F.lit(".h")).desc(), F.col("path"), F.col("line")]


def first_matches(lines: DataFrame, patterns: DataFrame, limit: int = fixed.MAX_MATCHES) -> DataFrame:
    """``top_matches(corpus_search(lines, patterns))`` without making all matches."""
    best, stored = first_places(lines, patterns, limit)
    return _quoted(best, stored)


def _quoted(best: DataFrame, stored: DataFrame) -> DataFrame:
    return best.join(stored.drop("run_id"), "_place").select(*MATCH, "rn")


def first_places(lines: DataFrame, patterns: DataFrame, limit: int = fixed.MAX_MATCHES) -> tuple[DataFrame, DataFrame]:
    """The first matches as (run_id, pattern, n_bytes, _place, rn), and the stored lines with their ``_place``.

    The lines are stored in the order that ranks them and searched from the front, four times as many
    in each turn; a pattern with ``limit`` matches takes no part in later turns.  So a pattern makes
    a few times ``limit`` matches, however common it is.  No text is moved; ``n_bytes`` tells how
    much of it will be shown.
    """
    given = kept(lines.select("run_id", "path", "line", "text", F.monotonically_increasing_id().alias("_place")))
    shown = F.least(F.octet_length("text"), F.lit(fixed.MAX_MATCH_BYTES)).alias("n_bytes")
    match = ["run_id", "pattern", shown, "_place"]
    size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    anchors = _anchors(given, patterns)
    n = max(1, min(MAX_RANGES, size // RANGE_BYTES))
    if n <= FIRST_RANGES:
        return top_matches(_search(given, anchors), limit).select(*match, "rn"), given
    # the upper bits of the id are the partition, so ids rise in the order of the lines
    placed = given.drop("_place").repartitionByRange(n, *_place()).sortWithinPartitions(*_place())
    stored = kept(placed.withColumn("_place", F.monotonically_increasing_id()))
    discard(given)
    ranked = Window.partitionBy("run_id", "pattern").orderBy("_place")
    found, start, width = None, 0, FIRST_RANGES
    while start < n:
        here = stored.filter((F.col("_place") >= start << 33) & (F.col("_place") < (start + width) << 33))
        hits = _search(here.select("run_id", "text", "_place"), anchors).select(*match)
        more = kept(hits.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= limit).drop("rn"))
        found = more if found is None else found.unionByName(more)
        start, width = start + width, width * 4
        if start < n:
            full = found.groupBy("run_id", "pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
            anchors = durable(anchors.join(full, ["run_id", "pattern"], "left_anti"))
    return found.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= limit), stored


def _shown_lines(best: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored lines that some pattern shows, as much of them as is shown, dealt by ``_place``."""
    count = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = stored.repartition(count, "_place").join(best.select("_place").distinct(), "_place", "left_semi")
    # a text that is too long stays too long
    return kept_by(wanted.withColumn("text", byte_prefix(_plain(F.col("text")), fixed.MAX_MATCH_BYTES + 4)), "_place")


def search_all(places: DataFrame, words: DataFrame, counts: DataFrame, lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns with words through the index, those of blanks alone beside it."""
    asked = durable(patterns.select("run_id", "pattern").filter("pattern <> ''").distinct())
    found = search_places(places, candidate_words(asked, words, counts), lines)
    blank = asked.filter(~F.col("pattern").rlike(r"\S"))
    return found if blank.isEmpty() else found.unionByName(search_blanks(lines, blank))


def top_matches(matches: DataFrame, limit: int = fixed.MAX_MATCHES) -> DataFrame:
    """First ``limit`` lines per pattern: definitions, then headers, then by place."""
    order = Window.partitionBy("run_id", "pattern").orderBy(*_place())
    return matches.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)


def _plain(text: Column) -> Column:
    return F.replace(text, F.char(F.lit(0)), F.lit(""))


def pattern_blocks(patterns: DataFrame, top: DataFrame) -> DataFrame:
    """(run_id, pattern, block): the fenced lines of each pattern, or a note."""
    text = _plain(F.col("text"))
    cut = F.when(
        F.octet_length(text) > fixed.MAX_MATCH_BYTES,
        F.concat(byte_prefix(text, fixed.MAX_MATCH_BYTES), F.lit("...")),
    ).otherwise(text)
    shown = top.select(
        "run_id",
        "pattern",
        "rn",
        F.concat_ws(":", "path", F.col("line").cast("string"), cut).alias("shown"),
    )
    # at most MAX_MATCHES short lines per group
    body = shown.groupBy("run_id", "pattern").agg(
        F.array_sort(F.collect_list(F.struct("rn", "shown"))).alias("_lines")
    )
    return (
        patterns.select("run_id", "pattern")
        .distinct()
        .join(body, ["run_id", "pattern"], "left")
        .select(
            "run_id",
            "pattern",
            F.format_string(
                fixed.EVIDENCE_BLOCK,
                "pattern",
                F.coalesce(F.array_join(F.col("_lines.shown"), "\n"), F.lit(fixed.NO_MATCHES)),
            ).alias("block"),
        )
    )


def evidence_blocks(
    requested: DataFrame, blocks: DataFrame, keys: list[str]
) -> DataFrame:
    """Blocks of one review joined in request order: keys, evidence."""
    # at most MAX_PATTERNS blocks per group
    return (
        requested.join(blocks, ["run_id", "pattern"])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("_blocks"))
        .select(*keys, F.array_join(F.col("_blocks.block"), "\n\n").alias("evidence"))
    )


def gather_evidence(
    reviews: DataFrame,
    lines: DataFrame,
    keys: list[str],
    text: str,
    together: list[str] | None = None,
    finish: Callable[[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]], DataFrame] | None = None,
) -> DataFrame:
    """Requests, search, ranking and blocks in one: keys, evidence.

    Evidence is many times the lines that it quotes, so it is put together for some of the reviews at
    a time, and stored.  Turns read the lines that are shown from a table dealt by line, so no turn moves
    them, and what only the turns need is removed after them.  Reviews equal in ``together`` (by default ``keys``) have the same turn.
    ``finish``, given the reviews of a turn, their evidence, and a function that leaves the turn's rows
    of any table with the columns ``together``, makes the rows that are stored instead.
    """
    told = kept(reviews) if finish else reviews
    requested = kept(clean_patterns(told, keys, text))
    places, stored = first_places(lines, requested)
    best = kept(places)
    shown = requested.join(best.groupBy("run_id", "pattern").agg(F.sum("n_bytes").alias("n")), ["run_id", "pattern"])
    size = shown.agg(F.sum("n")).first()[0] or 0
    turns = max(1, min(MAX_TURNS, -(-size // TURN_BYTES)))
    quoted = _shown_lines(best, stored)
    discard(stored)

    def make(turn: int) -> DataFrame:
        def mine(rows: DataFrame) -> DataFrame:
            return rows.filter(F.pmod(F.xxhash64(*(together or keys)), F.lit(turns)) == turn) if turns > 1 else rows

        asked = mine(requested)
        top = _quoted(best.join(asked.select("run_id", "pattern").distinct(), ["run_id", "pattern"], "left_semi"), quoted)
        found = evidence_blocks(asked, pattern_blocks(asked, top), keys)
        return finish(mine(told), found, mine) if finish else found

    out = kept_in_turns(make, turns, ZSTD_HARD if turns > 1 else ZSTD)
    for table in (quoted, best, requested, *([told] if finish else [])):
        discard(table)
    return out


def condense_evidence(text: Column) -> Column:
    """Keep the text before the evidence and at most six of its lines."""
    marker = "\n\n[GREP RESULTS"
    at = F.instr(text, marker)
    before = F.left(text, at - 1)
    lines = F.transform(F.split(F.substring(text, at, F.length(text)), "\n"), trimmed)
    empty = F.expr("named_struct('kept', cast(array() as array<string>), 'full', false)")

    def take(acc: Column, line: Column) -> Column:
        frame = (line == "") | F.startswith(line, F.lit("```")) | F.startswith(line, F.lit("GREP `"))
        missing = F.contains(line, F.lit("(no matches"))
        more = F.when(
            missing | F.contains(line, F.lit(":")),
            F.array_append(acc["kept"], F.concat(F.lit("- "), line)),
        ).otherwise(acc["kept"])
        # notes about missing matches do not close the list, other lines do
        full = ~missing & (F.size(more) >= fixed.MAX_CONDENSED)
        return F.when(acc["full"] | frame, acc).otherwise(
            F.struct(more.alias("kept"), full.alias("full"))
        )

    kept = F.aggregate(lines, empty, take, lambda acc: acc["kept"])
    short = F.array_join(kept, "\n")
    return (
        F.when(at == 0, text)
        .when(F.size(kept) == 0, before)
        .otherwise(F.concat(before, F.lit(fixed.CONDENSED_HEADING), short))
    )
