"""A stored index of a corpus, so that a run reads its lines once however often it searches.

The index holds the lines, the runs of characters of each line (bucketed by run and word,
so that a search moves only its own side), the vocabulary with the counts of its grams,
and the first matches of every pattern that was looked up.  A pattern that an earlier round or another review has asked
for is not searched again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, kept, scratch_dir
from . import evidence as ev

FOUND = "run_id string, pattern string, rn int, path string, line int, text string"


class SearchIndex:
    """Index of ``lines`` (run_id, path, line, text); ``buckets`` should grow with the corpus."""

    def __init__(self, lines: DataFrame, folder: str | None = None, buckets: int | None = None):
        self.spark = lines.sparkSession
        name = uuid.uuid4().hex
        self.folder = folder or f"{scratch_dir(self.spark)}/index-{name}"
        count = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.lines = ev.with_ids(lines)
        keys = ["run_id", "word"]
        (
            ev.postings(self.lines)
            .repartition(count, *keys)  # one file a bucket
            .write.bucketBy(count, *keys)
            .sortBy(*keys)
            .option("path", f"{self.folder}/places")
            .saveAsTable(f"places_{name}")
        )
        self.places = self.spark.table(f"places_{name}")
        self.words = kept(ev.vocabulary(self.places))
        self.counts = kept(ev.gram_counts(ev.word_grams(self.words)))
        self.spark.createDataFrame([], FOUND).write.parquet(f"{self.folder}/found")

    def found(self) -> DataFrame:
        """First matches of all patterns looked up; a pattern without any has a row without a path."""
        return self.spark.read.schema(FOUND).parquet(f"{self.folder}/found")

    def look_up(self, patterns: DataFrame) -> DataFrame:
        """Search the patterns (run_id, pattern) that nobody has asked for; returns those."""
        known = self.found().select("run_id", "pattern").distinct()
        fresh = durable(
            patterns.select("run_id", "pattern").distinct().join(known, ["run_id", "pattern"], "left_anti")
        )
        if fresh.isEmpty():
            return fresh
        hits = ev.top_matches(ev.search_all(self.places, self.words, self.counts, self.lines, fresh))
        rows = fresh.join(hits, ["run_id", "pattern"], "left")
        # one job commits the patterns with their matches: a lost one leaves neither
        rows.select(*[F.col(f.split()[0]) for f in FOUND.split(", ")]).write.mode("append").parquet(
            f"{self.folder}/found"
        )
        return fresh

    def evidence(self, reviews: DataFrame, keys: list[str], text: str) -> DataFrame:
        """(keys, evidence): the blocks of matches that each review asks for."""
        requested = durable(ev.clean_patterns(reviews, keys, text))
        self.look_up(requested)
        asked = requested.select("run_id", "pattern").distinct()
        top = self.found().filter(F.col("path").isNotNull()).join(asked, ["run_id", "pattern"], "left_semi")
        return ev.evidence_blocks(requested, ev.pattern_blocks(requested, top), keys)


def indexed(lines: DataFrame | SearchIndex) -> SearchIndex:
    return lines if isinstance(lines, SearchIndex) else SearchIndex(lines)
