"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    conversation_repair,
    html_text,
    language_id,
    license_scan,
    line_frequency,
    minhash,
    packing,
    phrase_prints,
    prefix_trie,
    secret_scan,
    substring_dedup,
    warc,
)
from .common import stored, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language_id.train(docs.filter(~language_id.held_out()))
    predicted = docs.select(
        "doc_id", language_id.held_out().alias("held_out"), language_id.predictor(*learned)("text").alias("p")
    )
    return predicted.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.groups(docs, threshold_pct=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = line_frequency.rate(table(spark, sf_dir, "documents"))
    return rated.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "removed_words",
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_text.extract("html").alias("text"))


def op7_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_prints.compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_page").alias("refers_to"), "error",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = packing.shared_file(docs, public_tokenizers.path("word_bpe_49k.json"))
    both = docs.select("doc_id", bpe.encoder(shared)("text").alias("ids")).withColumn(
        "decoded", bpe.decoder(shared)("ids")
    )
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(
        table(spark, sf_dir, "conversations"), prefix_trie.branched_conversations
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    show = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in secret_scan.KINDS],
        F.sha2(show(F.filter("spans", lambda x: x["kind"].isin(*secret_scan.KINDS))), 256).alias("base_sha256"),
        show(F.col("spans")).alias("spans"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_substring_dedup,
    op2_packing,
    op3_language_id,
    op4_minhash,
    op5_line_frequency,
    op6_html_text,
    op7_phrase_prints,
    op8_warc,
    op9_license_scan,
    op10_bpe,
    op11_prefix_trie,
    op12_secret_scan,
    op13_conversation_repair,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
