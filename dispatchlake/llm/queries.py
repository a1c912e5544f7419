"""Registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.llm import exact, lines, matrices, merkle, ngrams, packing, periods, pieces, pii, quality, toxicity, warc, winnow
from dispatchlake.llm.common import documents, tokenizer_path


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    found = pii.find(documents(spark, folder))
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document."""
    coded = pieces.encode(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    packed = packing.pack(documents(spark, folder), tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and verdict of every document."""
    judged = quality.judge(documents(spark, folder))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = documents(spark, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document among those that share nine tenths of their word triples."""
    return ngrams.link(documents(spark, folder), width=3, percent=90).drop("text_key")


def op7_token_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Matrix rows of 2048 ids of all documents."""
    packed = matrices.pack(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), end_id=50256, pad_id=50256, capacity=2048)
    return packed.select("sequence_id", F.crc32("ids").alias("ids_crc32"), "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "starts")


def op8_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion record of every page."""
    records = warc.derive(warc.responses(spark.read.parquet(f"{folder}/pages.parquet")))
    return records.withColumn("record_sha256", F.sha2(warc.serialized(), 256)).drop("headers", "source_headers")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every line of all documents: words within one edit of an earlier line."""
    return lines.judge(documents(spark, folder)).drop("text_key", "row")


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact.deduplicate(documents(spark, folder)).drop("text_key", "n_chunks")


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a benchmark window of ten words, and the items they come from."""
    found = winnow.contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; every second one, by checksum, is shown without its line ends."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claims = {"text": F.when(altered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return merkle.manifest(documents(spark, folder), claims=claims, proofs=False).drop("source")


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by checksum, with the rest after some word repeating a stretch."""
    if doc_id is None or not words:
        return words
    spread, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    n = len(words)
    start = spread % n
    period = 1 + (n - start) // (3 + spread % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, after a period was laid over every tenth."""
    found = periods.find(documents(spark, folder), edit=with_period)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_token_matrices": op7_token_matrices,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
