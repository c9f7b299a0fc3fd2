"""Registered queries of the text operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, near_dup, oracles, packing, pii, quality, repeats, topk, toxicity, url_rules, warc, whitening
from .common import read


def op1_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector id."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=20, query_divisor=20, scale=64.0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back; a record that isn't read is an error."""
    found = warc.archive_pages(read(spark, sf_dir, "pages"), with_payload=False, complete=True).where("gap_reason is null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents over two-word shingles."""
    found = near_dup.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2, percent=80)
    return found.withColumnRenamed("row_id", "doc_id")


def op5_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; every fifth of the id hashes is held out."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, exclude_fold=(5, 0)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), capacity=4096)


#: (verdict, host, path) of the rules that op7 applies.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest fitting rule of every page."""
    return url_rules.judge(read(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; every third of the id hashes is held out."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), exclude_fold=(3, 1))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.DECISION).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item."""
    return decontam.find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; every third of the id hashes is held out."""
    found = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), exclude_fold=(3, 1))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "page_score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every usable vector, a row for each."""
    rows, model, error = whitening.whiten(read(spark, sf_dir, "embeddings"), "embedding", most=8, scale=1024.0, offset=100_000)
    explained = F.array(*[F.lit(float(e)) for e in model.explained[:8]]).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.moments.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, "i").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the 50-byte strings that a document of a smaller id has."""
    found = repeats.find_repeats(read(spark, sf_dir, "documents"), span=50)
    left = F.octet_length("kept").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    return {f.__name__: f for f in (op1_block_top_k, op2_warc, op3_private_data, op4_hyperminhash, op5_compression_language, op6_best_fit_packing, op7_url_rules, op8_toxicity, op9_decontamination, op10_co_training, op11_whitening, op12_run_length_repeats)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where whole tables are within its reach."""
    return {
        "op1_block_top_k": oracles.TOP_K,
        "op2_warc": oracles.WARC,
        "op4_hyperminhash": oracles.NEAR_DUPLICATES,
        "op7_url_rules": oracles.URL_RULES,
        "op9_decontamination": oracles.DECONTAMINATION,
        "op12_run_length_repeats": oracles.REPEATS,
    }
