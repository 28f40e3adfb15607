"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ambientspark.llm import alignment, classifier, decontaminate, licenses, oracles, packing, periods, personal, quality, repeats, secrets, simhash, toxicity, warc
from ambientspark.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = "quality_metrics"
    return quality.judged(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[f"{m}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.license_spans(read_table(spark, sf_dir, "documents"))).drop("spans")


def word_vocabulary() -> str:
    """Where the installed tokenizer files have the word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(read_table(spark, sf_dir, "documents"), word_vocabulary())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digest(personal.personal_spans(read_table(spark, sf_dir, "documents")))


def capture_records(pages: DataFrame) -> DataFrame:
    """Every page as a full response in order of page_id, and a later not-modified revisit of each with that response's validator."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = 86_400
    full = pages.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "url", (F.col("page_id") * 600).alias("at"), F.lit("response").alias("kind"), F.lit(200).alias("http_status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("no-cache")).alias("headers"), F.md5("html").alias("payload_digest"))
    again = pages.select(
        F.concat(F.lit("v"), "page_id").alias("record_id"), "url", (F.col("page_id") * 600 + 400 * day).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"),
        F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return full.unionByName(again)


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(capture_records(read_table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", "url_key", "at", "response_id", "status", text.alias("headers"), "payload_digest")


def op6_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.without_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("repository"), F.col("source").alias("owner"))
    return secrets.secret_digest(secrets.secret_spans(docs))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_toxicity_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digest(periods.periodic_runs(periods.with_made_periods(read_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_license_scan, op3_best_fit_packing, op4_personal_data, op5_revisits, op6_quality_neighbours,
    op7_repeated_bytes, op8_secret_ownership, op9_simhash_anchors, op10_benchmark_leaks, op11_toxicity_distance, op12_token_alignment,
    op13_periodic_runs)}
ORACLES = {"op1_quality_rules": oracles.QUALITY, "op5_revisits": oracles.REVISITS}
