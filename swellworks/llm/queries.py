"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.warc import archive_round_trip

    out = archive_round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from swellworks.llm.simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.licenses import licenses

    return licenses(_table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from swellworks.llm.token_files import encode_corpus, with_digest

    return with_digest(encode_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.jpeg import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op6_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.rlz import removed

    return removed(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from swellworks.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.toxicity import scored

    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swellworks.llm.suffix import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_tokens": op4_tokens,
    "op5_jpeg": op5_jpeg,
    "op6_rlz": op6_rlz,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_suffix": op10_suffix,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH q AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b FROM pages),
w AS (SELECT d, max(page_id) AS m FROM q WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, q.d AS payload_digest,
  CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM q LEFT JOIN w ON q.d = w.d""",
}
