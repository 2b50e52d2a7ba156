"""The corpus pipeline: toxicity, near-dedup, repeats, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, whatever their names.  Null texts count as empty (and are near-duplicates of each other), rows without a
doc_id pass the near-dedup stage, rows that share a doc_id are documents of their own, and an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from swellworks.llm import bpe, decontaminate, simhash, suffix, toxicity
from swellworks.llm.runtime import Workspace, column, spare

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of a repeated passage: below 50 words of prose, above any single line that documents share by chance.
REPEAT, REPEAT_GRAM = 240, 120


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates (five words, similarity 0.8).

    Of a group's texts with that doc_id the one of the least hash stays, of equal rows one.
    """
    ws = Workspace(spark, "near_dedup")
    groups = simhash.similar_components(docs, k=5, least=0.8, ws=ws)
    kept = ws.table(groups.groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("r")).select("r.*"), "kept")
    d, t = spare(docs.columns, "doc", "t")
    kept = kept.select(F.col("doc_id").alias(d), F.col("t").alias(t))
    named = docs.where("doc_id IS NOT NULL").withColumns({d: F.col("doc_id"), t: F.xxhash64("text")})
    columns = [column(c) for c in docs.columns]
    return named.join(kept, [d, t]).dropDuplicates([d, t]).select(*columns).unionAll(docs.where("doc_id IS NULL").select(*columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus: of every repeated passage the first occurrence stays."""
    out = suffix.cleaned(docs, REPEAT, REPEAT_GRAM, keep_first=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 of its shingles of five words)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the text decoded from them."""
    return bpe.round_trip(docs, VOCABULARY)


STAGES = [
    ("toxicity", nontoxic),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", encoded),
]

#: A trained classifier and similarity groups have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
