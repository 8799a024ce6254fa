"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Documents without letters, or of no language that is known, go; repeated lines go, and documents that were nothing else; of near
duplicates the smallest doc_id stays; documents with benchmark items go; what is left is packed.  All stages but the
last return the columns of documents.  Null texts count as empty and go in the first stage; repeated rows (doc_id and
text equal) are one document from the third stage on; extra columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontam, langid, line_dedup, minhash_dedup, packing
from sieveline.llm.common import Scratch, table
from sieveline.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found with a posterior of a half at least; fills in missing languages."""
    docs = docs.select(COLUMNS)
    pieces = vocabulary("piece_bpe_32k.model")
    langs, p = langid.fit(spark, docs, pieces)
    if not langs:  # nothing to learn a language from: only texts without letters are rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(spark, docs, langs, p, pieces).where("lang_pred <> 'und' and score >= 0.5")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines similar to earlier ones, and documents of which nothing is left by that."""
    found = line_dedup.deduplicate(spark, docs.select(COLUMNS), percent=80)
    kept = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    docs = docs.select(COLUMNS)
    kept = minhash_dedup.near_duplicates(spark, docs, k=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    found = decontam.decontaminate(spark, docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's tokens in sequences of 4096."""
    return packing.pack(spark, docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # SQL cannot express the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
