"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; further columns of any name stay, too. Null
and empty texts go with the first stage, and stay in the others if they come to
them. Repeated rows and ids, null ids and empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltriage.llm import decontaminate, near_dedup, packing, quality_rules, secret_scan
from calltriage.llm.common import drop_scratch, scratch_table, table
from calltriage.llm.queries import tokenizer_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules' policy v1; null and empty texts don't."""
    return quality_rules.keep(docs, "v1")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more. Texts without words all stay."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Texts without words stay; an empty benchmark leaves all."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; n_chars, if there is one, follows the text (null for a null text)."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of up to 1024 tokens. A null or empty text is one piece of one token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", reject_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: Near duplicates, decoded secrets and packing can't be said in SQL; tests/llm
#: compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``. A stage's table is deleted once the next one stands; the last one's input stays, as the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
