"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, lexical_search, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, token_counts, toxicity
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents that an earlier document or place holds."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severity of all documents."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected rating of all documents."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on four-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into windows of up to 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the unigram and the context tree."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the marks of a common template.
MARKED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the marked one, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(marked), tokenizer_path()))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, in plain text or wrapped."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v1."""
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.verdict("base")).alias("base_failed"), quality_rules.verdict("v1").alias("kept")
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents, of all, for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    ops = (
        op1_substring_dedup, op2_minhash_near_dedup, op3_toxicity, op4_packing, op5_lm_scoring,
        op6_quality_classifier, op7_chat_format, op8_quality_rules, op9_decontaminate, op10_secret_scan,
        op11_token_counts, op12_collocations, op13_lexical_search,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
