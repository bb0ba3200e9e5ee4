"""The queries op1 to op10: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import ann, bpe, chat_format, exact_topk, langid, mixing, neardup, quality, token_counts, toxicity
from lakeloom.llm._common import new_path, small_batches

VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty, so every distinct text is encoded."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), new_path(spark, "token-cache"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments are validated against `chat_format.TOOLS`."""
    return chat_format.format_chat(_table(spark, sf_dir, "conversations"), chat_format.tool_schemas(spark))


def chat_with_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over a table with calls and results, made from the same conversations."""
    return chat_format.format_chat(chat_format.with_tools(_table(spark, sf_dir, "conversations")), chat_format.tool_schemas(spark))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_chat_formatting, chat_with_tools, op4_bpe, op5_language_id, op6_exact_topk, op7_mixing, op8_nearest, op9_near_duplicates, op10_quality)}
ORACLES = {"op3_chat_formatting": chat_format.ORACLE_SQL, "chat_with_tools": chat_format.TOOLS_SQL, "op6_exact_topk": exact_topk.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op9_near_duplicates": neardup.ORACLE_SQL}
