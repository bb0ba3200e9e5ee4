"""The training corpus: documents through language ID, toxicity, near-dedup, mixing and BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, langid, mixing, neardup, toxicity
from lakeloom.llm._common import materialize, small_batches
from lakeloom.llm.queries import tokenizer_path

#: Below this share of known n-grams a text is in none of the learned languages.
LEAST_LANGUAGE_SCORE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letters, or hardly a known n-gram.

    Learned from the documents' own languages; where none has one, nothing can be told and all stay.
    """
    small_batches(spark)
    names = docs.columns
    model = langid.fit(docs)
    if not model.languages:
        return docs
    out = langid.predict(docs, model, lang="_lang", score="_score")
    return out.filter((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).select(*names)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, column="_score").filter(F.col("_score") < 0.5).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    small_batches(spark)
    return neardup.deduplicate(docs, words=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path(), keep_text=False)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Learned models decide the first stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
