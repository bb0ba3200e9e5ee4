"""Token counts through a digest cache.

A cache row holds the digest of a normalised content, the digest of a tokenizer version and the
token count. Documents are joined to the cache by both digests: first digests alone tell which
contents it lacks, then the text of each distinct one is fetched, encoded and appended. A content's
copies are encoded once however many rows hold it, and a later call with the same cache encodes, and
moves, only what is new.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import BROADCAST_IDS, join_salted, map_texts, materialize, spans, utf8

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


@lru_cache(8)
def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content.

    Counts are of exact texts, so normalisation may not alter any character: null becomes empty
    and the encoding is UTF-8.
    """
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


@lru_cache(4)
def counter(path: str):
    """A function from a string array to the token counts of its texts.

    ``.model`` files go to sentencepiece. Of ``.json`` files the plain byte-level ones go to this
    package's encoder, which gives the library's ids several times faster, others to the library.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)]

    from lakeloom.llm import bpe

    try:
        encoder = bpe.Encoder(bpe.vocabulary(path))
    except ValueError:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        def by_library(texts: pa.Array) -> list[int]:
            _, off = utf8(texts)
            out: list[int] = []
            for lo, hi in spans(off):
                batch = [t or "" for t in texts[lo:hi].to_pylist()]
                out += [len(x.ids) for x in model.encode_batch_fast(batch, add_special_tokens=False)]
            return out

        return by_library
    return lambda texts: bpe.count_batch(encoder, texts)


def read_cache(spark, path: str, tokenizer: str) -> DataFrame | None:
    """One row per content known for this tokenizer version; None without a cache."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer_digest") == tokenizer_digest(tokenizer))
    return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have added the same content


def missing(digests: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct digests that the cache lacks; only digests move. Written."""
    return materialize(digests.select("content_digest").distinct().join(known, "content_digest", "left_anti"), "missing")


def contents(docs: DataFrame, lacking: DataFrame | None, text: str = "text") -> DataFrame:
    """content_digest and text of each distinct content; only of those ``lacking``, if given.

    Up to BROADCAST_IDS missing digests are broadcast, so no text that the cache knows leaves its
    task. More are joined after the texts of each task have been reduced to distinct ones.
    """
    rows = docs.select(content_digest(F.col(text)).alias("content_digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    once = lambda df: df.groupBy("content_digest").agg(F.first("text").alias("text"))
    if lacking is None:
        return once(rows)
    if lacking.count() <= BROADCAST_IDS:
        return once(rows.join(F.broadcast(lacking), "content_digest", "left_semi"))
    return once(rows).join(lacking, "content_digest", "left_semi")


def fill_cache(docs: DataFrame, digests: DataFrame, tokenizer: str, cache: str, text: str = "text") -> None:
    """Encode the distinct contents of ``docs`` (with ``digests``) that the cache lacks and append them.

    Copies within a map task are dropped before the shuffle, so a content that fills a third of
    the rows moves once per task at most. A retried task writes the same rows again; Spark's
    commit protocol keeps one attempt.
    """
    version = tokenizer_digest(tokenizer)
    known = read_cache(docs.sparkSession, cache, tokenizer)
    misses = contents(docs, missing(digests, known) if known is not None else None, text)

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            n = pa.array(count(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), n], ["content_digest", "tokenizer_digest", "n_tokens"])

    map_texts(misses, run, CACHE_SCHEMA).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row of ``docs``.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated, null keys too;
    other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(key).alias(key), content_digest(F.col(text)).alias("content_digest"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    keyed = materialize(keyed, "digests")
    fill_cache(docs, keyed, tokenizer, cache, text)
    known = read_cache(spark, cache, tokenizer)
    out = join_salted(keyed, known, "content_digest", key, "inner")
    return out.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
