"""Token counts through a digest cache.

A count depends only on the normalised content and on the tokenizer's version, so counts are stored
under (content digest, tokenizer digest).  A call joins its documents to the stored counts, encodes
each distinct content that is missing once, and appends those counts to the cache.

Edge cases: null text counts as empty (0 tokens, 0 bytes); repeated texts are encoded once; repeated
rows and null ids each return a row; an empty table returns no rows; other columns are ignored.
Two writers that append the same digest do no harm: reads take one count for each digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, salted_join, salts, stage
from .pieces import batches, loaded

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(name: str) -> str:
    """SHA-256 of the tokenizer file: another version of the file never meets stored counts."""
    path = name
    if "/" not in name:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text, style: str):
    """Content that has the same count: a 'words' tokenizer drops white space, however long."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if style == "words" else text


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """One stored count for each digest of this tokenizer version; a path that isn't there yet is an empty cache."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counter(name: str, style: str):
    def count(rows):
        encoder = loaded(name, style)
        for batch in rows:
            texts = batch.column("content").to_pylist()
            digests = batch.column("digest")
            for begin, part in batches(texts):
                _, counts = encoder.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [digests.slice(begin, len(part)), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
                )

    return count


def token_counts(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str = "word_bpe_49k.json",
    style: str = "words",
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    key_rows: int = 200_000,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row; appends misses to the cache.

    Rows of a digest that over ``key_rows`` rows share meet their count in several tasks.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    content = normalised(F.col(text_col), style)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    keyed = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), digest)
    keyed = stage(keyed.withColumn("__row", F.monotonically_increasing_id()), "digests")
    parts = salts(keyed.groupBy("digest").count().agg(F.max("count")).first()[0], key_rows)
    misses = (
        docs.select(digest, content.alias("content"))
        .join(read_cache(spark, cache_path, version), "digest", "left_anti")
        .groupBy("digest").agg(F.first("content").alias("content"))
        .mapInArrow(_counter(tokenizer, style), "digest binary, n_tokens bigint")
    )
    misses.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counted = salted_join(keyed, read_cache(spark, cache_path, version), ["digest"], F.col("__row"), parts)
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents against a cache of its own, new for each call."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, fresh_path(spark, "token-counts"))
