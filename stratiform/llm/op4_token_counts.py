"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm.common import documents, materialize, shared_dir, slices
from stratiform.llm.tokenize import WordCounts

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    name = path if "/" in path else public_tokenizers.path(path)
    return hashlib.sha256(Path(name).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def normalised(text: F.Column) -> F.Column:
    """White space runs become one space, outer ones go: the tokenizer drops white space itself."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Count the tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Digests of normalised content join the counts stored under ``cache_path`` for this version
    of the tokenizer; only distinct misses are encoded, and then appended there. A null text
    counts as empty. Copies and repeated rows are encoded once and all returned; a null or
    repeated doc_id and extra columns are harmless; an empty table gives no rows.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    stored = f"{cache_path}/{version}"
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = materialize(
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(normalised(text), 256).alias("digest")),
        "op4-keys",
    )
    schema = "digest string, n_tokens long"
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    if _exists(spark, stored):
        first = first.join(spark.read.schema(schema).parquet(stored), "digest", "left_anti")
    found = docs.select("doc_id", text.alias("text")).join(
        first.select(F.col("doc_id").alias("rep"), "digest"), F.col("doc_id").eqNullSafe(F.col("rep"))
    )
    found = found.where(F.sha2(normalised(F.col("text")), 256) == F.col("digest")).select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                n = counts.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    found.mapInArrow(encode, schema).write.mode("append").parquet(stored)
    cache = spark.read.schema(schema).parquet(stored).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(cache, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache of this call's own, so that nothing is left out of a run."""
    return token_counts(documents(spark, sf_dir), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
