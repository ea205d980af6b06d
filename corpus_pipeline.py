"""A corpus pipeline of training-data operators: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm import op2_line_dedup, op3_packing, op5_mixing, op6_language_id, op7_jaccard_join
from stratiform.llm.common import documents, materialize
from stratiform.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those far less predictable than any language learned; ``lang`` stays as labelled."""
    ship(spark)
    model = op6_language_id.learn(docs)
    return op6_language_id.identify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs, but for its first; documents that lose all their lines go."""
    ship(spark)
    out = op2_line_dedup.dedup_lines(docs.select(*COLUMNS))
    out = out.where("n_lines > n_dropped or n_dropped = 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by five-word shingles, similarity 0.8: that of smallest doc_id.

    Equal texts leave one row, also where doc_ids repeat or are null.
    """
    ship(spark)
    return op7_jaccard_join.keep_one_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes near its target; a row per copy."""
    ship(spark)
    return op5_mixing.mixed_rows(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 2048 tokens: a row per piece."""
    ship(spark)
    return op3_packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Language models, templates, connected components and packing are beyond SQL: tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
