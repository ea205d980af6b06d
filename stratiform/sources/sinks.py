"""Sinks: runs by partition, layers as Markdown, plans as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_run(df: DataFrame, path: str, kind: str, item: str, run: int) -> None:
    """Store one run under its key; writing it again replaces that run only."""
    keyed = df.withColumns({"kind": F.lit(kind), "item": F.lit(item), "run": F.lit(run)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "item", "run").parquet(path)


def read_run(spark: SparkSession, path: str, kind: str, item: str, run: int) -> DataFrame:
    """One run: only its partition is read."""
    return spark.read.parquet(path).filter((F.col("kind") == kind) & (F.col("item") == item) & (F.col("run") == run)).drop("kind", "item", "run")


def write_markdown(sections: DataFrame, path: str, title: str = "title", content: str = "content") -> None:
    sections.select(F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(content), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_rows(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path) if by else df.write.mode("append").parquet(path)
