"""Features of equal content under one name: work on places and shapes is done once for each that is different."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def members(rows: DataFrame, key: str, *what: str) -> DataFrame:
    """(key, shape): each feature with the name of its content, the set of ``what`` in all of its rows.

    The name is the number of distinct rows and two digests of 64 bits over them, whatever their order.
    """
    text = rows.select(F.col(key).alias("key"), F.to_json(F.struct(*what)).alias("_t")).distinct()
    digest = lambda salt: F.hex(F.bit_xor(F.xxhash64(F.lit(salt), "_t")))
    return text.groupBy("key").agg(F.concat_ws("-", F.count(F.lit(1)), digest(1), digest(2)).alias("shape"))


def content(rows: DataFrame, named: DataFrame, key: str, *what: str) -> DataFrame:
    """(shape, what): the rows of one feature of each shape of ``named``, as ``members`` tells them."""
    first = named.groupBy("shape").agg(F.min("key").alias("_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_first"))).select("shape", *what).distinct()


def expanded(found: DataFrame, named: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """``found`` with the shapes in ``column`` replaced by the features that have them, in all combinations."""
    who = named.select(F.col("shape").alias("_shape"), F.col("key").alias("_key"))
    out = found.join(who, F.col(column) == F.col("_shape"), how)
    return out.select(*[F.col("_key").alias(c) if c == column else F.col(c) for c in found.columns])


def sizes(named: DataFrame) -> DataFrame:
    """(shape, n): how many features have each shape."""
    return named.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))

