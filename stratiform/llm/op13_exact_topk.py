"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratiform.llm.common import materialize

K, SCALE, EVERY = 20, 64.0, 20
#: Rows of a block of candidates and of queries: what one task holds, whatever the data.
CANDIDATES, QUERIES = 8192, 2048
#: Queries whose score arrays are filled together (they stay in a core's cache), and candidates a strip.
TOGETHER, STRIP = 16, 2048


def quantised(x: F.Column, scale: float = SCALE) -> F.Column:
    """Each component as floor(scale * x), a long; null for vectors that take no part."""
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(x.isNotNull() & ok, F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors, shorter ones filled with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(flat.offsets.to_numpy())
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def postings(vectors: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the places of the vectors that hold it and their weights.

    A list that holds more than half of the vectors is kept with all of them (places ``None``),
    as adding a zero is cheaper than looking up a place.
    """
    out = []
    for weights in np.ascontiguousarray(vectors.T):
        at = np.flatnonzero(weights)
        out.append((None, weights) if 2 * len(at) > len(weights) else (at, weights[at]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Dense scores of n candidates for every query, a term at a time."""
    scores = np.zeros((len(queries), n), queries.dtype)
    for term, (at, weights) in enumerate(lists[: queries.shape[1]]):
        rows = np.flatnonzero(queries[:, term])
        if not len(rows) or not len(weights):
            continue
        w = queries[rows, term][:, None]
        if at is None and len(rows) == len(queries):
            scores += w * weights
        elif at is None:
            scores[rows] += w * weights
        else:
            scores[rows[:, None], at] += w * weights
    return scores


def best_of(scores: np.ndarray, k: int, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each row's k highest (all, if fewer), in no order; ties to smaller places."""
    n = scores.shape[1]
    if k < n and narrow:  # score and place in one number, so that no two are equal
        key = (scores.astype(np.int64) << 16) + (n - 1 - np.arange(n))
        at = n - 1 - (np.partition(key, n - k, axis=1)[:, n - k :] & 0xFFFF)
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(scores, at, axis=1)


def search_block(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query among a block of candidates: (query, place, score).

    Candidates stand in the order of ties. ``own`` and ``keys`` name rows; a query's own row is
    no candidate of it. Numbers are 32 bits where no score can pass them, 64 or unbounded else.
    """
    width = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :width], vectors[:, :width]
    largest = lambda x: max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    bound = largest(queries) * largest(vectors) * max(width, 1)
    kind = np.int32 if bound < 1 << 30 else np.int64 if bound < 1 << 62 else object
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    narrow = bound < 1 << 46 and STRIP <= 1 << 16
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    strips = [(a, postings(vectors[a : a + STRIP]), min(STRIP, len(vectors) - a)) for a in range(0, len(vectors), STRIP)]
    for q in range(0, len(queries), TOGETHER):
        some = queries[q : q + TOGETHER]
        at, score = [], []
        for start, lists, n in strips:
            # one more than k, as the query's own row may be among them
            i, s = best_of(accumulate(some, lists, n), k + 1, narrow)
            at.append(i + start), score.append(s)
        i, s = np.concatenate(at, axis=1), np.concatenate(score, axis=1)
        mine = keys[i] == own[q : q + TOGETHER, None]
        rows = np.repeat(np.arange(q, q + len(some)), i.shape[1])
        i, s, mine = i.ravel(), s.ravel(), mine.ravel()
        rows, i, s = rows[~mine], i[~mine], s[~mine]
        order = np.lexsort((i, -s if kind is not object else np.unique(-s, return_inverse=True)[1], rows))
        rows, i, s = rows[order], i[order], s[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        found.append((rows[rank < k], i[rank < k], s[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k(vectors: DataFrame, queries: F.Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """The k highest integer inner products of every row that ``queries`` holds for, against all other rows.

    Returns query_id, rank (from 1), the candidate's id and score. Components are floor(scale * x),
    x as double. Ties go to the smaller id, a null id last. Vectors that are null or hold null or
    non-finite components take no part; of vectors of unequal lengths the common components count,
    so an empty one scores 0. Rows repeated as they are each are a candidate and, where chosen, a
    query of their own; a row is no candidate of itself alone. Scores beyond a long stop at its
    ends. Other columns are not read; an empty table gives no rows.

    Queries and candidates are dealt into blocks of bounded size by a hash of the row; each pair
    of blocks is one task's work, which returns k rows a query, and these are merged by rank.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column), scale).alias("q"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = materialize(x.where("q is not null").withColumn("row", F.monotonically_increasing_id()), "op13-rows")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0)).alias("m")).first()
    parts_c, parts_q = max(1, -(-n["n"] // CANDIDATES)), max(1, -(-n["m"] // QUERIES))
    deal = lambda parts, seed: F.pmod(F.xxhash64(F.col("row"), F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = rows.where("asked").select(deal(parts_q, 1).alias("b"), every(parts_c).alias("a"), "row", "id", "q")
    held = rows.select(deal(parts_c, 2).alias("a"), every(parts_q).alias("b"), "row", "id", "q")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "row", "id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64())] * 5, names)
        right = right.take(pa.compute.sort_indices(right, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        keys, own = right.column("row").to_numpy(), left.column("row").to_numpy()
        rows, at, score = search_block(_matrix(left.column("q")), own, _matrix(right.column("q")), keys, k)
        if score.dtype == object:
            score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], np.int64)
        found, got = left.select(["row", "id"]).take(pa.array(rows)), right.select(["row", "id"]).take(pa.array(at))
        return pa.table([*found.columns, *got.columns, pa.array(score.astype(np.int64))], names)

    near = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(search, "query long, query_id long, row long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20, against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.r AS own, b.vec_id, b.r, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, r) AS rank FROM s)
WHERE rank <= 20
"""
