"""Vector retrieval queries: vec_id is the chunk, label its document type, tens of ids its parent."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import retrieval as R
from stratiform.plans.base import query, table

_S = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label AS doc_type, e.vec_id // 10 AS parent_id,
 round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"""
_T = "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r0 FROM s), k AS (SELECT query_id, chunk_id, doc_type, parent_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id))::INTEGER AS rank FROM t WHERE r0 <= 10 AND score <= 1.6)"


def scores(spark, sf_dir, keep, wanted=None):
    """The ``keep`` least scores of each query, of the wanted and of the others where ``wanted`` is given."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    passages = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_type"), F.floor(F.col("vec_id") / 10).cast("long").alias("parent_id"), "embedding")
    if wanted is None:
        return R.scored(queries, passages, keep)
    return R.scored(queries, passages.withColumn("wanted", F.coalesce(wanted.cast("int"), F.lit(0))), keep, "wanted").drop("wanted")


@query("retrieve_topk", f"WITH {_S}, {_T} SELECT query_id, chunk_id, score, rank FROM k WHERE rank <= 5")
def retrieve_topk(spark, sf_dir):
    return R.top_k(scores(spark, sf_dir, 10), 5, 1.6).select("query_id", "chunk_id", "score", "rank")


@query("retrieve_filtered_backfill", f"""WITH {_S}, w AS (SELECT *, CASE WHEN doc_type IN (1, 2) THEN 0 ELSE 1 END AS fill FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, fill ORDER BY score, chunk_id) AS r FROM w),
 c AS (SELECT *, sum(1 - fill) OVER (PARTITION BY query_id) AS nw, row_number() OVER (PARTITION BY query_id ORDER BY fill, score, chunk_id) AS pos FROM n WHERE r <= 10)
 SELECT query_id, chunk_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id))::INTEGER AS rank FROM c WHERE (fill = 0 OR nw < 5) AND pos <= 10 AND score <= 1.9) WHERE rank <= 5""")
def retrieve_filtered_backfill(spark, sf_dir):
    wanted = F.col("doc_type").isin(1, 2)
    return R.top_k_filtered(scores(spark, sf_dir, 10, wanted), wanted, 5, 1.9).select("query_id", "chunk_id", "score", "rank")


@query("retrieve_fused", f"""WITH {_S}, {_T} SELECT chunk_id, query_id, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score, query_id, rank) AS rn FROM k WHERE rank <= 5) WHERE rn = 1 ORDER BY score, query_id, rank LIMIT 8""")
def retrieve_fused(spark, sf_dir):
    return R.fuse(R.top_k(scores(spark, sf_dir, 10), 5, 1.6), "chunk_id", 8).select("chunk_id", "query_id", "score")


@query("retrieve_parent_best", f"WITH {_S}, {_T} SELECT query_id, parent_id, score, n_hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, parent_id) AS rn FROM (SELECT query_id, parent_id, min(score) AS score, count(*) AS n_hits FROM k GROUP BY 1, 2)) WHERE rn <= 3")
def retrieve_parent_best(spark, sf_dir):
    return R.best_parents(R.top_k(scores(spark, sf_dir, 20), 10, 1.6), 3).select("query_id", "parent_id", "score", "n_hits")


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda t: t::DOUBLE * t::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda t: t::DOUBLE * t::DOUBLE))))"


@query("cosine_alignment", f"SELECT vec_id, round(cos, 6) AS cos, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (cos - (-0.2)) / 1.2)), 6) AS aligned FROM (SELECT a.vec_id, {_COS} AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def cosine_alignment(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cos = R.cosine(F.col("embedding"), F.col("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cos, 6).alias("cos"), F.round(R.calibrated(cos, -0.2), 6).alias("aligned"))


@query("calibrate_median", f"SELECT round(median(cos), 6) AS offset_cos, round(1 - median(cos), 6) AS scale FROM (SELECT {_COS} AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def calibrate_median(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    m = e.join(nxt, "vec_id").select(R.cosine(F.col("embedding"), F.col("other")).alias("cos")).agg(F.median("cos").alias("m"))
    return m.select(F.round("m", 6).alias("offset_cos"), F.round(1 - F.col("m"), 6).alias("scale"))


@query("chunk_ancestors", "WITH RECURSIVE a AS (SELECT vec_id AS chunk_id, vec_id // 10 AS ancestor_id, 1 AS distance FROM embeddings WHERE vec_id >= 10 UNION ALL SELECT chunk_id, ancestor_id // 10, distance + 1 FROM a WHERE ancestor_id >= 10) SELECT * FROM a")
def chunk_ancestors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    tree = e.withColumn("parent_id", F.when(F.col("chunk_id") >= 10, F.floor(F.col("chunk_id") / 10)).cast("long"))
    return R.ancestors(tree)


@query("parent_context", "SELECT lang AS parent_id, count(*) AS n, left(string_agg(text, chr(10) ORDER BY doc_id), 2000) || CASE WHEN length(string_agg(text, chr(10) ORDER BY doc_id)) > 2000 THEN '…' ELSE '' END AS content FROM documents GROUP BY 1")
def parent_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("parent_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return R.with_children(d.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")), d, 2000)
