"""Exact vector retrieval: filtered top-k, back-fill, fusion, parent expansion.

Blocks of queries meet blocks of passages in one task each, which returns the best of every query; one
exchange per query joins them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.settle import settled

#: Queries of a block, and passages of one.
MOST_BROADCAST, PASSAGES = 1000, 16384
#: Shares of a parent's children that are cut on their own first.
SHARES = 128


def squared_l2(a: Column, b: Column) -> Column:
    """In double precision: float components are widened first."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / F.nullif(n, F.lit(0.0))).otherwise(0.0)


def calibrated(cos: Column, offset: float | Column) -> Column:
    """(cos - offset) / (1 - offset), kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - offset) / (1 - offset)))


def scored(queries: DataFrame, passages: DataFrame, keep: int | None = None, by: str | None = None) -> DataFrame:
    """(query_id, chunk columns, score) of every passage for each query (query_id, query) of a stated set.

    Blocks of queries meet blocks of passages, each pair of blocks in one task as matrices. With
    ``keep`` a block returns only the ``keep`` least scores of each query (and value of ``by``),
    ties by chunk_id: what ``best`` can choose from, so a query brings ``keep`` rows a block, not
    all passages. Null vectors take no part.
    """
    queries, passages = queries.where("query is not null").select("query_id", "query"), passages.where("embedding is not null")
    rest = [f for f in passages.schema.fields if f.name != "embedding"]
    if keep is None:
        p = passages.crossJoin(queries)
        return p.withColumn("score", F.round(squared_l2(F.col("embedding"), F.col("query")), 6)).drop("embedding", "query")
    n_q, n_p = (max(1, -(-df.count() // size)) for df, size in ((queries, MOST_BROADCAST), (passages, PASSAGES)))
    named = lambda df, key, n, m, own, other: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = named(queries, "query_id", n_q, n_p, "_q", "_p").repartition(n_q * n_p, "_q", "_p").groupBy("_q", "_p")
    p = named(passages, "chunk_id", n_p, n_q, "_p", "_q").repartition(n_q * n_p, "_q", "_p").groupBy("_q", "_p")
    names = [f.name for f in rest]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in [*(right.schema.field(c).type for c in names), pa.int64(), pa.float64()]], [*names, "query_id", "score"])
        x, y = matrix(right.column("embedding")), matrix(left.column("query"))
        chunk, ids = right.column("chunk_id").to_numpy(), left.column("query_id").to_numpy()
        kind = right.column(by).to_numpy() if by else np.zeros(len(x), np.int8)
        groups = [np.nonzero(kind == v)[0] for v in np.unique(kind)]
        square, most = (x * x).sum(1), (y * y).sum(1)
        rows, who, scores = [], [], []
        for at in range(0, len(y), 64):
            near = square - 2 * (y[at : at + 64] @ x.T) + most[at : at + 64, None]
            for i, line in enumerate(near, at):
                for g in groups:
                    pick = line[g]
                    if len(g) > keep:
                        # the product is off by rounding, and scores are told apart by 6 places only
                        slack = 2e-6 + 1e-12 * (most[i] + square.max())
                        found = g[pick <= np.partition(pick, keep - 1)[keep - 1] + slack]
                    else:
                        found = g
                    exact = ((x[found] - y[i]) ** 2).sum(1)
                    exact = np.floor(exact * 1e6 + 0.5) / 1e6
                    order = np.lexsort((chunk[found], exact))[:keep]
                    rows.append(found[order])
                    who.append(np.full(len(order), ids[i]))
                    scores.append(exact[order])
        at = pa.array(np.concatenate(rows))
        return pa.table([*(right.column(c).take(at) for c in names), pa.array(np.concatenate(who)), pa.array(np.concatenate(scores))], [*names, "query_id", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", query_id long, score double"
    return q.cogroup(p).applyInArrow(compare, schema)


def best(df: DataFrame, n: int, by: str = "query_id", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The ``n`` least scores of each query, with their rank."""
    w = Window.partitionBy(by).orderBy("score", tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_k(scores: DataFrame, k: int, threshold: float) -> DataFrame:
    """2k best, then the threshold, then k: a threshold before the limit would find other rows."""
    found = best(scores, 2 * k).filter(F.col("score") <= threshold).drop("rank")
    return best(found, k)


def top_k_filtered(scores: DataFrame, wanted: Column, k: int, threshold: float) -> DataFrame:
    """2k best of the wanted, filled up to 2k with the best of the others where fewer than k are wanted.

    Wanted hits stand before the fillers; then threshold and k as in ``top_k``, by score.
    """
    tagged = scores.withColumn("_fill", F.when(wanted, 0).otherwise(1))
    w = Window.partitionBy("query_id").orderBy("_fill", "score", "chunk_id")
    n_wanted = F.sum(1 - F.col("_fill")).over(Window.partitionBy("query_id"))
    cut = best(tagged.filter("_fill = 0"), 2 * k, rank="_r").unionByName(best(tagged.filter("_fill = 1"), 2 * k, rank="_r")).drop("_r")
    cut = cut.withColumn("_n", n_wanted).withColumn("_at", F.row_number().over(w)).filter(((F.col("_fill") == 0) | (F.col("_n") < k)) & (F.col("_at") <= 2 * k))
    return best(cut.filter(F.col("score") <= threshold).drop("_fill", "_n", "_at"), k)


def fuse(hits: DataFrame, key: str, n: int) -> DataFrame:
    """One list from several queries' hits: the best of each key, then the ``n`` best."""
    w = Window.partitionBy(key).orderBy("score", "query_id", "rank")
    firsts = hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return firsts.orderBy("score", "query_id", "rank").limit(n)


def best_parents(hits: DataFrame, k: int) -> DataFrame:
    """Best score of each parent of the hits, the ``k`` best parents of each query."""
    per = hits.groupBy("query_id", "parent_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n_hits"))
    return best(per, k, tie="parent_id")


def with_children(parents: DataFrame, chunks: DataFrame, most: int, mark: str = "…") -> DataFrame:
    """Text of each parent: its children in order, joined until ``most`` characters, then cut with a mark.

    Only children that begin within ``most`` characters are shown, and of each only as many: shares
    of a parent's children drop what begins later even among themselves, so what meets in a group
    is bounded whatever the number of children.
    """
    first = chunks.where("content is not null").select("parent_id", "chunk_index", F.substring("content", 1, most + 1).alias("content")).withColumn("_share", F.pmod(F.xxhash64("chunk_index"), F.lit(SHARES)))
    for by in (["parent_id", "_share"], ["parent_id"]):
        before = Window.partitionBy(*by).orderBy("chunk_index", "content").rowsBetween(Window.unboundedPreceding, -1)
        first = first.withColumn("_at", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))).filter(F.col("_at") <= most)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    text = first.groupBy("parent_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))
    text = chunks.select("parent_id").distinct().join(text, "parent_id", "left").fillna("", ["content"])
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit(mark))).otherwise(F.col("content"))
    return parents.join(text, "parent_id", "left").withColumn("content", cut)


def ancestors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ancestor_id, distance), near to far, for trees of any depth; a cycle ends where it meets its start.

    Each round doubles the distance covered, so a tree of depth d takes about log2(d) joins; pairs
    that are known already are not met again, so rounds end on cycles too.
    """
    known = settled(chunks.filter("parent_id is not null and parent_id <> chunk_id").select(F.col("chunk_id").alias("_c"), F.col("parent_id").alias("_a"), F.lit(1).alias("_d")))
    far = 1
    while True:
        step = known.filter(F.col("_d") == far).select(F.col("_c").alias("chunk_id"), F.col("_a").alias("_m"))
        more = step.join(known, step["_m"] == known["_c"]).select(F.col("chunk_id").alias("_c"), "_a", (F.col("_d") + far).alias("_d")).filter("_a <> _c")
        more = settled(more.groupBy("_c", "_a").agg(F.min("_d").alias("_d")).join(known.select("_c", "_a"), ["_c", "_a"], "left_anti"))
        if more.isEmpty():
            break
        known, far = known.unionByName(more), far * 2
    return known.select(F.col("_c").alias("chunk_id"), F.col("_a").alias("ancestor_id"), F.col("_d").alias("distance"))


def subtree_text(sections: DataFrame, root: str) -> DataFrame:
    """Text of each section named ``root`` with all below it, depth first: sections (section_id, parent_id, pos, title, content)."""
    below = ancestors(sections.select(F.col("section_id").alias("chunk_id"), "parent_id"))
    tops = sections.filter(F.col("title") == root).select(F.col("section_id").alias("root_id"))
    mine = below.join(tops, below["ancestor_id"] == tops["root_id"]).select("root_id", F.col("chunk_id").alias("section_id")).unionByName(tops.select("root_id", F.col("root_id").alias("section_id")))
    # the order of a section is the list of positions on the way down to it
    way = below.join(sections.select(F.col("section_id").alias("ancestor_id"), "pos"), "ancestor_id")
    way = way.groupBy(F.col("chunk_id").alias("section_id")).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("distance", "pos"))), lambda x: x["pos"])).alias("way"))
    rows = mine.join(sections, "section_id").join(way, "section_id", "left").withColumn("at", F.concat(F.coalesce("way", F.array().cast("array<int>")), F.array(F.col("pos").cast("int"))))
    parts = F.array_sort(F.collect_list(F.struct("at", "title", "content")))
    return rows.groupBy("root_id").agg(F.array_join(F.transform(parts, lambda p: F.concat_ws("\n", p["title"], p["content"])), "\n").alias("content"))


def metadata_filter(policy: Column | None = None, summary: Column | None = None, task: Column | None = None, terrain: str | None = None, doc_type: str | None = None, columns: tuple[str, str] = ("terrain", "doc_type")) -> Column:
    """Predicate of a search: policies or the summaries of a task where both are given, else all conditions at once; terrain 'all' is none."""
    if policy is not None and summary is not None:
        return policy | (summary & task if task is not None else summary)
    out = F.lit(True)
    if terrain and terrain != "all":
        out = out & (F.col(columns[0]) == terrain)
    if doc_type:
        out = out & (F.col(columns[1]) == doc_type)
    return out & task if task is not None else out


def context_around(text: Column, hit: Column, reach: int) -> Column:
    """The hit with ``reach`` characters to both sides (0: the hit only), null where it does not occur."""
    at = F.instr(text, hit)
    start = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, F.substring(text, start, at + F.length(hit) + reach - start))
