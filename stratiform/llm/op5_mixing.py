"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratiform.llm.common import documents, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BLOCKS = 32
_HEX = 4294967296.0


def _hash32(*parts: F.Column) -> F.Column:
    """A number below 2**32 that other SQL engines can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Add ``target`` to (source, source_size): a row per source, so its windows stay small.

    Weights go round by the sources' order by code point, null last. ``share`` of all sizes is
    split by weight; where a target would pass ``limit`` times its source it stops there and the
    rest is shared again. That ends where all uncapped sources have one ratio of target to weight:
    in the order of size by weight, the first k sources are capped, for the least k that works.
    """
    by = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w.cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    ratio = (F.lit(share) * total - F.lit(limit) * F.coalesce(F.sum("source_size").over(seen), F.lit(0))) / F.sum("w").over(rest)
    rows = rows.select("source", "source_size", "w", ratio.alias("ratio"))
    rows = rows.withColumn("free", F.col("ratio") * F.col("w") <= F.lit(limit) * F.col("source_size"))
    level = F.max(F.when(F.col("free"), F.col("ratio"))).over(Window.partitionBy())
    first = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), F.col("ratio"))))
    level = F.coalesce(first.over(Window.partitionBy()).getField("ratio"), level)
    cap = (F.lit(limit) * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", F.when(level.isNull(), cap).otherwise(F.least(cap, level * F.col("w"))).alias("target"))


def mix_copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """Decide how often each row of (doc_id, source, size) is taken: adds source_size, target, copies.

    Every document of a source expects target / source_size copies. Documents stand by size class
    (16 to a doubling), then by hash block, size and id; prefix sums of the expected copies plus
    one offset per source are cut at whole numbers, and a document is taken once for each one it
    crosses. Prefix sums need only counts per (source, class, block), so a source that holds most
    rows is ranked in many small groups.
    """
    bits = F.length(F.bin(F.col("size"))) - 1
    klass = (bits * 16 + F.expr("cast((size * 16) div cast(pow(2, length(bin(size)) - 1) as bigint) as int) & 15")).cast("int")
    rows = sized.withColumn("_class", F.when(F.col("size") > 0, klass).otherwise(-1)).withColumn(
        "_block", F.pmod(_hash32(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(BLOCKS)).cast("int")
    )
    cells = rows.groupBy("source", "_class", "_block").agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, limit)
    before = Window.partitionBy("source").orderBy(F.desc("_class"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "_class", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_class", "_block").orderBy(F.desc("size"), "doc_id")))
    cells = cells.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_block").alias("_b"), "_before")
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_block") == F.col("_b"))).drop("_s")
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash32(F.coalesce("source", F.lit("\u0000")), F.lit(seed)) / F.lit(_HEX)
    rank = F.col("_before") + F.col("_rank")
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return rows.withColumn("copies", F.least(copies, F.lit(limit)).cast("int")).drop("_class", "_block", "_rank", "_before", "_s", "_c", "_b")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Return doc_id, size, source_size, target, taken and copies for every document.

    A null text has size 0 and a null source is a source of its own, the last. Repeated rows
    count each; texts of no words are never taken beyond their (zero) size; an empty table gives
    no rows. Extra columns are not read.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select("doc_id", "source", size.alias("size")), "op5-sizes")
    mixed = mix_copies(sized, **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the mix: each as often as it is taken, by its own text, source and doc_id.

    Rows repeated as they are count each; of rows that share doc_id, text and source but differ in
    other columns one stands for all. Columns are those of ``docs``.
    """
    keyed = docs.withColumns({"_t": F.xxhash64("text"), "_id": F.col("doc_id"), "_src": F.col("source")})
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(keyed.select("doc_id", "source", "_t", size.alias("size")), "op5-sizes")
    copies = mix_copies(sized, **options).groupBy("doc_id", "source", "_t").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    copies = materialize(copies.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("_t").alias("t"), "copies", "n"), "op5-copies")
    release(sized)
    same = F.col("_id").eqNullSafe(F.col("i")) & F.col("_src").eqNullSafe(F.col("s")) & (F.col("_t") == F.col("t"))
    found = keyed.join(copies.hint("merge"), same)
    found = found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["i", "s", "t"]))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (
  SELECT *, CASE WHEN size > 0 THEN (length(bin(size)) - 1) * 16 + (((size * 16) // (1::BIGINT << (length(bin(size)) - 1))) & 15) ELSE -1 END AS klass,
    ('0x' || substr(md5(doc_id::VARCHAR || '|mix'), 1, 8))::BIGINT % 32 AS block
  FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY klass DESC, block, size DESC, doc_id) AS rnk FROM k
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sized GROUP BY source
), w AS (
  SELECT source, source_size, ([3, 1, 2])[((rn - 1) % 3) + 1]::DOUBLE AS w FROM src
), o AS (
  SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE
      - (2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
      / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ratio
  FROM w
), lev AS (
  SELECT arg_min(ratio, source_size / w) AS lvl FROM o WHERE ratio * w <= 2 * source_size
), tgt AS (
  SELECT source, source_size, CASE WHEN lvl IS NULL THEN 2.0::DOUBLE * source_size ELSE least((2 * source_size)::DOUBLE, lvl * w) END AS target FROM o, lev
), final AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rnk,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5(coalesce(r.source, chr(0)) || '|mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM ranked r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(rnk * rate + off) - floor((rnk - 1) * rate + off), 2)::INTEGER * size)::BIGINT AS taken,
  least(floor(rnk * rate + off) - floor((rnk - 1) * rate + off), 2)::INTEGER AS copies
FROM final
"""
