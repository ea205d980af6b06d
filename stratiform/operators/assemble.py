"""Assembly of plans: source lists, chapters, nested documents, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.operators.quality import similarity
from stratiform.operators.titles import matched


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def enrich(rows: DataFrame, known: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Fill missing columns from ``known`` by key, then from an expression."""
    k = known.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(k, F.col(key) == F.col("_k"), "left")
    for c, otherwise in columns.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}"), otherwise))
    return out.drop("_k", *[f"_{c}" for c in columns])


def clean_file_name(name: Column) -> Column:
    """File name without parser suffix, extension and leading number."""
    for pattern in ("_minerU_parsed", r"\.md$", r"^\d+[ ._-]*"):
        name = F.regexp_replace(name, pattern, "")
    return name


# Words by which a source's title is national, provincial or one of planning.
NATIONAL, PROVINCIAL, LOCAL, LOCAL_KINDS, PLANNING = "《中华人民共和国|国务院|中共中央", "条例|规划|意见", "市|县|镇", "规划|批复|方案", "规划|国土空间"


def legal_level(title: Column) -> Column:
    """national, provincial or planning by words of the title, null if none tells; a local title counts only if it is a plan or decision."""
    local = title.rlike(LOCAL)
    planning = (local & title.rlike(LOCAL_KINDS)) | (~local & title.rlike(PLANNING))
    return F.when(title.rlike(NATIONAL), "national").when(title.contains("省") & title.rlike(PROVINCIAL), "provincial").when(planning, "planning")


def title_sets(df: DataFrame, by: str, title: str) -> DataFrame:
    """Sorted distinct titles of each group."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(title)).alias("titles"))


def joined_text(df: DataFrame, by: Sequence[str], order: str, text: str, sep: str = "\n\n", into: str = "content") -> DataFrame:
    """Texts of each group in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias(into), F.count(F.lit(1)).alias("n"))


def chapters(articles: DataFrame, plan: str, order: str, chapter: str, fields: Sequence[str]) -> DataFrame:
    """Articles nested in runs of one chapter, and those in their plan."""
    w = Window.partitionBy(plan).orderBy(order)
    new = F.when(F.lag(chapter).over(w).eqNullSafe(F.col(chapter)), 0).otherwise(1)
    run = articles.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("position"), *fields)))
    nested = run.groupBy(plan, "_run").agg(F.first(chapter).alias("chapter"), items.alias("articles"))
    return nested.groupBy(plan).agg(F.transform(F.array_sort(F.collect_list(F.struct("_run", "chapter", "articles"))), lambda c: F.struct(c["chapter"].alias("chapter"), c["articles"].alias("articles"))).alias("chapters"))


def plan_json(nested: DataFrame, plan: str) -> DataFrame:
    return nested.select(plan, F.to_json(F.struct(F.col(plan).alias("plan"), F.size("chapters").alias("n_chapters"), "chapters")).alias("json"))


def route(patterns: DataFrame, titles: DataFrame, least: float = 0.65) -> DataFrame:
    """Section of each pattern: a title that holds it or is held first, then one of the same core word, then the most similar.

    Titles (title, title_pos) of equal standing are taken by position.
    """
    rank = {"exact": 0, "keyword": 1, "similar": 2}
    hits = matched(patterns, titles, least=least).join(titles.groupBy("title").agg(F.min("title_pos").alias("title_pos")), "title")
    place = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])[F.col("how")]
    closeness = F.when(F.col("how") == "similar", similarity(F.col("pattern"), F.col("title"))).otherwise(1.0)
    w = Window.partitionBy("pattern").orderBy(place, F.desc("score"), "title_pos")
    return hits.withColumn("score", closeness).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("pattern", "title", "how", "score")
