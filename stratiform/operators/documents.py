"""Views of ingested documents: list, overview, chapters at three levels of detail, key points, full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PREVIEW = 100
LEVELS = ("summary", "medium", "full")


def listed(chunks: DataFrame, source: str = "source", order: str = "chunk_index", content: str = "content", doc_type: str = "doc_type", preview: int = PREVIEW) -> DataFrame:
    """One row a source: type and beginning of its first chunk, chunks, characters, and its place by name."""
    g = chunks.groupBy(source).agg(
        F.min(F.struct(F.col(order).alias("o"), F.col(doc_type).alias("t"), F.substring(content, 1, preview).alias("p"))).alias("_f"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("chars")
    )
    return g.select(source, F.col("_f.t").alias("doc_type"), F.coalesce("_f.p", F.lit("N/A")).alias("preview"), "chunks", "chars")


def list_text(listing: DataFrame, source: str = "source") -> DataFrame:
    """The list as lines of text, one a source: a report for a reader, by name."""
    line = F.concat(F.col(source), F.lit("\n   类型: "), F.coalesce("doc_type", F.lit("")), F.lit("\n   切片数: "), F.col("chunks").cast("string"), F.lit("\n   预览: "), F.col("preview"), F.lit("\n"))
    return listing.select(source, line.alias("text"))


def overview(chunks: DataFrame, summaries: DataFrame, source: str = "source", order: str = "chunk_index", title: str = "section_title", level: str = "depth", doc_type: str = "doc_type") -> DataFrame:
    """(source, doc_type, text): executive summary and the titles of chapters, which are the chunks of depth 1 in order.

    ``summaries`` (source, summary) may lack a source, which is then said so.
    """
    by = Window.partitionBy(source).orderBy(order)
    chapters = chunks.where((F.col(level) == 1) & (F.coalesce(F.length(title), F.lit(0)) > 0)).withColumn("_i", F.row_number().over(by))
    lines = chapters.groupBy(source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", title))), lambda x: F.concat(x["_i"].cast("string"), F.lit(". "), x[title])), "\n").alias("_chapters"))
    kinds = chunks.groupBy(source).agg(F.min_by(doc_type, order).alias("doc_type"))
    out = kinds.join(lines, source, "left").join(summaries.select(source, F.nullif("summary", F.lit("")).alias("_summary")), source, "left")
    head = F.concat(F.lit("【文档概览】\n来源: "), F.col(source), F.lit("\n类型: "), F.coalesce("doc_type", F.lit("未知")), F.lit("\n\n"))
    body = F.coalesce(F.concat(F.lit("**执行摘要**\n"), F.col("_summary"), F.lit("\n")), F.lit("⚠️  该文档尚未生成摘要\n"))
    tail = F.coalesce(F.concat(F.lit("\n**章节列表**\n"), F.col("_chapters"), F.lit("\n")), F.lit(""))
    return out.select(source, "doc_type", F.concat(head, body, tail).alias("text"))


def _fragment(source: Column, body: Column) -> Column:
    return F.concat(F.lit("【知识片段 1】\n来源: "), source, F.lit("\n位置: 第1 页\n内容:\n"), body)


def chapter(chunks: DataFrame, requests: DataFrame, source: str = "source", order: str = "chunk_index", title: str = "section_title") -> DataFrame:
    """Each request (source, pattern, level) with the first chunk whose title holds the pattern, as text of that level.

    ``chunks`` have content, summary and key_points; a missing summary is the content's beginning.
    Levels are those of ``LEVELS``; a request for another level, or that finds nothing, has an
    ``error`` and no text.
    """
    have = chunks.select(F.col(source).alias("_s"), F.col(title).alias("_t"), F.struct(F.col(order).alias("o"), F.col("content").alias("c"), F.coalesce("summary", F.substring("content", 1, 200)).alias("s"), F.coalesce("key_points", F.array().cast("array<string>")).alias("k")).alias("_x"))
    asked = requests.select(source, "pattern", "level").distinct()
    met = asked.join(have, (F.col(source) == F.col("_s")) & F.contains("_t", "pattern"), "left")
    hit = met.groupBy(source, "pattern", "level").agg(F.min("_x").alias("_x"))
    points = F.array_join(F.transform(F.col("_x.k"), lambda p: F.concat(F.lit("  • "), p)), "\n")
    body = F.when(F.col("level") == "summary", F.col("_x.s")).when(F.col("level") == "full", F.col("_x.c")).when(F.col("level") == "medium", F.concat(F.lit("**摘要**\n"), F.col("_x.s"), F.lit("\n\n**关键要点**\n"), points))
    error = F.when(~F.col("level").isin(*LEVELS), "level").when(F.col("_x").isNull(), "chapter")
    return hit.select(source, "pattern", "level", F.when(error.isNull(), _fragment(F.col(source), body)).alias("text"), error.alias("error"))


def matching_points(chunks: DataFrame, queries: DataFrame, source: str = "source", order: str = "chunk_index") -> DataFrame:
    """(query, source, point) of all key points that hold a query's words as they stand, in any case; each once.

    ``queries`` (query, sources): an array of sources to look into, null for all. Queries are a
    stated list, so they go to every row of points.
    """
    p = chunks.select(source, F.explode("key_points").alias("point")).where("point is not null").distinct()
    q = queries.select("query", "sources").distinct()
    hit = F.contains(F.lower("point"), F.lower("query")) & (F.col("sources").isNull() | F.array_contains("sources", F.col(source)))
    return p.join(F.broadcast(q), hit).select("query", source, "point").distinct()


def full_text(chunks: DataFrame, source: str = "source", order: str = "chunk_index", content: str = "content", doc_type: str = "doc_type") -> DataFrame:
    """(source, doc_type, total_chunks, length, content): all chunks of a source in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(content, F.lit("")).alias("c"))))
    g = chunks.groupBy(source).agg(F.min_by(doc_type, order).alias("doc_type"), F.count(F.lit(1)).alias("total_chunks"), F.array_join(F.transform(parts, lambda p: p["c"]), "\n\n").alias("content"))
    return g.select(source, "doc_type", "total_chunks", F.length("content").alias("length"), "content")
