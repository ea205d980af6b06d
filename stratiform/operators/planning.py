"""Rules around plans: query expansion, file metadata, summaries, next layer, alignment, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Synonyms of query terms; category, subcategory and level of document folders, in order.
SYNONYMS = {
    "村庄": ["农村", "乡村", "村镇"],
    "规划": ["规划编制", "规划设计", "空间规划"],
    "用地": ["土地", "建设用地", "用地分类"],
    "标准": ["规范", "技术规范", "标准规范"],
    "指标": ["控制指标", "规划指标", "技术指标"],
}
FOLDERS = {
    "01_专业教材": ("专业教材", "", ""),
    "02_法律法规/01_法律": ("法律法规", "法律", "国家"),
    "02_法律法规/02_地方性法规": ("法律法规", "地方性法规", "地方"),
    "02_法律法规/03_行政法规": ("法律法规", "行政法规", "国家"),
    "03_政策文件/01_国家层面": ("政策文件", "国家政策", "国家"),
    "03_政策文件/02_地方层面/01_广东省": ("政策文件", "地方政策", "广东省"),
    "04_技术规范/01_国家层面": ("技术规范", "国家标准", "国家"),
    "04_技术规范/02_地方层面/01_广东省": ("技术规范", "地方标准", "广东省"),
    "05_上位规划/01_广东省": ("上位规划", "", "广东省"),
    "06_相关案例": ("相关案例", "", ""),
}
SUMMARY = "struct<dimension_key: string, layer: int, word_count: int, key_points: array<string>, text_summary: string, metrics: map<string, string>, summary: string, key_findings: array<string>, key_numbers: map<string, string>>"


def expand_query(text: Column, synonyms: dict[str, Sequence[str]] = SYNONYMS, per_term: int = 2, most: int = 3) -> Column:
    """The query and its variants, ``per_term`` for each term found, ``most`` in all."""
    variants = [F.when(text.contains(term), F.regexp_replace(text, term, s)) for term, found in synonyms.items() for s in found[:per_term]]
    return F.slice(F.array_compact(F.array(text, *variants)), 1, most)


def folder_category(folder: Column, folders: dict[str, tuple[str, str, str]] = FOLDERS) -> Column:
    """Category, subcategory and level of a folder: its own or a parent's entry, else the first that its first part begins."""
    as_struct = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("category", "subcategory", "level"))])
    first = F.split(folder, "/")[0]
    out = None
    for path, v in folders.items():
        hit = (folder == path) | folder.startswith(path + "/")
        out = F.when(hit, as_struct(v)) if out is None else out.when(hit, as_struct(v))
    for path, v in folders.items():
        out = out.when(F.lit(path).startswith(first), as_struct(v))
    return out


def file_title(name: Column) -> Column:
    """Number, title and standard of a file name."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "(?:_minerU_parsed|_parsed|_converted|_md)$", "")
    seq = F.nullif(F.regexp_extract(stem, r"^(\d+)[\s._-]+", 1), F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"^\d+[\s._-]+", ""), "《([^》]*)》", "$1"), r"\s+", " "))
    standard = F.nullif(F.regexp_extract(stem, r"((?:GB|JGJ|CJJ|DB)[/T]*\s*\d+(?:[-—.]\d+)*)", 1), F.lit(""))
    return F.struct(seq.alias("seq"), title.alias("title"), standard.alias("standard_no"))


def parse_summary(text: Column, key: Column, layer: Column) -> Column:
    """A stored summary in any of three formats: structured, intermediate, plain text."""
    p = F.from_json(text, SUMMARY)
    words = F.when(p["dimension_key"].isNotNull(), p["word_count"]).when(p["summary"].isNotNull(), F.length(p["summary"])).otherwise(F.coalesce(F.length(text), F.lit(0)))
    body = F.when(p["dimension_key"].isNotNull(), p["text_summary"]).when(p["summary"].isNotNull(), F.left(p["summary"], F.lit(200))).otherwise(F.left(F.coalesce(text, F.lit("")), F.lit(200)))
    points = F.coalesce(F.when(p["dimension_key"].isNotNull(), p["key_points"]).when(p["summary"].isNotNull(), p["key_findings"]), F.array().cast("array<string>"))
    metrics = F.coalesce(F.when(p["dimension_key"].isNotNull(), p["metrics"]).otherwise(p["key_numbers"]), F.create_map().cast("map<string,string>"))
    return F.struct(F.coalesce(p["dimension_key"], key).alias("dimension_key"), F.coalesce(p["layer"], layer).alias("layer"), words.alias("word_count"), points.alias("key_points"), body.alias("text_summary"), metrics.alias("metrics"))


def next_layer(previous: Column, done: Sequence[Column]) -> Column:
    """One above the previous layer, else the first layer that is not done (3 at most)."""
    return F.when(previous > 0, previous + 1).when(~done[0], 1).when(~done[1], 2).otherwise(3)


def phase_of(layer: Column) -> Column:
    return F.when(layer.between(1, 3), F.concat(F.lit("layer"), layer.cast("string"))).otherwise("completed")


def citation_rates(found: DataFrame, by: str) -> DataFrame:
    """Shares of citations (``exists``, ``score``, ``supportive``) that exist, are accurate (70 of 100), support or decorate; 0 without any."""
    n = F.count("exists")
    rate = lambda c: F.round(F.coalesce(F.count_if(c) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    return found.groupBy(by).agg(n.alias("n"), rate(F.col("exists")).alias("existence"), rate(F.col("score") >= 70).alias("accuracy"), rate(F.col("supportive")).alias("supportive"), rate(~F.col("supportive")).alias("decorative"))


def parent_chunks(chunks: DataFrame) -> DataFrame:
    """Parent of each chunk (doc_id, chunk_index, chunk_id, ancestors, title): the nearest ancestor title that has a chunk.

    Titles are not qualified by their path: the last chunk of a title stands for it.
    """
    last = chunks.groupBy("doc_id", "title").agg(F.max_by("chunk_id", "chunk_index").alias("parent_id"))
    up = chunks.select("doc_id", "chunk_id", F.posexplode(F.reverse("ancestors")).alias("far", "title"))
    near = up.join(last, ["doc_id", "title"]).filter("parent_id <> chunk_id").groupBy("doc_id", "chunk_id").agg(F.min_by("parent_id", "far").alias("parent_id"))
    return chunks.join(near, ["doc_id", "chunk_id"], "left")


def saved_layers(events: DataFrame, session: str, kind: str, layer: str) -> DataFrame:
    """Each saved checkpoint with the last layer completed before it, once for each completion."""
    w = Window.partitionBy(session).orderBy("seq")
    done = events.withColumn("_n", F.count(F.when(F.col(kind) == "layer_completed", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    done = done.withColumn("completed_layer", F.last(F.when(F.col(kind) == "layer_completed", F.col(layer)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    saved = done.filter((F.col(kind) == "checkpoint_saved") & (F.col("_n") > 0))
    first = F.row_number().over(Window.partitionBy(session, "_n").orderBy("seq"))
    return saved.withColumn("_rn", first).filter("_rn = 1").select(session, "seq", "completed_layer")


def frequent_phrases_kept(target: Column, downstream: Column, pattern: str = "[一-龥]{2,4}", least: int = 2) -> Column:
    """Share of phrases frequent in the target that occur downstream; 0.5 when none is frequent."""
    all_phrases = F.regexp_extract_all(target, F.lit(pattern), F.lit(0))
    kinds = F.array_distinct(all_phrases)
    often = F.filter(kinds, lambda p: F.size(F.filter(all_phrases, lambda q: q == p)) >= least)
    kept = F.filter(often, lambda p: downstream.contains(p))
    return F.when(F.size(often) > 0, F.size(kept) / F.nullif(F.size(often), F.lit(0))).otherwise(0.5)


def alignment(cos: Column, keywords: Column, downstream: Column) -> Column:
    """0.7 calibrated cosine and 0.3 keyword alignment; keywords alone without a vector; 0 for an empty text."""
    mixed = F.coalesce(0.7 * cos + 0.3 * keywords, keywords)
    return F.when(F.coalesce(F.length(downstream), F.lit(0)) == 0, 0.0).otherwise(mixed)
