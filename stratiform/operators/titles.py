"""Titles matched with patterns: an index of characters finds candidates, containment, core words and similarity decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.operators.quality import similarity

# Endings that a title's core word has without them, words for one thing, endings that stand for each other.
SUFFIXES = ["工程", "系统", "设施", "规划", "配置", "设计", "建设", "网络"]
CORE_SYNONYMS = {
    "给水": ["供水", "饮水"],
    "供水": ["给水", "饮水"],
    "排水": ["污水", "雨污"],
    "污水": ["排水", "雨污"],
    "电力": ["供电", "用电"],
    "供电": ["电力", "用电"],
    "通信": ["电信", "信息"],
    "电信": ["通信", "信息"],
}
SUFFIX_SYNONYMS = {
    "工程": ["系统", "设施", "规划", "配置", "网络"],
    "系统": ["工程", "设施", "规划", "配置", "网络"],
    "设施": ["工程", "系统", "规划", "网络"],
    "规划": ["工程", "系统", "设施"],
    "网络": ["工程", "系统", "设施"],
}
#: Similarity from which titles are the same, and the least length that is compared (fixed values).
RATIO, LEAST = 0.65, 3


def core(title: Column) -> Column:
    """A title without its ending, where it is longer than that."""
    out = title
    for s in SUFFIXES:
        out = F.when(title.endswith(s) & (F.length(title) > len(s)), F.left(title, F.length(title) - len(s))).otherwise(out)
    return out


def _map(words: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def _any(words: Column, test) -> Column:
    return F.coalesce(F.exists(words, test), F.lit(False))


def keyword_match(pattern: Column, title: Column) -> Column:
    """Whether two titles speak of one thing: one core holds the other, or a word for it, or both are endings that stand for each other."""
    a, b = core(pattern), core(title)
    full = (F.length(a) > 0) & (F.length(b) > 0)
    synonyms, endings = _map(CORE_SYNONYMS), _map(SUFFIX_SYNONYMS)
    bare = F.coalesce(F.array_contains(endings[pattern], title), F.lit(False)) | F.coalesce(F.array_contains(endings[title], pattern), F.lit(False))
    return (full & (F.contains(a, b) | F.contains(b, a))) | _any(synonyms[a], lambda s: F.contains(b, s)) | _any(synonyms[b], lambda s: F.contains(a, s)) | bare


def contained(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def _known(pattern: Column) -> Column:
    """Characters that any title which matches a pattern must share one of: its own and those of words for it."""
    more = F.array_distinct(F.split(F.concat_ws("", F.coalesce(_map(CORE_SYNONYMS)[core(pattern)], F.array().cast("array<string>")), F.coalesce(_map(SUFFIX_SYNONYMS)[pattern], F.array().cast("array<string>"))), ""))
    return F.filter(F.array_union(_characters(pattern), more), lambda c: c != "")


def candidates(patterns: DataFrame, titles: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(pattern, title) that may match: those that share a character, or a character of a word for the same, once each.

    An equi-join on characters in place of all pairs; of pairs that neither hold each other nor
    share a core, those go whose lengths or shared characters leave no room for ``RATIO``: a
    match of M characters needs 2 M / (both lengths) of it, and M characters that both have.
    """
    p = patterns.select(*on, "pattern").distinct().withColumn("_k", F.explode(_known(F.col("pattern"))))
    t = titles.select(*on, "title").distinct().withColumn("_k", F.explode(F.array_union(_characters(F.col("title")), _known(F.col("title")))))
    met = p.join(t, [*on, "_k"]).select(*on, "pattern", "title").distinct()
    count = lambda text, c: F.size(F.filter(F.split(text, ""), lambda x: x == c))
    shared = F.aggregate(F.array_intersect(_characters(F.col("pattern")), _characters(F.col("title"))), F.lit(0), lambda s, c: s + F.least(count(F.col("pattern"), c), count(F.col("title"), c)))
    near = 2 * shared >= RATIO * (F.length("pattern") + F.length("title"))
    out = met.withColumns({"exact": contained(F.col("pattern"), F.col("title")), "keyword": keyword_match(F.col("pattern"), F.col("title"))})
    return out.where(F.col("exact") | F.col("keyword") | near)


def matched(patterns: DataFrame, titles: DataFrame, on: Sequence[str] = (), least: float = RATIO) -> DataFrame:
    """(pattern, title, how): ``exact`` (one holds the other), ``keyword`` or ``similar``, the first that holds.

    Both sides may be of any size; ``on`` names columns in which they must agree. Null and empty
    texts match nothing.
    """
    full = lambda df, c: df.where(F.coalesce(F.length(c), F.lit(0)) > 0)
    c = candidates(full(patterns, "pattern"), full(titles, "title"), on)
    told = c.where(F.col("exact") | F.col("keyword")).withColumn("how", F.when(F.col("exact"), "exact").otherwise("keyword"))
    rest = c.where(~(F.col("exact") | F.col("keyword")) & (F.length("pattern") >= LEAST) & (F.length("title") >= LEAST))
    similar = rest.where(similarity(F.col("pattern"), F.col("title")) >= least).withColumn("how", F.lit("similar"))
    return told.unionByName(similar).select(*on, "pattern", "title", "how")


def routed(patterns: DataFrame, titles: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Each title with the first of its patterns (by ``pattern_pos``) that it matches: what goes where."""
    hits = matched(patterns, titles, on).join(patterns.select(*on, "pattern", "pattern_pos"), [*on, "pattern"])
    w = Window.partitionBy(*on, "title").orderBy("pattern_pos", "pattern")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "pattern_pos")


def looked_up(sections: DataFrame, requests: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Content of the first section (by ``pos``) whose title holds a request's title or is held by it; empty where none does.

    ``sections`` (title, pos, content) and ``requests`` (wanted) meet by the first character of
    the one in the other. An empty title is held by all.
    """
    s = sections.select(*on, "title", "pos", "content")
    r = requests.select(*on, "wanted").distinct()
    by = [*on, "_c"]
    first, every = lambda c: F.left(c, F.lit(1)).alias("_c"), lambda c: F.explode(F.array_union(_characters(F.col(c)), F.array(F.lit("")))).alias("_c")
    down = r.select("*", every("wanted")).join(s.select("*", first(F.col("title"))), by)
    up = r.select("*", first(F.col("wanted"))).join(s.select("*", every("title")), by)
    met = down.unionByName(up, allowMissingColumns=True).where(contained(F.col("title"), F.col("wanted")))
    best = met.groupBy(*on, "wanted").agg(F.min(F.struct("pos", "content")).alias("_b")).select(*on, "wanted", F.col("_b.content").alias("content"))
    return r.join(best, [*on, "wanted"], "left").withColumn("content", F.coalesce("content", F.lit("")))
