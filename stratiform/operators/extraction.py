"""Figures, places and names of planning reports, and lines of sections as a document prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.operators.rollups import place_names

# Figures of a plan, by the first match in all reports; the total area is looked for in the land-use report first.
FIGURES = [
    (r"土地总[用]?面积[约]*\s*([\d.]+)\s*公顷", "total_area_ha"),
    (r"户籍人口\s*(\d+)\s*人", "population_registered"),
    (r"常住人口[约]?\s*(\d+)\s*人", "population_resident"),
    (r"(\d+)\s*户", "population_household"),
    (r"耕地面积[约]*\s*([\d.]+)\s*公顷", "farmland_ha"),
    (r"水田面积[达]?\s*([\d.]+)\s*公顷", "paddy_ha"),
    (r"建设用地[总面积]?\s*([\d.]+)\s*公顷", "construction_land_ha"),
    (r"生态用地[总面积]?\s*([\d.]+)\s*公顷", "ecological_land_ha"),
    (r"林地[面积]*[在占比达]?\s*(\d+)\s*%", "forest_coverage_pct"),
    (r"商业林[面积约]*\s*([\d.]+)\s*公顷", "commercial_forest_ha"),
    (r"生态林[面积约]*\s*([\d.]+)\s*公顷", "ecological_forest_ha"),
    (r"水域面积\s*([\d.]+)\s*公顷", "water_ha"),
    (r"(\d+)\s*个自然村", "village_count"),
    (r"建筑\s*(\d+)\s*处", "building_count"),
    (r"(\d+)\s*处崩塌", "collapse_points"),
    (r"(\d+)\s*处滑坡", "landslide_points"),
]
LAND_USE_AREA = r"土地总用地面积[约]*\s*([\d.]+)\s*公顷"
# Where the names of villages stand, the first that holds; parts of a place.
VILLAGES = [r"完整名单[：:]\s*([^。\n]+)", r"下辖\s*\d+\s*个自然村[，,：:\s]*(.+?)(?:\n|$)"]
VILLAGES_ANYWHERE = r"包括(.+?)等\s*\d+\s*个自然村"
LOCATION = {"province": r"([^\s，,]+省)", "city": r"([^\s，,]+市)", "county": r"([^\s，,]+县)", "town": r"([^\s，,]+镇)"}


def first(text: Column, pattern: str) -> Column:
    """The first capture of a pattern, null where it does not occur."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def figures(reports: DataFrame, plan: str, key: str = "dimension_key", content: str = "content", order: str = "pos") -> DataFrame:
    """Figures of each plan from all its reports, joined by line in order: a column for each, null where none is found.

    What is captured but is no number (two points) counts as not found.
    """
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(content, F.lit("")).alias("t"))))  # the reports of one plan
    area = F.max(F.when(F.col(key) == "land_use", first(F.col(content), LAND_USE_AREA).try_cast("double")))
    g = reports.groupBy(plan).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("_text"), area.alias("_area"))
    found = {name: first(F.col("_text"), p).try_cast("double") for p, name in FIGURES}
    found["total_area_ha"] = F.when(F.col("_area") > 0, F.col("_area")).otherwise(found["total_area_ha"])
    return g.select(plan, *[c.alias(n) for n, c in found.items()])


def parameters(explicit: Column, summary: Column, metrics: Column, text: Column) -> Column:
    """A parameter as given, else from the summary, else from the metrics of a dependency, else from the text."""
    return F.coalesce(explicit, summary, metrics, text)


def location_parts(text: Column) -> Column:
    """Province, city, county and town of a text, null where not named."""
    return F.struct(*[first(text, p).alias(k) for k, p in LOCATION.items()])


def villages(social: Column, location: Column) -> Column:
    """Names of villages: from the full list, else from those that belong to the place, else from what it includes; null without any."""
    both = F.concat(F.coalesce(location, F.lit("")), F.lit("\n"), F.coalesce(social, F.lit("")))
    names = place_names(F.coalesce(*[first(social, p) for p in VILLAGES], first(both, VILLAGES_ANYWHERE)))
    return F.when(F.size(names) > 0, names)


# What a line of punctuation only holds, numerals of sections.
PUNCTUATION = r"^[：:，,。；;、！!？?）\)】】]+$"
NUMERALS = "一二三四五六七八九十"


def without_orphans(rows: DataFrame, by: list[str], pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines without rules and quotes, those of punctuation only joined to the line before them.

    That may be a blank one; its own blanks at the end go where something is joined. The first
    line stays whatever it is. Null lines are as empty ones.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    trimmed = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", "")
    r = rows.where((trimmed != "---") & ~trimmed.startswith(">")).withColumn("_mark", F.when(trimmed.rlike(PUNCTUATION) & F.lag(pos).over(w).isNotNull(), trimmed))
    r = r.withColumn("_run", F.max(F.when(F.col("_mark").isNull(), F.col(pos))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marks = F.array_sort(F.collect_list(F.when(F.col("_mark").isNotNull(), F.struct(pos, "_mark"))).over(Window.partitionBy(*by, "_run")))
    r = r.withColumn("_marks", F.array_join(F.transform(marks, lambda m: m["_mark"]), ""))
    joined = F.when(F.col("_marks") != "", F.concat(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+$", ""), "_marks")).otherwise(F.col(line))
    return r.where("_mark is null").withColumn(line, joined).drop("_mark", "_run", "_marks")


def ordinal(n: Column, style: str = "full") -> Column:
    """The label of the n-th section: 一 to 十, 十一 to 九十九, and beyond by figures; ``full`` in brackets, ``half`` before one."""
    digit = lambda d: F.substring(F.lit(NUMERALS), d.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    word = F.when(n <= 10, digit(n)).when(n < 100, F.concat(F.when(tens > 1, digit(tens)).otherwise(F.lit("")), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise(F.lit("")))).otherwise(n.cast("string"))
    return F.concat(F.lit("（"), word, F.lit("）")) if style == "full" else F.concat(n.cast("string"), F.lit("）"))


def legal_titles(titles: Column, most: int = 80) -> Column:
    """Different titles in marks, shorter than ``most``, by code point."""
    return F.array_sort(F.array_distinct(F.filter(titles, lambda t: F.length(t) < most)))
