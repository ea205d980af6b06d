"""Text rules as column expressions: cleaning, headings, tags, extraction. Vocabularies are parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Planning vocabulary by dimension, terrain and document type, in order of preference.
DIMENSION_WORDS = {
    "land_use": ["用地", "土地", "三区三线", "建设用地", "农用地", "宅基地"],
    "infrastructure": ["给排水", "供水", "排水", "电力", "通信", "环卫"],
    "ecological_green": ["生态", "绿地", "景观", "绿化", "公园"],
    "historical_culture": ["文物", "历史", "文化", "保护", "古建筑"],
    "traffic": ["道路", "交通", "路网", "停车"],
    "location": ["区位", "位置", "边界", "行政区划"],
    "socio_economic": ["经济", "产业", "收入", "人口", "GDP"],
    "villager_wishes": ["意愿", "诉求", "需求", "建议"],
    "superior_planning": ["上位规划", "政策", "法规", "纲要"],
    "natural_environment": ["自然", "环境", "气候", "地形", "地貌"],
    "public_services": ["公共服务", "教育", "医疗", "养老"],
    "architecture": ["建筑", "房屋", "住宅", "风貌"],
    "disaster_prevention": ["灾害", "防灾", "消防", "防洪"],
    "industry_development": ["产业", "发展", "特色", "农业", "旅游"],
    "governance": ["治理", "组织", "党建", "村规民约"],
}
TERRAIN_WORDS = {"mountain": ["山区", "山地", "丘陵", "坡"], "plain": ["平原", "盆地", "平坦"], "hill": ["丘陵", "岗地", "低山"], "coastal": ["沿海", "滨海", "海岛"], "riverside": ["沿江", "滨河", "水乡"]}
DOC_TYPE_WORDS = {"policy": ["政策", "意见", "办法", "规定", "条例"], "standard": ["标准", "规范", "规程", "技术", "GB"], "case": ["案例", "示范", "典型", "经验"], "guide": ["指南", "手册", "教程", "指导"], "report": ["报告", "调研", "分析", "研究"]}
REGION_PATTERN = "([一-龥]+{})"
#: The same rules for the corpus at hand.
ENGLISH_WORDS = {"land": ["land", "and"], "water": ["ing", "tion"], "road": ["ment", "que"], "people": ["the", "der"], "nature": ["ad", "lich"]}


def hits(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in dict.fromkeys(words)), F.lit(0))


def top_tags(text: Column, vocabulary: dict[str, list[str]], k: int = 3) -> Column:
    """Keys with the most words found, ties in the vocabulary's order; an array of ``k`` at most."""
    entries = F.array(*[F.struct((-hits(text, words)).alias("s"), F.lit(i).alias("i"), F.lit(key).alias("key")) for i, (key, words) in enumerate(vocabulary.items())])
    found = F.array_sort(F.filter(entries, lambda e: e["s"] < 0))
    return F.transform(F.slice(found, 1, k), lambda e: e["key"])


def best_tag(text: Column, vocabulary: dict[str, list[str]], none: str) -> Column:
    return F.coalesce(F.try_element_at(top_tags(text, vocabulary, 1), F.lit(1)), F.lit(none))


def first_tag(text: Column, vocabulary: dict[str, list[str]], none: str) -> Column:
    """The first key of which any word occurs."""
    out = None
    for key, words in vocabulary.items():
        out = F.when(hits(text, words) > 0, key) if out is None else out.when(hits(text, words) > 0, key)
    return out.otherwise(none)


def clean_markdown(text: Column) -> Column:
    """Newline runs to two, trailing blanks, carriage returns, byte-order mark, control characters, outer space."""
    steps = [(r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"), (r"\r\n", "\n"), ("﻿", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")]
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and navigation."""
    for tag in ("script", "style", "nav", "footer", "header"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(html, r"[ \t\r\n]+", " "))


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    return F.concat_ws("_", source, index.cast("string"), F.substring(F.md5(content.cast("binary")), 1, 8))


def cache_key(query: Column, parameters: Column) -> Column:
    return F.md5(F.concat(query, F.lit(":"), parameters).cast("binary"))


def has_table(text: Column) -> Column:
    return text.contains("<table>") | (text.contains("|") & text.contains("---"))


# Headings by pattern in the order in which they are tried, with their kind and level (0: not told by the
# pattern). The last six need a blank line or a heading before, or a line of text that is not numbered after.
HEADINGS = [
    (r"^第([一二三四五六七八九十百零]+)([章节部分编目])\s*(.*)$", "by unit", 0, False),
    (r"^第([一二三四五六七八九十百零]+)([条款目])\s*(.*)$", "article", 0, False),
    (r"^第?(\d+(?:\.\d+)+)[条款]?\s*(.*)$", "article", None, False),
    (r"^([一二三四五六七八九十]+)[、\.]\s*(.+)$", "section", 2, True),
    (r"^[（\(]([一二三四五六七八九十]+)[）\)]\s*(.*)$", "item", 3, True),
    (r"^(\d+)[\.\、]\s*(.+)$", "section", 2, True),
    (r"^[（\(]?(\d+)[）\)]\s*(.+)$", "item", 3, True),
    (r"^([IVXLCDM]+)[\.\、]\s*(.+)$", "section", 2, True),
    (r"^([ivxlcdm]+)[\)）]\s*(.+)$", "item", 3, True),
]
# Kinds by unit of the first pattern.
UNITS = {"编": "chapter", "章": "chapter", "节": "section", "部": "chapter", "分": "chapter", "目": "item"}
#: Levels of kinds whose pattern tells none.
KIND_LEVELS = {"chapter": 1, "section": 2, "article": 3, "item": 3}
#: What any heading starts with: other lines are told by one look.
_OPENS = r"^[#第一二三四五六七八九十（(\dIVXLCDMivxlcdm]"
# What a numbered line starts with.
NUMBERED = r"^(?:\d+[.)、]|[（(]\d+[）)]|[一二三四五六七八九十]+[、.)]|[（(][一二三四五六七八九十]+[）)])"


def numbered_line(line: Column) -> Column:
    return F.trim(line).rlike(NUMBERED)


def heading_kind(line: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """(kind, level) of a heading, null for other lines; the first pattern that holds counts, level 0 where it tells none.

    ``before`` and ``after`` are the lines around it, null at the ends of a text; without them
    the lines around are taken to allow a heading.
    """
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    alone = F.lit(True)
    if before is not None:
        b, a = F.trim(F.coalesce(before, F.lit(""))), F.trim(F.coalesce(after, F.lit("")))
        alone = (F.length(s) < 100) & ((b == "") | b.startswith("#") | ((a != "") & ~numbered_line(a)))
    kind = lambda k, level: F.struct(k.alias("kind"), level.cast("int").alias("level"))
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    out = F.when(~s.rlike(_OPENS), F.lit(None)).when(s.startswith("#"), kind(F.lit("markdown"), F.length(F.regexp_extract(s, "^(#+)", 1))))
    for pattern, name, level, free in HEADINGS:
        dots = F.length(F.regexp_replace(F.regexp_extract(s, r"^第?(\d+(?:\.\d+)+)", 1), "[^.]", ""))
        hit = s.rlike(pattern) & (alone if free else F.lit(True))
        if free and pattern.startswith(r"^(\d") and after is not None:
            hit = hit & ~F.trim(F.coalesce(after, F.lit(""))).rlike(r"^\d+[.、]")
        named = units[F.regexp_extract(s, pattern, 2)] if name == "by unit" else F.lit(name)
        out = out.when(hit, kind(named, F.lit(level) if level is not None else dots + 1))
    return out


def heading_level(line: Column) -> Column:
    """1 to 4 for Markdown and numbered headings, else null; kinds without a level of their own have that of ``KIND_LEVELS``."""
    kind = heading_kind(line)
    levels = F.create_map(*[F.lit(x) for pair in KIND_LEVELS.items() for x in pair])
    level = F.when(kind["level"] > 0, kind["level"]).otherwise(levels[kind["kind"]])
    return F.when(level.isNotNull() & (F.trim(line).startswith("#") | (F.length(line) < 100)), F.least(level, F.lit(4)))


def as_heading(line: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(4))), F.lit(" "), F.regexp_replace(line, r"^#+\s*", ""))


def regions(text: Column) -> Column:
    """Administrative names in a text, by kind, first mention first."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(REGION_PATTERN.format(k)), F.lit(1)) for k in "省市县镇村"]))
    return F.array_distinct(found)


# Parts of an address; each reaches as far back as it may, so a city holds its province.
ADDRESS = {"province": "(.+省)", "city": "(.+市)", "county": "([^省市]+县)", "town": "([^县市省]+镇)", "village": "([^县市省镇]+村)(?![委会])"}


def address_parts(text: Column) -> Column:
    """province, city, county, town and village of an address, null where absent."""
    return F.struct(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(k) for k, p in ADDRESS.items()])


def is_village(text: Column) -> Column:
    """Whether an address names a village."""
    return F.coalesce(text.rlike(ADDRESS["village"]), F.lit(False))


# Figures of a planning text, by name.
METRICS = {
    "area_ha": r"([\d.]+)\s*公顷", "area_mu": r"([\d.]+)\s*亩", "population": r"(\d+)\s*人", "households": r"(\d+)\s*户",
    "percentage": r"([\d.]+)\s*%", "amount_wan_yuan": r"([\d.]+)\s*万元", "length_km": r"([\d.]+)\s*km", "area_sqm": r"([\d.]+)\s*m[²2]",
}


def metrics(text: Column) -> dict[str, Column]:
    """The first value of each figure, null if absent or no number."""
    return {k: first_number(text, p) for k, p in METRICS.items()}


# Words of a document's name by its type, in the order in which they are tried.
DOC_TYPES = [
    ("textbook", "教材|原理|教程|导论|基础|入门|读本"),
    ("guide", "指南|手册|指导|操作|规程"),
    ("policy", "条例|规定|办法|通知|意见|决定|批复"),
    ("standard", "标准|规范|gb|cjj|cj|hg|jc|jg|jt"),
    ("case", "规划|设计|方案|案例|实例|工程"),
]
# A chapter in a text, and the number of a standard in a title.
CHAPTER, STANDARD_NUMBER = r"第[一二三四五六七八九十\d]+章", r"(?i)[A-Z]{2,4}[/\-]?\d{4,}"


def _by_name(out: Column, name: Column, types: list[tuple[str, str]]) -> Column:
    for kind, words in types:
        out = out.when((F.lower(name) if kind == "standard" else name).rlike(words), kind)
    return out.otherwise("report")


def doc_type_of_file(name: Column, content: Column) -> Column:
    """Type of a document by its file name; a text in chapters is a textbook."""
    return _by_name(F.when(F.coalesce(content.rlike(CHAPTER), F.lit(False)), "textbook"), name, DOC_TYPES)


def doc_type_of_title(title: Column) -> Column:
    """Type by the title: one with a standard's number is a standard, one with 法 a policy."""
    return _by_name(F.when(title.rlike(STANDARD_NUMBER), "standard"), title, [(k, w + "|法" if k == "policy" else w) for k, w in DOC_TYPES])


def first_number(text: Column, pattern: str) -> Column:
    """First capture as a number, null if absent or no number."""
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def key_points(text: Column, n: int = 5) -> Column:
    """Third-level headings, then bold runs that are none of them, of 4 to 50 characters, ``n`` at most."""
    fit = lambda p: F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x).between(4, 50))
    headings, bold = fit(r"###\s+([^\n]+)"), fit(r"\*\*([^\n]+?)\*\*")
    return F.slice(F.concat(headings, F.array_except(bold, headings)), 1, n)


def first_json(text: Column) -> Column:
    """The first JSON object of a text, code fences taken off; null if there is none."""
    body = F.regexp_replace(text, "```(?:json)?", "")
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def compact_count(n: Column) -> Column:
    return F.when(n >= 1000, F.format_string("%.1fk", n / 1000.0)).otherwise(n.cast("string"))


def parse_time(text: Column) -> Column:
    """ISO or YYYYMMDD_HHMMSS, null if neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss")), F.try_to_timestamp(text))
