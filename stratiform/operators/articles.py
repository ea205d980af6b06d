"""Reports read back as dimensions, figures put into articles, contexts of references, and the registry of sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Name of a report without headings, default type of a reference, project and phase, marks of parsers, most rows shown.
WHOLE, REFERENCE, PROJECT, PHASE = "规划内容", "法规", "村庄规划", "init"
UNKNOWN = "未知"
PARSER, SECONDS = r"<!--\s*解析器:\s*([\p{L}\p{N}_]+)\s*-->", r"<!--\s*解析耗时:\s*([\d.]+)s\s*-->"
REGULATIONS, REFERENCES, PROJECT_CHARS, KEPT_EVENTS, KEY_POINTS, POINT_CHARS, DETAILED = 5, 3, 50, 500, 5, (4, 50), 5
# Summary fields by the figure they stand in for.
SUMMARY_FIELDS = {
    "population_registered": ("socio_economic.registered_population",), "population_resident": ("socio_economic.resident_population",), "population_household": ("socio_economic.households",),
    "total_area_ha": ("land_use.total_area_ha",), "farmland_ha": ("land_use.farmland_area_ha",), "construction_land_ha": ("land_use.construction_area_ha",), "ecological_land_ha": ("land_use.ecological_area_ha",),
    "water_ha": ("land_use.water_area_ha",), "forest_coverage_pct": ("land_use.forest_coverage_rate", "natural_environment.forest_coverage_rate"), "building_count": ("architecture.total_buildings",),
}
PLACES = ["province", "city", "county", "town"]
_SUBS = "array<struct<title:string,content:string>>"

# A line starts at the text's start or after a line end; an empty line, the end after a line end included, ends a section.
# What a section holds is taken line by line, so each character is looked at once; its last line must end.
_EOL = r"\n\r\u2028\u2029"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _section(mark: str, end: str) -> str:
    head, lines = rf"{mark}(?<![^{_EOL}]{mark}){_SPACE}+([^{_EOL}]+)\n", rf"(?:(?!{end}{_SPACE})[^{_EOL}]++[{_EOL}])*+"
    return rf"{head}({lines})(?={end}{_SPACE}|[{_EOL}]|\z)"


DIMENSION, SUBSECTION = _section("##", "##"), _section("###", "###?")
_NAMED = rf"^#+{_SPACE}+([^{_EOL}]+)\n((?s:.*))"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _parts(text: Column, pattern: str, name: str) -> Column:
    """Trimmed (name, content) of every match, in order: matches are found once and then taken apart."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(*[_trim(F.regexp_extract(m, _NAMED, i)).alias(c) for i, c in ((1, name), (2, "content"))]))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def dimensions_of(text: Column) -> Column:
    """Dimensions of a layer's report: array of (name, content, subsections of (title, content)).

    A section runs from its ``##`` line to the next one or the first empty line; the last one counts only
    if its last line ends. Sections without a name or content are left out; ``content`` is what stands
    before the first ``###``, or all of it where nothing does. A text without sections is one dimension,
    a blank or null one none.
    """
    trimmed = _trim(F.coalesce(text, F.lit("")))

    def shaped(d: Column) -> Column:
        c = d["content"]
        cut = F.locate("### ", c)
        main = F.when(cut > 0, _trim(F.substring_index(c, "### ", 1))).otherwise(c)
        subs = F.when(cut > 0, _parts(c, SUBSECTION, "title")).otherwise(F.array().cast(_SUBS))
        return F.struct(d["name"].alias("name"), F.when(main == "", c).otherwise(main).alias("content"), subs.cast(_SUBS).alias("subsections"))

    found = F.filter(_parts(text, DIMENSION, "name"), lambda d: (d["name"] != "") & (d["content"] != ""))
    whole = F.struct(F.lit(WHOLE).alias("name"), trimmed.alias("content"), F.array().cast(_SUBS).alias("subsections"))
    kind = f"array<struct<name:string,content:string,subsections:{_SUBS}>>"
    return F.when(trimmed == "", F.array().cast(kind)).otherwise(_let(found, lambda d: F.when(F.size(d) > 0, F.transform(d, shaped).cast(kind)).otherwise(F.array(whole).cast(kind))))


def parser_of(text: Column) -> Column:
    """struct(parser, parse_time) of the first marks in a document, null where absent."""
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.struct(first(PARSER).alias("parser"), first(SECONDS).alias("parse_time"))


def filled_figures(df: DataFrame, summaries: str, config: str) -> DataFrame:
    """Figures and places of ``df`` completed: a place of ``config`` wins over all, summaries fill what is empty or 0.

    ``summaries`` and ``config`` are JSON texts. Figures are the columns of ``SUMMARY_FIELDS`` that ``df``
    has, places those of ``PLACES``; a summary's empty text, 0 or text that is no number fills nothing.
    """
    s, c = F.try_parse_json(summaries), F.try_parse_json(config)
    text = lambda v, path: F.nullif(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))
    out = {}
    for name in (p for p in PLACES if p in df.columns):
        out[name] = F.coalesce(text(c, name), F.nullif(F.col(name), F.lit("")), text(s, f"location.{name}"), F.lit(""))
    for name, paths in SUMMARY_FIELDS.items():
        if name in df.columns:
            kind = df.schema[name].dataType
            given = [F.nullif(text(s, p).try_cast("double").cast(kind), F.lit(0).cast(kind)) for p in paths]
            out[name] = F.coalesce(F.nullif(F.col(name), F.lit(0).cast(kind)), *given, F.lit(0).cast(kind))
    return df.withColumns(out)


def article_context(number: Column, f: Column) -> Column:
    """The text handed to the writer of an article: its facts for the first, its aims for the seventh, figures for all others.

    ``f`` is a struct of village, period, place columns, law lists (national, provincial, planning),
    positioning, goal, endowment, strategies, resident, registered, area, farmland, forest, villages. Lists
    and texts are cut to the article's bounds; empty ones are left out.
    """
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    line = lambda label, c, chars: F.when(has(c), F.concat(F.lit(label), F.substring(c, 1, chars)))
    or_else = lambda c, default: F.when(has(c), c).otherwise(F.lit(default))
    place = F.concat(*[F.coalesce(f[p], F.lit("")) for p in PLACES])
    laws = F.concat(*[F.slice(F.coalesce(f[n], F.array().cast("array<string>")), 1, k) for n, k in (("national", 5), ("provincial", 5), ("planning", 3))])
    ha = lambda c: F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    first = [
        F.concat(F.lit("村庄名称："), or_else(f["village"], "本村")), F.concat(F.lit("所在位置："), or_else(place, "所在地区")), F.concat(F.lit("规划期限："), f["period"]),
        F.when(F.size(laws) > 0, F.concat(F.lit("编制依据："), F.array_join(laws, "；"))), line("规划定位：", f["positioning"], 200),
    ]
    seventh = [line("规划定位：\n", f["positioning"], 800), line("发展目标：", f["goal"], 500), line("资源禀赋：", f["endowment"], 500), line("规划策略：", f["strategies"], 500)]
    other = [
        F.concat(F.lit("项目名称："), or_else(f["village"], "村庄"), F.lit("规划（"), f["period"], F.lit("）")),
        F.concat(F.lit("项目概况：村庄位于"), or_else(place, "所在省/市/县/镇"), F.lit("，下辖"), text(f["villages"]), F.lit("个自然村")),
        F.when(f["resident"] != 0, F.concat(F.lit("常住人口："), text(f["resident"]), F.lit("人，户籍人口："), text(f["registered"]), F.lit("人"))),
        F.when(f["area"] != 0, F.concat(F.lit("村域总面积："), ha(f["area"]), F.lit("公顷"))), line("规划定位：", f["positioning"], 300), line("发展目标：", f["goal"], 200),
        F.concat(F.lit("耕地保有量："), ha(f["farmland"]), F.lit("公顷")), F.concat(F.lit("森林覆盖率："), text(f["forest"]), F.lit("%")), F.concat(F.lit("自然村数量："), text(f["villages"]), F.lit("个")),
    ]
    joined = lambda parts: F.array_join(F.array_compact(F.array(*parts)), "\n")
    return F.when(number == 1, joined(first)).when(number == 7, joined(seventh)).otherwise(joined(other))


def reference_context(hits: DataFrame, by: str, rank: str, doc_types: Sequence[str] = (), most: int = REFERENCES) -> DataFrame:
    """(by, text): the best ``most`` hits (rank, source, doc_type, content) of each query as numbered references.

    ``doc_types`` keeps hits of those types only. Hits of equal rank go by source, then content.
    """
    kept = hits.where(F.col("doc_type").isin(*doc_types)) if doc_types else hits
    top = _ranked(kept, by, rank, most)
    part = F.concat(F.lit("【参考"), F.col("_n").cast("string"), F.lit(" - "), F.coalesce("doc_type", F.lit(REFERENCE)), F.lit("】\n来源: "), F.coalesce("source", F.lit("Unknown")), F.lit("\n内容:\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    return top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def _ranked(hits: DataFrame, by: str, rank: str, most: int) -> DataFrame:
    order = [F.col(rank), F.col("source").asc_nulls_last(), F.col("content").asc_nulls_last()]
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most)


def detailed_context(hits: DataFrame, by: str, rank: str, most: int = DETAILED) -> DataFrame:
    """(by, text): source, place (page, else paragraph) and content of the best hits of each query, unknown where null."""
    known = lambda *c: F.coalesce(*[F.col(x).cast("string") for x in c], F.lit(UNKNOWN))
    part = F.concat(F.lit("来源: "), known("source"), F.lit("\n位置: "), known("page", "paragraph"), F.lit("\n内容: "), F.coalesce("content", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", part.alias("t")))), lambda x: x["t"]), "\n\n")
    return _ranked(hits, by, rank, most).groupBy(by).agg(text.alias("text"))


def key_points(text: Column) -> Column:
    """The first headings of level three and deeper, then bold passages not among them, each of 4 to 50 characters; a heading may repeat."""
    low, high = POINT_CHARS
    found = lambda p: F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)), _trim), lambda t: F.length(t).between(low, high))
    headings = found(rf"###{_SPACE}+([^\n]+)")
    return F.slice(F.concat(headings, F.array_except(found(r"\*\*([^\n]+?)\*\*"), headings)), 1, KEY_POINTS)


def regulation_context(keys: DataFrame, regulations: DataFrame, key: str, most: int = REGULATIONS) -> DataFrame:
    """(key, name, n_regulations, total_length, text): the first regulations (key, name, pos, source, content) of each key asked for.

    A key without any is named by itself and has an empty text.
    """
    top = regulations.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos", "source", "content"))).where(F.col("_n") <= most)
    part = F.concat(F.lit("【"), F.coalesce("source", F.lit("")), F.lit("】\n"), F.coalesce("content", F.lit("")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", part.alias("t")))), lambda x: x["t"]), "\n\n")
    told = top.groupBy(key).agg(F.min("name").alias("name"), F.count("*").alias("n_regulations"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("total_length"), text.alias("text"))
    return keys.select(key).distinct().join(told, key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string"))).fillna({"n_regulations": 0, "total_length": 0, "text": ""})


def layer_completed(reports: DataFrame, session: str, layer: str, content: str, phase: Column, pause: Column) -> DataFrame:
    """(session, layer, event): the JSON of the event that tells a layer's end, with counts of its reports and characters."""
    counts = reports.groupBy(session, layer).agg(F.count("*").alias("report_count"), F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("total_chars"))
    event = F.struct(F.lit("layer_completed").alias("type"), F.col(layer).alias("layer"), phase.alias("phase"), "report_count", "total_chars", pause.alias("pause_after_step"), (F.col(layer) - 1).alias("previous_layer"), F.col(session).alias("session_id"))
    return counts.select(session, layer, F.to_json(event).alias("event"))


def checkpoint_saved(checkpoint: Column, layer: Column, phase: Column, session: Column, revised: Column) -> Column:
    """JSON of a saved checkpoint; ``revised`` (null: no revision) lists the revised dimensions."""
    revision = F.when(revised.isNotNull(), True)
    return F.to_json(F.struct(F.lit("checkpoint_saved").alias("type"), checkpoint.alias("checkpoint_id"), layer.alias("layer"), phase.alias("phase"), session.alias("session_id"), revision.alias("is_revision"), revised.alias("revised_dimensions")))


def session_completed(session: Column) -> Column:
    """JSON of the event that a session is done."""
    return F.to_json(F.struct(F.lit("completed").alias("type"), session.alias("session_id")))


def session_failed(session: Column, message: Column) -> Column:
    """JSON of the event that a session failed; a null message is left out."""
    return F.to_json(F.struct(F.lit("error").alias("type"), session.alias("session_id"), message.alias("message")))


def layer_started(layer: Column, name: Column, dimensions: Column, session: Column) -> Column:
    """JSON of the event that a layer begins, with the number of its dimensions."""
    return F.to_json(F.struct(F.lit("layer_started").alias("type"), layer.alias("layer"), name.alias("layer_name"), dimensions.alias("dimension_count"), session.alias("session_id")))


def session_view(state: Column) -> Column:
    """struct(phase, project_name) of a session's state as JSON, with their defaults; a name taken from its village data is cut."""
    v = F.try_parse_json(state)
    get = lambda path: F.try_variant_get(v, path, "string")
    name = F.coalesce(get("$.project_name"), F.substring(F.coalesce(get("$.config.village_data"), F.lit(PROJECT)), 1, PROJECT_CHARS))
    return F.struct(F.coalesce(get("$.phase"), F.lit(PHASE)).alias("phase"), name.alias("project_name"))


def registry_results(log: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """The log of a registry (session, order, op, key, value) with what each operation found: ``ok`` and ``epoch``.

    ``init`` starts a session anew, ``delete`` ends it; ``set`` and ``append`` need a session that is there.
    A session's epoch counts its starts and ends so far, so values of an earlier life are never seen.
    One window over a session's operations; nothing is gathered.
    """
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boundary = F.col("op").isin("init", "delete")
    last = F.last(F.when(boundary, F.col("op")), ignorenulls=True)
    out = log.withColumns({"epoch": F.count(F.when(boundary, 1)).over(w), "_state": last.over(w), "_before": last.over(w.rowsBetween(Window.unboundedPreceding, -1))})
    ok = F.when(F.col("op") == "init", True).when(F.col("op") == "delete", F.coalesce(F.col("_before") == "init", F.lit(False))).otherwise(F.coalesce(F.col("_state") == "init", F.lit(False)))
    return out.withColumn("ok", ok).drop("_before")


def registry_values(log: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """(session, key, value) of sessions that are there after all operations: the last value set for each key of their last life."""
    done = registry_results(log, session, order)
    last = done.groupBy(session).agg(F.max("epoch").alias("epoch"))
    live = done.where("op = 'set' and ok").join(last, [session, "epoch"])
    return live.groupBy(session, "key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def registry_history(log: DataFrame, session: str, order: Sequence[str], most: int = KEPT_EVENTS) -> DataFrame:
    """(session, order, value, place): the newest ``most`` values appended in the last life of each session, oldest first."""
    done = registry_results(log, session, order)
    last = done.groupBy(session).agg(F.max("epoch").alias("epoch"))
    live = done.where("op = 'append' and ok").join(last, [session, "epoch"])
    w = Window.partitionBy(session)
    back = F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))
    kept = live.withColumn("_back", back).where(F.col("_back") <= most)
    return kept.select(session, *order, "value", F.row_number().over(w.orderBy(*order)).alias("place"))
