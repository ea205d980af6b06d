"""Knowledge sources of reports, text handed from reports to the next ones, and rows that put scores together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.operators import planning as N, quality as Q

# Labels of document types, the head of the appendix, types that are no legal basis, the strategy that is filled.
TYPE_LABELS = {"policy": "法规", "standard": "标准", "textbook": "教材", "case": "案例", "planning": "上位规划", "guide": "指南"}
HEAD = "## 附录：知识来源与参考依据"
NOT_LEGAL = ["textbook", "case", "report"]
GENERATED = "S-GENERATE"
# Most key points, metrics and characters of a summary that are handed on, characters of a text that stand for its context.
POINTS, METRICS, SUMMARY_CHARS, CONTEXT_CHARS = 5, 8, 200, 500
_CHUNK = "struct<title:string,doc_type:string,source:string>"


def chunks_of(sources: Column) -> Column:
    """Chunks of a JSON text: the list in ``retrieved_chunks`` of an object, or the objects of a list; empty for all else."""
    v = F.try_parse_json(sources)
    kind = F.schema_of_variant(v)
    path = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.retrieved_chunks", "array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    objects = F.filter(path, lambda c: F.schema_of_variant(c).startswith("OBJECT"))
    text = lambda c, name: F.coalesce(F.try_variant_get(c, f"$.{name}", "string"), F.lit(""))
    return F.coalesce(F.transform(objects, lambda c: F.struct(*[text(c, n).alias(n) for n in ("title", "doc_type", "source")])), F.array().cast(f"array<{_CHUNK}>"))


def cleaned_name(source: Column) -> Column:
    """A file's name without the mark of its parser and what follows the last one, and without its ending."""
    return F.trim(F.regexp_replace(F.regexp_replace(source, r"(?s)^(.*)_minerU_parsed.*$", "$1"), r"\.md$", ""))


def named(df: DataFrame, names: DataFrame, key: str = "dimension_key", name: str = "dimension_name") -> DataFrame:
    """Rows with the name of their key, the key itself where it has none. Names are those of a fixed outline."""
    return df.join(names.select(F.col("key").alias("_k"), F.col("name").alias("_n")), F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_n", F.col(key))).drop("_k", "_n")


def report_sources(reports: DataFrame, known: DataFrame, by: list[str], fill_types: bool = True) -> DataFrame:
    """(by, place, title, doc_type): the different sources of each report by title, as they first occur.

    ``known`` (source, title, doc_type) tells of files. A chunk without a title takes that of its
    file, else the file's cleaned name; without a type it takes the file's, too, if ``fill_types``,
    else only together with the title, and then whatever it had. Chunks without either are none.
    """
    c = reports.select(*by, F.posexplode(chunks_of(F.col("knowledge_sources"))).alias("place", "c")).select(*by, "place", "c.*")
    k = known.groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("t"), F.coalesce("doc_type", F.lit("")).alias("d"))).alias("_i"))
    c = c.join(k, (F.col("source") == F.col("_s")) & (F.col("source") != ""), "left")
    untitled, untyped, has = F.col("title") == "", F.col("doc_type") == "", F.col("source") != ""
    kind = F.when(has & ((untyped if fill_types else F.lit(False)) | (untitled & F.lit(not fill_types))), F.coalesce("_i.d", F.lit(""))).otherwise(F.col("doc_type"))
    title = F.when(untitled & has, F.coalesce(F.nullif("_i.t", F.lit("")), cleaned_name(F.col("source")))).otherwise(F.col("title"))
    rows = c.select(*by, "place", title.alias("title"), kind.alias("doc_type")).where("title <> ''")
    first = F.row_number().over(Window.partitionBy(*by, "title").orderBy("place"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def source_rows(reports: DataFrame, known: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """(by, dimension_name, sources): the sources of each report that has any, as a list by place."""
    s = report_sources(reports, known, by)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "title", "doc_type"))), lambda x: F.struct(x["title"].alias("source"), x["doc_type"].alias("doc_type"), F.lit("").alias("section")))
    return named(s.groupBy(*by).agg(listed.alias("sources")), names)


def appendix(reports: DataFrame, known: DataFrame, names: DataFrame, session: str) -> DataFrame:
    """(session, text): the appendix of sources of each session, layers 1 to 3 in order and reports by ``pos``; none without sources."""
    s = report_sources(reports.where("layer between 1 and 3"), known, [session, "layer", "pos", "dimension_key"], fill_types=False)
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    line = F.concat(F.lit("- ["), F.coalesce(labels[F.col("doc_type")], F.col("doc_type")), F.lit("] "), F.col("title"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    block = named(s.groupBy(session, "layer", "pos", "dimension_key").agg(parts.alias("_lines")), names)
    text = F.concat(F.lit("### 【Layer"), F.col("layer").cast("string"), F.lit(" - "), "dimension_name", F.lit("】\n"), "_lines", F.lit("\n"))
    blocks = F.array_sort(F.collect_list(F.struct("layer", "pos", text.alias("t"))))
    return block.groupBy(session).agg(F.concat(F.lit(f"\n{HEAD}\n\n"), F.array_join(F.transform(blocks, lambda b: b["t"]), "\n")).alias("text"))


def is_legal(doc_type: Column) -> Column:
    """Whether a document may be a legal basis by its type; one of unknown type may."""
    return ~F.coalesce(doc_type.isin(*NOT_LEGAL), F.lit(False))


def filled(articles: DataFrame, generated: DataFrame, key: str = "number", strategy: str = "strategy", content: str = "content") -> DataFrame:
    """Articles whose text is to be generated with the text generated for them, where there is one; all others as they are."""
    g = generated.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    out = articles.join(g, F.col(key) == F.col("_k"), "left")
    return out.withColumn(content, F.when(F.col("_k").isNotNull() & (F.col(strategy) == GENERATED), F.col("_c")).otherwise(F.col(content))).drop("_k", "_c")


def dependency_text(required: DataFrame, reports: DataFrame, names: DataFrame, target: str) -> DataFrame:
    """(target, text): the reports that each target requires (target, key, pos), under their names, in order; empty without any."""
    r = reports.select(F.col("key").alias("dimension_key"), "content")
    met = named(required.select(target, F.col("key").alias("dimension_key"), "pos").join(r, "dimension_key"), names)
    part = F.concat(F.lit("### "), "dimension_name", F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    texts = met.groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return required.select(target).distinct().join(texts, target, "left").withColumn("text", F.coalesce("text", F.lit("")))


def summary_prompt(summaries: DataFrame, by: str, order: str = "pos") -> DataFrame:
    """(by, text): summaries as a prompt tells them, one after the other.

    ``summaries`` have dimension_key, key_points, metrics (a map, in its own order) and
    text_summary; what is null or empty is left out.
    """
    points = F.array_join(F.slice("key_points", 1, POINTS), "；")
    pairs = F.array_join(F.transform(F.slice(F.map_entries("metrics"), 1, METRICS), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    lines = F.array(
        F.concat(F.lit("【"), "dimension_key", F.lit("】")), F.when(F.size("key_points") > 0, F.concat(F.lit("关键要点："), points)), F.when(F.size("metrics") > 0, F.concat(F.lit("核心指标："), pairs)),
        F.when(F.length("text_summary") > 0, F.concat(F.lit("摘要："), F.substring("text_summary", 1, SUMMARY_CHARS))),
    )
    told = F.struct(order, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("t"))
    return summaries.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), "\n\n").alias("text"))


def keyword_alignment(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (downstream_dim, target, downstream) with ``keyword_score``: the share of expected words that occur.

    ``words`` (pos, downstream_dim, words) lists them by target dimension: the first that speaks of
    the downstream one counts. Without any, frequent phrases of the target decide. There is a row of
    words for each dimension of the plan, a fixed vocabulary, so they go to the texts, not texts to them.
    """
    first = words.where(F.size("words") > 0).groupBy(F.col("downstream_dim").alias("_d")).agg(F.min_by("words", "pos").alias("_w"))
    out = pairs.join(F.broadcast(first), F.col("downstream_dim") == F.col("_d"), "left")
    found = F.size(F.filter("_w", lambda w: F.contains(F.col("downstream"), w))) / F.nullif(F.size("_w"), F.lit(0))
    return out.withColumn("keyword_score", F.when(F.col("_d").isNotNull(), found).otherwise(N.frequent_phrases_kept(F.col("target"), F.col("downstream")))).drop("_d", "_w")


def revision_waves(impact: DataFrame, completed: DataFrame) -> DataFrame:
    """(session_id, wave, dimension_key) of completed dimensions, by the impact table that names their waves."""
    return impact.join(completed.select("session_id", "dimension_key").distinct(), ["session_id", "dimension_key"]).select("session_id", "wave", "dimension_key")


def synchronised(numbered: DataFrame, requests: DataFrame, session: str, keep: int = 50) -> DataFrame:
    """Each request (session, from_seq) with the events it lacks among the last ``keep``, and the last number; unknown sessions go."""
    late = Window.partitionBy(session).orderBy(F.desc("seq"))
    tail = numbered.withColumn("_n", F.row_number().over(late)).where(F.col("_n") <= keep)
    met = tail.join(requests.select(session, "from_seq"), session)
    return met.groupBy(session, "from_seq").agg(F.sort_array(F.collect_list(F.when(F.col("seq") > F.col("from_seq"), F.col("seq")))).alias("seqs"), F.max("seq").alias("last_seq"))


def knowledge_context(snippets: Column, content: Column, most: int = CONTEXT_CHARS) -> Column:
    """What a text is held against: the snippets kept for it, else its own beginning."""
    return F.when(F.size(snippets) > 0, F.array_join(snippets, " ")).otherwise(F.substring(content, 1, most))


def quality_rows(texts: DataFrame, rates: DataFrame, key: str, rules: dict | None = None) -> DataFrame:
    """(key, text_length, faithfulness, n_claims, depth, reason) of each text, by the support of its claims (``rates``)."""
    score = Q.depth(F.col("text"), rules)
    out = texts.join(rates.select(key, "n_claims", "faithfulness"), key, "left")
    return out.select(key, F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), F.coalesce("faithfulness", F.lit(1.0)).alias("faithfulness"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), score.alias("depth"), Q.depth_reason(F.col("text"), score).alias("reason"))


def mean_consistency(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean score over the dimensions of each run, 0 without any."""
    return scores.groupBy(*by).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("overall"), F.count(score).alias("dims"))


def feature_counts(features: DataFrame, layer: str, category: str) -> DataFrame:
    """Features of each layer, in all and by category: (layer, category, n); category null for all."""
    return features.rollup(layer, category).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")).where("_g < 3").select(layer, category, F.col("_g").cast("boolean").alias("all_categories"), "n")
