"""Citations in texts: extraction, existence in a knowledge base, accuracy, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Patterns of citations by kind.
CHINESE_CITATIONS = {
    "law": ["《[^》]+法》", "《[^》]+条例》", "《[^》]+规定》", "《[^》]+办法》", "《[^》]+导则》", "《[^》]+标准》", "《[^》]+规范》"],
    "clause": ["第[一二三四五六七八九十百]+条", r"第\d+条"],
    "indicator": [r"不少于\s*\d+\s*米", r"不低于\s*\d+\s*米", r"≥\s*\d+\s*米", r"\d+\s*年一遇", r"人均\s*\d+[-~]\d+\s*平方米", r"不超过\s*\d+%", r"不低于\s*\d+%"],
    "standard": [r"GB\s*\d+[-\d]*", r"GB/T\s*\d+[-\d]*", r"DB\d+/\d+[-\d]*", r"CJJ\s*\d+[-\d]*", r"SL\s*\d+[-\d]*"],
}
# Contexts that make a citation support an argument, and that make it mere decoration.
SUPPORTIVE = "根据.*应|依据.*须|按照.*要求|按照.*标准|符合.*规定|遵守.*条例"
DECORATIVE = "参考|借鉴|参照|可参考|详见"
#: Characters to both sides that are a citation's context, points from which it is accurate, points where nothing can be compared.
AROUND, ACCURATE, UNKNOWN = 100, 70.0, 50.0


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (citation, position), positions from 0: the pieces between them tell where each starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.greatest(F.size(found), F.lit(0))).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<citation:string,position:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        here = F.array(F.struct(x["m"].alias("citation"), at.cast("int").alias("position")))
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], here).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def extract(docs: DataFrame, patterns: dict[str, list[str]] | None = None, around: int = AROUND) -> DataFrame:
    """(doc_id, order, position, kind, citation, context): each different citation of a text and kind, by position.

    A citation stands where the first of its kind's patterns that finds it does so first, and its
    context is the text around that place. Of equal positions those of earlier patterns come
    first. Patterns must not match an empty text. Null texts have none.
    """
    patterns = patterns or CHINESE_CITATIONS
    flat = [(kind, p) for kind, ps in patterns.items() for p in ps]

    def found(rank: int, kind: str, pattern: str) -> Column:
        return F.transform(matches(F.col("text"), pattern), lambda m: F.struct(F.lit(rank).alias("rank"), m["position"].alias("position"), F.lit(kind).alias("kind"), m["citation"].alias("citation")))

    lists = [found(i, k, p) for i, (k, p) in enumerate(flat)]
    rows = docs.where("text is not null").select("doc_id", "text", F.explode(F.flatten(F.array(*lists))).alias("c")).select("doc_id", "text", "c.*")
    first = F.row_number().over(Window.partitionBy("doc_id", "kind", "citation").orderBy("rank", "position"))
    start, end = F.greatest(F.lit(0), F.col("position") - around), F.col("position") + F.length("citation") + around
    rows = rows.withColumn("context", F.substring("text", start + 1, end - start)).drop("text")
    rows = rows.withColumn("_n", first).where("_n = 1")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "rank"))
    return rows.withColumn("order", order).select("doc_id", "order", "position", "kind", "citation", "context")


def exists_in(kind: Column, citation: Column, knowledge: Column, sources: Column | None = None) -> Column:
    """Whether a knowledge text or the name of a source holds a citation: a law also without its marks, a standard whatever its blanks and hyphens."""
    squeeze = lambda c: F.regexp_replace(c, "[ -]", "")
    name = F.regexp_replace(citation, "[《》]", "")
    inside = lambda x: F.contains(knowledge, x) | (F.exists(sources, lambda s: F.contains(s, x)) if sources is not None else F.lit(False))
    return inside(citation) | ((kind == "law") & inside(name)) | ((kind == "standard") & F.contains(squeeze(knowledge), squeeze(citation)))


def accuracy(exists: Column, citation: Column, context: Column, knowledge: Column) -> Column:
    """0 to 100: words that the context shares with the knowledge around the citation, by the smaller of both; 50 where it stands nowhere as it is."""
    at = F.instr(knowledge, citation)
    start = F.greatest(F.lit(0), at - 1 - 50)
    snippet = F.substring(knowledge, start + 1, at - 1 + 100 - start)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))
    a, b = words(context), words(snippet)
    share = F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)) * 100.0
    return F.when(~exists, 0.0).when(at == 0, UNKNOWN).otherwise(F.coalesce(share, F.lit(UNKNOWN)))


def support_type(context: Column, supportive: str = SUPPORTIVE, decorative: str = DECORATIVE) -> Column:
    """supportive or decorative; supportive where neither pattern occurs."""
    return F.when(context.rlike(supportive), "supportive").when(context.rlike(decorative), "decorative").otherwise("supportive")


def evaluate(docs: DataFrame, cited: DataFrame) -> DataFrame:
    """Counts and rates of the citations (doc_id, exists_in_kb, accuracy, support_type) of every text; 0 for those without any."""
    g = cited.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("exists_in_kb").alias("existing"), F.count_if(F.col("accuracy") >= ACCURATE).alias("accurate"),
        F.count_if(F.col("support_type") == "supportive").alias("supportive"), F.count_if(F.col("support_type") == "decorative").alias("decorative"),
    )
    names = ["total", "existing", "accurate", "supportive", "decorative"]
    out = docs.select("doc_id").join(g, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    rate = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6)
    return out.select("*", rate("existing").alias("existence_rate"), rate("accurate").alias("accuracy_rate"), rate("supportive").alias("supportive_rate"))
