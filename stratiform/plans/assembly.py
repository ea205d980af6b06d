"""Assembly queries: documents play articles, their source the plan, their language the chapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import assemble as A
from stratiform.plans.base import query, table


@query("first_seen_sources", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def first_seen_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return A.first_seen(d, ["lang", "source"], ["doc_id"])


@query("enriched_titles", "SELECT o_orderkey AS ref_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'own ' || o_orderkey END, CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'plan') AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def enriched_titles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("source_id"))
    o = o.withColumn("title", F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("own "), F.col("ref_id").cast("string"))))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("title"))
    name = A.clean_file_name(F.lit("007_plan_minerU_parsed.md"))
    return A.enrich(o, known, "source_id", {"title": name}).select("ref_id", "title")


@query("layer_report_text", "SELECT source, doc_id // 20 AS layer, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS content_md5 FROM documents GROUP BY 1, 2")
def layer_report_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 20).cast("long").alias("layer"), "doc_id", "text")
    return A.joined_text(d, ["source", "layer"], "doc_id", "text").select("source", "layer", "n", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("title_sets", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS titles FROM nation GROUP BY 1")
def title_sets(spark, sf_dir):
    return A.title_sets(table(spark, sf_dir, "nation"), "n_regionkey", "n_name").select("n_regionkey", F.array_join("titles", ",").alias("titles"))


_RUN = "d AS (SELECT source || '-' || (doc_id // 50) AS plan, lang, doc_id FROM documents), r AS (SELECT plan, lang, doc_id, sum(new) OVER (PARTITION BY plan ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT plan, lang, doc_id, CASE WHEN lag(lang) OVER (PARTITION BY plan ORDER BY doc_id) IS NOT DISTINCT FROM lang THEN 0 ELSE 1 END AS new FROM d))"


def articles(spark, sf_dir):
    """A plan is the articles of one source in a range of ids, as many as a plan has."""
    plan = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string"))
    return table(spark, sf_dir, "documents").select(plan.alias("plan"), "doc_id", "lang", "n_chars")


@query("chapter_nesting", f"WITH {_RUN} SELECT plan, max(run)::INTEGER AS n_chapters, count(*)::INTEGER AS n_articles, arg_min(lang, doc_id) AS first_chapter FROM r GROUP BY 1")
def chapter_nesting(spark, sf_dir):
    nested = A.chapters(articles(spark, sf_dir), "plan", "doc_id", "lang", ["n_chars"])
    total = F.aggregate("chapters", F.lit(0), lambda s, c: s + F.size(c["articles"]))
    return nested.select("plan", F.size("chapters").alias("n_chapters"), total.alias("n_articles"), F.col("chapters")[0]["chapter"].alias("first_chapter"))


@query("plan_json")
def plan_json(spark, sf_dir):
    return A.plan_json(A.chapters(articles(spark, sf_dir), "plan", "doc_id", "lang", ["n_chars"]), "plan")


@query("region_outline", "SELECT r_name, count(n_nationkey) AS n, string_agg(n_name, '; ' ORDER BY n_nationkey) AS articles FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def region_outline(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.joined_text(n, ["r_name"], "n_nationkey", "n_name", "; ", "articles")
