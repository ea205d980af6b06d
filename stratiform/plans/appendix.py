"""Sources, appendices, prompts and composite rows: orders are reports, their priorities and keys make their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import appendix as A, quality as Q
from stratiform.plans.base import query, table
from stratiform.plans.events import _N, numbered
from stratiform.plans.quality import DEPTH

_KS = """CASE o_orderkey % 4 WHEN 0 THEN '[{"title": "T' || o_custkey % 7 || '", "doc_type": "policy"}, {"source": "f' || o_orderkey % 5 || '.md"}, 5, {"title": "T' || o_custkey % 7 || '", "doc_type": "case"}]'
 WHEN 1 THEN '{"retrieved_chunks": [{"source": "0 n' || o_orderkey % 9 || '_minerU_parsed.md", "doc_type": "x"}, {"source": "f1.md", "doc_type": "guide"}]}' WHEN 2 THEN '{"other": 1}' END"""
_NAMES = [("d1", "区位"), ("d2", "土地"), ("d3", "交通")]
_NV = "nm(key, name) AS (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in _NAMES) + ")"
_RP = "rp AS (SELECT o_custkey AS session_id, (o_orderkey % 4)::INTEGER AS layer, o_orderkey AS pos, 'd' || o_orderkey % 6 AS dim, o_orderkey % 4 AS form, o_orderkey, o_custkey FROM orders)"
_SRC = f"""{_RP}, kn(source, t, d) AS (VALUES ('f0.md', 'File 0', 'standard'), ('f1.md', '', 'planning'), ('f2.md', 'File 2', '')),
 ch AS (SELECT *, 0 AS place, 'T' || o_custkey % 7 AS title, 'policy' AS doc_type, '' AS source FROM rp WHERE form = 0 UNION ALL SELECT *, 1, '', '', 'f' || o_orderkey % 5 || '.md' FROM rp WHERE form = 0 UNION ALL SELECT *, 0, '', 'x', '0 n' || o_orderkey % 9 || '_minerU_parsed.md' FROM rp WHERE form = 1
 UNION ALL SELECT *, 1, '', 'guide', 'f1.md' FROM rp WHERE form = 1), jn AS (SELECT ch.*, coalesce(nullif(title, ''), nullif(t, ''), regexp_replace(regexp_replace(source, '_minerU_parsed.*$', ''), '\\.md$', '')) AS name, coalesce(d, '') AS kd FROM ch LEFT JOIN kn USING (source))""".replace("\\\\", "\\")


def reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dim = F.concat(F.lit("d"), (F.col("o_orderkey") % 6).cast("string"))
    return o.select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 4).cast("int").alias("layer"), F.col("o_orderkey").alias("pos"), dim.alias("dimension_key"), F.expr(_KS).alias("knowledge_sources"))


def known(spark):
    return spark.createDataFrame([("f0.md", "File 0", "standard"), ("f1.md", "", "planning"), ("f2.md", "File 2", "")], "source string, title string, doc_type string")


def names(spark):
    return spark.createDataFrame(_NAMES, "key string, name string")


@query("knowledge_rows", f"WITH {_NV}, {_SRC} SELECT session_id, layer, pos, dim AS dimension_key, coalesce(nm.name, dim) AS dimension_name, string_agg(jn.name || ':' || CASE WHEN doc_type = '' AND source <> '' THEN kd ELSE doc_type END, ',' ORDER BY place) AS sources FROM jn LEFT JOIN nm ON nm.key = dim GROUP BY 1, 2, 3, 4, 5")
def knowledge_rows(spark, sf_dir):
    out = A.source_rows(reports(spark, sf_dir), known(spark), names(spark), ["session_id", "layer", "pos", "dimension_key"])
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["doc_type"])), ","))


@query("knowledge_appendix", f"""WITH {_NV}, {_SRC}, ty AS (SELECT *, CASE WHEN title = '' AND source <> '' THEN kd ELSE doc_type END AS ft FROM jn WHERE layer BETWEEN 1 AND 3), lb AS (SELECT *, CASE ft WHEN 'policy' THEN '法规' WHEN 'standard' THEN '标准' WHEN 'planning' THEN '上位规划' WHEN 'guide' THEN '指南' ELSE ft END AS label FROM ty),
 bl AS (SELECT session_id, layer, pos, '### 【Layer' || layer || ' - ' || coalesce(nm.name, dim) || '】' || chr(10) || string_agg('- [' || label || '] ' || lb.name, chr(10) ORDER BY place) || chr(10) AS t FROM lb LEFT JOIN nm ON nm.key = dim GROUP BY session_id, layer, pos, dim, nm.name)
 SELECT session_id, md5(chr(10) || '## 附录：知识来源与参考依据' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY layer, pos)) AS text_md5 FROM bl GROUP BY 1""")
def knowledge_appendix(spark, sf_dir):
    out = A.appendix(reports(spark, sf_dir), known(spark), names(spark), "session_id")
    return out.select("session_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("dependency_prompts", f"WITH {_NV}, rq AS (SELECT l_orderkey AS target, 'd' || l_partkey AS key, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), rr AS (SELECT 'd' || p_partkey AS key, p_name AS content FROM part WHERE p_partkey % 3 > 0), j AS (SELECT target, string_agg('### ' || coalesce(nm.name, rr.key) || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY pos, rr.key) AS text FROM rq JOIN rr USING (key) LEFT JOIN nm ON nm.key = rr.key GROUP BY 1) SELECT DISTINCT rq.target, md5(coalesce(text, '')) AS text_md5 FROM rq LEFT JOIN j USING (target)")
def dependency_prompts(spark, sf_dir):
    key = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    required = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("target"), key("l_partkey").alias("key")).agg(F.min("l_linenumber").alias("n"))
    required = required.select("target", "key", F.struct("n", "key").alias("pos"))
    r = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(key("p_partkey").alias("key"), F.col("p_name").alias("content"))
    return A.dependency_text(required, r, names(spark), "target").select("target", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("summary_prompts", """WITH s AS (SELECT o_custkey AS session_id, o_orderkey AS pos, 'k' || o_orderkey AS k, [x::VARCHAR FOR x IN range(o_orderkey % 8)] AS pts, o_orderkey % 3 AS m, CASE WHEN o_orderkey % 2 = 0 THEN repeat(o_orderpriority, 30) ELSE '' END AS t FROM orders),
 l AS (SELECT session_id, pos, '【' || k || '】' || CASE WHEN len(pts) > 0 THEN chr(10) || '关键要点：' || array_to_string(pts[1:5], '；') ELSE '' END || CASE WHEN m > 0 THEN chr(10) || '核心指标：a=' || m || ', b=' || pos ELSE '' END || CASE WHEN t <> '' THEN chr(10) || '摘要：' || left(t, 200) ELSE '' END AS t FROM s)
 SELECT session_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY pos)) AS text_md5 FROM l GROUP BY 1""")
def summary_prompts(spark, sf_dir):
    k = F.col("o_orderkey")
    pts = F.when(k % 8 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k % 8 - 1, F.lit(0))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    metrics = F.when(k % 3 > 0, F.create_map(F.lit("a"), k % 3, F.lit("b"), k))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), k.alias("pos"), F.concat(F.lit("k"), k.cast("string")).alias("dimension_key"), pts.alias("key_points"), metrics.alias("metrics"), F.when(k % 2 == 0, F.repeat("o_orderpriority", F.lit(30))).otherwise("").alias("text_summary"))
    return A.summary_prompt(s, "session_id").select("session_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("filled_articles", "SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 AND c_custkey IS NOT NULL THEN c_name ELSE o_orderpriority END AS content, coalesce(c_mktsegment NOT IN ('BUILDING'), true) AS legal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_orderkey")
def filled_articles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderkey") % 3 == 0, A.GENERATED).otherwise("S-COPY").alias("strategy"), F.col("o_orderpriority").alias("content"))
    out = A.filled(articles, c.select(F.col("c_custkey").alias("number"), F.col("c_name").alias("content")))
    kind = c.select(F.col("c_custkey").alias("number"), F.when(F.col("c_mktsegment") == "BUILDING", "case").otherwise("policy").alias("doc_type"))
    return out.join(kind, "number", "left").select("number", "content", A.is_legal(F.col("doc_type")).alias("legal"))


@query("keyword_alignments", "WITH w(pos, d, words) AS (VALUES (2, 'en', ['zzz']), (1, 'en', ['the', 'of', 'qq']), (1, 'fr', ['de', 'que'])) SELECT doc_id, round(CASE WHEN w.d IS NULL THEN 0.5::DOUBLE ELSE len(list_filter(words, lambda x: contains(coalesce(text, ''), x)))::DOUBLE / len(words) END, 6) AS keyword_score FROM documents LEFT JOIN (SELECT d, arg_min(words, pos) AS words FROM w GROUP BY 1) w ON w.d = lang")
def keyword_alignments(spark, sf_dir):
    words = spark.createDataFrame([(2, "en", ["zzz"]), (1, "en", ["the", "of", "qq"]), (1, "fr", ["de", "que"])], "pos int, downstream_dim string, words array<string>")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("downstream_dim"), F.lit("target").alias("target"), F.coalesce("text", F.lit("")).alias("downstream"))
    return A.keyword_alignment(d, words).select("doc_id", F.round("keyword_score", 6).alias("keyword_score"))


@query("synchronised_events", f"WITH {_N}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM n) SELECT user_id, max(seq) AS last_seq, coalesce(string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (seq > user_id % 60), '') AS seqs FROM t WHERE r <= 50 GROUP BY user_id")
def synchronised_events(spark, sf_dir):
    n = numbered(spark, sf_dir)
    requests = n.select("user_id", (F.col("user_id") % 60).alias("from_seq")).distinct()
    return A.synchronised(n, requests, "user_id").select("user_id", "last_seq", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ",").alias("seqs"))


@query("text_quality_rows", """WITH q AS (SELECT doc_id, coalesce(length(text), 0) AS text_length, CASE WHEN doc_id % 3 = 0 THEN 'a b' ELSE left(text, 500) END AS ctx FROM documents) SELECT doc_id, text_length, 1.0::DOUBLE AS faithfulness, 0 AS n_claims, md5(ctx) AS context_md5 FROM q""")
def text_quality_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, n_claims long, faithfulness double")
    rows = A.quality_rows(d, none, "doc_id", DEPTH)
    context = d.select("doc_id", F.md5(A.knowledge_context(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))), F.col("text")).cast("binary")).alias("context_md5"))
    return rows.join(context, "doc_id").select("doc_id", "text_length", "faithfulness", F.col("n_claims").cast("int").alias("n_claims"), "context_md5")


@query("feature_counts", "SELECT p_brand AS layer, p_type AS category, false AS all_categories, count(*) AS n FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, NULL, true, count(*) FROM part GROUP BY 1")
def feature_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("layer"), F.col("p_type").alias("category"))
    return A.feature_counts(p, "layer", "category")


@query("overall_consistency", "SELECT l_suppkey AS run, round(avg(l_discount), 8) AS overall, count(*) AS dims FROM lineitem GROUP BY 1")
def overall_consistency(spark, sf_dir):
    out = A.mean_consistency(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_discount").alias("score")), ["run"])
    return out.withColumn("overall", F.round("overall", 8))


@query("revision_waves", "SELECT DISTINCT o_orderkey AS session_id, l_linenumber AS wave, 'd' || l_partkey AS dimension_key FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' OR l_linenumber = 1")
def revision_waves(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("wave"), F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("dimension_key")).distinct()
    done = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), "o_orderstatus"), "session_id").where("o_orderstatus = 'F' or wave = 1")
    # a dimension may stand in several waves: only those of the rows that are done count here
    return A.revision_waves(li.join(done.select("session_id", "wave", "dimension_key"), ["session_id", "wave", "dimension_key"]), done)
