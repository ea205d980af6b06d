"""Reports as dimensions, figures, contexts, events and the registry of sessions, over the tables' texts and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import articles as A
from stratiform.plans.base import SHARES, query, table


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) || chr(65279)"
_CUT = f"trim(CASE WHEN regexp_matches({{0}}, '[\\n\\r][\\n\\r]') THEN regexp_extract({{0}}, '^([\\s\\S]*?[\\n\\r])[\\n\\r]', 1) ELSE {{0}} END, {_BLANK})"


@query("layer_dimensions", f"""WITH t AS (SELECT doc_id, doc_id % 4 AS form, trim(coalesce(text, ''), {_BLANK}) AS body FROM documents), c AS (SELECT *, {_CUT.format("body")} AS cut, regexp_matches(body, '[\\n\\r][\\n\\r]') AS gap FROM t),
 m AS (SELECT *, CASE WHEN contains(cut, '### ') THEN coalesce(nullif(trim(split_part(cut, '### ', 1), {_BLANK}), ''), cut) ELSE cut END AS main, (body <> '' AND (form = 1 OR form = 3 AND gap)) AS one, len(regexp_extract_all(chr(10) || cut || chr(10), '\\n###[ \\t]+[^\\n]'))::INTEGER AS k FROM c)
 SELECT doc_id, CASE WHEN form = 2 THEN 2 WHEN body = '' THEN 0 ELSE 1 END AS n, CASE WHEN form = 2 OR one THEN 'D' || doc_id WHEN body <> '' THEN '规划内容' END AS name, CASE WHEN form = 2 OR body <> '' THEN CASE WHEN form = 2 THEN 1 + k - CASE WHEN gap AND regexp_matches(cut, '###[ \\t]+[^\\n]*$') THEN 1 ELSE 0 END ELSE 0 END END AS n_subsections,
 CASE WHEN form = 2 THEN md5('lead') WHEN one THEN md5(main) WHEN form = 3 AND body <> '' THEN md5('## D' || doc_id || chr(10) || body) WHEN body <> '' THEN md5(body) END AS content_md5 FROM m""")
def layer_dimensions(spark, sf_dir):
    """A report without headings, one with a section, one with two (subsections in the first), one whose last line is open."""
    # taking texts apart costs more than moving them, so they are dealt over many tasks however few files hold them
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(SHARES, "doc_id").withColumn("body", F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r\u00a0\u3000\ufeff")))
    name = F.concat(F.lit("## D"), F.col("doc_id").cast("string"), F.lit("\n"))
    two = F.concat(name, F.lit("lead\n### S\n"), F.col("body"), F.lit("\n### T\nx\n## E\nend\n"))
    form, given = F.col("doc_id") % 4, F.col("body") != ""
    text = F.when(form == 2, two).when(given & (form == 1), F.concat(name, F.col("body"), F.lit("\n"))).when(given & (form == 3), F.concat(name, F.col("body"))).otherwise(F.col("body"))
    first = F.get("d", F.lit(0))
    out = d.select("doc_id", A.dimensions_of(text).alias("d"))
    return out.select("doc_id", F.size("d").alias("n"), first["name"].alias("name"), F.when(first.isNotNull(), F.when(form == 2, F.size(first["subsections"])).otherwise(0)).alias("n_subsections"), F.md5(first["content"].cast("binary")).alias("content_md5"))


@query("parser_marks", """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'parser_' || doc_id END AS parser, CASE WHEN doc_id % 3 = 1 THEN doc_id || '.5' END AS parse_time FROM documents""")
def parser_marks(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    mark = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("\n<!-- 解析器: parser_"), i, F.lit(" -->"))).otherwise(F.lit(""))
    time = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<!--解析耗时: "), i, F.lit(".5s-->"))).otherwise(F.lit("<!--解析耗时: xs-->"))
    return table(spark, sf_dir, "documents").select("doc_id", A.parser_of(F.concat(F.coalesce("text", F.lit("")), mark, time)).alias("p")).select("doc_id", "p.parser", "p.parse_time")


@query("filled_figures", """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'cfg' WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'sum' END AS county, CASE WHEN o_custkey % 2 > 0 THEN o_custkey % 2 WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 ELSE 0 END::INTEGER AS population_resident,
 CASE o_orderkey % 3 WHEN 0 THEN 4.5 WHEN 1 THEN 6.5 ELSE 7.5 END::DOUBLE AS forest_coverage_pct FROM orders""")
def filled_figures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    summaries = F.expr("""'{"location": {"county": "sum"}, "socio_economic": {"resident_population": "' || o_orderkey % 5 || '"}, "land_use": {"forest_coverage_rate": ' || CASE WHEN o_orderkey % 3 = 1 THEN '6.5' ELSE '0' END || '}, "natural_environment": {"forest_coverage_rate": "7.5"}}'""")
    config = F.expr("""CASE WHEN o_orderkey % 2 = 0 THEN '{"county": "cfg"}' ELSE '{"county": ""}' END""")
    own = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE '' END")
    rows = o.select(F.col("o_orderkey").alias("order_id"), own.alias("county"), (F.col("o_custkey") % 2).cast("int").alias("population_resident"), F.when(F.col("o_orderkey") % 3 == 0, 4.5).otherwise(0.0).alias("forest_coverage_pct"), summaries.alias("s"), config.alias("c"))
    return A.filled_figures(rows, "s", "c").drop("s", "c")


@query("article_contexts", """SELECT o_orderkey AS order_id, md5(CASE o_orderkey % 8 WHEN 1 THEN '村庄名称：' || o_orderpriority || chr(10) || '所在位置：' || CASE WHEN o_custkey % 2 = 0 THEN '省县' ELSE '所在地区' END || chr(10) || '规划期限：2025' || CASE WHEN o_custkey % 7 > 0 THEN chr(10) || '编制依据：' || array_to_string(['L' || x FOR x IN range(least(o_custkey % 7, 5))], '；') ELSE '' END || chr(10) || '规划定位：' || repeat('a', 200)
 WHEN 7 THEN '规划定位：' || chr(10) || repeat('a', 600) || chr(10) || '规划策略：s' ELSE '项目名称：' || o_orderpriority || '规划（2025）' || chr(10) || '项目概况：村庄位于' || CASE WHEN o_custkey % 2 = 0 THEN '省县' ELSE '所在省/市/县/镇' END || '，下辖' || o_custkey % 5 || '个自然村' || CASE WHEN o_custkey % 3 > 0 THEN chr(10) || '常住人口：' || o_custkey % 3 || '人，户籍人口：9人' ELSE '' END
 || chr(10) || '村域总面积：' || o_custkey % 4 + 1 || '.50公顷' || chr(10) || '规划定位：' || repeat('a', 300) || chr(10) || '耕地保有量：0.00公顷' || chr(10) || '森林覆盖率：3%' || chr(10) || '自然村数量：' || o_custkey % 5 || '个' END) AS text_md5 FROM orders""")
def article_contexts(spark, sf_dir):
    c = F.col("o_custkey")
    place = lambda text: F.when(c % 2 == 0, F.lit(text)).otherwise(F.lit(""))
    laws = F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), F.lit(1), (c % 7).cast("int")), lambda i: F.concat(F.lit("L"), i.cast("string")))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    f = F.struct(
        F.col("o_orderpriority").alias("village"), F.lit("2025").alias("period"), place("省").alias("province"), none.alias("city"), place("县").alias("county"), F.lit("").alias("town"), laws.alias("national"), empty.alias("provincial"), empty.alias("planning"),
        F.repeat(F.lit("a"), 600).alias("positioning"), none.alias("goal"), F.lit("").alias("endowment"), F.lit("s").alias("strategies"), (c % 3).alias("resident"), F.lit(9).alias("registered"), (c % 4 + 1.5).alias("area"), F.lit(None).cast("double").alias("farmland"), F.lit(3).alias("forest"), (c % 5).alias("villages"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.md5(A.article_context(F.col("o_orderkey") % 8, f).cast("binary")).alias("text_md5"))


@query("reference_contexts", """WITH h AS (SELECT l_orderkey AS q, l_extendedprice AS score, 'f' || l_suppkey AS source, CASE l_partkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'case' ELSE 'guide' END AS doc_type, 'c' || l_partkey AS content FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, source, content) AS n FROM h WHERE doc_type IN ('policy', 'guide')) SELECT q AS order_id, string_agg('【参考' || n || ' - ' || doc_type || '】' || chr(10) || '来源: ' || source || chr(10) || '内容:' || chr(10) || content || chr(10), chr(10) ORDER BY n) AS text FROM n WHERE n <= 3 GROUP BY 1""")
def reference_contexts(spark, sf_dir):
    kind = F.expr("CASE l_partkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'case' ELSE 'guide' END")
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("score"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("source"), kind.alias("doc_type"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("content"))
    return A.reference_context(hits, "order_id", "score", ["policy", "guide"])


@query("detailed_contexts", """WITH n AS (SELECT o_custkey AS customer_id, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, 'f' || o_orderkey) AS n FROM orders)
 SELECT customer_id, string_agg('来源: f' || o_orderkey || chr(10) || '位置: ' || CASE o_orderkey % 3 WHEN 0 THEN '4' WHEN 1 THEN o_orderstatus ELSE '未知' END || chr(10) || '内容: ' || o_orderpriority, chr(10) || chr(10) ORDER BY n) AS text FROM n WHERE n <= 5 GROUP BY 1""")
def detailed_contexts(spark, sf_dir):
    k = F.col("o_orderkey")
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("score"), F.concat(F.lit("f"), k.cast("string")).alias("source"), F.when(k % 3 == 0, 4).alias("page"), F.when(k % 3 == 1, F.col("o_orderstatus")).alias("paragraph"), F.col("o_orderpriority").alias("content"))
    return A.detailed_context(hits, "customer_id", "score")


_POINT = "list_filter(list_transform(regexp_extract_all(t, '{}', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288))), lambda x: length(x) BETWEEN 4 AND 50)"


@query("key_points", f"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '### head ' || doc_id % 5 ELSE '**head 1** **abc**' END || chr(10) || '**head ' || doc_id % 3 || '** and **bold** or **bold**' AS t FROM documents),
 p AS (SELECT doc_id, {_POINT.format('###[\\s\\x{00A0}\\x{3000}]+([^\\n]+)')} AS h, {_POINT.format('\\*\\*([^\\n]+?)\\*\\*')} AS b FROM t)
 SELECT doc_id, array_to_string(list_concat(h, list_filter(b, lambda x, i: list_position(b, x) = i AND NOT list_contains(h, x)))[1:5], '|') AS points FROM p""")
def key_points(spark, sf_dir):
    tail = F.expr("CASE WHEN doc_id % 2 = 0 THEN '### head ' || doc_id % 5 ELSE '**head 1** **abc**' END || '\\n' || '**head ' || doc_id % 3 || '** and **bold** or **bold**'")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.key_points(text), "|").alias("points"))


@query("regulation_contexts", """WITH r AS (SELECT p_brand AS brand, 'B ' || p_brand AS name, p_partkey AS pos, p_name AS source, p_type AS content FROM part WHERE p_size % 2 = 0 AND p_brand NOT LIKE '%1'), n AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY pos, source, content) AS n FROM r),
 g AS (SELECT brand, min(name) AS name, count(*) AS k, sum(length(content)) AS total, string_agg('【' || source || '】' || chr(10) || content, chr(10) || chr(10) ORDER BY n) AS text FROM n WHERE n <= 5 GROUP BY 1)
 SELECT b.brand, coalesce(g.name, b.brand) AS name, coalesce(k, 0)::BIGINT AS n_regulations, coalesce(total, 0)::BIGINT AS total_length, coalesce(text, '') AS text FROM (SELECT DISTINCT p_brand AS brand FROM part) b LEFT JOIN g USING (brand)""")
def regulation_contexts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("B "), F.col("p_brand")).alias("name"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("source"), F.col("p_type").alias("content"), "p_size")
    return A.regulation_context(p.select("brand"), p.where("p_size % 2 = 0 AND brand NOT LIKE '%1'").drop("p_size"), "brand")


@query("layer_events", """SELECT o_custkey AS session_id, o_orderkey % 3 AS layer, '{"type":"layer_completed","layer":' || o_orderkey % 3 || ',"phase":"p' || o_orderkey % 3 || '","report_count":' || count(*) || ',"total_chars":' || sum(length(o_orderpriority)) || ',"pause_after_step":' || (o_orderkey % 3 = 1) || ',"previous_layer":' || o_orderkey % 3 - 1 || ',"session_id":' || o_custkey || '}' AS event FROM orders GROUP BY 1, 2""")
def layer_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 3).alias("layer"), "o_orderpriority")
    return A.layer_completed(o, "session_id", "layer", "o_orderpriority", F.concat(F.lit("p"), F.col("layer").cast("string")), F.col("layer") == 1)


@query("session_views", """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN 'p' || o_custkey ELSE 'init' END AS phase, CASE o_orderkey % 4 WHEN 0 THEN 'N' || o_custkey WHEN 1 THEN left(repeat(o_orderpriority, 9), 50) ELSE '村庄规划' END AS project_name FROM orders""")
def session_views(spark, sf_dir):
    state = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN '{"phase": "p' || o_custkey || '", "project_name": "N' || o_custkey || '"}' WHEN 1 THEN '{"config": {"village_data": "' || repeat(o_orderpriority, 9) || '"}}' WHEN 2 THEN '{}' ELSE 'broken' END""")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), A.session_view(state).alias("v")).select("order_id", "v.*")


# Events are operations: signups start a session, errors of some minutes end it, the others set and append.
_LOG = """l AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'init' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'delete' WHEN event_type = 'view' THEN 'append' ELSE 'set' END AS op, event_type || event_id % 4 AS key, event_id AS value FROM events),
 e AS (SELECT *, count(*) FILTER (WHERE op IN ('init', 'delete')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM l), b AS (SELECT user_id, epoch, op FROM e WHERE op IN ('init', 'delete')),
 f AS (SELECT e.user_id, e.ts, e.event_id, e.op, e.key, e.value, e.epoch, coalesce(b.op = 'init', false) AS alive, max(e.epoch) OVER (PARTITION BY e.user_id) AS last FROM e LEFT JOIN b USING (user_id, epoch))"""


def _log(spark, sf_dir):
    op = F.expr("CASE WHEN event_type = 'signup' THEN 'init' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'delete' WHEN event_type = 'view' THEN 'append' ELSE 'set' END")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", op.alias("op"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("key"), F.col("event_id").alias("value"))


@query("registry_operations", f"WITH {_LOG}, p AS (SELECT user_id, epoch, lag(op) OVER (PARTITION BY user_id ORDER BY epoch) AS before FROM b) SELECT f.user_id, f.event_id, f.epoch::BIGINT AS epoch, CASE f.op WHEN 'init' THEN true WHEN 'delete' THEN coalesce(p.before = 'init', false) ELSE alive END AS ok FROM f LEFT JOIN p ON p.user_id = f.user_id AND p.epoch = f.epoch AND f.op = 'delete'")
def registry_operations(spark, sf_dir):
    return A.registry_results(_log(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "epoch", "ok")


@query("registry_values", f"WITH {_LOG} SELECT user_id, key, arg_max(value, (ts, event_id)) AS value FROM f WHERE alive AND epoch = last AND op = 'set' GROUP BY 1, 2")
def registry_values(spark, sf_dir):
    return A.registry_values(_log(spark, sf_dir), "user_id", ["ts", "event_id"])


@query("registry_history", f"WITH {_LOG}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM f WHERE alive AND epoch = last AND op = 'append') SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS place FROM h WHERE back <= 2")
def registry_history(spark, sf_dir):
    return A.registry_history(_log(spark, sf_dir), "user_id", ["ts", "event_id"], most=2).select("user_id", "event_id", "place")
