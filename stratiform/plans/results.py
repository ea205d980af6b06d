"""Tool results, JSON of rows, probed boundaries, zone coverage and report figures over texts and places made from the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratiform.operators import extraction as E, results as R, shapes as S, spatial as P
from stratiform.operators.text import lines
from stratiform.plans.base import query, table
from stratiform.plans.shapes import _IN, _Q, _XY, places, zones
from stratiform.plans.spatial import _F, facilities

#: Results of six forms, by event.
_RESULT = """CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'plain ' || event_type WHEN 2 THEN '{"success": false, "error": "' || event_type || '"}' WHEN 3 THEN '{"success": true, "summary": ' || event_id || ', "center": [' || event_id || ', 2.5]}'
 WHEN 4 THEN '{"success": true, "data": {"water": {"success": true, "geojson": {"features": [{"properties": {"n": ' || event_id || '}}]}}, "road": {"success": ' || CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END || ', "geojson": {"features": [{}, {}]}}}}' ELSE '{"success": true, "data": "' || event_type || '"}' END"""


@query("tool_results", """SELECT event_id, event_id % 6 NOT IN (0, 2) AS success, CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'text' WHEN 2 THEN 'error' WHEN 3 THEN 'analysis' WHEN 4 THEN 'geojson' ELSE 'text' END AS data_type, CASE event_id % 6 WHEN 0 THEN '工具返回空结果' WHEN 2 THEN event_type END AS error,
 CASE event_id % 6 WHEN 1 THEN 'plain ' || event_type WHEN 5 THEN event_type END AS text_data, CASE WHEN event_id % 6 = 3 THEN event_id::DOUBLE END AS center_x, CASE WHEN event_id % 6 = 3 THEN '{"summary":' || event_id || '}' END AS analysis_data,
 CASE WHEN event_id % 6 = 4 THEN CASE WHEN event_id % 4 = 0 THEN '水系:1,道路:2' ELSE '水系:1' END ELSE '' END AS layers, CASE WHEN event_id % 6 = 4 THEN '中敏感区' END AS level FROM events""")
def tool_results(spark, sf_dir):
    out = R.normalised(table(spark, sf_dir, "events").select("event_id", F.expr(_RESULT).alias("result")))
    named = F.array_join(F.transform("layers", lambda x: F.concat(x["layerName"], F.lit(":"), x["features"].cast("string"))), ",")
    level = F.get_json_object(F.try_element_at("layers", F.lit(1))["geojson"], "$.features[0].properties.sensitivity_level")
    return out.select("event_id", "success", "data_type", "error", "text_data", F.col("center")[0].alias("center_x"), "analysis_data", named.alias("layers"), level.alias("level"))


@query("rows_as_json", """SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '","event_type":"' || event_type || '","missing":null}' AS json FROM events""")
def rows_as_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.lit(None).cast("string").alias("missing"))
    return R.as_json(e, "event_id")


_TURN = f"(k * {2 * math.pi / 12!r}::DOUBLE)"


@query("sampled_boundary", f"""WITH {_F}, k AS (SELECT facility_id, lon_2, lat_2, unnest(range(12)) AS k FROM f), r AS (SELECT *, CASE WHEN (facility_id + k) % 3 = 0 THEN NULL ELSE ((facility_id * 7 + k * 53) % 20 + 1) * 60 END AS s FROM k),
 d AS (SELECT *, 10 / 60.0::DOUBLE * 5.0 * 1000 * CASE WHEN s IS NULL THEN 1 WHEN s <= 600 THEN 1.2 ELSE 1.2 * 600 / s::DOUBLE END AS far FROM r) SELECT facility_id, k::INTEGER AS bearing, round(lon_2 + far * cos{_TURN} / 111320.0, 8) AS lon, round(lat_2 + far * sin{_TURN} / 110540.0, 8) AS lat FROM d""")
def sampled_boundary(spark, sf_dir):
    f = facilities(spark, sf_dir).select(F.col("facility_id").alias("centre_id"), F.col("lon_2").alias("lon"), F.col("lat_2").alias("lat"))
    k, c = F.col("bearing"), F.col("centre_id")
    routes = f.select("centre_id").withColumn("bearing", F.explode(F.sequence(F.lit(0), F.lit(11)))).where((c + k) % 3 != 0).withColumn("duration_s", ((c * 7 + k * 53) % 20 + 1) * 60.0)
    out = P.sampled_boundaries(f, routes, 10, "walk", 12).select(c.alias("facility_id"), F.posexplode(F.slice("ring", 1, 12)).alias("bearing", "p"))
    return out.select("facility_id", "bearing", F.round(F.col("p")[0], 8).alias("lon"), F.round(F.col("p")[1], 8).alias("lat"))


@query("zone_coverage", f"""{_XY}, {_Q}, h AS (SELECT facility_id, point_id, row_number() OVER (PARTITION BY facility_id ORDER BY point_id) AS n FROM q, b WHERE {_IN})
 SELECT b.facility_id, count(h.point_id) AS total_in_zone, round(count(h.point_id) / (SELECT count(*) FROM p)::DOUBLE, 8) AS coverage_rate, coalesce(string_agg(h.point_id::VARCHAR, ',' ORDER BY h.point_id) FILTER (n <= 20), '') AS shown FROM b LEFT JOIN h USING (facility_id) GROUP BY 1""")
def zone_coverage(spark, sf_dir):
    z, p = zones(spark, sf_dir), places(spark, sf_dir)
    hits = S.contained_shapes(p.withColumnRenamed("point_id", "point"), z, "facility_id")
    out = P.shape_coverage(z, p, hits, "facility_id", "point_id")
    return out.select("facility_id", "total_in_zone", F.round("coverage_rate", 8).alias("coverage_rate"), F.array_join(F.transform("shown", lambda x: x.cast("string")), ",").alias("shown"))


_REPORT = "CASE o_orderkey % 5 WHEN 0 THEN '户籍人口 ' || o_orderkey || ' 人' WHEN 1 THEN '土地总面积约' || o_orderkey || '.5公顷，林地面积 ' || (o_orderkey % 100) || '%' WHEN 2 THEN '土地总用地面积' || o_custkey || '公顷' WHEN 3 THEN '有 ' || o_orderkey || ' 户，水域面积 3.1.4 公顷' END"


@query("plan_figures", f"""WITH r AS (SELECT o_custkey AS plan, o_orderkey AS pos, o_orderkey % 5 = 2 AS land, coalesce({_REPORT}, '') AS t FROM orders), g AS (SELECT plan, string_agg(t, chr(10) ORDER BY pos) AS t, max(CASE WHEN land THEN plan END)::DOUBLE AS area FROM r GROUP BY 1)
 SELECT plan, coalesce(CASE WHEN area > 0 THEN area END, nullif(regexp_extract(t, '土地总[用]?面积[约]*\\s*([\\d.]+)\\s*公顷', 1), '')::DOUBLE) AS total_area_ha, nullif(regexp_extract(t, '户籍人口\\s*(\\d+)\\s*人', 1), '')::DOUBLE AS population_registered, nullif(regexp_extract(t, '(\\d+)\\s*户', 1), '')::DOUBLE AS population_household,
 nullif(regexp_extract(t, '林地[面积]*[在占比达]?\\s*(\\d+)\\s*%', 1), '')::DOUBLE AS forest_coverage_pct, NULL::DOUBLE AS water_ha FROM g""".replace("\\\\", "\\"))
def plan_figures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("plan"), F.when(F.col("o_orderkey") % 5 == 2, "land_use").otherwise("other").alias("dimension_key"), F.col("o_orderkey").alias("pos"), F.expr(_REPORT).alias("content"))
    return E.figures(r, "plan").select("plan", "total_area_ha", "population_registered", "population_household", "forest_coverage_pct", "water_ha")


@query("orphan_punctuation", r"""WITH l AS (SELECT doc_id, pos, CASE WHEN pos % 5 IN (0, 3) THEN '。' WHEN pos % 11 = 7 THEN ' --- ' WHEN pos % 11 = 9 THEN '> q' ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
 t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l), k AS (SELECT * FROM t WHERE s <> '---' AND s NOT LIKE '>%'), o AS (SELECT *, regexp_full_match(s, '[：:，,。；;、！!？?）)】]+') AND lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS orphan FROM k), r AS (SELECT *, max(CASE WHEN NOT orphan THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM o),
 m AS (SELECT doc_id, run, string_agg(s, '' ORDER BY pos) AS marks FROM r WHERE orphan GROUP BY 1, 2)
 SELECT r.doc_id, r.pos::INTEGER AS pos, md5(CASE WHEN marks IS NOT NULL THEN regexp_replace(line, '\s+$', '') || marks ELSE line END) AS line_md5 FROM r LEFT JOIN m ON m.doc_id = r.doc_id AND m.run = r.run WHERE NOT orphan""")
def orphan_punctuation(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents")).withColumn("line", F.when((F.col("pos") % 5).isin(0, 3), "。").when(F.col("pos") % 11 == 7, " --- ").when(F.col("pos") % 11 == 9, "> q").otherwise(F.col("line")))
    return E.without_orphans(rows, ["doc_id"]).select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("line_md5"))
