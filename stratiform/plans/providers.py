"""Provider answers built from the keys of the tables, read back as typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import providers as P
from stratiform.plans.base import query, table

_STEPS = """CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE '[{"polyline": "' || o_orderkey % 50 || '.5,' || o_custkey % 60 || '.25;x,1;7;8.5,9.5", "instruction": "go", "distance": "' || o_orderkey % 90 || '", "duration": "12"}, {"road": "R' || o_custkey % 9 || '", "distance": "x", "polyline": "3,4"}]' END"""
_XML = """CASE o_orderkey % 3 WHEN 0 THEN 'no xml' WHEN 1 THEN '<result><distance>' || o_orderkey % 40 || '.5</distance><routelatlon>1.5,2;3,4;</routelatlon></result>' ELSE '<result><duration>' || o_custkey || '</duration></result>' END"""


@query("provider_routes", """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 3 END AS n_coords, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 50 + 12.0 END::DOUBLE AS lon_sum, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '|R' || o_custkey % 9 END AS roads,
 CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 90 END::BIGINT AS metres, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN (o_orderkey % 40 + 0.5) * 1000 ELSE 0 END::DOUBLE AS xml_metres, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_custkey END::DOUBLE AS xml_seconds,
 CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 0 END::INTEGER AS xml_points FROM orders""")
def provider_routes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", P.route_steps(F.expr(_STEPS)).alias("r"), P.route_xml(F.expr(_XML)).alias("x"))
    total = lambda c, start: F.aggregate(c, start, lambda s, v: s + v)
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.size("r.coords").alias("n_coords"), total(F.transform("r.coords", lambda p: p[0]), F.lit(0.0)).alias("lon_sum"), F.array_join("r.steps.road", "|").alias("roads"),
        total(F.transform("r.steps.distance", lambda v: v.cast("long")), F.lit(0).cast("long")).alias("metres"), F.col("x.distance").alias("xml_metres"), F.col("x.duration").alias("xml_seconds"), F.size("x.coords").alias("xml_points"),
    )


@query("unified_pois", """SELECT c_custkey AS place, 'first' AS provider, 'p' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 60 + 0.5 END::DOUBLE AS lon, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END::DOUBLE AS lat, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 60 + 0.5 END::DOUBLE AS lon_gcj02,
 CASE WHEN c_custkey % 2 = 0 THEN 'street' ELSE 'P' || c_nationkey || 'A' END AS address, (c_custkey % 400)::INTEGER AS distance, c_mktsegment AS category FROM customer
 UNION ALL SELECT s_suppkey, 'second', NULL, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 60 + 0.25 END::DOUBLE, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey END::DOUBLE, NULL, '', NULL, 'shop' FROM supplier""")
def unified_pois(spark, sf_dir):
    a = F.expr("""to_json(struct('p' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 60) || '.5,' || c_nationkey END AS location, CASE WHEN c_custkey % 2 = 0 THEN 'street' ELSE '' END AS address, 'P' || c_nationkey AS pname, 'A' AS adname, c_custkey % 400 AS distance, c_mktsegment AS type))""")
    b = F.expr("to_json(struct(s_name AS name, CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 60) || '.25,' || s_nationkey ELSE ',' END AS lonlat, 'shop' AS typeName))")
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), a.alias("poi"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), b.alias("poi"))
    return P.unified_pois(first, second, "place", "poi").drop("lat_gcj02", "typecode", "tel")


@query("edge_features", """SELECT l_orderkey * 8 + l_linenumber AS edge_id, l_partkey AS osm_id, CASE l_linenumber % 4 WHEN 0 THEN 'track' WHEN 1 THEN 'steps' WHEN 2 THEN 'alley' ELSE 'unknown' END AS highway,
 CASE l_linenumber % 4 WHEN 0 THEN '农/林道路（田野道路）' WHEN 1 THEN '台阶' WHEN 2 THEN 'alley' ELSE 'unknown' END AS highway_desc, CASE l_suppkey % 3 WHEN 0 THEN 'N' || l_suppkey WHEN 1 THEN 'L' || l_suppkey ELSE '' END AS name, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_quantity END AS length, 'osm' AS source FROM lineitem""")
def edge_features(spark, sf_dir):
    text = F.expr("""'{' || CASE l_linenumber % 4 WHEN 0 THEN '"highway": ["track", "path"], ' WHEN 1 THEN '"highway": "steps", ' WHEN 2 THEN '"highway": "alley", ' ELSE '' END || CASE l_suppkey % 3 WHEN 0 THEN '"name": "N' || l_suppkey || '", ' WHEN 1 THEN '"name": ["L' || l_suppkey || '"], ' ELSE '"name": [], ' END || CASE WHEN l_suppkey % 5 = 0 THEN '"x": 1' ELSE '"length": ' || l_quantity END || '}'""")
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), "l_partkey", text.alias("edge"))
    return P.edge_features(e, "edge_id", "l_partkey", "edge")


_LABEL = "CASE {} WHEN 1 THEN '畅通' WHEN 2 THEN '缓行' WHEN 3 THEN '拥堵' WHEN 4 THEN '严重拥堵' ELSE '无数据' END"


@query("traffic_states", f"""SELECT o_orderkey AS order_id, {_LABEL.format('o_orderkey % 7')} AS status, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 100 ELSE 0 END::DOUBLE AS clear, (o_orderkey % 30)::DOUBLE AS blocked, 'A' || o_custkey || ',B' AS roads, {_LABEL.format('o_custkey % 6')} || ',无数据' AS road_states, (o_orderkey % 80)::INTEGER AS speed, 2 AS points FROM orders""")
def traffic_states(spark, sf_dir):
    info = F.expr("""'{"evaluation": {"status": ' || o_orderkey % 7 || ', "excellent": "' || CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 100 || '' ELSE '1.5' END || '", "blocked": ' || o_orderkey % 30 || '}}'""")
    roads = F.expr("""'[{"name": "A' || o_custkey || '", "status": ' || o_custkey % 6 || ', "speed": "' || o_orderkey % 80 || '", "polyline": "1,2;3,4"}, {"name": "B", "status": "1"}]'""")
    t = table(spark, sf_dir, "orders").select("o_orderkey", P.traffic_evaluation(info).alias("e"), P.traffic_roads(roads).alias("r"))
    share = lambda label: F.element_at("e.shares", label)
    return t.select(
        F.col("o_orderkey").alias("order_id"), F.col("e.status").alias("status"), share("畅通").alias("clear"), share("拥堵").alias("blocked"), F.array_join("r.name", ",").alias("roads"), F.array_join("r.status", ",").alias("road_states"),
        F.col("r")[0]["speed"].alias("speed"), F.size(F.col("r")[0]["coords"]).alias("points"),
    )


@query("village_centres", """SELECT c_custkey AS place, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 1.5 WHEN c_custkey % 3 = 1 THEN c_nationkey + 0.5 WHEN c_nationkey % 2 = 0 THEN 9.5 END::DOUBLE AS lon,
 CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'geocode' WHEN c_custkey % 3 = 1 THEN 'poi_search' WHEN c_nationkey % 2 = 0 THEN 'county_fallback' ELSE 'failed' END AS strategy FROM customer""")
def village_centres(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    village = F.concat(F.lit("V"), F.col("c_custkey").cast("string"), F.lit("村"))
    county = F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit("县"))
    located = c.withColumns({"location": F.concat(county, F.when(F.col("c_custkey") % 6 == 0, F.lit("")).otherwise(village)), "county": county, "village": village})
    places = located.select(F.col("c_custkey").alias("place"), "location")
    geocodes = located.where("c_custkey % 4 = 1").select("location", F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat"))
    pois = located.where("c_custkey % 3 = 1").select(F.col("county").alias("region"), F.col("village").alias("name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), (F.col("c_nationkey") + 0.5).alias("lon"), F.lit(3.5).alias("lat"))
    pois = pois.withColumn("lon", F.when(F.col("pos") == 1, F.col("lon")).otherwise(F.lit(-1.0)))
    counties = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string"), F.lit("县")).alias("county"), F.lit(9.5).alias("lon"), F.lit(8.5).alias("lat"))
    return P.located_centres(places, geocodes, pois, counties, "place").select("place", "lon", "strategy")


@query("routed_networks", """SELECT s_suppkey AS centre, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS route_count, CASE WHEN s_suppkey % 3 = 0 THEN 2 * 1000.0 + 1 ELSE 3 * 1000.0 + 3 END::DOUBLE AS total_distance_m, 3::BIGINT AS unique_coords FROM supplier""")
def routed_networks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("centre"), (F.lit(116.0) + F.col("s_suppkey") % 10).alias("lon"), F.lit(25.0).alias("lat"))
    point = lambda which: F.array(F.round(f"{which}_lon", 6), F.round(f"{which}_lat", 6))
    line = F.when(~((F.col("route_id") == 2) & (F.col("centre") % 3 == 0)), F.array(point("o"), point("d")))
    answers = P.probe_routes(s, "centre").select("centre", "route_id", (F.lit(1000.0) + F.col("route_id")).alias("distance"), line.alias("coords"))
    return P.routed_network(answers, "centre")


@query("geometry_vertices", """SELECT o_orderkey AS order_id, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN 3 ELSE 0 END AS n,
 CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 3 WHEN 2 THEN o_custkey + 5 WHEN 3 THEN o_custkey + 9 WHEN 4 THEN o_custkey + 4 ELSE 0 END::DOUBLE AS x_sum FROM orders""")
def geometry_vertices(spark, sf_dir):
    g = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN '{"type": "Point", "coordinates": [' || o_custkey || ', 2]}' WHEN 1 THEN '{"type": "LineString", "coordinates": [[' || o_custkey || ', 2], [3, 4, 5]]}'
 WHEN 2 THEN '{"type": "Polygon", "coordinates": [[[' || o_custkey || ', 0], [1, 0], [1, 1], [0, 0]], [[1, 1], [1, 2], [1, 3], [0, 1]]]}' WHEN 3 THEN '{"type": "MultiPolygon", "coordinates": [[[[' || o_custkey || ', 0], [1, 1], [1, 2]], [[1, 0], [1, 0], [1, 0]]], [[[1, 0], [1, 0], [2, 0]]]]}'
 WHEN 4 THEN '{"type": "MultiLineString", "coordinates": [[[' || o_custkey || ', 1], [1, 1]], [[3, 1]]]}' ELSE '{"type": "Circle"}' END""")
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), P.vertices(g).alias("v"))
    return v.select("order_id", F.size("v").alias("n"), F.aggregate(F.transform("v", lambda p: p[0]), F.lit(0.0), lambda s, x: s + x).alias("x_sum"))


_RATE = "(count(*) FILTER (WHERE c_custkey % (c_nationkey % 4 + 1) = 0))::DOUBLE / count(*)::DOUBLE"


@query("service_advice", f"""WITH r AS (SELECT c_nationkey AS area, {_RATE} AS rate, count(*) FILTER (WHERE c_custkey % (c_nationkey % 4 + 1) > 0) AS n, max(CASE WHEN c_custkey % (c_nationkey % 4 + 1) > 0 THEN c_custkey END) AS far FROM customer GROUP BY 1)
 SELECT area, (CASE WHEN rate < 0.8 THEN 1 ELSE 0 END + CASE WHEN n > 0 THEN 1 ELSE 0 END)::INTEGER AS n_advice, CASE WHEN rate < 0.5 THEN 'low' WHEN rate < 0.8 THEN 'fair' ELSE 'good' END AS class,
 CASE WHEN n > 0 THEN 'Farthest uncovered point is ' || far || 'm outside service radius. Consider facility at coordinates [' || far || '.5, 2.0].' END AS farthest, CASE WHEN area % 3 = 0 THEN 2 ELSE 1 END AS n_ecological FROM r""")
def service_advice(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("hit", F.col("c_custkey") % (F.col("c_nationkey") % 4 + 1) == 0)
    # The farthest point of each area is all that its advice needs: one row stands for the gaps.
    gap = F.max(F.when(~F.col("hit"), F.struct(F.col("c_custkey").cast("double").alias("gap_m"), F.array(F.col("c_custkey") + 0.5, F.lit(2.0)).alias("coordinates"))))
    r = c.groupBy(F.col("c_nationkey").alias("area")).agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("rate"), gap.alias("gap"))
    advice = P.gap_advice(F.lit("clinic"), F.col("rate"), F.array_compact(F.array("gap")))
    zones = F.array(F.struct(F.when(F.col("area") % 3 == 0, F.lit("river")).otherwise(F.lit("slope")).alias("zone_type"), F.lit(50).alias("buffer_distance_m")))
    first = F.get(advice, F.lit(0))
    return r.select(
        "area", F.size(advice).alias("n_advice"), F.when(first.contains("is below 50%"), "low").when(first.contains("needs improvement"), "fair").otherwise("good").alias("class"),
        F.get(F.filter(advice, lambda a: a.startswith("Farthest")), F.lit(0)).alias("farthest"), F.size(P.ecological_advice(F.lit("Moderately Sensitive"), zones)).alias("n_ecological"),
    )
