"""Spatial queries: customers are population points, suppliers are facilities, at places made from their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.functions import geo
from stratiform.operators import shapes, spatial as P
from stratiform.plans.base import query, table

_LON, _LAT = "(116.0::DOUBLE + (({0} * 37) % 1000) / 10000.0::DOUBLE)", "(24.8::DOUBLE + (({0} * 53) % 1000) / 10000.0::DOUBLE)"
_P = f"p AS (SELECT c_custkey AS point_id, {_LON.format('c_custkey')} AS lon, {_LAT.format('c_custkey')} AS lat, c_mktsegment AS area, greatest(round(c_acctbal), 0)::BIGINT AS population, (c_custkey % 5)::INTEGER AS kind FROM customer)"
_F = f"f AS (SELECT s_suppkey AS facility_id, {_LON.format('(s_suppkey + 7)')} AS lon_2, {_LAT.format('(s_suppkey + 11)')} AS lat_2, (s_suppkey % 5)::INTEGER AS kind FROM supplier)"
_H = """(6371000.0::DOUBLE * 2 * atan2(sqrt(pow(sin(radians(lat_2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat_2)) * pow(sin(radians(lon_2 - lon) / 2), 2)),
 sqrt(1 - (pow(sin(radians(lat_2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat_2)) * pow(sin(radians(lon_2 - lon) / 2), 2)))))"""


def _at(key, lon, lat, dx=0, dy=0):
    k = F.col(key)
    return (F.lit(116.0) + ((k + dx) * 37 % 1000) / 10000.0).alias(lon), (F.lit(24.8) + ((k + dy) * 53 % 1000) / 10000.0).alias(lat)


def points(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("point_id"), *_at("c_custkey", "lon", "lat"), F.col("c_mktsegment").alias("area"), F.greatest(F.round("c_acctbal"), F.lit(0.0)).cast("long").alias("population"), (F.col("c_custkey") % 5).cast("int").alias("kind"))


def facilities(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("facility_id"), *_at("s_suppkey", "lon_2", "lat_2", 7, 11), (F.col("s_suppkey") % 5).cast("int").alias("kind"))


@query("service_coverage", f"WITH {_P}, {_F}, n AS (SELECT point_id, arg_min(facility_id, facility_id) AS facility_id FROM p, f WHERE {_H} <= 500 GROUP BY 1) SELECT p.point_id, p.population, n.point_id IS NOT NULL AS covered, n.facility_id FROM p LEFT JOIN n USING (point_id)")
def service_coverage(spark, sf_dir):
    f = facilities(spark, sf_dir).drop("kind")
    return P.covered(points(spark, sf_dir), f, 500.0, "point_id", "facility_id", "facility_id").select("point_id", "population", "covered", "facility_id")


@query("service_coverage_rate", f"""WITH {_P}, {_F}, n AS (SELECT DISTINCT point_id FROM p, f WHERE {_H} <= 500) SELECT area, sum(CASE WHEN n.point_id IS NOT NULL THEN population ELSE 0 END)::BIGINT AS covered_weight, sum(population)::BIGINT AS total_weight,
 CASE WHEN sum(population) > 0 THEN round(sum(CASE WHEN n.point_id IS NOT NULL THEN population ELSE 0 END)::DOUBLE / sum(population)::DOUBLE, 4) ELSE 0.0 END AS rate FROM p LEFT JOIN n USING (point_id) GROUP BY 1""")
def service_coverage_rate(spark, sf_dir):
    f = facilities(spark, sf_dir).drop("kind")
    return P.coverage_rate(P.covered(points(spark, sf_dir), f, 500.0, "point_id", "facility_id", "facility_id"), "population", by=["area"])


@query("nearest_facility", f"WITH {_P}, {_F}, n AS (SELECT point_id, min({_H}) AS distance FROM p JOIN f USING (kind) GROUP BY 1) SELECT point_id, round(distance, 4) AS distance FROM n")
def nearest_facility(spark, sf_dir):
    out = shapes.nearest_point(points(spark, sf_dir), "point_id", facilities(spark, sf_dir), "facility_id", ["kind"])
    return out.select("point_id", F.round("distance", 4).alias("distance"))


@query("poi_coverage_by_type", f"""WITH {_P}, {_F}, m AS (SELECT kind, count(DISTINCT facility_id) AS found FROM f GROUP BY 1), n AS (SELECT kind, count(*) AS in_range FROM f, (SELECT 116.05::DOUBLE AS lon, 24.85::DOUBLE AS lat) c WHERE {_H} <= 2000 GROUP BY 1)
 SELECT kind, found, coalesce(in_range, 0) AS in_range, round(coalesce(in_range, 0) / greatest(found, 1)::DOUBLE, 4) AS rate FROM m LEFT JOIN n USING (kind)""")
def poi_coverage_by_type(spark, sf_dir):
    d = geo.haversine(F.lit(116.05), F.lit(24.85), F.col("lon_2"), F.col("lat_2"))
    g = facilities(spark, sf_dir).groupBy("kind").agg(F.countDistinct("facility_id").alias("found"), F.count_if(d <= 2000).alias("in_range"))
    return g.withColumn("rate", F.round(F.col("in_range") / F.greatest("found", F.lit(1)), 4))


@query("gap_points", f"WITH {_P} SELECT point_id, round(d - 3000, 1) AS gap FROM (SELECT point_id, {_H} AS d FROM p, (SELECT 116.05::DOUBLE AS lon_2, 24.85::DOUBLE AS lat_2)) WHERE d > 3000")
def gap_points(spark, sf_dir):
    d = geo.haversine(F.col("lon"), F.col("lat"), F.lit(116.05), F.lit(24.85))
    return points(spark, sf_dir).withColumn("d", d).filter("d > 3000").select("point_id", F.round(F.col("d") - 3000, 1).alias("gap"))


@query("bbox_filter", f"WITH {_P} SELECT point_id, lon, lat FROM p WHERE lon BETWEEN 116.02 AND 116.06 AND lat BETWEEN 24.82 AND 24.87")
def bbox_filter(spark, sf_dir):
    return points(spark, sf_dir).filter(F.col("lon").between(116.02, 116.06) & F.col("lat").between(24.82, 24.87)).select("point_id", "lon", "lat")


@query("haversine_metres", f"WITH {_P} SELECT point_id, round({_H}, 3) AS metres FROM p, (SELECT 116.05::DOUBLE AS lon_2, 24.85::DOUBLE AS lat_2)")
def haversine_metres(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(116.05), F.lit(24.85)), 3).alias("metres"))


_X, _Y = "(lon - 105.0)", "(lat - 35.0)"
_C = f"((20.0 * sin(6.0 * {_X} * pi()) + 20.0 * sin(2.0 * {_X} * pi())) * 2.0 / 3.0)"


@query("gcj_to_wgs", f"""WITH {_P}, s AS (SELECT point_id, lon, lat, 1 - 0.00669342162296594323::DOUBLE * pow(sin(lat / 180.0 * pi()), 2) AS magic,
 -100.0 + 2.0 * {_X} + 3.0 * {_Y} + 0.2 * {_Y} * {_Y} + 0.1 * {_X} * {_Y} + 0.2 * sqrt(abs({_X})) + {_C} + (20.0 * sin({_Y} * pi()) + 40.0 * sin({_Y} / 3.0 * pi())) * 2.0 / 3.0 + (160.0 * sin({_Y} / 12.0 * pi()) + 320.0 * sin({_Y} * pi() / 30.0)) * 2.0 / 3.0 AS dlat,
 300.0 + {_X} + 2.0 * {_Y} + 0.1 * {_X} * {_X} + 0.1 * {_X} * {_Y} + 0.1 * sqrt(abs({_X})) + {_C} + (20.0 * sin({_X} * pi()) + 40.0 * sin({_X} / 3.0 * pi())) * 2.0 / 3.0 + (150.0 * sin({_X} / 12.0 * pi()) + 300.0 * sin({_X} / 30.0 * pi())) * 2.0 / 3.0 AS dlon FROM p)
 SELECT point_id, round(lon - dlon * 180.0 / (6378245.0::DOUBLE / sqrt(magic) * cos(lat / 180.0 * pi()) * pi()), 8) AS wgs_lon, round(lat - dlat * 180.0 / ((6378245.0::DOUBLE * (1 - 0.00669342162296594323::DOUBLE)) / (magic * sqrt(magic)) * pi()), 8) AS wgs_lat FROM s""")
def gcj_to_wgs(spark, sf_dir):
    lon, lat = geo.gcj_to_wgs(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("point_id", F.round(lon, 8).alias("wgs_lon"), F.round(lat, 8).alias("wgs_lat"))


@query("tile_xy", f"WITH {_P} SELECT point_id, floor((lon + 180.0) / 360.0 * 16384.0)::BIGINT AS tile_x, floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 16384.0)::BIGINT AS tile_y FROM p")
def tile_xy(spark, sf_dir):
    x, y = geo.tile_xy(F.col("lon"), F.col("lat"), 14)
    return points(spark, sf_dir).select("point_id", x.cast("long").alias("tile_x"), y.cast("long").alias("tile_y"))


@query("mercator_xy", f"WITH {_P} SELECT point_id, round(lon * 20037508.342789244::DOUBLE / 180.0, 4) AS x, round(ln(tan((90.0 + lat) * pi() / 360.0)) * 20037508.342789244::DOUBLE / pi(), 4) AS y FROM p")
def mercator_xy(spark, sf_dir):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("point_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("centroid_bbox", f"WITH {_P} SELECT area, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM p GROUP BY 1")
def centroid_bbox(spark, sf_dir):
    g = P.centroid_bbox(points(spark, sf_dir), ["area"])
    return g.withColumn("lon", F.round("lon", 9)).withColumn("lat", F.round("lat", 9))


@query("isochrone_ring", f"""WITH {_F} SELECT facility_id, minutes, radius, i AS corner, round(lon_2 + radius * cos(i * (2 * pi() / 36)) / 111320.0, 9) AS lon, round(lat_2 + radius * sin(i * (2 * pi() / 36)) / 110540.0, 9) AS lat
 FROM (SELECT facility_id, lon_2, lat_2, minutes, round(minutes / 60.0::DOUBLE * 5.0 * 1000, 2) AS radius FROM f, (VALUES (5), (10), (15)) v(minutes)), (SELECT unnest(range(36))::INTEGER AS i)""")
def isochrone_ring(spark, sf_dir):
    f = facilities(spark, sf_dir).select("facility_id", F.col("lon_2").alias("lon"), F.col("lat_2").alias("lat"))
    iso = P.isochrones(f, [15, 5, 10], "walk").select("facility_id", "minutes", "radius", F.posexplode("ring").alias("corner", "pt")).filter("corner < 36")
    return iso.select("facility_id", "minutes", "radius", "corner", F.round(F.col("pt")[0], 9).alias("lon"), F.round(F.col("pt")[1], 9).alias("lat"))


@query("ring_area", f"WITH {_F} SELECT facility_id, minutes, round(18 * sin(2 * pi() / 36) * pow(round(minutes / 60.0::DOUBLE * 5.0 * 1000, 2), 2) / (111320.0::DOUBLE * 110540.0) * 1e6, 4) AS area FROM f, (VALUES (5), (15)) v(minutes)")
def ring_area(spark, sf_dir):
    f = facilities(spark, sf_dir).select("facility_id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return P.isochrones(f, [5, 15], "walk").select("facility_id", "minutes", F.round(geo.shoelace(F.col("ring")) * 1e6, 4).alias("area"))


@query("travel_reach", f"""WITH {_P}, r AS (SELECT point_id, CASE WHEN point_id % 3 = 0 THEN {_H} * 1.3 ELSE {_H} END AS metres, CASE WHEN point_id % 3 = 0 THEN {_H} / 9.0 / 60.0 ELSE {_H} / 1000.0 / 40.0 * 60.0 END AS minutes FROM p, (SELECT 116.05::DOUBLE AS lon_2, 24.85::DOUBLE AS lat_2))
 SELECT point_id, round(metres, 3) AS metres, round(minutes, 4) AS minutes, minutes <= 8 AND metres <= 5000 AS reachable, minutes <= 8 AS in_time FROM r""")
def travel_reach(spark, sf_dir):
    p = points(spark, sf_dir).select("point_id", F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), F.lit(116.05).alias("d_lon"), F.lit(24.85).alias("d_lat"))
    d = geo.haversine(F.col("o_lon"), F.col("o_lat"), F.col("d_lon"), F.col("d_lat"))
    routes = p.withColumn("ok", F.col("point_id") % 3 == 0).withColumn("distance_m", F.when(F.col("ok"), d * 1.3)).withColumn("duration_s", F.when(F.col("ok"), d / 9.0))
    out = P.travel(routes, 40.0, 8.0, 5000.0)
    return out.select("point_id", F.round("metres", 3).alias("metres"), F.round("minutes", 4).alias("minutes"), "reachable", "in_time")


@query("site_score", """SELECT s_suppkey AS facility_id, round(score, 1) AS score, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Moderate' WHEN score >= 20 THEN 'Poor' ELSE 'Unsuitable' END AS level FROM (SELECT s_suppkey,
 round((0.30::DOUBLE * (s_suppkey % 101)::DOUBLE + 0.25::DOUBLE * coalesce(CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey * 7 % 101)::DOUBLE END, 50.0) + 0.20::DOUBLE * (s_suppkey * 13 % 101)::DOUBLE + 0.15::DOUBLE * 50.0 + 0.05::DOUBLE * 50.0 + 0.05::DOUBLE * 50.0) / 1.0::DOUBLE, 6) AS score FROM supplier)""")
def site_score(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("facility_id"), (k % 101).cast("double").alias("a"), F.when(k % 4 > 0, (k * 7 % 101).cast("double")).alias("b"), (k * 13 % 101).cast("double").alias("c"))
    return P.site_score(s, {"coverage": "a", "population": "b", "proximity": "c"}).select("facility_id", "score", "level")


@query("points_in_zone", f"WITH {_P} SELECT point_id FROM p WHERE lon > 116.0123 AND lon < 116.0617 AND lat > 24.8151 AND lat < 24.8519")
def points_in_zone(spark, sf_dir):
    w, e, s, n = 116.0123, 116.0617, 24.8151, 24.8519
    box = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    near = points(spark, sf_dir).filter(F.col("lon").between(w, e) & F.col("lat").between(s, n))
    return near.filter(geo.inside(F.col("lon"), F.col("lat"), box)).select("point_id")


@query("union_layers", "SELECT 'nation' AS layer, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def union_layers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("nation").alias("layer"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.lit("region").alias("layer"), F.col("r_name").alias("name")))


@query("highway_histogram", "SELECT string_split(p_type, ' ')[1] AS highway, count(*) AS n, sum(CASE WHEN string_split(p_type, ' ')[1] IN ('STANDARD', 'PROMO') THEN 1 ELSE 0 END)::BIGINT AS relevant FROM part GROUP BY 1")
def highway_histogram(spark, sf_dir):
    kind = F.element_at(F.split("p_type", " "), 1)
    p = table(spark, sf_dir, "part").select(kind.alias("highway"))
    return p.groupBy("highway").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("highway").isin("STANDARD", "PROMO"), 1).otherwise(0)).alias("relevant"))


@query("route_totals", "SELECT l_suppkey AS network, count(*) AS n_routes, sum(l_quantity) AS metres, count(DISTINCT (l_partkey, l_linenumber)) AS n_points FROM lineitem GROUP BY 1")
def route_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("network")).agg(F.count(F.lit(1)).alias("n_routes"), F.sum("l_quantity").alias("metres"), F.countDistinct("l_partkey", "l_linenumber").alias("n_points"))


@query("population_forecast", """SELECT n_nationkey, y AS n_years, floor((n_nationkey * 137 + 500)::DOUBLE * pow(1 + (5 + n_nationkey % 7)::DOUBLE / 1000.0, y) + 20)::BIGINT AS population FROM nation, (VALUES (1), (5), (15)) v(y)""")
def population_forecast(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("n_years", F.explode(F.array(F.lit(1), F.lit(5), F.lit(15))))
    p0, k = (F.col("n_nationkey") * 137 + 500).cast("double"), (5 + F.col("n_nationkey") % 7).cast("double")
    return n.select("n_nationkey", "n_years", F.floor(p0 * F.pow(1 + k / 1000.0, F.col("n_years")) + 20).cast("long").alias("population"))
