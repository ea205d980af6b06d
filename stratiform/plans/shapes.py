"""Overlay, predicates, zones and nearest lines: customers are plots and roads, suppliers are zones with a hole."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import overlay as O, shapes as S
from stratiform.plans.base import query
from stratiform.plans.spatial import _F, _P, facilities, points

#: Half sides in degrees: of a zone and of its hole, and the step of a plot's.
ZONE, HOLE, PLOT = 0.004, 0.002, 0.0005
#: Corners of a road beside a customer.
ROAD = [(0.0013371, 0.0004127), (0.0031413, 0.0027183), (0.0029979, -0.0016021)]
KINDS = ["farmland", "ecological", "historical"]


def _square(x, y, h):
    at = lambda i, j: F.array(x + i * h, y + j * h)
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))


def plots(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("point_id", "kind", F.array(_square(F.col("lon"), F.col("lat"), F.lit(PLOT) * (F.col("point_id") % 4 + 1))).alias("rings"))


def zones(spark, sf_dir):
    f = facilities(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") % 3 + 1)
    return f.select("facility_id", "kind", kind.alias("zone_type"), F.array(*[_square(F.col("lon_2"), F.col("lat_2"), F.lit(h)) for h in (ZONE, HOLE)]).alias("rings"))


def roads(spark, sf_dir):
    line = F.array(*[F.array(F.col("lon") + dx, F.col("lat") + dy) for dx, dy in ROAD])
    return points(spark, sf_dir).where("kind = 0").select(F.col("point_id").alias("road_id"), F.array(line).alias("lines"))


_A = f"a AS (SELECT point_id, kind, lon - {PLOT} * (point_id % 4 + 1) AS x1, lon + {PLOT} * (point_id % 4 + 1) AS x2, lat - {PLOT} * (point_id % 4 + 1) AS y1, lat + {PLOT} * (point_id % 4 + 1) AS y2 FROM p)"
_B = f"""b AS (SELECT facility_id, kind, ['farmland', 'ecological', 'historical'][kind % 3 + 1] AS zone_type, lon_2 - {ZONE} AS ox1, lon_2 + {ZONE} AS ox2, lat_2 - {ZONE} AS oy1, lat_2 + {ZONE} AS oy2,
 lon_2 - {HOLE} AS hx1, lon_2 + {HOLE} AS hx2, lat_2 - {HOLE} AS hy1, lat_2 + {HOLE} AS hy2 FROM f)"""
_SHARE = "greatest(0, least(a.x2, {0}x2) - greatest(a.x1, {0}x1)) * greatest(0, least(a.y2, {0}y2) - greatest(a.y1, {0}y1))"
_XY = f"WITH {_P}, {_F}, {_A}, {_B}"
#: Cells between all borders of zones that some zone covers.
_CELLS = """xs AS (SELECT v AS x1, lead(v) OVER (ORDER BY v) AS x2 FROM (SELECT DISTINCT unnest([ox1, ox2, hx1, hx2]) AS v FROM b)), ys AS (SELECT v AS y1, lead(v) OVER (ORDER BY v) AS y2 FROM (SELECT DISTINCT unnest([oy1, oy2, hy1, hy2]) AS v FROM b)),
 cells AS (SELECT DISTINCT x1, x2, y1, y2 FROM xs, ys, b WHERE (x1 + x2) / 2 BETWEEN ox1 AND ox2 AND (y1 + y2) / 2 BETWEEN oy1 AND oy2 AND NOT ((x1 + x2) / 2 BETWEEN hx1 AND hx2 AND (y1 + y2) / 2 BETWEEN hy1 AND hy2))"""


def _rounded(area):
    """Areas in squares of 1e-4 degrees, without what is rounding."""
    return F.round(area * 1e8, 3)


@query("overlay_intersection", f"{_XY} SELECT point_id, facility_id, round(s * 1e8, 3) AS area FROM (SELECT point_id, facility_id, {_SHARE.format('o')} - {_SHARE.format('h')} AS s FROM a, b) WHERE s > 1e-13")
def overlay_intersection(spark, sf_dir):
    got = O.overlay_areas(plots(spark, sf_dir), zones(spark, sf_dir), "intersection", "point_id", "facility_id")
    return got.where("area > 1e-13").select(F.col("a").alias("point_id"), F.col("b").alias("facility_id"), _rounded(F.col("area")).alias("area"))


@query("overlay_clip_difference", f"{_XY}, {_CELLS}, c AS (SELECT point_id, sum({_SHARE.format('c.')}) AS s FROM a, cells c WHERE a.x1 < c.x2 AND c.x1 < a.x2 AND a.y1 < c.y2 AND c.y1 < a.y2 GROUP BY 1) SELECT point_id, round(coalesce(s, 0) * 1e8, 3) AS clipped, round(((x2 - x1) * (y2 - y1) - coalesce(s, 0)) * 1e8, 3) + 0.0 AS left_over FROM a LEFT JOIN c USING (point_id)")
def overlay_clip_difference(spark, sf_dir):
    a, b = plots(spark, sf_dir), zones(spark, sf_dir)
    part = lambda how: O.overlay_areas(a, b, how, "point_id", "facility_id").select(F.col("a").alias("point_id"), F.col("area").alias(how))
    out = a.select("point_id").join(part("clip"), "point_id", "left").join(part("difference"), "point_id", "left")
    zero = F.lit(0.0)
    return out.select("point_id", _rounded(F.coalesce("clip", zero)).alias("clipped"), _rounded(F.coalesce("difference", zero)).alias("left_over"))


@query("overlay_union_totals", f"""{_XY}, {_CELLS}, u AS (SELECT x1, x2, y1, y2 FROM a), xa AS (SELECT sum((x2 - x1) * (y2 - y1)) AS s FROM cells)
 SELECT round(s * 1e8, 3) AS zones_area, (SELECT round(sum(i) * 1e8, 2) FROM (SELECT {_SHARE.format('o')} - {_SHARE.format('h')} AS i FROM a, b)) AS shared_area FROM xa""")
def overlay_union_totals(spark, sf_dir):
    whole = O.overlay_sums(plots(spark, sf_dir), zones(spark, sf_dir), "union", "point_id", "facility_id")
    shared = whole.where("in_a and in_b").agg(F.round(F.sum("area") * 1e8, 2).alias("shared_area"))
    return O.dissolve(zones(spark, sf_dir)).agg(_rounded(F.sum("area")).alias("zones_area")).crossJoin(shared)  # one row each


#: Diamonds: discs of four corners, whose union another engine can add up in turned coordinates.
_RADIUS = 0.003


@query("buffer_dissolve", f"""WITH {_F}, d AS (SELECT kind, lon_2 + lat_2 - {_RADIUS} AS x1, lon_2 + lat_2 + {_RADIUS} AS x2, lon_2 - lat_2 - {_RADIUS} AS y1, lon_2 - lat_2 + {_RADIUS} AS y2 FROM f),
 xs AS (SELECT kind, v AS x1, lead(v) OVER (PARTITION BY kind ORDER BY v) AS x2 FROM (SELECT DISTINCT kind, unnest([x1, x2]) AS v FROM d)), ys AS (SELECT kind, v AS y1, lead(v) OVER (PARTITION BY kind ORDER BY v) AS y2 FROM (SELECT DISTINCT kind, unnest([y1, y2]) AS v FROM d)),
 c AS (SELECT DISTINCT kind, xs.x1, xs.x2, ys.y1, ys.y2 FROM xs JOIN ys USING (kind) JOIN d USING (kind) WHERE (xs.x1 + xs.x2) / 2 BETWEEN d.x1 AND d.x2 AND (ys.y1 + ys.y2) / 2 BETWEEN d.y1 AND d.y2)
 SELECT kind, round(sum((x2 - x1) * (y2 - y1)) / 2 * 1e8, 3) AS area FROM c GROUP BY 1""")
def buffer_dissolve(spark, sf_dir):
    f = facilities(spark, sf_dir).select("facility_id", "kind", F.array(F.array(F.array("lon_2", "lat_2"))).alias("rings"))
    parts = O.buffer_parts(f, "kind", F.lit(_RADIUS), corners=4)
    return O.dissolve(parts, "key").groupBy(F.col("a").alias("kind")).agg(_rounded(F.sum("area")).alias("area"))


_SEG = "r AS (SELECT point_id AS road_id, " + ", ".join(f"lon + {dx} AS rx{i}, lat + {dy} AS ry{i}" for i, (dx, dy) in enumerate(ROAD)) + " FROM p WHERE kind = 0), s AS (" + " UNION ALL ".join(
    f"SELECT road_id, rx{i} AS x1, ry{i} AS y1, rx{i + 1} AS x2, ry{i + 1} AS y2 FROM r" for i in range(len(ROAD) - 1)) + ")"
_EDGES = "e AS (" + " UNION ALL ".join(
    f"SELECT facility_id, {k}{a[0]} AS u1, {k}{a[1]} AS v1, {k}{b[0]} AS u2, {k}{b[1]} AS v2 FROM b" for k in "oh" for a, b in ((("x1", "y1"), ("x2", "y1")), (("x2", "y1"), ("x2", "y2")), (("x2", "y2"), ("x1", "y2")), (("x1", "y2"), ("x1", "y1")))
) + ")"
_SIDE = "sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"
_MEET = f"""{_SIDE.format('u1', 'v1', 'u2', 'v2', 'x1', 'y1')} * {_SIDE.format('u1', 'v1', 'u2', 'v2', 'x2', 'y2')} <= 0 AND {_SIDE.format('x1', 'y1', 'x2', 'y2', 'u1', 'v1')} * {_SIDE.format('x1', 'y1', 'x2', 'y2', 'u2', 'v2')} <= 0"""


@query("roads_in_zones", f"""{_XY}, {_SEG}, {_EDGES} SELECT DISTINCT road_id, facility_id FROM s, e WHERE {_MEET}
 UNION SELECT road_id, facility_id FROM r, b WHERE rx0 BETWEEN ox1 AND ox2 AND ry0 BETWEEN oy1 AND oy2 AND NOT (rx0 BETWEEN hx1 AND hx2 AND ry0 BETWEEN hy1 AND hy2)""")
def roads_in_zones(spark, sf_dir):
    return S.intersects(roads(spark, sf_dir).withColumnRenamed("lines", "rings"), zones(spark, sf_dir), "road_id", "facility_id", filled_a=False).toDF("road_id", "facility_id")


@query("plots_within_zones", f"{_XY} SELECT point_id, facility_id FROM a, b WHERE x1 >= ox1 - 1e-9 AND x2 <= ox2 + 1e-9 AND y1 >= oy1 - 1e-9 AND y2 <= oy2 + 1e-9 AND (x2 <= hx1 + 1e-9 OR x1 >= hx2 - 1e-9 OR y2 <= hy1 + 1e-9 OR y1 >= hy2 - 1e-9)")
def plots_within_zones(spark, sf_dir):
    return S.within(plots(spark, sf_dir), zones(spark, sf_dir), "point_id", "facility_id", slack=1e-6).toDF("point_id", "facility_id")


_IN = "x BETWEEN ox1 AND ox2 AND y BETWEEN oy1 AND oy2 AND NOT (x BETWEEN hx1 AND hx2 AND y BETWEEN hy1 AND hy2)"
#: Places beside the customers, off the borders of all zones.
_Q = "q AS (SELECT point_id, lon + 0.00001234 AS x, lat + 0.00002345 AS y FROM p)"


def places(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", (F.col("lon") + 0.00001234).alias("x"), (F.col("lat") + 0.00002345).alias("y"))


@query("protection_conflicts", f"{_XY}, {_Q}, h AS (SELECT DISTINCT point_id, zone_type FROM q, b WHERE {_IN}) SELECT point_id, count(h.zone_type) > 0 AS in_protected_zone, coalesce(string_agg(zone_type || ':' || CASE WHEN zone_type = 'farmland' THEN 'high' ELSE 'medium' END, ',' ORDER BY zone_type), '') AS conflicts FROM q LEFT JOIN h USING (point_id) GROUP BY 1")
def protection_conflicts(spark, sf_dir):
    out = S.protection_conflicts(places(spark, sf_dir), "point_id", zones(spark, sf_dir), "facility_id", "zone_type")
    return out.select("point_id", "in_protected_zone", F.array_join(F.transform("conflicts", lambda c: F.concat(c["zone_type"], F.lit(":"), c["severity"])), ",").alias("conflicts"))


_TO = "sqrt(pow({0} - x1 - t * (x2 - x1), 2) + pow({1} - y1 - t * (y2 - y1), 2))"
_T = "greatest(0, least(1, (({0} - x1) * (x2 - x1) + ({1} - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2))))"


@query("hazard_state", f"""{_XY}, {_Q}, {_EDGES}, z AS (SELECT * FROM b WHERE kind = 0), i AS (SELECT DISTINCT point_id FROM q, z WHERE {_IN}),
 d AS (SELECT point_id, min({_TO.format('x', 'y')}) * 111000 AS m FROM (SELECT q.*, x1, y1, x2, y2, {_T.format('x', 'y')} AS t FROM q, (SELECT u1 AS x1, v1 AS y1, u2 AS x2, v2 AS y2 FROM e WHERE facility_id IN (SELECT facility_id FROM z))) GROUP BY 1)
 SELECT q.point_id, i.point_id IS NOT NULL AS in_hazard_zone, i.point_id IS NULL AND coalesce(m <= 500, false) AS near_hazard_zone FROM q LEFT JOIN i USING (point_id) LEFT JOIN d USING (point_id)""")
def hazard_state(spark, sf_dir):
    return S.hazard_state(places(spark, sf_dir), "point_id", zones(spark, sf_dir).where("kind = 0"), "facility_id")


@query("nearest_road", f"WITH {_P}, {_F}, {_SEG} SELECT facility_id, round(min({_TO.format('lon_2', 'lat_2')}) * 111000, 3) AS metres FROM (SELECT f.*, x1, y1, x2, y2, {_T.format('lon_2', 'lat_2')} AS t FROM f, s) GROUP BY 1")
def nearest_road(spark, sf_dir):
    f = facilities(spark, sf_dir).select("facility_id", F.col("lon_2").alias("x"), F.col("lat_2").alias("y"))
    return S.nearest_segment(f, "facility_id", roads(spark, sf_dir), "road_id").select("facility_id", F.round("metres", 3).alias("metres"))


@query("road_offsets", f"WITH {_P}, {_F}, {_SEG}, d AS (SELECT facility_id, min({_TO.format('lon_2', 'lat_2')}) * 111000 AS m FROM (SELECT f.*, x1, y1, x2, y2, {_T.format('lon_2', 'lat_2')} AS t FROM f, s) GROUP BY 1) SELECT count(*) AS points, round(avg(m), 3) AS average_offset_m, round(max(m), 3) AS largest_offset_m FROM d")
def road_offsets(spark, sf_dir):
    f = facilities(spark, sf_dir).select("facility_id", F.col("lon_2").alias("x"), F.col("lat_2").alias("y"))
    out = S.offsets(f, "facility_id", roads(spark, sf_dir), "road_id")
    return out.select("points", F.round("average_offset_m", 3).alias("average_offset_m"), F.round("largest_offset_m", 3).alias("largest_offset_m"))
