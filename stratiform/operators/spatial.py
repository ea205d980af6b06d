"""Spatial joins and site analysis on points: grid cells first, exact distance after."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.functions import geo

# Standard service radius in metres, travel speed in km/h, score weights, sensitivity factors.
SERVICE_RADIUS = {
    "幼儿园": 300, "小学": 500, "中学": 1000, "医院": 1000, "诊所": 500, "公园": 500, "公交站": 300, "停车场": 200, "超市": 500, "菜市场": 500, "健身设施": 500, "垃圾收集点": 100,
}
MIN_POPULATION = {"幼儿园": 500, "小学": 1000, "中学": 3000, "医院": 5000, "诊所": 1000, "公园": 2000, "超市": 1500, "菜市场": 2000, "健身设施": 1000, "垃圾收集点": 200, "公交站": 500}
SPEED_KMH = {"walk": 5.0, "bike": 15.0, "drive": 40.0}
SCORE_WEIGHTS = {"coverage": 0.30, "population": 0.25, "proximity": 0.20, "constraints": 0.15, "protection": 0.05, "hazard": 0.05}
SENSITIVITY = {"water_body": (50, 0.3), "river": (30, 0.25), "wetland": (100, 0.35), "forest": (20, 0.15), "slope_over_25": (0, 0.2)}
MISSING_SCORE, DEFAULT_RADIUS = 50.0, 500


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """All (left, right) pairs within ``radius`` metres, with ``distance``: no cross join.

    Both sides get the cell of a grid in space as wide as the radius, so it holds at the poles and
    across the date line; the right side goes to its own cell and the 26 around, so pairs meet in an
    equi-join, which a further key ``on`` makes narrower. Columns of the right side are lon_2,
    lat_2 and what else it has; names must not clash.
    """

    def cells(df: DataFrame, lon: str, lat: str) -> DataFrame:
        a, b = F.radians(lon), F.radians(lat)
        # a hair wider than the radius, so that rounding moves no pair more than one cell apart
        xyz = {"_x": F.cos(b) * F.cos(a), "_y": F.cos(b) * F.sin(a), "_z": F.sin(b)}
        return df.withColumns({k: cell(v * geo.EARTH, radius * 1.000001 + 0.01) for k, v in xyz.items()})

    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", s)]) for s in steps])
    b = cells(right, "lon_2", "lat_2").withColumn("_o", F.explode(around))
    b = b.withColumns({"_x": F.col("_x") + F.col("_o.i"), "_y": F.col("_y") + F.col("_o.j"), "_z": F.col("_z") + F.col("_o.k")}).drop("_o")
    joined = cells(left, "lon", "lat").join(b, ["_x", "_y", "_z", *on]).drop("_x", "_y", "_z")
    distance = geo.haversine(F.col("lon"), F.col("lat"), F.col("lon_2"), F.col("lat_2"))
    return joined.withColumn("distance", distance).filter(F.col("distance") <= radius)


def covered(points: DataFrame, facilities: DataFrame, radius: float, key: str, rank: str, name: str) -> DataFrame:
    """Each point with whether a facility is within the radius, and the one that stands first in the list."""
    spots = facilities.groupBy("lon_2", "lat_2").agg(F.min(F.struct(F.col(rank).alias("_r"), F.col(name).alias("_n"))).alias("_s"))
    near = radius_pairs(points.select("lon", "lat").distinct(), spots, radius)
    first = near.groupBy("lon", "lat").agg(F.min(F.struct("_s", "distance")).alias("_f"))
    out = points.join(first, ["lon", "lat"], "left")
    return out.select(*points.columns, F.col("_f").isNotNull().alias("covered"), F.col("_f._s._n").alias(name), F.col("_f.distance").alias("distance"))


def nearest(points: DataFrame, facilities: DataFrame, within: float, key: str, name: str, on: Sequence[str] = ()) -> DataFrame:
    """Nearest facility of each point within a distance, ties by name; null where there is none."""
    at = [*on, "lon", "lat"]
    spots = facilities.groupBy(*on, "lon_2", "lat_2").agg(F.min(name).alias(name))
    near = radius_pairs(points.select(*at).distinct(), spots, within, on)
    best = near.groupBy(*at).agg(F.min(F.struct("distance", name)).alias("_b"))
    return points.select(key, *at).join(best, at, "left").select(key, F.col(f"_b.{name}").alias(name), F.col("_b.distance").alias("distance"))


def weighted_pairs(points: DataFrame, facilities: DataFrame, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """(on, distance, n) of pairs of places within ``radius`` metres: n pairs of a point and a facility have it."""
    places = points.groupBy(*on, "lon", "lat").agg(F.count(F.lit(1)).alias("_n"))
    spots = facilities.groupBy(*on, "lon_2", "lat_2").agg(F.count(F.lit(1)).alias("_n2"))
    return radius_pairs(places, spots, radius, on).select(*on, "distance", (F.col("_n") * F.col("_n2")).alias("n"))


def coverage_rate(df: DataFrame, weight: str, flag: str = "covered", by: Sequence[str] = ()) -> DataFrame:
    """Covered and total weight, and their ratio to 4 places, 0 where the total is."""
    total, part = F.sum(weight), F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0))
    return df.groupBy(*by).agg(part.alias("covered_weight"), total.alias("total_weight")).withColumn(
        "rate", F.when(F.col("total_weight") > 0, F.round(F.col("covered_weight") / F.col("total_weight"), 4)).otherwise(0.0)
    )


def isochrones(centres: DataFrame, minutes: Sequence[int], mode: str, points: int = 36) -> DataFrame:
    """A closed circle for each centre and travel time, smallest first."""
    out = centres.withColumn("minutes", F.explode(F.array(*map(F.lit, sorted(minutes)))))
    radius = F.round(F.col("minutes") / 60.0 * SPEED_KMH[mode] * 1000, 2)
    return out.withColumn("radius", radius).withColumn("ring", geo.ring(F.col("lon"), F.col("lat"), F.col("radius"), points))


def travel(routes: DataFrame, speed: float, most_minutes: float, most_metres: float) -> DataFrame:
    """Reachability of origin-destination rows: the route's figures, else straight distance at ``speed`` km/h."""
    straight = geo.haversine(F.col("o_lon"), F.col("o_lat"), F.col("d_lon"), F.col("d_lat"))
    d = F.when(F.col("ok"), F.col("distance_m")).otherwise(straight)
    t = F.when(F.col("ok"), F.col("duration_s") / 60.0).otherwise(straight / 1000.0 / speed * 60.0)
    return routes.withColumn("metres", d).withColumn("minutes", t).withColumn("reachable", (F.col("minutes") <= most_minutes) & (F.col("metres") <= most_metres)).withColumn(
        "in_time", F.col("minutes") <= most_minutes
    )


def level(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Moderate").when(score >= 20, "Poor").otherwise("Unsuitable")


def site_score(df: DataFrame, scores: dict[str, str | None]) -> DataFrame:
    """Weighted mean of sub-scores (columns by name; absent or null: ``MISSING_SCORE``), and its level."""
    parts = [F.lit(w) * (F.coalesce(F.col(scores[k]), F.lit(MISSING_SCORE)) if scores.get(k) else F.lit(MISSING_SCORE)) for k, w in SCORE_WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    exact = F.round(total / sum(SCORE_WEIGHTS.values()), 6)
    return df.withColumn("level", level(exact)).withColumn("score", F.round(exact, 1))


def sensitivity(areas: DataFrame, study_km2: float) -> DataFrame:
    """Index of buffer areas (factor, area_km2) by weight over the study area, and its class."""
    weight = F.create_map(*[F.lit(x) for k, (_, w) in SENSITIVITY.items() for x in (k, w)])
    index = areas.agg(F.coalesce(F.sum(F.col("area_km2") * weight[F.col("factor")]), F.lit(0.0)).alias("s")).select((F.col("s") / study_km2).alias("index"))
    cut = F.when(F.col("index") >= 0.3, "Highly Sensitive").when(F.col("index") >= 0.15, "Moderately Sensitive").when(F.col("index") >= 0.05, "Low Sensitivity").otherwise("Minimal Sensitivity")
    return index.withColumn("class", cut)


def centroid_bbox(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of all vertices and the box around them."""
    agg = {"lon": F.avg("lon"), "lat": F.avg("lat"), "west": F.min("lon"), "south": F.min("lat"), "east": F.max("lon"), "north": F.max("lat")}
    return points.groupBy(*by).agg(*[v.alias(k) for k, v in agg.items()])


def prefer(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first provider that answered for a key; an empty answer is an answer (``ok``), a failure is none."""
    merged = None
    for i, f in enumerate(frames):
        part = f.withColumn("_rank", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    best = merged.filter("ok").groupBy(key).agg(F.min("_rank").alias("_best"))
    return merged.join(best, key).filter("_rank = _best").drop("_rank", "_best")


def nearest_k(points: DataFrame, facilities: DataFrame, within: float, k: int, key: str, name: str, on: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest facilities of each point within a distance, ties by name, with their rank."""
    at, spot = [*on, "lon", "lat"], [*on, "lon_2", "lat_2"]
    # at one place the first k names stand for all, and points of one place share their list
    first = facilities.select(*spot, name).withColumn("_n", F.row_number().over(Window.partitionBy(*spot).orderBy(name))).filter(F.col("_n") <= k).drop("_n")
    near = radius_pairs(points.select(*at).distinct(), first, within, on)
    rank = F.row_number().over(Window.partitionBy(*at).orderBy(F.round("distance", 4), name))
    lists = near.withColumn("rank", rank).filter(F.col("rank") <= k).select(*at, name, "distance", "rank")
    return points.select(key, *at).join(lists, at).select(key, name, "distance", "rank")


#: Metres around water in which no facility may stand.
WATER_BUFFER = 50.0


def in_buffer(points: DataFrame, features: DataFrame, radius: float = WATER_BUFFER, key: str = "point_id") -> DataFrame:
    """Each point with the distance of the nearest feature's centre closer than ``radius``, null where none is, and whether one is."""
    near = radius_pairs(points.select("lon", "lat").distinct(), features.select("lon_2", "lat_2").distinct(), radius).filter(F.col("distance") < radius)
    least = near.groupBy("lon", "lat").agg(F.min("distance").alias("distance"))
    return points.select(key, "lon", "lat").join(least, ["lon", "lat"], "left").select(key, "distance", F.col("distance").isNotNull().alias("in_buffer"))


#: How far beyond the circle of a travel time a probe stands (a fixed value).
PROBE = 1.2


def sampled_boundaries(centres: DataFrame, routes: DataFrame, minutes: float, mode: str, points: int = 36, key: str = "centre_id") -> DataFrame:
    """(key, radius, ring): where one gets from each centre (key, lon, lat) in a time, probed by bearing.

    Probes stand ``PROBE`` times the radius away, bearing k at k / ``points`` of a turn. ``routes``
    (key, bearing, duration_s) tell how long each takes: one that is reached in time is a corner,
    a longer one is scaled back by time over duration, and a probe without a route (or of no
    duration known) falls back to the circle itself. A centre's ring is closed, by bearing.
    """
    radius = F.lit(minutes / 60.0 * SPEED_KMH[mode] * 1000)
    probes = centres.select(key, "lon", "lat").withColumn("bearing", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    r = routes.select(key, "bearing", F.col("duration_s").cast("double").alias("_s")).groupBy(key, "bearing").agg(F.min("_s").alias("_s"))
    known = probes.join(r, [key, "bearing"], "left")
    share = F.when(F.col("_s").isNull(), 1.0 / PROBE).when(F.col("_s") / 60.0 <= minutes, 1.0).otherwise(minutes / F.nullif(F.col("_s") / 60.0, F.lit(0.0)))
    far, angle = radius * PROBE * share, F.col("bearing") * (2 * math.pi / points)
    corner = F.array(F.col("lon") + far * F.cos(angle) / geo.METRES_LON, F.col("lat") + far * F.sin(angle) / geo.METRES_LAT)
    corners = F.array_sort(F.collect_list(F.struct("bearing", corner.alias("p"))))  # ``points`` of them
    rings = known.groupBy(key).agg(F.transform(corners, lambda c: c["p"]).alias("ring"))
    return rings.select(key, F.round(radius, 2).alias("radius"), geo.close_ring(F.col("ring")).alias("ring"))


def zone_coverage(zones: DataFrame, pois: DataFrame, hits: DataFrame, zone: str, poi: str, shown: int = 20) -> DataFrame:
    """(zone, total_in_zone, coverage_rate, shown): points of interest in each zone, their share of all, and the first by key.

    ``hits`` (zone, poi) tell which lie where, as ``shapes.contained`` finds them.
    """
    found = hits.select(zone, poi).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(zone).orderBy(poi)))
    g = found.groupBy(zone).agg(F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.col(poi)))).alias("shown"))
    return _shares(zones.select(zone), g, pois, zone, poi)


def shape_coverage(zones: DataFrame, pois: DataFrame, hits: tuple[DataFrame, DataFrame, DataFrame], zone: str, poi: str, shown: int = 20) -> DataFrame:
    """``zone_coverage`` from the shapes and pairs that ``shapes.contained_shapes`` finds: pairs of keys are never written out."""
    named_p, named_z, pairs = hits
    first = named_p.withColumn("_n", F.row_number().over(Window.partitionBy("shape").orderBy("key"))).where(F.col("_n") <= shown)
    held = named_p.groupBy(F.col("shape").alias("point")).agg(F.count(F.lit(1)).alias("_c"))
    held = held.join(first.groupBy(F.col("shape").alias("point")).agg(F.collect_list("key").alias("_k")), "point")
    # a point has one shape, so those of different shapes are different points
    g = pairs.join(held, "point")
    total = g.groupBy("polygon").agg(F.sum("_c").alias("_c"))
    least = g.select("polygon", F.explode("_k").alias("_k")).withColumn("_n", F.row_number().over(Window.partitionBy("polygon").orderBy("_k"))).where(F.col("_n") <= shown)
    g = total.join(least.groupBy("polygon").agg(F.array_sort(F.collect_list("_k")).alias("shown")), "polygon")
    g = named_z.select(F.col("key").alias(zone), F.col("shape").alias("polygon")).join(g, "polygon").drop("polygon")
    return _shares(zones.select(zone), g, pois, zone, poi)


def _shares(zones: DataFrame, found: DataFrame, pois: DataFrame, zone: str, poi: str) -> DataFrame:
    """All zones with what was found (zone, _c, shown), and its share of all points."""
    total = pois.agg(F.count(F.lit(1)).alias("_all"))
    out = zones.join(found, zone, "left").crossJoin(F.broadcast(total))  # a single row
    n = F.coalesce("_c", F.lit(0))
    rate = F.coalesce(n / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0))
    return out.select(zone, n.alias("total_in_zone"), rate.alias("coverage_rate"), F.coalesce("shown", F.array().cast(f"array<{pois.schema[poi].dataType.simpleString()}>")).alias("shown"))
