"""Answers of map providers as typed rows: points of interest, routes, road edges, traffic, centres and advice.

Answers come as JSON or XML text, one a row. Text that cannot be read, absent fields and coordinates that are no
numbers give the defaults named at each function; nothing fails and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratiform.functions import geo
from stratiform.functions.text import ADDRESS

# Labels of traffic states and of the shares of roads in each, classes of roads.
NO_DATA = "无数据"
TRAFFIC = {1: "畅通", 2: "缓行", 3: "拥堵", 4: "严重拥堵", 5: NO_DATA}
SHARES = {"excellent": "畅通", "congested": "缓行", "blocked": "拥堵", "seriousBlocked": "严重拥堵"}
HIGHWAYS = {
    "motorway": "高速公路", "motorway_link": "高速连接线", "trunk": "主干道", "trunk_link": "主干道连接线",
    "primary": "一级公路（国道级）", "primary_link": "一级公路连接线", "secondary": "二级公路（省道级）", "secondary_link": "二级公路连接线",
    "tertiary": "三级公路（县道级）", "tertiary_link": "三级公路连接线", "residential": "居民区道路（村内道路）", "unclassified": "未分类道路（村道）",
    "track": "农/林道路（田野道路）", "service": "服务道路", "living_street": "生活街道", "pedestrian": "步行街", "path": "小路",
    "footway": "人行道", "cycleway": "自行车道", "bridleway": "马道", "steps": "台阶",
}
# Places of the three probed routes in a grid of 3 x 3 corners, degrees of a kilometre, zones with water.
PROBES = [(0, 2), (0, 6), (2, 6)]
KM_PER_DEGREE = 111.0
WATER = ["water_body", "river", "wetland"]
_STEP = "struct<polyline:string,instruction:string,road:string,distance:string,duration:string>"
_POI = "id string, name string, location string, address string, pname string, cityname string, adname string, distance string, type string, typecode string, tel string"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _whole(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def polyline(text: Column) -> Column:
    """Points of ``x,y;x,y``; pairs without two numbers are left out."""
    pair = F.transform(F.split(_text(text), ";"), lambda p: F.transform(F.slice(F.split(p, ","), 1, 2), lambda v: v.try_cast("double")))
    return F.filter(pair, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()))


def wgs(points: Column) -> Column:
    """Points of the shifted datum in the common one."""
    return F.transform(points, lambda p: F.array(*geo.gcj_to_wgs(p[0], p[1])))


def route_steps(steps: Column) -> Column:
    """struct(coords, steps) of a JSON list of steps: all their points in order, and instruction, road, metres and seconds of each."""
    s = F.coalesce(F.from_json(steps, f"array<{_STEP}>"), F.array().cast(f"array<{_STEP}>"))
    told = F.transform(s, lambda x: F.struct(_text(x["instruction"]).alias("instruction"), _text(x["road"]).alias("road"), _whole(x["distance"]).alias("distance"), _whole(x["duration"]).alias("duration")))
    return F.struct(F.flatten(F.transform(s, lambda x: wgs(polyline(x["polyline"])))).alias("coords"), told.alias("steps"))


def route_xml(xml: Column) -> Column:
    """struct(distance metres, duration seconds, coords) of an XML answer in kilometres; 0 and empty where absent, null if unreadable."""
    x = F.from_xml(xml, "distance string, duration string, routelatlon string", {"mode": "PERMISSIVE"})
    number = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    out = F.struct((number(x["distance"]) * 1000).alias("distance"), number(x["duration"]).alias("duration"), polyline(F.trim(x["routelatlon"])).alias("coords"))
    return F.when(F.trim(xml).rlike(r"(?s)^<.*>$"), out)


def unified_pois(first: DataFrame, second: DataFrame, key: str, poi: str) -> DataFrame:
    """(key, provider, id, name, lon, lat, lon_gcj02, lat_gcj02, address, distance, category, typecode, tel) of two providers' answers.

    The first gives ``location`` in the shifted datum, turned into the common one and kept beside it; the
    second gives ``lonlat`` and fewer fields: those it lacks are null. Missing coordinates are 0.
    """
    p, q = F.from_json(poi, _POI), F.from_json(poi, "name string, lonlat string, address string, typeName string")
    at = F.get(polyline(p["location"]), F.lit(0))
    lon, lat = geo.gcj_to_wgs(at[0], at[1])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    place = F.concat(_text(p["pname"]), _text(p["cityname"]), _text(p["adname"]))
    a = first.select(
        key, F.lit("first").alias("provider"), _text(p["id"]).alias("id"), _text(p["name"]).alias("name"), zero(lon).alias("lon"), zero(lat).alias("lat"), zero(at[0]).alias("lon_gcj02"), zero(at[1]).alias("lat_gcj02"),
        F.coalesce(F.nullif(p["address"], F.lit("")), place).alias("address"), _whole(p["distance"]).alias("distance"), _text(p["type"]).alias("category"), _text(p["typecode"]).alias("typecode"), _text(p["tel"]).alias("tel"),
    )
    to = F.split(_text(q["lonlat"]), ",")
    b = second.select(
        key, F.lit("second").alias("provider"), _text(q["name"]).alias("name"), zero(F.get(to, F.lit(0)).try_cast("double")).alias("lon"), zero(F.get(to, F.lit(1)).try_cast("double")).alias("lat"),
        _text(q["address"]).alias("address"), _text(q["typeName"]).alias("category"),
    )
    return a.unionByName(b, allowMissingColumns=True)


def _first_text(edge: Column, field: str) -> Column:
    """A field that holds a text or a list of texts: the text, or the first of the list; null for all else."""
    v = F.try_variant_get(edge, f"$.{field}", "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$[0]", "string"))


def edge_features(edges: DataFrame, key: str, node: str, edge: str) -> DataFrame:
    """(key, osm_id, highway, highway_desc, name, length, source) of road edges given as JSON with texts or lists of texts.

    ``osm_id`` is the edge's first node; a road of no class is ``unknown``, one of an unlisted class describes itself.
    """
    e = F.try_parse_json(edge)
    highway = F.coalesce(_first_text(e, "highway"), F.lit("unknown"))
    length = F.coalesce(F.nanvl(F.try_variant_get(e, "$.length", "double"), F.lit(0.0)), F.lit(0.0))
    return edges.select(key, F.col(node).alias("osm_id"), highway.alias("highway"), F.coalesce(F.try_element_at(_map(HIGHWAYS), highway), highway).alias("highway_desc"), _text(_first_text(e, "name")).alias("name"), length.alias("length"), F.lit("osm").alias("source"))


def _status(v: Column) -> Column:
    """Label of a state given as an integer; a state given as a text, an unknown or absent one is no data."""
    whole = F.when(F.schema_of_variant(F.try_variant_get(v, "$.status", "variant")) == "BIGINT", F.try_variant_get(v, "$.status", "int"))
    return F.coalesce(F.try_element_at(_map(TRAFFIC), whole), F.lit(NO_DATA))


def traffic_evaluation(info: Column) -> Column:
    """struct(description, status, shares): shares by label, texts that are no whole numbers count 0."""
    e = F.try_variant_get(F.try_parse_json(info), "$.evaluation", "variant")

    def share(field: str) -> Column:
        v = F.try_variant_get(e, f"$.{field}", "variant")
        text = F.try_variant_get(v, "$", "string")
        whole = F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$", "double")).when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("double"))
        return F.coalesce(whole, F.lit(0.0))

    shares = F.create_map(*[x for field, label in SHARES.items() for x in (F.lit(label), share(field))])
    return F.struct(_text(F.try_variant_get(e, "$.description", "string")).alias("description"), _status(e).alias("status"), shares.alias("shares"))


def traffic_roads(roads: Column) -> Column:
    """Roads of a JSON list: name, status, direction, angle, speed, lcodes and coords, null for a road without a line."""
    v = F.coalesce(F.try_variant_get(F.try_parse_json(roads), "$", "array<variant>"), F.array().cast("array<variant>"))

    def road(r: Column) -> Column:
        text = lambda n: _text(F.try_variant_get(r, f"$.{n}", "string"))
        line = text("polyline")
        return F.struct(text("name").alias("name"), _status(r).alias("status"), text("direction").alias("direction"), text("angle").alias("angle"), _whole(text("speed")).alias("speed"), text("lcodes").alias("lcodes"), F.when(line != "", polyline(line)).alias("coords"))

    return F.transform(v, road)


def vertices(geometry: Column) -> Column:
    """All points of a GeoJSON geometry in order, holes and parts included; empty for an unknown type."""
    v = F.try_parse_json(geometry)
    kind, empty = F.try_variant_get(v, "$.type", "string"), F.array().cast("array<array<double>>")
    at = lambda depth: F.try_variant_get(v, "$.coordinates", "array<" * depth + "double" + ">" * depth)
    points = F.when(kind == "Point", F.array(at(1))).when(kind.isin("LineString", "MultiPoint"), at(2)).when(kind.isin("Polygon", "MultiLineString"), F.flatten(at(3))).when(kind == "MultiPolygon", F.flatten(F.flatten(at(4))))
    return F.coalesce(F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.slice(p, 1, 2)), empty)


def located_centres(places: DataFrame, geocodes: DataFrame, pois: DataFrame, counties: DataFrame, key: str) -> DataFrame:
    """(key, lon, lat, strategy, error): the centre of each address (key, location) by the first way that finds it.

    ``geocodes`` (location, lon, lat), then the first of ``pois`` (region, name, pos, lon, lat) named like
    the village in its county, then the county's centre in ``counties`` (county, lon, lat). An address
    without a village has no strategy; ``failed`` where none finds it.
    """
    part = lambda name: F.regexp_extract(_text(F.col("location")), ADDRESS[name], 1)
    base = places.select(key, "location", part("village").alias("_village"), part("county").alias("_county"))
    once = lambda df, by, order: df.groupBy(*by).agg(F.min_by(F.struct("lon", "lat"), order).alias("_at"))
    g = once(geocodes, ["location"], F.struct("lon", "lat")).withColumnRenamed("_at", "_geo")
    p = once(pois, ["region", "name"], F.struct("pos", "lon", "lat")).select(F.col("region").alias("_county"), F.col("name").alias("_village"), F.col("_at").alias("_poi"))
    c = once(counties, ["county"], F.struct("lon", "lat")).select(F.col("county").alias("_county"), F.col("_at").alias("_ref"))
    out = base.join(g, "location", "left").join(p, ["_county", "_village"], "left").join(c, "_county", "left")
    village = F.col("_village") != ""
    at = F.when(village, F.coalesce("_geo", "_poi", "_ref"))
    strategy = F.when(~village, None).when(F.col("_geo").isNotNull(), "geocode").when(F.col("_poi").isNotNull(), "poi_search").when(F.col("_ref").isNotNull(), "county_fallback").otherwise("failed")
    error = F.when(~village, "未检测到村级地址").when(at.isNull(), "无法定位村级中心")
    return out.select(key, at["lon"].alias("lon"), at["lat"].alias("lat"), strategy.alias("strategy"), error.alias("error"))


def probe_routes(centres: DataFrame, key: str, km: float = 5.0) -> DataFrame:
    """(key, route_id, o_lon, o_lat, d_lon, d_lat): routes to ask for between corners of a grid around each centre (key, lon, lat)."""
    d = km / KM_PER_DEGREE
    corner = lambda i: (F.col("lon") + F.lit((i // 3 - 1) * d), F.col("lat") + F.lit((i % 3 - 1) * d))
    probe = lambda n, a, b: F.struct(F.lit(n).alias("route_id"), *[c.alias(name) for c, name in zip((*corner(a), *corner(b)), ("o_lon", "o_lat", "d_lon", "d_lat"))])
    return centres.select(key, F.inline(F.array(*[probe(n, a, b) for n, (a, b) in enumerate(PROBES)])))


def routed_network(answers: DataFrame, key: str) -> DataFrame:
    """(key, route_count, total_distance_m, unique_coords) of answered probes (key, route_id, distance, coords), null coords: no route."""
    kept = answers.where(F.col("coords").isNotNull())
    routes = kept.groupBy(key).agg(F.count("*").alias("route_count"), F.sum(F.coalesce("distance", F.lit(0.0))).alias("total_distance_m"))
    points = kept.select(key, F.explode("coords").alias("_p")).distinct().groupBy(key).agg(F.count("*").alias("unique_coords"))
    out = answers.select(key).distinct().join(routes, key, "left").join(points, key, "left")
    return out.fillna({"route_count": 0, "total_distance_m": 0.0, "unique_coords": 0})


def gap_advice(kind: Column, rate: Column, gaps: Column) -> Column:
    """Advice on a coverage rate and on the first of the farthest gaps (gap_m, coordinates); empty where there is none to give."""
    share = F.format_string("%.1f%%", rate * 100)
    low = F.concat(F.lit("Coverage rate ("), share, F.lit(") is below 50%. Consider adding new "), kind, F.lit(" facilities."))
    fair = F.concat(F.lit("Coverage rate ("), share, F.lit(") needs improvement. Review facility locations for better coverage."))
    gap = lambda g: F.coalesce(g["gap_m"], F.lit(0.0))
    most = F.array_max(F.transform(gaps, gap))
    far = F.get(F.filter(gaps, lambda g: gap(g) == most), F.lit(0))
    where = F.concat(F.lit("["), F.array_join(F.transform(far["coordinates"], lambda v: v.cast("string")), ", "), F.lit("]"))
    farthest = F.concat(F.lit("Farthest uncovered point is "), F.format_string("%.0fm", gap(far)), F.lit(" outside service radius. Consider facility at coordinates "), F.coalesce(where, F.lit("[]")), F.lit("."))
    return F.array_compact(F.array(F.when(rate < 0.5, low).when(rate < 0.8, fair), F.when(F.size(gaps) > 0, farthest)))


def ecological_advice(sensitivity: Column, zones: Column) -> Column:
    """Advice on a sensitivity class, then on each zone (zone_type, buffer_distance_m) with water."""
    high = "Study area has high ecological sensitivity. Limit development to low-impact activities. Establish comprehensive protection zones."
    fair = "Study area requires careful planning. Avoid development in identified sensitive zones. Implement mitigation measures for buffer areas."
    rest = "Study area has acceptable sensitivity level. Standard planning constraints apply."
    head = F.when(sensitivity == "Highly Sensitive", high).when(sensitivity == "Moderately Sensitive", fair).otherwise(rest)
    buffer = lambda z: F.concat(F.lit("Establish "), F.coalesce(z["buffer_distance_m"], F.lit(0)).cast("string"), F.lit("m protection buffer for "), z["zone_type"], F.lit(". Prohibit construction and pollution sources within buffer."))
    return F.concat(F.array(head), F.coalesce(F.transform(F.filter(zones, lambda z: z["zone_type"].isin(WATER)), buffer), F.array().cast("array<string>")))
