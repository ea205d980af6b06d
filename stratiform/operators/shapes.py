"""Joins of points, lines and polygons: covers of cells of several levels meet, exact tests follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratiform.functions import geo
from stratiform.operators import alike, overlay as O
from stratiform.settle import settled

#: Cells of level L are 2 ** L wide. Shapes smaller than 2 ** FINEST count as that small.
FINEST = -24
#: Metres of a degree in distances between points and lines (a fixed value of the rules).
METRES_PER_DEGREE = 111000.0


def segments(shapes: DataFrame, key: str, lines: str = "rings", closed: bool = False) -> DataFrame:
    """Segments (key, x1, y1, x2, y2) of arrays of lines of [x, y]; a line of one point gives itself as one.

    With ``closed`` the lines are rings, closed where they are not. Null shapes, and points with a
    coordinate that is null or not finite, give none.
    """
    line = shapes.select(F.col(key).alias("key"), F.explode(lines).alias("line")).where(F.size("line") > 0)
    if closed:
        line = line.withColumn("line", geo.close_ring(F.col("line")))
    n = F.size("line") - 1
    pairs = F.arrays_zip(F.slice("line", F.lit(1), F.greatest(n, F.lit(1))).alias("p"), F.when(n > 0, F.slice("line", F.lit(2), n)).otherwise(F.col("line")).alias("q"))
    s = line.withColumn("s", F.explode(pairs)).select("key", *[F.col(f"s.{e}")[i].cast("double").alias(f"{c}{k}") for k, e in ((1, "p"), (2, "q")) for i, c in enumerate("xy")])
    return s.where(F.abs(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2")) < float("inf"))


def level_of(extent: Column) -> Column:
    """The level whose cells are at least as wide as ``extent``."""
    return F.greatest(F.lit(FINEST), F.ceil(F.log2(F.greatest(extent, F.lit(2.0**FINEST)))).cast("int"))


def number(value: Column, level: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), -level)).cast("long")


def box_cells(rows: DataFrame, level: Column, box: Sequence[tuple[str, str]], names: Sequence[str]) -> DataFrame:
    """Rows with the cells of ``level`` that their box touches: columns ``level`` and ``names``."""
    out = rows.withColumn("level", level)
    for (lo, hi), name in zip(box, names):
        out = out.withColumn(name, F.explode(F.sequence(number(F.col(lo), F.col("level")), number(F.col(hi), F.col("level")))))
    return out


def _levels(rows: DataFrame) -> list[int]:
    """Levels in use: some tens at most, as they are powers of two of an extent."""
    return sorted(r["own"] for r in rows.select("own").distinct().collect())


def _boxed(s: DataFrame) -> DataFrame:
    out = s.withColumns({"bx1": F.least("x1", "x2"), "bx2": F.greatest("x1", "x2"), "by1": F.least("y1", "y2"), "by2": F.greatest("y1", "y2")})
    return out.withColumn("own", level_of(F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"))))


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxed rows whose boxes touch, by an equi-join on cells of the coarser of both levels.

    A box touches four cells of its own level at most and one to four of each coarser level that
    the other side uses, so rows are repeated by the number of levels, whatever their number.
    """
    box, names = [("bx1", "bx2"), ("by1", "by2")], ["cx", "cy"]
    levels_a, levels_b = _levels(a), _levels(b)
    pick = lambda levels, least: F.explode(F.filter(F.array(*map(F.lit, levels)), least))
    ren = lambda df, p: df.select("level", *names, *[F.col(c).alias(f"{p}_{c}") for c in a.columns if c != "own"])
    if not levels_a or not levels_b:
        return ren(box_cells(a, F.col("own"), box, names), "a").join(ren(box_cells(b, F.col("own"), box, names), "b"), ["level", *names]).drop("level", *names)
    own_a = box_cells(a, F.col("own"), box, names)
    all_b = box_cells(b, pick(levels_a, lambda v: v >= F.col("own")), box, names)
    own_b = box_cells(b, F.col("own"), box, names)
    up_a = box_cells(a, pick(levels_b, lambda v: v > F.col("own")), box, names)
    pairs = ren(own_a, "a").join(ren(all_b, "b"), ["level", *names]).unionByName(ren(up_a, "a").join(ren(own_b, "b"), ["level", *names]))
    return pairs.drop("level", *names).where("a_bx1 <= b_bx2 and b_bx1 <= a_bx2 and a_by1 <= b_by2 and b_by1 <= a_by2")


def _turn(p: str, q: str, r: str) -> Column:
    """Twice the signed area of three points, named by prefix and number."""
    x, y = lambda e: F.col(e[:-1] + "x" + e[-1]), lambda e: F.col(e[:-1] + "y" + e[-1])
    return (x(q) - x(p)) * (y(r) - y(p)) - (y(q) - y(p)) * (x(r) - x(p))


def meet() -> Column:
    """Whether the segments a and b of a pair share a point, ends included."""
    d1, d2 = _turn("b_1", "b_2", "a_1"), _turn("b_1", "b_2", "a_2")
    d3, d4 = _turn("a_1", "a_2", "b_1"), _turn("a_1", "a_2", "b_2")
    # boxes touch already: what is left is that neither lies to one side of the other's line
    return (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)


def touching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (a, b) of shapes of which a segment of one meets a segment of the other."""
    pairs = _meeting(_boxed(a), _boxed(b)).where(meet())
    return pairs.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()


def contained(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(point, polygon) of all points (point, x, y) inside of polygons: an odd number of edges lies above.

    Points first meet polygons by the cells of their boxes, then only those edges whose heights
    enclose the point's, again by cells. A row of ``polygons`` is a part, and a key with several
    rows is their union; a name with several points is inside where one of them is. Points on an
    edge count for one side of it. Points of the same places, and polygons of the same rings, are
    tested as one: only the result is as long as their pairs.
    """
    named_p, named_s, found = contained_shapes(points, polygons, key, rings)
    return alike.expanded(alike.expanded(found, named_p, "point"), named_s, "polygon")


def contained_shapes(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``contained`` by shapes: the shapes of points and polygons (key, shape), and the pairs of shapes (point, polygon)."""
    points, polygons = points.where("x is not null and y is not null"), polygons.where(F.col(rings).isNotNull())
    named_p, named_s = alike.members(points, "point", "x", "y"), alike.members(polygons, key, rings)
    p = alike.content(points, named_p, "point", "x", "y").withColumnRenamed("shape", "point")
    return named_p, named_s, _contained(p, alike.content(polygons, named_s, key, rings), "shape", rings)


def _contained(p: DataFrame, polygons: DataFrame, key: str, rings: str) -> DataFrame:
    parts = polygons.select(F.col(key).alias("polygon"), F.xxhash64(F.to_json(rings)).alias("part"), F.col(rings).alias("rings")).where("rings is not null").distinct()
    edge = segments(parts.withColumn("name", F.struct("polygon", "part")), "name", "rings", closed=True)
    edge = edge.select("key.polygon", "key.part", "x1", "y1", "x2", "y2").where("y1 <> y2")
    box = edge.groupBy("polygon", "part").agg(F.min(F.least("x1", "x2")).alias("bx1"), F.max(F.greatest("x1", "x2")).alias("bx2"), F.min(F.least("y1", "y2")).alias("by1"), F.max(F.greatest("y1", "y2")).alias("by2"))
    box = box.withColumn("own", level_of(F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"))))
    levels = _levels(box)
    edge = edge.withColumns({"by1": F.least("y1", "y2"), "by2": F.greatest("y1", "y2")}).withColumn("own", level_of(F.col("by2") - F.col("by1")))
    heights = _levels(edge)
    at = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    at = at.withColumns({"cx": number(F.col("x"), F.col("level")), "cy": number(F.col("y"), F.col("level"))})
    cells = box_cells(box, F.col("own"), [("bx1", "bx2"), ("by1", "by2")], ["cx", "cy"]).drop("own")
    near = at.join(cells, ["level", "cx", "cy"]).where("x between bx1 and bx2 and y between by1 and by2").select("point", "x", "y", "polygon", "part")
    near = near.withColumn("level", F.explode(F.array(*map(F.lit, heights)).cast("array<int>"))).withColumn("cy", number(F.col("y"), F.col("level")))
    band = box_cells(edge, F.col("own"), [("by1", "by2")], ["cy"]).select("polygon", "part", "level", "cy", "x1", "y1", "x2", "y2")
    hit = near.join(band, ["polygon", "part", "level", "cy"])
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = hit.where(crosses).groupBy("point", "x", "y", "polygon", "part").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return odd.select("point", "polygon").distinct()


def _corners(shapes: DataFrame, key: str, lines: str) -> DataFrame:
    """The first point of each line or ring: where no edges meet, it tells where all of it is."""
    line = shapes.select(F.col(key).alias("point"), F.explode(lines).alias("line")).where(F.size("line") > 0)
    return line.select("point", F.col("line")[0][0].alias("x"), F.col("line")[0][1].alias("y")).distinct()


def intersects(a: DataFrame, b: DataFrame, key_a: str, key_b: str, filled_a: bool = True, filled_b: bool = True, shape: str = "rings") -> DataFrame:
    """Distinct (a, b) of shapes that share a point; borders belong to shapes.

    ``filled`` shapes are polygons (rings, even-odd), others lines or points. Either some segments
    meet, or one shape lies inside the other. Rows of equal key are one shape; empty and null
    shapes meet nothing. Equal shapes are tested as one and stand for their keys in the result.
    """
    a, b = a.where(F.col(shape).isNotNull()), b.where(F.col(shape).isNotNull())
    named_a, named_b = alike.members(a, key_a, shape), alike.members(b, key_b, shape)
    a, b = alike.content(a, named_a, key_a, shape), alike.content(b, named_b, key_b, shape)
    pairs = touching(segments(a, "shape", shape, closed=filled_a), segments(b, "shape", shape, closed=filled_b))
    if filled_b:
        pairs = pairs.unionByName(_contained(_corners(a, "shape", shape), b, "shape", shape).toDF("a", "b"))
    if filled_a:
        pairs = pairs.unionByName(_contained(_corners(b, "shape", shape), a, "shape", shape).toDF("b", "a").select("a", "b"))
    return alike.expanded(alike.expanded(pairs.distinct(), named_a, "a"), named_b, "b")


def within(a: DataFrame, b: DataFrame, key_a: str, key_b: str, shape: str = "rings", slack: float = 1e-9) -> DataFrame:
    """Distinct (a, b) of polygons a that lie in one polygon b, borders included.

    The overlay of both layers decides: b must cover the area of a but for the share ``slack``,
    which is for rounding. Polygons without area lie in none.
    """
    (named_a, left), (named_b, right) = O.by_shape(a, key_a, shape), O.by_shape(b, key_b, shape)
    own = O.areas(O.dissolve(left, "shape"), "a").select("a", F.col("area").alias("whole"))
    shared = O.areas(O.shared_pieces(left, right, "intersection", O.PER_STRIP), "a", "b")
    held = shared.join(own, "a").where(F.col("area") >= F.col("whole") * (1 - slack)).select("a", "b")
    return alike.expanded(alike.expanded(held, named_a, "a"), named_b, "b")


def to_segment(x: str = "x", y: str = "y") -> Column:
    """Distance in the plane between a point and the segment of its row."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / square))).otherwise(F.lit(0.0))
    return F.hypot(F.col(x) - F.col("x1") - t * dx, F.col(y) - F.col("y1") - t * dy)


def nearest_of(points: DataFrame, key: str, at: Sequence[str], targets: DataFrame, name: str, box: Sequence[tuple[str, str]], distance: Column, on: Sequence[str] = ()) -> DataFrame:
    """The nearest target of every point, however far: (key, name, distance), ties by name.

    ``at`` are a point's coordinates, ``box`` the columns of the least and greatest ones of a
    target, and ``distance`` a metric of a joined row that is never below the largest difference
    of a coordinate. Only targets that agree in ``on`` count; points without any have no row.

    Each point takes the finest level at which a target's box touches its cell or a neighbour of
    it, measures the targets there, and where the least distance found passes the cells' width
    looks once more at the level as wide as it: what is nearer touches a neighbour there. So no
    point meets all targets, and none is left out. Levels start at the mean spacing of targets.
    Points of one place look once, and of targets that differ in ``name`` only the first is met.
    """
    spot = F.struct(*on, *at)
    places = points.where(" and ".join(f"{c} is not null" for c in at)).select(spot.alias("_spot"), *on, *at).distinct()
    rest = [c for c in targets.columns if c != name]
    near = _nearest_spots(places, "_spot", at, targets.groupBy(*rest).agg(F.min(name).alias(name)), name, box, distance, on)
    found = points.select(key, spot.alias("_spot")).join(near, "_spot")
    best = found.groupBy(key).agg(F.min(F.struct("distance", name)).alias("_b"))
    return best.select(key, F.col(f"_b.{name}").alias(name), F.col("_b.distance").alias("distance"))


def _nearest_spots(points: DataFrame, key: str, at: Sequence[str], targets: DataFrame, name: str, box: Sequence[tuple[str, str]], distance: Column, on: Sequence[str]) -> DataFrame:
    """``nearest_of`` for points and targets that are all different."""
    names = [f"_c{i}" for i in range(len(at))]
    points = points.select(key, *on, *at).where(" and ".join(f"{c} is not null" for c in at))
    targets = targets.where(" and ".join(f"{lo} is not null and {hi} is not null" for lo, hi in box))
    sides = targets.agg(F.count(F.lit(1)).alias("n"), *[F.min(lo).alias(f"lo{i}") for i, (lo, _) in enumerate(box)], *[F.max(hi).alias(f"hi{i}") for i, (_, hi) in enumerate(box)], F.avg(F.greatest(F.lit(0.0), *[F.col(hi) - F.col(lo) for lo, hi in box])).alias("mean")).first()
    own = points.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(at)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(at)]).first()
    empty = points.join(targets.limit(0).select(name, *on, *[c for b in box for c in b]), list(on)) if on else points.join(targets.limit(0).select(name, *[c for b in box for c in b]), F.lit(True))
    if not sides["n"] or own["lo0"] is None:
        return empty.select(key, name, F.lit(0.0).alias("distance"))
    lows = [min(sides[f"lo{i}"], own[f"lo{i}"]) for i in range(len(at))]
    extent = max(max(sides[f"hi{i}"], own[f"hi{i}"]) - lows[i] for i in range(len(at)))
    spacing = extent / max(1.0, sides["n"] ** (1 / len(at)))
    level = lambda v: max(FINEST, int(v.hex().split("p")[1]) + 1) if v > 0 else FINEST
    first, last = level(max(spacing, sides["mean"])), level(extent) + 1
    last = max(first, last)
    levels = list(range(first, last + 1))
    shifted = lambda c: F.call_function("shiftright", F.col(c), F.col("level") - F.lit(first))
    base = [number(F.col(c), F.lit(first)).alias(n) for c, n in zip(at, names)]
    spread = lambda df: df.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).select(*on, "level", *[shifted(n).alias(n) for n in names]).distinct()

    def around(df: DataFrame) -> DataFrame:
        for n in names:
            df = df.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
        return df

    taken = around(spread(box_cells(targets, F.lit(first), box, names).select(*on, *names).distinct())).distinct()
    cells = points.select(*on, *base).distinct()
    where = cells.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).select(*on, "level", *[F.col(n).alias(f"{n}b") for n in names], *[shifted(n).alias(n) for n in names])
    finest = where.join(taken, [*on, "level", *names]).groupBy(*on, *[F.col(f"{n}b").alias(n) for n in names]).agg(F.min("level").alias("level"))
    placed = points.select("*", *base).join(finest, [*on, *names]).select(key, *on, *at, "level")

    def best(rows: DataFrame) -> DataFrame:
        used = sorted(r["level"] for r in rows.select("level").distinct().collect())  # some tens of levels
        hits = around(rows.select("*", *[number(F.col(c), F.col("level")).alias(n) for c, n in zip(at, names)]))
        held = box_cells(targets, F.explode(F.array(*map(F.lit, used)).cast("array<int>")), box, names)
        met = hits.join(held, [*on, "level", *names]).withColumn("distance", distance)
        return met.groupBy(key).agg(F.min(F.struct("distance", name)).alias("_b"), F.any_value(F.struct("level", *on, *at)).alias("_p"))

    near = settled(best(placed))
    wide = F.pow(F.lit(2.0), F.col("_p.level"))
    far = near.where(F.col("_b.distance") > wide).select(key, *[F.col(f"_p.{c}").alias(c) for c in (*on, *at)], level_of(F.col("_b.distance")).alias("level"))
    out = near.where(F.col("_b.distance") <= wide).select(key, "_b").unionByName(best(far).select(key, "_b"))
    return out.select(key, F.col(f"_b.{name}").alias(name), F.col("_b.distance").alias("distance"))


def nearest_segment(points: DataFrame, key: str, lines: DataFrame, name: str, shape: str = "lines") -> DataFrame:
    """The nearest line of every point (key, x, y in degrees) and its distance in metres of a plane degree."""
    s = segments(lines, name, shape).withColumnRenamed("key", name)
    s = s.withColumns({"bx1": F.least("x1", "x2"), "bx2": F.greatest("x1", "x2"), "by1": F.least("y1", "y2"), "by2": F.greatest("y1", "y2")})
    out = nearest_of(points, key, ["x", "y"], s, name, [("bx1", "bx2"), ("by1", "by2")], to_segment())
    return out.withColumn("metres", F.col("distance") * METRES_PER_DEGREE)


def nearest_point(points: DataFrame, key: str, targets: DataFrame, name: str, on: Sequence[str] = ()) -> DataFrame:
    """The nearest target (lon_2, lat_2) of every point (lon, lat) by great-circle metres, however far, ties by name."""

    def space(df: DataFrame, lon: str, lat: str, names: Sequence[str]) -> DataFrame:
        a, b = F.radians(lon), F.radians(lat)
        return df.withColumns(dict(zip(names, (F.cos(b) * F.cos(a) * geo.EARTH, F.cos(b) * F.sin(a) * geo.EARTH, F.sin(b) * geo.EARTH))))

    p = space(points, "lon", "lat", ["px", "py", "pz"])
    t = space(targets.select(name, *on, "lon_2", "lat_2"), "lon_2", "lat_2", ["tx", "ty", "tz"])
    held = p.select(key, *on, "px", "py", "pz")
    # the way along the globe is never shorter than the difference of any coordinate in space
    lon, lat = F.degrees(F.atan2("py", "px")), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pz") / geo.EARTH))))
    metres = geo.haversine(lon, lat, F.col("lon_2"), F.col("lat_2"))
    return nearest_of(held, key, ["px", "py", "pz"], t, name, [("tx", "tx"), ("ty", "ty"), ("tz", "tz")], metres, on)


def offsets(points: DataFrame, key: str, lines: DataFrame, name: str, shape: str = "lines") -> DataFrame:
    """Mean and largest distance between points and their nearest line, and the points' number: one row."""
    near = nearest_segment(points, key, lines, name, shape)
    return near.agg(F.count(F.lit(1)).alias("points"), F.avg("metres").alias("average_offset_m"), F.max("metres").alias("largest_offset_m"))


#: Zones that may stand against a place, and how severe that is (fixed values): farmland is, all others less.
SEVERE_ZONE, SEVERE, MODERATE = "farmland", "high", "medium"
#: Metres within which a hazard zone is near.
HAZARD_NEAR = 500.0


def protection_conflicts(points: DataFrame, key: str, zones: DataFrame, zone_id: str, zone_type: str, rings: str = "rings") -> DataFrame:
    """Each point (key, x, y) with the types of protection zone that hold it: in_protected_zone and conflicts.

    ``conflicts`` lists (zone_type, severity) by type, empty where no zone holds the point.
    """
    named_p, named_z, hit = contained_shapes(points.select(F.col(key).alias("point"), "x", "y"), zones, zone_id, rings)
    kinds = alike.expanded(named_z.select(F.col("shape").alias("polygon"), F.col("key").alias("zone")), zones.select(F.col(zone_id).alias("shape"), F.col(zone_type).alias("key")), "zone")
    kinds = kinds.select("polygon", F.col("zone").alias("zone_type")).distinct()
    severity = F.when(F.col("zone_type") == SEVERE_ZONE, SEVERE).otherwise(MODERATE)
    found = hit.join(kinds, "polygon").select("point", "zone_type").distinct().groupBy("point").agg(F.array_sort(F.collect_list(F.struct("zone_type", severity.alias("severity")))).alias("conflicts"))
    found = alike.expanded(found, named_p, "point")
    out = points.join(found, points[key] == found["point"], "left").drop("point")
    none = F.array().cast("array<struct<zone_type:string,severity:string>>")
    return out.withColumn("in_protected_zone", F.col("conflicts").isNotNull()).withColumn("conflicts", F.coalesce("conflicts", none))


def hazard_state(points: DataFrame, key: str, zones: DataFrame, zone_id: str, rings: str = "rings", near: float = HAZARD_NEAR) -> DataFrame:
    """Each point (key, x, y) with whether a hazard zone holds it, and else whether one is within ``near`` metres."""
    p = points.select(F.col(key).alias("point"), "x", "y")
    named, _, hit = contained_shapes(p, zones, zone_id, rings)
    inside = alike.expanded(hit.select("point").distinct(), named, "point").withColumn("_in", F.lit(True))
    border = nearest_segment(p, "point", zones.select(zone_id, F.transform(rings, geo.close_ring).alias("lines")), zone_id)
    out = p.join(inside, "point", "left").join(border.select("point", F.col("metres").alias("_m")), "point", "left")
    inside_zone = F.coalesce("_in", F.lit(False))
    return out.select(F.col("point").alias(key), inside_zone.alias("in_hazard_zone"), (~inside_zone & F.coalesce(F.col("_m") <= near, F.lit(False))).alias("near_hazard_zone"))
