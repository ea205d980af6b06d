"""Overlay, dissolve and buffers of polygons: a plane sweep in strips, whose pieces add up."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratiform.functions import geo
from stratiform.operators import alike

#: The plane is turned by this angle (radians) first, so that no edge of usual data is upright in it.
ANGLE = 0.5772156649015329
#: Edges that a strip should hold: a sweep compares all pairs of them.
PER_STRIP = 128
#: Tasks that share the strips, at most.
MOST_TASKS = 2000
#: Heights and widths below this share of the largest coordinate are rounding, not area.
NOISE = 1e-12
MODES = ("intersection", "difference", "symmetric_difference", "union", "clip", "dissolve")

Keys = Callable[[Iterable, Iterable], list[tuple]]


def _keys(how: str) -> Keys:
    """What a place covered by the features ``a`` and ``b`` belongs to."""
    both = lambda a, b: [(x, y) for x in a for y in b]
    left = lambda a, b: [] if b else [(x, None) for x in a]
    right = lambda a, b: [] if a else [(None, y) for y in b]
    return {
        "intersection": both,
        "difference": left,
        "symmetric_difference": lambda a, b: left(a, b) + right(a, b),
        "union": lambda a, b: both(a, b) + left(a, b) + right(a, b),
        "clip": lambda a, b: [(x, None) for x in a] if b else [],
        "dissolve": lambda a, b: [(x, None) for x in a],
    }[how]


def crossings(u1: np.ndarray, v1: np.ndarray, u2: np.ndarray, v2: np.ndarray, block: int = 512) -> np.ndarray:
    """The u of all points where two edges cross, block by block."""
    out = []
    du, dv = u2 - u1, v2 - v1
    for at in range(0, len(u1), block):
        s = slice(at, at + block)
        det = du[s, None] * dv - dv[s, None] * du
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((u1 - u1[s, None]) * dv - (v1 - v1[s, None]) * du) / det
            r = ((u1 - u1[s, None]) * dv[s, None] - (v1 - v1[s, None]) * du[s, None]) / det
        i, j = np.nonzero((t > 0) & (t < 1) & (r > 0) & (r < 1))
        later = j > i + at
        out.append(u1[at + i[later]] + t[i[later], j[later]] * du[at + i[later]])
    return np.concatenate(out) if out else np.zeros(0)


def sweep(layer: list[int], key: list, part: list, u1: np.ndarray, v1: np.ndarray, u2: np.ndarray, v2: np.ndarray, lo: float, hi: float, keys: Keys) -> list[tuple]:
    """Trapezoids (a, b, left, right, four heights) of a strip's regions.

    Between two neighbouring ends or crossings of edges none of them cross, so sorting them by
    height there and toggling the parts they bound, from below, tells what covers each gap. A key
    is covered where one of its parts is. A gap that goes on between the same edges is one piece.
    """
    noise = NOISE * max(1e-300, *(float(np.abs(x).max()) for x in (u1, v1, u2, v2)))
    slope = (v2 - v1) / (u2 - u1)
    a, b = np.maximum(u1, lo), np.minimum(u2, hi)
    x = crossings(u1, v1, u2, v2)
    x = np.unique(np.concatenate([a[a < b], b[a < b], x[(x > lo) & (x < hi)]]))
    left, right = x[:-1], x[1:]
    wide = right - left > noise
    left, right = left[wide], right[wide]
    owner = list(zip(layer, key, part))
    out: list[tuple] = []
    running: dict[tuple, list[float]] = {}

    def close(name: tuple, span: list[float]) -> None:
        low, high, ka, kb = name
        at = lambda e, u: float(v1[e] + (u - u1[e]) * slope[e])
        out.append((ka, kb, span[0], span[1], at(low, span[0]), at(low, span[1]), at(high, span[0]), at(high, span[1])))

    for first in range(0, len(left), 256):
        x0, x1 = left[first : first + 256], right[first : first + 256]
        slab, edge = np.nonzero((a <= x0[:, None]) & (b >= x1[:, None]))
        height = v1[edge] + ((x0 + x1)[slab] / 2 - u1[edge]) * slope[edge]
        # edges that lie on each other keep their order from slab to slab, so gaps between them go on
        order = np.lexsort((edge, np.round(height / noise), slab))
        slab, edge, height = slab[order].tolist(), edge[order].tolist(), height[order].tolist()
        now, last = None, None
        for s, e, h in zip(slab, edge, height):
            if s != now:
                now, last = s, None
                active: set = set()
                counts: list[dict] = [{}, {}]  # only what covers the place: keys that left are taken out
            if last is not None and h - last[1] > noise and active:
                for ka, kb in keys(*counts):
                    name, span = (last[0], e, ka, kb), running.get((last[0], e, ka, kb))
                    if span and span[1] == x0[s]:
                        span[1] = float(x1[s])
                    else:
                        if span:
                            close(name, span)
                        running[name] = [float(x0[s]), float(x1[s])]
            who = owner[e]
            held = counts[who[0]]
            if who in active:
                active.remove(who)
                held[who[1]] -= 1
                if not held[who[1]]:
                    del held[who[1]]
            else:
                active.add(who)
                held[who[1]] = held.get(who[1], 0) + 1
            last = (e, h)
    for name, span in running.items():
        close(name, span)
    return out


def edges(shapes: DataFrame, key: str, rings: str = "rings", part: str | None = None, layer: int = 0) -> DataFrame:
    """Edges (layer, key, part, u1, v1, u2, v2) of polygons in the turned plane, u1 below u2.

    ``rings`` is an array of rings of [x, y], closed or not; what an odd number of rings of a part
    surrounds is inside, so holes need no mark. Null rings, and edges without length or with a
    coordinate that is null or not finite, are left out.
    """
    c, s = math.cos(ANGLE), math.sin(ANGLE)
    turned = lambda p: F.struct((p[0] * c + p[1] * s).alias("u"), (p[1] * c - p[0] * s).alias("v"))
    rows = shapes.select(F.col(key).alias("key"), (F.col(part) if part else F.lit(0)).cast("string").alias("part"), F.explode(rings).alias("ring"))
    rows = rows.where(F.size("ring") > 2).withColumn("ring", F.transform(geo.close_ring(F.col("ring")), turned))
    n = F.size("ring") - 1
    pairs = F.arrays_zip(F.slice("ring", 1, n).alias("p"), F.slice("ring", 2, n).alias("q"))
    e = rows.withColumn("e", F.explode(pairs)).select("key", "part", F.col("e.p").alias("p"), F.col("e.q").alias("q"))
    first, last = F.least("p", "q"), F.greatest("p", "q")
    e = e.select(F.lit(layer).alias("layer"), "key", "part", first["u"].alias("u1"), first["v"].alias("v1"), last["u"].alias("u2"), last["v"].alias("v2"))
    finite = F.abs(F.col("u1") + F.col("v1") + F.col("u2") + F.col("v2")) < float("inf")
    return e.where(finite & (F.col("u1") < F.col("u2")))


def _in_strips(e: DataFrame, per_strip: int) -> tuple[DataFrame | None, int]:
    """Edges with the strips (strip, sub, lo, hi) that they pass, None where there are none, and tasks to share them.

    Strips are as wide as an even spread of edges asks for, but not narrower than a mean edge;
    those that hold more edges than ``per_strip`` are cut again, so dense places share the work.
    """
    got = e.agg(F.min("u1").alias("lo"), F.max("u2").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg(F.col("u2") - F.col("u1")).alias("mean")).first()
    if not got["n"]:
        return None, 1
    lo, width = got["lo"], max((got["hi"] - got["lo"]) * per_strip / got["n"], got["mean"])
    number = lambda u: F.floor((F.col(u) - lo) / width).cast("long")
    passed = e.withColumn("strip", F.explode(F.sequence(number("u1"), number("u2"))))
    counts = passed.groupBy("strip").agg(F.ceil(F.count(F.lit(1)) / per_strip).cast("int").alias("subs"))
    fine = passed.join(counts, "strip")
    place = lambda u: F.floor(((F.col(u) - lo) / width - F.col("strip")) * F.col("subs")).cast("int")
    inside = lambda k: F.greatest(F.lit(0), F.least(k, F.col("subs") - 1))
    fine = fine.withColumn("sub", F.explode(F.sequence(inside(place("u1")), inside(place("u2")))))
    bound = lambda k: F.lit(lo) + F.lit(width) * (F.col("strip") + k / F.col("subs"))
    return fine.withColumns({"lo": bound(F.col("sub")), "hi": bound(F.col("sub") + 1)}), min(MOST_TASKS, -(-got["n"] // per_strip))


def pieces(e: DataFrame, how: str, type_a: str, type_b: str = "string", per_strip: int = PER_STRIP) -> DataFrame:
    """Regions of edges of layers 0 and 1 as disjoint trapezoids: (a, b, ring, area)."""
    keys = _keys(how)
    names = ["a", "b", "left", "right", "low_l", "low_r", "high_l", "high_r"]
    schema = f"a {type_a}, b {type_b}, " + ", ".join(f"{x} double" for x in names[2:])
    strips, tasks = _in_strips(e, per_strip)
    if strips is None:
        rows = e.sparkSession.createDataFrame([], schema)
    else:

        def work(table: pa.Table) -> pa.Table:
            ka, kb = (table.column(c).to_pylist() for c in ("key_a", "key_b"))
            layer = table.column("layer").to_pylist()
            key = [y if k else x for k, x, y in zip(layer, ka, kb)]
            u1, v1, u2, v2 = (table.column(c).to_numpy() for c in ("u1", "v1", "u2", "v2"))
            found = sweep(layer, key, table.column("part").to_pylist(), u1, v1, u2, v2, table.column("lo")[0].as_py(), table.column("hi")[0].as_py(), keys)
            types = [table.schema.field("key_a").type, table.schema.field("key_b").type, *[pa.float64()] * 6]
            return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

        columns = ["strip", "sub", "lo", "hi", "layer", "key_a", "key_b", "part", "u1", "v1", "u2", "v2"]
        # a strip is little data and much work: their number, not their bytes, says how many tasks share them
        rows = strips.select(*columns).repartition(tasks, "strip", "sub").groupBy("strip", "sub").applyInArrow(work, schema)
    c, s = math.cos(ANGLE), math.sin(ANGLE)
    back = lambda u, v: F.array(F.col(u) * c - F.col(v) * s, F.col(u) * s + F.col(v) * c)
    corners = [back("left", "low_l"), back("right", "low_r"), back("right", "high_r"), back("left", "high_l"), back("left", "low_l")]
    area = (F.col("right") - F.col("left")) * (F.col("high_l") - F.col("low_l") + F.col("high_r") - F.col("low_r")) / 2
    return rows.select("a", "b", F.array(*corners).alias("ring"), area.alias("area"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def by_shape(shapes: DataFrame, key: str, rings: str) -> tuple[DataFrame, DataFrame]:
    """Features with their shapes, and the polygons of each shape."""
    rows = shapes.select(F.col(key).alias("key"), F.col(rings).alias("rings")).where("rings is not null")
    named = alike.members(rows, "key", "rings")
    return named, alike.content(rows, named, "key", "rings")


def shared_pieces(a: DataFrame, b: DataFrame, how: str, per_strip: int) -> DataFrame:
    """Pieces of the overlay of two layers of polygons (shape, rings), by shapes."""
    left, right = edges(_numbered(a, "shape", "rings"), "key", "rings", "part", 0), edges(_numbered(b, "shape", "rings"), "key", "rings", "part", 1)
    left = left.withColumns({"key_a": F.col("key"), "key_b": F.lit(None).cast("string")})
    right = right.withColumns({"key_b": F.col("key"), "key_a": F.lit(None).cast("string")})
    return pieces(left.drop("key").unionByName(right.drop("key")), how, "string", "string", per_strip)


def _checked(how: str) -> str:
    if how not in MODES[:-1]:
        raise ValueError(f"how: one of {', '.join(MODES[:-1])}")
    return how


def _featured(found: DataFrame, named_a: DataFrame, named_b: DataFrame, how: str) -> DataFrame:
    """Rows of shapes (a, b) as rows of the features that have them."""
    if how in ("clip", "difference"):
        kind = named_b.schema["key"].dataType
        return alike.expanded(found, named_a, "a").withColumn("b", F.lit(None).cast(kind))
    join = "inner" if how == "intersection" else "left"
    return alike.expanded(alike.expanded(found, named_a, "a", join), named_b, "b", join)


def overlay(a: DataFrame, b: DataFrame, how: str, key_a: str, key_b: str, rings: str = "rings", per_strip: int = PER_STRIP) -> DataFrame:
    """Overlay of two polygon layers: disjoint pieces (a, b, ring, area) of each result feature.

    ``intersection``: a piece for each pair of features that cover it. ``difference``: what of a
    is in no b (b null). ``symmetric_difference``: that of either side. ``union``: all three.
    ``clip``: what of a lies in any b. Features may overlap within a layer and have holes (even-odd
    rule) and parts; rows of equal key are one feature. Features that only touch share no piece.
    Areas are in the plane of the coordinates, squared. Empty layers are allowed. Features of the
    same polygons are swept as one and get their pieces each.
    """
    _checked(how)
    (named_a, left), (named_b, right) = by_shape(a, key_a, rings), by_shape(b, key_b, rings)
    return _featured(shared_pieces(left, right, how, per_strip), named_a, named_b, how)


def overlay_areas(a: DataFrame, b: DataFrame, how: str, key_a: str, key_b: str, rings: str = "rings", per_strip: int = PER_STRIP) -> DataFrame:
    """``areas`` of ``overlay`` by both features (a, b, area, pieces), summed before features of one shape part."""
    _checked(how)
    (named_a, left), (named_b, right) = by_shape(a, key_a, rings), by_shape(b, key_b, rings)
    return _featured(areas(shared_pieces(left, right, how, per_strip), "a", "b"), named_a, named_b, how)


def overlay_sums(a: DataFrame, b: DataFrame, how: str, key_a: str, key_b: str, rings: str = "rings", per_strip: int = PER_STRIP) -> DataFrame:
    """(in_a, in_b, area): area of all features of ``overlay`` together, by the layers that cover them.

    A piece counts once for each pair of features that share it, so shapes count by their features.
    """
    _checked(how)
    (named_a, left), (named_b, right) = by_shape(a, key_a, rings), by_shape(b, key_b, rings)
    found = areas(shared_pieces(left, right, how, per_strip), "a", "b")
    for side, named in (("a", named_a), ("b", named_b)):
        n = alike.sizes(named).select(F.col("shape").alias(side), F.col("n").alias(f"n_{side}"))
        found = found.join(n, side, "left")
    times = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0))
    held = found.select(F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"), (F.col("area") * times("n_a") * times("n_b")).alias("area"))
    return held.groupBy("in_a", "in_b").agg(F.sum("area").alias("area"))


def _numbered(shapes: DataFrame, key: str, rings: str) -> DataFrame:
    """Rows named by their rings too, so that features of several rows are unions of them, not parities."""
    return shapes.select(F.col(key).alias("key"), F.col(rings).alias("rings"), F.xxhash64(F.to_json(rings)).alias("part")).distinct()


def dissolve(shapes: DataFrame, by: str | None = None, rings: str = "rings", per_strip: int = PER_STRIP) -> DataFrame:
    """The union of all polygons, or of those of each value of ``by``: disjoint pieces (a, ring, area)."""
    named = shapes if by else shapes.withColumn("_all", F.lit(0))
    key = by or "_all"
    kind = _type(named, key)
    e = edges(_numbered(named, key, rings), "key", "rings", "part", 0)
    e = e.withColumns({"key_a": F.col("key"), "key_b": F.lit(None).cast("string")}).drop("key")
    return pieces(e, "dissolve", kind, per_strip=per_strip).drop("b")


def areas(parts: DataFrame, *by: str) -> DataFrame:
    """Area and number of pieces of each result feature."""
    return parts.groupBy(*by).agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("pieces"))


def mercator_rings(rings: Column) -> Column:
    """Rings in degrees as rings in Web Mercator metres."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(*geo.to_mercator(p[0], p[1]))))


def mercator_km2(area: Column) -> Column:
    return area / 1e6


def buffer_parts(shapes: DataFrame, key: str, radius: Column, lines: str = "rings", filled: bool = False, corners: int = 64) -> DataFrame:
    """Convex polygons (key, rings) whose union is the buffer of points, lines or, ``filled``, polygons.

    ``lines`` is an array of lines of [x, y]: a line of one point is a point. Every vertex gets a
    disc of ``corners`` corners and every segment a box; ``dissolve`` joins them, by key for
    buffers of their own, or all. Distances are in the plane of the coordinates.
    """
    rows = shapes.select(F.col(key).alias("key"), radius.cast("double").alias("r"), F.col(lines).alias("lines")).where("lines is not null and r > 0")
    line = rows.withColumn("line", F.explode("lines"))
    points = line.select("key", "r", F.explode("line").alias("p")).distinct()
    step = 2 * math.pi / corners
    disc = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.array(F.col("p")[0] + F.col("r") * F.cos(i * step), F.col("p")[1] + F.col("r") * F.sin(i * step)))
    discs = points.select("key", F.array(disc).alias("rings"))
    n = F.size("line") - 1
    pairs = F.arrays_zip(F.slice("line", F.lit(1), n).alias("p"), F.slice("line", F.lit(2), n).alias("q"))
    boxes = line.where(F.size("line") > 1).withColumn("e", F.explode(pairs)).select("key", "r", F.col("e.p").alias("p"), F.col("e.q").alias("q")).where("p <> q")
    dx, dy = F.col("q")[0] - F.col("p")[0], F.col("q")[1] - F.col("p")[1]
    boxes = boxes.withColumns({"nx": -dy * F.col("r") / F.hypot(dx, dy), "ny": dx * F.col("r") / F.hypot(dx, dy)})
    at = lambda e, k: F.array(F.col(e)[0] + k * F.col("nx"), F.col(e)[1] + k * F.col("ny"))
    boxes = boxes.select("key", F.array(F.array(at("p", 1), at("q", 1), at("q", -1), at("p", -1))).alias("rings"))
    out = discs.unionByName(boxes)
    return out.unionByName(rows.select("key", F.col("lines").alias("rings"))) if filled else out
