"""Joins of points, lines and polygons against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratiform.operators import shapes as S
from test_overlay import frame, star


def orient(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def meet(s, t):
    (a, b), (c, d) = s, t
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return False
    sign = lambda v: (v > 0) - (v < 0)
    return sign(orient(a, b, c)) * sign(orient(a, b, d)) <= 0 and sign(orient(c, d, a)) * sign(orient(c, d, b)) <= 0


def edges(lines, closed):
    out = []
    for line in lines or []:
        pts = line + line[:1] if closed and line and line[0] != line[-1] else line
        out += list(zip(pts, pts[1:])) if len(pts) > 1 else [(p, p) for p in pts]
    return out


def inside(p, rings):
    hit = False
    for (x1, y1), (x2, y2) in edges(rings, True):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def brute(a, b, filled_a, filled_b):
    out = set()
    for i, x in a:
        for j, y in b:
            hit = any(meet(s, t) for s in edges(x, filled_a) for t in edges(y, filled_b))
            hit |= filled_b and any(inside(line[0], y) for line in x or [] if line)
            hit |= filled_a and any(inside(line[0], x) for line in y or [] if line)
            if hit:
                out.add((i, j))
    return out


def polygons(seed, n, scale):
    """Polygons from tiny to large, with holes, multi-parts, copies, nulls and empties."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        cx, cy, size = r.uniform(0, 100), r.uniform(-50, 50), scale * 10 ** r.uniform(-2, 1)
        ring = star(r, cx, cy, size, r.randrange(3, 12))
        rings = [ring]
        if i % 3 == 0:
            rings.append([[cx + (x - cx) * 0.6, cy + (y - cy) * 0.6] for x, y in ring])
        if i % 5 == 0:
            rings.append(star(r, cx + 3 * size, cy, size, 5))
        out.append((i, rings))
    return out + [(900, None), (901, []), (902, [[]])]


def lines(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, step = r.uniform(0, 100), r.uniform(-50, 50), 10 ** r.uniform(-2, 1.3)
        line = [[x, y]]
        for _ in range(r.randrange(0, 6)):
            x, y = x + r.uniform(-step, step), y + r.uniform(-step, step)
            line.append([x, y])
        out.append((i, [line]))
    return out


@pytest.mark.parametrize("filled_a,filled_b", [(True, True), (False, True), (True, False), (False, False)])
def test_intersects_against_all_pairs(spark, filled_a, filled_b):
    a = polygons(1, 60, 1.5) if filled_a else lines(2, 80)
    b = polygons(3, 60, 2.0) if filled_b else lines(4, 80)
    b = b + [(700 + i, rings) for i, rings in a[:5]]  # equal shapes, and borders shared in full
    got = S.intersects(frame(spark, a), frame(spark, b), "id", "id", filled_a, filled_b)
    assert {(r["a"], r["b"]) for r in got.collect()} == brute(a, b, filled_a, filled_b)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_contained_against_all_pairs(spark):
    r = random.Random(9)
    shapes = polygons(5, 80, 3.0)
    pts = [(i, r.uniform(-10, 110), r.uniform(-60, 60)) for i in range(600)] + [(601, None, 1.0)]
    got = S.contained(spark.createDataFrame(pts, "point int, x double, y double"), frame(spark, shapes), "id")
    want = {(i, k) for i, x, y in pts if x is not None for k, rings in shapes if rings and inside((x, y), rings)}
    assert {(r["point"], r["polygon"]) for r in got.collect()} == want and want
    none = frame(spark, shapes).limit(0)
    assert S.contained(spark.createDataFrame(pts, "point int, x double, y double"), none, "id").count() == 0


def test_within(spark):
    square = lambda x, y, s: [[[x, y], [x + s, y], [x + s, y + s], [x, y + s]]]
    a = frame(spark, [(1, square(1.0, 1.0, 1.0)), (2, square(0.0, 0.0, 1.0)), (3, square(3.0, 3.0, 4.0)), (4, square(4.2, 4.2, 0.5)), (5, None)])
    holed = [*square(0.0, 0.0, 6.0), *square(4.0, 4.0, 1.0)]
    b = frame(spark, [(7, holed), (8, square(0.0, 0.0, 1.0))])
    assert {(r["a"], r["b"]) for r in S.within(a, b, "id", "id").collect()} == {(1, 7), (2, 7), (2, 8)}


def to_line(p, line):
    best = math.inf
    for (x1, y1), (x2, y2) in edges([line], False):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((p[0] - x1) * dx + (p[1] - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        best = min(best, math.hypot(p[0] - x1 - t * dx, p[1] - y1 - t * dy))
    return best


def test_nearest_segment_against_all_pairs(spark):
    r = random.Random(11)
    roads = lines(6, 150)
    pts = [(i, r.uniform(0, 100), r.uniform(-50, 50)) for i in range(400)] + [(500 + i, 10.0**i, -(10.0**i)) for i in range(7)] + [(600, None, 1.0)]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    road = spark.createDataFrame(roads, "road int, lines array<array<array<double>>>")
    got = {x["id"]: x for x in S.nearest_segment(p, "id", road, "road").collect()}
    assert set(got) == {i for i, x, _ in pts if x is not None}
    for i, x, y in pts:
        if x is not None:
            want = min(to_line((x, y), k[0]) for _, k in roads)
            assert abs(got[i]["distance"] - want) <= 1e-9 * max(1.0, want) and abs(got[i]["metres"] - want * 111000) <= 1e-3 * max(1.0, want)
            assert abs(to_line((x, y), dict(roads)[got[i]["road"]][0]) - want) <= 1e-9 * max(1.0, want)
    one = S.offsets(p.where("id < 50"), "id", road, "road").first()
    assert abs(one["average_offset_m"] - sum(got[i]["metres"] for i in range(50)) / 50) < 1e-6 and one["points"] == 50
    assert S.nearest_segment(p, "id", road.limit(0), "road").count() == 0
    assert S.nearest_segment(p.limit(0), "id", road, "road").count() == 0


def metres(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_point_has_no_bound(spark):
    r = random.Random(12)
    pts = [(i, r.uniform(115, 117), r.uniform(24, 26), i % 3) for i in range(200)] + [(300, -60.0, -20.0, 1), (301, 0.0, 90.0, 0), (302, 179.9, 0.0, 2), (303, 1.0, 1.0, 9)]
    far = [(i, r.uniform(115.5, 116), r.uniform(24.5, 25), i % 3) for i in range(60)] + [(99, -179.9, 0.0, 2)]
    p = spark.createDataFrame(pts, "id int, lon double, lat double, kind int")
    t = spark.createDataFrame(far, "place int, lon_2 double, lat_2 double, kind int")
    got = {x["id"]: x for x in S.nearest_point(p, "id", t, "place", ["kind"]).collect()}
    assert set(got) == {i for i, *_, k in pts if k != 9}
    for i, lon, lat, kind in pts[:-1]:
        want = min((metres(lon, lat, a, b), j) for j, a, b, k in far if k == kind)
        assert abs(got[i]["distance"] - want[0]) < 1e-3 and (i == 302) == (got[i]["place"] == 99)


def test_zones(spark):
    square = lambda x, y, s: [[[x, y], [x + s, y], [x + s, y + s], [x, y + s]]]
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0), (3, 1.002, 0.5)], "id int, x double, y double")
    zones = spark.createDataFrame([(1, "farmland", square(0.0, 0.0, 1.0)), (2, "ecological", square(0.2, 0.2, 1.0)), (3, "ecological", square(0.3, 0.3, 1.0))], "zone int, kind string, rings array<array<array<double>>>")
    got = {r["id"]: r for r in S.protection_conflicts(pts, "id", zones, "zone", "kind").collect()}
    assert got[1]["in_protected_zone"] and [tuple(c) for c in got[1]["conflicts"]] == [("ecological", "medium"), ("farmland", "high")]
    assert not got[2]["in_protected_zone"] and got[2]["conflicts"] == []
    hazard = {r["id"]: (r["in_hazard_zone"], r["near_hazard_zone"]) for r in S.hazard_state(pts, "id", zones.where("zone = 1"), "zone").collect()}
    assert hazard == {1: (True, False), 2: (False, False), 3: (False, True)}
    assert S.hazard_state(pts, "id", zones.limit(0), "zone").where("in_hazard_zone or near_hazard_zone").count() == 0
