"""Overlay, dissolve and buffers against brute force over the cells of a fine grid."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import overlay as O

SIDE = 300


def star(r, cx, cy, size, corners):
    """A ring around a centre, by angle, so that it does not cross itself."""
    at = sorted(r.uniform(0, 2 * math.pi) for _ in range(corners))
    return [[cx + (d := r.uniform(0.4, 1) * size) * math.cos(t), cy + d * math.sin(t)] for t in at]


def shrunk(ring, cx, cy, by):
    return [[cx + (x - cx) * by, cy + (y - cy) * by] for x, y in ring]


def layer(seed, n, size):
    r = random.Random(seed)
    out = []
    for i in range(n):
        cx, cy = r.uniform(0, 10), r.uniform(0, 10)
        ring = star(r, cx, cy, size, r.randrange(5, 14))
        rings = [ring, shrunk(ring, cx, cy, 0.5)] if i % 2 else [ring]
        out.append((i, rings))
    return out


def covered(rings, x, y):
    """Even-odd rule at many points."""
    inside = np.zeros(x.shape, bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


@pytest.fixture(scope="module")
def plane():
    t = (np.arange(SIDE) + 0.5) / SIDE * 14 - 2
    return *np.meshgrid(t, t), (14 / SIDE) ** 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, rings array<array<array<double>>>")


@pytest.mark.parametrize("per_strip", [12, 128])
def test_overlay_against_grid_cells(spark, plane, per_strip):
    x, y, cell = plane
    left, right = layer(1, 8, 2.5), layer(2, 6, 3.0)
    a, b = {i: covered(r, x, y) for i, r in left}, {i: covered(r, x, y) for i, r in right}
    any_a, any_b = np.any(list(a.values()), axis=0), np.any(list(b.values()), axis=0)
    want = {
        "intersection": {(i, j): (p & q).sum() * cell for i, p in a.items() for j, q in b.items()},
        "difference": {(i, None): (p & ~any_b).sum() * cell for i, p in a.items()},
        "clip": {(i, None): (p & any_b).sum() * cell for i, p in a.items()},
    }
    want["symmetric_difference"] = want["difference"] | {(None, j): (q & ~any_a).sum() * cell for j, q in b.items()}
    want["union"] = want["symmetric_difference"] | want["intersection"]
    fa, fb = frame(spark, left), frame(spark, right)
    for how, expected in want.items():
        got = {(r["a"], r["b"]): r["area"] for r in O.areas(O.overlay(fa, fb, how, "id", "id", per_strip=per_strip), "a", "b").collect()}
        for k in expected.keys() | got.keys():
            assert abs(got.get(k, 0) - expected.get(k, 0)) < 0.08, (how, k, got.get(k), expected.get(k))
    whole = O.areas(O.dissolve(fa, per_strip=per_strip)).first()["area"]
    assert abs(whole - any_a.sum() * cell) < 0.1
    own = {r["a"]: r["area"] for r in O.areas(O.dissolve(fa, "id", per_strip=per_strip), "a").collect()}
    assert all(abs(own[i] - p.sum() * cell) < 0.08 for i, p in a.items())


def test_strips_do_not_bear_on_areas(spark):
    fa, fb = frame(spark, layer(5, 12, 2.0)), frame(spark, layer(6, 12, 2.0))
    sums = [O.areas(O.overlay(fa, fb, "union", "id", "id", per_strip=p), "a", "b").collect() for p in (5, 40, 100_000)]
    sums = [{(r["a"], r["b"]): r["area"] for r in s if r["area"] > 1e-9} for s in sums]
    assert sums[0].keys() == sums[1].keys() == sums[2].keys()
    assert all(abs(sums[i][k] - sums[2][k]) < 1e-9 for i in (0, 1) for k in sums[2])


def test_pieces_are_the_region_itself(spark, plane):
    x, y, _ = plane
    left, right = layer(3, 3, 3.0), layer(4, 3, 3.0)
    rows = O.overlay(frame(spark, left), frame(spark, right), "intersection", "id", "id").collect()
    pair = max(((r["a"], r["b"]) for r in rows), key=lambda k: sum(r["area"] for r in rows if (r["a"], r["b"]) == k))
    parts = [covered([r["ring"]], x, y) for r in rows if (r["a"], r["b"]) == pair]
    truth = covered(dict(left)[pair[0]], x, y) & covered(dict(right)[pair[1]], x, y)
    assert (np.sum(parts, axis=0) <= 1).all()  # no two overlap
    assert (np.any(parts, axis=0) != truth).sum() <= 2


def test_shared_borders_and_empty_layers(spark):
    square = lambda x, y: [[[x, y], [x + 1.0, y], [x + 1.0, y + 1.0], [x, y + 1.0], [x, y]]]
    a = frame(spark, [(1, square(0.0, 0.0)), (2, square(1.0, 0.0)), (3, None), (4, []), (5, [[[0.0, 0.0], [1.0, 1.0]]])])
    b = frame(spark, [(7, square(1.0, 0.0)), (8, square(0.0, 1.0)), (7, square(1.5, 0.0))])
    got = {(r["a"], r["b"]): round(r["area"], 9) for r in O.areas(O.overlay(a, b, "intersection", "id", "id"), "a", "b").collect()}
    assert got == {(2, 7): 1.0}  # neighbours touch, equal squares meet, rows of one key are united
    assert round(O.areas(O.dissolve(b)).first()["area"], 9) == 2.5
    none = b.limit(0)
    assert O.overlay(a, none, "intersection", "id", "id").count() == 0 and O.overlay(none, none, "union", "id", "id").count() == 0
    assert round(O.areas(O.overlay(a, none, "difference", "id", "id")).first()["area"], 9) == 2.0
    with pytest.raises(ValueError):
        O.overlay(a, b, "within", "id", "id")


def test_buffers(spark):
    t = (np.arange(1500) + 0.5) / 1500 * 14 - 2
    x, y, cell = *np.meshgrid(t, t), (14 / 1500) ** 2
    lines = [(1, [[[1.0, 1.0], [6.0, 2.0], [6.0, 7.0]]]), (2, [[[5.0, 1.0]]]), (3, [[[4.0, 6.0], [9.0, 5.0]], [[2.0, 8.0]]])]
    rows = frame(spark, lines)
    own, whole = {}, np.zeros(x.shape, bool)
    for i, parts in lines:
        hit = np.zeros(x.shape, bool)
        for line in parts:
            for (x1, y1), (x2, y2) in zip(line, line[1:] or line):
                dx, dy = x2 - x1, y2 - y1
                t = np.clip(((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
                hit |= (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2 <= 0.8**2
        own[i], whole = hit, whole | hit
    parts = O.buffer_parts(rows, "id", F.lit(0.8))
    assert abs(O.areas(O.dissolve(parts)).first()["area"] - whole.sum() * cell) < 0.06
    got = {r["a"]: r["area"] for r in O.areas(O.dissolve(parts, "key"), "a").collect()}
    assert all(abs(got[i] - h.sum() * cell) < 0.05 for i, h in own.items())
    square = frame(spark, [(1, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]])])
    grown = O.areas(O.dissolve(O.buffer_parts(square, "id", F.lit(0.5), filled=True))).first()["area"]
    assert abs(grown - (4 + 8 * 0.5 + math.pi * 0.25)) < 0.01
