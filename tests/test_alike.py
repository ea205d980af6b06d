"""Equal places and shapes are worked on once, and every feature that has them gets the result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.operators import alike, overlay as O, retrieval as R, rollups as U, shapes as S, spatial as P
from stratiform.streaming import events as V

SQUARE = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]
OTHER = [[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, rings array<array<array<double>>>")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def layers(spark):
    return frame(spark, [(i, SQUARE) for i in range(40)]), frame(spark, [(i, OTHER) for i in range(30)])


def test_shapes_are_named_by_all_their_rows(spark):
    a = frame(spark, [(1, SQUARE), (1, OTHER), (2, OTHER), (2, SQUARE), (2, SQUARE), (3, SQUARE)])
    names = dict(map(tuple, alike.members(a, "id", "rings").collect()))
    assert names[1] == names[2] != names[3]
    assert alike.content(a, alike.members(a, "id", "rings"), "id", "rings").count() == 3


def test_equal_features_are_swept_once(spark, layers, monkeypatch):
    a, b = layers
    swept, pieces = [], O.pieces
    monkeypatch.setattr(O, "pieces", lambda e, *args: swept.append(e.count()) or pieces(e, *args))
    got = O.overlay_areas(a, b, "intersection", "id", "id")
    assert {(r["a"], r["b"]): round(r["area"], 9) for r in got.collect()} == {(i, j): 1.0 for i in range(40) for j in range(30)}
    assert swept == [8]  # four edges of each of two shapes
    assert O.areas(O.overlay(a, b, "intersection", "id", "id"), "a", "b").count() == 1200
    for how, area in (("clip", 1.0), ("difference", 3.0)):
        assert [(r["a"], r["b"], round(r["area"], 9)) for r in O.overlay_areas(a, b, how, "id", "id").orderBy("a").collect()] == [(i, None, area) for i in range(40)]
    sums = {(r["in_a"], r["in_b"]): round(r["area"], 6) for r in O.overlay_sums(a, b, "union", "id", "id").collect()}
    assert sums == {(True, True): 1200.0, (True, False): 120.0, (False, True): 90.0}


def test_coincident_edges_leave_whole_pieces(spark):
    """Edges on each other do not change places from slab to slab, which would cut pieces."""
    u = np.linspace(0.0, 1.0, 50)
    e = [(0, "a", 0, 0.0, 0.0, 1.0, 0.1), (0, "b", 0, 0.0, 0.0, 1.0, 0.1), (0, "a", 0, 0.0, 1.0, 1.0, 1.1), (0, "b", 0, 0.0, 1.0, 1.0, 1.1)]
    e += [(1, "z", i, x, 2.0, x + 0.02, 2.0) for i, x in enumerate(u)]  # ends that make slabs
    e += [(1, "z", i, x, 3.0, x + 0.02, 3.0) for i, x in enumerate(u)]
    columns = list(zip(*e))
    out = O.sweep(list(columns[0]), list(columns[1]), list(columns[2]), *map(np.array, columns[3:]), 0.0, 1.0, O._keys("difference"))
    assert sorted(p[0] for p in out) == ["a", "b"]


def test_within_and_intersects_by_shapes(spark, layers, monkeypatch):
    a, b = layers
    inner = frame(spark, [(i, [[[1.2, 1.2], [1.8, 1.2], [1.8, 1.8], [1.2, 1.8]]]) for i in range(20)])
    met, inside = [], S._contained
    monkeypatch.setattr(S, "_contained", lambda p, *args: met.append(p.count()) or inside(p, *args))
    assert S.within(inner, b, "id", "id").count() == 600
    assert S.intersects(a, b, "id", "id").count() == 1200 and S.intersects(inner, a, "id", "id").count() == 800
    assert max(met) == 1
    pts = spark.createDataFrame([(i, 1.5, 1.5) for i in range(50)] + [(99, 9.0, 9.0)], "point int, x double, y double")
    assert S.contained(pts, b, "id").count() == 1500
    assert met[-1] == 2


def test_points_of_one_place_look_once(spark, monkeypatch):
    pts = spark.createDataFrame([(i, i % 2, 116.0, 24.8) for i in range(60)], "key int, kind int, lon double, lat double")
    fac = spark.createDataFrame([(100 + i, i % 2, 116.0 + i % 4 * 0.001, 24.8) for i in range(40)], "f int, kind int, lon_2 double, lat_2 double")
    pairs, counts = P.radius_pairs, []

    def counted(left, right, *args):
        out = pairs(left, right, *args)
        counts.append(out.count())
        return out

    plain = pairs(pts, fac, 250.0, ["kind"])
    least = {r["key"]: r["d"] for r in plain.groupBy("key").agg(F.min(F.struct("distance", "f")).alias("d")).collect()}
    stats = rows(U.distance_stats(plain, ["kind"]).select("kind", *[F.round(c, 6) for c in ("least", "mean", "most")]))
    monkeypatch.setattr(P, "radius_pairs", counted)
    assert {r["key"]: (r["distance"], r["f"]) for r in P.nearest(pts, fac, 250.0, "key", "f", ["kind"]).collect()} == {k: tuple(d) for k, d in least.items()}
    near = rows(P.nearest_k(pts, fac, 250.0, 3, "key", "f", ["kind"]).select("key", "f", "rank"))
    assert near[:3] == [(0, 100, 1), (0, 104, 2), (0, 108, 3)] and len(near) == 180
    assert rows(U.distance_stats(P.weighted_pairs(pts, fac, 250.0, ["kind"]), ["kind"], times="n").select("kind", *[F.round(c, 6) for c in ("least", "mean", "most")])) == stats
    free = fac.drop("kind")
    assert {r["f"] for r in P.covered(pts, free, 250.0, "key", "f", "f").collect()} == {100}
    assert {(r["distance"], r["in_buffer"]) for r in P.in_buffer(pts, free, 250.0, "key").collect()} == {(0.0, True)}
    assert max(counts) <= 12


def test_blocks_return_the_best_of_each_query_only(spark, monkeypatch):
    """Copies tie, and the least ids of them stay, whatever block they are in."""
    monkeypatch.setattr(R, "MOST_BROADCAST", 5)
    monkeypatch.setattr(R, "PASSAGES", 50)
    vector = F.array(*[(F.col("id") % 60 * k % 11).cast("float") for k in (1, 2, 3)])
    e = spark.range(300).select(F.col("id").alias("chunk_id"), (F.col("id") % 3).cast("int").alias("kind"), vector.alias("embedding"))
    q = e.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    q = q.unionByName(spark.range(1).select(F.lit(999).cast("long").alias("query_id"), F.lit(None).cast("array<float>").alias("query")))
    every, some = R.scored(q, e), R.scored(q, e, 4, "kind")
    assert every.count() == 15 * 300 and some.count() < 15 * 300 / 2
    assert rows(R.top_k(R.scored(q, e, 10), 5, 90.0).select("query_id", "chunk_id", "score", "rank")) == rows(R.top_k(every, 5, 90.0).select("query_id", "chunk_id", "score", "rank"))
    filled = lambda df: rows(R.top_k_filtered(df, F.col("kind") == 1, 2, 90.0).select("query_id", "chunk_id", "score", "rank"))
    assert filled(some) == filled(every)


def test_last_value_of_equal_events(spark):
    """Events of one time and id give the same value in any order; a null value shows nothing."""
    given = [(1, 0, 7, 2.0), (1, 0, 7, 5.0), (1, 0, 7, 3.0), (2, 0, 8, 1.0), (2, 1, 9, None)]
    for order in (given, given[::-1]):
        df = spark.createDataFrame(order, "user int, s long, event_id int, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).coalesce(1)
        assert {(r["user"], r["value"], r["n"]) for r in V.batches(df, ["user"], "ts", 1000 * 3600, "value", "event_id").collect()} == {(1, 5.0, 3), (2, 1.0, 2)}


def test_zone_coverage_by_shapes(spark, layers):
    zones = layers[1].unionByName(frame(spark, [(50, SQUARE), (51, [[[8.0, 8.0], [9.0, 8.0], [9.0, 9.0]]])]))
    pts = spark.createDataFrame([(i, 1.5 + i % 2, 1.5 + i % 2) for i in range(30)], "point int, x double, y double")
    hits = S.contained(pts, zones, "id").toDF("point", "id")
    assert rows(P.shape_coverage(zones, pts, S.contained_shapes(pts, zones, "id"), "id", "point", 4)) == rows(P.zone_coverage(zones, pts, hits, "id", "point", 4))


def test_children_are_cut_in_shares_first(spark, monkeypatch):
    """Nulls before the first text count for nothing, and the texts shown are the first ones by index."""
    monkeypatch.setattr(R, "SHARES", 3)
    chunks = spark.range(400).select(F.lit("p").alias("parent_id"), F.col("id").alias("chunk_index"), F.when(F.col("id") >= 300, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("content"))
    chunks = chunks.unionByName(spark.createDataFrame([("none", 1, None), ("long", 1, "x" * 99), ("long", 2, "y")], "parent_id string, chunk_index long, content string"))
    parents = spark.createDataFrame([("p",), ("none",), ("long",), ("absent",)], "parent_id string")
    got = dict(map(tuple, R.with_children(parents, chunks, 22).select("parent_id", "content").collect()))
    assert got == {"p": "\n".join(f"t{i}" for i in range(300, 306))[:22] + "…", "none": "", "long": "x" * 22 + "…", "absent": None}


def test_texts_are_not_dealt_by_dimension(spark):
    """Words go to the texts: a dimension that many texts share would bring them all to one task."""
    from stratiform.operators import appendix as A

    words = spark.range(2).select(F.col("id").alias("pos"), F.lit("en").alias("downstream_dim"), F.array(F.lit("a"), F.lit("b")).alias("words"))
    pairs = spark.range(6).select(F.lit("en").alias("downstream_dim"), F.lit("t").alias("target"), F.lit("a c").alias("downstream"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.keyword_alignment(pairs, words)
        assert {r["keyword_score"] for r in out.collect()} == {0.5}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
