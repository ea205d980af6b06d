"""Graph operators on cycles, and the pairs of a cyclic parent table."""

from stratiform.operators import graph as G, retrieval as R


def test_waves_and_impact_end_on_cycles(spark):
    dims = spark.createDataFrame([(k, 1, i) for i, k in enumerate("abcdef")], "key string, layer int, pos int")
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "d"), ("e", "f"), ("gone", "a")], "src string, dst string").selectExpr("*", "'depends_on' AS kind")
    assert {r["key"]: r["wave"] for r in G.waves(dims, deps).collect()} == {"a": 1, "b": 2, "c": 3}
    assert G.waves(dims.limit(0), deps).count() == 0
    got = {(r["target"], r["key"], r["level"]) for r in G.impact(deps, ["a", "d"]).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("d", "e", 1), ("d", "f", 2)}


def test_ancestors_end_on_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "x"), ("z", "z"), ("r", None)], "chunk_id string, parent_id string")
    got = {(r["chunk_id"], r["ancestor_id"]): r["distance"] for r in R.ancestors(rows).collect()}
    cycle = {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}
    assert got == cycle | {("x", "a"): 1, ("x", "b"): 2, ("x", "c"): 3, ("y", "x"): 1, ("y", "a"): 2, ("y", "b"): 3, ("y", "c"): 4}


def test_waves_keep_columns_and_need_one_layer_only(spark):
    from stratiform.plans import graph as P

    dims = spark.createDataFrame([("a", 1, 0, "s"), ("b", 1, 1, "s"), ("c", 1, 2, None)], "key string, layer int, pos int, session string")
    deps = spark.createDataFrame([("a", "b", "depends_on"), ("b", "c", "depends_on"), ("x", "a", "depends_on")], "src string, dst string, kind string")
    got = {(r["key"], r["wave"], r["session"]) for r in G.waves(dims, deps, keep=["session"]).collect()}
    assert got == {("a", 1, "s"), ("b", 2, "s"), ("c", 3, None)}
    sf = "/root/testdata/sf0.001"
    one = P.dims(spark, sf).where("layer = 1")
    assert {tuple(r) for r in P.deps(spark, sf, one).collect()} == {tuple(r) for r in P.deps(spark, sf).where("kind = 'depends_on' and src % 8 <= 3").collect()}
