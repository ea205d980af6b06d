"""Provider answers and article contexts: values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from stratiform.functions import geo
from stratiform.operators import articles as A, providers as P


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_routes(spark):
    steps = '[{"polyline": "116.5,24.5;bad;1,x;10.0,20.0,9", "instruction": "left", "road": "R", "distance": "120", "duration": "x"}, {}]'
    lon, lat = geo.gcj_to_wgs(F.lit(116.5), F.lit(24.5))
    r = one(spark, P.route_steps(F.lit(steps)), P.route_steps(F.lit(None).cast("string")), P.route_steps(F.lit("nothing")), lon, lat)
    assert r[0]["coords"] == [[r[3], r[4]], [10.0, 20.0]] and r[3] != 116.5
    assert [tuple(s) for s in r[0]["steps"]] == [("left", "R", 120, 0), ("", "", 0, 0)]
    assert r[1]["coords"] == [] and r[1]["steps"] == [] and r[2]["steps"] == []


def test_route_xml(spark):
    r = one(spark, *[P.route_xml(F.lit(x).cast("string")) for x in ("<r><distance> 1.5 </distance><duration>60</duration><routelatlon> 1,2;3,4; </routelatlon></r>", "<r></r>", "broken", None)])
    assert tuple(r[0]) == (1500.0, 60.0, [[1.0, 2.0], [3.0, 4.0]]) and r[2] is None and r[3] is None
    assert r[1] is None or tuple(r[1]) == (0.0, 0.0, [])


def test_edges_and_pois(spark):
    edges = ['{"highway": ["track", "path"], "name": ["a", "b"], "length": 2}', '{"highway": "alley", "name": [], "length": 1.5}', '{"highway": [], "name": null}', "broken", None]
    e = spark.createDataFrame([(i, i * 10, t) for i, t in enumerate(edges)], "k int, u int, edge string")
    got = [tuple(r) for r in P.edge_features(e, "k", "u", "edge").orderBy("k").select("osm_id", "highway", "highway_desc", "name", "length").collect()]
    assert got == [(0, "track", "农/林道路（田野道路）", "a", 2.0), (10, "alley", "alley", "", 1.5), (20, "unknown", "unknown", "", 0.0), (30, "unknown", "unknown", "", 0.0), (40, "unknown", "unknown", "", 0.0)]
    a = spark.createDataFrame([(1, '{"name": "x", "location": "8.5,9.5", "address": "", "pname": "p", "adname": "q", "distance": "7"}'), (2, "{}"), (3, None)], "k int, poi string")
    b = spark.createDataFrame([(4, '{"name": "y", "lonlat": "1,2", "typeName": "t"}'), (5, '{"lonlat": "1"}')], "k int, poi string")
    rows = {r["k"]: r for r in P.unified_pois(a, b, "k", "poi").collect()}
    assert (rows[1]["lon"], rows[1]["lat"], rows[1]["address"], rows[1]["distance"]) == (8.5, 9.5, "pq", 7) and (rows[2]["lon"], rows[3]["name"]) == (0.0, "")
    assert (rows[4]["lon"], rows[4]["category"], rows[4]["id"], rows[4]["distance"]) == (1.0, "t", None, None) and (rows[5]["lon"], rows[5]["lat"]) == (1.0, 0.0)


def test_traffic(spark):
    info = '{"evaluation": {"description": "d", "status": 2, "excellent": " 40 ", "congested": "4.5", "blocked": 3.5}}'
    r = one(spark, P.traffic_evaluation(F.lit(info)), P.traffic_evaluation(F.lit('{"evaluation": {"status": "1"}}')), P.traffic_evaluation(F.lit("x")), P.traffic_roads(F.lit('[{"name": "n", "status": 4, "speed": 30, "polyline": "1,2;z"}, {"status": 9}]')), P.traffic_roads(F.lit(None).cast("string")))
    assert (r[0]["description"], r[0]["status"], r[0]["shares"]) == ("d", "缓行", {"畅通": 40.0, "缓行": 0.0, "拥堵": 3.5, "严重拥堵": 0.0})
    assert r[1]["status"] == r[2]["status"] == P.NO_DATA and r[4] == []
    assert [(x["name"], x["status"], x["speed"], x["coords"]) for x in r[3]] == [("n", "严重拥堵", 30, [[1.0, 2.0]]), ("", P.NO_DATA, 0, None)]


def test_vertices_and_probes(spark):
    shapes = ['{"type": "Point", "coordinates": [1, 2, 3]}', '{"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4]], [[5, 6]]], [[[7, 8]]]]}', '{"type": "Polygon", "coordinates": [[[1, 2], [3]]]}', '{"type": "Other"}', "x", None]
    r = one(spark, *[P.vertices(F.lit(s).cast("string")) for s in shapes])
    assert list(r) == [[[1.0, 2.0]], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]], [[1.0, 2.0]], [], [], []]
    c = spark.createDataFrame([(1, 0.0, 0.0)], "k int, lon double, lat double")
    got = [tuple(r) for r in P.probe_routes(c, "k", 111.0).orderBy("route_id").collect()]
    assert got == [(1, 0, -1.0, -1.0, -1.0, 1.0), (1, 1, -1.0, -1.0, 1.0, -1.0), (1, 2, -1.0, 1.0, 1.0, -1.0)]
    none = spark.createDataFrame([(1, 0, 5.0, None), (2, 0, 5.0, [[1.0, 2.0], [1.0, 2.0]])], "k int, route_id int, distance double, coords array<array<double>>")
    assert {r["k"]: tuple(r)[1:] for r in P.routed_network(none, "k").collect()} == {1: (0, 0.0, 0), 2: (1, 5.0, 1)}


def test_centres(spark):
    places = spark.createDataFrame([(1, "C县A村"), (2, "C县B村"), (3, "C县D村"), (4, "E县F村"), (5, "C县"), (6, None)], "k int, location string")
    geocodes = spark.createDataFrame([("C县A村", 1.0, 1.0), ("C县A村", 0.5, 9.0)], "location string, lon double, lat double")
    pois = spark.createDataFrame([("C县", "B村", 2, 7.0, 7.0), ("C县", "B村", 1, 2.0, 2.0)], "region string, name string, pos int, lon double, lat double")
    counties = spark.createDataFrame([("C县", 3.0, 3.0)], "county string, lon double, lat double")
    got = {r["k"]: (r["lon"], r["strategy"]) for r in P.located_centres(places, geocodes, pois, counties, "k").collect()}
    assert got == {1: (0.5, "geocode"), 2: (2.0, "poi_search"), 3: (3.0, "county_fallback"), 4: (None, "failed"), 5: (None, None), 6: (None, None)}


def test_advice(spark):
    gaps = F.array(*[F.struct(F.lit(g).alias("gap_m"), F.array(F.lit(x), F.lit(2.5)).alias("coordinates")) for g, x in ((3.0, 1.5), (9.0, 4.5), (9.0, 8.5))])
    zones = F.array(F.struct(F.lit("river").alias("zone_type"), F.lit(30).alias("buffer_distance_m")), F.struct(F.lit("slope").alias("zone_type"), F.lit(5).alias("buffer_distance_m")))
    r = one(spark, P.gap_advice(F.lit("park"), F.lit(0.256), gaps), P.gap_advice(F.lit("park"), F.lit(0.75), F.slice(gaps, 1, 0)), P.gap_advice(F.lit("park"), F.lit(0.8), F.slice(gaps, 1, 0)), P.ecological_advice(F.lit("x"), zones))
    assert r[0] == ["Coverage rate (25.6%) is below 50%. Consider adding new park facilities.", "Farthest uncovered point is 9m outside service radius. Consider facility at coordinates [4.5, 2.5]."]
    assert r[1] == ["Coverage rate (75.0%) needs improvement. Review facility locations for better coverage."] and r[2] == []
    assert r[3][1] == "Establish 30m protection buffer for river. Prohibit construction and pollution sources within buffer." and len(r[3]) == 2


REPORTS = {
    "## A\none\n## B\ntwo\n": [("A", "one", []), ("B", "two", [])],
    "## A\none\n## B\ntwo": [("A", "one", [])],
    "## A\none\n\nrest\n## B\n\nx\n": [("A", "one", [])],
    "## A\nlead\n### S\ns1\n### T\nt1\n## B\nb\n": [("A", "lead", [("S", "s1")]), ("B", "b", [])],
    "## A\n### S\ns1\n### T\nt1\n## B\nb\n": [("A", "### S\ns1\n### T\nt1", [("S", "s1")]), ("B", "b", [])],
    "plain\ntext ": [("规划内容", "plain\ntext", [])],
    "## only": [("规划内容", "## only", [])],
    " \n": [],
    "": [],
    None: [],
}


def test_dimensions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(REPORTS)], "i int, t string").select("i", A.dimensions_of(F.col("t")).alias("d")).orderBy("i").collect()
    got = [[(d["name"], d["content"], [tuple(s) for s in d["subsections"]]) for d in r["d"]] for r in rows]
    assert got == list(REPORTS.values())


def test_sections_are_found_once(spark):
    from stratiform.plans.catalogue import QUERIES

    df = spark.createDataFrame([("## A\r\nx\n## B\ny\r\n\nz\n",), ("##\n\nA\nb\n## \u2028c\nd\n",)], "t string").select(A.dimensions_of(F.col("t")).alias("d"))
    assert [[(x["name"], x["content"]) for x in r["d"]] for r in df.collect()] == [[("B", "y")], [("A", "b"), ("c", "d")]]
    # one search for sections and one for subsections, in tasks that do not follow from the number of files
    query = QUERIES["layer_dimensions"](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and "REPARTITION_BY_NUM" in plan


def test_figures_and_views(spark):
    df = spark.createDataFrame([(1, "", 0, 0.0, '{"location": {"city": "c"}, "land_use": {"forest_coverage_rate": "x"}, "natural_environment": {"forest_coverage_rate": 5}, "architecture": {"total_buildings": "7.9"}}', '{"city": ""}'), (2, "own", 3, 1.5, "{}", None), (3, None, None, None, None, "broken")], "k int, city string, building_count int, forest_coverage_pct double, s string, c string")
    assert [tuple(r)[1:4] for r in A.filled_figures(df, "s", "c").orderBy("k").collect()] == [("c", 7, 5.0), ("own", 3, 1.5), ("", 0, 0.0)]
    long = "v" * 60
    r = one(spark, *[A.session_view(F.lit(t).cast("string")) for t in (None, '{"phase": "p", "config": {"village_data": "%s"}}' % long, '{"project_name": "%s"}' % long)])
    assert [tuple(x) for x in r] == [("init", "村庄规划"), ("p", "v" * 50), ("init", long)]
    r = one(spark, A.parser_of(F.lit("a <!-- 解析器: x1 --> <!-- 解析器: x2 -->\n<!--解析耗时:2.5s-->")), A.parser_of(F.lit(None).cast("string")), A.checkpoint_saved(F.lit("c"), F.lit(1), F.lit("p"), F.lit("s"), F.lit(None).cast("array<string>")))
    assert tuple(r[0]) == ("x1", "2.5") and tuple(r[1]) == (None, None) and r[2] == '{"type":"checkpoint_saved","checkpoint_id":"c","layer":1,"phase":"p","session_id":"s"}'


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_registry(spark, seed):
    """The registry equals a plain dictionary that the operations are applied to one by one."""
    rng = random.Random(seed)
    log = [(rng.choice("abc"), i, rng.choice(["init", "set", "set", "set", "append", "append", "delete"]), rng.choice("xy"), str(i)) for i in range(120)]
    state, results = {}, []
    for s, _, op, key, value in log:
        there = s in state
        results.append(there or op == "init")
        if op == "init":
            state[s] = ({}, [])
        elif op == "delete":
            state.pop(s, None)
        elif there and op == "set":
            state[s][0][key] = value
        elif there:
            state[s][1].append(value)
    df = spark.createDataFrame(log, "s string, i int, op string, key string, value string")
    assert [r["ok"] for r in A.registry_results(df, "s", ["i"]).orderBy("i").collect()] == results
    assert {(r["s"], r["key"]): r["value"] for r in A.registry_values(df, "s", ["i"]).collect()} == {(s, k): v for s, (m, _) in state.items() for k, v in m.items()}
    want = {(s, v): n for s, (_, h) in state.items() for n, v in enumerate(h[-2:], 1)}
    assert {(r["s"], r["value"]): r["place"] for r in A.registry_history(df, "s", ["i"], 2).collect()} == want
    assert A.registry_values(df.limit(0), "s", ["i"]).count() == 0


def test_points_and_events(spark):
    text = "### First point\n#### Deep one\n### abc\n**bold text** **bold text** **First point** **x\ny**\n**fifth** **sixth**"
    r = one(spark, A.key_points(F.lit(text)), A.key_points(F.lit(None).cast("string")), A.session_failed(F.lit("s"), F.lit("m")), A.session_completed(F.lit("s")), A.layer_started(F.lit(1), F.lit("n"), F.lit(2), F.lit("s")))
    assert r[0] == ["First point", "Deep one", "bold text", "fifth", "sixth"] and r[1] == []
    assert list(r[2:]) == ['{"type":"error","session_id":"s","message":"m"}', '{"type":"completed","session_id":"s"}', '{"type":"layer_started","layer":1,"layer_name":"n","dimension_count":2,"session_id":"s"}']


def test_detailed(spark):
    hits = spark.createDataFrame([(1, 0.5, "a", 3, "p", "x"), (1, 0.1, None, None, "p", None), (1, 0.9, "c", None, None, "z")], "k int, score double, source string, page int, paragraph string, content string")
    assert A.detailed_context(hits, "k", "score", 2).first()["text"] == "来源: 未知\n位置: p\n内容: \n\n来源: a\n位置: 3\n内容: x"
    assert A.reference_context(hits.withColumn("doc_type", F.lit(None).cast("string")), "k", "score", most=1).first()["text"] == "【参考1 - 法规】\n来源: Unknown\n内容:\n\n"
