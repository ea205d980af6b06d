"""Tool results, JSON of rows, sampled boundaries and report figures, worked by hand."""

import json
import math
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratiform.operators import extraction as E, results as R, shapes as S, spatial as P


def test_tool_results(spark):
    feature = {"type": "Feature", "properties": {"name": "r"}, "geometry": None}
    geo = {"type": "FeatureCollection", "features": [feature]}
    cases = {
        "null": None,
        "text": "just words",
        "list": "[1, 2]",
        "failed": {"success": False, "error": "no key"},
        "silent": {"a": 1},
        "top": {"success": True, "geojson": geo, "layer_name": "L", "center": [1.5, 2]},
        "bare": {"success": True, "geojson": {"features": []}},
        "listed": {"success": 1, "layers": [{"layerType": "t", "layerName": "n", "geojson": geo}]},
        "nested": {"success": True, "data": {"geojson": geo, "summary": "s", "center": [3, 4, 5]}},
        "kinds": {"success": True, "data": {"road": {"success": True, "geojson": geo}, "water": {"success": True, "geojson": {"features": [{"properties": {"sensitivity_level": "x"}}, {"properties": 5}]}}, "residential": {"success": False, "geojson": geo}}, "location": "here"},
        "words": {"success": True, "data": "told"},
        "analysis": {"success": "yes", "overall_score": 0, "summary": None, "coverage_rate": 0.5},
        "none": {"success": True, "data": None},
    }
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in cases.items()]
    got = {r["id"]: r for r in R.normalised(spark.createDataFrame(rows, "id string, result string")).collect()}
    kinds = {"null": "error", "text": "text", "list": "error", "failed": "error", "silent": "error", "top": "geojson", "bare": "geojson", "listed": "geojson", "nested": "geojson", "kinds": "geojson", "words": "text", "analysis": "analysis", "none": "analysis"}
    assert {k: r["data_type"] for k, r in got.items()} == kinds
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {"null": R.EMPTY, "list": R.UNKNOWN_TYPE, "failed": "no key", "silent": R.UNKNOWN}
    assert {k: r["success"] for k, r in got.items()} == {k: v != "error" for k, v in kinds.items()}
    assert got["text"]["text_data"] == "just words" and got["words"]["text_data"] == "told"
    assert [(x["layerType"], x["layerName"], x["color"], x["features"]) for x in got["top"]["layers"]] == [("analysis", "L", None, 1)] and got["top"]["center"] == [1.5, 2.0]
    assert [(x["layerType"], x["layerName"]) for x in got["listed"]["layers"]] == [("t", "n")] and got["bare"]["layers"] == []
    assert json.loads(got["nested"]["analysis_data"]) == {"summary": "s"} and got["nested"]["center"] is None
    assert [(x["layerName"], x["color"], x["features"]) for x in got["kinds"]["layers"]] == [("水系", "#87CEEB", 2), ("道路", "#FF6B6B", 1)] and got["kinds"]["location"] == "here"
    water, road = (json.loads(x["geojson"]) for x in got["kinds"]["layers"])
    assert [f["properties"] for f in water["features"]] == [{"sensitivity_level": "x"}, {"sensitivity_level": "中敏感区"}]
    assert road == geo | {"features": [feature | {"properties": {"name": "r", "axis_type": "交通主轴"}}]}
    assert json.loads(got["analysis"]["analysis_data"]) == {"overall_score": 0, "coverage_rate": 0.5}


def test_rows_as_json(spark):
    row = (1, datetime(2024, 1, 2, 3, 4, 5), [datetime(2024, 1, 2, 3, 4, 5, 60)], {"k": date(2024, 1, 2)}, (Decimal("1.50"), None), None, b"ab")
    df = spark.createDataFrame([row], "id int, at timestamp, more array<timestamp_ntz>, days map<string,date>, s struct<price:decimal(5,2),n:int>, missing string, raw binary")
    got = json.loads(R.as_json(df, "id").first()["json"])
    assert got == {"id": 1, "at": "2024-01-02T03:04:05", "more": ["2024-01-02T03:04:05.000060"], "days": {"k": "2024-01-02"}, "s": {"price": "1.50", "n": None}, "missing": None, "raw": "ab"}
    assert R.sanitised(df, "at").schema["raw"].dataType.simpleString() == "binary"


def test_sampled_boundary(spark):
    centres = spark.createDataFrame([(1, 100.0, 30.0), (2, 0.0, 0.0)], "centre_id int, lon double, lat double")
    routes = spark.createDataFrame([(1, 0, 300.0), (1, 1, 1200.0), (1, 2, None), (1, 2, 900.0)], "centre_id int, bearing int, duration_s double")
    got = {r["centre_id"]: r for r in P.sampled_boundaries(centres, routes, 10, "walk", 4).collect()}
    radius = 10 / 60 * 5 * 1000
    share = [1.2, 1.2 * 10 / 20, 1.2 * 10 / 15, 1.0]
    want = [[100 + radius * s * math.cos(k * math.pi / 2) / 111320, 30 + radius * s * math.sin(k * math.pi / 2) / 110540] for k, s in enumerate(share)]
    assert got[1]["radius"] == round(radius, 2) and len(got[1]["ring"]) == 5 and got[1]["ring"][0] == got[1]["ring"][-1]
    assert [x for p in got[1]["ring"][:4] for x in p] == pytest.approx([x for p in want for x in p])
    assert got[2]["ring"][0][0] == pytest.approx(radius / 111320)
    pois = spark.createDataFrame([(i, 100.0 + i / 1000, 30.0) for i in range(-20, 30)], "point int, x double, y double")
    rings = spark.createDataFrame([(k, [r["ring"]]) for k, r in got.items()], "centre_id int, rings array<array<array<double>>>")
    hits = S.contained(pois, rings, "centre_id").withColumnRenamed("polygon", "centre_id")
    cover = {r["centre_id"]: r for r in P.zone_coverage(rings, pois, hits, "centre_id", "point", 3).collect()}
    inside = [i for i in range(-20, 30) if want[2][0] <= 100 + i / 1000 < want[0][0]]
    assert cover[1]["total_in_zone"] == len(inside) and cover[1]["coverage_rate"] == len(inside) / 50 and cover[1]["shown"] == inside[:3]
    assert cover[2]["total_in_zone"] == 0 and cover[2]["shown"] == []


def test_figures_places_and_lines(spark):
    reports = [
        (1, "location", 0, "位于广东省，梅州市 平远县，泗水镇。包括甲村、乙村等2个自然村"),
        (1, "land_use", 1, "土地总用地面积约 120.5 公顷，耕地面积约30公顷"),
        (1, "socio_economic", 2, "户籍人口 800 人，210 户。土地总面积 99 公顷。完整名单：金田，石村、至高接，12，长长长长长长长。其他"),
        (2, "socio_economic", 0, "水域面积 1.2.3 公顷，12处滑坡"),
        (3, "land_use", 0, None),
    ]
    df = spark.createDataFrame(reports, "plan int, dimension_key string, pos int, content string")
    got = {r["plan"]: {k: v for k, v in r.asDict().items() if v is not None and k != "plan"} for r in E.figures(df, "plan").collect()}
    assert got == {1: {"total_area_ha": 120.5, "farmland_ha": 30.0, "population_registered": 800.0, "population_household": 210.0, "village_count": 2.0}, 2: {"landslide_points": 12.0}, 3: {}}
    text = lambda i: F.lit(reports[i][3])
    r = spark.range(1).select(E.location_parts(text(0)), E.villages(text(2), text(0)), E.villages(F.lit("无"), text(0)), E.villages(F.lit("无"), F.lit(None).cast("string"))).first()
    assert tuple(r[0]) == ("位于广东省", "梅州市", "平远县", "泗水镇") and r[1] == ["金田", "石村"] and r[2] == ["甲村", "乙村"] and r[3] is None
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["，", "！", "甲 ", "。", "---", "", "）", "> q", "乙 "])] + [(2, 0, "丙"), (2, 1, None)], "d int, pos int, line string")
    out = sorted(((x["d"], x["pos"], x["line"]) for x in E.without_orphans(lines, ["d"]).collect()), key=lambda x: x[:2])
    assert out == [(1, 0, "，！"), (1, 2, "甲。"), (1, 5, "）"), (1, 8, "乙 "), (2, 0, "丙"), (2, 1, None)]
    labels = spark.range(1).select(*[E.ordinal(F.lit(n)) for n in (1, 10, 11, 20, 35, 100)], E.ordinal(F.lit(3), "half")).first()
    assert list(labels) == ["（一）", "（十）", "（十一）", "（二十）", "（三十五）", "（100）", "3）"]
    assert spark.range(1).select(E.legal_titles(F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("x" * 80)))).first()[0] == ["a", "b"]
