"""Golden values worked out by hand, and properties."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratiform.functions import geo, stats, text as X
from stratiform.operators import assemble, citations, graph, quality, retrieval, spatial, store, text as O
from stratiform.sources import files, geojson, sinks
from stratiform.streaming import events


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_haversine(spark):
    r = one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.haversine(F.lit(116.0), F.lit(24.8), F.lit(116.0), F.lit(24.8)), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)))
    assert r[0] == pytest.approx(6371000 * math.pi / 180) and r[1] == 0 and r[2] == pytest.approx(6371000 * math.pi)


def test_datum_shift_and_projections(spark):
    lon, lat = F.lit(116.0), F.lit(24.8)
    out = geo.gcj_to_wgs(F.lit(10.0), F.lit(50.0))
    there = geo.wgs_to_gcj(lon, lat)
    back = geo.gcj_to_wgs(*there)
    m = geo.from_mercator(*geo.to_mercator(lon, lat))
    r = one(spark, *out, *there, *back, *m)
    assert (r[0], r[1]) == (10.0, 50.0) and 0.003 < abs(r[2] - 116) < 0.01
    assert abs(r[4] - 116) < 1e-4 and abs(r[5] - 24.8) < 1e-4 and r[6] == pytest.approx(116) and r[7] == pytest.approx(24.8)


def test_rings(spark):
    ring = geo.ring(F.lit(0.0), F.lit(0.0), F.lit(1000.0), 12)
    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3), (0, 0))])
    line = geo.points_of_polyline(F.lit("1,2;3,4;5,0|7,8;9,9;8,1"))
    r = one(spark, F.size(ring), ring[0] == F.element_at(ring, -1), geo.shoelace(square), geo.inside(F.lit(1.0), F.lit(1.0), square), geo.inside(F.lit(3.0), F.lit(1.0), square), F.size(line), F.size(line[0]), F.size(geo.wkt_points(F.lit("POLYGON((1 2, 3.5 4, 5 6))"))))
    assert list(r) == [13, True, 6.0, True, False, 2, 4, 3]


def test_statistics(spark):
    assert stats.two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert stats.two_sided_p(2.776, 4) == pytest.approx(0.05, abs=1e-4)
    assert stats.two_sided_p(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    r = one(spark, stats.p_step(F.lit(5.0), F.lit(2)), stats.cohens_d_plain(F.lit(1.0), F.lit(4.0), F.lit(3.0), F.lit(4.0)), stats.cohens_d_weighted(F.lit(3), F.lit(1.0), F.lit(0.0), F.lit(3), F.lit(2.0), F.lit(0.0)), stats.cohens_d_plain(F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(0.0)))
    assert list(r) == [0.001, 1.0, 1000.0, 0.0]


def test_p_steps_and_effects(spark):
    steps = one(spark, *[stats.p_step(F.lit(t), F.lit(df)) for t, df in ((4.1, 5), (-3.5, 29), (2.1, 2), (2.0, 2), (3.3, 30), (2.6, 40), (-1.97, 30), (1.9, 99))])
    assert list(steps) == [0.001, 0.01, 0.05, 0.1, 0.001, 0.01, 0.05, 0.1]
    words = one(spark, *[stats.effect_word(F.lit(d)) for d in (0.9, 0.5, 0.2, 0.1, -3.0)], *[stats.stars(F.lit(p)) for p in (0.0005, 0.001, 0.01, 0.05)])
    assert list(words) == ["large", "medium", "small", "negligible", "negligible", "***", "**", "*", "ns"]
    assert one(spark, stats.t_quantile(F.lit(4)))[0] == pytest.approx(2.776445, abs=1e-5)


def test_claims_depth_and_support(spark):
    texts = ["村庄道路密度为8.5米每公顷，现状。", "根据《土地管理法》第三十二条规定须办理手续。", "短句5米", "没有任何具体内容的一句普通文字描述啊"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["kind"]) for r in quality.claims(quality.sentences(df, r"[。！？\n]", 10), quality.CHINESE_CLAIMS).collect())
    assert got == [(0, "number"), (1, "duty"), (1, "law")]
    t = F.lit("采用分析方法，按 GB 50188 与《镇规划标准》，道路 8 米，建议加宽，应保留。")
    r = one(spark, quality.depth(t), quality.depth(F.lit("无")), quality.depth_reason(t, F.lit(4.6)), quality.depth_reason(F.lit("无"), F.lit(1.0)))
    assert r[0] == pytest.approx(1 + 1 + 0.5 + 0.5 + 1.0 + 0.4) and r[1] == 1.0
    assert r[2] == "评分 4.6 分：包含具体数值指标, 引用法规文件, 引用技术标准, 包含技术方法描述" and r[3] == "评分 1.0 分：缺乏具体技术内容"
    r = one(spark, *[quality.support(F.lit(c), F.lit("密度 6.4，依《镇规划标准》与GB 50188")) for c in ("约6.4公里", "依《镇规划标准》执行", "见GB 50188", "长 9 米", "无")])
    assert list(r) == ["6.4", "《镇规划标准》", "50188", None, None]


def test_citations(spark):
    text = "根据《土地管理法》第三条，道路不低于 8 米。参考《镇规划标准》GB 50188-2007，另见《土地管理法》。"
    df = spark.createDataFrame([(1, text), (2, None), (3, "无")], "doc_id long, text string")
    rows = citations.extract(df).orderBy("order").collect()
    assert [(r["kind"], r["citation"], r["position"]) for r in rows] == [("law", "《土地管理法》", 2), ("clause", "第三条", 9), ("indicator", "不低于 8 米", 15), ("law", "《镇规划标准》", 25), ("standard", "GB 50188-2007", 32)]
    assert rows[0]["context"] == text and all(r["citation"] in r["context"] for r in rows)
    kb = F.lit("土地管理法规定，GB50188 2007 适用。不低于 8 米的道路")
    c = citations.extract(df)
    c = c.withColumn("exists_in_kb", citations.exists_in(F.col("kind"), F.col("citation"), kb)).withColumn("accuracy", citations.accuracy(F.col("exists_in_kb"), F.col("citation"), F.col("context"), kb)).withColumn("support_type", citations.support_type(F.substring("context", F.col("position") - 1, F.lit(9))))
    got = {r["citation"]: r for r in c.collect()}
    assert {k: v["exists_in_kb"] for k, v in got.items()} == {"《土地管理法》": True, "第三条": False, "不低于 8 米": True, "《镇规划标准》": False, "GB 50188-2007": True}
    assert got["第三条"]["accuracy"] == 0 and got["《土地管理法》"]["accuracy"] == 50 and 0 <= got["不低于 8 米"]["accuracy"] <= 100
    e = citations.evaluate(df, c).first()
    assert (e["total"], e["existing"], e["existence_rate"]) == (5, 3, 0.6) and e["supportive"] + e["decorative"] == 5
    assert list(one(spark, *[citations.support_type(F.lit(x)) for x in ("根据本法应当", "参考手册", "按照要求参考", "其他")])) == ["supportive", "decorative", "supportive", "supportive"]


def test_document_types_and_figures(spark):
    cases = [("乡村教材.md", "", "textbook"), ("a.md", "第三章 总则", "textbook"), ("操作手册", "", "guide"), ("管理办法", "", "policy"), ("GB50188", "", "standard"), ("村庄规划", "", "case"), ("其他", None, "report")]
    assert list(one(spark, *[X.doc_type_of_file(F.lit(n), F.lit(c).cast("string")) for n, c, _ in cases])) == [k for _, _, k in cases]
    assert list(one(spark, *[X.doc_type_of_title(F.lit(n)) for n in ("GB50188 教材", "城乡规划法", "规划指南", "村庄规划标准", "x")])) == ["standard", "policy", "guide", "standard", "report"]
    m = one(spark, *X.metrics(F.lit("面积 12.5 公顷，人口 340 人，90 户，覆盖 45%，投资 3万元，路长1.2km，30 m²")).values())
    assert list(m) == [12.5, None, 340.0, 90.0, 45.0, 3.0, 1.2, 30.0]
    assert list(one(spark, *[assemble.legal_level(F.lit(t)) for t in ("《中华人民共和国土地管理法》", "广东省城乡规划条例", "平远县总体规划", "平远县简介", "国土空间用途", "其他")])) == ["national", "provincial", "planning", None, "planning", None]


def test_planning_words(spark):
    t = F.lit("本村土地与宅基地、道路交通和人口经济状况，地处山区丘陵")
    r = one(spark, X.top_tags(t, X.DIMENSION_WORDS), X.best_tag(t, X.TERRAIN_WORDS, "all"), X.best_tag(F.lit("无"), X.TERRAIN_WORDS, "all"), X.first_tag(F.lit("村庄规划标准.md"), X.DOC_TYPE_WORDS, "general"))
    assert list(r[0]) == ["land_use", "traffic", "socio_economic"] and list(r[1:]) == ["mountain", "all", "standard"]


def test_addresses_and_headings(spark):
    r = one(spark, X.address_parts(F.lit("广东省梅州市平远县泗水镇金田村")), X.address_parts(F.lit("金田村")), *[X.heading_level(F.lit(s)) for s in ("# 总则", "第一章 总则", "1.2.3 范围", "一、目标", "（一）目标", "1. 目标", "(1) 目标", "普通文字")])
    assert list(r[0]) == ["广东省", "广东省梅州市", "平远县", "泗水镇", "金田村"] and r[1]["village"] == "金田村" and r[1]["county"] is None
    assert list(r[2:]) == [1, 1, 3, 2, 3, 2, 3, None]
    lines = ["正文。", "1. 目标", "说明文字", "2. 任务", "3. 任务", "IV. 总论", "iv) 条目", "第3.2条 范围", "  ## 二级"]
    kinds = one(spark, *[X.heading_kind(F.lit(x), F.lit(a).cast("string"), F.lit(b).cast("string")) for a, x, b in zip([None, *lines], lines, [*lines[1:], None])])
    assert [k and tuple(k) for k in kinds] == [None, ("section", 2), None, None, ("section", 2), ("section", 2), ("item", 3), ("article", 2), ("markdown", 2)]
    assert list(one(spark, *[X.numbered_line(F.lit(x)) for x in ("1. a", "（二）b", "(3) c", "三、d", "e 1.")])) == [True, True, True, True, False]


def test_extraction(spark):
    t = F.lit("### 关键问题一\n文字 **重点内容甲** 和 **重点内容甲**\n人口 1234 人")
    r = one(spark, X.key_points(t), X.first_number(t, r"人口 (\d+)"), X.first_json(F.lit('```json\n{"a": 1}\n``` x')), X.compact_count(F.lit(1234)), X.parse_time(F.lit("20240102_030405")), X.parse_time(F.lit("bad")), X.clean_markdown(F.lit("a  \n\n\n\nb\x07\n")), X.strip_comments(F.lit("a<!-- x\ny -->b")))
    assert list(r[0]) == ["关键问题一", "重点内容甲"] and r[1] == 1234.0 and r[2] == '{"a": 1}' and r[3] == "1.2k" and r[4].hour == 3 and r[5] is None and r[6] == "a\n\nb" and r[7] == "ab"


def test_dependency_graph(spark):
    assert len(graph.DIMENSIONS) == 28 and len(graph.EDGES) == 73
    w = {r["key"]: r["wave"] for r in graph.waves(graph.dimensions(spark), graph.edges(spark)).collect()}
    assert [w[k] for k in ("resource_endowment", "planning_positioning", "development_goals", "planning_strategies", "project_bank", "industry")] == [1, 2, 3, 4, 2, 1]
    sizes = {r["target"]: r["count"] for r in graph.impact(graph.edges(spark), ["planning_positioning", "natural_environment", "resource_endowment"]).groupBy("target").count().collect()}
    assert sizes == {"planning_positioning": 14, "natural_environment": 16, "resource_endowment": 15}


def test_feedback_and_change(spark):
    r = one(spark, quality.change_degree(F.lit(""), F.lit("x")), quality.change_degree(F.lit("x"), F.lit("")), quality.change_degree(F.lit("abcdef"), F.lit("abcdef")), quality.feedback_response(F.lit("bad road"), F.lit("good road"), ["good"], ["bad"]), quality.removal(F.lit("a"), F.lit("bad"), ["bad"]), quality.share(F.lit("x"), [], 0.5))
    assert list(r[:3]) == [1.0, 0.0, 0.3] and 0.8 < r[3] <= 1.0 and list(r[4:]) == [0.5, 0.5]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n。，", max_size=400), st.integers(5, 60))
def test_split_text_loses_nothing(value, limit):
    parts = O.split_text(value, limit, 0)
    assert all(len(p) <= limit for p in parts)
    assert "".join("".join(parts).split()) == "".join(value.split())


def test_split_table_repeats_the_header():
    text = "\n".join(["| a | b |", "|---|---|", *[f"| {i} | x |" for i in range(30)]])
    parts = O.split_table(text, 80)
    assert all(p.startswith("| a | b |\n|---|---|\n") and len(p) <= 80 for p in parts)
    assert sum(p.count("| x |") for p in parts) == 30


def test_heading_pairs_and_placeholders(spark):
    rows = spark.createDataFrame([(1, 0, "# 第一章"), (1, 1, "# 总则"), (1, 2, "text"), (1, 3, "## a")], "doc_id long, pos int, line string")
    assert [r["line"] for r in O.merge_heading_pairs(rows).orderBy("pos").collect()] == ["# 第一章 总则", "text", "## a"]
    more = ["# 第一章", "# 第二章", "# 第3节", "# 名称", "# 普通", "# 另一个", "## 第十二条", "", "## 条文", "# 第一章"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(more)], "doc_id long, pos int, line string")
    assert [r["line"] for r in O.merge_heading_pairs(rows).orderBy("pos").collect()] == ["# 第一章 第二章", "# 第3节 名称", "# 普通", "# 另一个", "## 第十二条 条文", "# 第一章"]
    text = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# a", "## b", "x", "# c"])], "doc_id long, pos int, line string")
    assert O.blank_after_headings(text).first()["content"] == "# a\n## b\n\nx\n# c"
    c = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["a"])], "doc_id long, path array<string>")
    assert [r["path"] for r in O.placeholders(c).collect()] == [["a", "b"]]


def test_store_reducers_and_migration(spark):
    df = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["b", "c"])], "k string, o int, items array<string>")
    assert store.merge_lists(df, "k", "items", "o").first()["items"] == ["a", "b", "c"]
    once = store.add_missing_columns(df, {"status": ("string", "new"), "o": ("int", 0)})
    assert once.columns == store.add_missing_columns(once, {"status": ("string", "new")}).columns == ["k", "o", "items", "status"]


def test_radius_pairs_equal_brute_force(spark):
    pts = spark.range(60).select(F.col("id").alias("a"), (116 + (F.col("id") * 37 % 100) / 2000).alias("lon"), (24 + (F.col("id") * 53 % 100) / 2000).alias("lat"))
    fac = spark.range(40).select(F.col("id").alias("b"), (116 + (F.col("id") * 29 % 100) / 2000).alias("lon_2"), (24 + (F.col("id") * 71 % 100) / 2000).alias("lat_2"))
    got = {(r["a"], r["b"]) for r in spatial.radius_pairs(pts, fac, 900.0).collect()}
    brute = pts.crossJoin(fac).filter(geo.haversine(F.col("lon"), F.col("lat"), F.col("lon_2"), F.col("lat_2")) <= 900)
    assert got == {(r["a"], r["b"]) for r in brute.collect()} and got


def test_radius_pairs_at_poles_and_date_line(spark):
    r = random.Random(4)
    spots = [(r.uniform(-180, 180), 90 - r.random() ** 2) for _ in range(30)] + [(r.choice([-1, 1]) * (180 - r.random() / 9), r.uniform(-1, 1)) for _ in range(30)] + [(r.uniform(0, 0.5), 75 + r.uniform(0, 0.1)) for _ in range(30)]
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "a int, lon double, lat double")
    fac = pts.select(F.col("a").alias("b"), F.col("lon").alias("lon_2"), F.col("lat").alias("lat_2"))
    for metres in (3000.0, 20000.0):
        got = {(x["a"], x["b"]) for x in spatial.radius_pairs(pts, fac, metres).collect()}
        assert got == {(x["a"], x["b"]) for x in pts.crossJoin(fac).filter(geo.haversine(F.col("lon"), F.col("lat"), F.col("lon_2"), F.col("lat_2")) <= metres).collect()} and len(got) > 100


def test_trees(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 2)], "chunk_id long, parent_id long")
    got = {(x["chunk_id"], x["ancestor_id"], x["distance"]) for x in retrieval.ancestors(tree).collect()}
    assert {g for g in got if g[0] == 7} == {(7, 6, 1), (7, 5, 2), (7, 4, 3), (7, 3, 4), (7, 2, 5), (7, 1, 6)} and len(got) == 1 + 2 + 3 + 4 + 5 + 6 + 2
    s = spark.createDataFrame([(1, None, 0, "A", "a"), (2, 1, 1, "B", "b"), (3, 1, 2, "C", "c"), (4, 2, 3, "D", "d"), (5, None, 4, "E", "e")], "section_id long, parent_id long, pos int, title string, content string")
    assert retrieval.subtree_text(s, "A").first()["content"] == "A\na\nB\nb\nD\nd\nC\nc" and retrieval.subtree_text(s, "B").first()["content"] == "B\nb\nD\nd"


def test_search_scores_in_blocks(spark, monkeypatch):
    e = spark.range(40).select(F.col("id").alias("chunk_id"), F.array(*[(F.col("id") * k % 7).cast("float") for k in (1, 2, 3)]).alias("embedding"))
    q = e.filter("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    once = sorted(map(tuple, retrieval.scored(q, e).select("query_id", "chunk_id", "score").collect()))
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 4)
    assert once == sorted(map(tuple, retrieval.scored(q, e).select("query_id", "chunk_id", "score").collect())) and len(once) == 560


def test_filters_and_context(spark):
    df = spark.createDataFrame([("plain", "policy", 1), ("hill", "case", 1), ("plain", "case", 2)], "terrain string, doc_type string, task int")
    n = lambda c: df.filter(c).count()
    t = F.col("task") == 1
    assert n(retrieval.metadata_filter(terrain="all")) == 3 and n(retrieval.metadata_filter(task=t, terrain="plain")) == 1 and n(retrieval.metadata_filter(doc_type="case")) == 2
    assert n(retrieval.metadata_filter(policy=F.col("doc_type") == "policy", summary=F.col("doc_type") == "case", task=t)) == 2
    assert list(one(spark, *[retrieval.context_around(F.lit("abcdefg"), F.lit(h), k) for h, k in (("d", 0), ("d", 2), ("a", 3), ("z", 1))])) == ["d", "bcdef", "abcd", None]


def test_prefer_keeps_an_empty_answer(spark):
    a = spark.createDataFrame([("x", True, None), ("y", False, None)], "k string, ok boolean, poi string")
    b = spark.createDataFrame([("x", True, "p"), ("y", True, "q")], "k string, ok boolean, poi string")
    assert {(r["k"], r["poi"]) for r in spatial.prefer([a, b], "k").collect()} == {("x", None), ("y", "q")}


def test_files_and_geojson(spark, tmp_path):
    import zipfile

    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_bytes("乡村规划文本，测试编码。".encode("gbk"))
    (tmp_path / "d/e/b.html").write_text("<html><script>no</script><body><p>Visible words here</p><nav>menu</nav></body></html>")
    (tmp_path / "d/short.md").write_text("tiny")
    (tmp_path / "d/bad.docx").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "d/c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p ><w:t>First paragraph</w:t></w:p><w:tbl><w:tr ><w:tc><w:p ><w:t>a</w:t></w:p></w:tc><w:tc><w:p ><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl>")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.read_directory(spark, str(tmp_path / "d")).collect()}
    assert set(got) == {"a.txt", "b.html", "c.docx", "bad.docx"} and got["bad.docx"]["error"] and got["a.txt"]["text"].startswith("乡村规划")
    assert got["b.html"]["text"] == "Visible words here" and got["c.docx"]["text"] == "First paragraph\na | b"
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"water":5}},{"type":"Feature","geometry":null,"properties":{}}]}')
    f = geojson.read_features(spark, str(tmp_path / "g.geojson"))
    r = f.select(F.size(F.element_at(geojson.outer_rings(F.col("geometry_type"), F.col("coordinates")), 1)).alias("n"), geojson.layer_kind(F.col("geometry_type"), F.col("properties")).alias("kind")).collect()
    assert [(x["n"], x["kind"]) for x in r] == [(4, "water")]
    kinds = [("Polygon", '{"boundary":"x","water":1}', "boundary"), ("MultiPolygon", '{"highway":"a"}', "road"), ("Polygon", "{}", "boundary"), ("LineString", '{"waterway":"r"}', "water"), ("MultiLineString", "{}", "road"), ("Point", '{"place":""}', None), ("Point", '{"building":"yes"}', "residential"), ("MultiPoint", '{"place":"a"}', None)]
    assert list(one(spark, *[geojson.layer_kind(F.lit(g), F.lit(p)) for g, p, _ in kinds])) == [k for *_, k in kinds]
    assert one(spark, F.size(geojson.outer_rings(F.lit("MultiPolygon"), F.lit("[[[[0,0],[1,0],[0,0]]],[[[5,5],[6,5],[5,5]]]]"))))[0] == 2
    pts = spark.createDataFrame([(1.0, 2.0, "n")], "lon double, lat double, name string")
    assert geojson.point_features(pts, "lon", "lat").first()["feature"] == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"name":"n"}}'
    for run in (1, 2, 1):
        sinks.write_run(spark.range(run * 3), str(tmp_path / "cache"), "rag", "x", run)
    assert sinks.read_run(spark, str(tmp_path / "cache"), "rag", "x", 1).count() == 3 and sinks.read_run(spark, str(tmp_path / "cache"), "rag", "x", 2).count() == 6


def test_sequence_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    e = spark.read.parquet(src).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), e.schema)
    events.run_to_end(events.sequence_stream(stream, "user_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["user_id"], r["event_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["user_id"], r["event_id"], r["seq"]) for r in events.sequence(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "seq").collect()}
