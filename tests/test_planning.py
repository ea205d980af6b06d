"""Planning rules: values worked out by hand."""

from pyspark.sql import functions as F

from stratiform.operators import planning as N


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_words(spark):
    r = one(
        spark, N.expand_query(F.lit("村庄用地")), N.folder_category(F.lit("02_法律法规/01_法律/x")), N.folder_category(F.lit("03")), N.folder_category(F.lit("zzz")), N.file_title(F.lit("07 《镇规划标准》 GB 50188-2007_minerU_parsed.md")),
        N.frequent_phrases_kept(F.lit("道路 道路 绿地 绿地 人口"), F.lit("道路")), N.frequent_phrases_kept(F.lit("a"), F.lit("b")), N.alignment(F.lit(None).cast("double"), F.lit(0.4), F.lit("x")), N.alignment(F.lit(0.5), F.lit(0.5), F.lit("")),
    )
    assert r[0] == ["村庄用地", "农村用地", "乡村用地"] and tuple(r[1]) == ("法律法规", "法律", "国家") and r[2]["category"] == "政策文件" and r[3] is None
    assert tuple(r[4]) == ("07", "镇规划标准 GB 50188-2007", "GB 50188-2007") and list(r[5:]) == [0.5, 0.5, 0.4, 0.0]


def test_summaries(spark):
    three = ['{"dimension_key": "traffic", "layer": 2, "word_count": 9, "key_points": ["a"], "text_summary": "t", "metrics": {"m": "1"}}', '{"summary": "abc", "key_findings": ["f"], "key_numbers": {"n": "2"}}', "plain", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(three)], "i int, t string").select("i", N.parse_summary(F.col("t"), F.lit("k"), F.lit(1)).alias("p")).orderBy("i").collect()
    got = [(r["p"]["dimension_key"], r["p"]["layer"], r["p"]["word_count"], r["p"]["key_points"], r["p"]["text_summary"], r["p"]["metrics"]) for r in rows]
    assert got == [("traffic", 2, 9, ["a"], "t", {"m": "1"}), ("k", 1, 3, ["f"], "abc", {"n": "2"}), ("k", 1, 5, [], "plain", {}), ("k", 1, 0, [], "", {})]


def test_parents(spark):
    c = spark.createDataFrame([(1, 0, "x0", ["r"], "r"), (1, 1, "x1", ["r"], "a"), (1, 2, "x2", ["r", "gone", "a"], "b"), (1, 3, "x3", ["r"], "a")], "doc_id long, chunk_index int, chunk_id string, ancestors array<string>, title string")
    assert {r["chunk_id"]: r["parent_id"] for r in N.parent_chunks(c).collect()} == {"x0": None, "x1": "x0", "x2": "x3", "x3": "x0"}
