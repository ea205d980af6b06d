"""Golden values of roll-ups and small rules."""

import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from stratiform.functions import text as X
from stratiform.operators import quality, rollups as U, text as O
from stratiform.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_periods_names_and_tables(spark):
    r = one(spark, *[U.planning_period(F.lit(x).cast("string"), 2024) for x in ("2023-2035年", "2025", None, "近期")])
    assert [tuple(x) for x in r] == [(2023, 2035), (2025, 2028), (2024, 2027), (2024, 2027)]
    assert one(spark, U.place_names(F.lit("上村、下村，东至河,12,很长很长的一个名字, 甲")))[0] == ["上村", "下村"] and one(spark, U.place_names(F.lit("上村、下村。中村")))[0] == ["上村", "下村"]
    row = one(spark, *U.summary_row(F.lit("depth"), F.lit(2.4), F.lit(2.168), F.lit(10.7), F.lit(1.234), F.lit(0.031), F.lit("*")))
    assert list(row) == ["depth", "2.40", "2.17", "0.23", "+10.7%", "1.23", "0.0310", "*"]
    assert list(one(spark, *U.approved(F.lit("layer1"), F.lit("layer2")).values())) == [False, 0, "layer2", 1]
    assert list(one(spark, U.travel_minutes(F.lit(500.0), F.lit(5.0)), U.travel_minutes(F.lit(500.0), F.lit(0.0)), U.first_nonempty(F.lit(""), F.lit(None).cast("string"), F.lit("x")))) == [6.0, None, "x"]


def test_tables_of_contents_and_villages(spark):
    text = "# 标题\n## 目 录\n### 第一节 ..... 1\n第二节.....2\n正文开始\n...留下\n# 目录\n## 一\n# 总则\n```\n# 目录\n```\n## 目次\n" + "\n".join(f"条{i}..{i}" for i in range(52))
    want = ["# 标题", "正文开始", "...留下", "# 总则", "```", "# 目录", "```", "条50..50", "条51..51"]
    r = one(spark, O.drop_contents(F.lit(text)), O.drop_contents(F.lit(None).cast("string")), X.is_village(F.lit("平远县金田村")), X.is_village(F.lit("金田村委会")), X.is_village(F.lit("平远县")))
    assert r[0].split("\n") == want and list(r[1:]) == [None, True, False, False]


def test_cached_vectors_are_new_and_distinct(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("bb",), ("c",)], "text string")
    cache = texts.filter("text = 'c'").select(F.md5("text").alias("md5"))
    got = {(r["md5"], r["vector"]) for r in U.cached_vectors(texts, cache, "text", F.length("text")).collect()}
    assert got == {(hashlib.md5(t.encode()).hexdigest(), len(t)) for t in ("a", "bb")}


def test_plan_json_against_plain_loops(spark):
    rows = duckdb.sql(f"select source, doc_id, lang, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()
    plans = {}
    for source, i, lang, n in rows:
        chapters = plans.setdefault(f"{source}-{i // 50}", [])
        if not chapters or chapters[-1][0] != lang:
            chapters.append((lang, []))
        chapters[-1][1].append((i, n))
    want = {p: [(lang, articles) for lang, articles in c] for p, c in plans.items()}
    got = {}
    for r in QUERIES["plan_json"](spark, SF).collect():
        x = json.loads(r["json"])
        assert x["plan"] == r["plan"] and x["n_chapters"] == len(x["chapters"])
        got[r["plan"]] = [(c.get("chapter"), [(a["position"], a.get("n_chars")) for a in c["articles"]]) for c in x["chapters"]]
    assert got == want


def test_change_degree_against_the_rule(spark):
    import difflib

    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    some = {r["doc_id"]: r["change"] for r in QUERIES["change_degree"](spark, SF).filter("doc_id % 10 = 0").collect()}
    assert some
    for i, change in some.items():
        old, new = texts[i + 1], texts[i]
        d = 1 - difflib.SequenceMatcher(None, old or "", new or "").ratio()
        want = 0.0 if not new else 1.0 if not old else 0.3 if d < 0.1 else 1.0 if d > 0.8 else d
        assert abs(change - want) < 1e-6
    assert quality.CHINESE_CLAIMS


def test_matching_blocks_against_the_library(spark, monkeypatch):
    import difflib
    import random

    random.seed(7)
    pairs = []
    for letters in ("ab", "abcdefghij" * 9 + "XYZ", "".join(map(chr, range(0x4E00, 0x5200)))):
        for n in (0, 1, 40, 400, 1500):
            old = "".join(random.choices(letters, k=n))
            edited = "".join(c if random.random() < 0.95 else random.choice(letters) for c in old) + old[: n // 3]
            pairs += [(old, edited), (edited, old), (old, "".join(random.choices(letters, k=300))), (old, old)]
    want = [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)  # texts of this size are never left to the library
    assert [quality.matched(a, b) for a, b in pairs] == want
    for least in (20, 200):
        assert [quality.matched(a, b, least) for a, b in pairs] == [w if w >= least else 0 for w in want]
    monkeypatch.undo()
    monkeypatch.setattr(quality, "PAIRS", 1)  # beyond that many pairs the library counts
    assert [quality.matched(a, b) for a, b in pairs] == want


def test_pairs_of_texts_are_dealt_over_many_tasks(spark):
    assert QUERIES["change_degree"](spark, SF).rdd.getNumPartitions() >= 200
