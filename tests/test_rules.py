"""Rules worked by hand: citations by place, evidence in words, tables with names, headings by unit; titles against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from stratiform.functions import text as X
from stratiform.operators import assemble as A, citations as C, quality as Q, text as O, titles as T


def test_a_citation_stands_where_its_match_does(spark):
    text = "见 GB 50188-2007 的说明，" + "x" * 150 + "又见 GB 50188。第三条《城乡规划法》《城乡规划法》"
    df = spark.createDataFrame([(1, text), (2, "无"), (3, None)], "doc_id long, text string")
    rows = C.extract(df).orderBy("order").collect()
    second = text.index("GB 50188。")
    assert [(r["kind"], r["citation"], r["position"]) for r in rows] == [("standard", "GB 50188-2007", 2), ("standard", "GB 50188", second), ("clause", "第三条", text.index("第三条")), ("law", "《城乡规划法》", text.index("《"))]
    assert rows[1]["context"] == text[second - 100 : second + 8 + 100]
    cited = C.extract(df).withColumns({"exists_in_kb": F.lit(True), "accuracy": F.lit(80.0), "support_type": F.lit("supportive")})
    got = {r["doc_id"]: (r["total"], r["existing"], r["existence_rate"], r["supportive_rate"]) for r in C.evaluate(df, cited).collect()}
    assert got == {1: (4, 4, 1.0, 1.0), 2: (0, 0, 0.0, 0.0), 3: (0, 0, 0.0, 0.0)}
    # of one place the earlier pattern comes first
    same = C.extract(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), {"z": ["ab"], "a": ["a", "ab"]}).orderBy("order").collect()
    assert [(r["kind"], r["citation"]) for r in same] == [("z", "ab"), ("a", "a"), ("a", "ab")]


def test_evidence_in_words(spark):
    context = "首行\n" + "a" * 60 + "道路宽 6.5 米" + "b" * 60 + "\n依《镇规划标准》，按GB 50188执行"
    line = context.split("\n")[1]
    at = line.index("6.5")
    cases = {"宽6.5公里": line[at - 50 : at + 3 + 50], "依《镇规划标准》": "法规 《镇规划标准》 在上下文中出现", "依《另一标准》": None, "见DB 11/22": None, "长 9 米，依《镇规划标准》": "法规 《镇规划标准》 在上下文中出现"}
    got = spark.range(1).select(*[Q.support_evidence(F.lit(c), F.lit(context)) for c in cases]).first()
    assert list(got) == list(cases.values())
    assert spark.range(1).select(Q.support_evidence(F.lit("见GB 50188"), F.lit("按 GB 50188"), {"standard": r"GB\s*\d+"})).first()[0] == "标准 GB 50188 在上下文中出现"


def test_tables_have_names_and_headers(spark):
    text = "- list\nTable one\n\n| a | b |\n|---|:-:|\n| 1 |  | 2 |\n| 3 | 4 |\ntext | with bar\n|---|\n| h |\n| v |\n||\n\n| only header |\nend\n| x |\n| y |"
    t = O.markdown_tables(O.lines(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string"))).orderBy("table_no")
    assert [(r["table_no"], r["name"], r["headers"], r["rows"]) for r in t.collect()] == [
        (1, "Table one", ["a", "b"], [["1", "2"], ["3", "4"]]),
        (2, "text | with bar", ["h"], [["v"]]),
        (3, "end", ["x"], [["y"]]),
    ]


def test_headings_by_unit(spark):
    lines = ["第一章 总则", "第二节", "第三目 范围", "第四条 内容", "第五部分", "第2.1条", "1、目标", "（一）子项", "text", "# x", ""]
    got = spark.range(1).select(*[X.heading_kind(F.lit(x)) for x in lines]).first()
    assert [k and tuple(k) for k in got] == [("chapter", 0), ("section", 0), ("item", 0), ("article", 0), ("chapter", 0), ("article", 2), ("section", 2), ("item", 3), None, ("markdown", 1), None]


def keyword(pattern, title):
    """The rule as plain code over two titles."""

    def bare(x):
        return next((x[: -len(s)] for s in T.SUFFIXES if x.endswith(s) and len(x) > len(s)), x)

    a, b = bare(pattern), bare(title)
    if a in b or b in a:
        return True
    if any(s in b for s in T.CORE_SYNONYMS.get(a, [])) or any(s in a for s in T.CORE_SYNONYMS.get(b, [])):
        return True
    return title in T.SUFFIX_SYNONYMS.get(pattern, []) or pattern in T.SUFFIX_SYNONYMS.get(title, [])


def how(pattern, title):
    if pattern in title or title in pattern:
        return "exact"
    if keyword(pattern, title):
        return "keyword"
    if min(len(pattern), len(title)) >= 3 and difflib.SequenceMatcher(None, pattern, title).ratio() >= 0.65:
        return "similar"
    return None


def names(seed, n):
    r = random.Random(seed)
    parts = ["给水", "供水", "饮水", "排水", "污水", "雨污", "电力", "供电", "用电", "通信", "电信", "信息", "道路", "交通", "公共", "服务", "村庄", "土地", "利用", "生态"]
    return sorted({"".join(r.choice(parts) for _ in range(r.randrange(1, 4))) + r.choice(["", *T.SUFFIXES]) for _ in range(n)} | set(T.SUFFIXES[:3]))


def test_titles_equal_all_pairs(spark):
    patterns, titles = names(1, 90), names(2, 110)
    p = spark.createDataFrame([(x, i) for i, x in enumerate(patterns)] + [("", 900), (None, 901)], "pattern string, pattern_pos int")
    t = spark.createDataFrame([(x, i) for i, x in enumerate(titles)] + [("", 900), (None, 901)], "title string, title_pos int")
    out = T.matched(p, t)
    got = {(r["pattern"], r["title"]): r["how"] for r in out.collect()}
    want = {(a, b): h for a in patterns for b in titles if (h := how(a, b))}
    assert got == want and set(want.values()) == {"exact", "keyword", "similar"}
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    routed = {r["title"]: r["pattern"] for r in T.routed(p, t).collect()}
    assert routed == {b: next(a for a in patterns if (a, b) in want) for b in titles if any((a, b) in want for a in patterns)}
    best = {r["pattern"]: (r["title"], r["how"]) for r in A.route(p, t).collect()}
    for a in patterns:
        mine = [(["exact", "keyword", "similar"].index(want[(a, b)]), -difflib.SequenceMatcher(None, a, b).ratio() if want[(a, b)] == "similar" else -1.0, i, b) for i, b in enumerate(titles) if (a, b) in want]
        assert best.get(a) == ((min(mine)[3], want[(a, min(mine)[3])]) if mine else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_sections_looked_up(spark, seed):
    r = random.Random(seed)
    words = ["ab", "b", "abc", "xyz", "", "yz", "q"]
    rows = [(d, r.choice(words), i, f"{d}.{i}") for d in range(4) for i in range(5)]
    asks = [(d, w) for d in range(5) for w in [*words, "zz"]]
    s = spark.createDataFrame(rows, "dim int, title string, pos int, content string")
    got = {(x["dim"], x["wanted"]): x["content"] for x in T.looked_up(s, spark.createDataFrame(asks, "dim int, wanted string"), ["dim"]).collect()}
    want = {(d, w): next((c for k, t, _, c in rows if k == d and (w in t or t in w)), "") for d, w in asks}
    assert got == want
