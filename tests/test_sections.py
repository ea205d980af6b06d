"""Section trees, chunk repair, cleaning, document views and ingest, against plain loops and golden values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratiform.operators import chunking as C, documents as D, tree as T
from stratiform.sources import ingest as I

SCHEMA = "source string, chunk_id string, parent_id string, chunk_index int, depth int, section_title string, content string, char_count int, is_placeholder boolean"


def forest(seed, sources=6, most=40):
    """Random trees, several roots, parents that are not there, and cycles in one source."""
    r = random.Random(seed)
    rows = []
    for s in range(sources):
        n = r.randrange(1, most)
        order = r.sample(range(n * 2), n)
        for i in range(n):
            parent = None if i == 0 or r.random() < 0.15 else f"c{r.randrange(i)}" if r.random() < 0.95 else "gone"
            if s == 0 and i in (1, 2, 3) and n > 4:
                parent = f"c{[2, 3, 1][i - 1]}"  # a cycle of three
            text = "x" * r.choice([0, 10, 49, 50, 120])
            rows.append((f"s{s}", f"c{i}", parent, order[i], r.randrange(0, 4), r.choice(["", "t", f"title {i}"]), f"{s}.{i}{text}", len(text), r.random() < 0.1))
    return rows


def by_source(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], {})[x[1]] = x
    return out


def way_up(own, chunk):
    """Chunks from one up to its root, or None on or below a cycle."""
    out = [chunk]
    while (p := own[out[-1]][2]) in own:
        if p in out:
            return None
        out.append(p)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_and_ancestors_equal_a_walk(spark, seed):
    rows = forest(seed)
    tree = T.with_intervals(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {(r["source"], r["chunk_id"]): r for r in tree.collect()}
    assert len(got) == len(rows)
    far = {(r["source"], r["chunk_id"], r["ancestor"]): r["distance"] for r in T.ancestors(tree).collect()}
    want_far, at_two, texts = {}, {}, {}
    for s, own in by_source(rows).items():
        ways = {c: way_up(own, c) for c in own}
        order = sorted((c for c in own if ways[c]), key=lambda c: [own[x][3] for x in reversed(ways[c])])
        for c in own:
            r = got[(s, c)]
            if ways[c] is None:
                assert r["enter"] is None and r["path"] is None
                continue
            below = [x for x in order if c in ways[x]]
            assert r["enter"] == order.index(c) + 1 and r["leave"] == order.index(below[-1]) + 1
            texts[(s, c)] = "\n\n".join(own[x][6] for x in below)
            want_far |= {(s, c, a): d for d, a in enumerate(ways[c]) if d}
            hit = next((x for x in ways[c] if own[x][4] == 2), None)
            if hit:
                at_two[(s, c)] = hit
    assert far == want_far
    assert {(r["source"], r["chunk_id"]): r["ancestor"] for r in T.ancestor_at_depth(tree, 2).collect()} == at_two
    assert {(r["source"], r["chunk_id"]): r["content"] for r in T.subtrees(tree, tree.where("path is not null")).collect()} == texts
    for r in T.section_context(tree, tree.select("source", "chunk_id")).collect():
        own = by_source(rows)[r["source"]]
        target = own[r["chunk_id"]][2] if own[r["chunk_id"]][2] in own else r["chunk_id"]
        assert r["target"] == target and r["content"] == texts.get((r["source"], target)) and r["section_title"] == own[target][5]
    assert T.with_intervals(spark.createDataFrame([], SCHEMA)).count() == 0


def repaired(chunks):
    """The rule as a loop over one source's chunks in order."""
    if len(chunks) < 2:
        return {c[1]: (c[2], c[8], None) for c in chunks}
    children = {}
    for c in chunks:
        if c[2]:
            children.setdefault(c[2], []).append(c[1])
    root = next((c for c in chunks if c[4] == 1), None)
    out = {}
    for c in chunks:
        has, parent, mark = bool(children.get(c[1])), c[2], c[8]
        if (c[7] or 0) < 50 and not has and c[5]:
            mark = True
            if c[4] == 1 and root and c[1] != root[1]:
                parent = root[1]
                children.setdefault(root[1], []).append(c[1])
        out[c[1]] = (parent, mark, has)
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_orphans_equal_the_loop(spark, seed):
    rows = forest(seed, sources=10, most=12)
    got = {(r["source"], r["chunk_id"]): (r["parent_id"], r["is_placeholder"], r["has_children"]) for r in T.orphans_fixed(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(s, c): v for s, own in by_source(rows).items() for c, v in repaired(sorted(own.values(), key=lambda x: x[3])).items()}
    assert got == want


def test_code_and_tables_split():
    code = "```\n" + "x" * 172 + "\n```"
    assert C.split_long("short") is None
    note = "[代码块摘要: 1 个代码块, 共 180 字符]"
    assert C.split_long(f"before {code} after" + " " * 60, 230) == [(0, f"before  after\n\n{note}", False)]
    assert C.split_code(code + "y" * 300, 230) == [(0, "y" * (230 - len(note) - 100) + f"\n\n{note}", False)]
    assert C.split_code(code, 200) == [(0, note, False)]
    few = C.split_long("```\na\n```\n" + "word " * 60, 100, 0)
    assert len(few) > 2 and "".join(t for _, t, _ in few) == "```\na\n```\n" + "word " * 60
    head, rows = "<tr><th>h</th></tr>", [f"<tr><td>{i:030d}</td></tr>" for i in range(6)]
    text = f"intro\n<table>{head}\n" + "\n".join(rows) + "\n</table>\nafter"
    parts = C.split_long(text, 150)
    assert [i for i, _, _ in parts] == list(range(len(parts))) and parts[-1] == (len(parts) - 1, "after", False)
    assert all(len(t) <= 150 + len("\n</table>") and head in t for _, t, _ in parts[:-1]) and parts[0][1].startswith("intro\n<table>")
    assert re.findall(r"<td>(\d+)</td>", "".join(t for _, t, _ in parts)) == [f"{i:030d}" for i in range(6)]
    assert C.split_long("<table>" + "z" * 200, 50) == [(0, ("<table>" + "z" * 200)[:50], False)]
    late = C.split_long(f"<table>{head}{rows[0]}</table>" + "tail " * 60, 100, 0)
    assert [(i, a) for i, _, a in late if a] == [(i, True) for i in range(sum(a for *_, a in late))] and late[0][2] is False


def test_long_chunks_keep_their_place(spark):
    rows = [("s", "c0", None, 0, 1, "T", "word " * 50, 250, False), ("s", "c1", "c0", 1, 2, "U", "tiny", 4, False), ("s", "c2", None, 2, 1, None, None, 0, False)]
    got = sorted(C.long_chunks_split(spark.createDataFrame(rows, SCHEMA), limit=100, overlap=0).collect(), key=lambda r: r["chunk_id"])
    assert [r["chunk_id"] for r in got] == ["c0_0", "c0_1", "c0_2", "c1", "c2"]
    assert [r["section_title"] for r in got] == ["T", "T (部分2)", "T (部分3)", "U", None] and [r["parent_chunk_id"] for r in got] == ["c0"] * 3 + [None] * 2
    assert "".join(r["content"] for r in got[:3]) == "word " * 50 and [r["char_count"] for r in got] == [100, 100, 50, 4, 0]


def plain_clean(text):
    """The cleaning rule as one pass over the lines of a text."""
    out, code, toc, level, seen = [], False, False, 0, 0
    for n, line in enumerate(re.sub(r"<!--[\s\S]*?-->", "", text).split("\n"), 1):
        s = line.strip()
        if s.startswith("```"):
            code = not code
            out.append(line)
            continue
        if code:
            out.append(line)
            continue
        if m := re.match(r"^(#+)\s*目\s*[录次]", s):
            toc, level, seen = True, len(m[1]), 0
            continue
        if toc:
            seen += 1
            if seen > 50:
                toc = False
            else:
                m = re.match(r"^(#+)\s+", s)
                listed = re.match(r"^\s*#+\s", s) or ".." in s
                if not listed or (m and len(m[1]) <= level):
                    toc = False
                    out.append(line)
                continue
        if re.match(r"^\*\s*\d+\s*[-—]\s*$", s) or s.startswith("![image]") or (n <= 20 and re.match("^(?:" + "|".join(map(re.escape, I.METADATA_FIELDS)) + ")[：:]", s)):
            continue
        out.append(line)
    rows, merged, i = [x for x in out if x.strip()], [], 0
    number = r"^第(?:\d+|[一二三四五六七八九十]|十[一二三四五])[篇章节条]$"
    while i < len(rows):
        a = re.match(r"^(#{1,6})\s+(.+)$", rows[i])
        b = re.match(r"^(#{1,6})\s+(.+)$", rows[i + 1]) if i + 1 < len(rows) else None
        if a and b and a[1] == b[1] and re.match(number, a[2].strip()):
            merged.append(f"{a[1]} {a[2].strip()} {b[2].strip()}")
            i += 2
        else:
            merged.append(rows[i])
            i += 1
    lines = []
    for j, line in enumerate(merged):
        lines.append(line)
        if j + 1 < len(merged) and line.startswith("#") and not merged[j + 1].startswith("#"):
            lines.append("")
    return "\n".join(lines)


def test_cleaning_equals_the_loop(spark):
    r = random.Random(8)
    kinds = ["# 第一章", "# 总则", "## 第3节", "## 第4节", "# 目录", "## 目 次", "### deep", "第一条 ........ 3", "text", "", "  ", "```", "* 12 -", "![image](x)", "文号：1", "分类: b", "<!-- note -->", "<!-- long", "end -->", "plain line", "#tag"]
    texts = ["\n".join(r.choice(kinds) for _ in range(r.randrange(1, 90))) for _ in range(150)]
    texts += ["# 目录\n" + "\n".join(f"a .... {i}" for i in range(60)) + "\nend", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: x["content"] for x in C.cleaned(docs, I.METADATA_FIELDS).collect()}
    want = {i: c for i, t in enumerate(texts) if t is not None and (c := plain_clean(t))}
    assert got == want


def test_document_views(spark):
    rows = [("a.md", 0, 1, "One", "# One\nfirst", "policy", "sum", ["Point A", "point b"]), ("a.md", 1, 2, "Two", "second", "policy", None, None), ("a.md", 2, 1, "Three", "third", "case", None, ["Other"]), ("b.md", 5, 1, "One", "solo", None, None, ["POINT c"])]
    chunks = spark.createDataFrame(rows, "source string, chunk_index int, depth int, section_title string, content string, doc_type string, summary string, key_points array<string>")
    got = {r["source"]: (r["doc_type"], r["preview"], r["chunks"], r["chars"]) for r in D.listed(chunks, preview=5).collect()}
    assert got == {"a.md": ("policy", "# One", 3, 22), "b.md": (None, "solo", 1, 4)}
    views = {r["source"]: r["text"] for r in D.overview(chunks, spark.createDataFrame([("a.md", "all of it")], "source string, summary string")).collect()}
    assert views["a.md"] == "【文档概览】\n来源: a.md\n类型: policy\n\n**执行摘要**\nall of it\n\n**章节列表**\n1. One\n2. Three\n"
    assert views["b.md"] == "【文档概览】\n来源: b.md\n类型: 未知\n\n⚠️  该文档尚未生成摘要\n\n**章节列表**\n1. One\n"
    asked = spark.createDataFrame([("a.md", "One", "summary"), ("a.md", "T", "full"), ("a.md", "One", "medium"), ("a.md", "none", "full"), ("b.md", "One", "long")], "source string, pattern string, level string")
    text = {(r["source"], r["pattern"], r["level"]): (r["text"], r["error"]) for r in D.chapter(chunks, asked).collect()}
    lead = "【知识片段 1】\n来源: a.md\n位置: 第1 页\n内容:\n"
    assert text == {("a.md", "One", "summary"): (f"{lead}sum", None), ("a.md", "T", "full"): (f"{lead}second", None), ("a.md", "One", "medium"): (f"{lead}**摘要**\nsum\n\n**关键要点**\n  • Point A\n  • point b", None), ("a.md", "none", "full"): (None, "chapter"), ("b.md", "One", "long"): (None, "level")}
    points = D.matching_points(chunks, spark.createDataFrame([("point", None), ("point", ["b.md"]), ("other", ["b.md"])], "query string, sources array<string>"))
    assert sorted((r["query"], r["source"], r["point"]) for r in points.collect()) == [("point", "a.md", "Point A"), ("point", "a.md", "point b"), ("point", "b.md", "POINT c")]
    whole = {r["source"]: (r["total_chunks"], r["length"], r["content"]) for r in D.full_text(chunks).collect()}
    assert whole["a.md"] == (3, 26, "# One\nfirst\n\nsecond\n\nthird")


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_ingest_new_changed_and_deleted_files(spark, tmp_path):
    folder, path = tmp_path / "docs", str(tmp_path / "store")
    folder.mkdir()
    body = "道路交通规划的正文内容，" * 8
    write(folder, "第一指南.md", f"# 第一章\n# 总则\n{body}\n## 道路\n{body}\n# 附则\n短\n")
    write(folder, "b.md", f"# B\n{body}\n")
    write(folder, "tiny.md", "x")
    assert I.sync_folder(spark, str(folder), path) == {"insert": 2, "update": 0, "skip": 0, "delete": 0}
    first = I.current_chunks(spark, path).orderBy("source", "chunk_index").collect()
    mine = [r for r in first if r["source"] == "第一指南.md"]
    assert [r["section_title"] for r in mine] == ["第一章 总则", "道路", "附则"] and [r["depth"] for r in mine] == [1, 2, 1]
    assert mine[1]["parent_id"] == mine[0]["chunk_id"] and mine[2]["parent_id"] == mine[0]["chunk_id"] and mine[2]["is_placeholder"]
    assert mine[0]["has_children"] and mine[0]["doc_type"] == "textbook" and "traffic" in mine[1]["dimensions"]
    # a rerun adds nothing
    assert I.sync_folder(spark, str(folder), path) == {"insert": 0, "update": 0, "skip": 2, "delete": 0}
    assert I.current_chunks(spark, path).orderBy("source", "chunk_index").collect() == first
    # changed
    write(folder, "b.md", f"# B2\n{body}\n# C\n{body}")
    assert I.sync_folder(spark, str(folder), path) == {"insert": 0, "update": 1, "skip": 1, "delete": 0}
    assert [r["section_title"] for r in I.current_chunks(spark, path).where("source = 'b.md'").orderBy("chunk_index").collect()] == ["B2", "C"]
    # deleted, and back
    (folder / "b.md").unlink()
    assert I.sync_folder(spark, str(folder), path) == {"insert": 0, "update": 0, "skip": 1, "delete": 1}
    assert {r["source"] for r in I.current_chunks(spark, path).collect()} == {"第一指南.md"}
    write(folder, "b.md", f"# B2\n{body}\n# C\n{body}")
    assert I.sync_folder(spark, str(folder), path)["insert"] == 1 and I.current_chunks(spark, path).where("source = 'b.md'").count() == 2


def test_ingest_stream_takes_each_file_once(spark, tmp_path):
    folder, path = tmp_path / "docs", str(tmp_path / "store")
    folder.mkdir()
    for i in range(3):
        write(folder, f"d{i}.md", f"# T{i}\n" + "text of some length " * 5)
    for turn in range(2):
        I.ingest_stream(spark, str(folder), path, str(tmp_path / f"checkpoint{turn}"), files_per_batch=2)  # a lost checkpoint too
        assert I.current_chunks(spark, path).count() == 3 and I.manifest(spark, path).count() == 3
    write(folder, "d9.md", "# T9\n" + "text of some length " * 5)
    I.ingest_stream(spark, str(folder), path, str(tmp_path / "checkpoint1"), files_per_batch=2)
    assert I.current_chunks(spark, path).count() == 4


def test_texts_leave_batches_bit_by_bit(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from stratiform.functions.batches import by_text, sliced

    texts = ["a" * 10, None, "é" * 10, "", "b" * 50, "c", None]
    parts = [p.to_pylist() for p in sliced(pa.array(texts).slice(1), 20)]
    assert parts == [[None, "é" * 10, ""], ["b" * 50], ["c", None]]
    assert list(sliced(pa.array([], pa.string()))) == []
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * (i * 997 % 40000)) for i in range(600)], "i int, t string").coalesce(1)
    length = by_text(lambda t: None if t is None else len(t), pa.int64(), "long")
    assert df.where(~length(F.col("t")).eqNullSafe(F.length("t").cast("long"))).count() == 0


def test_lines_are_marked_in_slices(spark, monkeypatch):
    import pyarrow as pa
    from stratiform.functions import batches

    seen = []
    monkeypatch.setattr(C, "by_text", lambda f, kind, returns: seen.append((f, kind)) or batches.by_text(f, kind, returns))
    docs = spark.createDataFrame([(1, "# 目录\na..1\nb"), (2, None), (3, "x\n* 3 -\ny")], "doc_id int, text string")
    assert {r["doc_id"]: r["content"] for r in C.cleaned(docs, []).collect()} == {1: "b", 3: "x\ny"}
    f, kind = seen[0]
    assert pa.array([f("a\nb"), f(None)], kind).to_pylist() == [[{"pos": 1, "line": "a", "kept": False}, {"pos": 2, "line": "b", "kept": False}], []]
