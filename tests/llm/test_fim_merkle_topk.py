"""Fill-in-the-middle, Merkle manifest and exact top-k against brute force, with their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.llm import op11_fill_in_middle as op11, op12_merkle as op12, op13_exact_topk as op13

#: Columns beyond those of the table bear names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, place long, n int, h1 int, form string, key int, tree int"
EXTRA = ("x", 1, 2, 3, "y", 4, 5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    r = random.Random(4)
    letters = "abc XYZ\n<>PSMé你\U0001f600́"
    rows = [(0, None), (1, ""), (2, "a"), (3, "\U0001f600"), (4, "has <P> inside"), (5, "<S>"), (6, "x<M>"), (7, "<P<S<M"), (None, "no id"), (None, None), (8, "é" * 300_000 + "end"), (9, "<")]
    rows += [(10 + i, "".join(r.choice(letters) for _ in range(r.choice([1, 3, 30, 3000])))) for i in range(200)]
    return rows + rows[:4] + rows[20:23]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, ["s1", "s1", None, "", "é", "Z"][(i or 0) % 6 if (i or 0) < 100 else 1], len(t or "") or None, *EXTRA) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("every,block", [(1, 1), (2, 3), (5, 64), (1024, 1 << 20)])
def test_checkpoints_find_every_code_point(every, block):
    for _, t in texts():
        t = (t or "")[:400]
        c = op11.Checkpoints(t.encode(), every, block)
        assert c.n == len(t)
        assert [c.byte_of(i) for i in range(len(t) + 1)] == [len(t[:i].encode()) for i in range(len(t) + 1)]
        assert len(c.units) == -(-len(t) // every)


def fim(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, empty):
    made = op11.fill_in_middle(docs, every=7)
    got = made.withColumn("back", op11.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, t or "", *fim(i, t)) for i, t in texts()), key=str)
    assert sorted(((r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert op11.fill_in_middle(empty).count() == 0
    assert all(r["form"] == "plain" for r in op11.fill_in_middle(docs, fim_percent=0).collect())


def test_levels_and_fold():
    r = random.Random(2)
    for n in [1, 2, 3, 4, 5, 9, 16, 17, 27, 28, 100]:
        digests = [sha(str(r.random())) for _ in range(n)]
        levels = op12.levels_of(n, 3)
        tree = op12.collapse(digests, levels, 3)
        assert len(tree[-1]) == 1
        proofs = op12.lower_proofs(tree, "", 3)
        assert [op12.fold(d, p, [(i, n)], 3) for i, (d, p) in enumerate(zip(digests, proofs))] == tree[-1] * n


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """Root and, for each node, its siblings' digests in order and the root of a changed node."""
    proofs, fold = [""] * len(nodes), [lambda x: x] * len(nodes)
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, group = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k, m in enumerate(members[at : at + fanout]):
                left, right = "".join(run[:k]), "".join(run[k + 1 :])
                for i in m:
                    proofs[i] += left + right
                    fold[i] = lambda x, f=fold[i], a=left, b=right: sha(a + f(x) + b)
            up.append(sha("".join(run)))
            group.append([i for m in members[at : at + fanout] for i in m])
        nodes, members = up, group
    return nodes[0] if nodes else None, proofs, fold


def merkle(rows, fanout):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    first = lambda x: (x is not None, (x or "").encode())
    names = sorted(by, key=first)
    trees = {}
    for name in names:
        own = sorted(by[name], key=lambda x: (x[0] is not None, x[0] or 0, leaf(x)))
        trees[name] = (own, *climb([leaf(x) for x in own], fanout))
    root, over, lift = climb([trees[n][1] for n in names], fanout)
    out = []
    for g, name in enumerate(names):
        own, sub, proofs, fold = trees[name]
        for row, proof, f in zip(own, proofs, fold):
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4]:
                now = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            back = lift[g](f(leaf(now)))
            out.append((row[0], leaf(row), sub, root, sha(proof + over[g]), back, back == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,levels", [(2, 2), (3, 1), (16, 3)])
def test_manifest_against_a_plain_tree(spark, docs, empty, fanout, levels):
    rows = [tuple(r) for r in docs.select(op12.FIELDS).collect()]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(op12.crc_of_id("doc_id") % 5 == 0, op12.leaf_hash([low if c == "text" else F.col(c) for c in op12.FIELDS]))
    proved = op12.manifest(docs.withColumn("leaf2", changed), keep=["leaf2"], fanout=fanout, levels=levels)
    got = op12.folded(proved.withColumn("now", F.coalesce("leaf2", "leaf")), "now", fanout=fanout).collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert sorted((tuple(r[n] for n in names) + (r["folded_root"] == r["root"],) for r in got), key=str) == merkle(rows, fanout)
    assert op12.manifest(empty, fanout=fanout, levels=levels).count() == 0


def test_manifest_of_one_row_and_of_one_group(spark):
    one = spark.createDataFrame([(7, "t", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = op12.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == leaf((7, "s", None, 1, "t")) and r["proof"] == ""
    many = one.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("doc_id"), "text", "lang", "source", "n_chars")
    got = op12.manifest(many).collect()
    assert len({r["root"] for r in got}) == 1 and all(r["subroot"] == r["root"] for r in got)


def brute(rows, k):
    """Rows as (id, vector); exact integers, ties by id, null last."""
    ok = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is None or i % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, m) for m, j, c in ok if m != n)
        out += [(i, rank + 1, None if f[1] else f[2], -f[0]) for rank, f in enumerate(found[:k])]
    return sorted(out, key=str)


def answers(frame):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect()), key=str)


def test_topk_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.normal(size=24) * (r.random(24) < 0.4)]) for i in r.permutation(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(1020, None), (1040, [None, 1.0]), (1060, [float("nan")]), (1080, [float("inf")]), (1100, []), (1120, [0.5, -2.0]), (None, rows[5][1]), (None, None), (20, rows[7][1]), (20, rows[7][1])]
    x = spark.createDataFrame([(i, v, "l", 5, 6) for i, v in rows], "vec_id long, embedding array<float>, label string, row int, score int").repartition(4)
    asked = F.col("vec_id") % 20 == 0
    assert answers(op13.top_k(x, asked, k=7)) == brute(rows, 7)
    monkeypatch.setattr(op13, "CANDIDATES", 50)
    monkeypatch.setattr(op13, "QUERIES", 5)
    assert answers(op13.top_k(x, asked)) == brute(rows, 20)
    assert answers(op13.top_k(x, asked, k=1000)) == brute(rows, 1000)
    assert op13.top_k(x.limit(0), asked).count() == 0


def test_blocks_of_any_width_are_exact():
    r = np.random.default_rng(1)
    for size in (10, 10**6, 10**10, 2**62):
        q = r.integers(-size, size, (20, 6)) * (r.random((20, 6)) < 0.3)
        v = r.integers(-size, size, (90, 6)) * (r.random((90, 6)) < 0.3)
        v[40:60] = v[3]
        rows, at, score = op13.search_block(q, np.arange(20), v, np.arange(90), 5)
        for i in range(20):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], v[j])), j) for j in range(90) if j != i)[:5]
            assert [(-int(s), int(a)) for a, s in zip(at[rows == i], score[rows == i])] == want
