"""Text-quality scores: claims and their support, depth, overlap, response to feedback."""

from __future__ import annotations

import difflib
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Patterns of claims by kind; one sentence may hold several.
ENGLISH_CLAIMS = {"number": r"[0-9]", "law": r"(?i)license|rights", "clause": r","}
# Claims of planning texts (numbers with units, laws and articles, duty words).
CHINESE_CLAIMS = {
    "number": r"\d+\.?\d*[%米年公顷平方米]",
    "law": r"《[^》]+》|第[一二三四五六七八九十]+条|GB\s*\d+",
    "duty": "应|须|必须|不得|禁止|规定|要求|标准",
}
# Evidence in a claim that a context may hold, in the order in which it is looked for.
CHINESE_EVIDENCE = {"number": r"\d+\.?\d*", "law": r"《[^》]+》", "standard": r"GB\s*\d+|DB\s*\d+/\d+"}
# Marks of depth with their points, and words that count 0.5 and 0.2 each, up to 1.
CHINESE_DEPTH = {
    "marks": {r"\d+\.?\d*\s*[%米年公顷平方米]": 1.0, r"《[^》]+》": 0.5, r"GB\s*\d+|DB\s*\d+/\d+": 0.5},
    "methods": ["方法", "步骤", "流程", "计算", "分析", "评估", "指标"],
    "advice": ["应", "建议", "可", "宜", "需"],
}
# What a depth score is explained by (the word 指标 counts as a method, but does not explain).
CHINESE_REASONS = {r"\d+\.?\d*\s*[%米年公顷平方米]": "包含具体数值指标", r"《[^》]+》": "引用法规文件", r"GB\s*\d+|DB\s*\d+/\d+": "引用技术标准", "方法|步骤|流程|计算|分析|评估": "包含技术方法描述"}
NO_REASON = "缺乏具体技术内容"


def sentences(docs: DataFrame, stops: str, least: int) -> DataFrame:
    """(doc_id, pos, sentence) of at least ``least`` characters."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", stops, -1)).alias("pos", "s"))
    return parts.select("doc_id", "pos", F.trim("s").alias("sentence")).filter(F.length("sentence") >= least)


def claims(sents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A row for each kind of claim a sentence makes."""
    kinds = F.filter(F.array(*[F.when(F.col("sentence").rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())
    return sents.withColumn("kind", F.explode(kinds))


def support_rate(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Supported share of each document's claims, 1 where it makes none."""
    g = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.col("supported").cast("int")).alias("s"))
    out = docs.join(g, key, "left")
    return out.select(key, F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.round(F.coalesce(F.col("s") / F.col("n_claims"), F.lit(1.0)), 6).alias("faithfulness"))


def support(claim: Column, context: Column, evidence: dict[str, str] | None = None) -> Column:
    """The first evidence of a claim that its context holds: numbers, then laws, then standards; null if none does."""
    found = [F.filter(F.regexp_extract_all(claim, F.lit(p), F.lit(0)), lambda x: F.contains(context, x)) for p in (evidence or CHINESE_EVIDENCE).values()]
    return F.try_element_at(F.concat(*found), F.lit(1))


# What is said of evidence by name, and characters told to both sides of a number.
SAID = {"law": ("法规 ", " 在上下文中出现"), "standard": ("标准 ", " 在上下文中出现")}
BESIDE = 50


def support_evidence(claim: Column, context: Column, evidence: dict[str, str] | None = None, said: dict[str, tuple[str, str]] | None = None) -> Column:
    """What supports a claim, in words, null if nothing does.

    The first evidence that the context holds, kinds in order. A kind with words of its own
    (``said``) is told by them; a number by the line around the first place where it stands, with
    up to ``BESIDE`` characters to both sides.
    """
    said = SAID if said is None else said
    tell = []
    for kind, pattern in (evidence or CHINESE_EVIDENCE).items():
        found = F.try_element_at(F.filter(F.regexp_extract_all(claim, F.lit(pattern), F.lit(0)), lambda x: F.contains(context, x)), F.lit(1))
        if kind in said:
            tell.append(F.when(found.isNotNull(), F.concat(F.lit(said[kind][0]), found, F.lit(said[kind][1]))))
        else:
            # as a group of its own, the number is looked for as it stands: \Q and \E quote it
            around = F.concat(F.lit(f"(?d).{{0,{BESIDE}}}\\Q"), found, F.lit(f"\\E.{{0,{BESIDE}}}"))
            tell.append(F.when(found.isNotNull(), F.call_function("regexp_extract", context, around, F.lit(0))))
    return F.coalesce(*tell)


def depth(text: Column, rules: dict | None = None) -> Column:
    """1 to 5: points for the marks a text shows, for words of method and of advice."""
    rules = rules or CHINESE_DEPTH
    marks = sum((F.when(text.rlike(p), v).otherwise(0.0) for p, v in rules["marks"].items()), F.lit(1.0))
    return F.least(F.lit(5.0), marks + F.least(F.lit(1.0), hits(text, rules["methods"]) * 0.5) + F.least(F.lit(1.0), hits(text, rules["advice"]) * 0.2))


def depth_reason(text: Column, score: Column, reasons: dict[str, str] | None = None, none: str = NO_REASON) -> Column:
    """The score in words, with what speaks for it."""
    said = F.filter(F.array(*[F.when(text.rlike(p), F.lit(w)) for p, w in (reasons or CHINESE_REASONS).items()]), lambda x: x.isNotNull())
    listed = F.when(F.size(said) > 0, F.array_join(said, ", ")).otherwise(F.lit(none))
    return F.concat(F.lit("评分 "), F.format_number(score, 1), F.lit(" 分："), listed)


def tokens(text: Column, pattern: str = "[a-z]{3,}") -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set, 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0))).otherwise(0.0)


def hits(text: Column, words: Sequence[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def share(text: Column, words: Sequence[str], none: float) -> Column:
    """Share of words that occur, ``none`` for an empty list."""
    return hits(text, words) / len(words) if words else F.lit(none)


def removal(old: Column, new: Column, words: Sequence[str]) -> Column:
    """1 - new / old hits of unwanted words; may be negative where the new text has more."""
    a, b = hits(old, words), hits(new, words)
    return F.when(a > 0, 1 - b / F.nullif(a, F.lit(0))).when(b == 0, 1.0).otherwise(0.5)


def keyword_coverage(text: Column, expected: Sequence[str], forbidden: Sequence[str]) -> Column:
    return share(text, expected, 1.0) * (1 - share(text, forbidden, 0.0))


#: Most pairs of equal characters that are held at once; texts with more are compared by the standard library.
PAIRS = 4_000_000


def _equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, run) in order of i and j: equal characters that are not popular in ``b``, the run of such that ends there."""
    values, at, counts = np.unique(b, return_inverse=True, return_counts=True)
    rare = counts <= len(b) // 100 + 1 if len(b) >= 200 else np.ones(len(values), bool)
    places = np.flatnonzero(rare[at])
    order = places[np.argsort(b[places], kind="stable")]
    held = b[order]
    low = np.searchsorted(held, a, "left")
    many = np.searchsorted(held, a, "right") - low
    ends = np.cumsum(many)
    if len(ends) and ends[-1] > PAIRS:
        return None
    i = np.repeat(np.arange(len(a)), many)
    j = order[np.arange(len(i)) + np.repeat(low - ends + many, many)]
    used = many > 0
    before = lambda p, k: (i[p] >= k) & (j[p] >= k) & used[i[p] - k] & (a[i[p] - k] == b[j[p] - k])
    run, k, p = np.ones(len(i), np.int64), 1, np.arange(len(i))
    while len(p := p[before(p, k)]):
        run[p] += 1
        k += 1
        if k > 32:  # long runs: along each diagonal, from where it began
            line = np.lexsort((i, j - i))
            new = np.ones(len(i), bool)
            new[1:] = (np.diff((j - i)[line]) != 0) | (np.diff(i[line]) != 1)
            n = np.arange(len(i))
            run[line] = n - np.maximum.accumulate(np.where(new, n, 0)) + 1
            break
    return i, j, run


def matched(a: str, b: str, least: float = 0.0) -> int:
    """Characters in matching blocks of two texts, as ``difflib.SequenceMatcher`` counts them; 0 as soon as they stay below ``least``.

    Equal characters are paired once, and each part of the texts filters its parent's pairs. No part
    gives more than the shorter of its sides, so texts that have little in common are left early.
    """
    if min(len(a), len(b)) < least:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    pairs = _equal_pairs(x, y)
    if pairs is None:
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    total, left, parts = 0, min(len(a), len(b)), deque([(0, len(a), 0, len(b), pairs)])
    while parts and total + left >= least:
        alo, ahi, blo, bhi, (i, j, run) = parts.popleft()
        left -= min(ahi - alo, bhi - blo)
        s, t, size = alo, blo, 0
        if len(i):
            inside = np.minimum(run, np.minimum(i - alo, j - blo) + 1)
            best = int(inside.argmax())
            size = int(inside[best])
            s, t = int(i[best]) - size + 1, int(j[best]) - size + 1
        while s > alo and t > blo and a[s - 1] == b[t - 1]:
            s, t, size = s - 1, t - 1, size + 1
        while s + size < ahi and t + size < bhi and a[s + size] == b[t + size]:
            size += 1
        if not size:
            continue
        total += size
        for u, v, w, z in ((alo, s, blo, t), (s + size, ahi, t + size, bhi)):
            if u < v and w < z:
                lo, hi = np.searchsorted(i, (u, v))
                keep = np.flatnonzero((j[lo:hi] >= w) & (j[lo:hi] < z)) + lo
                # without a pair only what both sides begin with can match
                if len(keep) or a[u] == b[w]:
                    parts.append((u, v, w, z, (i[keep], j[keep], run[keep])))
                    left += min(v - u, z - w)
    return total if total >= least else 0


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratio of matching blocks (a pandas function: no built-in has it), 0 where it is below ``least``."""

    def ratio(p: str, q: str) -> float:
        both = len(p) + len(q)
        return 2.0 * matched(p, q, least * both / 2) / both if both else 1.0

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def change_degree(old: Column, new: Column) -> Column:
    """1 - similarity, with small changes raised to 0.3 and large ones to 1; 0 if both are empty or the new is."""
    d = 1 - similarity(old, new, 0.19)  # what is below 0.2 is a large change, whatever the number
    empty_old, empty_new = F.coalesce(F.length(old), F.lit(0)) == 0, F.coalesce(F.length(new), F.lit(0)) == 0
    return F.when(empty_new, 0.0).when(empty_old, 1.0).when(d < 0.1, 0.3).when(d > 0.8, 1.0).otherwise(d)


def feedback_response(old: Column, new: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Half coverage of wanted words, 0.3 removal of unwanted ones, 0.2 change; at most 1, 0 for an empty text."""
    total = 0.5 * share(new, positive, 0.5) + 0.3 * removal(old, new, negative) + 0.2 * change_degree(old, new)
    return F.when(F.coalesce(F.length(new), F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), total))
