"""Documents as lines, headings and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratiform.functions import text as X

SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")
LIMIT, OVERLAP = 5000, 200


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line), from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def clean_lines(rows: DataFrame, noise: str, metadata: str, head: int = 20) -> DataFrame:
    """Drop blank and noise lines, metadata lines among the first ``head``, and everything in code fences stays as it is."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    fence = F.col("line").rlike("^\\s*```").cast("int")
    marked = rows.withColumn("in_code", (F.sum(fence).over(w.rowsBetween(Window.unboundedPreceding, 0)) - fence) % 2 == 1)
    drop = (F.trim("line") == "") | F.col("line").rlike(noise) | ((F.col("pos") < head) & F.col("line").rlike(metadata))
    return marked.filter(F.col("in_code") | ~drop)


def heading_paths(rows: DataFrame) -> DataFrame:
    """Heading level of each line, and the titles of the section it stands in: h1 to h4, reset by higher ones."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("level", X.heading_level(F.col("line"))).withColumn("_title", F.regexp_replace("line", r"^#+\s*", ""))
    for n in range(1, 5):
        at = F.when(F.col("level") <= n, F.struct("pos", F.when(F.col("level") == n, F.col("_title")).alias("t")))
        out = out.withColumn(f"h{n}", F.last(at, ignorenulls=True).over(w)["t"])
    return out.drop("_title")


def sections(rows: DataFrame) -> DataFrame:
    """Text from each heading to the next: (doc_id, section, title path, content)."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = heading_paths(rows).withColumn("section", F.count("level").over(w))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    path = F.filter(F.array("h1", "h2", "h3", "h4"), lambda x: x.isNotNull())
    return numbered.groupBy("doc_id", "section").agg(F.first(path, ignorenulls=True).alias("path"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("content"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs with text, numbered with the empty ones counted."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n\n|\n", -1)).alias("chunk_index", "content"))
    return p.filter(F.trim("content") != "")


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the coarsest separator that occurs, again where a piece is too long, and join short pieces up to the limit."""
    if len(text) <= limit:
        return [text] if text else []
    sep = next((s for s in separators if s and s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    pieces = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]] if sep else [text[i : i + limit] for i in range(0, len(text), limit)]
    out: list[str] = []
    held = ""
    for piece in pieces:
        if len(piece) > limit:
            if held.strip():
                out.append(held)
            held = ""
            out += split_text(piece, limit, overlap, finer or ("",))
        elif len(held) + len(piece) > limit:
            out.append(held)
            tail = held[-overlap:] if overlap and overlap + len(piece) <= limit else ""
            held = tail + piece
        else:
            held += piece
    if held.strip():
        out.append(held)
    return out


def split_table(text: str, limit: int = LIMIT) -> list[str]:
    """Rows of a Markdown table in pieces of at most ``limit`` characters (if a row fits), the header on each."""
    rows = text.split("\n")
    head = "\n".join(rows[:2]) if len(rows) > 1 and set(rows[1].replace("|", "").strip()) <= set("-: ") else ""
    body = rows[2:] if head else rows
    out, held = [], head
    for row in body:
        if held and len(held) + 1 + len(row) > limit and held != head:
            out.append(held)
            held = head
        held = f"{held}\n{row}" if held else row
    return [*out, held] if held != head or not out else out


def chunks(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, title, content): texts beyond ``limit`` are split by their kind."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                table = text is not None and "|" in text and "---" in text
                parts = split_table(text, limit) if table else split_text(text or "", limit, overlap)
                rows += [(doc_id, i, p) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content"])

    out = docs.select("doc_id", "text").mapInPandas(split, "doc_id long, chunk_index int, content string")
    title = F.when(F.col("chunk_index") > 0, F.concat(F.lit("(部分"), (F.col("chunk_index") + 1).cast("string"), F.lit(")"))).otherwise("")
    return out.select("doc_id", "chunk_index", X.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), title.alias("title"), "content")


def placeholders(chunk_rows: DataFrame) -> DataFrame:
    """Missing ancestor paths of chunks (doc_id, path): each prefix that has no chunk of its own."""
    prefix = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    need = chunk_rows.filter(F.size("path") > 1).select("doc_id", F.explode(prefix).alias("path")).distinct()
    return need.join(chunk_rows.select("doc_id", "path"), ["doc_id", "path"], "left_anti")


# Titles that are a number only.
NUMBER_ONLY = r"^第(?:\d+|[一二三四五六七八九十]|十[一二三四五])[篇章节条]$"


def merge_heading_pairs(rows: DataFrame) -> DataFrame:
    """Join a Markdown heading that is a number only with the heading of its level right after it ("Chapter 1", "General").

    In a run of such headings the first takes the second, the third the fourth; blank lines are dropped before.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    mark, title = F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    r = rows.filter(F.trim("line") != "").withColumns({"_mark": mark, "_title": title})
    opens = (F.col("_mark") != "") & F.col("_title").rlike(NUMBER_ONLY) & F.coalesce(F.lead("_mark").over(w) == F.col("_mark"), F.lit(False))
    r = r.withColumns({"_next": F.lead("_title").over(w), "_opens": opens})
    # runs of openers: the odd ones of a run take the line after them
    start = F.when(F.col("_opens") & ~F.coalesce(F.lag("_opens").over(w), F.lit(False)), 1).otherwise(0)
    r = r.withColumn("_run", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_odd", F.col("_opens") & (F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("pos")) % 2 == 1))
    taken = F.coalesce(F.lag("_odd").over(w), F.lit(False))
    line = F.when(F.col("_odd"), F.concat_ws(" ", "_mark", "_title", "_next")).otherwise(F.col("line"))
    return r.withColumn("_taken", taken).filter(~F.col("_taken")).select("doc_id", "pos", line.alias("line"))


def blank_after_headings(rows: DataFrame) -> DataFrame:
    """Text of each document with a blank line after each heading that no other heading follows."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    heading = F.col("line").rlike("^#{1,6}")
    following = F.lead("line").over(w)
    out = rows.withColumn("line", F.when(heading & following.isNotNull() & ~following.rlike("^#{1,6}"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))  # the lines of one document
    return out.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("content"))


def table_numbers(rows: DataFrame, by: str, block: int = 1000) -> DataFrame:
    """Number tables (runs of rows with a bar) of each ``by``: (…, table_no) on the rows that are in one.

    Tables are numbered within documents; the numbers before come from prefix sums over ranges of
    ``block`` doc_ids and over the documents of a range, so no task sees all rows of a ``by``.
    """
    w = Window.partitionBy(by, "doc_id").orderBy("pos")
    r = rows.withColumn("in_table", F.col("line").contains("|"))
    start = F.col("in_table") & ~F.coalesce(F.lag("in_table").over(w), F.lit(False))
    r = r.withColumn("_no", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("in_table")
    per_doc = r.groupBy(by, "doc_id").agg(F.max("_no").alias("_t")).withColumn("_b", F.floor(F.col("doc_id") / block))
    before = lambda *p: F.coalesce(F.sum("_t").over(Window.partitionBy(by, *p[:-1]).orderBy(p[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = per_doc.groupBy(by, "_b").agg(F.sum("_t").alias("_t")).withColumn("_r", before("_b")).drop("_t")
    docs = per_doc.withColumn("_d", before("_b", "doc_id")).join(ranges, [by, "_b"]).select(by, "doc_id", (F.col("_d") + F.col("_r")).alias("_before"))
    return r.join(docs, [by, "doc_id"]).withColumn("table_no", F.col("_no") + F.col("_before")).drop("_no", "_before")


def markdown_tables(rows: DataFrame, longest_name: int = 60) -> DataFrame:
    """(doc_id, table_no, name, headers, rows) of the Markdown tables in lines (doc_id, pos, line).

    A table is a run of lines that start with a bar; its first one that is no rule is the header,
    a rule right after that is left out, and the others are rows of their cells with text. The
    name is the nearest line before that has text and starts with neither bar nor hyphen. Tables
    without a header or a row are none.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = F.regexp_replace("line", r"^\s+|\s+$", "")
    r = rows.select("doc_id", "pos", s.alias("s")).withColumn("bar", F.col("s").startswith("|"))
    start = F.when(F.col("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False)), 1).otherwise(0)
    title = F.when((F.col("s") != "") & ~F.col("bar") & ~F.col("s").startswith("-"), F.substring("s", 1, longest_name))
    r = r.withColumns({"run": F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)), "name": F.coalesce(F.last(title, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))}).where("bar")
    by = Window.partitionBy("doc_id", "run").orderBy("pos")
    r = r.withColumn("head", F.min(F.when(~F.col("s").startswith("|---"), F.col("pos"))).over(Window.partitionBy("doc_id", "run"))).where("pos >= head")
    r = r.withColumn("n", F.row_number().over(by)).where(~((F.col("n") == 2) & F.col("s").rlike(r"^\|[\s\-:]+\|")))
    cells = F.filter(F.transform(F.split("s", r"\|", -1), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    r = r.withColumn("cells", cells)
    body = F.array_sort(F.collect_list(F.when((F.col("n") > 1) & (F.size("cells") > 0), F.struct("pos", "cells"))))  # the rows of one table
    t = r.groupBy("doc_id", "run").agg(F.min_by("name", "pos").alias("name"), F.min_by("cells", "pos").alias("headers"), F.transform(body, lambda x: x["cells"]).alias("rows"))
    t = t.where((F.size("headers") > 0) & (F.size("rows") > 0))
    return t.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("run"))).select("doc_id", "table_no", "name", "headers", "rows")


# The heading of a table of contents, and lines after which one ends anyway.
CONTENTS, MOST_CONTENTS = r"^(#+)\s*目\s*[录次]", 50


def without_contents(lines: list[str], heading: str = CONTENTS, most: int = MOST_CONTENTS) -> list[str]:
    """Lines without tables of contents.

    A table runs from its heading over deeper headings and dotted lines; another line, a heading
    of its level or above, or ``most`` lines end it. Lines in code fences are never part of one.
    """
    out, depth, seen, code = [], 0, 0, False
    for line in lines:
        s = line.strip()
        fence = s.startswith("```")
        code ^= fence
        if fence or code:
            out.append(line)
        elif opening := re.match(heading, s):
            depth, seen = len(opening[1]), 0
        else:
            seen += 1
            mark = re.match(r"#+(?=\s)", s)
            if depth and seen <= most and (".." in s or mark) and not (mark and len(mark[0]) <= depth):
                continue
            depth = 0
            out.append(line)
    return out


def drop_contents(text: Column) -> Column:
    """A text without its tables of contents (a pandas function: where one ends depends on what was read)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else "\n".join(without_contents(t.split("\n"))))

    return run(text)
