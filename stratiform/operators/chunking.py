"""Long chunks split by what they hold: HTML tables by row, code by a summary, text by the coarsest separator."""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratiform.functions.batches import by_text
from stratiform.functions.text import strip_comments
from stratiform.operators.text import LIMIT, OVERLAP, blank_after_headings, merge_heading_pairs, split_text

#: Share of the limit beyond which code is told of and not kept (a fixed value), and what is left free for the words.
CODE_SHARE, CODE_ROOM = 0.7, 100
CODE, ROW = re.compile(r"```[\s\S]*?```"), re.compile(r"<tr>.*?</tr>", re.S)
#: Ending of the title of what follows a table, where it is split itself.
AFTER_TABLE = " (后缀)"

Part = tuple[int, str, bool]
PARTS = pa.list_(pa.struct([("i", pa.int32()), ("t", pa.string()), ("after", pa.bool_())]))
LINES = pa.list_(pa.struct([("pos", pa.int32()), ("line", pa.string()), ("kept", pa.bool_())]))


def split_code(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Part]:
    """A text with much code becomes its other text and one line about the code; else it is split as text."""
    blocks = [m.end() - m.start() for m in CODE.finditer(text)]
    length = sum(blocks)
    if length <= limit * CODE_SHARE:
        return [(i, t, False) for i, t in enumerate(split_text(text, limit, overlap))]
    note = f"[代码块摘要: {len(blocks)} 个代码块, 共 {length} 字符]"
    rest = CODE.sub("", text).strip()
    if rest:
        note = f"{rest[: max(0, limit - len(note) - CODE_ROOM)]}\n\n{note}"
    return [(0, note[:limit], False)]


def split_html_table(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Part]:
    """Rows of an HTML table in pieces of about ``limit`` characters, its first row on each, text before it on the first.

    The first piece is closed once a row would pass the limit and it holds more than its own text;
    the last is cut at the limit. What follows the table is a piece of its own, or several.
    """
    start, close = text.find("<table>"), text.rfind("</table>")
    end = close + len("</table>") if close >= 0 else len(text)
    before, after, table = text[:start].strip(), text[end:].strip(), text[start:end]
    rows = ROW.findall(table)
    if not rows:
        return [(0, text[:limit], False)]
    head, body = rows[0], rows[1:] or rows
    out: list[Part] = []
    held = f"{before}\n<table>{head}"
    for row in body:
        if len(held) + 1 + len(row) > limit and len(held) > len(before) + 10:
            out.append((len(out), f"{held}\n</table>", False))
            held = f"<table>{head}"
        held += f"\n{row}"
    out.append((len(out), f"{held}\n</table>"[:limit], False))
    if len(after) > limit:
        out += [(i, t, True) for i, t, _ in (split_code if "```" in after else split_text_parts)(after, limit, overlap)]
    elif after:
        out.append((len(out), after, False))
    return out


def split_text_parts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Part]:
    return [(i, t, False) for i, t in enumerate(split_text(text, limit, overlap))]


def split_long(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Part] | None:
    """Parts (number, text, whether it follows a table) of a chunk beyond the limit, null for a shorter one."""
    if len(text) <= limit:
        return None
    if "<table>" in text:
        return split_html_table(text, limit, overlap)
    return (split_code if CODE.search(text) else split_text_parts)(text, limit, overlap)


def long_chunks_split(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, chunk: str = "chunk_id", title: str = "section_title", content: str = "content") -> DataFrame:
    """Chunks, those beyond ``limit`` characters as their parts; other columns stay, ``part`` tells the place.

    A part's id is its chunk's with its number, its title says which part it is from the second
    on; ``parent_chunk_id`` names the chunk, null where nothing was split. Null content is empty.
    """

    def split(t: str | None) -> list[dict] | None:
        return None if t is None or (p := split_long(t, limit, overlap)) is None else [{"i": i, "t": x, "after": a} for i, x, a in p]

    parts = by_text(split, PARTS, "array<struct<i:int,t:string,after:boolean>>")
    long = F.length(content) > limit
    short = chunks.where(~F.coalesce(long, F.lit(False))).withColumns({"part": F.lit(None).cast("int"), "parent_chunk_id": F.lit(None).cast("string"), "char_count": F.coalesce(F.length(content), F.lit(0))})
    cut = chunks.where(long).withColumn("_p", parts(F.col(content))).select("*", F.posexplode("_p").alias("part", "_x")).drop("_p")
    base = F.concat(F.coalesce(title, F.lit("")), F.when(F.col("_x.after"), F.lit(AFTER_TABLE)).otherwise(F.lit("")))
    name = F.when(F.col("_x.i") > 0, F.concat(base, F.lit(" (部分"), (F.col("_x.i") + 1).cast("string"), F.lit(")"))).otherwise(base)
    new = {"parent_chunk_id": F.col(chunk).cast("string"), title: name, content: F.col("_x.t"), chunk: F.concat_ws("_", chunk, F.col("_x.i").cast("string")), "char_count": F.length("_x.t")}
    cut = cut.withColumns(new).drop("_x")
    return short.withColumn(chunk, F.col(chunk).cast("string")).unionByName(cut)


# Noise lines, fields of metadata lines, lines at the head of a text that may be such.
NOISE = r"^\*\s*\d+\s*[-—]\s*$|^!\[image\]"
HEAD_LINES = 20


def marked_lines(text: str, heading: str, most: int) -> list[tuple[int, str, bool]]:
    """Lines (number from 1, line, whether it stays whatever it holds) without tables of contents.

    Fences and code stay, and so does the line that ends a table of contents unless that is ended
    by its length. Numbers count all lines of the text.
    """
    out: list[tuple[int, str, bool]] = []
    code, depth, seen = False, 0, 0
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if s.startswith("```") or code:
            code ^= s.startswith("```")
            out.append((n, line, True))
            continue
        if opening := re.match(heading, s, re.I):
            depth, seen = len(opening[1]), 0
            continue
        if depth:
            seen += 1
            mark = re.match(r"(#+)\s", s)
            if seen > most:
                depth = 0
            elif (mark and len(mark[1]) > depth) or (not mark and ".." in s):
                continue
            else:
                depth = 0
                out.append((n, line, True))
                continue
        out.append((n, line, False))
    return out


def cleaned(docs: DataFrame, metadata_fields: list[str], heading: str = r"^(#+)\s*目\s*[录次]", most: int = 50) -> DataFrame:
    """(doc_id, content): documents without comments, tables of contents, noise, metadata lines at their head and blank lines.

    Headings that are a number only are joined with the next of their level, and a heading that no
    other follows gets a blank line after it. Where a table of contents ends depends on what was
    read, so lines are marked by a small function for each text; all else are windows over lines.
    Documents without a line left have no row.
    """
    def marked(t: str | None) -> list[dict]:
        return [] if t is None else [{"pos": n, "line": x, "kept": k} for n, x, k in marked_lines(t, heading, most)]

    mark = by_text(marked, LINES, "array<struct<pos:int,line:string,kept:boolean>>")
    rows = docs.select("doc_id", F.explode(mark(strip_comments(F.col("text")))).alias("x")).select("doc_id", "x.pos", "x.line", "x.kept")
    s = F.regexp_replace("line", r"^\s+|\s+$", "")
    fields = "^(?:" + "|".join(re.escape(f) for f in metadata_fields) + ")[：:]"
    drop = s.rlike(NOISE) | ((F.col("pos") <= HEAD_LINES) & s.rlike(fields)) if metadata_fields else s.rlike(NOISE)
    return blank_after_headings(merge_heading_pairs(rows.where(F.col("kept") | ~drop).drop("kept")))
