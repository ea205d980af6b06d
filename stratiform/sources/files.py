"""Document files: type detection, encodings, text of HTML and DOCX, recursive directories."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Extensions by kind, encodings in the order they are tried.
KINDS = {
    "document": ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "md", "html", "htm"),
    "geojson": ("geojson", "json"),
    "shapefile": ("shp", "zip"),
    "kml": ("kml", "kmz"),
    "gis_file": ("gdb", "gpkg", "gml"),
}
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")
SKIPPED = {"script", "style", "nav", "footer", "header"}
LEAST = 10


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column) -> Column:
    """document, geojson, shapefile, kml or gis_file by extension, else unknown."""
    ext = extension(path)
    out = None
    for kind, extensions in KINDS.items():
        out = F.when(ext.isin(*extensions), kind) if out is None else out.when(ext.isin(*extensions), kind)
    return out.otherwise("unknown")


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in SKIPPED and self.skip > 0

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    return "\n".join(p.parts)


def docx_to_text(data: bytes) -> str:
    """Paragraphs, and table rows with their cells joined by a bar."""
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
    text_of = lambda x: "".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", x))
    out = []
    for m in re.finditer(r"<w:tbl>.*?</w:tbl>|<w:p[ >].*?</w:p>", xml, re.S):
        if m.group().startswith("<w:tbl>"):
            for row in re.findall(r"<w:tr[ >].*?</w:tr>", m.group(), re.S):
                out.append(" | ".join(text_of(c) for c in re.findall(r"<w:tc>.*?</w:tc>|<w:tc .*?</w:tc>", row, re.S)))
        else:
            out.append(text_of(m.group()))
    return "\n".join(x for x in out if x.strip())


def parse(name: str, data: bytes) -> str:
    ext = name.rsplit(".", 1)[-1].lower()
    if ext == "docx":
        return docx_to_text(data)
    text = decode(data)
    return html_to_text(text) if ext in ("html", "htm") else text


def texts_of(files: DataFrame) -> DataFrame:
    """(path, kind, content_hash, text, error) of files (path, content): parsed and hashed in one pass.

    A bad file spoils no other: its error is its result. Texts of fewer than ``LEAST`` characters
    between blanks are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"]):
                digest = hashlib.md5(data).hexdigest()
                try:
                    rows.append((name, digest, parse(name, data), None))
                except Exception as e:  # the error is the row's result
                    rows.append((name, digest, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "text", "error"])

    parsed = files.select("path", "content").mapInPandas(run, "path string, content_hash string, text string, error string")
    out = parsed.withColumn("kind", file_kind(F.col("path")))
    return out.filter(F.col("error").isNotNull() | (F.length(F.trim("text")) >= LEAST)).select("path", "kind", "content_hash", "text", "error")


def read_directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``texts_of`` all files below a directory."""
    return texts_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))
