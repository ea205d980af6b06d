"""Fill-in-the-middle transformation, with cuts found through a sparse checkpoint index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm.common import documents, slices

#: Code points from one checkpoint to the next.
EVERY = 1024
#: Bytes that are counted at once, so that a very long text needs little memory besides itself.
BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of the documents that are rearranged, and of those the percent with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = "1"


class Checkpoints:
    """Code points of a UTF-8 text: their number, and the byte offset of every ``EVERY``-th one.

    Counting goes over the bytes once, block by block, and notes the byte offset of each code
    point whose number is a multiple of ``every``. ``byte_of`` finds the last checkpoint at or
    before a code point by binary search, and counts on from there over ``every`` code points at
    most. Bytes that continue a code point are those of the form 10xxxxxx.
    """

    def __init__(self, text: bytes, every: int = EVERY, block: int = BLOCK) -> None:
        self.every, self.data = every, np.frombuffer(text, np.uint8)
        units, at, seen = [], [], 0
        for start in range(0, len(self.data), block):
            lead = np.flatnonzero((self.data[start : start + block] & 0xC0) != 0x80)
            first = -seen % every
            if first < len(lead):
                at.append(lead[first::every] + start)
                units.append(np.arange(seen + first, seen + len(lead), every))
            seen += len(lead)
        self.n = seen
        self.units = np.concatenate(units) if units else np.zeros(0, np.int64)
        self.bytes = np.concatenate(at) if at else np.zeros(0, np.int64)

    def byte_of(self, unit: int) -> int:
        """Byte offset of the code point of that number; the end of the text for number ``n``."""
        if unit >= self.n:
            return len(self.data)
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        start = int(self.bytes[k])
        near = self.data[start : start + 4 * self.every]
        return start + int(np.flatnonzero((near & 0xC0) != 0x80)[unit - int(self.units[k])])


def _draw(k: int, seed: str) -> F.Column:
    """The k-th group of 8 hexadecimal digits of the sha256 of seed, colon and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")


def fill_in_middle(docs: DataFrame, seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, every: int = EVERY) -> DataFrame:
    """Cut every whole text into prefix, middle and suffix, and rearrange it for infilling.

    Returns doc_id, n (code points), form (``plain``, ``psm``, ``spm``), prefix_chars, middle_chars
    (null if plain) and output, the text with its marks. A null text is empty; empty texts and
    texts that hold a mark stay plain. Draws depend on doc_id alone, so reruns agree; a null
    doc_id draws as an empty one, rows repeated as they are come out repeated. Parts may be empty.
    Texts of any length are whole; extra columns are not read; an empty table gives no rows.
    No row leaves its partition: nothing is shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in MARKS)
        for batch in batches:
            for part in slices(batch, "text"):
                out, ns, forms, prefixes, middles = [], [], [], [], []
                draws = zip(*(part.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)))
                for text, (h1, h2, h3, h4) in zip(part.column("text").to_pylist(), draws):
                    index = Checkpoints(text, every)
                    n = index.n
                    ns.append(n)
                    if not n or h3 % 100 >= fim_percent or p in text or s in text or m in text:
                        out.append(text), forms.append("plain"), prefixes.append(None), middles.append(None)
                        continue
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    i, j = index.byte_of(a), index.byte_of(b)
                    pieces = (s, text[j:], p, text[:i], m, text[i:j]) if h4 % 100 < spm_percent else (p, text[:i], s, text[j:], m, text[i:j])
                    out.append(b"".join(pieces)), forms.append("spm" if pieces[0] == s else "psm"), prefixes.append(a), middles.append(b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).view(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *(_draw(k, seed) for k in (1, 2, 3, 4)))
    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text before rearrangement, from output and form alone: marks occur nowhere else."""
    parts = F.split(output, "|".join(MARKS), -1)
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every output and of the text restored from it."""
    made = fill_in_middle(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), x AS (
  SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM x
), o AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
