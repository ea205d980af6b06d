"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm.common import _BYTE, _P, _powers, documents, mix64

#: Bytes of a chunk: least, normal, most. Boundaries are hard before the normal size, easy after.
LEAST, NORMAL, MOST = 8, 32, 128
HARD_BITS, EASY_BITS = 6, 3
#: Bytes that a gear hash sees: one bit of shift each.
WINDOW = 32
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def chunk_ends(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut every byte string: (document of each chunk, its first byte, its end), in one padded array.

    The gear hash of a byte covers the ``WINDOW`` bytes up to it and none of another string, by
    padding. All strings are cut in step, each step finding the next boundary of all of them.
    """
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(lens + WINDOW) - lens
    data = np.zeros(int((lens + WINDOW).sum()), np.uint8)
    pad = bytes(WINDOW)
    joined = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8)
    data[: len(joined)] = joined
    inside = np.ones(len(data), bool)
    for k in range(WINDOW):
        inside[starts - WINDOW + k] = False
    h = np.where(inside, _GEAR[data], np.uint32(0))
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    easy = np.flatnonzero((h >> np.uint32(32 - EASY_BITS) == 0) & inside) + 1
    hard = np.flatnonzero((h >> np.uint32(32 - HARD_BITS) == 0) & inside) + 1
    far = len(data) + MOST
    easy, hard = np.append(easy, far), np.append(hard, far)
    live = np.flatnonzero(lens > 0)
    at, stop = starts[live], (starts + lens)[live]
    docs, begins, ends = [], [], []
    while len(live):
        first = hard[np.searchsorted(hard, at + LEAST)]
        later = easy[np.searchsorted(easy, at + NORMAL)]
        end = np.where(first <= at + NORMAL, first, np.minimum(later, at + MOST))
        end = np.minimum(end, stop)
        docs.append(live)
        begins.append(at)
        ends.append(end)
        more = end < stop
        live, at, stop = live[more], end[more], stop[more]
    if not docs:
        z = np.zeros(0, np.int64)
        return z, z, data
    d, b, e = (np.concatenate(x) for x in (docs, begins, ends))
    order = np.argsort(b, kind="stable")
    return d[order], np.stack([b[order], e[order]]), data


def chunk_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted digests of its distinct chunks (48 bits) and their bytes in all."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    doc, spans, data = chunk_ends(raw)
    if not len(doc):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    fwd, inv = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * fwd[: len(data)], out=prefix[1:])
    b, e = spans
    digest = mix64((prefix[e] - prefix[b]) * inv[b] + (e - b).astype(np.uint64) * np.uint64(_P)) >> np.uint64(16)
    order = np.lexsort((digest, doc))
    doc, digest, size = doc[order], digest[order], (e - b)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
    total = np.add.reduceat(size, np.flatnonzero(new))
    doc, digest = doc[new], digest[new]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(digest[i:j], total[i:j]) for i, j in zip(cut, cut[1:])]


def fingerprint_text(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """Hexadecimal digest and decimal bytes of each distinct chunk, by digest; empty for no text."""
    return ",".join(f"{d:012x}:{n}" for d, n in zip(chunks[0].tolist(), chunks[1].tolist()))


def parse_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [p.split(":") for p in text.split(",") if p]
    return np.array([int(d, 16) for d, _ in pairs], np.uint64), np.array([int(n) for _, n in pairs], np.int64)


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of a's bytes in chunks that b has too, by the lesser weight; 1.0 if both are empty."""
    whole = int(a[1].sum())
    if not whole:
        return 1.0 if not len(b[0]) else 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return float(np.minimum(a[1][i], b[1][j]).sum()) / whole


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Rows dealt to a range, and the most ranges (the driver and each plan hold two numbers for each).
RANGE_ROWS, MOST_RANGES = 1500, 16384


def range_bounds(docs: DataFrame) -> list[int]:
    """Ascending bounds that deal doc_id into ranges of about equal rows, from a sketch of the ids."""
    parts = min(MOST_RANGES, -(-docs.count() // RANGE_ROWS))
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = docs.agg(F.percentile_approx("doc_id", at, 20 * MOST_RANGES).alias("b")).first()["b"] or []
    return sorted({int(x) for x in got})


def _numbers(values: list[int]) -> F.Column:
    """A literal array, as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(bounds: list[int]) -> F.Column:
    """Index of the range of doc_id, descending, null last: a search in two levels."""
    if not bounds:
        return F.lit(0)
    each = max(2, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    fine = F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";")
    not_above = lambda a: F.size(F.filter(a, lambda b: b <= F.col("doc_id")))
    coarse = F.greatest(not_above(_numbers([b[0] for b in blocks])), F.lit(1))
    table = F.transform(fine, lambda x: F.split(x, ",").cast("array<bigint>"))
    below = (coarse - 1) * each + not_above(F.element_at(table, coarse))
    return F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.lit(len(bounds)) - below)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare it with both neighbours.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. The next document is the one of the next lower doc_id, after the last the first;
    rows of one doc_id stand in the order of their texts, a null doc_id comes last. A null text
    is empty. Documents are dealt by ranges of doc_id, so each text is shuffled once; the largest
    of each range also goes to the range before, where it follows the last. An empty table
    gives no rows; a single document is its own next one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("part", _range_of(bounds))
    heads = {r["part"]: r["head"] for r in part.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    used = sorted(heads)  # ranges that have rows
    n = len(bounds) + 1
    before = {p: used[i - 1] for i, p in enumerate(used)}  # what follows the last is the first
    lead = _numbers([before.get(p, 0) for p in range(n)])
    top = _numbers([-1 if heads.get(p) is None else heads[p] for p in range(n)])
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    after = F.struct(F.element_at(lead, F.col("part") + 1).cast("int").alias("part"), F.lit(True).alias("tail"))
    no_id = [p for p in used if heads[p] is None]
    is_head = F.col("doc_id") == F.element_at(top, F.col("part") + 1)
    is_head = F.coalesce(is_head, F.col("part").isin(no_id) if no_id else F.lit(False))
    spread = rows.withColumn("part", _range_of(bounds)).select("doc_id", "text", F.explode(F.when(is_head, F.array(own, after)).otherwise(F.array(own))).alias("to"))
    dealt = spread.select("doc_id", "text", "to.part", "to.tail").repartition(n, "part")
    dealt = dealt.sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, str]] = []  # rows that wait for their next one
        size = 0
        part, closed = None, False

        def flush(rows: list[tuple[int, int | None, str]]) -> pa.RecordBatch:
            texts = [t for _, _, t in rows]
            own, nxt = texts[:-1], texts[1:]
            new = [edited(a, b) for a, b in zip(own, nxt)]
            sets = chunk_sets(texts + new)
            a, b, c = sets[: len(own)], sets[1 : len(texts)], sets[len(texts) :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for _, i, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]), pa.array([fingerprint_text(x) for x in a], pa.string()), pa.array([fingerprint_text(x) for x in c], pa.string()),
                    pa.array([containment(x, y) for x, y in zip(a, c)], pa.float64()), pa.array([containment(x, y) for x, y in zip(a, b)], pa.float64()),
                ],
                OUT_NAMES,
            )

        for batch in batches:
            parts, ids, texts, tails = (batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "tail"))
            for p, i, t, tail in zip(parts, ids, texts, tails):
                if p != part:
                    held, size, part, closed = [], 0, p, False
                if closed:
                    continue
                held.append((p, i, t))
                size += len(t)
                closed = tail
                if len(held) > 1 and (size > 1 << 20 or closed):
                    yield flush(held)
                    held, size = held[-1:], len(t)

    return dealt.mapInArrow(compute, ", ".join(f"{n} {t}" for n, t in zip(OUT_NAMES, OUT_TYPES)))


OUT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
OUT_TYPES = ["long", "long", "string", "string", "string", "double", "double"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
