"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

_FALLBACK: dict[str, str] = {}
#: Paths written by the ``tidy`` operators that are running, innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests), one temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if path:
        return path.rstrip("/")
    return _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="stratiform-"))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratiform_path = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """A table of ``materialize`` once more, with columns of its own for joins with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._stratiform_path)


def release(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that no later plan reads."""
    path = getattr(df, "_stratiform_path", None)
    if path:
        _delete(df.sparkSession, path)


def clean_shuffles(spark: SparkSession) -> None:
    """Let the driver collect plans that nobody holds: Spark deletes their shuffle files only then, by itself every 30 minutes at least."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write an operator's result to the shared folder, and delete all tables it has written on the way."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _OPEN.append([])
        spark, paths = None, _OPEN[-1]
        try:
            out = operator(*args, **kwargs)
            spark = out.sparkSession
            _OPEN.remove(paths)
            return materialize(out, operator.__name__)
        finally:
            _OPEN[:] = [x for x in _OPEN if x is not paths]
            if spark is not None:
                for path in paths:
                    _delete(spark, path)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text is about ``max_bytes``; one row is never cut."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (vectorised, wraps around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 62, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = 1 << max(16, int(n).bit_length())
        fwd, inv = np.full(size, _P, dtype=np.uint64), np.full(size, _P_INV, dtype=np.uint64)
        fwd[0] = inv[0] = 1
        _POWERS.update(n=size, fwd=np.multiply.accumulate(fwd), inv=np.multiply.accumulate(inv))
    return _POWERS["fwd"], _POWERS["inv"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word ``[^\\x20\\x09-\\x0D]+`` of every text, A-Z lowered.

    Returns (hash of each word, document index of each word, first byte and end byte of each
    word within its own document's UTF-8). One pass over the joined bytes; prefix sums of a
    polynomial over random byte values give each word's hash without a loop over words.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
    starts = np.concatenate([[0], np.cumsum(lens + 1)])[:-1].astype(np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", dtype=np.uint8)
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    fwd, inv = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * fwd[: len(data)], out=prefix[1:])
    h = mix64((prefix[end] - prefix[begin]) * inv[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(starts, begin, side="right") - 1
    return h, doc, begin - starts[doc], end - starts[doc]


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles: (hash, document, index of the first word).

    With ``short``, a document of fewer than ``k`` words yields its whole sequence as one.
    """
    n = len(words)
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : n - k + 1 + j]
        where = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        out = mix64(acc[where])
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            acc = np.zeros(len(few), dtype=np.uint64)
            for j in range(k - 1):
                has = counts[few] > j
                acc = np.where(has, acc * np.uint64(0xC2B2AE3D27D4EB4F) + words[np.minimum(first[few] + j, n - 1)], acc)
            acc = mix64(acc + counts[few].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            out, where = np.concatenate([out, acc]), np.concatenate([where, first[few]])
            order = np.argsort(where, kind="stable")
            out, where = out[order], where[order]
    return out, doc[where], where - first[doc[where]]


def distinct_per_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, value) pairs."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def crc_of_id(column: str) -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables from batches sorted by their first column (a long), cut only where it changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(0).to_numpy()
        at = int(np.searchsorted(x, x[-1]))
        if at or (held and held[0].column(0)[0].as_py() != x[0]):
            if at:
                held.append(batch.slice(0, at))
            # the open group may have ended before this batch
            yield pa.Table.from_batches(held)
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def grouped(rows: DataFrame, key: str, node: str, parts: int | None = None) -> DataFrame:
    """Groups of rows with an equal key and two nodes or more: (key, hub, node), the hub its least.

    Sorted partitions are scanned as streams, so a group may be of any size.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = last_node = None
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = last_key is None or k[0] != last_key
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            hub = np.where(at >= 0, n[at], last_hub if last_hub is not None else 0)
            again = np.zeros(len(k), bool)
            again[1:] = n[1:] == n[:-1]
            again[0] = last_node is not None and n[0] == last_node
            keep = (hub != n) & ~(again & ~new)
            last_key, last_hub, last_node = k[-1], hub[-1], n[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(hub[keep]), pa.array(n[keep])], [key, "hub", node])

    spread = rows.select(key, node)
    spread = spread.repartition(parts, key) if parts else spread.repartition(key)
    return spread.sortWithinPartitions(key, node).mapInArrow(scan, f"{key} long, hub long, {node} long")


def distinct_groups(groups: DataFrame, key: str) -> DataFrame:
    """(g, node, m): all nodes of groups (key, hub, node) and their number but the hub, once for groups of the very same nodes."""
    h = F.xxhash64("node")
    sums = [F.sum(h % (1 << 40)).alias("s"), F.sum(F.shiftright(h, 40)).alias("r")]
    hubs = groups.groupBy(F.col(key).alias("g")).agg(F.min("hub").alias("hub"), F.count(F.lit(1)).alias("m"), *sums)
    kept = materialize(hubs.groupBy("hub", "m", "s", "r").agg(F.min("g").alias("g")).select("g", "hub", "m"), "groups")
    rows = groups.select(F.col(key).alias("g"), "node").join(kept.select("g", "m"), "g")
    return rows.unionByName(kept.select("g", F.col("hub").alias("node"), "m"))


#: Words of 64 bits in a key filter: 2 MB, whatever the number of keys.
FILTER_WORDS = 1 << 18


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size that holds every key (a long) and some others by chance.

    Scans use it to leave out most rows before a join; the join itself decides. Where keys are so
    many that it fills up, it leaves nothing out and results stay the same.
    """
    k = F.col(column)
    word = F.pmod(F.shiftrightunsigned(k, 6), F.lit(FILTER_WORDS)).alias("w")
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b")
    got = keys.select(word, bit).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.int64).view(np.uint64)
    return (bitmap[(k >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)
