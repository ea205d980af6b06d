"""Embedding near-duplicates: inverted lists, residual product codes, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stratiform.llm.common import materialize, reread, tidy
from stratiform.llm.components import connected_components

THRESHOLD = 0.95
#: Bounds of what is fitted and broadcast: vectors of the sample, inverted lists, codes of a subspace.
SAMPLE, MOST_LISTS, CODES = 32_768, 4_096, 64
#: Vectors aimed at in a list, and rows of a block of pairs (least, most).
LIST_ROWS, LEAST_BLOCK, MOST_BLOCK = 256, 128, 4_096


@dataclass
class Index:
    """Coarse centroids (k, d) and codebooks of their residuals (subspaces, codes, d / subspaces)."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[2]


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (c * c).sum(1)[None] - 2 * x @ c.T
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at] + (x * x).sum(1), 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([_nearest(x[i : i + 4096], c)[0] for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, lists: int, seed: int = 0) -> Index:
    """Fit on unit vectors of a bounded sample."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, max(1, lists), rng)
    rest = sample - centroids[_nearest(sample, centroids)[0]]
    d = sample.shape[1]
    m = next(m for m in (8, 4, 2, 1) if d % m == 0)
    books = []
    for part in np.split(rest, m, axis=1):
        book = _kmeans(part, CODES, rng, 6)
        books.append(np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)]))
    return Index(centroids, np.stack(books))


def encode(index: Index, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """List, codes, quantisation error and lists to probe of each unit vector.

    A vector within ``radius`` that lies in another list is beyond the plane midway between the
    two centroids, so lists whose plane is further off need no probe; all others are probed. Of
    two lists only the later one is probed, as each pair needs to be met once.
    """
    c = index.centroids
    d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
    home = d.argmin(1)
    gap = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * c @ c.T, 1e-12))
    plane = (d - d[np.arange(len(x)), home][:, None]) / (2 * gap[home])
    probe = plane <= radius + 1e-6
    probe &= np.arange(len(c))[None] >= home[:, None]
    probe[np.arange(len(x)), home] = True
    rest = x - c[home]
    codes = np.zeros((len(x), len(index.books)), np.uint8)
    error = np.zeros(len(x))
    for j, book in enumerate(index.books):
        codes[:, j], e = _nearest(rest[:, j * index.width : (j + 1) * index.width], book)
        error += e
    return home, codes, np.sqrt(error), [np.flatnonzero(p) for p in probe]


def block_links(index: Index, cell: int, members: dict, queries: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks of one list: (node, links, least node of its group) of each linked node.

    Distances come from one table of each query and the members' codes; a member stays if it may
    lie within the radius given its own quantisation error, so the table loses no link. The rest
    is compared exactly, in double precision.
    """
    radius = np.sqrt(2 - 2 * threshold) + 1e-5
    x, y = queries["unit"], members["unit"]
    rest = x - index.centroids[cell]
    i_all, j_all = [], []
    step = max(1, (1 << 21) // max(len(y), 1))
    limit = ((radius + members["error"]) ** 2).astype(np.float32) + np.float32(1e-4)
    for a in range(0, len(x), step):
        r = rest[a : a + step]
        dist = np.zeros((len(r), len(y)), np.float32)
        for j, book in enumerate(index.books):
            part = r[:, j * index.width : (j + 1) * index.width]
            table = ((part * part).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * part @ book.T).astype(np.float32)
            dist += table[:, members["codes"][:, j]]
        near = dist <= limit[None]
        # a pair of one list is met twice here: keep the order of its nodes
        near &= (queries["home"][a : a + step, None] != cell) | (queries["node"][a : a + step, None] < members["node"][None])
        i, j = np.nonzero(near)
        for b in range(0, len(i), 1 << 16):
            p, q = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)]
            cos = np.einsum("ij,ij->i", queries["raw"][p], members["raw"][q]) / (queries["norm"][p] * members["norm"][q])
            ok = cos >= threshold
            i_all.append(p[ok])
            j_all.append(q[ok])
    i = np.concatenate(i_all) if i_all else np.zeros(0, np.int64)
    j = np.concatenate(j_all) if j_all else np.zeros(0, np.int64)
    if not len(i):
        z = np.zeros(0, np.int64)
        return z, z, z
    nodes, inverse = np.unique(np.concatenate([queries["node"][i], members["node"][j]]), return_inverse=True)
    a, b = inverse[: len(i)], inverse[len(i) :]
    links = np.bincount(a, members["n"][j], len(nodes)) + np.bincount(b, queries["n"][i], len(nodes))
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, links.astype(np.int64), nodes[label]


def _decode(raw: pa.Array, dtype: str) -> np.ndarray:
    data = b"".join(raw.to_pylist())
    return np.frombuffer(data, dtype).astype(np.float64).reshape(len(raw), -1)


def _links(nodes: DataFrame, threshold: float, dtype: str) -> DataFrame:
    """(node, links, root) of distinct vectors (node, n, raw) of one length: a row for each block in which a node has links."""
    spark = nodes.sparkSession
    total = nodes.count()
    share = min(1.0, SAMPLE / total)
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < F.lit(int(np.ceil(share * (1 << 20))))).select("raw").limit(2 * SAMPLE).collect()
    sample = np.frombuffer(b"".join(bytes(r["raw"]) for r in picked), dtype).astype(np.float64).reshape(len(picked), -1)
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    index = fit(sample, min(MOST_LISTS, len(sample) // 8 + 1, -(-total // LIST_ROWS)))
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids at most
    radius = float(np.sqrt(2 - 2 * threshold))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _decode(part.column("raw"), dtype)
                x /= np.linalg.norm(x, axis=1)[:, None]
                home, codes, error, probes = encode(shared.value, x, radius)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), part.column("raw"), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes]), pa.array(error), pa.array([p.tolist() for p in probes], pa.list_(pa.int32()))],
                    ["node", "n", "raw", "home", "codes", "error", "probes"],
                )

    table = materialize(nodes.mapInArrow(assign, "node long, n long, raw binary, home int, codes binary, error double, probes array<int>"), "op1-index")
    in_list = dict(table.groupBy("home").count().collect())  # MOST_LISTS rows at most
    asked = dict(table.select(F.explode("probes").alias("cell")).groupBy("cell").count().collect())
    block = int(min(MOST_BLOCK, max(LEAST_BLOCK, total // 128)))
    cells = [(c, max(1, -(-in_list.get(c, 0) // block)), max(1, -(-asked.get(c, 0) // block))) for c in range(len(index.centroids))]
    blocks = lambda: F.broadcast(spark.createDataFrame(cells, "cell int, mb int, qb int"))  # noqa: E731  as many rows
    nth = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.col(n)).cast("int")
    members = table.withColumnRenamed("home", "cell").join(blocks(), "cell").withColumn("m", nth("mb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    members = members.select("cell", "m", "q", "node", "n", "raw", "codes", "error")
    queries = reread(table).select("node", "n", "raw", "home", F.explode("probes").alias("cell")).join(blocks(), "cell").withColumn("q", nth("qb")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    queries = queries.select("cell", "m", "q", "node", "n", "raw", "home")

    def side(t: pa.Table, dtype: str = dtype) -> dict:
        raw = _decode(t.column("raw").combine_chunks() if t.column("raw").num_chunks != 1 else t.column("raw").chunk(0), dtype)
        norm = np.linalg.norm(raw, axis=1)
        return {"node": t.column("node").to_numpy(), "n": t.column("n").to_numpy(), "raw": raw, "norm": norm, "unit": raw / norm[:, None]}

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["node", "links", "root"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        m, q = side(left), side(right)
        m["codes"] = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(left.num_rows, -1)
        m["error"], q["home"] = left.column("error").to_numpy(), right.column("home").to_numpy()
        got = block_links(shared.value, left.column("cell")[0].as_py(), m, q, threshold)
        return pa.table([pa.array(x, pa.int64()) for x in got], names=names)

    keys = ["cell", "m", "q"]
    found = members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(compare, "node long, links long, root long")
    return materialize(found, "op1-links")


@tidy
def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Link vectors by cosine >= threshold: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing.
    Vectors of each length are compared with one another, however long. Equal vectors are one node (by a
    64-bit digest) that counts its copies; repeated rows are copies. Lists beyond a block are cut
    into blocks by hash, members against queries, and a block returns counts and one link per
    node instead of pairs. The model is fitted on ``SAMPLE`` vectors at most; all vectors are
    indexed, and probing and table distances keep every link (up to rounding).
    """
    spark = vectors.sparkSession
    double = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    dtype = "<f8" if double else "<f4"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            out = []
            for v in column:
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else (x + 0).astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    rows = rows.mapInArrow(clean, "vec_id long, raw binary").withColumn("node", F.when(F.col("raw").isNotNull(), F.xxhash64("raw")))
    rows = materialize(rows, "op1-vectors")
    nodes = rows.where("raw is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"))
    nodes = materialize(nodes, "op1-nodes")
    sizes = [r["size"] for r in nodes.groupBy(F.length("raw").alias("size")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").orderBy("size").collect()]  # one row for each length of vectors
    found = None
    for size in sizes:
        part = _links(nodes.where(F.length("raw") == size), threshold, dtype)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, root long")
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.select("node", "n").join(sums, "node", "left").join(labels.withColumnRenamed("component_id", "label"), "node", "left")
    per_node = per_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    named = rows.select("vec_id", "node").join(per_node, "node", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("least"))
    named = named.join(least, "label", "left")
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
