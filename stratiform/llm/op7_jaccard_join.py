"""N-gram Jaccard join by partition-and-enumerate signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm.common import distinct_groups, distinct_per_doc, documents, grouped, key_filter, materialize, may_hold, mix64, release, shingles, slices, tidy, whole_groups, word_hashes
from stratiform.llm.components import connected_components

#: Words of a shingle and least similarity in hundredths: of the query, and of pipeline stages.
QUERY, STAGE = (4, 85), (5, 80)
#: Second-level parts of a part of the domain; all subsets of one less are enumerated.
SUB = 3
#: Nodes of a block; larger groups are compared block by block.
BLOCK = 1024
#: Longs compared at once.
SLAB = 1 << 21
#: Bits of the smallest parity sketch.
LEAST_BITS = 256
_U = np.uint64


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, as sorted (hash, document) arrays."""
    h, doc, _, _ = word_hashes(texts)
    s, d, _ = shingles(h, doc, len(texts), words)
    return distinct_per_doc(s, d)


def set_digests(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and order-free 63-bit digest of each document's set; digest 0 for an empty one."""
    size = np.bincount(doc, minlength=n)
    total = np.zeros(n, _U)
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    if len(doc):
        total[doc[cut]] = np.add.reduceat(mix64(values ^ _U(0x5851F42D4C957F2D)), cut)
    digest = mix64(total + size.astype(_U) * _U(0x2545F4914F6CDD1D)) >> _U(1)
    return size, np.where(size > 0, digest, _U(0)).astype(np.int64)


def parity_sketches(values: np.ndarray, doc: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bit for each of at least two buckets a shingle, a power of two of them: whether the set has an odd number there.

    Sets whose sketches differ in b bits differ in b shingles at least.
    """
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * size, 2))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    bucket = (mix64(values ^ _U(0x3C79AC492BA7B653)) >> _U(32)).astype(np.int64) & (bits[doc] - 1)
    odd = np.bincount(start[doc] + bucket, minlength=start[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start, start[1:])]


def bands(most: int, percent: int) -> np.ndarray:
    """Last size of each band: similar sets lie in one band or in two adjoining ones."""
    ends, low = [], 1
    while low <= most:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return np.array(ends or [1], np.int64)


def signatures(values: np.ndarray, doc: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets given as sorted (hash, document) arrays: (signature, document).

    Different sets of one band, or of a band and the next, differ in at most k shingles. The hash
    domain is cut into k // 2 + 1 parts and some spare ones, so such sets differ in one shingle at
    most in one part more than are spare. Each part is cut into ``SUB`` parts, and all subsets of
    one less are enumerated: one of them is the same in both sets. A set emits the first parts
    only, as many as its own largest difference needs plus the spare ones. Subsets without
    shingles are left out, unless more parts than are spare have one: then they could be all that
    two sets share. Equal sets need no signature.
    """
    out_s, out_d = [], []
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = bands(int(size.max()) * 2 + 2, percent)
    band = np.searchsorted(ends, np.maximum(size, 1))
    loss = 100 - percent
    for up in (0, 1):  # with bands up to one's own, and with the next one
        tag = band + up
        # the largest symmetric difference of two similar sets of this tag, and of this set
        most_k = 2 * ends[tag] * loss // (100 + percent)
        partner = np.minimum(size * 100 // percent, ends[tag])
        k = np.minimum((size + partner) * loss // (100 + percent), most_k)
        use = (size > 0) & (k > 0) & (partner > ends[band] if up else True)
        spare = np.where(most_k > 1, 1 + most_k // 24, 0)
        parts = most_k // 2 + 1 + spare
        sent = np.where(use, k // 2 + 1 + spare, 0)
        first = np.cumsum(sent) - sent
        keep = use[doc]
        v, d = values[keep], doc[keep]
        if not len(v):
            continue
        place = mix64(v ^ _U(0x9FB21C651E98DF25))
        part = ((place >> _U(32)) * parts[d].astype(_U) >> _U(32)).astype(np.int64)
        inside = part < sent[d]
        v, d, place, part = v[inside], d[inside], place[inside], part[inside]
        total = int(sent.sum())
        slot = (first[d] + part) * SUB + ((place & _U(0xFFFFFFFF)) * _U(SUB) >> _U(32)).astype(np.int64)
        sums = np.zeros(total * SUB, _U)
        np.add.at(sums, slot, mix64(v))
        held = np.bincount(slot, minlength=total * SUB).reshape(total, SUB)
        sums = sums.reshape(total, SUB)
        owner = np.repeat(np.arange(len(size)), sent)
        index = np.arange(total) - first[owner]
        filled = held.sum(1)[:, None] > held  # of each subset, named by the part it leaves out
        empty = np.bincount(owner[~filled.all(1)], minlength=len(size)) > spare
        emit = filled | empty[owner][:, None]
        name = mix64((tag[owner].astype(_U) << _U(32)) + index.astype(_U) * _U(SUB))[:, None] + np.arange(SUB, dtype=_U)[None]
        tagged = mix64(sums.sum(1)[:, None] - sums + mix64(name))
        out_s.append(tagged[emit].view(np.int64))
        out_d.append(np.broadcast_to(owner[:, None], emit.shape)[emit])
    if not out_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_d)


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, t, n_shingles, node, sketch): t is the text's digest, node that of its shingle set, 0 if empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                v, d = shingle_sets(part.column("text").to_pylist(), words)
                size, node = set_digests(v, d, part.num_rows)
                cols = [part.column("doc_id"), part.column("t"), pa.array(size, pa.int64()), pa.array(node), pa.array(parity_sketches(v, d, size), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "n_shingles", "node", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(compute, "doc_id long, t long, n_shingles long, node long, sketch binary")


def _signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                v, d = shingle_sets(part.column("text").to_pylist(), words)
                size, node = set_digests(v, d, part.num_rows)
                s, owner = signatures(v, d, size, percent)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(node[owner])], ["sig", "node"])

    return docs.select("text").mapInArrow(compute, "sig long, node long")


def members_of(groups: DataFrame, key: str = "sig") -> DataFrame:
    """(g, b, k, node): members of groups (key, hub, node), once for groups of the very same members.

    A group beyond ``BLOCK`` nodes is cut into blocks by hash; a member of block b is in the comparison k of
    each pair of blocks it is one of.
    """
    rows = distinct_groups(groups, key)
    blocks = F.floor(F.col("m") / BLOCK).cast("int") + 1
    rows = rows.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    rows = rows.where("nb = 1").select("g", "node", "b", F.lit(0).alias("o")).unionByName(rows.where("nb > 1").select("g", "node", "b", other.alias("o")))
    return rows.select("g", "b", F.xxhash64("g", F.least("b", "o"), F.greatest("b", "o")).alias("k"), "node")


def sketch_pairs(first: np.ndarray, label: np.ndarray, block: np.ndarray, n: np.ndarray, sketch: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group with different labels that neither sizes nor sketches rule out, and their distance.

    ``first`` holds the group's first row for each row. In a group of two blocks only rows of different blocks are paired.
    The distance is that of the shorter sketch's length, whatever others the group holds.
    """
    rows = len(first)
    start = np.flatnonzero(first == np.arange(rows))
    end = np.repeat(np.append(start[1:], rows), np.diff(np.append(start, rows)))
    width = np.fromiter(map(len, sketch), np.int64, rows)
    low = np.minimum.reduceat(width, start)[np.searchsorted(start, first)]
    two = (np.maximum.reduceat(block, start) != np.minimum.reduceat(block, start))[np.searchsorted(start, first)]
    out_i, out_j, out_d = [], [], []

    def folded(at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        table = np.zeros((len(at), w // 8), _U)
        for r, x in enumerate(at.tolist()):
            y = np.frombuffer(sketch[x], _U)
            while len(y) > w // 8:  # a folded sketch is the shorter parity sketch, as buckets are the low bits
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            table[r] = y
        place = np.zeros(rows, np.int64)
        place[at] = np.arange(len(at))
        return table, place

    for w in np.unique(low):
        at = np.flatnonzero(low == w)
        table, place = folded(at, w)
        wider = {v: folded(at[width[at] >= v], v) for v in np.unique(width[at]) if v > w}
        later = end[at] - at - 1
        done = np.cumsum(later)
        step = max(1, SLAB // int(w // 8))
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + step, "right")))
            c = later[a:b]
            i = np.repeat(at[a:b], c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (~two[i] | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(table[place[i]] ^ table[place[j]]).sum(1, dtype=np.int64)
            ok = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            i, j, apart = i[ok], j[ok], apart[ok]
            for v, (longs, row) in wider.items():
                x = np.flatnonzero(np.minimum(width[i], width[j]) == v)
                for s in range(0, len(x), step):
                    y = x[s : s + step]
                    apart[y] = np.bitwise_count(longs[row[i[y]]] ^ longs[row[j[y]]]).sum(1, dtype=np.int64)
            ok = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            out_i.append(i[ok])
            out_j.append(j[ok])
            out_d.append(apart[ok])
            a = b
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j, out_d))


def owned(groups: pa.ListArray, g: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether ``g`` is the least group that rows i and j have in common; ``groups`` has a sorted list for each row."""
    width = groups.value_lengths().to_numpy()
    start = np.cumsum(width) - width
    values, name = np.unique(groups.flatten().to_numpy(), return_inverse=True)
    held = np.repeat(np.arange(len(width)), width) * len(values) + name
    at = np.searchsorted(values, g)
    keep = np.zeros(len(i), bool)
    done = np.cumsum(width[i])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + SLAB, "right")))
        w = width[i[a:b]]
        pair = np.repeat(np.arange(a, b), w)
        named = name[np.repeat(start[i[a:b]] - np.cumsum(w) + w, w) + np.arange(len(pair))]
        sought = j[pair] * len(values) + named
        both = held[np.minimum(np.searchsorted(held, sought), len(held) - 1)] == sought
        pair, named = pair[both], named[both]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        keep[pair[first]] = named[first] == at[pair[first]]
        a = b
    return keep


def candidates(members: DataFrame, percent: int, turn: str) -> DataFrame:
    """(a, b, apart): pairs of members (k, g, b, node, label, n, sketch, groups) that may link and have different labels.

    ``turn`` tells which: the nearest partner of each node, that of each pair of labels, or all. A pair
    comes from the least of the groups it is in; as ties go to the least nodes, what is nearest in
    all groups is so in that one.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            k, g, block, node, label, n = (t.column(c).to_numpy() for c in ("k", "g", "b", "node", "label", "n"))
            new = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            i, j, d = sketch_pairs(first, label, block, n, t.column("sketch").to_pylist(), percent)
            low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if turn == "node":  # the nearest of either side
                side, other = np.concatenate([i, j]), np.concatenate([j, i])
                order = np.lexsort((node[other], np.concatenate([d, d]), side))
                best = order[np.concatenate([[True], side[order][1:] != side[order][:-1]])] if len(side) else order
                at = np.unique(best % max(1, len(i)))
            elif turn == "label":
                la, lb = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                order = np.lexsort((high, low, d, lb, la, first[i]))
                x = [c[order] for c in (first[i], la, lb)]
                at = order[np.concatenate([[True], np.any([c[1:] != c[:-1] for c in x], axis=0)])] if len(i) else order
            else:
                at = np.arange(len(i))
            if len(at):
                at = at[owned(t.column("groups").combine_chunks(), g[i[at]], i[at], j[at])]
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (low, high, d)], ["a", "b", "apart"])

    return members.repartition("k").sortWithinPartitions("k").select("k", "g", "b", "node", "label", "n", "sketch", "groups").mapInArrow(compare, "a long, b long, apart long")


def nearest(near: DataFrame) -> DataFrame:
    """(a, b): of candidates (a, b, apart) the nearest of each node."""
    side = lambda x, y: near.select(F.col(x).alias("node"), F.struct("apart", F.col(y).alias("other")).alias("o"))
    best = side("a", "b").unionAll(side("b", "a")).groupBy("node").agg(F.min("o").alias("o")).select("node", F.col("o.other").alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def node_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set) of wanted nodes (t, node): sorted hashes of the shingles, 8 bytes each."""
    bitmap = key_filter(wanted, "t")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bitmap, batch.column("t").to_numpy())))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                v, d = shingle_sets(part.column("text").to_pylist(), words)
                _, node = set_digests(v, d, part.num_rows)
                cut = np.searchsorted(d, np.arange(part.num_rows + 1))
                right = node == part.column("node").to_numpy()  # should two texts share their digest
                sets = [v[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets, pa.binary())], ["node", "set"]).filter(pa.array(right))

    texts = docs.select(F.xxhash64("text").alias("t"), "text").where("text is not null").mapInArrow(likely, "t long, text string")
    texts = texts.join(wanted.select("t", "node").hint("merge"), "t").dropDuplicates(["node", "t"]).select("node", "text")
    return texts.mapInArrow(compute, "node long, set binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar enough, counted exactly."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep[r] = 100 * both >= percent * (len(p) + len(q) - both)
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    x, y = (sets.select(F.col("node").alias(p), F.col("set").alias(c)) for p, c in (("a", "x"), ("b", "y")))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


@tidy
def jaccard_rows(docs: DataFrame, words: int = QUERY[0], percent: int = QUERY[1]) -> DataFrame:
    """The table behind ``jaccard_components``, with the digests of text and set: doc_id, t, n_shingles, node, label.

    Documents with one label are linked; the label of an empty set is null.
    """
    keys = materialize(_keys(docs, words), "op7-keys")
    groups = materialize(grouped(_signature_rows(docs, words, percent), "sig", "node"), "op7-groups")
    nodes = keys.where("node <> 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("t").alias("t"))
    members = materialize(members_of(groups), "op7-members")
    release(groups)
    lists = members.groupBy("node").agg(F.array_sort(F.collect_set("g")).alias("groups"))
    known = materialize(nodes.drop("t").join(lists.hint("merge"), "node"), "op7-known")
    sketched = lambda rows: rows.join(known.hint("merge"), "node")
    near = materialize(candidates(sketched(members.withColumn("label", F.col("node"))), percent, "node"), "op7-near")
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = materialize(node_sets(docs, materialize(ends.join(nodes.select("node", "t"), "node"), "op7-wanted"), words), "op7-sets")
    # a node without a candidate has none in later turns
    live = materialize(members.join(ends.hint("merge"), "node", "left_semi"), "op7-live")
    release(members)
    pairs = tried = materialize(nearest(near), "op7-pairs")
    links = materialize(verified(pairs, sets, percent), "op7-links")
    labels = connected_components(links)
    for turn in ("label", "all"):
        named = live.join(labels, "node", "left").withColumn("label", F.coalesce("component_id", "node")).drop("component_id")
        mixed = named.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k")
        more = candidates(sketched(named.join(mixed, "k", "left_semi")), percent, turn).select("a", "b").distinct()
        pairs = materialize(more.join(tried, ["a", "b"], "left_anti"), "op7-pairs")
        found = materialize(verified(pairs, sets, percent), "op7-links")
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        if not found.isEmpty():
            labels = connected_components(links)
    named = keys.select("doc_id", "t", "n_shingles", "node").join(labels.withColumnRenamed("component_id", "label"), "node", "left")
    return named.select("doc_id", "t", "n_shingles", "node", F.when(F.col("node") != 0, F.coalesce("label", "node")).alias("label"))


def jaccard_components(docs: DataFrame, words: int = QUERY[0], percent: int = QUERY[1]) -> DataFrame:
    """Group documents by links of Jaccard similarity: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lowered; a text of fewer words than a shingle is
    one shingle; texts without words or null ones link with nothing. Very long texts are whole
    sets like others. Equal sets are one node (its 64-bit digest), so copies cost nothing further.
    Members of a signature's group are compared by size and parity sketch, which rule pairs out
    exactly; a pair of several groups is reported by the least of them. Pairs left are verified by their sets: the nearest of each node first, then the
    nearest of each two components, then all that still lie in different components. Repeated rows
    are copies; a null doc_id has the component of its equals; extra columns are not read; an
    empty table gives no rows.
    """
    rows = jaccard_rows(docs, words, percent)
    smallest = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(smallest, "label", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@tidy
def keep_one_each(docs: DataFrame, words: int = STAGE[0], percent: int = STAGE[1]) -> DataFrame:
    """One row of each group of linked documents, and all rows whose text has no words.

    The row of smallest doc_id stays (null last, then by the text's digest), once where it is
    repeated; columns are those of ``docs``.
    """
    rows = jaccard_rows(docs, words, percent).where("label is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = rows.groupBy("label").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("op7_id"), F.col("o.t").alias("op7_t"))
    copies = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("op7_n"))
    kept = first.join(copies, first["op7_id"].eqNullSafe(copies["doc_id"]) & (first["op7_t"] == copies["t"])).select("op7_id", "op7_t", "op7_n")
    kept = materialize(kept, "op7-kept")
    worded = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    found = docs.where(worded).join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("op7_id")) & (F.xxhash64("text") == F.col("op7_t")))
    once = found.where("op7_n > 1").dropDuplicates(["op7_id", "op7_t"])  # repeated rows: one of them
    return found.where("op7_n = 1").unionByName(once).select(*docs.columns).unionByName(docs.where(~worded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
