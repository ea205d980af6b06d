"""Line dedup by a log-template tree: lines of templates that recur across documents are dropped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm.common import distinct_groups, documents, grouped, key_filter, materialize, may_hold, mix64, release, slices, tidy
from stratiform.llm.components import connected_components

#: Leading tokens of a tree path; documents that make a template recur.
DEPTH, MIN_DOCS = 3, 3
#: Share of positions, in hundredths, that a template fixes at least.
SIMILAR = 80
FIELD = b"<*>"
_FIELD = re.compile(rb"[\d@]")
_MASK63 = np.uint64((1 << 63) - 1)


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line; those with a digit, of an address or of a mail name become one field."""
    tokens = line.split()
    if _FIELD.search(line) or b"://" in line:
        tokens = [FIELD if _FIELD.search(t) or b"://" in t else t for t in tokens]
    return tokens


def digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") >> 1


def leaf_of(tokens: list[bytes]) -> int:
    """The tree path of a line: its token count, and its first tokens."""
    return digest(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH]))


def fields(n: int) -> int:
    """Positions of ``n`` that a template may leave open."""
    return n * (100 - SIMILAR) // 100


def segment_digests(leaf: int, hashes: np.ndarray) -> np.ndarray:
    """The last level of the tree: digests of the segments of a line's tokens beyond the path, one more than it may have fields.

    Lines of one template have all tokens but the fields in common, so one segment at least.
    """
    v = fields(len(hashes))
    at = np.linspace(min(DEPTH, len(hashes) - 1), len(hashes), v + 2).astype(np.int64)[:-1]
    h = mix64((hashes.astype(np.uint64) << np.uint64(32)) + np.arange(len(hashes), dtype=np.uint64))
    return mix64(np.add.reduceat(h, at) + np.arange(v + 1, dtype=np.uint64) + np.uint64(leaf)) & _MASK63


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, r, line_no, leaf, node) of every line with tokens: r names the row, node is the digest of the masked line."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                at, nos, leaf, node = [], [], [], []
                for i, t in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    for no, line in enumerate((t or b"").split(b"\n")):
                        if tokens := masked(line):
                            at.append(i)
                            nos.append(no)
                            leaf.append(leaf_of(tokens))
                            node.append(digest(b" ".join(tokens)))
                at = pa.array(at, pa.int64())
                cols = [part.column("doc_id").take(at), part.column("r").take(at), pa.array(nos, pa.int32()), pa.array(leaf, pa.int64()), pa.array(node, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "r", "line_no", "leaf", "node"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("r"), "text")
    return rows.mapInArrow(split, "doc_id long, r long, line_no int, leaf long, node long")


def _tokens(docs: DataFrame, leaves: np.ndarray) -> DataFrame:
    """(leaf, node, tokens) of lines whose leaf may be in ``leaves``: 32-bit hashes of the masked tokens."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = [tokens for t in part.column("text").cast(pa.binary()).to_pylist() for line in (t or b"").split(b"\n") if (tokens := masked(line))]
                leaf = np.fromiter(map(leaf_of, lines), np.int64, len(lines))
                keep = np.flatnonzero(may_hold(leaves, leaf)).tolist()
                node = [digest(b" ".join(lines[i])) for i in keep]
                hashes = [np.fromiter(map(crc32, lines[i]), np.uint32, len(lines[i])).tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(node, pa.int64()), pa.array(hashes, pa.binary())], ["leaf", "node", "tokens"])

    return docs.select("text").mapInArrow(split, "leaf long, node long, tokens binary")


def _segments(lines: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, counts = [], []
            for leaf, tokens in zip(batch.column("leaf").to_pylist(), batch.column("tokens")):
                sigs.append(segment_digests(leaf, np.frombuffer(tokens.as_buffer(), np.uint32)))
                counts.append(len(sigs[-1]))
            if sigs:
                node = np.repeat(batch.column("node").to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(node)], ["sig", "node"])

    return lines.mapInArrow(cut, "sig long, node long")


class Branch:
    """The templates of one place in the tree: tokens, and which of them are fixed."""

    def __init__(self, n: int):
        self.need = n - fields(n)
        self.tokens, self.fixed = np.zeros((4, n), np.uint32), np.zeros((4, n), bool)
        self.first: list[int] = []

    def add(self, line: np.ndarray, node: int) -> tuple[int, int | None]:
        """Parse a line: (its template, the template's first line if this is the second one else None).

        It goes to the template that has most tokens in common with it, if these are enough to stay
        fixed; the others become fields. Otherwise it is a new template.
        """
        t = len(self.first)
        if t:
            same = (self.tokens[:t] == line) & self.fixed[:t]
            count = same.sum(1)
            best = int(count.argmax())
            if count[best] >= self.need:
                self.fixed[best] = same[best]
                first, self.first[best] = self.first[best], None
                return best, first
        if t == len(self.tokens):
            self.tokens, self.fixed = np.concatenate([self.tokens] * 2), np.concatenate([self.fixed] * 2)
        self.tokens[t], self.fixed[t] = line, True
        self.first.append(node)
        return t, node


def _parsed(members: DataFrame) -> DataFrame:
    """(node, template) of members (g, order, node, tokens) whose template has two lines or more."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_g, branch = None, None
        for batch in batches:
            nodes, names = [], []
            for g, node, raw in zip(batch.column("g").to_pylist(), batch.column("node").to_pylist(), batch.column("tokens")):
                line = np.frombuffer(raw.as_buffer(), np.uint32)
                if g != open_g:
                    open_g, branch = g, Branch(len(line))
                n_before = len(branch.first)
                at, first = branch.add(line, node)
                if len(branch.first) > n_before:
                    continue  # a template of one line so far
                name = hash_pair(g, at)
                for x in (node,) if first is None else (first, node):
                    nodes.append(x)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(names, pa.int64())], ["node", "template"])

    spread = members.repartition("g").sortWithinPartitions("g", F.desc("n_docs"), "node").select("g", "node", "tokens")
    return spread.mapInArrow(parse, "node long, template long")


def hash_pair(a: int, b: int) -> int:
    return digest(b"%d %d" % (a, b))


@tidy
def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(r, drop): numbers of the lines to drop of each row that loses some, r being xxhash64(doc_id, text)."""
    lines = materialize(_lines(docs), "op2-lines")
    per_doc = lines.select("leaf", "node", "r").distinct()
    nodes = materialize(per_doc.groupBy("leaf", "node").agg(F.count(F.lit(1)).alias("n_docs")), "op2-nodes")
    full = nodes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf")
    full = materialize(full, "op2-leaves")
    texts = _tokens(docs, key_filter(full, "leaf")).join(full.hint("merge"), "leaf", "left_semi").dropDuplicates(["node"])
    texts = materialize(texts.hint("merge").join(nodes.select("node", "n_docs"), "node"), "op2-texts")
    groups = materialize(grouped(_segments(texts), "sig", "node"), "op2-groups")
    members = distinct_groups(groups, "sig").select("g", "node").join(texts.drop("leaf").hint("merge"), "node")
    parsed = materialize(_parsed(members), "op2-parsed")
    release(groups)
    # the documents of a template: of lines that recur by themselves their number will do
    counted = parsed.join(nodes.select("node", "n_docs"), "node")
    often = counted.where(F.col("n_docs") >= min_docs).select("template")
    few = counted.where(F.col("n_docs") < min_docs).hint("merge").join(lines.select("node", "r"), "node").select("template", "r").distinct()
    often = often.union(few.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")).distinct()
    links = materialize(parsed.join(often, "template").select("node", "template"), "op2-links")
    labels = connected_components(links, "node", "template")
    known = nodes.select("node", "n_docs").join(labels, "node", "left").where((F.col("n_docs") >= min_docs) | F.col("component_id").isNotNull())
    known = materialize(known.select("node", F.coalesce("component_id", "node").alias("class")), "op2-classes")
    hits = lines.join(known.hint("merge"), "node").select("class", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r", "line_no").alias("at"))
    first = hits.groupBy("class").agg(F.min("at").alias("first"))
    gone = hits.join(first, "class").where("at <> first").select("at.r", "at.line_no")
    return gone.groupBy("r").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines whose template recurs in ``min_docs`` documents: adds n_lines and n_dropped, replaces text.

    Lines are parsed by a tree of fixed depth: token count, the first ``DEPTH`` tokens, and a
    segment of the others; a line is filed under each of its segments. Tokens with digits, of
    addresses and mail names are fields from the start. At each place lines, those of most
    documents first and then by digest, go to the template with which they share most tokens; where
    they differ it gets fields, while ``SIMILAR`` of its positions stay fixed; else they are a new
    template. Recurring templates that share a line are one class, of which the first line (by
    doc_id, null last, and number) stays.

    Tokens are runs without ASCII white space; lines without tokens stay and do not count. A null
    text stays null. A row is a document, whatever its doc_id; rows that repeat doc_id and text
    are one document and all lose the same lines. Very long lines have as many segments as fields
    and one. Other columns pass through; an empty table gives no rows.
    """
    drops = recurring_lines(docs, min_docs).select(F.col("r").alias("op2_r"), F.col("drop").alias("op2_drop"))
    keyed = docs.join(drops.hint("merge"), F.xxhash64("doc_id", "text") == F.col("op2_r"), "left")
    lines = F.split("text", "\n", -1)
    dropped = F.coalesce(F.col("op2_drop"), F.array().cast("array<int>"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("op2_drop"), i))
    text = F.when(F.col("op2_drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    count = F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    out = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return keyed.select(*out, count.cast("long").alias("n_lines"), F.size(dropped).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_dropped and the text that is left."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
