"""Merkle manifest of a dataset, reduced by superblocks of several levels at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratiform.llm.common import crc_of_id, documents, materialize

#: Children of a node, and levels that one task collapses: a superblock has FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 16, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Letters in a digest.
HEX = 64
#: Groups whose subroots (about 100 bytes each) are broadcast; more of them are joined by shuffle.
MOST_BROADCAST = 10_000


def node_hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[F.Column]) -> F.Column:
    """Digest of a row: each value as its bytes' number, a colon and itself, or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels between n nodes and the one that they become."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(digests: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """All levels of a superblock, its own first: runs of ``fanout`` digests become their digest."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([node_hash("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def lower_proofs(tree: list[list[str]], upper: str, fanout: int = FANOUT) -> list[str]:
    """For each digest of the lowest level its siblings, level by level, and then ``upper``."""
    proofs = [upper] * len(tree[-1])
    for level in reversed(tree[:-1]):
        below = []
        for r, proof in enumerate(proofs):
            run = "".join(level[r * fanout : (r + 1) * fanout])
            below += [run[:i] + run[i + HEX :] + proof for i in range(0, len(run), HEX)]
        proofs = below
    return proofs


def fold(digest: str, proof: str, places: list[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a digest and its siblings give, through groups of (place, number of nodes)."""
    at = 0
    for place, n in places:
        while n > 1:
            left = place % fanout
            others = min(fanout, n - (place - left)) - 1
            siblings = proof[at : at + others * HEX]
            digest = node_hash(siblings[: left * HEX] + digest + siblings[left * HEX :])
            at += others * HEX
            place, n = place // fanout, -(-n // fanout)
    return digest


def indexed(rows: DataFrame, group: str | None, order: list[str], label: str) -> DataFrame:
    """Add ``place``, the number of a row within its group by ``order`` (nulls first), from 0, and ``n``, the group's rows.

    Rows are dealt by ranges and written down; a row's place is its rank in its range and group
    and the rows of that group in earlier ranges, so a group that holds most rows has many parts.
    """
    by = [group] if group else []
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), label)
    whole = Window.partitionBy(*by)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select(*[F.col(g).alias("_g") for g in by], F.col("part").alias("_part"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_before"), F.sum("c").over(whole).alias("n"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)))
    on = F.col("part") == F.col("_part")
    if group:
        on &= F.col(group).eqNullSafe(F.col("_g"))
    return ranked.join(cells, on).withColumn("place", F.col("_before") + F.col("_rank") - 1).drop("part", "_part", "_rank", "_before", "_g")


NODE = "tree long, place long, n long, digest string"


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of all superblocks of (tree, place, n, digest), as nodes of the trees above."""
    size = fanout**levels

    def collapse_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree, place, n = (int(rows[c].iat[0]) for c in ("tree", "place", "n"))
        todo = min(levels, levels_of(n, fanout))
        top = collapse(rows["digest"].tolist(), todo, fanout)[-1]
        return pd.DataFrame({"tree": [tree], "place": [place // size], "n": [-(-n // size)], "digest": top})

    return nodes.groupBy("tree", F.floor(F.col("place") / size).alias("block")).applyInPandas(collapse_block, NODE)


def _proved(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """All nodes with their proof: the siblings in their superblock, and then the proof of its root.

    ``above`` holds (tree, place, proof) of the superblocks' roots. Other columns of the nodes stay
    with them, so proofs are made where rows are and never dealt again.
    """
    size = fanout**levels
    columns = nodes.columns

    def prove_block(rows: pa.Table, root: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([*rows.select(columns).columns, pa.array([], pa.string())], [*columns, "proof"])
        rows = rows.select(columns).sort_by("place")
        todo = min(levels, levels_of(rows.column("n")[0].as_py(), fanout))
        proofs = lower_proofs(collapse(rows.column("digest").to_pylist(), todo, fanout), root.column("proof")[0].as_py(), fanout)
        return pa.table([*rows.columns, pa.array(proofs, pa.string())], [*columns, "proof"])

    left = nodes.groupBy("tree", F.floor(F.col("place") / size).alias("block"))
    right = above.groupBy("tree", F.col("place").alias("block"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return left.cogroup(right).applyInArrow(prove_block, f"{types}, proof string")


def _tower(nodes: DataFrame, fanout: int, levels: int, label: str) -> list[DataFrame]:
    """Nodes of all superblock levels: the given ones first, one node of every tree last."""
    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        out.append(materialize(_reduced(out[-1].select("tree", "place", "n", "digest"), fanout, levels), label))
    return out


def _proofs(tower: list[DataFrame], top: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Proofs of the lowest nodes of a tower, whose highest continue with ``top`` (tree, place, proof)."""
    if len(tower) == 1:
        return tower[0].join(top, ["tree", "place"])
    for nodes in reversed(tower[:-1]):
        top = _proved(nodes, top.select("tree", "place", "proof"), fanout, levels)
    return top


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "source", key: str = "doc_id", keep: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Leaves of all rows with their places and proofs, the subroot of each group, and the root.

    Returns key, the columns of ``keep``, leaf, place and n (in the group), group_place and
    n_groups, subroot, root and proof: the siblings' digests, level by level through the subroot
    to the root, left to right, 64 letters each. Groups stand by value, null first; rows in a
    group by key, null first, then by leaf, so rows repeated as they are stand side by side. A
    group of one row is its own subroot, and one group's subroot is the root. A null value differs
    from an empty one. Texts are whole; columns that are in neither ``fields`` nor ``keep`` are
    not read, whatever their names; an empty table gives no rows.

    ``levels`` levels of ``fanout`` are collapsed at a time: a task holds ``fanout ** levels``
    digests whatever the data, the roots of these superblocks are reduced in the same way, and a
    proof is the one inside the superblock followed by that of its root.
    """
    keep = keep or []
    leaf = leaf_hash([F.col(c) for c in fields or FIELDS]).alias("digest")
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("grp"), leaf, *kept)
    leaves = indexed(named, "grp", ["key", "digest"], "op12-leaves")
    counts = materialize(leaves.groupBy("grp").agg(F.max("n").alias("rows")), "op12-groups")
    trees = indexed(counts, None, ["grp"], "op12-order").select(F.col("grp").alias("_g"), F.col("place").alias("tree"), F.col("n").alias("n_groups"))
    trees = materialize(trees, "op12-trees")
    rows = leaves.join(trees, F.col("grp").eqNullSafe(F.col("_g"))).drop("grp", "_g")
    rows = materialize(rows, "op12-rows")
    lower = _tower(rows, fanout, levels, "op12-nodes")
    tops = lower[-1].select("tree", F.col("digest").alias("subroot")).join(trees.select("tree", "n_groups"), "tree")
    tops = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("n_groups").alias("n"), F.col("subroot").alias("digest"))
    upper = _tower(materialize(tops, "op12-subroots"), fanout, levels, "op12-tops")
    first = upper[-1].first()
    over = _proofs(upper, upper[-1].select("tree", "place", F.lit("").alias("proof")), fanout, levels)
    over = materialize(over.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "proof"), "op12-over")
    sub = upper[0].select(F.col("place").alias("tree"), F.col("digest").alias("subroot"))
    proved = _proofs(lower, over, fanout, levels).join(F.broadcast(sub) if counts.count() <= MOST_BROADCAST else sub, "tree")
    return proved.select(
        F.col("key").alias(key), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("digest").alias("leaf"), "place", "n",
        F.col("tree").alias("group_place"), "n_groups", "subroot", F.lit(first["digest"] if first else "").alias("root"), "proof",
    )


def folded(rows: DataFrame, leaf: str, out: str = "folded_root", fanout: int = FANOUT) -> DataFrame:
    """Add the root that column ``leaf`` and each row's siblings give; proof becomes its own digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(c).to_pylist() for c in (leaf, "proof", "place", "n", "group_place", "n_groups")]
            roots = [fold(d, p, [(i, n), (j, m)], fanout) for d, p, i, n, j, m in zip(*x)]
            digests = [node_hash(p) for p in x[1]]
            keep = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(digests, pa.string()), pa.array(roots, pa.string())], [*kept, "proof_sha256", out])

    kept = [c for c in rows.columns if c != "proof"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(scan, ", ".join(f"`{c}` {types[c]}" for c in kept) + f", proof_sha256 string, {out} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 5 divides the crc32 of an id, A-Z in the text were changed to a-z since."""
    docs = documents(spark, sf_dir)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(crc_of_id("doc_id") % 5 == 0, leaf_hash([low if c == "text" else F.col(c) for c in FIELDS]))
    proved = manifest(docs.withColumn("_changed", changed), keep=["_changed"])
    out = folded(proved.withColumn("_now", F.coalesce("_changed", "leaf")), "_now")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tower(name: str, first: str, levels: int) -> str:
    """CTEs of a tree's levels: (g, i, d, n, lft, rgt) with the siblings before and after a node."""
    run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
    parts = []
    for k in range(levels + 1):
        below = first if k == 0 else (
            f"SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, CASE WHEN max(n) = 1 THEN 1 ELSE (max(n) + 15) // 16 END AS n FROM {name}{k - 1} GROUP BY g, i // 16"
        )
        parts.append(
            f"{name}{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
            f"coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM ({below}))"
        )
    return ",\n".join(parts)


def _sql_fold(name: str, group: str, place: str, levels: int, source: str, out: str) -> str:
    """CTEs that fold column ``now`` of ``source`` up the tree and gather its proof."""
    parts, last = [], source
    for k in range(levels):
        here = f"{out}{k}"
        parts.append(
            f"{here} AS (SELECT s.* REPLACE (CASE WHEN t.n = 1 THEN s.now ELSE sha256(t.lft || s.now || t.rgt) END AS now, s.proof || CASE WHEN t.n = 1 THEN '' ELSE t.lft || t.rgt END AS proof) "
            f"FROM {last} s JOIN {name}{k} t ON s.{group} = t.g AND s.{place} // {16 ** k} = t.i)"
        )
        last = here
    return ",\n".join(parts)


def _sql_leaf(text: str) -> str:
    values = [f"({text if c == 'text' else c})::VARCHAR" for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


#: Levels that the SQL spells out: enough for 16 ** 5 documents of a source, and as many sources.
_DEPTH = 5
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(doc_id::VARCHAR)), lambda k: ord(substr(doc_id::VARCHAR, k + 1, 1))::BIGINT)),
    lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"""
ORACLE = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), leaf AS MATERIALIZED (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, crc
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
  FROM leaf
), {_sql_tower("low", "SELECT g, i, leaf AS d, n FROM placed", _DEPTH)},
{_sql_tower("top", f"SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM low{_DEPTH}", _DEPTH)},
start AS (SELECT doc_id, leaf, g, i, 0 AS one, coalesce(changed, leaf) AS now, '' AS proof FROM placed),
{_sql_fold("low", "g", "i", _DEPTH, "start", "f")},
{_sql_fold("top", "one", "g", _DEPTH, f"f{_DEPTH - 1}", "u")}
SELECT u.doc_id, u.leaf, l.d AS subroot, t.d AS root, sha256(u.proof) AS proof_sha256, u.now AS folded_root, u.now = t.d AS verified
FROM u{_DEPTH - 1} u JOIN low{_DEPTH} l ON u.g = l.g, top{_DEPTH} t
"""
