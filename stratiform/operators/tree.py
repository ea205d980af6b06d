"""Section trees: pre-order intervals stored with each section, so subtrees and ancestors are plain joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from stratiform.settle import settled


def with_intervals(chunks: DataFrame, source: str = "source", chunk: str = "chunk_id", parent: str = "parent_id", order: str = "chunk_index") -> DataFrame:
    """Chunks with ``path``, ``enter`` and ``leave``: where a chunk stands in its source's tree.

    ``path`` lists the ``order`` numbers from the root down to the chunk, ``enter`` is its rank in
    depth-first order (from 1, children by ``order``) and ``leave`` that of the last chunk below
    it. Numbers must not repeat within a source. A parent that is null or not there makes a root;
    chunks on a cycle or below one have null. Each round doubles the way up that is known, so a
    tree of depth d takes about log2(d) joins, and a cycle is told by its not ending.
    """
    rows = chunks.select(F.col(source).alias("_s"), F.col(chunk).alias("_c"), F.col(parent).alias("_p"), F.col(order).cast("long").alias("_o"))
    there = rows.select(F.col("_s").alias("_s2"), F.col("_c").alias("_c2")).distinct()
    state = rows.join(there, (F.col("_s") == F.col("_s2")) & (F.col("_p") == F.col("_c2")), "left").select("_s", "_c", F.col("_c2").alias("_up"), F.array("_o").alias("_path"))
    state = settled(state)
    most = state.groupBy("_s").count().agg(F.max("count").alias("n")).first()["n"] or 0
    for _ in range(math.ceil(math.log2(most)) + 1 if most > 1 else 0):
        open_ = state.where("_up is not null")
        if open_.isEmpty():
            break
        above = state.select(F.col("_s").alias("_s2"), F.col("_c").alias("_c2"), F.col("_up").alias("_next"), F.col("_path").alias("_over"))
        further = open_.join(above, (F.col("_s") == F.col("_s2")) & (F.col("_up") == F.col("_c2"))).select("_s", "_c", F.col("_next").alias("_up"), F.concat("_over", "_path").alias("_path"))
        state = settled(state.where("_up is null").unionByName(further))
    whole = state.where("_up is null").select("_s", "_c", "_path")
    size = whole.select("_s", F.explode("_path").alias("_o")).groupBy("_s", "_o").agg(F.count(F.lit(1)).alias("_n"))
    placed = whole.withColumn("_enter", F.row_number().over(Window.partitionBy("_s").orderBy("_path"))).withColumn("_o", F.element_at("_path", -1)).join(size, ["_s", "_o"])
    placed = placed.select(F.col("_s").alias(source), F.col("_c").alias(chunk), F.col("_path").alias("path"), F.col("_enter").alias("enter"), (F.col("_enter") + F.col("_n") - 1).cast("int").alias("leave"))
    return chunks.join(placed, [source, chunk], "left")


def ancestors(tree: DataFrame, source: str = "source", chunk: str = "chunk_id", order: str = "chunk_index") -> DataFrame:
    """(source, chunk, ancestor, distance) of all chunks of a tree with intervals, near to far."""
    up = tree.where("path is not null").select(source, F.col(chunk).alias("_c"), F.size("path").alias("_n"), F.posexplode("path").alias("_i", "_o")).where("_i < _n - 1")
    names = tree.select(source, F.col(order).cast("long").alias("_o"), F.col(chunk).alias("ancestor"))
    return up.join(names, [source, "_o"]).select(source, F.col("_c").alias(chunk), "ancestor", (F.col("_n") - 1 - F.col("_i")).alias("distance"))


def ancestor_at_depth(tree: DataFrame, depth: int, source: str = "source", chunk: str = "chunk_id", order: str = "chunk_index", level: str = "depth") -> DataFrame:
    """The nearest chunk at or above each chunk whose ``level`` is ``depth``: (source, chunk, ancestor); none: no row.

    Levels are those of the headings, which a tree may skip.
    """
    up = tree.where("path is not null").select(source, F.col(chunk).alias("_c"), F.posexplode("path").alias("_i", "_o"))
    there = tree.where(F.col(level) == depth).select(source, F.col(order).cast("long").alias("_o"), F.col(chunk).alias("ancestor"))
    best = up.join(there, [source, "_o"]).groupBy(source, "_c").agg(F.max_by("ancestor", "_i").alias("ancestor"))
    return best.withColumnRenamed("_c", chunk)


def subtrees(tree: DataFrame, targets: DataFrame, source: str = "source", chunk: str = "chunk_id", order: str = "chunk_index", content: str = "content", between: str = "\n\n") -> DataFrame:
    """(source, chunk, content): the text of each target with all below it, depth first.

    ``targets`` (source, chunk) meet the chunks below by the numbers on their paths, so only
    rows below a target move.
    """
    wanted = targets.select(source, F.col(chunk).alias("_t")).distinct().join(tree.select(source, F.col(chunk).alias("_t"), F.col(order).cast("long").alias("_o")), [source, "_t"])
    below = tree.where("path is not null").select(source, "enter", F.coalesce(content, F.lit("")).alias("_text"), F.explode("path").alias("_o"))
    parts = F.array_sort(F.collect_list(F.struct("enter", "_text")))  # what is shown of one section
    text = below.join(wanted, [source, "_o"]).groupBy(source, "_t").agg(F.array_join(F.transform(parts, lambda p: p["_text"]), between).alias("content"))
    return text.withColumnRenamed("_t", chunk)


def section_context(tree: DataFrame, hits: DataFrame, source: str = "source", chunk: str = "chunk_id", parent: str = "parent_id", title: str = "section_title", level: str = "depth", **names: str) -> DataFrame:
    """Each hit (source, chunk) with the section around it: that of its parent, or its own where it has none.

    Adds target, section_title, depth and content; hits that are not in the tree go.
    """
    own = tree.select(source, F.col(chunk).alias("_c"), F.col(parent).alias("_p"))
    there = tree.select(source, F.col(chunk).alias("_p"), F.lit(True).alias("_has"))
    found = hits.select(source, F.col(chunk).alias("_c")).distinct().join(own, [source, "_c"]).join(there, [source, "_p"], "left")
    found = found.select(source, F.col("_c"), F.when(F.col("_has"), F.col("_p")).otherwise(F.col("_c")).alias("target"))
    info = tree.select(source, F.col(chunk).alias("target"), F.col(title).alias("section_title"), F.col(level).alias("depth"))
    text = subtrees(tree, found.select(source, F.col("target").alias(chunk)), source, chunk, **names).withColumnRenamed(chunk, "target")
    return found.join(info, [source, "target"]).join(text, [source, "target"], "left").withColumnRenamed("_c", chunk)


#: Characters below which a chunk without children only holds a place.
SHORT = 50


def orphans_fixed(chunks: DataFrame, source: str = "source", chunk: str = "chunk_id", parent: str = "parent_id", order: str = "chunk_index", title: str = "section_title", level: str = "depth", chars: str = "char_count", placeholder: str = "is_placeholder") -> DataFrame:
    """Chunks with ``has_children`` and short ones without children marked as placeholders.

    A placeholder at depth 1 that is not the source's first chunk of that depth becomes its child.
    ``has_children`` tells of the children before that: only the first chunk of depth 1 gains any,
    and it comes before all that it gains. Chunks without a title are never marked, a null length
    is 0; a source of a single chunk stays as it is, ``has_children`` null.
    """
    by = Window.partitionBy(source)
    rows = chunks.withColumns({"_n": F.count(F.lit(1)).over(by), "_root": F.min(F.when(F.col(level) == 1, F.struct(F.col(order).alias("o"), F.col(chunk).alias("c")))).over(by)["c"]})
    parents = chunks.where(F.col(parent).isNotNull() & (F.col(parent) != "")).select(F.col(source).alias("_s"), F.col(parent).alias("_c")).distinct().withColumn("_has", F.lit(True))
    rows = rows.join(parents, (F.col(source) == F.col("_s")) & (F.col(chunk) == F.col("_c")), "left").drop("_s", "_c")
    many, has = F.col("_n") > 1, F.coalesce("_has", F.lit(False))
    marked = many & ~has & (F.coalesce(chars, F.lit(0)) < SHORT) & (F.coalesce(F.length(title), F.lit(0)) > 0)
    moved = marked & (F.col(level) == 1) & F.col("_root").isNotNull() & (F.col("_root") != F.col(chunk))
    new = {
        parent: F.when(moved, F.col("_root")).otherwise(F.col(parent)),
        placeholder: marked | F.coalesce(placeholder, F.lit(False)),
        "has_children": F.when(many, has),
    }
    return rows.withColumns(new).drop("_n", "_root", "_has")
