"""Ingest of document folders: a manifest of content hashes, so that reruns add nothing and changes replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratiform.functions import text as X
from stratiform.operators import chunking as C, store, text as O, tree
from stratiform.operators.planning import parent_chunks
from stratiform.settle import settled
from stratiform.sources.files import read_directory, texts_of

# Fields of the lines at the head of a published text.
METADATA_FIELDS = ["索引号", "分类", "发布机构", "成文日期", "名称", "文号", "发布日期", "主题词", "索 引 号", "发文机关", "标 题"]
MANIFEST = "source string, content_hash string, chunks long, live boolean, batch long"


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of texts (source, text): cleaned, cut at headings, long ones split, short ones without children marked.

    Returns source, chunk_index, chunk_id, parent_id, depth, section_title, ancestors, content,
    char_count, is_placeholder, has_children, has_table, doc_type and dimensions. Ancestors that
    have no chunk of their own get one that holds their heading, after all others.
    """
    named = docs.select(F.col("source").alias("doc_id"), "text")
    rows = C.cleaned(named, METADATA_FIELDS)
    s = O.sections(O.lines(rows.select("doc_id", F.col("content").alias("text"))))
    s = s.select("doc_id", "section", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "content").where(F.length(F.trim("content")) > 0)
    s = settled(s)  # read five times below
    missing = O.placeholders(s)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.size("path"), "path"))
    most = s.groupBy("doc_id").agg(F.max("section").alias("_m"))
    added = missing.withColumn("_i", order).join(most, "doc_id").select("doc_id", (F.col("_m") + F.col("_i")).alias("section"), "path", F.concat(F.repeat(F.lit("#"), F.size("path")), F.lit(" "), F.element_at("path", -1)).alias("content"), F.lit(True).alias("is_placeholder"))
    s = s.withColumn("is_placeholder", F.lit(False)).unionByName(added)
    title = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(""))
    s = s.select("doc_id", F.col("section").alias("chunk_index"), X.chunk_id(F.col("doc_id"), F.col("section"), F.col("content")).alias("chunk_id"), title.alias("title"), F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("ancestors"), F.size("path").alias("depth"), "content", "is_placeholder")
    s = C.long_chunks_split(parent_chunks(s).withColumnsRenamed({"doc_id": "source", "title": "section_title"}))
    s = settled(s).withColumn("chunk_index", F.row_number().over(Window.partitionBy("source").orderBy("chunk_index", "part")) - 1)
    s = tree.orphans_fixed(s).drop("part", "parent_chunk_id")
    kinds = docs.select("source", X.doc_type_of_file(F.col("source"), F.col("text")).alias("doc_type"))
    return s.join(kinds, "source").withColumns({"has_table": X.has_table(F.col("content")), "dimensions": X.top_tags(F.col("content"), X.DIMENSION_WORDS)})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of every source that was ever there; ``live`` tells whether it still is."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    newest = rows.groupBy("source").agg(F.max_by(F.struct("content_hash", "chunks", "live", "batch"), "batch").alias("m"))
    return newest.select("source", "m.*")


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all live sources, each from the batch that its manifest entry names."""
    live = manifest(spark, path).where("live").select("source", "batch")
    return spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks").join(live, ["source", "batch"]).drop("batch")


def apply_files(spark: SparkSession, files: DataFrame, path: str, whole: bool) -> dict[str, int]:
    """Bring a store up to date with files (source, content_hash, text), and count what was done.

    New and changed files are chunked into a batch of their own; the manifest entries that make
    them valid are written last, so a run that fails on the way leaves the store as it was and its
    rerun writes over what it left. With ``whole`` the files are all there are: sources that are
    not among them are marked as gone. Files with equal hashes cost one comparison.
    """
    known = manifest(spark, path)
    live = known.where("live")
    plan = settled(store.upsert_plan(live.select("source", "content_hash"), files.select("source", "content_hash"), "source", "content_hash"))
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    done = {"insert": counts.get("insert", 0), "update": counts.get("update", 0), "skip": counts.get("skip", 0), "delete": counts.get("keep", 0) if whole else 0}
    if not done["insert"] + done["update"] + done["delete"]:
        return done
    batch = (known.agg(F.max("batch").alias("b")).first()["b"] or 0) + 1
    fresh = settled(files.join(plan.where("action in ('insert', 'update')").select("source"), "source"))
    target = f"{path}/chunks/batch={batch}"
    chunked(fresh.select("source", "text")).write.mode("overwrite").parquet(target)
    n = spark.read.parquet(target).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    entries = fresh.select("source", "content_hash").join(n, "source", "left").select("source", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(True).alias("live"))
    if whole:
        gone = plan.where("action = 'keep'").select("source").join(live, "source")
        entries = entries.unionByName(gone.select("source", "content_hash", F.lit(0).cast("long").alias("chunks"), F.lit(False).alias("live")))
    entries.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    return done


def _named(files: DataFrame) -> DataFrame:
    """Sources are named by their files; files of one name in several folders are one, the last by path.

    Files that could not be read are left out, as are those without text.
    """
    read = files.where("error is null").withColumn("source", F.regexp_extract("path", r"([^/]+)$", 1))
    last = read.groupBy("source").agg(F.max(F.struct("path", "content_hash", "text")).alias("f"))
    return last.select("source", "f.content_hash", "f.text")


def sync_folder(spark: SparkSession, folder: str, path: str, pattern: str = "*") -> dict[str, int]:
    """Make the store at ``path`` hold just the documents of a folder: counts of insert, update, skip and delete."""
    return apply_files(spark, _named(read_directory(spark, folder, pattern)), path, whole=True)


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, files_per_batch: int = 1000, pattern: str = "*") -> None:
    """Take in what is new in a folder and stop; a micro-batch that is run again after a failure adds nothing.

    A file source tells new paths only: changed and deleted files are found by ``sync_folder``.
    """
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = source.schema(schema).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        apply_files(batch.sparkSession, _named(texts_of(batch)), path, whole=False)

    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
