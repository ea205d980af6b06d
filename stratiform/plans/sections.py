"""Section trees, chunk repair, cleaning and document views: conversations are documents, their turns sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators import chunking as C, documents as D, tree as T
from stratiform.operators.text import lines
from stratiform.plans.base import query, table
from stratiform.sources.ingest import METADATA_FIELDS

#: A turn stands below the one of half its number; of equal turns the first counts.
_CH = """ch AS (SELECT conv_id AS source, turn::INTEGER AS chunk_index, 'c' || turn AS chunk_id, CASE WHEN turn > 1 THEN 'c' || (turn // 2) END AS parent_id, coalesce(text, '') AS content, role AS section_title, length(coalesce(text, '')) AS char_count,
 (CASE WHEN turn > 1 THEN turn % 3 ELSE 1 END)::INTEGER AS depth FROM (SELECT conv_id, turn, min(text) AS text, min(role) AS role FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1, 2))"""
_TREE = f"""WITH RECURSIVE {_CH}, tr AS (SELECT source, chunk_id, chunk_index, [chunk_index] AS path FROM ch c WHERE NOT EXISTS (SELECT 1 FROM ch p WHERE p.source = c.source AND p.chunk_id = c.parent_id)
 UNION ALL SELECT ch.source, ch.chunk_id, ch.chunk_index, list_append(tr.path, ch.chunk_index) FROM tr JOIN ch ON ch.source = tr.source AND ch.parent_id = tr.chunk_id),
 w AS (SELECT a.source, a.chunk_id, a.chunk_index, a.path, (row_number() OVER (PARTITION BY a.source ORDER BY a.path))::INTEGER AS enter FROM tr a),
 up AS (SELECT b.source, b.chunk_id, a.chunk_id AS ancestor, len(b.path) - len(a.path) AS distance FROM w a JOIN w b ON a.source = b.source AND list_contains(b.path, a.chunk_index))"""


def chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("turn is not null and conv_id is not null").groupBy(F.col("conv_id").alias("source"), "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("content"), F.min("role").alias("section_title"))
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    t = F.col("turn")
    return c.select(
        "source", t.cast("int").alias("chunk_index"), name(t).alias("chunk_id"), F.when(t > 1, name(F.floor(t / 2))).alias("parent_id"), "content", "section_title", F.length("content").alias("char_count"),
        F.when(t > 1, t % 3).otherwise(1).cast("int").alias("depth"), F.lit(False).alias("is_placeholder"), F.lit("talk").alias("doc_type"),
    )


@query("section_intervals", f"{_TREE} SELECT source, chunk_id, enter, (enter + (SELECT count(*) FROM up WHERE up.source = w.source AND up.ancestor = w.chunk_id) - 1)::INTEGER AS leave FROM w")
def section_intervals(spark, sf_dir):
    return T.with_intervals(chunks(spark, sf_dir)).select("source", "chunk_id", "enter", "leave")


@query("section_ancestors", f"{_TREE} SELECT * FROM up WHERE distance > 0")
def section_ancestors(spark, sf_dir):
    return T.ancestors(T.with_intervals(chunks(spark, sf_dir)))


@query("ancestor_at_depth", f"{_TREE} SELECT up.source, up.chunk_id, arg_min(ancestor, distance) AS ancestor FROM up JOIN ch ON ch.source = up.source AND ch.chunk_id = up.ancestor WHERE ch.depth = 2 GROUP BY 1, 2")
def ancestor_at_depth(spark, sf_dir):
    return T.ancestor_at_depth(T.with_intervals(chunks(spark, sf_dir)), 2)


@query("section_context", f"""{_TREE}, tg AS (SELECT c.source, c.chunk_id, CASE WHEN p.chunk_id IS NULL THEN c.chunk_id ELSE p.chunk_id END AS target FROM ch c LEFT JOIN ch p ON p.source = c.source AND p.chunk_id = c.parent_id WHERE c.chunk_index % 3 = 0),
 tx AS (SELECT up.source, up.ancestor AS target, md5(string_agg(content, chr(10) || chr(10) ORDER BY enter)) AS content_md5 FROM up JOIN w ON w.source = up.source AND w.chunk_id = up.chunk_id JOIN ch ON ch.source = up.source AND ch.chunk_id = up.chunk_id GROUP BY 1, 2)
 SELECT tg.source, tg.chunk_id, target, section_title, depth, content_md5 FROM tg JOIN tx USING (source, target) JOIN ch ON ch.source = tg.source AND ch.chunk_id = target""")
def section_context(spark, sf_dir):
    tree = T.with_intervals(chunks(spark, sf_dir))
    out = T.section_context(tree, tree.where("chunk_index % 3 = 0").select("source", "chunk_id"))
    return out.select("source", "chunk_id", "target", "section_title", "depth", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("orphan_headings", f"""WITH {_CH}, n AS (SELECT *, CASE WHEN char_count < 150 AND chunk_index % 2 = 0 THEN char_count // 10 ELSE char_count END AS cc, count(*) OVER (PARTITION BY source) AS many, arg_min(chunk_id, chunk_index) FILTER (depth = 1) OVER (PARTITION BY source) AS root FROM ch),
 m AS (SELECT n.*, EXISTS (SELECT 1 FROM ch k WHERE k.source = n.source AND k.parent_id = n.chunk_id) AS has FROM n), o AS (SELECT *, many > 1 AND NOT has AND cc < 50 AND length(section_title) > 0 AS mark FROM m)
 SELECT source, chunk_id, CASE WHEN mark AND depth = 1 AND root <> chunk_id THEN root ELSE parent_id END AS parent_id, mark AS is_placeholder, CASE WHEN many > 1 THEN has END AS has_children FROM o""")
def orphan_headings(spark, sf_dir):
    short = F.when((F.col("char_count") < 150) & (F.col("chunk_index") % 2 == 0), F.floor(F.col("char_count") / 10)).otherwise(F.col("char_count"))
    out = T.orphans_fixed(chunks(spark, sf_dir).withColumn("char_count", short.cast("int")))
    return out.select("source", "chunk_id", "parent_id", "is_placeholder", "has_children")


#: Documents as code with a tail: beyond the limit, code of more than seven tenths of it becomes a line.
_CODE = "'lead ' || coalesce(text, '') || chr(10) || '```' || repeat(coalesce(text, '') , (doc_id % 3)::INTEGER) || '```'"


@query("code_summaries", f"""WITH d AS (SELECT doc_id, {_CODE} AS t, '```' || repeat(coalesce(text, ''), (doc_id % 3)::INTEGER) || '```' AS code, trim('lead ' || coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM documents WHERE NOT coalesce(contains(text, '```') OR contains(text, '<table>'), false)),
 n AS (SELECT *, '[代码块摘要: 1 个代码块, 共 ' || length(code) || ' 字符]' AS note FROM d WHERE length(t) > 2000 AND length(code) > 1400)
 SELECT doc_id, md5((left(rest, 2000 - length(note)::INTEGER - 100) || chr(10) || chr(10) || note)[1:2000]) AS content_md5 FROM n""")
def code_summaries(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").where(~F.coalesce(F.contains("text", F.lit("```")) | F.contains("text", F.lit("<table>")), F.lit(False)))
    d = d.select("doc_id", F.concat(F.lit("lead "), text, F.lit("\n```"), F.repeat(text, (F.col("doc_id") % 3).cast("int")), F.lit("```")).alias("content"), F.lit("t").alias("section_title"), F.col("doc_id").alias("chunk_id"))
    out = C.long_chunks_split(d, limit=2000, overlap=0)
    return out.where("parent_chunk_id is not null and content like '%代码块摘要%'").select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"


@query("cleaned_documents", rf"""WITH l AS (SELECT doc_id, pos, CASE pos % 9 WHEN 0 THEN '# 第' || (pos % 4 + 1) || '章' WHEN 1 THEN '# ' || line WHEN 5 THEN '文号：' || line WHEN 7 THEN '* 3 -' ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE NOT contains(text, '```') AND NOT contains(text, '<!--'))),
 k AS (SELECT * FROM l WHERE trim(line) <> '' AND NOT ({_TRIM} = '* 3 -' OR (pos < 20 AND {_TRIM} LIKE '文号：%'))), h AS (SELECT *, regexp_full_match(line, '#{{1,6}}\s+.+') AS hd, lead(line) OVER w AS nl, lag(line) OVER w AS pl FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 m AS (SELECT *, regexp_full_match(line, '# 第[0-9]+章') AND coalesce(regexp_full_match(nl, '#\s+.+'), false) AS opens, coalesce(regexp_full_match(pl, '# 第[0-9]+章'), false) AND regexp_full_match(line, '#\s+.+') AS taken FROM h),
 j AS (SELECT doc_id, pos, CASE WHEN opens THEN line || ' ' || trim(regexp_replace(nl, '^#\s+', ''), ' ' || chr(9)) ELSE line END AS line FROM m WHERE NOT taken), b AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nl FROM j)
 SELECT doc_id, md5(string_agg(CASE WHEN line LIKE '#%' AND nl NOT LIKE '#%' THEN line || chr(10) ELSE line END, chr(10) ORDER BY pos)) AS content_md5 FROM b GROUP BY 1""")
def cleaned_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("not contains(text, '```') and not contains(text, '<!--')")
    n = F.col("pos") % 9
    line = F.when(n == 0, F.concat(F.lit("# 第"), (F.col("pos") % 4 + 1).cast("string"), F.lit("章"))).when(n == 1, F.concat(F.lit("# "), "line")).when(n == 5, F.concat(F.lit("文号："), "line")).when(n == 7, "* 3 -").otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))  # the lines of one document
    text = lines(d).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))
    return C.cleaned(text, METADATA_FIELDS).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("document_list", f"WITH {_CH} SELECT source, 'talk' AS doc_type, left(arg_min(content, chunk_index), 100) AS preview, count(*) AS chunks, sum(char_count)::BIGINT AS chars FROM ch GROUP BY 1")
def document_list(spark, sf_dir):
    return D.listed(chunks(spark, sf_dir))


@query("document_overviews", f"""WITH {_CH}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_index) AS i FROM ch WHERE depth = 1 AND length(section_title) > 0), c AS (SELECT source, string_agg(i || '. ' || section_title, chr(10) ORDER BY i) AS chapters FROM t GROUP BY 1)
 SELECT s.source, '【文档概览】' || chr(10) || '来源: ' || s.source || chr(10) || '类型: talk' || chr(10) || chr(10) || CASE WHEN s.source % 2 = 0 THEN '**执行摘要**' || chr(10) || 'about ' || s.source || chr(10) ELSE '⚠️  该文档尚未生成摘要' || chr(10) END || coalesce(chr(10) || '**章节列表**' || chr(10) || chapters || chr(10), '') AS text
 FROM (SELECT DISTINCT source FROM ch) s LEFT JOIN c USING (source)""")
def document_overviews(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("source", F.col("source").cast("string"))
    sums = c.select("source").distinct().where(F.col("source").cast("long") % 2 == 0).select("source", F.concat(F.lit("about "), "source").alias("summary"))
    return D.overview(c, sums).select(F.col("source").cast("long").alias("source"), "text")


@query("chapter_views", f"""WITH {_CH}, q(pattern, level) AS (VALUES ('user', 'summary'), ('assist', 'full'), ('system', 'medium'), ('none', 'full'), ('user', 'other')), m AS (SELECT s.source, pattern, level, min(chunk_index) AS ci FROM (SELECT DISTINCT source FROM ch) s CROSS JOIN q LEFT JOIN ch ON ch.source = s.source AND contains(section_title, pattern) GROUP BY 1, 2, 3),
 x AS (SELECT m.source, pattern, level, ci, content FROM m LEFT JOIN ch ON ch.source = m.source AND ch.chunk_index = ci)
 SELECT source, pattern, level, CASE WHEN level = 'other' THEN 'level' WHEN ci IS NULL THEN 'chapter' END AS error, CASE WHEN level <> 'other' AND ci IS NOT NULL THEN md5('【知识片段 1】' || chr(10) || '来源: ' || source || chr(10) || '位置: 第1 页' || chr(10) || '内容:' || chr(10) ||
 CASE level WHEN 'summary' THEN left(content, 200) WHEN 'full' THEN content ELSE '**摘要**' || chr(10) || left(content, 200) || chr(10) || chr(10) || '**关键要点**' || chr(10) || '  • ' || left(content, 20) END) END AS text_md5 FROM x""")
def chapter_views(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumns({"source": F.col("source").cast("string"), "summary": F.lit(None).cast("string"), "key_points": F.array(F.substring("content", 1, 20))})
    asked = spark.createDataFrame([("user", "summary"), ("assist", "full"), ("system", "medium"), ("none", "full"), ("user", "other")], "pattern string, level string")
    asked = c.select("source").distinct().crossJoin(F.broadcast(asked))  # five requests a source
    out = D.chapter(c, asked)
    return out.select(F.col("source").cast("long").alias("source"), "pattern", "level", "error", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("key_point_matches", f"WITH {_CH}, p AS (SELECT DISTINCT source, left(content, 40) AS point FROM ch) SELECT DISTINCT query, source, point FROM p, (VALUES ('THE', 0), ('re', 3)) q(query, part) WHERE contains(lower(point), lower(query)) AND (part = 0 OR source IN (3, 6, 9))")
def key_point_matches(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("key_points", F.array(F.substring("content", 1, 40)))
    return D.matching_points(c, spark.createDataFrame([("THE", None), ("re", [3, 6, 9])], "query string, sources array<long>"))


@query("full_documents", f"WITH {_CH} SELECT source, count(*) AS total_chunks, length(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS length, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS content_md5 FROM ch GROUP BY 1")
def full_documents(spark, sf_dir):
    return D.full_text(chunks(spark, sf_dir)).select("source", "total_chunks", "length", F.md5(F.col("content").cast("binary")).alias("content_md5"))
