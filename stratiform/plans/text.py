"""Text queries: tagging, cleaning, headings, chunks, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.functions import text as X
from stratiform.operators import text as O
from stratiform.plans.base import query, table

_H = {k: "(" + " + ".join(f"contains(text, '{w}')::INTEGER" for w in ws) + ")" for k, ws in X.ENGLISH_WORDS.items()}
_V = "v AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS tag, {i} AS pos, {h} AS score FROM documents" for i, (k, h) in enumerate(_H.items())) + ")"


@query("dimension_tags", f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM v WHERE score > 0) SELECT d.doc_id, coalesce(string_agg(r.tag, ',' ORDER BY rn), '') AS tags FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rn <= 3 GROUP BY 1")
def dimension_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.top_tags(F.col("text"), X.ENGLISH_WORDS), ",").alias("tags"))


@query("terrain_argmax", f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM v WHERE score > 0) SELECT d.doc_id, coalesce(r.tag, 'all') AS terrain FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rn = 1")
def terrain_argmax(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.best_tag(F.col("text"), X.ENGLISH_WORDS, "all").alias("terrain"))


_TYPES = " ".join(f"WHEN regexp_matches({'lower(name)' if k == 'standard' else 'name'}, '{w}') THEN '{k}'" for k, w in X.DOC_TYPES)
_TITLES = " ".join(f"WHEN regexp_matches({'lower(name)' if k == 'standard' else 'name'}, '{w}{'|法' if k == 'policy' else ''}') THEN '{k}'" for k, w in X.DOC_TYPES)


@query("doc_type_cascade", rf"""WITH n AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS name FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(text, '第[一二三四五六七八九十\d]+章') THEN 'textbook' {_TYPES} ELSE 'report' END AS of_file, CASE WHEN regexp_matches(name, '(?i)[A-Z]{{2,4}}[/\-]?\d{{4,}}') THEN 'standard' {_TITLES} ELSE 'report' END AS of_title FROM n""")
def doc_type_cascade(spark, sf_dir):
    name = F.split("text", "\n", -1)[0]
    return table(spark, sf_dir, "documents").select("doc_id", X.doc_type_of_file(name, F.col("text")).alias("of_file"), X.doc_type_of_title(name).alias("of_title"))


@query("metrics_extract", "SELECT doc_id, " + ", ".join(f"try_cast(nullif(regexp_extract(text, '{p}', 1), '') AS DOUBLE) AS {k}" for k, p in X.METRICS.items()) + " FROM documents")
def metrics_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[v.alias(k) for k, v in X.metrics(F.col("text")).items()])


@query("document_lines", "SELECT doc_id, i - 1 AS pos, md5(l[i]) AS line_md5 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1))::INTEGER AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def document_lines(spark, sf_dir):
    return O.lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.md5(F.col("line").cast("binary")).alias("line_md5"))


_L = "l AS (SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1))::INTEGER AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


@query("clean_lines", f"WITH {_L} SELECT doc_id, pos FROM l WHERE NOT (trim(line) = '' OR regexp_matches(line, '^All rights') OR (pos < 2 AND regexp_matches(line, 'License')))")
def clean_lines(spark, sf_dir):
    return O.clean_lines(O.lines(table(spark, sf_dir, "documents")), "^All rights", "License", 2).select("doc_id", "pos")


_HP = f"""{_L}, h AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN '# ' || line WHEN pos % 3 = 0 THEN '## ' || line ELSE 'x' || line END AS line FROM l),
 g AS (SELECT *, CASE WHEN starts_with(line, '# ') THEN 1 WHEN starts_with(line, '## ') THEN 2 END AS level FROM h)"""


def _headed(spark, sf_dir):
    r = O.lines(table(spark, sf_dir, "documents"))
    return r.withColumn("line", F.when(F.col("pos") % 7 == 0, F.concat(F.lit("# "), "line")).when(F.col("pos") % 3 == 0, F.concat(F.lit("## "), "line")).otherwise(F.concat(F.lit("x"), "line")))


@query("heading_path", f"""WITH {_HP}, p AS (SELECT doc_id, pos, level, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level <= 2 THEN pos END IGNORE NULLS) OVER w AS p2 FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT p.doc_id, p.pos, p.level, ltrim(a.line[2:]) AS h1, CASE WHEN b.level = 2 THEN ltrim(b.line[3:]) END AS h2 FROM p LEFT JOIN g a ON a.doc_id = p.doc_id AND a.pos = p.p1 LEFT JOIN g b ON b.doc_id = p.doc_id AND b.pos = p.p2""")
def heading_path(spark, sf_dir):
    return O.heading_paths(_headed(spark, sf_dir)).select("doc_id", "pos", "level", "h1", "h2")


@query("section_sizes", f"""WITH {_HP}, s AS (SELECT doc_id, count(level) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, pos, line FROM g)
 SELECT doc_id, section, md5(string_agg(line, chr(10) ORDER BY pos)) AS content_md5 FROM s GROUP BY 1, 2""")
def section_sizes(spark, sf_dir):
    return O.sections(_headed(spark, sf_dir)).select("doc_id", "section", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("paragraph_chunks", f"WITH {_L} SELECT doc_id, pos AS chunk_index, doc_id || '_' || pos || '_' || substr(md5(line), 1, 8) AS chunk_id FROM l WHERE trim(line) <> ''")
def paragraph_chunks(spark, sf_dir):
    p = O.paragraphs(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "chunk_index", X.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


@query("recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return O.chunks(table(spark, sf_dir, "documents"), 1000, 100).select("doc_id", "chunk_index", "chunk_id", "title")


@query("table_numbers", f"WITH {_L}, t AS (SELECT d.source, l.doc_id, l.pos, contains(l.line, '|') AS it FROM l JOIN documents d USING (doc_id)), u AS (SELECT *, it AND NOT coalesce(lag(it) OVER w AND lag(doc_id) OVER w = doc_id, false) AS st FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id, pos)) SELECT source, doc_id, pos, table_no FROM (SELECT *, (sum(st::INTEGER) OVER (PARTITION BY source ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS table_no FROM u) WHERE it")
def table_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = O.lines(d).join(d.select("doc_id", "source"), "doc_id")
    return O.table_numbers(rows, "source").select("source", "doc_id", "pos", "table_no")


@query("html_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(" + "regexp_replace(" * 5 + "html" + "".join(f", '<{t}[^>]*>.*?</{t}>', ' ', 'gis')" for t in ("script", "style", "nav", "footer", "header")) + r", '<[^>]*>', ' ', 'gs'), '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("clean_markdown", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM documents")
def clean_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_markdown(F.col("text")).cast("binary")).alias("clean_md5"))


@query("table_flags", "SELECT doc_id, contains(text, '<table>') OR (contains(text, '|') AND contains(text, '---')) AS has_table, md5(doc_id || ':' || lang) AS cache_key FROM documents")
def table_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.has_table(F.col("text")).alias("has_table"), X.cache_key(F.col("doc_id").cast("string"), F.col("lang")).alias("cache_key"))


@query("depth_histogram", f"""WITH {_HP}, p AS (SELECT doc_id, pos, count(level) OVER w AS section, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level <= 2 THEN pos END) OVER w AS p2 FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT doc_id, section, max((p1 IS NOT NULL)::INTEGER + (p2 IS NOT NULL AND p2 IS DISTINCT FROM p1)::INTEGER) AS depth FROM p GROUP BY 1, 2) SELECT lang, depth, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY 1, 2""")
def depth_histogram(spark, sf_dir):
    """Sections of the documents of each language by the depth of their headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return O.sections(_headed(spark, sf_dir)).join(d, "doc_id").groupBy("lang", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


_ROWS = "t AS (SELECT doc_id, pos, CASE pos % 6 WHEN 2 THEN '| ' || line || ' | b |' WHEN 3 THEN '|---|---|' WHEN 4 THEN '| x | ' || line || ' |' ELSE line END AS line FROM l)"


@query("markdown_tables", rf"""WITH {_L}, {_ROWS}, s AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM t), u AS (SELECT *, s LIKE '|%' AS bar, coalesce(lag(s LIKE '|%') OVER w, false) AS was, last_value(CASE WHEN s <> '' AND s NOT LIKE '|%' AND s NOT LIKE '-%' THEN left(s, 60) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS name FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 r AS (SELECT *, sum((bar AND NOT was)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run, list_filter(list_transform(string_split(s, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cells FROM u),
 h AS (SELECT *, min(CASE WHEN s NOT LIKE '|---%' THEN pos END) OVER (PARTITION BY doc_id, run) AS head FROM r WHERE bar), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS n FROM h WHERE pos >= head),
 g AS (SELECT doc_id, run, arg_min(coalesce(name, ''), pos) AS name, arg_min(cells, pos) AS headers, count(*) FILTER (n > 1 AND len(cells) > 0 AND NOT (n = 2 AND regexp_matches(s, '^\|[\s\-:]+\|'))) AS n_rows, coalesce(string_agg(array_to_string(cells, ','), ';' ORDER BY pos) FILTER (n > 1 AND len(cells) > 0 AND NOT (n = 2 AND regexp_matches(s, '^\|[\s\-:]+\|'))), '') AS body FROM k GROUP BY 1, 2)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run))::INTEGER AS table_no, name, array_to_string(headers, ',') AS headers, n_rows, md5(body) AS rows_md5 FROM g WHERE len(headers) > 0 AND n_rows > 0""")
def markdown_tables(spark, sf_dir):
    n = F.col("pos") % 6
    line = F.when(n == 2, F.concat(F.lit("| "), "line", F.lit(" | b |"))).when(n == 3, "|---|---|").when(n == 4, F.concat(F.lit("| x | "), "line", F.lit(" |"))).otherwise(F.col("line"))
    t = O.markdown_tables(O.lines(table(spark, sf_dir, "documents")).withColumn("line", line))
    body = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return t.select("doc_id", "table_no", "name", F.array_join("headers", ",").alias("headers"), F.size("rows").cast("long").alias("n_rows"), F.md5(body.cast("binary")).alias("rows_md5"))


@query("phrase_frequency", "SELECT lang, p, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-z]{6,8}')) AS p FROM documents) GROUP BY 1, 2 HAVING count(*) >= 2")
def phrase_frequency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,8}"), F.lit(0))).alias("p"))
    return d.groupBy("lang", "p").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
