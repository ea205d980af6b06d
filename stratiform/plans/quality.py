"""Quality metrics and group statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from stratiform.functions import stats as X
from stratiform.operators import citations as C, quality as Q
from stratiform.plans.base import SHARES, query, table

_G = "g AS (SELECT l_returnflag AS grp, l_linenumber AS iter, l_extendedprice / 1000.0 AS value FROM lineitem)"


def samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("iter"), (F.col("l_extendedprice") / 1000.0).alias("value"))


@query("group_means", f"WITH {_G} SELECT grp, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) AS half FROM g GROUP BY 1")
def group_means(spark, sf_dir):
    g = samples(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), X.sample_std(F.col("value")).alias("s"))
    return g.select("grp", "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), F.round(X.ci_half_width(F.col("s"), F.col("n")), 6).alias("half"))


_A = f"WITH {_G}, s AS (SELECT grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM g GROUP BY 1)"


def _sides(spark, sf_dir):
    s = samples(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a = s.filter("grp = 'A'").select(*[F.col(c).alias(f"{c}1") for c in s.columns])
    b = s.filter("grp <> 'A'").select(*[F.col(c).alias(f"{c}2") for c in s.columns])
    return b.crossJoin(F.broadcast(a))  # one row


@query("cohens_d_weighted", f"{_A} SELECT b.grp, round((b.m - a.m) / CASE WHEN sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) = 0 THEN 0.001 ELSE sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) END, 6) AS d FROM s a, s b WHERE a.grp = 'A' AND b.grp <> 'A'")
def cohens_d_weighted(spark, sf_dir):
    d = X.cohens_d_weighted(*(F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")))
    return _sides(spark, sf_dir).select(F.col("grp2").alias("grp"), F.round(d, 6).alias("d"))


@query("cohens_d_plain", f"{_A} SELECT b.grp, round(CASE WHEN sqrt((a.v + b.v) / 2) > 0 THEN (b.m - a.m) / sqrt((a.v + b.v) / 2) ELSE 0 END, 6) AS d FROM s a, s b WHERE a.grp = 'A' AND b.grp <> 'A'")
def cohens_d_plain(spark, sf_dir):
    return _sides(spark, sf_dir).select(F.col("grp2").alias("grp"), F.round(X.cohens_d_plain(F.col("m1"), F.col("v1"), F.col("m2"), F.col("v2")), 6).alias("d"))


_PAIR = f"""WITH {_G}, i AS (SELECT grp, iter, avg(value) AS value FROM g GROUP BY 1, 2), p AS (SELECT b.grp, b.iter, b.value - a.value AS d FROM i a JOIN i b USING (iter) WHERE a.grp = 'A' AND b.grp <> 'A'),
 t AS (SELECT grp, count(*) AS n, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) ELSE 0 END AS t FROM p GROUP BY 1)"""


def _paired(spark, sf_dir):
    i = samples(spark, sf_dir).groupBy("grp", "iter").agg(F.avg("value").alias("value"))
    a = i.filter("grp = 'A'").select("iter", F.col("value").alias("base"))
    return i.filter("grp <> 'A'").join(a, "iter").withColumn("d", F.col("value") - F.col("base")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), X.paired_t(F.col("d")).alias("t"))


_P = "CASE WHEN n - 1 >= 30 THEN CASE WHEN abs(t) > 3.29 THEN 0.001 WHEN abs(t) > 2.58 THEN 0.01 WHEN abs(t) > 1.96 THEN 0.05 ELSE 0.1 END ELSE CASE WHEN abs(t) > 4 THEN 0.001 WHEN abs(t) > 3 THEN 0.01 WHEN abs(t) > 2 THEN 0.05 ELSE 0.1 END END::DOUBLE"


@query("compare_groups", f"""{_PAIR}, s AS (SELECT grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM g GROUP BY 1), w AS (SELECT b.grp, a.m - b.m AS diff, CASE WHEN b.m <> 0 THEN (a.m - b.m) / b.m * 100 ELSE 0 END AS percent,
 (a.m - b.m) / CASE WHEN ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) > 0 THEN sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) ELSE 0.001 END AS d FROM s a, s b WHERE a.grp = 'A' AND b.grp <> 'A'), p AS (SELECT grp, -t AS t, {_P} AS p FROM t)
 SELECT grp, round(diff, 6) AS diff, round(percent, 4) AS percent, round(d, 6) AS d, round(t, 6) AS t, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM w JOIN p USING (grp)""".replace("p AS (SELECT grp, -t", "q AS (SELECT grp, -t").replace("w JOIN p USING", "w JOIN q USING"))
def compare_groups(spark, sf_dir):
    """Group A against each other group."""
    diff = F.col("m1") - F.col("m2")
    w = _sides(spark, sf_dir).select(F.col("grp2").alias("grp"), diff.alias("diff"), F.when(F.col("m2") != 0, diff / F.col("m2") * 100).otherwise(0.0).alias("percent"), X.cohens_d_weighted(*(F.col(c) for c in ("n2", "m2", "v2", "n1", "m1", "v1"))).alias("d"))
    t = _paired(spark, sf_dir).select("grp", (-F.col("t")).alias("t"), X.p_step(F.col("t"), F.col("n") - 1).alias("p"))
    return w.join(t, "grp").select("grp", F.round("diff", 6).alias("diff"), F.round("percent", 4).alias("percent"), F.round("d", 6).alias("d"), F.round("t", 6).alias("t"), "p", X.stars(F.col("p")).alias("stars"))


@query("paired_t", f"{_PAIR} SELECT grp, n, round(t, 6) AS t FROM t")
def paired_t(spark, sf_dir):
    return _paired(spark, sf_dir).select("grp", "n", F.round("t", 6).alias("t"))


@query("p_step", f"{_PAIR} SELECT grp, {_P} AS p FROM t")
def p_step(spark, sf_dir):
    return _paired(spark, sf_dir).select("grp", X.p_step(F.col("t"), F.col("n") - 1).alias("p"))


@query("paired_p_exact")
def paired_p_exact(spark, sf_dir):
    return _paired(spark, sf_dir).select("grp", F.round(X.p_value(F.col("t"), F.col("n") - 1), 6).alias("p"))


_SENT = "sent AS (SELECT doc_id, pos, trim(s) AS s FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]')) AS s, unnest(range(1, len(string_split_regex(text, '[.!?\\n]')) + 1)) AS pos FROM documents WHERE text IS NOT NULL) WHERE length(trim(s)) >= 10)"
_KIND = "CASE k WHEN 'number' THEN regexp_matches(s, '[0-9]') WHEN 'law' THEN contains(lower(s), 'license') OR contains(lower(s), 'rights') ELSE contains(s, ',') END"


@query("sentence_claims", f"WITH {_SENT} SELECT doc_id, k AS kind, count(*) AS n FROM sent, (VALUES ('number'), ('law'), ('clause')) v(k) WHERE {_KIND} GROUP BY 1, 2")
def sentence_claims(spark, sf_dir):
    s = Q.sentences(table(spark, sf_dir, "documents"), r"[.!?\n]", 10)
    return Q.claims(s, Q.ENGLISH_CLAIMS).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


#: Evidence, marks of depth and words of the English texts here; the rules are those of planning texts.
EVIDENCE = {"number": r"[0-9]+", "name": r"[A-Z][a-z]{5,}"}
DEPTH = {"marks": {r"[0-9]+ ?%|[0-9]{4}": 1.0, r"(?i)license": 0.5, r"[A-Z]{3,}": 0.5}, "methods": ["tion", "que", "und"], "advice": ["the", "for", "que", "ing", "ent", "al"]}


@query("faithfulness", f"""WITH {_SENT}, x AS (SELECT s.doc_id, s.s, b.text AS ctx FROM sent s LEFT JOIN documents b ON b.doc_id = s.doc_id + 1 WHERE contains(s, ',') OR regexp_matches(s, '[0-9]')),
 c AS (SELECT doc_id, coalesce(len(list_filter(list_concat(regexp_extract_all(s, '[0-9]+'), regexp_extract_all(s, '[A-Z][a-z]{{5,}}')), lambda e: contains(ctx, e))) > 0, false) AS ok FROM x)
 SELECT d.doc_id, count(c.doc_id) AS n_claims, round(coalesce(sum(c.ok::INTEGER)::DOUBLE / count(c.doc_id), 1.0), 6) AS faithfulness FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def faithfulness(spark, sf_dir):
    """Claims of each document that the next document supports."""
    d = table(spark, sf_dir, "documents")
    s = Q.sentences(d, r"[.!?\n]", 10).filter(F.col("sentence").contains(",") | F.col("sentence").rlike("[0-9]"))
    context = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context"))
    s = s.join(context, "doc_id", "left").withColumn("supported", Q.support(F.col("sentence"), F.col("context"), EVIDENCE).isNotNull())
    return Q.support_rate(d.select("doc_id"), s, "doc_id")


@query("depth_score", """SELECT doc_id, round(least(5.0::DOUBLE, 1.0::DOUBLE + CASE WHEN regexp_matches(text, '[0-9]+ ?%|[0-9]{4}') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)license') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Z]{3,}') THEN 0.5::DOUBLE ELSE 0 END
 + least(1.0::DOUBLE, 0.5::DOUBLE * (contains(text, 'tion')::INTEGER + contains(text, 'que')::INTEGER + contains(text, 'und')::INTEGER)) + least(1.0::DOUBLE, 0.2::DOUBLE * (contains(text, 'the')::INTEGER + contains(text, 'for')::INTEGER + contains(text, 'que')::INTEGER + contains(text, 'ing')::INTEGER + contains(text, 'ent')::INTEGER + contains(text, 'al')::INTEGER))), 6) AS depth FROM documents""")
def depth_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(Q.depth(F.col("text"), DEPTH), 6).alias("depth"))


@query("token_overlap", """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents), b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM benchmark WHERE item_id % 20 = 0)
 SELECT doc_id, item_id, round(CASE WHEN least(len(w.t), len(b.t)) > 0 THEN len(list_intersect(w.t, b.t))::DOUBLE / least(len(w.t), len(b.t)) ELSE 0 END, 6) AS overlap FROM w, b""")
def token_overlap(spark, sf_dir):
    """All documents with every 20th item of the benchmark."""
    d = table(spark, sf_dir, "documents").select("doc_id", Q.tokens(F.lower("text")).alias("a"))
    b = table(spark, sf_dir, "benchmark").filter("item_id % 20 = 0").select("item_id", Q.tokens(F.lower("text")).alias("b"))
    return d.crossJoin(b).select("doc_id", "item_id", F.round(Q.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))  # a stated query set


@query("zipped_pairs", "SELECT a.l_orderkey AS order_id, count(*) AS n, round(avg(a.l_quantity - b.l_quantity), 6) AS mean_diff FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey + 1 AND a.l_linenumber = b.l_linenumber GROUP BY 1")
def zipped_pairs(spark, sf_dir):
    """Values of one order with those of the next by position, as far as both go."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("x"))
    nxt = li.select((F.col("order_id") - 1).alias("order_id"), "pos", F.col("x").alias("y"))
    return li.join(nxt, ["order_id", "pos"]).groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean_diff"))


_CITED = {"law": [r"[A-Z][a-z]+ License", r"All rights reserved"], "standard": [r"[A-Z]{2,}[ -]?[0-9]+"], "indicator": [r"[0-9]+ ?%"]}


_MATCHES = """m AS (SELECT doc_id, text, rank, kind, regexp_extract_all(text, p) AS ms FROM documents, (VALUES (0, 'law', '[A-Z][a-z]+ License'), (1, 'law', 'All rights reserved'), (2, 'standard', '[A-Z]{2,}[ -]?[0-9]+'), (3, 'indicator', '[0-9]+ ?%')) v(rank, kind, p) WHERE text IS NOT NULL),
 f AS (SELECT doc_id, text, rank, kind, unnest(list_reduce(ms, lambda a, x: {'off': a.off + strpos(substr(text, a.off + 1), x) - 1 + length(x), 'got': list_append(a.got, {'citation': x, 'position': a.off + strpos(substr(text, a.off + 1), x) - 1})}, {'off': 0::BIGINT, 'got': []::STRUCT(citation VARCHAR, "position" BIGINT)[]}).got) AS c FROM m),
 c AS (SELECT * FROM (SELECT doc_id, text, rank, kind, c.citation AS citation, c."position" AS pos, row_number() OVER (PARTITION BY doc_id, kind, c.citation ORDER BY rank, c."position") AS n FROM f) WHERE n = 1),
 x AS (SELECT *, substr(text, greatest(0, pos - 100) + 1, pos + length(citation) + 100 - greatest(0, pos - 100)) AS context FROM c)"""


@query("citation_extract", f"""WITH {_MATCHES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, rank))::INTEGER AS "order", pos::INTEGER AS position, kind, citation, context FROM x""")
def citation_extract(spark, sf_dir):
    return C.extract(table(spark, sf_dir, "documents"), _CITED)


_WORDS = r"list_distinct(regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+'))"


@query("citation_quality", rf"""WITH {_MATCHES}, k AS (SELECT x.*, b.text AS kb, strpos(b.text, citation) AS spot, coalesce(contains(b.text, citation), false) OR (kind = 'standard' AND coalesce(contains(regexp_replace(b.text, '[ -]', '', 'g'), regexp_replace(citation, '[ -]', '', 'g')), false)) AS ok FROM x LEFT JOIN documents b ON b.doc_id = x.doc_id + 1),
 w AS (SELECT *, {_WORDS.format('context')} AS a, {_WORDS.format("substr(kb, greatest(0, spot - 51) + 1, spot + 99 - greatest(0, spot - 51))")} AS b FROM k),
 s AS (SELECT *, CASE WHEN NOT ok THEN 0.0 WHEN spot = 0 THEN 50.0 ELSE coalesce(len(list_intersect(a, b))::DOUBLE / nullif(least(len(a), len(b)), 0) * 100, 50.0) END AS score, CASE WHEN regexp_matches(context, 'the [a-z]') THEN 'supportive' WHEN regexp_matches(context, 'and|que') THEN 'decorative' ELSE 'supportive' END AS kind_of FROM w),
 g AS (SELECT doc_id, count(*) AS total, count(*) FILTER (ok) AS existing, count(*) FILTER (score >= 70) AS accurate, count(*) FILTER (kind_of = 'supportive') AS supportive FROM s GROUP BY 1)
 SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(existing, 0) AS existing, coalesce(accurate, 0) AS accurate, coalesce(supportive, 0) AS supportive, round(coalesce(existing::DOUBLE / total, 0), 6) AS existence_rate, round(coalesce(accurate::DOUBLE / total, 0), 6) AS accuracy_rate FROM documents d LEFT JOIN g USING (doc_id)""")
def citation_quality(spark, sf_dir):
    """Citations of every document, with the next one as what is known."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("kb"))
    c = C.extract(d, _CITED).join(known, "doc_id", "left")
    c = c.withColumn("exists_in_kb", F.coalesce(C.exists_in(F.col("kind"), F.col("citation"), F.col("kb")), F.lit(False)))
    c = c.withColumns({"accuracy": C.accuracy(F.col("exists_in_kb"), F.col("citation"), F.col("context"), F.col("kb")), "support_type": C.support_type(F.col("context"), "the [a-z]", "and|que")})
    return C.evaluate(d, c).select("doc_id", "total", "existing", "accurate", "supportive", "existence_rate", "accuracy_rate")


@query("claim_evidence", f"""WITH {_SENT}, x AS (SELECT s.doc_id, s.s, b.text AS ctx FROM sent s JOIN documents b ON b.doc_id = s.doc_id + 1 WHERE contains(s, ',') OR regexp_matches(s, '[0-9]')),
 e AS (SELECT *, list_filter(regexp_extract_all(s, '[0-9]+'), lambda v: contains(ctx, v))[1] AS num, list_filter(regexp_extract_all(s, '[A-Z][a-z]{{5,}}'), lambda v: contains(ctx, v))[1] AS name FROM x),
 t AS (SELECT doc_id, s, CASE WHEN num IS NOT NULL THEN regexp_extract(ctx, '.{{0,50}}' || num || '.{{0,50}}') WHEN name IS NOT NULL THEN 'name ' || name || ' is there' END AS evidence FROM e)
 SELECT doc_id, count(*) AS n, count(evidence) AS supported, md5(string_agg(evidence, '|' ORDER BY s, evidence)) AS evidence_md5 FROM t GROUP BY 1""")
def claim_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = Q.sentences(d, r"[.!?\n]", 10).filter(F.col("sentence").contains(",") | F.col("sentence").rlike("[0-9]"))
    context = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context")).where("context is not null")
    told = s.join(context, "doc_id").withColumn("evidence", Q.support_evidence(F.col("sentence"), F.col("context"), EVIDENCE, {"name": ("name ", " is there")}))
    parts = F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("sentence", "evidence"))))  # a text's claims
    listed = F.when(F.size(parts) > 0, F.md5(F.array_join(F.transform(parts, lambda p: p["evidence"]), "|").cast("binary")))
    return told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("evidence").alias("supported"), listed.alias("evidence_md5"))


@query("feedback_score", """WITH x AS (SELECT a.doc_id, a.text AS new, b.text AS old FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, round(((contains(new, 'the')::INTEGER + contains(new, 'tion')::INTEGER + contains(new, 'que')::INTEGER) / 3.0::DOUBLE), 6) AS coverage,
 round(CASE WHEN (contains(old, 'ing')::INTEGER + contains(old, 'ment')::INTEGER) > 0 THEN 1 - (contains(new, 'ing')::INTEGER + contains(new, 'ment')::INTEGER) / (contains(old, 'ing')::INTEGER + contains(old, 'ment')::INTEGER)::DOUBLE
 WHEN (contains(new, 'ing')::INTEGER + contains(new, 'ment')::INTEGER) = 0 THEN 1.0 ELSE 0.5 END, 6) AS removal FROM x""")
def feedback_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("new"))
    old = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("old"))
    j = d.join(old, "doc_id")
    return j.select("doc_id", F.round(Q.share(F.col("new"), ["the", "tion", "que"], 0.5), 6).alias("coverage"), F.round(Q.removal(F.col("old"), F.col("new"), ["ing", "ment"]), 6).alias("removal"))


@query("keyword_coverage", "SELECT doc_id, round(((contains(text, 'the')::INTEGER + contains(text, 'of')::INTEGER) / 2.0::DOUBLE) * (1 - (contains(text, 'que')::INTEGER + contains(text, 'und')::INTEGER) / 2.0::DOUBLE), 6) AS score FROM documents")
def keyword_coverage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(Q.keyword_coverage(F.col("text"), ["the", "of"], ["que", "und"]), 6).alias("score"))


@query("retrieval_stats", """SELECT label, count(*) AS n_queries, sum((vec_id % 7 = 0)::INTEGER)::BIGINT AS n_empty, round(avg((vec_id % 7 = 0)::INTEGER) * 100, 4) AS empty_rate, round(avg(CASE WHEN vec_id % 7 <> 0 THEN vec_id END), 6) AS mean_score FROM embeddings GROUP BY 1""")
def retrieval_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("empty", F.col("vec_id") % 7 == 0)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if("empty").alias("n_empty"), F.round(F.avg(F.col("empty").cast("int")) * 100, 4).alias("empty_rate"), F.round(F.avg(F.when(~F.col("empty"), F.col("vec_id"))), 6).alias("mean_score"))


@query("quality_by_label", "SELECT quality, toxic, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def quality_by_label(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n"), 4).alias("mean_chars"))


@query("change_degree")
def change_degree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("new"))
    old = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("old"))
    # comparing costs far more than moving, so pairs are dealt over many tasks however few bytes they have
    return d.repartition(SHARES, "doc_id").join(old.repartition(SHARES, "doc_id"), "doc_id").select("doc_id", F.round(Q.change_degree(F.col("old"), F.col("new")), 6).alias("change"))
