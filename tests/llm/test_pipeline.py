"""The pipeline keeps clean documents, and each stage returns what the next one reads."""

import random

import corpus_pipeline
from stratiform.llm.common import materialize


def test_stages(spark):
    r = random.Random(6)
    vocabulary = {k: ["".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(300)] for k, letters in {"en": "abcdefgh", "fr": "ijklmnop"}.items()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        lines = [" ".join(r.choice(vocabulary[lang]) for _ in range(25)) for _ in range(4)]
        rows.append((i, "\n".join([*lines, "All rights reserved."]), lang, f"s{i % 4}", 1))
    rows += [(100, rows[0][1].replace(rows[0][1].split()[3], "other", 1), "fr", "s1", 1), (101, None, "en", "s1", 1), (102, "12345 !!", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), f"test-{name}")
        seen.append((name, docs))
    ids = {name: {x["doc_id"] for x in d.select("doc_id").collect()} for name, d in seen}
    assert all(d.columns == corpus_pipeline.COLUMNS for _, d in seen[:-1])
    assert ids["language_id"] == set(range(60)) | {100}
    lines = [x["text"] for x in seen[1][1].collect()]
    assert sum("All rights reserved." in x for x in lines) == 1 and ids["line_dedup"] == set(range(60)) | {100}
    assert ids["jaccard_join"] == set(range(60))
    assert ids["mixing"] <= set(range(60)) and ids["packing"] == ids["mixing"]
    assert seen[3][1].count() == seen[4][1].filter("piece = 0").count()
