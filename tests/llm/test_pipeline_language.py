"""Rejection by score in the pipeline's first stage."""

import random

import corpus_pipeline


def test_rejects_by_score_with_two_languages(spark):
    rng = random.Random(3)
    words = {"en": "the of and that with which from".split(), "de": "und der die nicht auch durch wird".split()}
    made = lambda lang, size: " ".join(rng.choice(words[lang]) for _ in range(200))[:size]
    rows = [(k, made(lang, 500), lang) for k, lang in enumerate(["en", "de"] * 80)]
    rows += [(900, made("en", 256) + made("de", 256), None), (901, "12 !?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == set(range(160))


def test_least_score_follows_the_languages():
    assert [round(corpus_pipeline.least_score(n), 3) for n in (0, 1, 2, 3, 4, 100)] == [0.0, 0.0, 0.533, 0.378, 0.3, 0.076]
