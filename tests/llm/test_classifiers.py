from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import language_id, quality_classifier

SF = "/root/testdata/sf0.01"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(0, 3, (lengths.sum(), 3))
    got, at = language_id.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        value = lambda path: sum(scores[at + t, l] for t, l in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, B905, E731, E741
        best = max(map(value, product(range(3), repeat=int(n)))) if n else 0
        assert np.isclose(value(got[at : at + n]), best)
        at += n


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 200 < len(held) < 500
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.held_out_model(docs)
    pick = lambda lang: docs.filter((F.col("lang") == lang) & (F.length("text") > 800)).orderBy("doc_id").first().text[:600]
    mixed = spark.createDataFrame([(1, pick("en") + " " + pick("de")), (2, pick("fr"))], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.identify(mixed, model).collect()}
    assert {s.lang for s in rows[1].spans} >= {"en", "de"} and rows[2].lang_pred == "fr"
    assert rows[1].score < rows[2].score


def test_scripts_narrow_candidates(spark):
    rows = [(k, "hello good morning world " * 5, "en") for k in range(9)] + [(k, "привет доброе утро мир " * 5, "ru") for k in range(10, 19)]
    model = language_id.train(spark.createDataFrame(rows, "_key long, text string, lang string"))
    docs = spark.createDataFrame([(1, "незнакомое слово"), (2, "unknown words"), (3, "汉字"), (4, "12 !")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect() if r.doc_id != 3} == {1: "ru", 2: "en", 4: "und"}


def test_language_odd(odd, none):
    rows = {r.doc_id: r for r in language_id.predictions(odd).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "und" and rows[3].score == 0
    assert language_id.predictions(odd).count() == odd.count()
    assert language_id.predictions(none).count() == 0
    kept = language_id.with_language(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def test_language_is_filled_and_none_is_needed(spark):
    texts = {"en": "hello good morning world", "ru": "привет доброе утро мир"}
    rows = [(k, texts[lang], lang, k) for k, lang in enumerate(["en", "ru"] * 20)] + [(100, texts["ru"], None, 1), (101, "12 !", None, 1), (102, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    kept = {r.doc_id: r.lang for r in language_id.with_language(docs).collect()}
    assert kept == {r[0]: r[2] for r in rows[:40]} | {100: "ru"}
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") == 0, "ru").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang for r in language_id.with_language(wrong).collect()}[0] == "en"
    unlabelled = language_id.with_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.columns == docs.columns and sorted(r.doc_id for r in unlabelled.collect()) == [*range(40), 100]


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_classifier.query(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert auc(y, s) > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_pairs_learn_what_sums_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0)).astype(float)
    model = quality_classifier.fit(x[:2000], y[:2000], rounds=30, pair_rounds=60)
    assert model.pairs[0] == (1, 3) and ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality_classifier.train(odd, labels)
    assert quality_classifier.scored(odd, model).count() == odd.count()
    empty = quality_classifier.train(none, labels)
    assert all(0 <= r.score <= 1 for r in quality_classifier.scored(odd, empty).collect())
