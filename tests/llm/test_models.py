"""Language identification and toxicity: rules, edge cases and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import language, queries, toxicity
from quirework.llm.grams import normal


def test_filters_count_languages():
    grams = [np.arange(0, 3000, dtype=np.uint64), np.arange(2000, 5000, dtype=np.uint64)]
    f = language.Filters(["a", "b"], grams)
    assert (f.masks(np.arange(0, 2000, dtype=np.uint64)) & 1 == 1).all() and (f.masks(np.arange(2000, 3000, dtype=np.uint64)) == 3).all()
    strange = f.masks(np.arange(10**6, 10**6 + 200_000, dtype=np.uint64))
    for bit in (0, 1):
        assert (strange >> bit & 1).mean() == pytest.approx(f.chance[bit], abs=2e-3)
    many = language.Filters([str(i) for i in range(40)], [np.array([i], np.uint64) for i in range(40)])
    assert int(many.masks(np.array([39], np.uint64))[0]) >> 39 & 1


def test_language_edges(spark, odd, clashing, nothing):
    filters = language.train(odd.select("doc_id", "text", "lang"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(clashing, filters, "doc_id").collect()]
    assert len(got) == 14
    whole = language.identify(clashing, filters, F.struct("*").alias("doc")).select("doc.*")
    assert whole.columns == clashing.columns and whole.count() == 14
    by = {d: (p, s) for d, p, s in got}
    assert by[5] == by[3] == by[8] == by[11] == ("und", 0.0) and by[1][0] == "en" and by[10][0] in ("en", "fr") and all(0 <= s <= 1 for _, s in by.values())
    none = language.train(nothing.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language.identify(odd, none, "doc_id").collect()} == {"und"}
    assert language.identify(nothing, filters, "doc_id").count() == 0
    assert normal(None) == normal("") == normal("1 2") and normal("A\tb--c") == b" a b c  "


def test_rare_languages_are_learned(spark, monkeypatch):
    """A language of five rows among many of others, and languages from the 65th on."""
    monkeypatch.setattr(language, "SAMPLE_ROWS", 20)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, i: f"{letters[k % 26]}{letters[k // 26]}qx{letters[i % 26]}{letters[k % 26]}"
    text = lambda k, i: " ".join(word(k, i + j) for j in range(20))
    rows = [(i, text(0, i), "l0") for i in range(3000)] + [(5000 + 10 * k + i, text(k, i), f"l{k}") for k in range(1, 70) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.train(docs)
    assert len(filters.languages) == 70
    got = language.identify(docs, filters, "lang").toPandas()
    assert (got.lang == got.lang_pred).all() and got.coverage.min() > 0.9


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98


def test_toxicity_edges(spark, odd, clashing, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (100, 1), (6, None), (None, 1), (77, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(clashing, model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[5] == same[3] == same[8] == same[11] and same[4] == same[100] and same[2] == same[6]
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.train(odd, labels.limit(0)).scores(["x"])[0] < 0.01
    assert toxicity.train(odd, labels.where("toxic = 1")).scores(["x"])[0] > 0.99


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank, pos = got.score.rank(), got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97 and (got.predicted == got.toxic).mean() > 0.97
