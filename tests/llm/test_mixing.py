"""Temperature mixing against the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from quirework.llm import mixing
from quirework.llm.frames import stored


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), "big" if i % 3 else ("mid" if i % 2 else f"small{i % 5}")) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shares_of(corpus):
    return stored(mixing.source_tokens(corpus.select("source", mixing.n_words("text").alias("tokens"))), "shares")


def test_exponent_meets_its_target(corpus):
    shares = shares_of(corpus)
    p = [r.share for r in shares.collect()]
    entropy = lambda t: -sum(w * math.log(w) for w in (x**t / sum(y**t for y in p) for x in p))
    top = math.log(len(p))
    t = mixing.exponent(shares, 0.9, None, 1.0)
    assert 0 < t < 1 and entropy(t) >= 0.9 * top and entropy(t + 1e-5) < 0.9 * top
    assert mixing.exponent(shares, None, None, 1.0) == 1.0
    t = mixing.exponent(shares, 1.0, 2.0, 1.0)
    most = lambda t: max(x ** (t - 1) for x in p) / sum(y**t for y in p)
    assert most(t) <= 2.0 < most(t - 1e-5)


def test_mix_keeps_budgets(corpus):
    got = mixing.mix_table(corpus, entropy=0.9, repeats=4.0, budget=1.0, key="k").toPandas()
    total = corpus.agg(F.sum(mixing.n_words("text"))).first()[0]
    for source, part in got.groupby("source"):
        goal = part.weight.iloc[0] * total
        assert goal <= part.n_tokens.sum() + 1e-6 and part.n_tokens.sum() < goal + 45, source
    times = got.groupby(["source", "doc_id"]).size().groupby("source").agg(["min", "max"])
    assert (times["max"] - times["min"] <= 1).all() and got.groupby("doc_id").epoch.max().max() < 5
    assert abs(got.groupby("source").weight.first().sum() - 1) < 1e-9
    again = mixing.mix_table(corpus.repartition(7), entropy=0.9, repeats=4.0, budget=1.0, key="k").toPandas()
    key = ["doc_id", "epoch"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def test_cut_takes_whole_blocks(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    got = mixing.mix_table(corpus, entropy=None, repeats=None, budget=0.5).toPandas()
    have = corpus.select("doc_id", "source").toPandas().merge(mixing.plan_mix(corpus.select("doc_id", "source", mixing.n_words("text").alias("tokens")), None, None, 0.5, "mix").toPandas()[["doc_id", "block", "copies"]], on="doc_id")
    part = have.groupby(["source", "block"]).copies.agg(["min", "max"])
    assert ((part["min"] != part["max"]).groupby("source").sum() <= 1).all() and len(got) < 3000


def test_odd_rows(odd, clashing, nothing):
    named = clashing.withColumns({n: F.lit(n) for n in ("copies", "doc", "tokens", "_tokens", "_source")})
    out = mixing.mix(named, entropy=None, repeats=None)
    assert {(r["copies"], r["doc"], r["tokens"], r["_tokens"], r["_source"], r["_row"]) for r in out.collect()} == {("copies", "doc", "tokens", "_tokens", "_source", "x")}
    assert dict(out.dtypes)["epoch"] == "int" and len(out.columns) == len(set(out.columns))
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert got == sorted((str(r.doc_id), r.text or "") for r in odd.collect()) and {"epoch", "mix_order", "block"} <= set(out.columns)
    assert mixing.mix(nothing).count() == 0 and mixing.mix_table(nothing).count() == 0
    assert mixing.mix_table(odd, budget=2.0, repeats=None, entropy=None).groupBy("epoch").count().where("epoch = 1").first()["count"] == 14
