"""The pipeline's stages by what each must keep, and its end against the tokenizer's library."""

import ast
import hashlib
import os
import re
import subprocess
import sys

import public_tokenizers
import pyspark
import pytest
import tiktoken
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quirework.llm import byte_bpe, ngram_join
from quirework.llm.frames import documents, stored

D = "/root/testdata/sf0.001"


def test_stages(spark, odd):
    docs = documents(spark, D).unionByName(odd.withColumn("doc_id", odd["doc_id"] + 10_000_000))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], D), name))
        if name != names[-1]:
            assert steps[-1].columns == docs.columns
    kept = {r.doc_id for r in steps[1].collect()}
    assert {r.doc_id for r in documents(spark, D).collect()} <= kept and not kept & {10_000_003, 10_000_005, 10_000_008, 10_000_011}
    groups = {r.doc_id: r.component_id for r in ngram_join.join_documents(steps[1], 5, 80).collect()}
    left = sorted((r.doc_id for r in steps[2].collect()), key=str)
    assert left == sorted({c for c in groups.values()}, key=str) and None in left
    assert sorted((r.doc_id for r in steps[3].collect()), key=str) == left
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id for r in steps[4].collect()} <= set(left)
    text = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode_ordinary(text[r.doc_id]))).encode()).hexdigest()


def test_one_row_of_each_group_stays(spark):
    """Rows that share a doc_id and differ, and rows without one."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(120)) for x in "abce")
    near = a.replace("a60 ", "x ")
    rows = [(1, a), (2, near), (2, b), (3, b), (3, e), (None, c), (None, c), (None, near), (7, c.replace("c60 ", "x ")), (None, "no other row has this text"), (None, "no other row has this text")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.without_near_duplicates(spark, docs, D)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in left.collect())) == sorted([(1, a), (2, b), (3, e), (7, c.replace("c60 ", "x ")), (0, "no other row has this text")])


def test_names_that_stages_use(spark, clashing):
    """Columns of the documents named like those that the operators add stay as they are."""
    docs = clashing.withColumns({n: F.lit("x") for n in ("copies", "doc", "row", "component_id", "_first", "first", "new", "cut")})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, D), name)
        assert docs.columns == columns and docs.where("copies <> 'x' or score <> 'x' or lang_pred <> 'x' or _row <> 'x' or epoch <> 'x'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() == docs.count() > 3


def test_empty(spark, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, D), name)
    assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 100


CLUSTER = """
import os, re, sys, time
import psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.adaptive.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()

def held():
    backends = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sorted(p.memory_info().rss >> 20 for p in backends)

spark.range(0, 2_000_000, 1, 2).select(F.expr("repeat(cast(id as string), 20) u")).repartition(2, F.rand(1)).sort("u").write.format("noop").mode("overwrite").save()
before = held()
dict(corpus_pipeline.STAGES)["pii"](spark, spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"), "")
time.sleep(1)
print("HELD", before, held())
os._exit(0)
"""


def test_stage_begins_with_memory_given_back(tmp_path):
    """Executors of their own processes hold less after a stage has begun than an earlier job has left them with."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    local, home = os.path.dirname(pyspark.__file__), tmp_path / "home"
    home.mkdir()
    for name in os.listdir(local):
        if name != "work":  # the executors' logs
            (home / name).symlink_to(os.path.join(local, name))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_DRIVER"))} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path / "warehouse")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "HELD" in out.stdout, out.stderr[-3000:]
    before, after = [ast.literal_eval(x) for x in re.findall(r"\[[^]]*\]", re.search("HELD (.*)", out.stdout)[1])]
    assert len(before) == len(after) == 2 and all(b - a > 100 for b, a in zip(before, after)), (before, after, out.stderr[-2000:])
