"""The queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language, media, mixing, ngram_join, paragraphs, pii, simhash, token_files, toxicity
from .frames import documents, held_out


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    filters = language.train(docs.select("doc_id", "text", "lang").where(learn))
    return language.identify(docs, filters, F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicate_units(documents(spark, sf_dir))


#: The key of the queries and of the pipeline over test documents.  It is public: real documents need a key of their own.
EXAMPLE_KEY = "example, not secret"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_documents(documents(spark, sf_dir), EXAMPLE_KEY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False))
    return toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(learn)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_table(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_paragraphs": op2_paragraphs,
        "op3_pii": op3_pii,
        "op4_mixing": op4_mixing,
        "op5_ngram_join": op5_ngram_join,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_media": op7_media,
        "op8_token_files": op8_token_files,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
    }


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS h FROM w),
n AS (SELECT w.doc_id, count(h) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a AS node, b AS far FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.far),
c AS (SELECT node, min(far) AS least FROM r GROUP BY node), d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(c.least, n.doc_id), n.doc_id) AS component_id, coalesce(d.links, 0) AS n_links FROM n LEFT JOIN c ON c.node = n.doc_id LEFT JOIN d ON d.a = n.doc_id
"""


def number_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def step_sql(n: int) -> str:
    """One of the steps that narrow the exponent: the last of 65 points at which the entropy still meets the target."""
    low = " + ".join(["0.0", *[f"(SELECT k FROM g{i}) / pow(64, {i})" for i in range(1, n)]])
    return f"""g{n} AS (SELECT greatest(0, coalesce(min(i) FILTER (h < (SELECT 0.98 * ln(count(*)) FROM sh WHERE share > 0)), 65) - 1) AS k FROM (SELECT i, ln(sum(exp(t * ln(share)))) - sum(exp(t * ln(share)) * t * ln(share)) / sum(exp(t * ln(share))) AS h
  FROM (SELECT i, ({low}) + i / pow(64, {n}) AS t, share FROM sh, (SELECT unnest(range(65)) AS i) WHERE share > 0) GROUP BY i))"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
r AS (SELECT *, {number_sql("'mix:' || doc_id || ':' || tokens")} AS row FROM d),
sh AS (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS tokens, sum(tokens) / (SELECT sum(tokens) FROM d) AS share FROM d GROUP BY source),
{step_sql(1)}, {step_sql(2)}, {step_sql(3)}, {step_sql(4)},
e AS (SELECT CASE WHEN (SELECT k FROM g1) = 64 THEN 1.0 ELSE (SELECT k FROM g1) / 64.0 + (SELECT k FROM g2) / pow(64, 2) + (SELECT k FROM g3) / pow(64, 3) + (SELECT k FROM g4) / pow(64, 4) END AS t),
w AS (SELECT source, tokens, docs, exp(t * ln(share)) / (SELECT sum(exp((SELECT t FROM e) * ln(share))) FROM sh) AS weight FROM sh, e),
b AS (SELECT source, weight, ceil(docs / 512.0)::BIGINT AS blocks, tokens AS all_tokens, weight * (SELECT sum(tokens) FROM d) AS goal, floor(weight * (SELECT sum(tokens) FROM d) / tokens + 1e-9)::BIGINT AS whole FROM w),
x AS (SELECT r.*, weight, whole, greatest(0.0, goal * (1 - 1e-9) - whole * all_tokens) AS rest, row % blocks AS block FROM r JOIN b USING (source)),
s AS (SELECT source, block, sum(tokens) AS bt, any_value(rest) AS rest FROM x GROUP BY source, block),
c AS (SELECT source, block, bt, sum(bt) OVER (PARTITION BY source ORDER BY {number_sql("'mix:last:' || block")}, block) - bt AS before FROM s),
y AS (SELECT x.*, c.before, c.before < x.rest AS begun, c.before + bt <= x.rest AS full_, sum(x.tokens) OVER (PARTITION BY x.source, x.block ORDER BY {number_sql("'mix:last:' || row")}) - x.tokens AS upto FROM x JOIN c ON c.source = x.source AND c.block = x.block),
z AS (SELECT *, whole + CASE WHEN begun AND full_ THEN 1 WHEN begun AND before + upto < rest THEN 1 ELSE 0 END AS copies FROM y)
SELECT doc_id, source, tokens AS n_tokens, round(weight, 9) AS weight, block, epoch::INTEGER AS epoch, {number_sql("'mix:' || epoch || ':' || row")} AS mix_order FROM (SELECT *, unnest(range(copies)) AS epoch FROM z)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_ngram_join": OP5_SQL}
