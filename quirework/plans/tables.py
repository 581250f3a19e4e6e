"""Reading tables, and what the queries of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch handed to Python, about.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def longs(df: DataFrame) -> DataFrame:
    """All whole numbers as bigint."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name) for f in df.schema])


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


SQL_TOKENS = r"len(regexp_extract_all({0}, '[A-Za-z0-9À-ɏ]+|[^\sA-Za-z0-9À-ɏ]'))::BIGINT"


def tokens_sql(text: str) -> str:
    return SQL_TOKENS.replace("{0}", text)
