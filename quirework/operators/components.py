"""Connected components of an undirected graph given as a DataFrame of edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FILE_EDGES = 500_000


def shared_folder(spark) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is not set a session on one machine (tests, a laptop) gets a folder of its warehouse;
    on a cluster there is no place that is shared for certain, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quirework"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that can be reached.

    Rounds of two steps: each node takes the smallest label among its neighbours' labels and its
    own, then the label of that label (pointer jumping), until nothing changes.  Labels are
    combined before they are shuffled, so a node with very many neighbours is no hot spot.
    Null ends and loops are ignored.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = kept(clean.unionByName(clean.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    # A file a round for each FILE_EDGES edges: small graphs take few files, large ones as many as their shuffles have partitions.
    files = -(-both.count() // FILE_EDGES) or 1
    labels = kept(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).coalesce(files))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("far"))
        moved = kept(step.join(jump, "label").select("x", "old", F.least("label", "far").alias("label")).coalesce(files))
        labels = moved.select("x", "label")
        if moved.where(F.col("old") != F.col("label")).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components: not settled")
    return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
