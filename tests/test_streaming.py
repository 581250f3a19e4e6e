from quirework.streaming.incremental import link_mentions, run_stage, stage_state

SCHEMA = "book_id string, ord int, source string, reading string, translation string, category string, chunk_id string, summary string"


def test_stage_runs_once(spark, tmp_path):
    source, data, log, mark = (str(tmp_path / x) for x in ("in", "data", "log", "mark"))
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "item_id string, v int").write.mode("append").parquet(source)
    items = lambda: spark.readStream.schema("item_id string, v int").parquet(source)
    run_stage(items(), "s", lambda df: df.selectExpr("item_id", "v * 10 as v"), data, log, mark).awaitTermination()
    spark.createDataFrame([("c", 3)], "item_id string, v int").write.mode("append").parquet(source)
    run_stage(items(), "s", lambda df: df.selectExpr("item_id", "v * 10 as v"), data, log, mark).awaitTermination()
    assert {(r.item_id, r.v) for r in spark.read.parquet(data).collect()} == {("a", 10), ("b", 20), ("c", 30)}
    assert {(r.item_id, r.status) for r in stage_state(spark, log).collect()} == {(x, "completed") for x in "abc"}


def test_links_go_on(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for ord_, name in ((1, "Abel"), (2, "Cain"), (3, "Abel")):
        spark.createDataFrame([("b", ord_, name, None, name, "character", str(ord_), "")], SCHEMA).write.mode("append").parquet(source)
        q = link_mentions(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.ord: (r.entity_id, r.how) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("character_000001", "new"), 2: ("character_000002", "new"), 3: ("character_000001", "source")}
