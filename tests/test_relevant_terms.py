"""Terms of documents with any doc_id."""

from quirework.plans import translation


def test_documents_with_large_ids_count(spark, tmp_path):
    spark.createDataFrame([("red almond",), ("blue",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    docs = [(5, "an almond and a fig"), (999_999_999, "blue"), (1_000_000_000, "a red fig"), (5_000_000_000, "almond, blue")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    forms = {"red", "almond", "blue"} | {w for _, t in docs for w in t.split(" ") if len(w) == 3}
    got = {(r.doc_id, r.entity_id) for r in translation.relevant_terms(spark, str(tmp_path)).collect()}
    assert got == {(d, f) for d, t in docs for f in forms if f in t}
