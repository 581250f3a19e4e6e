from pyspark.sql import functions as F

from quirework.config import Translation
from quirework.operators import context, resolve
from quirework.plans.translate import translate, usage, window

CHUNKS = "book_id string, spine_index int, chunk_index int, chunk_id string, text string, classification string, status string, summary string, translated_text string"


def echoing():
    """A factory that executors can read without this module."""

    def echo():
        def call(messages):
            text = messages[-1]["content"]
            if "Mend" in messages[0]["content"]:
                return "mended " + text.split("\n")[1] if "- " in text else "no issues shown"
            if "Polish" in messages[0]["content"]:
                return "polished " + text.rpartition("Draft:\n")[2]
            if "hard" in text:
                return "no end mark"
            shown = [m["content"] for m in messages[1:-1] if m["role"] == "user"]
            return f"{len(messages)} {' / '.join(shown)}</analysis>" + text.upper()

        return call

    return echo


def test_chunks_in_order_with_context(spark):
    rows = [("b", 0, 1, "0000.001", "a cat sat", "chapter", "completed", "sum one", "KATZE SASS"), ("b", 0, 2, "0000.002", "hard dog ran", "chapter", "pending", None, None), ("b", 1, 1, "0001.001", "the cat", "toc_auto", "pending", None, None)]
    forms = spark.createDataFrame([("b", 2, "cat", "cat = KAT"), ("b", 1, "bird", "bird = B"), ("other", 1, "cat", "not this")], "book_id string, ord int, source string, line string")
    got = translate(spark.createDataFrame(rows, CHUNKS), forms, echoing(), None, lambda: lambda m: "short", Translation(qa_retries=2)).orderBy("chunk_id", "attempt").collect()
    assert [(r.chunk_id, r.attempt, r.verdict, r.selected, r.summary, r.overlap_chunk_id) for r in got] == [("0000.002", 1, "fail", False, None, "0000.001"), ("0000.002", 2, "pass", True, "short", "0000.001"), ("0001.001", 1, "pass", True, None, "0000.002")]
    assert got[1].translated_text == "mended hard dog ran" and (got[0].passes, got[1].passes) == (1, 2)
    assert got[2].translated_text == "THE CAT"
    told = ["8 Glossary:", "cat = KAT", " / Story so far:", "sum one", "---", "short", " / Text before not to be translated again:", "hard dog ran", "", "Translated as:", "mended hard dog ran"]
    assert got[2].analysis.replace("\n", "|") == "|".join(told).replace("| / ", " / ")
    assert all(r.prompt_tokens > 0 and r.completion_tokens > 0 for r in got)


def test_second_pass_and_usage(spark):
    rows = [("b", 0, 1, "0000.001", "a cat", "chapter", "completed", "s", "EIN KATER"), ("b", 0, 2, "0000.002", "a dog", "toc_auto", None, None, None)]
    forms = spark.createDataFrame([], "book_id string, ord int, source string, line string")
    out = translate(spark.createDataFrame(rows, CHUNKS), forms, echoing(), polisher=echoing())
    r = out.first()
    assert (r.translated_text, r.passes, r.verdict) == ("polished A DOG", 2, "pass") and "a cat\n\nTranslated as:\nEIN KATER" in r.analysis
    u = usage(out).first()
    assert (u.n_attempts, u.n_chunks) == (1, 1) and u.tokens_a_chunk == r.prompt_tokens + r.completion_tokens


def test_judge_and_last_attempt(spark):
    rows = [("b", 0, 1, "0000.001", "a b", "chapter", None, None, None)]
    forms = spark.createDataFrame([], "book_id string, ord int, source string, line string")
    judge = lambda: lambda m: '{"issues": [{"issue": "tone", "severity": "high"}]}'
    got = translate(spark.createDataFrame(rows, CHUNKS), forms, echoing(), judge, None, Translation(qa_retries=1)).orderBy("attempt").collect()
    assert [(r.attempt, r.verdict, r.selected) for r in got] == [(1, "fail", False), (2, "fail", True)]
    assert window([("1", "a b c"), ("2", "d e"), ("3", "f g h i")], 5) == "f g h i" and window([("1", "a"), ("2", "b")], 5) == "a\n---\nb"


def test_texts_about_entities(spark):
    r = spark.createDataFrame([("c1", 2, "place", "Rome", ["R"], "", "old", ""), ("c1", 1, "character", "Abel", ["A", "B"], "kind", "x", "curt")], "c string, ord int, category string, name string, forms array<string>, summary string, notes string, speech_style string")
    assert context.glossary_block(r, "c").first().glossary == "## character\n- Abel: kind\n  forms: A, B\n  speech: curt\n\n## place\n- Rome: old\n  forms: R"
    named = r.withColumn("nicknames", F.array(F.lit("Bea: Abe")))
    block = context.glossary_block(named, "c")
    assert "  speech: curt\n  called: Bea: Abe\n\n## place\n- Rome: old\n  forms: R" in block.first().glossary
    assert context.too_long(block, "c", 5).count() == 1 and context.too_long(block, "c").count() == 0
    out = r.select(resolve.embedding_text(F.col("category"), F.col("name"), F.col("forms"), F.array(F.lit("")), F.col("summary"), F.array())).collect()
    assert {x[0] for x in out} == {"place. Rome. R", "character. Abel. A, B. kind"}
    conflicts = spark.createDataFrame([(1, "x", ["y"]), (2, "z", ["x", "w"])], "entity_id int, current_translation string, alternatives array<string>")
    remap = spark.createDataFrame([(2, 1)], "node int, component int")
    assert tuple(resolve.remapped_conflicts(conflicts, remap).first()) == (1, "x", ["y", "z", "w"])
    d = spark.createDataFrame([(2, 3, True, 3), (1, 2, True, 1), (4, 5, False, 4)], "a int, b int, same_entity boolean, preferred int")
    assert [tuple(x) for x in resolve.decided(d, remap).collect()] == [(1, 3, 3)]
    assert resolve.report(spark.createDataFrame([(1, "HIGH", 3, 2)], "round int, tier string, n_pairs int, n_merged int")).first().markdown.endswith("| 1 | HIGH | 3 | 2 |")
