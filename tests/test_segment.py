import random

from pyspark.sql import functions as F

from quirework.functions.text import TOKEN, n_tokens
from quirework.operators import packing, segment
from quirework.operators.segment import Chunking


def naive(tokens, breaks, c):
    """Piles of blocks, kept as lists."""
    ends, pile, low = [], [], c.target * (1 - c.flex)
    for i, t in enumerate(tokens):
        if pile and sum(tokens[k] for k in pile) + t > c.target:
            total, cut = 0, None
            for n, k in enumerate(pile):
                total += tokens[k]
                if total > c.target:
                    break
                if breaks[k] and total >= low:
                    cut = n
            n = len(pile) - 1 if cut is None else cut
            ends.append(pile[n])
            pile = pile[n + 1 :] + [i]
        else:
            pile.append(i)
    if pile:
        if ends and sum(tokens[k] for k in pile) < c.least:
            ends.pop()
        ends.append(pile[-1])
    return ends


def test_greedy_against_piles(spark):
    random.seed(5)
    rows = []
    for i in range(400):
        n = random.randint(1, 40)
        rows.append((i, [(random.randint(0, 60), random.random() < 0.3) for _ in range(n)]))
    df = spark.createDataFrame(rows, "id int, b array<struct<tokens:int,brk:boolean>>")
    for c in (Chunking(target=100, least=20, flex=0.2), Chunking(target=60, least=45, flex=0.6)):
        for r in df.select("id", "b", segment.chunk_ends(F.col("b"), c)["ends"].alias("e")).collect():
            assert r.e == naive([x.tokens for x in r.b], [x.brk for x in r.b], c), r.id


def test_break_at(spark):
    b = spark.createDataFrame([([(10, True), (10, False), (10, True), (50, True)],), ([(5, False)],)], "b array<struct<tokens:int,brk:boolean>>")
    assert [r[0] for r in b.select(segment.break_at(F.col("b"), 5, 40)).collect()] == [2, None]


def test_blocks(spark):
    md = "# Title\ntext one  \nmore\n\n   \n#tag\n---\n***\n\n＊＊＊\n\n* * *\na\n- - -\nlast"
    df = spark.createDataFrame([(1, md), (2, ""), (3, None), (4, " \n　\n"), (5, "one")], "d int, t string")
    got = [(r.d, r.block_index, r.kind, r.text) for r in segment.parse_blocks(df, "d", "t").orderBy("d", "block_index").collect()]
    assert got == [
        (1, 0, "heading", "# Title"), (1, 1, "paragraph", "text one\nmore"), (1, 2, "heading", "#tag"), (1, 3, "hr", "* * *"), (1, 4, "hr", "* * *"), (1, 5, "scene_break", "* * *"), (1, 6, "hr", "* * *"),
        (1, 7, "paragraph", "a"), (1, 8, "hr", "* * *"), (1, 9, "paragraph", "last"), (5, 0, "paragraph", "one"),
    ]


def test_tail_joins_the_chunk_before(spark):
    df = spark.createDataFrame([(1, "\n\n".join(["w " * 10] * 5 + ["x"]))], "d int, t string")
    got = segment.chunk_documents(df, "d", "t", Chunking(target=20, least=5)).orderBy("chunk_index").collect()
    assert [(r.block_start, r.block_end, r.token_count, r.extended_for_remainder) for r in got] == [(0, 1, 20, False), (2, 3, 20, False), (4, 5, 11, False)]
    short = segment.chunk_documents(df, "d", "t", Chunking(target=20, least=12)).collect()
    assert [(r.block_start, r.block_end, r.token_count, r.extended_for_remainder) for r in short][-1] == (2, 5, 31, True)


def sizes(spark, tokens, **how):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "d int, o int, t int")
    return [r.token_count for r in packing.batches(df, "d", "o", "t", **how).orderBy("batch_no").collect()]


def test_packing(spark):
    how = {"target": 1000, "least": 100, "redistribute": 0.4}
    assert sizes(spark, [450] * 2 + [200], **how) == [450, 650]
    assert sizes(spark, [450, 450, 90], **how) == [990]
    assert sizes(spark, [600, 350, 99], **how) == [1049]
    assert sizes(spark, [2500, 10], **{**how, "least": 5}) == [2500, 10]
    assert sizes(spark, [500, 500, 450, 500], **how) == [1000, 950]
    assert sizes(spark, [10], **how) == [10]


def test_coverage_finds_faults(spark):
    blocks = spark.createDataFrame([(1, i, 5) for i in range(4)], "d int, block_index int, token_count int")
    good = spark.createDataFrame([(1, 1, 0, 1, 10), (1, 2, 2, 3, 10)], "d int, chunk_index int, block_start int, block_end int, token_count int")
    bad = spark.createDataFrame([(1, 1, 0, 2, 10), (1, 3, 2, 2, 90)], "d int, chunk_index int, block_start int, block_end int, token_count int")
    assert segment.coverage(blocks, good, "d").first().valid
    r = segment.coverage(blocks, bad, "d").first()
    assert (r.uncovered, r.repeated, r.misnumbered, r.valid) == (1, 1, 1, False)


def test_coverage_works_texts_out_once_for_blocks_and_once_for_chunks(spark):
    df = spark.createDataFrame([(1, "# a\n\nb c\n\nd"), (2, ""), (3, None)], "d int, t string")
    chunks = segment.chunk_documents(df, "d", "t", Chunking(target=3, least=1))
    out = segment.coverage(segment.parse_blocks(df, "d", "t"), chunks, "d")
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 0, 0, 5, 5, True)]
    assert plan(chunks).count("split(") == 1 and plan(out).count("split(") == 2


def test_coverage_counts_rows_that_are_there_twice(spark):
    blocks = spark.createDataFrame([(1, 0, 4), (1, 0, 4), (1, 1, None), (2, 0, 1)], "d int, block_index int, token_count int")
    chunks = spark.createDataFrame([(1, 1, 0, 0, 4), (1, 1, 0, 0, 4), (1, 2, 1, 2, 9)], "d int, chunk_index int, block_start int, block_end int, token_count int")
    got = {r.d: tuple(r)[1:] for r in segment.coverage(blocks, chunks, "d").collect()}
    assert got == {1: (0, 2, 2, 1, 8, 17, False), 2: (1, 0, 0, None, 1, None, False)}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_counted_without_a_list(spark):
    random.seed(4)
    texts = ["".join(random.choice("aZ9éɏ _-\n\t\x0b\f\r 　字😀×÷") for _ in range(random.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert df.where(n_tokens(F.col("t")) != F.coalesce(F.regexp_count("t", F.lit(TOKEN)), F.lit(0))).count() == 0
    assert "regexp_count" not in plan(df.select(n_tokens(F.col("t")))) and "regexp_extract_all" not in plan(df.select(n_tokens(F.col("t"))))


def test_scene_breaks_of_any_form(spark):
    df = spark.createDataFrame([(1, "~~~"), (2, "a\n***\nb"), (3, "x ~~~"), (4, "◇◇◇"), (5, " * * *"), (6, "end")], "d int, t string")
    kinds = lambda *patterns: [r.kind for r in segment.parse_blocks(df, "d", "t", Chunking(scene_breaks=patterns)).orderBy("d", "block_index").collect()]
    assert kinds(r"^~{3}$") == ["scene_break", "paragraph", "hr", *["paragraph"] * 3, "hr", "paragraph"]
    assert kinds(r"~{3}$", "^q|end") == ["scene_break", "paragraph", "hr", "paragraph", "scene_break", "paragraph", "hr", "scene_break"]
    assert kinds() == ["paragraph", "paragraph", "hr", *["paragraph"] * 3, "hr", "paragraph"]
