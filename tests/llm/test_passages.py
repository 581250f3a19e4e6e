"""Repeated passages at any word offset against all repeated windows; sentences of lines that stay."""

import random

from quirework.llm import paragraphs, passages
from quirework.llm.passages import WINDOW


def words(rng, n, tag="w"):
    return [f"{tag}{rng.randint(0, 10**6)}" for _ in range(n)]


def brute(docs):
    """(doc, from, till, removed) of the chained windows of each kind."""
    at, out = {}, set()
    for d, t in sorted(docs):
        w = t.lower().split()
        for i in range(len(w) - WINDOW + 1):
            at.setdefault(tuple(w[i : i + WINDOW]), []).append((d, i))
    chosen = {}
    for places in at.values():
        if len(places) > 1:
            for k, (d, i) in enumerate(sorted(places)):
                chosen.setdefault((d, k > 0), []).append(i)
    for (d, removed), starts in chosen.items():
        starts, begin = sorted(starts), None
        for i, j in zip(starts, starts[1:] + [None]):
            begin = i if begin is None else begin
            if j is None or j - i > WINDOW:
                out.add((d, begin, i + WINDOW, removed))
                begin = None
    return out


def test_passages_are_those_of_all_windows(spark):
    rng = random.Random(21)
    runs = [words(rng, n, "p") for n in (50, 51, 60, 75, 82, 130, 49)]
    docs = []
    for i in range(40):
        w = []
        for r in rng.sample(runs, 2):
            w += words(rng, rng.randint(0, 90)) + r[rng.randint(0, 3) :]
        w = [x.upper() if rng.random() < 0.1 else x for x in w + words(rng, rng.randint(0, 9))]
        docs.append((i, "".join(x + rng.choice([" "] * 9 + ["\n"]) for x in w)))
    docs += [(90, "a " * 70), (91, " ".join(f"c{i % 3}" for i in range(53))), (92, ""), (93, None)]
    df = paragraphs.identified(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    none = spark.createDataFrame([], "row long, at int, till int, exact boolean")
    got = [(r.doc_id, r.word, r.till, r.removed) for r in passages.passages(df, none).collect()]
    want = brute([(d, t) for d, t in docs if t])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    heads = {r.doc_id: (r.word, r.line) for r in passages.passages(df, none).collect()}
    for d, (word, line) in heads.items():
        before = sum(len(x.split()) for x in dict(docs)[d].split("\n")[: line + 1])
        assert before > word >= before - len(dict(docs)[d].split("\n")[line].split())


def test_passage_inside_long_sentences_is_cut(spark):
    rng = random.Random(22)
    run = " ".join(words(rng, 82, "p"))
    docs = [(i, f"{' '.join(words(rng, 100))} {run} {' '.join(words(rng, 120 + i))}\nend {i}") for i in (3, 4, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.level, r.unit, r.paragraph, r.n_words, r.cluster_doc_id, r.cluster_size, r.removed) for r in paragraphs.duplicate_units(df).collect())
    assert got == [(i, "passage", 100, 0, 82, 3, 3, i > 3) for i in (3, 4, 5)]
    left = {r.doc_id: r.text for r in paragraphs.deduplicated(df).collect()}
    assert left[3] == docs[0][1] and left[4] == docs[1][1].replace(run + " ", "") and left[5] == docs[2][1].replace(run + " ", "")


def test_the_line_that_stays_gives_up_its_repeats(spark):
    """Passage S in a line of document 1 and inside a line that documents 5 and 9 share: once in what is left."""
    rng = random.Random(23)
    s = " ".join(f"{' '.join(words(rng, 12, 's')).capitalize()}." for _ in range(3))
    line = f"{' '.join(words(rng, 40))}. {s} {' '.join(words(rng, 40))}."
    docs = [(1, f"{' '.join(words(rng, 30))}. {s} {' '.join(words(rng, 30))}."), (5, line), (9, line)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.level, r.removed) for r in paragraphs.duplicate_units(df).collect()}
    assert got == {(1, "sentence", False), (5, "paragraph", False), (5, "sentence", True), (9, "paragraph", True)}
    left = {r.doc_id: r.text for r in paragraphs.deduplicated(df).collect()}
    assert s in left[1] and s not in left[5] and left[9] == "" and left[5] == line.replace(s + " ", "")


def test_what_only_a_similar_line_repeats_stays(spark):
    """A sentence that is only in a line removed for a similar one and in another document is not cut there."""
    rng = random.Random(24)
    base = words(rng, 400)
    own = words(rng, 25, "o")
    edited = base[:200] + own + base[225:]
    docs = [(1, " ".join(base)), (2, " ".join(edited)), (3, f"{' '.join(words(rng, 60))}. {' '.join(own)}. {' '.join(words(rng, 60))}."), (4, f"{' '.join(words(rng, 20))} {' '.join(edited[180:240])}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id: r.text for r in paragraphs.deduplicated(df).collect()}
    assert left[2] == "" and left[3] == docs[2][1] and left[4] == docs[3][1]


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(x.size()))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


def test_windows_are_shuffled_as_few_bytes(spark):
    """A repeated window costs no more than 30 bytes of shuffles: twice by its hash, once by its text."""
    rng = random.Random(25)
    runs = [words(rng, 400, "p") for _ in range(200)]
    docs = [(i, " ".join(words(rng, 20 + i % 7) + runs[i % 200] + words(rng, 10))) for i in range(600)]
    df = paragraphs.identified(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).localCheckpoint()
    none = spark.createDataFrame([], "row long, at int, till int, exact boolean")
    n = 600 * (400 - WINDOW + 1)
    assert passages.passages(df, none).count() == 600
    assert shuffled(spark, lambda: passages.passages(df, none).write.format("noop").mode("overwrite").save()) < 30 * n


def test_first_place_with_rows_that_repeat_or_lack_an_id(spark):
    """Texts without doc_id come before all others, equal rows are one place (and repeat from their first word); doc_ids beyond 32 bits keep their order."""
    rng = random.Random(26)
    run, other = words(rng, 60, "p"), words(rng, 70, "q")
    docs = [(d, " ".join(words(rng, 10) + r)) for d, r in ((None, run), (-(1 << 40), run), (1 << 62, other), (7, other), ((1 << 62) + 1, other), (3, run))]
    df = paragraphs.identified(spark.createDataFrame([*docs, docs[3]], "doc_id long, text string").repartition(3))
    none = spark.createDataFrame([], "row long, at int, till int, exact boolean")
    rows = {r.row: r.doc_id for r in df.collect()}
    got = passages.passages(df, none).collect()
    assert sorted((str(r.doc_id), r.word, r.till, r.removed, rows[r.keep.row], r.keep.doc_id, r.keep.word, r.size) for r in got) == sorted(
        [(str(d), 10, 70, d is not None, None, -(1 << 63), 10, 3) for d in (None, -(1 << 40), 3)] + [(str(d), w, 80, d != 7, 7, 7, w, 4) for d, w in ((7, 0), (1 << 62, 10), ((1 << 62) + 1, 10))]
    )
