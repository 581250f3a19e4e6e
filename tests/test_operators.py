import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quirework.functions import markup
from quirework.functions import text as T
from quirework.operators import assemble, classify, context, linking, provider, quality, resolve, state
from quirework.operators.components import components


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 101), (7, 7), (None, 3)], "a int, b int")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {99: 99, 100: 99, 101: 99}
    assert components(edges.limit(0)).collect() == []


def test_similarity():
    assert resolve.similarity_of("MARTHA", "marhta") == pytest.approx(0.9611, abs=1e-3)
    assert resolve.similarity_of("", "x") == 0 and resolve.similarity_of("A ", "a") == 1
    assert resolve.jaro_winkler("アベル", "アベルちゃん") == pytest.approx(0.8833, abs=1e-3)


def test_fuzzy_pairs_lose_nothing(spark):
    words = ["abel", "able", "abelard", "lebanon", "lab", "elba", "bela", "zorro", "zoro", "orroz", "k", "kk"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, form string")
    got = {(r.a, r.b): round(r.jw, 9) for r in resolve.fuzzy_pairs(df, "id", "form", 0.75).collect()}
    want = {(i, j): round(s, 9) for i in range(len(words)) for j in range(i + 1, len(words)) if (s := resolve.similarity_of(words[i], words[j])) >= 0.75}
    assert got == want


def test_resolve_merges_until_nothing_changes(spark):
    rows = [(i, i, n, [n], [], "", i, i) for i, n in enumerate(["ann", "ann b", "ann b c", "zed"])]
    entities = spark.createDataFrame(rows, "id int, ord int, name string, forms array<string>, aliases array<string>, notes string, first_seen int, last_seen int")

    def candidates(e):
        pairs = resolve.substring_pairs(e.select("id", F.explode("forms").alias("form")), "id", "form")
        tagged = {"source_substring": pairs, "translation_containment": pairs}
        return resolve.evidence(tagged, e.select("id", F.lit("x").alias("category")))

    left, remap = resolve.resolve(entities, candidates)
    assert sorted((r.id, r.name, r.forms) for r in left.collect()) == [(2, "ann b c", ["ann b c", "ann", "ann b"]), (3, "zed", ["zed"])]
    assert {r.node: r.component for r in remap.collect()} == {0: 2, 1: 2, 2: 2}


def test_whole_records_and_forms_are_merged(spark):
    rows = [(1, 1, "A", ["a"], ["x"], "n", 5, 6, "one", "curt", ["b1"], [("Ann", "P")]), (2, 2, "B", ["b"], ["y", "x"], "n m", 3, 9, "two", "curt\nloud", ["b2", "b1"], [("Ann", "Q"), ("Bob", "R")]), (3, 3, "C", ["c"], None, None, 7, 7, None, None, None, None)]
    entities = spark.createDataFrame(rows, "id int, ord int, name string, forms array<string>, aliases array<string>, notes string, first_seen int, last_seen int, summary string, speech_style string, books array<string>, nicknames array<struct<speaker string, nick string>>")
    remap = spark.createDataFrame([(1, 1), (2, 1)], "node int, component int")
    got = {r.id: r for r in resolve.merged(entities, remap).collect()}
    a = got[1]
    assert (a.name, a.forms, a.aliases, a.notes, a.first_seen, a.last_seen, a.n_merged) == ("A", ["a", "b"], ["x", "y"], "n n m", 3, 9, 2)
    assert (a.summary, a.speech_style, a.books, [tuple(x) for x in a.nicknames]) == ("one two", "curt\nloud", ["b1", "b2"], [("Ann", "P"), ("Bob", "R")])
    assert (got[3].name, got[3].forms, got[3].aliases, got[3].summary, got[3].nicknames) == ("C", ["c"], [], "", [])
    forms = spark.createDataFrame([(1, "s", "S", ["T"], "", 2, "c5"), (2, "s", "U", ["S", "V"], "r", 3, "c1"), (2, "t", "W", None, None, 1, "c2")], "entity_id int, source string, translation string, translation_variants array<string>, reading string, occurrence_count long, first_seen_chunk string")
    merged = {r.source: tuple(r)[2:] for r in resolve.merged_forms(forms, remap).collect()}
    assert merged == {"s": ("S", ["T", "U", "V"], "r", 5, "c1"), "t": ("W", [], None, 1, "c2")}


def test_the_preferred_entity_survives(spark):
    entities = spark.createDataFrame([(1, 1, "long name", ["p"], [], "", 1, 1), (2, 2, "ln", ["q"], [], "", 2, 2)], "id int, ord int, name string, forms array<string>, aliases array<string>, notes string, first_seen int, last_seen int")
    one = lambda e: e.sparkSession.createDataFrame([(1, 2, ["jaro_winkler"], 0.8, False)], "a int, b int, heuristics array<string>, jw double, same_category boolean").join(e.select(F.col("id").alias("a")), "a").join(e.select(F.col("id").alias("b")), "b")
    left, remap = resolve.resolve(entities, one, lambda p: p.select("a", "b", F.col("b").cast("string").alias("preferred")))
    assert [(r.id, r.name, r.forms) for r in left.collect()] == [(2, "ln", ["q", "p"])] and {r.component for r in remap.collect()} == {2}


def test_mentions_see_earlier_entities(spark):
    rows = [("b", 1, "Abel", None, "Abel", "character", "1", "a"), ("b", 2, "Abel", None, "Abel!", "place", "2", "a b"), ("b", 3, "Abell", None, "x", "character", "3", ""), ("b", 4, "Bob", "r", "B", "place", "4", ""), ("b", 5, "Rob", "r", "B", "character", "5", "")]
    df = spark.createDataFrame(rows, "book_id string, ord int, source string, reading string, translation string, category string, chunk_id string, summary string")
    got = [(r.ord, r.entity_id, r.how) for r in linking.fold_mentions(df).orderBy("ord").collect()]
    assert got == [(1, "character_000001", "new"), (2, "character_000001", "source"), (3, "character_000001", "similar"), (4, "place_000001", "new"), (5, "place_000001", "reading")]
    e = linking.fold_entities(df).where("entity_id = 'character_000001'").first()
    assert (e.n_mentions, e.sources, e.summary, e.last_seen) == (3, ["Abel", "Abell"], "a a b", "3")


def test_summary_cut():
    assert linking.merged_summary("abc", "bc") == "abc"
    assert linking.merged_summary("aaaa bbbb", "cccc", 11) == "aaaa bbbb..."


def test_rules(spark):
    page = lambda html: one(spark, classify.by_rules(F.col("h")), h=html)
    assert page('<nav epub:type="toc"><h1>x</h1></nav>').classification == "toc_auto"
    assert page("<p>a b</p><img src='x'/>").classification == "illustration"
    assert tuple(page("<h2>Part <b>One</b></h2><p>few</p>")) == ("frontmatter", "Part One")
    assert page("<p>" + "word " * 40 + "</p>") is None
    assert page("") is None


def test_rules_then_provider(spark):
    df = spark.createDataFrame([(1, "<h1>a</h1>", None), (2, "<p>" + "w " * 50 + "</p>", None), (3, "<h1>b</h1>", "chapter"), (4, "<p>" + "v " * 50 + "</p>", None)], "id int, html string, given string")
    asked = []
    call = lambda rows: (asked.append(rows.count()), rows.withColumn("answer", F.when(F.col("id") == 2, "chapter").otherwise("nonsense")))[1]
    got = {r.id: r.classification for r in classify.classify(df, "html", call, "given").collect()}
    assert got == {1: "frontmatter", 2: "chapter", 3: "chapter", 4: None} and asked == [2]


def test_markdown():
    md = markup.html_markdown
    assert md("<html><head><title>t</title><style>x</style></head><body><h2>A <i>b</i></h2><p>One<br/>two <b>x</b> &amp; y</p><hr/><p><ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp>字<rt>ji</rt></ruby></p></body></html>") == "## A *b*\n\nOne\ntwo **x** & y\n\n* * *\n\n{漢|kan}{字|ji}\n"
    assert md("<p><span class='koboSpan'>a</span><span>b</span> c<script>z</script></p><img src='i.png' alt='x'>") == "ab c\n\n![x](i.png)\n"
    assert md("<ul><li>a<li>b</ul><ol><li>c</li></ol><blockquote>q</blockquote><table><tr><th>h<td>i</tr><tr><td>1<td>2</table>") == "* a\n* b\n\n1. c\n\n> q\n\n| h | i |\n| --- | --- |\n| 1 | 2 |\n"
    assert md(None) is None and md("") == "\n" and md("<div><div></div></div>") == "\n" and md("a < b <p>x</q>y") == "a < b\n\nxy\n"


def test_html():
    assert assemble.markdown_html("# T\n\na *b* **c**  \nd {漢|kan}\n\n* * *\n\n- x\n- y & z") == "<h1>T</h1>\n<p>a <em>b</em> <strong>c</strong><br/>\nd <ruby>漢<rt>kan</rt></ruby></p>\n<hr/>\n<ul>\n<li>x</li>\n<li>y &amp; z</li>\n</ul>"
    assert assemble.markdown_html(None) is None and assemble.markdown_html("") == ""


def test_text(spark):
    assert one(spark, T.slug(F.col("t")), t="Ｈello, Wörld!! 漢字") == "hello-wörld-漢字"
    assert one(spark, T.slug(F.col("t")), t="!!") == "unknown"
    assert one(spark, T.book_id(F.col("i"), F.col("t"), F.col("s")), i="978-3-16-148410-0", t="x", s="y") == "9783161484100"
    assert one(spark, T.book_id(F.col("i"), F.col("t"), F.col("s")), i="", t=" ", s="My File") == "my-file"
    assert one(spark, T.normal_markdown(F.col("t")), t="\n a \n\n\n\nb　\n") == "a\n\nb\n"
    assert one(spark, T.chunk_id(F.lit(12345), F.lit(7)), t="") == "12345.007"
    assert tuple(one(spark, T.parse_chunk_id(F.col("t")), t="0012.034")) == (12, 34)
    assert one(spark, T.truncated_words(F.col("t"), 7), t="abc def ghi") == "abc..."


def test_quality(spark):
    gate = lambda s, o: one(spark, quality.length_gate(F.col("s"), F.col("o")), s=s, o=o)
    assert [gate("a b c d e f g h i j", "x y"), gate("a", "x y z"), gate("a b", "x"), gate("", "x"), gate("a", "x y")] == ["short", "long", "ok", "skipped", "ok"]
    assert quality.json_in('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert quality.json_in('so {"a": "}"} or {"b": {"c": "\\"}"}} end') == '{"b": {"c": "\\"}"}}'
    assert quality.json_in("none") == "none" and quality.json_in(None) is None


def test_context(spark):
    chunks = spark.createDataFrame([(1, "the ab c"), (2, "xy"), (3, "")], "c int, t string")
    forms = spark.createDataFrame([("e1", "ab"), ("e1", "the"), ("e2", "y"), ("e3", "zz"), ("e4", "")], "entity_id string, source string")
    want = {(1, "e1"), (2, "e2")}
    assert {tuple(r) for r in context.relevant_entities(chunks, forms, "c", "t").collect()} == want
    assert {tuple(r) for r in context.relevant_entities(chunks, forms, "c", "t", most=0).collect()} == want
    assert {tuple(r) for r in context.relevant_entities_scan(chunks, forms, "c", "t").collect()} == want


def test_state(spark):
    log = spark.createDataFrame([("s", "a", "started", 1, None, 1), ("s", "a", "completed", 2, None, 2), ("s", "a", "started", 3, None, 3), ("s", "b", "completed", 1, None, 1), ("s", "b", "failed", 2, "e" * 150, 2), ("s", "c", "completed", 1, None, 1), ("s", "c", "reset", 4, None, 4), ("s", "d", "completed", 9, None, 9)], "stage string, item_id string, status string, at long, error_message string, seq long")
    now = state.latest_state(log)
    assert {(r.item_id, r.status) for r in now.collect()} == {("a", "completed"), ("b", "failed"), ("d", "completed")}
    items = spark.createDataFrame([(x,) for x in "abcd"], "item_id string")
    assert {r.item_id for r in state.pending(items, now, "s").collect()} == {"b", "c"}
    assert len(state.failures(now).first().error_message) == 100
    assert {r.item_id for r in state.work(items, now, "s", targets=["a"]).collect()} == {"a"}
    with pytest.raises(ValueError):
        state.work(items, now, "s", force=True, retry_failed=True)
    reset = log.unionByName(spark.createDataFrame([("s", None, "reset", 5, None, 5)], log.schema))
    assert {r.item_id for r in state.latest_state(reset).collect()} == {"d"}


def test_provider(spark):
    calls, waits = [], []

    def flaky(messages):
        calls.append(len(messages))
        if len(calls) < 3:
            raise provider.RetryLater("busy")
        return "ok"

    assert provider.completed(flaky, [{}], sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    answers = iter(["no", '{"a": 0}', 'x {"a": 1}'])
    assert provider.structured(lambda m: next(answers), [], lambda o: None if o["a"] else "a is 0") == {"a": 1}
    with pytest.raises(ValueError):
        provider.validated(lambda m: "x", [], lambda t: False)
    df = spark.createDataFrame([(1, [("user", "hi")]), (2, [("user", "bad")])], "id int, m array<struct<role:string,content:string>>")

    def factory():
        def echo(m):
            if m[-1]["content"] == "bad":
                raise ValueRefused("refused")
            return m[-1]["content"].upper()

        from quirework.operators.provider import Refused as ValueRefused

        return echo

    assert {(r.id, r.answer, r.error) for r in provider.answered(df, "m", factory).collect()} == {(1, "HI", None), (2, None, "refused")}


def test_user_entities_stay_as_they_are(spark):
    known = spark.createDataFrame([("b", "place_000007", "place", "Tower", "user", [("塔", "Tower", "")])], "book_id string, entity_id string, category string, name string, origin string, forms array<struct<source string, translation string, reading string>>")
    rows = [
        ("b", 1, "塔", "", "place", "A tower", "c1", "tall", "n1", ["Spire"], [("Ann", "Tow")], "", "h"),
        ("b", 2, "谷", "tani", "place", "Valley", "c1", "deep", "n2", ["Vale"], [("Ann", "V"), ("Bob", "W")], "slow", "h1"),
        ("b", 3, "谷", "", "river", "The valley", "c2", "deep", "n2", ["Vale", "Dale"], [("Ann", "X")], "slow", "h1"),
        ("b", 4, "渓", "tani", "place", "Valley", "c3", "wide", "n3", None, None, "fast", "h2"),
    ]
    mentions = spark.createDataFrame(rows, "book_id string, ord int, source string, reading string, category string, translation string, chunk_id string, summary string, notes string, aliases array<string>, nicknames array<struct<speaker string, nick string>>, speech_style string, context_hint string")
    got = [(r.ord, r.entity_id, r.how) for r in linking.fold_mentions(mentions, known=known).orderBy("ord").collect()]
    assert got == [(1, "place_000007", "source"), (2, "place_000008", "new"), (3, "place_000008", "source"), (4, "place_000008", "reading")]
    e = {r.entity_id: r for r in linking.fold_entities(mentions, known=known).collect()}
    assert (e["place_000007"].n_mentions, e["place_000007"].translations, e["place_000007"].aliases) == (0, ["Tower"], [])
    v = e["place_000008"]
    assert (v.n_mentions, v.sources, v.translations, v.aliases, v.nicknames) == (3, ["谷", "渓"], ["Valley", "The valley"], ["Vale", "Dale"], ["Ann: V", "Bob: W"])
    assert (v.summary, v.notes, v.speech_style, v.hints, v.first_seen, v.last_seen) == ("deep wide", "n2 n3", "slow\nfast", ["h1", "h2"], "c1", "c3")


def test_similar_sources_meet_by_their_characters(spark):
    rng = random.Random(8)
    book, plain = linking.Book(0.9), []
    for i in range(400):
        source = "".join(rng.choice("abcd") for _ in range(rng.randint(5, 9)))
        m = SimpleNamespace(source=source, category="x", translation=source, chunk_id="c")
        alike = [e for e in plain if any(resolve.similarity_of(s, source) >= 0.9 for s in e)]
        hit = next((e for e in plain if source in e), None) or (alike[0] if len(alike) == 1 else None)
        if hit is None:
            plain.append(hit := [])
        if source not in hit:
            hit.append(source)
        book.add(m)
    assert [list(e["forms"]) for e in book.entities] == plain


def test_categories_are_checked(spark):
    entities = spark.createDataFrame([("a", "place"), ("b", "thing"), ("c", None)], "name string, category string")
    assert linking.require_categories(entities.where("name = 'a'"), ["place"]).count() == 1
    with pytest.raises(ValueError, match="thing"):
        linking.require_categories(entities, ["place"])


def test_markdown_of_all_kinds():
    got = assemble.markdown_html("1. one\n2. two\n   - in\n   - ner\n3. three\n\n> q\n> r\n\n| a | b |\n|---|:-:|\n| 1 | `2|x` |\n\n```py\nx < 1\n\n# no heading\n```\nsnake_case_word _it_ {x} {a|b|c} [l](u)")
    assert got == (
        "<ol>\n<li>one</li>\n<li>two\n<ul>\n<li>in</li>\n<li>ner</li>\n</ul>\n</li>\n<li>three</li>\n</ol>\n<blockquote><p>q\nr</p></blockquote>\n"
        "<table>\n<thead>\n<tr><th>a</th><th>b</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td>`2</td><td>x`</td></tr>\n</tbody>\n</table>\n"
        '<pre><code class="language-py">x &lt; 1\n\n# no heading\n</code></pre>\n<p>snake_case_word <em>it</em> {x} {a|b|c} <a href="u">l</a></p>'
    )


def test_http_client_and_shape(spark):
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            said = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append(said)
            status = next((n for n in (400, 429, 500) if f"s{n}" in said), 200)
            body = b'{"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}' if status == 200 else b'{"error": {"code": "insufficient_quota"}}' if "quota" in said else b"{}"
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = provider.Http(f"http://127.0.0.1:{server.server_port}/v1", "m", "k", 20)
        say = lambda t: client([{"role": "user", "content": t}])
        assert say("x") == "hi" and client.used == [3, 1]
        for text, kind in (("s400", provider.Refused), ("s429", provider.RetryLater), ("s429 quota", provider.Refused), ("s500", provider.RetryLater)):
            with pytest.raises(kind):
                say(text)
    finally:
        server.shutdown()
    shown = []
    provider.structured(lambda m: shown.append(m[-1]["content"]) or '{"a": "x"}', [{"role": "user", "content": "q"}], lambda o: None, shape={"a": "string"})
    assert shown == ['q\n\nAnswer with a JSON object like this:\n{"a": "text"}']


def test_lost_values_are_pending_again(spark):
    now = spark.createDataFrame([("s", "a", "completed"), ("s", "b", "completed"), ("s", "c", "failed"), ("t", "a", "completed")], "stage string, item_id string, status string")
    items = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "item_id string, v string")
    assert {(r.stage, r.item_id) for r in state.without_lost(now, items, "s", "v").collect()} == {("s", "b"), ("s", "c"), ("t", "a")}


def test_cosine_pairs_hold_bounded_blocks(spark, monkeypatch):
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, None), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    monkeypatch.setattr(resolve, "HELD_BYTES", 30 * 4 * 8, raising=False)
    pairs = resolve.cosine_pairs(df, "id", "v", 0.9)
    x, y = (df.where("id is not null and v is not null").select(F.col("id").alias(i), F.col("v").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    want = {(r.a, r.b): round(r.c, 9) for r in x.join(y, F.col("a") < F.col("b")).select("a", "b", resolve.cosine(F.col("x"), F.col("y")).alias("c")).where("c >= 0.9").collect()}
    got = [((r.a, r.b), round(r.cosine, 9)) for r in pairs.collect()]
    assert len(want) > 100 and dict(got) == want and len(got) == len(want)
    # ten blocks of 30 rows, a task for each pair of them
    assert pairs.rdd.getNumPartitions() == 55
    monkeypatch.undo()
    assert resolve.n_blocks(2000, 64) == 2 and resolve.n_blocks(600_000, 64) == 10 and resolve.n_blocks(600_000, 1536) == 220 and resolve.n_blocks(0, 0) == 1
    with pytest.raises(Exception, match="different lengths"):
        resolve.cosine_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, v array<double>"), "id", "v").collect()


def test_mentions_of_many_books_pass_by_in_order(spark):
    random.seed(9)
    names = ["塔", "塔の上", "アベル", "アベルちゃん", "城", "a-very-long-name", "a-very-long-namf"]
    rows = [(random.choice(["x", "y", "z", None]), i, random.choice(names), random.choice(["place", "character"]), random.choice(["T", "U"]), f"c{i}", random.choice([None, "r"]), random.choice([None, "s1", "s2"])) for i in range(3000)]
    schema = "book_id string, ord int, source string, category string, translation string, chunk_id string, reading string, summary string"
    known = spark.createDataFrame([("y", "place_000009", "place", "城", None, [("城", "Castle", None)]), ("only", "item_000001", "item", "K", "user", [])], "book_id string, entity_id string, category string, name string, origin string, forms array<struct<source string, translation string, reading string>>")
    books, want = {}, {}
    for r in rows:
        if r[0] not in books:
            books[r[0]] = linking.Book()
            if r[0] == "y":
                linking.taken_in(books["y"], SimpleNamespace(entity_id="place_000009", category="place", name="城", origin=None, forms=[{"source": "城", "translation": "Castle", "reading": None}]))
        e, how = books[r[0]].add(SimpleNamespace(**dict(zip(schema.replace(" string", "").replace(" int", "").split(", "), r))))
        want[r[0], r[1]] = (e["entity_id"], how)
    df = spark.createDataFrame(random.sample(rows, len(rows)), schema).repartition(7)
    links, entities = linking.fold_mentions(df, known=known), linking.fold_entities(df, known=known)
    assert {(r.book_id, r.ord): (r.entity_id, r.how) for r in links.collect()} == want
    got = {(r.book_id, r.entity_id): (r.n_mentions, r.summary, r.last_seen) for r in entities.collect()}
    assert got == {(b, e["entity_id"]): (e["n_mentions"], e["summary"], e["last_seen"]) for b, book in books.items() for e in book.entities} | {("only", "item_000001"): (0, "", "")}
    # no book's mentions are handed over as one table
    for out in (links, entities, linking.fold_mentions(df), linking.fold_entities(df)):
        assert "MapInArrow" in (text := out._jdf.queryExecution().optimizedPlan().toString()) and "InPandas" not in text


def test_mentions_are_read_as_they_come():
    import pyarrow as pa

    read = []

    def batches():
        for k in range(5):
            read.append(k)
            yield pa.RecordBatch.from_pylist([{"book_id": "b", "ord": k, "known": None, "mention": {"source": f"s{k}", "category": "c", "translation": "t", "chunk_id": "1"}}])

    rows = linking.folded(batches(), 0.95, True)
    assert next(rows) == ("b", 0, "c_000001", "new") and read == [0]
    assert len(list(rows)) == 4


def test_pages_are_freed_one_by_one_and_batches_are_bounded(spark, tables):
    import gc

    import pyarrow as pa

    from quirework.plans import books

    page = "<body>" + "<div><p>a <b>c</b></p><ul><li>x<li>y</ul>" * 50
    markup.html_markdown(page)
    gc.collect()
    gc.disable()
    try:
        assert markup.html_markdown(page).startswith("a **c**") and gc.collect() == 0
    finally:
        gc.enable()
    batch = pa.array([None, "", page, *(f"<p>{i}</p>" for i in range(100))])
    assert markup.markdown_of(batch).to_pylist() == [markup.html_markdown(x) for x in batch.to_pylist()]
    assert markup.markdown_of(batch.slice(0, 0)).to_pylist() == []
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert books.html_to_markdown(spark, tables).count() == 50
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
