import io
import zipfile

import pytest

from quirework import config
from quirework.plans import stages
from quirework.sources import epub

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:language>ja</dc:language><dc:identifier>i</dc:identifier></metadata>
<manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b%20c.xhtml" media-type="application/xhtml+xml"/><item id="p" href="p.png" media-type="image/png"/><item id="z" href="z.xhtml" media-type="application/xhtml+xml"/><item id="c" href="s.css" media-type="text/css"/></manifest>
<spine page-progression-direction="rtl"><itemref idref="a"/><itemref idref="p"/><itemref idref="none"/><itemref idref="b"/></spine></package>"""
PAGE = "<html><head><title>x</title></head><body class='k'><h1>One</h1><p>{}</p></body></html>"


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", OPF)
        z.writestr("O/t/a.xhtml", PAGE.format("word " * 40))
        z.writestr("O/t/b c.xhtml", PAGE.format("few"))
        z.writestr("O/s.css", "p { writing-mode: vertical-rl; color: red }")
    (folder / "x.epub").write_bytes(out.getvalue())
    return str(folder)


def test_read(spark, shelf):
    docs = epub.documents(spark, shelf).orderBy("spine_index").collect()
    assert [(d.spine_index, d.original_href) for d in docs] == [(0, "t/a.xhtml"), (3, "t/b%20c.xhtml")]
    b = epub.books(spark, shelf).first()
    assert b.padding == 4 and b.images == ["p.png"] and b.metadata["title"] == ["T"] and len(b.warnings) == 2


def test_stages_end_to_end(spark, shelf, tmp_path):
    docs = stages.clean(stages.extract(spark, shelf))
    known = stages.classified(docs).fillna({"classification": "chapter"})
    chunks = stages.chunked(known)
    assert {r.chunk_id for r in chunks.collect()} == {"0000.001", "0003.001"}
    layout = config.Layout(str(tmp_path))
    kept = stages.commit(chunks, layout, "chunk", 0, chunks.selectExpr("chunk_id as item_id"))
    whole = stages.assembled(kept.where("spine_index = 0").selectExpr("path", "spine_index", "chunk_index", "upper(text) as translated_text"), kept)
    assert {(r.spine_index, r.complete) for r in whole.collect()} == {(0, True), (3, False)}
    book = stages.rebuilt(spark, shelf, whole, docs).first()
    with zipfile.ZipFile(io.BytesIO(bytes(book.content))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert b"WORD WORD" in z.read("O/t/a.xhtml") and b"class='k'" in z.read("O/t/a.xhtml")
        assert b"few" in z.read("O/t/b c.xhtml") and b"writing-mode" not in z.read("O/s.css")
    assert {r.item_id for r in stages.batched(kept).collect()} == {"0000.b1", "0003.b1"}


def test_package_and_contents():
    out = epub.package_updated(OPF, "en", " (English Translation)", "note", "x.css", "new-id")
    assert "T (English Translation)" in out and 'page-progression-direction="ltr"' in out and ">en<" in out and "new-id" in out and "x.css" in out
    ncx = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> A </text></navLabel><navPoint><navLabel><text>B</text></navLabel></navPoint></navPoint></navMap></ncx>'
    assert epub.toc_titles(ncx) == ["A", "B"] and epub.toc_titles(epub.with_titles(ncx, ["x", "y"])) == ["x", "y"]
    nav = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a">One <b>1</b></a></li></ol></nav></body></html>'
    assert epub.toc_titles(nav) == ["One 1"]
    with pytest.raises(ValueError):
        epub.with_titles(ncx, ["x"])
    with pytest.raises(ValueError):
        epub.with_body("<p/>", "x")


def test_settings():
    s = config.merged(config.Settings(), {"target_language": "de", "unknown": 1, "chunking": {"target": 10}})
    assert s.suffix() == " (German Translation)" and s.chunking.target == 10 and s.chunking.least == 400
    assert config.language_name("xx") == "xx" and "chunking" in config.default_yaml()


NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel></navPoint><navPoint><navLabel><text>Two</text></navLabel></navPoint><navPoint><navLabel><text>One</text></navLabel></navPoint></navMap></ncx>'


def test_contents(spark):
    from quirework.plans import contents

    entries = spark.createDataFrame([("b", 0, "O/t.ncx", bytearray(NCX.encode())), ("b", 1, "O/x.html", bytearray(b"<p>no contents</p>")), ("c", 0, "n.xhtml", bytearray(b"<nav"))], "path string, ord int, name string, content binary")
    found = contents.titles(entries)
    assert [r.title for r in found.orderBy("ord").collect()] == ["One", "Two"]

    def factory():
        def call(messages):
            lines = messages[-1]["content"].split("\n\n")[0].split("\n")
            return '{"titles": [' + ", ".join(f'"{x.upper()}"' for x in lines) + "]}"

        return call

    made = contents.translated_titles(found, factory, "Japanese", "English")
    new = contents.rewritten(entries, made).collect()
    assert len(new) == 1 and epub.toc_titles(bytes(new[0].content).decode()) == ["ONE", "TWO", "ONE"]
    e = spark.createDataFrame([("b", 1, "place", 2), ("b", 2, "character", 1), ("b", 3, "term", 3)], "book_id string, entity_id long, category string, ord int")
    f = spark.createDataFrame([("b", 1, "r", "Rome"), ("b", 2, "a", "Abel"), ("b", 3, "t", "")], "book_id string, entity_id long, source string, translation string")
    assert contents.glossary(e, f).first().glossary == "a -> Abel\nr -> Rome" and contents.glossary(e, f, ("place",)).first().glossary == "r -> Rome"


def test_command_line_and_versions(spark, shelf, tmp_path):
    from quirework import cli

    work, out = str(tmp_path / "work"), tmp_path / "out"
    layout = config.Layout(work)
    assert cli.main(["run", shelf, work]) == 0 and cli.main(["chunk", work]) == 0
    assert stages.versions(spark, layout, "chunk") == [0, 1] and stages.versions(spark, layout, "translate") == []
    with pytest.raises(ValueError):
        cli.main(["assemble", work])
    parts = stages.newest(spark, layout, "chunk").selectExpr("path", "spine_index", "chunk_index", "upper(text) as translated_text")
    stages.commit(parts, layout, "translate")
    assert cli.main(["assemble", work]) == 0 and cli.main(["rebuild", shelf, work, str(out)]) == 0
    with zipfile.ZipFile(out / "x.epub") as z:
        page, package = z.read("O/t/a.xhtml"), z.read("O/c.opf")
        assert b"WORD WORD" in page and b'href="../added.css"' in page and b"added.css" in package and b"English Translation" in package and z.read("O/added.css")
    stages.commit(parts, layout, "glossary_cluster")
    assert stages.invalidate(spark, layout, "glossary_build") == ("glossary_cluster", "glossary_reconcile") and stages.versions(spark, layout, "glossary_cluster") == []
    assert epub.validated("x", ("no-such-validator",))[0] is None
    assert config.Models("a", qa="b").of("qa") == "b" and config.Models("a").of("summarize") == "a"
    whole = spark.createDataFrame([("x", 1, False)], "path string, spine_index int, complete boolean")
    with pytest.raises(ValueError, match="x#1"):
        stages.require_complete(whole)
