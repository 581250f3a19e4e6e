"""EPUB books: a reader that distributes over files, and a writer of changed copies."""

from __future__ import annotations

import io
import posixpath
import re
import subprocess
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types of documents and images, and the XML namespaces of packages.
DOCUMENTS = ("application/xhtml+xml", "text/html")
OPF, DC = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}"
DOCUMENT_SCHEMA = "path string, spine_index int, original_href string, raw string"
BOOK_SCHEMA = "path string, opf_path string, padding int, images array<string>, metadata map<string,array<string>>, warnings array<string>"
ENTRY_SCHEMA = "path string, ord int, name string, compress_type int, content binary"


def opf_path(archive: zipfile.ZipFile) -> str:
    """The package file that META-INF/container.xml names; without it the first .opf."""
    if "META-INF/container.xml" in archive.namelist():
        found = ElementTree.fromstring(archive.read("META-INF/container.xml")).find(".//{*}rootfile")
        if found is not None and found.get("full-path"):
            return found.get("full-path")
    names = [n for n in archive.namelist() if n.endswith(".opf")]
    if not names:
        raise ValueError("no package document")
    return names[0]


def resolve(base: str, href: str) -> str:
    """An href relative to the package file as a name in the archive."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0]))).lstrip("/")


def read_book(data: bytes) -> tuple[dict, list[tuple[int, str, str]]]:
    """Facts of the book and its documents (place in the spine, href, markup) in reading order.

    Ids that the manifest lacks and entries that are no documents are skipped, so places may have gaps.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = opf_path(z)
        package = ElementTree.fromstring(z.read(opf))
        items = {i.get("id"): i for i in package.iter(f"{OPF}item")}
        spine = [r.get("idref") for r in package.iter(f"{OPF}itemref")]
        warnings, docs = [], []
        for place, ref in enumerate(spine):
            item = items.get(ref)
            if item is None:
                warnings.append(f"unknown id {ref}")
            elif item.get("media-type") in DOCUMENTS:
                name = resolve(opf, item.get("href"))
                if name in z.namelist():
                    docs.append((place, item.get("href"), z.read(name).decode("utf-8", "replace")))
                else:
                    warnings.append(f"missing {name}")
        listed = {*spine}
        warnings += [f"not in the spine: {i.get('href')}" for k, i in items.items() if i.get("media-type") in DOCUMENTS and k not in listed]
        metadata: dict[str, list[str]] = {}
        for e in package.iter():
            if isinstance(e.tag, str) and e.tag.startswith(DC) and (e.text or "").strip():
                metadata.setdefault(e.tag[len(DC):], []).append(e.text.strip())
        images = [i.get("href") for i in items.values() if (i.get("media-type") or "").startswith("image/")]
        return {"opf_path": opf, "padding": max(4, len(str(len(spine)))), "images": images, "metadata": metadata, "warnings": warnings}, docs


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A row a spine document of all books at ``path``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf.path, pdf.content):
                yield pd.DataFrame([(path, *d) for d in read_book(content)[1]], columns=["path", "spine_index", "original_href", "raw"])

    return files(spark, path).mapInPandas(run, DOCUMENT_SCHEMA)


def books(spark: SparkSession, path: str) -> DataFrame:
    """A row a book: package file, padding of spine numbers, images, metadata, warnings."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([{"path": p} | read_book(c)[0] for p, c in zip(pdf.path, pdf.content)])

    return files(spark, path).mapInPandas(run, BOOK_SCHEMA)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A row an archive entry, in archive order."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf.path, pdf.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(path, i, e.filename, e.compress_type, z.read(e)) for i, e in enumerate(z.infolist())], columns=["path", "ord", "name", "compress_type", "content"])

    return files(spark, path).mapInPandas(run, ENTRY_SCHEMA)


def archive(rows: list[tuple[int | None, str, bytes]]) -> bytes:
    """The bytes of a book: mimetype first and stored, then the others in order, new ones (without a place) last."""
    out = io.BytesIO()
    rows = sorted(rows, key=lambda r: (r[1] != "mimetype", r[0] is None, r[0] or 0, r[1]))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for _, name, content in rows:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def rebuilt(original: DataFrame, modified: DataFrame) -> DataFrame:
    """(path, content): each book with the contents of ``modified`` (path, name, content) in place of its own; other entries keep their bytes."""
    m = modified.select("path", "name", F.col("content").alias("_new"))
    joined = original.select("path", "ord", "name", "content").join(m, ["path", "name"], "full_outer").select("path", "ord", "name", F.coalesce("_new", "content").alias("content"))

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(None if pd.isna(o) else int(o), n, c) for o, n, c in zip(pdf.ord, pdf.name, pdf["content"])]
        return pd.DataFrame({"path": [key[0]], "content": [archive(rows)]})

    return joined.withColumnRenamed("name", "name").groupBy("path").applyInPandas(lambda k, p: write(k, p), "path string, content binary")


def toc_titles(xml: str) -> list[str]:
    """Titles of an NCX or a navigation document, in document order."""
    root = ElementTree.fromstring(xml)
    text = lambda e: " ".join("".join(e.itertext()).split())
    points = [text(e.find("{*}navLabel/{*}text")) for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("}navPoint") and e.find("{*}navLabel/{*}text") is not None]
    if points:
        return points
    navs = [n for n in root.iter() if isinstance(n.tag, str) and n.tag.rsplit("}")[-1] == "nav" and any(k.endswith("type") and v == "toc" for k, v in n.attrib.items())]
    return [text(a) for n in navs for a in n.iter() if isinstance(a.tag, str) and a.tag.rsplit("}")[-1] == "a"]


def with_titles(xml: str, titles: list[str]) -> str:
    """The same document with other titles; their number must fit."""
    root = ElementTree.fromstring(xml)
    labels = [e.find("{*}navLabel/{*}text") for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("}navPoint") and e.find("{*}navLabel/{*}text") is not None]
    if not labels:
        navs = [n for n in root.iter() if isinstance(n.tag, str) and n.tag.rsplit("}")[-1] == "nav" and any(k.endswith("type") and v == "toc" for k, v in n.attrib.items())]
        labels = [a for n in navs for a in n.iter() if isinstance(a.tag, str) and a.tag.rsplit("}")[-1] == "a"]
    if len(labels) != len(titles):
        raise ValueError(f"{len(titles)} titles for {len(labels)} entries")
    for label, title in zip(labels, titles):
        for child in list(label):
            label.remove(child)
        label.text = title
    return ElementTree.tostring(root, encoding="unicode")


def with_body(xhtml: str, body: str) -> str:
    """The same document with another body content; head and body attributes stay."""
    m = re.search(r"(?is)(<body\b[^>]*>)(.*)(</body\s*>)", xhtml)
    if not m:
        raise ValueError("no body")
    return xhtml[: m.end(1)] + "\n" + body + "\n" + xhtml[m.start(3):]


def with_stylesheet(xhtml: str, href: str) -> str:
    """The document with a link to a style sheet at the end of its head, once."""
    link = f'<link rel="stylesheet" type="text/css" href="{href}"/>'
    return xhtml if link in xhtml else re.sub(r"(?i)</head\s*>", lambda m: link + m[0], xhtml, count=1)


def validated(path: str, command: tuple[str, ...] = ("epubcheck",), seconds: float = 300.0) -> tuple[bool | None, str]:
    """Whether a validator finds a book in order, and what it says; None if there is no validator or it takes too long."""
    try:
        done = subprocess.run([*command, path], capture_output=True, text=True, timeout=seconds)
    except (FileNotFoundError, subprocess.TimeoutExpired) as e:
        return None, str(e)
    return done.returncode == 0, done.stdout + done.stderr


def package_updated(opf: str, language: str, suffix: str, note: str, css: str | None = None, identifier: str | None = None) -> str:
    """A package with its languages, first title's suffix, description, reading direction and, if given, style sheet item and identifier changed."""
    ElementTree.register_namespace("", OPF[1:-1])
    ElementTree.register_namespace("dc", DC[1:-1])
    root = ElementTree.fromstring(opf)
    metadata = root.find(f"{OPF}metadata")
    for e in root.iter(f"{DC}language"):
        e.text = language
    title = root.find(f".//{DC}title")
    if title is not None and not (title.text or "").endswith(suffix):
        title.text = (title.text or "") + suffix
    description = root.find(f".//{DC}description")
    if description is None and metadata is not None:
        description = ElementTree.SubElement(metadata, f"{DC}description")
    if description is not None:
        description.text = note
    if identifier is not None and (first := root.find(f".//{DC}identifier")) is not None:
        first.text = identifier
    spine = root.find(f"{OPF}spine")
    if spine is not None and spine.get("page-progression-direction") == "rtl":
        spine.set("page-progression-direction", "ltr")
    manifest = root.find(f"{OPF}manifest")
    if css is not None and manifest is not None and not any(i.get("href") == css for i in manifest):
        ElementTree.SubElement(manifest, f"{OPF}item", {"id": "added-css", "href": css, "media-type": "text/css"})
    return ElementTree.tostring(root, encoding="unicode")
