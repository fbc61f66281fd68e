"""E-books as a table of text segments: one task reads one archive of a bounded size; everything after is DataFrame work."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, doc_path string, row long, kind string, text string, digest string, error string"
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd caption figcaption blockquote pre div section article header footer aside body title".split())
SKIPPED = frozenset("script style head template svg math rt rp".split())
SPINE_STEP, NAV, NCX = 1_000_000, 8_000_000_000, 9_000_000_000


class _Blocks(HTMLParser):
    """Text of the innermost block elements in document order; readings of ruby are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.hidden = [], [], 0

    def _end(self) -> None:
        text = re.sub(r" {2,}", " ", re.sub(r"[\r\n\t]+", " ", "".join(self.open))).strip()
        if text:
            self.found.append(text)
        self.open = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SKIPPED:
            self.hidden += 1
        elif tag in BLOCKS:
            self._end()
        elif tag == "br":
            self.open.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self._end()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.open.append(data)


def blocks(html: bytes) -> list[str]:
    parser = _Blocks()
    parser.feed(html.decode("utf-8", "replace"))
    parser.close()
    parser._end()
    return parser.found


def entry(archive: zipfile.ZipFile, path: str) -> str | None:
    """The archive's name for a path: as written, else the only one that equals it when decoded, normalised and with forward slashes."""
    fold = lambda x: unicodedata.normalize("NFC", unquote(x)).replace("\\", "/")
    names = archive.namelist()
    if path in names:
        return path
    same = [n for n in names if fold(n) == fold(path)]
    return same[0] if len(same) == 1 else None


def segments_of(raw: bytes) -> Iterator[tuple[str, int, str, str]]:
    """(document, row, kind, text) by the package's spine, then the table of contents."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if tag(e) == "rootfile")
        root, base = ElementTree.fromstring(archive.read(package)), posixpath.dirname(package)
        items = {e.attrib["id"]: e.attrib for e in root.iter() if tag(e) == "item"}
        place = lambda href: entry(archive, posixpath.normpath(posixpath.join(base, href.split("#")[0])))
        spine = [items[e.attrib["idref"]]["href"] for e in root.iter() if tag(e) == "itemref" and e.attrib.get("idref") in items]
        contents = [(NAV, "nav", x["href"]) for x in items.values() if "nav" in x.get("properties", "").split() and x["href"] not in spine]
        for start, kind, href in [*((i * SPINE_STEP, "text", h) for i, h in enumerate(spine)), *contents]:
            if name := place(href):
                for k, text in enumerate(blocks(archive.read(name))):
                    yield name, start + k, kind, text
        for x in items.values():
            if x.get("media-type") == "application/x-dtbncx+xml" and (name := place(x["href"])):
                labels = [e.text.strip() for e in ElementTree.fromstring(archive.read(name)).iter() if tag(e) == "text" and e.text and e.text.strip()]
                for k, text in enumerate(labels):
                    yield name, NCX + k, "ncx", text


def epub_segments(spark: SparkSession, path: str, max_bytes: int = 500 << 20) -> DataFrame:
    """Segments of every .epub under a folder; a book that can't be read, or is over ``max_bytes``, is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for book, raw, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if size > max_bytes:
                        raise ValueError("the book is too large")
                    rows = [(book, d, n, k, t, hashlib.sha1(t.encode()).hexdigest(), None) for d, n, k, t in segments_of(raw)]
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(book, None, None, "error", None, None, str(e) or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{epub,EPUB}").load(path)
    return files.select("path", "content", "length").mapInArrow(run, SCHEMA)
