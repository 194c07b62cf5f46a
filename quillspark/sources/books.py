"""Books as files: EPUB items, spine and metadata, page blocks, plain texts.

Files are read as binary rows, one a file, so a directory is spread over the
tasks; a file that cannot be read gives a row with its error and no text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.patterns import Author
from quillspark.functions.text import clean_extracted, is_page_header, lines, merge_text, squeeze_breaks, strip, unlines
from quillspark.sources.html import html_text, is_navigation

LEAST_CHAPTER = 100
METADATA = ("title", "creator", "language", "publisher", "date")
_DC, _OPF = "{http://purl.org/dc/elements/1.1/}", "{http://www.idpf.org/2007/opf}"
ITEMS = (
    "source_file string, item_id string, href string, media_type string, container_pos int, spine_pos int, skip boolean, text string, "
    "title string, creator string, language string, publisher string, date string, error string"
)


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``source_file, content``; an empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``source_file, text``: one row a file, line ends as LF."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    text = F.replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return rows.select(F.col("_metadata.file_name").alias("source_file"), text.alias("text"))


def unpack(content: bytes) -> tuple[list[tuple], dict[str, str]]:
    """Items (id, href, media type, bytes, place in the container, places in the spine) and metadata of an EPUB."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        path = next(x.attrib["full-path"] for x in container.iter() if x.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(path))
        base = PurePosixPath(path).parent
        metadata = dict.fromkeys(METADATA, "")
        for name in METADATA:
            found = next(package.iter(f"{_DC}{name}"), None)
            if found is not None:
                metadata[name] = found.text or ""
        manifest = [x for x in package.iter(f"{_OPF}item")]
        spine = [x.attrib.get("idref", "") for x in package.iter(f"{_OPF}itemref")]
        items = []
        for n, x in enumerate(manifest):
            href, item_id = unquote(x.attrib.get("href", "")), x.attrib.get("id", "")
            name = str(base / href)
            data = book.read(name) if name in book.namelist() else b""
            # the first place in the spine counts
            place = next((k for k, ref in enumerate(spine) if ref in (item_id, href)), None)
            items.append((item_id, href, x.attrib.get("media-type", ""), data, n, place))
        return items, metadata


def pack_books(books: DataFrame) -> DataFrame:
    """``source_file, content``: EPUB files of ``source_file, items`` (an array of href and html) and ``spine`` (an array of hrefs)."""

    def pack(items: list, spine: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
            rootfile = '<rootfile full-path="content.opf" media-type="application/oebps-package+xml"/>'
            book.writestr("META-INF/container.xml", f'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>{rootfile}</rootfiles></container>')
            manifest = "".join(f'<item id={quoteattr(x["href"])} href={quoteattr(x["href"])} media-type="application/xhtml+xml"/>' for x in items)
            refs = "".join(f"<itemref idref={quoteattr(x)}/>" for x in spine)
            book.writestr("content.opf", f'<package xmlns="{_OPF[1:-1]}"><manifest>{manifest}</manifest><spine>{refs}</spine></package>')
            for x in items:
                book.writestr(x["href"], x["html"].encode("utf-8", "replace"))
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source_file": pdf["source_file"], "content": [pack(i, s) for i, s in zip(pdf["items"], pdf["spine"])]})

    return books.select("source_file", "items", "spine").mapInPandas(run, "source_file string, content binary")


def epub_items(files: DataFrame) -> DataFrame:
    """One row for each document of each book, with its text; an unreadable book gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.strip().split(" ")[0] for x in ITEMS.split(",")]
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["source_file"], pdf["content"]):
                try:
                    items, metadata = unpack(bytes(content))
                    for item_id, href, kind, data, n, place in items:
                        if kind in ("application/xhtml+xml", "text/html"):
                            rows.append((name, item_id, href, kind, n, place, is_navigation(href, data), html_text(data), *metadata.values(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, *[None] * 12, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"container_pos": "Int32", "spine_pos": "Int32", "skip": "boolean"})

    return files.select("source_file", "content").mapInPandas(run, ITEMS)


def book_texts(items: DataFrame) -> DataFrame:
    """``source_file, text``: a book's chapters of over 100 characters in the order of the spine, then those not in it."""
    usable = items.where(F.col("error").isNull() & ~F.col("skip") & (F.length(strip(F.col("text"))) > LEAST_CHAPTER))
    order = F.struct(F.col("spine_pos").isNull().alias("a"), F.col("spine_pos").alias("b"), F.col("container_pos").alias("c"), "text")
    first = Window.partitionBy("source_file", "href").orderBy(F.col("spine_pos").asc_nulls_last(), "container_pos")
    once = usable.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.text), "\n\n")
    return once.groupBy("source_file").agg(joined.alias("text"))


def book_metadata(items: DataFrame) -> DataFrame:
    """``source_file`` and the five fields, empty where unknown."""
    fields = [F.coalesce(F.first(c, ignorenulls=True), F.lit("")).alias(c) for c in METADATA]
    return items.groupBy("source_file").agg(*fields)


def spine_order(spine: DataFrame, items: DataFrame) -> DataFrame:
    """``source_file, href, place``: spine entries by their item's path (by themselves where it is unknown), each once,
    then the items that the spine lacks."""
    named = items.select("source_file", "item_id", "href", "container_pos")
    known = spine.join(named, ["source_file", "item_id"], "left").select(
        "source_file", F.coalesce("href", "item_id").alias("href"), "spine_pos"
    )
    inside = known.join(named.select("source_file", "href").distinct(), ["source_file", "href"], "left_semi")
    inside = inside.groupBy("source_file", "href").agg(F.min("spine_pos").alias("p")).select("source_file", "href", F.lit(0).alias("k"), "p")
    rest = named.join(known, ["source_file", "href"], "left_anti").select("source_file", "href", F.lit(1).alias("k"), F.col("container_pos").alias("p"))
    order = Window.partitionBy("source_file").orderBy("k", "p", "href")
    return inside.unionByName(rest).select("source_file", "href", (F.row_number().over(order) - 1).alias("place"))


def page_text(pages: Column, author: Author | None = None, series: str | None = None) -> Column:
    """Text of an array of pages, each an array of blocks (``text``, ``kind``; kind 0 is text).

    Headers and footers are dropped, each page ends with an empty line, lines are merged into paragraphs.
    """

    def page(blocks: Column) -> Column:
        rows = F.flatten(F.transform(F.filter(blocks, lambda b: b.kind == 0), lambda b: lines(b.text)))
        return F.array_append(F.filter(rows, lambda x: ~is_page_header(x, author, series)), F.lit(""))

    text = clean_extracted(unlines(F.flatten(F.transform(pages, page))))
    return strip(squeeze_breaks(merge_text(text)))


def pages_of(files: DataFrame, decode: Callable[[bytes], list[list[tuple[str, int]]]]) -> DataFrame:
    """``source_file, pages, error`` by a decoder of page files, which is given from outside (no reader is part of this package)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["source_file"], pdf["content"]):
                try:
                    pages = [[{"text": t, "kind": k} for t, k in page] for page in decode(bytes(content))]
                    rows.append((name, pages, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "pages", "error"])

    return files.select("source_file", "content").mapInPandas(run, "source_file string, pages array<array<struct<text:string,kind:int>>>, error string")


def write_texts(texts: DataFrame, path: str) -> None:
    """Keyed by the whole source file's name: two files of one stem do not overwrite each other."""
    texts.write.mode("overwrite").parquet(path)
