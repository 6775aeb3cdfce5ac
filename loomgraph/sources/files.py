"""Uploaded files: intake, kind detection and text extraction."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import MAX_UPLOAD_BYTES
from loomgraph.functions.text import strip_markdown

_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
# First bytes, in hex, and the kind they tell; extensions with kind and media type.
MAGIC = (("25504446", "pdf"), ("504B0304", "docx"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("424D", "image"), ("00000100", "image"))
EXTENSIONS = {
    ".pdf": ("pdf", "application/pdf"), ".docx": ("docx", _DOCX), ".txt": ("txt", "text/plain"), ".md": ("md", "text/markdown"),
    ".markdown": ("md", "text/markdown"), ".png": ("image", "image/png"), ".jpg": ("image", "image/jpeg"), ".jpeg": ("image", "image/jpeg"),
    ".gif": ("image", "image/gif"), ".bmp": ("image", "image/bmp"), ".webp": ("image", "image/webp"), ".tiff": ("image", "image/tiff"),
    ".tif": ("image", "image/tiff"), ".html": ("bookmark", "text/html"), ".htm": ("bookmark", "text/html"),
}


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(source_path, content, byte_size, content_sha256)`` of files that are neither empty nor too large."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return intake(files.select(F.col("path").alias("source_path"), "content"))


def intake(files: DataFrame, content: str = "content") -> DataFrame:
    sized = files.withColumn("byte_size", F.octet_length(content).cast("long"))
    return sized.where(F.col("byte_size").between(1, MAX_UPLOAD_BYTES)).withColumn("content_sha256", F.sha2(content, 256))


def receive(files: DataFrame, content: str = "content", most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Every file with its ``code``, ``byte_size`` and, if accepted, ``content_sha256``.

    201: accepted. 400: empty or no content. 413: more than ``most`` bytes.
    """
    sized = files.withColumn("byte_size", F.coalesce(F.octet_length(content), F.lit(0)).cast("long"))
    code = F.when(F.col("byte_size") == 0, 400).when(F.col("byte_size") > most, 413).otherwise(201)
    return sized.withColumn("code", code).withColumn("content_sha256", F.when(code == 201, F.sha2(content, 256)))


def detect_kind(content: Column, filename: Column) -> Column:
    """``struct(kind, mime)``: by first bytes, then by extension; plain text where neither tells."""
    head = F.hex(F.substring(content, 1, 8))
    magic = F.lit(None).cast("string")
    for signature, kind in reversed(MAGIC):
        magic = F.when(F.startswith(head, F.lit(signature)), kind).otherwise(magic)
    extension = F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1))
    pairs = [x for e, (k, m) in EXTENSIONS.items() for x in (F.lit(e), F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mime")))]
    known = F.try_element_at(F.create_map(*pairs), extension)
    made = lambda kind, mime: F.struct(F.lit(kind).alias("kind"), (mime if isinstance(mime, Column) else F.lit(mime)).alias("mime"))
    return (
        F.when((magic == "docx") & extension.isin(".xlsx", ".pptx"), made("txt", "application/octet-stream"))
        .when(magic == "pdf", made("pdf", "application/pdf"))
        .when(magic == "image", made("image", F.coalesce(known["mime"], F.lit("image/png"))))
        .when(magic == "docx", made("docx", _DOCX))
        .otherwise(F.coalesce(known, made("txt", "text/plain")))
    )


class _Page(HTMLParser):
    """Text of a page without scripts, styles, comments and navigation; blocks on lines of their own."""

    SKIP = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "form"))
    BLOCK = frozenset(("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "title"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.SKIP
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def page_text(html: str) -> str:
    """The main text of a page, or the page itself where none is found."""
    parser = _Page()
    parser.feed(html)
    text = re.sub(r"\s*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", "".join(parser.parts))).strip()
    return text or html


def docx_text(raw: bytes) -> str:
    """Paragraphs of a Word file that are not blank, with a blank line between."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n\n".join(line for line in lines if line.strip())


@dataclass
class Extracted:
    """A text with what its extractor tells about it."""

    text: str
    used_ocr: bool = False
    page_count: int | None = None


#: Extractors by kind, ``bytes -> text``. PDF and image readers need libraries of their own: add them here.
EXTRACTORS: dict[str, Callable[[bytes], str | Extracted]] = {
    "txt": lambda raw: raw.decode("utf-8", errors="replace"),
    "note": lambda raw: raw.decode("utf-8", errors="replace"),
    "md": lambda raw: raw.decode("utf-8", errors="replace"),
    "bookmark": lambda raw: page_text(raw.decode("utf-8", errors="replace")),
    "docx": docx_text,
}


PROBED_PAGES = 3


def paged_extractor(pages: Callable[[bytes], list[str]], ocr: Callable[[bytes], str] | None = None) -> Callable[[bytes], Extracted]:
    """An extractor of paged files from a reader of page texts and a recogniser of images.

    Where the first pages hold any text, pages are joined by a blank line and counted. Where they
    hold none or can't be read, the recogniser is asked; without one that is an error.
    """

    def run(raw: bytes) -> Extracted:
        try:
            texts = pages(raw)
        except Exception:
            texts = []
        if any(t.strip() for t in texts[:PROBED_PAGES]):
            return Extracted("\n\n".join(texts), page_count=len(texts))
        if ocr is None:
            raise ValueError("no text layer, and no recogniser of images")
        return Extracted(ocr(raw), used_ocr=True)

    return run


def recognised(ocr: Callable[[bytes], str]) -> Callable[[bytes], Extracted]:
    """An extractor of images from a recogniser."""
    return lambda raw: Extracted(ocr(raw), used_ocr=True)


def extract_text(files: DataFrame, content: str = "content", kind: str = "kind", extractors: dict[str, Callable[[bytes], str | Extracted]] | None = None) -> DataFrame:
    """Add ``text``, ``used_ocr``, ``page_count`` and ``error`` to files; a file that can't be read has its error and no text."""
    use = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, errors = [], []
            for raw, of in zip(batch.column(content).to_pylist(), batch.column(kind).to_pylist(), strict=True):
                try:
                    if of not in use:
                        raise ValueError(f"unsupported kind {of}")
                    found = use[of](raw or b"")
                    read.append(found if isinstance(found, Extracted) else Extracted(found))
                    errors.append(None)
                except Exception as e:
                    read.append(Extracted(None))
                    errors.append(str(e)[:2000])
            made = [pa.array([getattr(r, f) for r in read], kind) for f, kind in (("text", pa.string()), ("used_ocr", pa.bool_()), ("page_count", pa.int32()))]
            yield pa.record_batch([*batch.columns, *made, pa.array(errors, pa.string())], names=[*batch.schema.names, "text", "used_ocr", "page_count", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    done = files.mapInArrow(run, f"{fields}, text string, used_ocr boolean, page_count int, error string")
    return done.withColumn("text", F.when(F.col(kind) == "md", strip_markdown(F.col("text"))).otherwise(F.col("text")))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the main ``text`` of web pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if h is None else page_text(h) for h in batch.column(html).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, text string")
