"""Books and markup: EPUB packages, Markdown, endnotes, plain text by format."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources import files

_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "tr", "section", "article", "aside"}
_DC = "{http://purl.org/dc/elements/1.1/}"
_UUID = re.compile(r"urn:uuid:.*|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
#: Formats by suffix.
FORMATS = {"txt": "text", "text": "text", "html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "epub": "epub", "pdf": "pdf"}


def markdown_text(text: Column) -> Column:
    """Markdown without its marks, by rules in a fixed order: links go before images and inline code before fences, so '![a](b)' leaves '!a'."""
    rules = [(r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"(?m)^[-*+]\s+", ""), (r"(?m)^\d+\.\s+", ""), (r"`([^`]+)`", "$1"), (r"```[\s\S]*?```", "")]
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


class _Chapter(HTMLParser):
    """Text with an empty line between blocks, headings with their places, and note marks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.headings, self.notes, self.hidden = "", [], [], 0
        self.open: list = []

    def _break(self):
        self.text = self.text.rstrip(" ")
        if self.text and not self.text.endswith("\n\n"):
            self.text += "\n\n"

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        if tag in _BLOCKS:
            self._break()
        if re.fullmatch(r"h[1-6]", tag):
            self.open.append((tag, len(self.text)))
        ident = dict(attrs).get("id") or dict(attrs).get("name") or ""
        mark = re.search(r"sdendnote(\d+)(anc|sym)", ident) if tag == "a" else None
        if mark:
            self.notes.append((int(mark.group(1)), mark.group(2), len(self.text)))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0
        if self.open and self.open[-1][0] == tag:
            _, start = self.open.pop()
            if self.text[start:].strip():
                self.headings.append((int(tag[1]), start, len(self.text), self.text[start:].strip()))
        if tag in _BLOCKS:
            self._break()

    def handle_data(self, data):
        if not self.hidden:
            data = re.sub(r"\s+", " ", data)
            self.text += data.lstrip() if not self.text or self.text[-1].isspace() else data


def parse_epub(content: bytes) -> dict:
    """Title, author, publisher, date, language, isbn, uuid, text, headings and notes of one EPUB package."""
    book = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
    opf = ElementTree.fromstring(book.read(package))
    first = lambda name: next((e.text.strip() for e in opf.iter(_DC + name) if e.text), "")
    isbn = uuid = ""
    for e in opf.iter(_DC + "identifier"):
        value = (e.text or "").strip()
        if "isbn" in str(e.attrib).lower() or re.fullmatch(r"97[89]\d{10}", value.replace("-", "")):
            isbn = value
        elif _UUID.fullmatch(value):
            uuid = value
    items = {e.get("id"): e.get("href") for e in opf.iter() if e.tag.endswith("}item")}
    text, headings, notes = "", [], []
    for ref in (e.get("idref") for e in opf.iter() if e.tag.endswith("}itemref")):
        if ref in items:
            chapter = _Chapter()
            chapter.feed(book.read(normpath(join(dirname(package), items[ref]))).decode("utf-8", "replace"))
            chapter.close()
            headings += [(level, a + len(text), b + len(text), title) for level, a, b, title in chapter.headings]
            notes += [(n, kind, at + len(text)) for n, kind, at in chapter.notes]
            text += chapter.text.strip(" ") if chapter.text.endswith("\n\n") or not chapter.text else chapter.text + "\n\n"
    return {"title": first("title"), "author": first("creator"), "publisher": first("publisher"), "date": first("date"), "language": first("language") or "en", "isbn": isbn, "uuid": uuid, "text": text, "headings": headings, "notes": notes}


_EPUB = "path string, title string, author string, publisher string, date string, language string, isbn string, uuid string, text string, headings array<struct<level:int,start:bigint,end:bigint,title:string>>, notes array<struct<number:int,kind:string,at:bigint>>, error string"


def epub_books(packages: DataFrame) -> DataFrame:
    """One row per package (path, content) with its metadata, text, headings and note marks; a broken package has only its error."""
    names = [f.split()[0] for f in re.split(r", (?=\w+ (?:string|array))", _EPUB)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append({"path": path, "error": None, **parse_epub(bytes(content))})
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, TypeError) as e:
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return packages.select("path", "content").mapInPandas(run, _EPUB)


def resolved_notes(books: DataFrame) -> DataFrame:
    """(path, number, call_at, note_at): marks in the text matched with the notes they call; -1 where one side is missing."""
    each = books.select("path", F.explode("notes").alias("n")).select("path", "n.*")
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    both = each.groupBy("path", "number").agg(at("anc").alias("call_at"), at("sym").alias("note_at"))
    return both.select("path", "number", F.coalesce("call_at", F.lit(-1)).alias("call_at"), F.coalesce("note_at", F.lit(-1)).alias("note_at"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text) of files of any known format, each one row; error says why a text is null.

    Formats go by suffix. Scanned PDF needs a reader that isn't here; its rows have an error, as have unknown formats.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    raw = raw.withColumn("format", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), F.nullif(suffix, F.lit(""))), F.lit("unknown")))
    decoded = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    none = F.lit(None).cast("string")
    plain = raw.where("format = 'text'").select("path", "format", decoded.alias("text"), none.alias("error"))
    marked = raw.where("format = 'markdown'").select("path", "format", markdown_text(decoded).alias("text"), none.alias("error"))
    html = files.html_texts(raw.where("format = 'html'").select(F.col("path").alias("page_id"), decoded.alias("html"))).select(F.col("page_id").alias("path"), F.lit("html").alias("format"), "text", none.alias("error"))
    books = epub_books(raw.where("format = 'epub'")).select("path", F.lit("epub").alias("format"), "text", "error")
    rest = raw.where("format IN ('pdf', 'unknown')").select("path", "format", none.alias("text"), F.concat(F.lit("no reader for "), "format").alias("error"))
    return plain.unionByName(marked).unionByName(html).unionByName(books).unionByName(rest)


def verses(lines: DataFrame) -> DataFrame:
    """(file, verse, text): lines (file, line_no, line) like '40:001:001 text' begin a verse, others go on with it; what comes before the first is left out."""
    from pyspark.sql import Window as W

    begin = F.col("line").rlike(r"^\d+:\d+:\d+\s")
    along = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("n", F.sum(F.coalesce(begin.cast("int"), F.lit(0))).over(along)).where("n > 0")
    body = F.trim(F.when(begin, F.regexp_replace("line", r"^\d+:\d+:\d+\s+", "")).otherwise(F.col("line")))
    per = rows.groupBy("file", "n").agg(F.max(F.when(begin, F.regexp_extract("line", r"^(\d+:\d+:\d+)", 1))).alias("verse"), F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))).alias("t"))
    return per.select("file", "verse", F.trim(F.array_join(F.filter(F.transform("t", lambda x: x["t"]), lambda t: t != ""), " ")).alias("text"))
