"""Cutting texts into paragraphs, sections, word chunks and windows, with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Found = Callable[[str], Iterable[tuple[int, int, str]]]
_PARAGRAPH = re.compile(r"[^\n]+(?:\n(?!\n)[^\n]*)*")
_HEADING = re.compile(r"(?:(?i:chapter)\s+[\divxlc]+\.?|[A-Z][A-Z ]{5,}|[IVXLC]+\.\s)", re.ASCII)
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
_BLANK = " \t\n\r\f\v"


def located(docs: DataFrame, found: Found) -> DataFrame:
    """(doc_id, idx, start, end, text): what ``found`` gives of each text, numbered from 0.

    One Arrow pass over (doc_id, text), linear in the text; nothing is shuffled. Null texts give no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, i, *hit) for doc, text in zip(frame["doc_id"], frame["text"], strict=True) for i, hit in enumerate(found(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "start", "end", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, idx long, start long, end long, text string")


def _trimmed(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    part = text[start:end]
    body = part.strip(_BLANK)
    start += len(part) - len(part.lstrip(_BLANK))
    return (start, start + len(body), body) if body else None


def literal_hits(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, start): every place, overlapping ones too, where ``needle`` stands."""

    def find(text: str) -> Iterator[tuple[int, int, str]]:
        at = text.find(needle)
        while at >= 0:
            yield at, at + len(needle), needle
            at = text.find(needle, at + 1)

    return located(docs, find).select("doc_id", "start")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Blocks between two or more line ends, with exact offsets; the text is without white space at its ends."""
    return located(docs, lambda text: [(m.start(), m.end(), m.group().strip()) for m in _PARAGRAPH.finditer(text) if m.group().strip()])


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    for line in text.split("\n"):
        if line:
            yield at, at + len(line), line
        at += len(line) + 1


def lines(docs: DataFrame) -> DataFrame:
    """The lines that aren't empty."""
    return located(docs, _lines)


def headings(docs: DataFrame) -> DataFrame:
    """Lines that begin a section: Chapter N, six or more capitals and blanks, or a roman number with a full stop."""
    return located(docs, lambda text: [(a, b, line.strip()) for a, b, line in _lines(text) if _HEADING.match(line + "\n")])


def sentences(docs: DataFrame) -> DataFrame:
    """Sentences by their closing marks, without white space at their ends."""
    return located(docs, lambda text: [hit for m in _SENTENCE.finditer(text) if (hit := _trimmed(text, m.start(), m.end()))])


def word_chunks(docs: DataFrame, size: int = 50, least: int = 5) -> DataFrame:
    """(doc_id, idx, n_words, chunk): consecutive chunks of ``size`` words; a rest under ``least`` words is dropped."""
    all_words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    rows = docs.where("text IS NOT NULL").select("doc_id", all_words.alias("w")).where(F.size("w") > 0)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda i: F.slice("w", i * size + 1, F.lit(size)))
    each = rows.select("doc_id", F.posexplode(chunks).alias("idx", "c")).where(F.size("c") >= least)
    return each.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.size("c").cast("bigint").alias("n_words"), F.array_join("c", " ").alias("chunk"))


def windows(size: int, overlap: int, n: Column) -> Column:
    """The first indices of windows over n items: steps of size - overlap; one window if all items fit."""
    step = max(1, size - overlap)
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
