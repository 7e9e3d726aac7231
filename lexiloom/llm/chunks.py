"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak; a cut goes to the end of the match.
_BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』”]*\s*"),
    re.compile(r"\n+"),
    re.compile(r"\s+"),
]


def _joined(ch: str) -> bool:
    """Whether a character belongs to the one before it: a mark of any script, a joiner, a variation selector."""
    return unicodedata.category(ch)[0] == "M" or ch == "\u200d"


def _cut(text: str, a: int, b: int, limit: int) -> int:
    """The strongest boundary of text[a:b] near its middle, within its middle half; else the nearest of any kind; else the middle itself."""
    middle, reach = (a + b) // 2, (b - a) // 4
    low, high = max(a + 1, middle - reach), min(b - 1, middle + reach)
    for kind in _BOUNDARIES:
        ends = [m.end() for m in kind.finditer(text, max(a, low - 2), min(b, high + 2)) if low <= m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - middle), e))
    ends = [m.end() for kind in _BOUNDARIES for m in kind.finditer(text, a, b) if a < m.end() < b]
    if ends:
        return min(ends, key=lambda e: (abs(e - middle), e))
    while middle < high and _joined(text[middle]):
        middle += 1
    return middle


def bisect(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` code points that cover the text in order, each but the first reaching back by about ``overlap``."""
    overlap = max(0, min(overlap, limit - 1, limit // 2))
    core = limit - overlap
    cuts, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= core or (a == 0 and b - a <= limit and b < len(text)):
            cuts.append((a, b))
        else:
            middle = _cut(text, a, b, core)
            todo += [(middle, b), (a, middle)]
    pieces = []
    for a, b in cuts:
        start = max(0, a - overlap) if a else 0
        if a and overlap:  # begin the overlap with a word, if one begins in its first half
            word = re.compile(r"\s+").search(text, max(0, start - 1), start + overlap // 2)
            start = word.end() if word and word.end() < a else start
        pieces.append((start, b))
    return pieces


def split_oversized(items: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """(key, piece_no, n_pieces, piece_start, piece_end, piece): every text in pieces of at most its row's limit.

    Method: recursive bisection at the strongest boundary (paragraph, sentence, line, word) near the midpoint,
    until a half fits into limit minus overlap; then each piece but the first is given the end of its
    predecessor. A text without boundaries is cut at midpoints, never before a combining mark. Whatever fits
    never leaves the JVM. Rows are independent of each other, so this is one pass without a shuffle.

    A null text gives no piece; an empty one gives one empty piece. A null limit or one under 1 sets no limit;
    a null or negative overlap is none, one over half the limit is half the limit. Repeated rows give their
    pieces again; other columns are ignored.
    """
    kind = items.schema[key].dataType.simpleString()
    named = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{limit}`").cast("long").alias("limit"), F.coalesce(F.col(f"`{overlap}`"), F.lit(0)).cast("long").alias("overlap"))
    named = named.where(F.col("text").isNotNull())
    large = F.coalesce((F.col("limit") >= 1) & (F.length("text") > F.col("limit")), F.lit(False))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    whole = named.where(~large).select("key", zero.alias("piece_no"), one.alias("n_pieces"), zero.alias("piece_start"), F.length("text").cast("bigint").alias("piece_end"), F.col("text").alias("piece"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, body, most, again in zip(frame["key"], frame["text"], frame["limit"], frame["overlap"], strict=True):
                pieces = bisect(body, int(most), int(again))
                rows += [(item, i, len(pieces), a, b, body[a:b]) for i, (a, b) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["key", "piece_no", "n_pieces", "piece_start", "piece_end", "piece"])

    pieces = named.where(large).mapInPandas(cut, f"key {kind}, piece_no long, n_pieces long, piece_start long, piece_end long, piece string")
    return whole.unionByName(pieces).withColumnRenamed("key", key)
