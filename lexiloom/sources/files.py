"""Reading and writing texts, annotations and markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "id string, body struct<type:string,value:string>, target struct<source:string,selector:struct<type:string,start:bigint,end:bigint>>, confidence double, evidenceLevel string, creator string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files, each one row; bytes that are no UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("text"))


def read_annotations(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Annotations of JSON lines with the track named after their file; bad lines fail if ``strict``, else they are left out."""
    rows = spark.read.schema(ANNOTATION).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    track = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return rows.select("id", track.alias("track"), F.col("target.selector.start").alias("start"), F.col("target.selector.end").alias("end"), F.col("body.value").alias("value"), F.coalesce("confidence", F.lit(0.85)).alias("confidence"), F.coalesce("evidenceLevel", F.lit("E5")).alias("evidence_level"), "creator")


def write_annotations(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder per track, sorted by start."""
    rows.repartition("track").sortWithinPartitions("track", "start").write.partitionBy("track").mode("overwrite").json(path)


class _Blocks(HTMLParser):
    _BREAKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "tr", "section", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self._BREAKS:
            self.out.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self._BREAKS:
            self.out.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.out[-1] += data


def html_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of (page_id, html): the text of blocks, an empty line between them; scripts and styles left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for html in frame["html"]:
                if html is None:
                    texts.append(None)
                    continue
                parser = _Blocks()
                parser.feed(html)
                parser.close()
                texts.append("\n\n".join(" ".join(b.split()) for b in parser.out if b.strip()))
            yield pd.DataFrame({"page_id": frame["page_id"], "text": texts})

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")
