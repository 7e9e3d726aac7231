"""Annotations in exchange formats, and the rules that they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Evidence levels.
LEVELS = ["E1", "E2", "E3", "E4", "E5"]
PAF = ["annotation_id", "track", "lfo_type", "start", "end", "confidence", "evidence_level", "creator", "value", "attributes"]


def attributes(extra: Column) -> Column:
    """k=v pairs in key order, joined by ';'; '.' for none."""
    pairs = F.array_sort(F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return F.when(F.size(extra) > 0, F.array_join(pairs, ";")).otherwise(".")


def paf(rows: DataFrame) -> DataFrame:
    """The ten columns of a tabular line per annotation, as strings; '.' stands for nothing, values are cut to 200 characters."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return rows.select(
        text("ann_id").alias("annotation_id"), text("track").alias("track"), text("lfo_type").alias("lfo_type"), text("start_pos").alias("start"), text("end_pos").alias("end"), text("confidence").alias("confidence"),
        text("evidence_level").alias("evidence_level"), text("creator").alias("creator"), F.coalesce(F.nullif(F.substring("body_value", 1, 200), F.lit("")), F.lit(".")).alias("value"), attributes(F.col("extra")).alias("attributes"),
    )


def write_paf(rows: DataFrame, path: str) -> None:
    """Tab-separated files, a folder per track; large tracks are spread over many files in order of start."""
    lines = paf(rows).withColumn("place", F.try_to_number("start", F.lit("999999999999999999")).cast("bigint"))
    lines = lines.repartitionByRange(F.col("track"), F.col("place")).sortWithinPartitions("track", "place").withColumn("folder", F.col("track"))
    lines.drop("place").write.partitionBy("folder").mode("overwrite").csv(path, sep="\t", quote="", header=False)


def paf_errors(lines: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(line_no, error) of tabular lines (line_no, line): comments and blank lines have none; a line may have several."""
    c = F.split("line", "\t", -1)
    col = lambda i: F.get(c, F.lit(i))
    start, end, confidence = col(3).try_cast("bigint"), col(4).try_cast("bigint"), col(5).try_cast("double")
    ten = F.size(c) == 10
    rules = [
        (~ten, "expected 10 columns"), (ten & ~col(2).isin(terms) if terms else F.lit(False), "unknown term"), (ten & (start.isNull() | end.isNull()), "offsets are no integers"),
        (ten & ((start < 0) | (end < 0)), "negative offset"), (ten & (start >= 0) & (end >= 0) & (start >= end), "start not before end"), (ten & confidence.isNull(), "confidence is no number"),
        (ten & ((confidence < 0) | (confidence > 1)), "confidence out of range"), (ten & ~col(6).isin(LEVELS), "unknown evidence level"),
    ]
    kept = lines.where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return kept.select("line_no", F.explode(F.filter(F.array(*(F.when(rule, F.lit(text)) for rule, text in rules)), lambda e: e.isNotNull())).alias("error"))


def csv_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations with a column for each key of ``extra`` that is named; empty strings where there is nothing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.regexp_replace("body_type", "^[^:]*:", "")
    return rows.select(
        text("ann_id").alias("id"), text("track").alias("track"), F.coalesce(kind, F.lit("")).alias("type"), text("start_pos").alias("start"), text("end_pos").alias("end"), text("confidence").alias("confidence"), text("evidence_level").alias("evidence_level"),
        text("creator").alias("creator"), F.coalesce(F.substring("body_value", 1, 200), F.lit("")).alias("value"), *(F.coalesce(F.try_element_at("extra", F.lit(k)), F.lit("")).alias(f"extra_{k}") for k in keys),
    )


def extra_keys(rows: DataFrame) -> list[str]:
    """The keys that ``extra`` has anywhere, sorted: they become columns, so they must be few."""
    return [r["k"] for r in rows.select(F.explode(F.map_keys("extra")).alias("k")).distinct().orderBy("k").collect()]


def web_annotations(rows: DataFrame) -> DataFrame:
    """(ann_id, json): each annotation as a linked-data object."""
    selector = F.struct(F.lit("TextPositionSelector").alias("type"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    body = F.struct(F.col("body_type").alias("type"), F.col("body_value").alias("value"), F.col("purpose").alias("purpose"))
    target = F.struct(F.col("urn").alias("source"), selector.alias("selector"))
    whole = F.struct(F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), F.concat(F.lit("urn:annotation:"), F.col("ann_id").cast("string")).alias("id"), F.lit("Annotation").alias("type"), body.alias("body"), target.alias("target"), "creator", "confidence", F.col("evidence_level").alias("evidenceLevel"))
    return rows.select("ann_id", F.to_json(whole).alias("json"))


def write_collection(rows: DataFrame, path: str) -> None:
    """Linked-data objects as JSON lines, and beside them, in ``collection``, the head with how many they are."""
    web_annotations(rows).select("json").write.mode("overwrite").text(f"{path}/items")
    head = rows.agg(F.to_json(F.struct(F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), F.lit("AnnotationCollection").alias("type"), F.count(F.lit(1)).alias("total"))).alias("json"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/collection")


#: A linked-data object as it may come: bounds and confidence as they stand.
_LOOSE = "struct<`@context`:string,id:string,type:string,body:string,target:string,creator:string,confidence:string,evidenceLevel:string>"


def annotation_errors(objects: DataFrame) -> DataFrame:
    """(id, error) of linked-data objects (id, json): every rule that one breaks."""
    o = F.from_json("json", _LOOSE)
    get = lambda path: F.get_json_object("json", path)
    start, end, confidence = get("$.target.selector.start"), get("$.target.selector.end"), get("$.confidence")
    place = get("$.target.selector.type") == "TextPositionSelector"
    whole = start.rlike(r"^-?\d+$") & end.rlike(r"^-?\d+$")
    a, b, c = start.try_cast("bigint"), end.try_cast("bigint"), confidence.try_cast("double")
    missing = lambda x: x.isNull()
    context, body, target = o["@context"], get("$.body"), get("$.target")
    rules = [
        (missing(o), "no object"), (missing(context), "missing context"), (context != "http://www.w3.org/ns/anno.jsonld", "unknown context"), (missing(get("$.id")), "missing id"), (F.coalesce(get("$.type"), F.lit("")) != "Annotation", "type is not Annotation"),
        (missing(body), "missing body"), (~body.startswith("{"), "body is no object"), (body.startswith("{") & missing(get("$.body.type")), "body without type"), (missing(target), "missing target"), (~target.startswith("{"), "target is no object"),
        (target.startswith("{") & missing(get("$.target.source")), "target without source"), (target.startswith("{") & missing(get("$.target.selector")), "target without selector"), (place & start.isNotNull() & end.isNotNull() & ~whole, "bounds are no integers"),
        (place & whole & (a > b), "start after end"), (place & whole & (a <= b) & (a < 0), "negative start"), (missing(get("$.creator")), "missing creator"), (missing(get("$.evidenceLevel")), "missing evidence level"), (~get("$.evidenceLevel").isin(LEVELS), "unknown evidence level"),
        (missing(confidence), "missing confidence"), (confidence.isNotNull() & c.isNull(), "confidence is no number"), ((c < 0) | (c > 1), "confidence out of range"),
    ]
    return objects.select("id", F.explode(F.filter(F.array(*(F.when(rule, F.lit(text)) for rule, text in rules)), lambda e: e.isNotNull())).alias("error"))
