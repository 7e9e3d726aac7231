"""Queries over annotation spans: filters, overlap and as-of joins, histograms, exports, people."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import intervals as I
from lexiloom.operators import segments as S
from lexiloom.plans import sql as Q
from lexiloom.session import read_table

BIG = "bigint"


def _spans(spark, d):
    """Each annotation once, with usable bounds."""
    rows = read_table(spark, d, "annotations").where("start_pos < end_pos").withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
    return rows.dropDuplicates(["ann_id"])


def viewport(spark, d):
    """Spans of visible tracks and enough confidence that overlap a range of each text."""
    rows = _spans(spark, d).where(T.overlaps(F.col("start"), F.col("end"), 100, 400) & F.col("track").isin("dialogue", "lexical", "sentiment"))
    return rows.where(F.floor(F.coalesce("confidence", F.lit(0.85)) * 10000) >= 7000).select("ann_id", "doc_id", "track", "start", "end")


def track_counts(spark, d):
    return _spans(spark, d).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("start").alias("first"), F.max("end").alias("last"))


def track_type_rollup(spark, d):
    return _spans(spark, d).rollup("track", "body_type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast(BIG).alias("level"))


def confidence_thresholds(spark, d):
    """Visible spans per track, each track with its own least confidence, 0 where none is set; a missing confidence counts as 1."""
    least = spark.createDataFrame([("dialogue", 0.8), ("lexical", 0.5), ("topics", 0.9), ("sentiment", 0.6)], "track string, least double")
    return _spans(spark, d).join(F.broadcast(least), "track", "left").where(F.coalesce("confidence", F.lit(1.0)) >= F.coalesce("least", F.lit(0.0))).groupBy("track").agg(F.count(F.lit(1)).alias("n"))


def density_bins(spark, d):
    """Spans of each track that touch each of 20 bins of their text."""
    docs = read_table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.length("text").cast(BIG).alias("len"))
    return I.density(_spans(spark, d).join(docs, "doc_id"), ["track"], F.col("len"), 20)


def density_normalised(spark, d):
    return density_bins(spark, d).select("track", "bin", F.round(F.col("n") / F.max("n").over(W.partitionBy("track")), 4).alias("height"))


def flattened(spark, d):
    """How much text is covered by how many spans of a document at once."""
    flat = I.flatten(_spans(spark, d), "doc_id", "ann_id")
    return flat.groupBy("doc_id", "active").agg(F.sum(F.col("end") - F.col("start")).cast(BIG).alias("chars")).select("doc_id", F.col("active").cast(BIG).alias("active"), "chars")


def _paragraphs(spark, d):
    return S.paragraphs(read_table(spark, d, "documents")).select("doc_id", "idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def spans_per_paragraph(spark, d):
    """Spans of each track that overlap each paragraph."""
    pairs = I.interval_join(_spans(spark, d).select("ann_id", "doc_id", "track", "start", "end"), _paragraphs(spark, d), ["doc_id"])
    return pairs.groupBy("doc_id", "idx", "track").agg(F.count(F.lit(1)).alias("n"))


def paragraph_of_span(spark, d):
    """The last paragraph that starts at or before each span."""
    points = _spans(spark, d).select("ann_id", "doc_id", "start")
    return I.asof_join(points, _paragraphs(spark, d), ["doc_id"], "start", "r_start", "idx").select("ann_id", "doc_id", F.coalesce("idx", F.lit(-1)).cast(BIG).alias("idx"))


def entity_paragraphs(spark, d):
    """The paragraph that holds each entity's start, -1 in gaps."""
    ents = read_table(spark, d, "entities").where("start_pos < end_pos").dropDuplicates(["entity_id"]).select("entity_id", "doc_id", "start_pos")
    paras = S.paragraphs(read_table(spark, d, "documents")).select("doc_id", "idx", "start", "end")
    marked = I.asof_join(ents, paras.select("doc_id", "start", F.struct("idx", "end").alias("p")), ["doc_id"], "start_pos", "start", "p")
    return marked.select("entity_id", F.when(F.col("start_pos") < F.col("p.end"), F.col("p.idx")).otherwise(F.lit(-1)).cast(BIG).alias("idx"))


def annotation_ids(spark, d):
    """Deterministic ids from what an annotation is and where."""
    parts = F.concat_ws(":", "project_id", "track", "body_type", F.col("start").cast("string"), F.col("end").cast("string"))
    return _spans(spark, d).select("ann_id", F.substring(F.sha2(parts, 256), 1, 12).alias("short_id"))


def tabular_rows(spark, d):
    """One line per annotation: bounds, track, and what else there is as k=v pairs in key order."""
    pairs = F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.substring(e["value"], 1, 200), F.lit("")))))
    attributes = F.when(F.size("extra") > 0, F.array_join(pairs, ";")).otherwise(F.lit("."))
    return _spans(spark, d).select("ann_id", F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("track", F.lit(".")), attributes).alias("line"))


def rule_violations(spark, d):
    """Annotations that break a rule, by rule."""
    rows = read_table(spark, d, "annotations")
    rules = {"no bounds": F.col("start_pos").isNull() | F.col("end_pos").isNull(), "empty span": F.col("start_pos") >= F.col("end_pos"), "confidence out of range": (F.col("confidence") < 0) | (F.col("confidence") > 1), "no evidence level": F.col("evidence_level").isNull(), "no creator": F.col("creator").isNull()}
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return rows.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def sentiment_spread(spark, d):
    """Mean and population deviation of confidence per track and document with more than one span."""
    rows = _spans(spark, d).groupBy("doc_id", "track").agg(F.count("confidence").alias("n"), F.round(F.avg("confidence"), 9).alias("mean"), F.round(F.stddev_pop("confidence"), 9).alias("spread"))
    return rows.where("n > 1")


def character_index(spark, d):
    """Per project and name: mentions, documents, first and last place."""
    both = read_table(spark, d, "entities").dropDuplicates(["entity_id"]).where("entity_type IN ('PER', 'PERSON')").select("project_id", F.col("body_value").alias("name"), "doc_id", "start_pos")
    both = both.unionByName(read_table(spark, d, "coreference").dropDuplicates(["mention_id"]).select("project_id", F.col("referent_id").alias("name"), "doc_id", "start_pos"))
    return both.where("name IS NOT NULL").groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def cooccurrence(spark, d):
    """Names of one project in how many documents together: the 20 most mentioned names of each project."""
    named = read_table(spark, d, "entities").where("body_value IS NOT NULL AND entity_type IN ('PER', 'PERSON')").select("project_id", "doc_id", F.col("body_value").alias("name"))
    top = named.groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("n"), "name"))).where("r <= 20").select("project_id", "name")
    inside = named.join(top, ["project_id", "name"]).distinct()
    a, b = inside.alias("a"), inside.alias("b")
    pairs = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.name") < F.col("b.name")))
    return pairs.groupBy(F.col("a.project_id").alias("project_id"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).agg(F.count(F.lit(1)).alias("shared_docs"))


def endnote_match(spark, d):
    """Quotations and annotations of a document on the same creator: a full outer match by document."""
    q = read_table(spark, d, "quote_selectors").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("quote_id").alias("q"))
    e = read_table(spark, d, "entities").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("entity_id").alias("e"))
    return q.join(e, "doc_id", "full_outer").select("doc_id", F.coalesce("q", F.lit(-1)).cast(BIG).alias("quotes"), F.coalesce("e", F.lit(-1)).cast(BIG).alias("entities"))


def pending_documents(spark, d):
    """Documents without any annotation."""
    return read_table(spark, d, "documents").select("doc_id").join(read_table(spark, d, "annotations").select("doc_id"), "doc_id", "left_anti")


def latest_first_spans(spark, d):
    """The five first spans of each track, by position."""
    nth = F.row_number().over(W.partitionBy("track").orderBy("start", "doc_id", "ann_id"))
    return _spans(spark, d).withColumn("nth", nth.cast(BIG)).where("nth <= 5").select("track", "nth", "ann_id", "start", "end")


_S = """WITH span AS (SELECT * FROM (SELECT DISTINCT ann_id, doc_id, project_id, track, body_type, start_pos AS start, end_pos AS "end", confidence FROM annotations WHERE start_pos < end_pos))"""
_P = ", " + Q.PARA.replace("para AS (SELECT", 'para AS (SELECT doc_id, idx, text, start AS p_start, "end" AS p_end FROM (SELECT') + ")"
_D = """, d AS (SELECT doc_id, length(text) AS len FROM documents WHERE length(text) > 0), b AS (SELECT track, start, "end", greatest(1, len // 20) AS w FROM span JOIN d USING (doc_id)),
e AS (SELECT track, unnest(range(least(19, greatest(0, start // w)), least(19, greatest(0, ("end" - 1) // w)) + 1)) AS bin FROM b), c AS (SELECT track, bin, count(*) AS n FROM e GROUP BY ALL), n AS (SELECT track, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT track FROM c) CROSS JOIN range(20) r(bin) LEFT JOIN c USING (track, bin))"""

QUERIES = {q.__name__: q for q in (viewport, track_counts, track_type_rollup, confidence_thresholds, density_bins, density_normalised, flattened, spans_per_paragraph, paragraph_of_span, entity_paragraphs, annotation_ids, tabular_rows, rule_violations, sentiment_spread, character_index, cooccurrence, endnote_match, pending_documents, latest_first_spans)}
SQL = {
    "viewport": _S + """SELECT ann_id, doc_id, track, start, "end" FROM span WHERE start < 400 AND "end" > 100 AND track IN ('dialogue', 'lexical', 'sentiment') AND floor(coalesce(confidence, 0.85::DOUBLE) * 10000) >= 7000""",
    "track_counts": _S + 'SELECT track, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(start) AS first, max("end") AS last FROM span GROUP BY track',
    "track_type_rollup": _S + "SELECT track, body_type, count(*) AS n, CAST(grouping(track) * 2 + grouping(body_type) AS BIGINT) AS level FROM span GROUP BY ROLLUP (track, body_type)",
    "confidence_thresholds": _S + "SELECT track, count(*) AS n FROM span LEFT JOIN (VALUES ('dialogue', 0.8::DOUBLE), ('lexical', 0.5), ('topics', 0.9), ('sentiment', 0.6)) t(track, least) USING (track) WHERE coalesce(confidence, 1.0) >= coalesce(least, 0) GROUP BY track",
    "density_bins": _S + _D + "SELECT * FROM n",
    "density_normalised": _S + _D + "SELECT track, bin, round(n / CAST(max(n) OVER (PARTITION BY track) AS DOUBLE), 4) AS height FROM n",
    "flattened": _S + """, e AS (SELECT doc_id, start AS pos, 1 AS d FROM span UNION ALL SELECT doc_id, "end", -1 FROM span), g AS (SELECT doc_id, pos, sum(d) AS d FROM e GROUP BY ALL),
        r AS (SELECT doc_id, pos, sum(d) OVER (PARTITION BY doc_id ORDER BY pos) AS active, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS "end" FROM g)
        SELECT doc_id, CAST(active AS BIGINT) AS active, CAST(sum("end" - pos) AS BIGINT) AS chars FROM r WHERE active > 0 AND "end" IS NOT NULL GROUP BY ALL""",
    "spans_per_paragraph": _S + _P + 'SELECT doc_id, idx, track, count(*) AS n FROM span JOIN para USING (doc_id) WHERE start < p_end AND "end" > p_start GROUP BY ALL',
    "paragraph_of_span": _S + _P + "SELECT ann_id, span.doc_id, coalesce(idx, -1) AS idx FROM span ASOF LEFT JOIN para ON span.doc_id = para.doc_id AND span.start >= para.p_start",
    "entity_paragraphs": "WITH x AS (SELECT DISTINCT entity_id, doc_id, start_pos FROM entities WHERE start_pos < end_pos)" + _P + "SELECT entity_id, coalesce(idx, -1) AS idx FROM x LEFT JOIN para ON x.doc_id = para.doc_id AND start_pos >= p_start AND start_pos < p_end",
    "annotation_ids": _S + """SELECT ann_id, left(sha256(concat_ws(':', project_id, track, body_type, start, "end")), 12) AS short_id FROM span""",
    "tabular_rows": """WITH x AS (SELECT DISTINCT ann_id, doc_id, start_pos, end_pos, track, list_sort(list_transform(map_entries(extra), lambda e: e.key || '=' || coalesce(left(e.value, 200), ''))) AS a FROM annotations WHERE start_pos < end_pos)
        SELECT ann_id, concat_ws(chr(9), doc_id, start_pos, end_pos, coalesce(track, '.'), CASE WHEN len(a) > 0 THEN array_to_string(a, ';') ELSE '.' END) AS line FROM x""",
    "rule_violations": """SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN start_pos IS NULL OR end_pos IS NULL THEN 'no bounds' END, CASE WHEN start_pos >= end_pos THEN 'empty span' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END,
        CASE WHEN evidence_level IS NULL THEN 'no evidence level' END, CASE WHEN creator IS NULL THEN 'no creator' END]) AS rule FROM annotations) WHERE rule IS NOT NULL GROUP BY rule""",
    "sentiment_spread": _S + "SELECT doc_id, track, count(confidence) AS n, round(avg(confidence), 9) AS mean, round(stddev_pop(confidence), 9) AS spread FROM span GROUP BY ALL HAVING count(confidence) > 1",
    "character_index": """WITH b AS (SELECT project_id, body_value AS name, doc_id FROM (SELECT DISTINCT * FROM entities) WHERE entity_type IN ('PER', 'PERSON') UNION ALL SELECT project_id, referent_id, doc_id FROM (SELECT DISTINCT * FROM coreference))
        SELECT project_id, name, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM b WHERE name IS NOT NULL GROUP BY ALL""",
    "cooccurrence": """WITH n AS (SELECT project_id, doc_id, body_value AS name FROM entities WHERE body_value IS NOT NULL AND entity_type IN ('PER', 'PERSON')), c AS (SELECT project_id, name, count(*) AS n FROM n GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, name) AS r FROM c), i AS (SELECT DISTINCT n.* FROM n JOIN r USING (project_id, name) WHERE r.r <= 20)
        SELECT a.project_id, a.name AS name_a, b.name AS name_b, count(*) AS shared_docs FROM i a JOIN i b ON a.project_id = b.project_id AND a.doc_id = b.doc_id AND a.name < b.name GROUP BY ALL""",
    "endnote_match": """SELECT doc_id, coalesce(q, -1) AS quotes, coalesce(e, -1) AS entities FROM (SELECT doc_id, count(DISTINCT quote_id) AS q FROM quote_selectors WHERE doc_id IS NOT NULL GROUP BY doc_id)
        FULL JOIN (SELECT doc_id, count(DISTINCT entity_id) AS e FROM entities WHERE doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id)""",
    "pending_documents": "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.doc_id = documents.doc_id)",
    "latest_first_spans": _S + 'SELECT track, nth, ann_id, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, doc_id, ann_id) AS nth FROM span) WHERE nth <= 5',
}
