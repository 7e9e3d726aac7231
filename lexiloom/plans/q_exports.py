"""Queries over exchange formats, rules, status and streams of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom import tracks
from lexiloom.plans.q_signals import _events
from lexiloom.session import read_table
from lexiloom.sources import exports

BIG = "bigint"


def _rows(spark, d):
    return read_table(spark, d, "annotations").dropDuplicates(["ann_id"])


def paf_lines(spark, d):
    """Annotations in ten columns; numbers of confidence are left to paf_errors."""
    return exports.paf(_rows(spark, d)).drop("confidence")


def paf_errors(spark, d):
    """How often each rule of the tabular format is broken."""
    lines = exports.paf(_rows(spark, d)).select(F.monotonically_increasing_id().alias("line_no"), F.array_join(F.array(*exports.PAF), "\t").alias("line"))
    return exports.paf_errors(lines).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def csv_rows(spark, d):
    """Annotations with a column for each key of what else they say."""
    rows = _rows(spark, d)
    return exports.csv_rows(rows, exports.extra_keys(rows)).drop("confidence")


def annotation_errors(spark, d):
    """How often each rule of linked-data annotations is broken."""
    objects = exports.web_annotations(_rows(spark, d)).withColumnRenamed("ann_id", "id")
    return exports.annotation_errors(objects).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def packed_size(spark, d):
    """Bytes that annotations take as packed spans and as bodies."""
    return _rows(spark, d).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 16).alias("span_bytes"), F.coalesce(F.sum(F.octet_length("body_value")), F.lit(0)).alias("body_bytes"))


def track_status(spark, d):
    """Which tracks of the registry each project has."""
    return tracks.default().status(spark, _rows(spark, d).where("project_id IS NOT NULL"), "project_id", "track", read_table(spark, d, "project_metadata"))


def sliding_windows(spark, d):
    """Events of windows of two hours, one hour apart, with how many users they have."""
    w = _events(spark, d).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return w.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "users")


_R = "WITH r AS (SELECT DISTINCT ann_id, doc_id, project_id, urn, track, body_type, purpose, body_value, lfo_type, start_pos, end_pos, confidence, evidence_level, creator, extra FROM annotations)"
_ATTR = "CASE WHEN cardinality(extra) > 0 THEN array_to_string(list_sort(list_transform(map_entries(extra), lambda e: e.key || '=' || coalesce(e.value, ''))), ';') ELSE '.' END"
QUERIES = {q.__name__: q for q in (paf_lines, paf_errors, csv_rows, annotation_errors, packed_size, track_status, sliding_windows)}
SQL = {
    "paf_lines": _R + f"""SELECT CAST(ann_id AS VARCHAR) AS annotation_id, coalesce(track, '.') AS track, coalesce(lfo_type, '.') AS lfo_type, coalesce(CAST(start_pos AS VARCHAR), '.') AS start, coalesce(CAST(end_pos AS VARCHAR), '.') AS "end",
        coalesce(evidence_level, '.') AS evidence_level, coalesce(creator, '.') AS creator, coalesce(nullif(left(body_value, 200), ''), '.') AS value, {_ATTR} AS attributes FROM r""",
    "paf_errors": _R + """, e AS (SELECT unnest([CASE WHEN start_pos IS NULL OR end_pos IS NULL THEN 'offsets are no integers' END, CASE WHEN start_pos < 0 OR end_pos < 0 THEN 'negative offset' END, CASE WHEN start_pos >= 0 AND end_pos >= 0 AND start_pos >= end_pos THEN 'start not before end' END,
        CASE WHEN confidence IS NULL THEN 'confidence is no number' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END, CASE WHEN coalesce(evidence_level, '.') NOT IN ('E1', 'E2', 'E3', 'E4', 'E5') THEN 'unknown evidence level' END]) AS error FROM r)
        SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY error""",
    "csv_rows": _R + """SELECT CAST(ann_id AS VARCHAR) AS id, coalesce(track, '') AS track, coalesce(regexp_replace(body_type, '^[^:]*:', ''), '') AS type, coalesce(CAST(start_pos AS VARCHAR), '') AS start, coalesce(CAST(end_pos AS VARCHAR), '') AS "end",
        coalesce(evidence_level, '') AS evidence_level, coalesce(creator, '') AS creator, coalesce(left(body_value, 200), '') AS value, coalesce(extra['model'], '') AS extra_model, coalesce(extra['score'], '') AS extra_score FROM r""",
    "annotation_errors": _R + """, e AS (SELECT unnest([CASE WHEN body_type IS NULL THEN 'body without type' END, CASE WHEN urn IS NULL THEN 'target without source' END, CASE WHEN start_pos > end_pos THEN 'start after end' END, CASE WHEN start_pos <= end_pos AND start_pos < 0 THEN 'negative start' END,
        CASE WHEN creator IS NULL THEN 'missing creator' END, CASE WHEN evidence_level IS NULL THEN 'missing evidence level' END, CASE WHEN evidence_level NOT IN ('E1', 'E2', 'E3', 'E4', 'E5') THEN 'unknown evidence level' END, CASE WHEN confidence IS NULL THEN 'missing confidence' END,
        CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END]) AS error FROM r) SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY error""",
    "packed_size": _R + "SELECT count(*) AS n, count(*) * 16 AS span_bytes, CAST(coalesce(sum(strlen(body_value)), 0) AS BIGINT) AS body_bytes FROM r",
    "track_status": _R + ", t(track) AS (VALUES " + ", ".join(f"('{n}')" for n in sorted(tracks.default().tracks)) + "), p AS (SELECT DISTINCT project_id FROM project_metadata), h AS (SELECT DISTINCT project_id, track FROM r) SELECT p.project_id, t.track, CASE WHEN h.track IS NULL THEN 'pending' ELSE 'computed' END AS status FROM p CROSS JOIN t LEFT JOIN h ON h.project_id = p.project_id AND h.track = t.track",
    "sliding_windows": "WITH w AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) SELECT CAST(epoch(s) AS BIGINT) AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM w GROUP BY ALL",
}
