"""Continuous periods and gaps of the annotation spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.periods import continuous_periods
from lexiloom.session import read_table


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous_periods(read_table(spark, sf_dir, "annotations"), ["doc_id", "track"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir).select("doc_id", "track", "kind", "start_pos", "end_pos")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered length per document and track."""
    length = F.col("end_pos") - F.col("start_pos")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, length)), F.lit(0)).cast("bigint")
    periods = F.sum((F.col("kind") == "period").cast("bigint"))
    return _periods(spark, sf_dir).groupBy("doc_id", "track").agg(periods.alias("n_periods"), of("period").alias("covered"), of("gap").alias("uncovered"))


_MERGED = """
WITH spans AS (SELECT doc_id, track, start_pos AS s, end_pos AS e FROM annotations WHERE start_pos < end_pos),
reach AS (SELECT *, max(e) OVER (PARTITION BY doc_id, track ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM spans),
island AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, track ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM reach),
period AS (SELECT doc_id, track, g, min(s) AS s, max(e) AS e FROM island GROUP BY doc_id, track, g),
beside AS (SELECT doc_id, track, e AS s, lead(s) OVER (PARTITION BY doc_id, track ORDER BY s) AS e FROM period),
rows_ AS (SELECT doc_id, track, 'period' AS kind, s AS start_pos, e AS end_pos FROM period
          UNION ALL SELECT doc_id, track, 'gap', s, e FROM beside WHERE e IS NOT NULL)
"""

QUERIES = {"p4_found": found, "p4_coverage": coverage}
SQL = {
    "p4_found": _MERGED + "SELECT doc_id, track, kind, start_pos, end_pos FROM rows_",
    "p4_coverage": _MERGED
    + """SELECT doc_id, track, CAST(sum(CASE WHEN kind = 'period' THEN 1 ELSE 0 END) AS BIGINT) AS n_periods,
        CAST(coalesce(sum(CASE WHEN kind = 'period' THEN end_pos - start_pos END), 0) AS BIGINT) AS covered,
        CAST(coalesce(sum(CASE WHEN kind = 'gap' THEN end_pos - start_pos END), 0) AS BIGINT) AS uncovered
        FROM rows_ GROUP BY doc_id, track""",
}
