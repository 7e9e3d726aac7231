"""Queries over vectors, sequences and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import alignment, vectors
from lexiloom.operators import segments as S
from lexiloom.session import read_table
from lexiloom.streaming import events

BIG = "bigint"


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))


def cosine_threshold(spark, d):
    return vectors.similar_pairs(_vectors(spark, d), 0.3).select("i", "j", F.round("cosine", 4).alias("cosine"))


def binary_jaccard(spark, d):
    """Jaccard of the positive coordinates, of every 50th vector with all others, at least 0.45."""
    return vectors.binary_jaccard(_vectors(spark, d), "i % 50 = 0", 0.45).select("q", "i", F.round("jaccard", 4).alias("jaccard"))


def recurrence_windows(spark, d):
    measured = vectors.recurrence(_vectors(spark, d), 50, 0.8)
    return measured.select("window", "n", *(F.round(c, 4).alias(c) for c in ("recurrence_rate", "determinism", "laminarity")))


def label_means(spark, d):
    """Mean of each coordinate per label."""
    each = read_table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("label", F.col("pos").cast(BIG).alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def gumbel_pvalues(spark, d):
    """p-values of document lengths under a Gumbel distribution fitted by moments."""
    n = read_table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.length("text").cast("double").alias("x"))
    fit = n.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    beta = F.col("sd") * F.sqrt(F.lit(6.0)) / F.pi()
    z = (F.col("x") - (F.col("mean") - 0.5772 * beta)) / beta
    p = F.when(beta <= 0, 1.0).otherwise(1 - F.exp(-F.exp(-F.greatest(z, F.lit(-700.0)))))
    return n.join(F.broadcast(fit)).select("doc_id", F.round(p, 6).alias("p"))


def _with_project(rows, per):
    """Rows with the one row of their project; a hot project is spread by the join, not by a window over it."""
    return rows.join(per.withColumnRenamed("project_id", "__p"), F.col("project_id").eqNullSafe(F.col("__p"))).drop("__p")


def z_scores(spark, d):
    """Lengths of a project's documents in deviations from its mean."""
    n = read_table(spark, d, "documents").where("length(text) > 0").select("doc_id", "project_id", F.length("text").alias("x"))
    per = n.groupBy("project_id").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return _with_project(n, per).select("doc_id", F.round((F.col("x") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 5).alias("z"))


def uniform_alphabet(spark, d):
    """A letter A to P for each document by its place between the shortest and longest of its project."""
    n = read_table(spark, d, "documents").where("length(text) > 0").select("doc_id", "project_id", F.length("text").alias("x"))
    n = _with_project(n, n.groupBy("project_id").agg(F.min("x").alias("low"), F.max("x").alias("high")))
    low, high = F.col("low"), F.col("high")
    place = (F.col("x") - low) / F.when(high > low, high - low).otherwise(1)
    return n.select("doc_id", F.char(65 + F.least(F.floor(place * 16), F.lit(15))).alias("letter"))


def word_alignments(spark, d):
    """Local word alignments of chunks with the chunk after them in the same source."""
    chunk = read_table(spark, d, "text_cleaner").where("length(text) > 0").dropDuplicates(["chunk_id"])
    after = F.lead(F.struct("chunk_id", "text")).over(W.partitionBy("source_path").orderBy("chunk_index", "chunk_id"))
    pairs = chunk.select(F.col("chunk_id").alias("id_a"), "text", after.alias("n")).where("n IS NOT NULL")
    return alignment.align_words(pairs.select("id_a", F.col("n.chunk_id").alias("id_b"), T.words(F.col("text")).alias("a"), T.words(F.col("n.text")).alias("b")))


def edition_changes(spark, d):
    """Paragraph changes between a document and the next chapter of its project with the same title."""
    per = S.paragraphs(read_table(spark, d, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"]).alias("p"))
    docs = read_table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", "project_id", "title").join(per, "doc_id")
    after = F.lead("p").over(W.partitionBy("project_id", "title").orderBy("doc_id"))
    pairs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("p").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return alignment.edition_changes(pairs)


def _events(spark, d):
    return read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark, d):
    return events.tumbling(_events(spark, d)).select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def event_sessions(spark, d):
    """Events of a user with gaps under an hour: how many, from first to last."""
    grouped = _events(spark, d).groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"))
    return grouped.select("user_id", "n", "first", "last")


def revenue_by_nation(spark, d):
    """A relational check: joins and an aggregation over the sales tables."""
    t = lambda n: read_table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


_LEN = "WITH n AS (SELECT doc_id, project_id, length(text) AS x FROM documents WHERE length(text) > 0)"
QUERIES = {q.__name__: q for q in (cosine_threshold, binary_jaccard, recurrence_windows, label_means, gumbel_pvalues, z_scores, uniform_alphabet, word_alignments, edition_changes, event_windows, event_sessions, revenue_by_nation)}
SQL = {
    "cosine_threshold": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.v, b.v), 4) AS cosine
        FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3""",
    "binary_jaccard": """WITH p AS (SELECT a.vec_id AS q, b.vec_id AS i, list_zip(a.embedding, b.embedding) AS z FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        j AS (SELECT q, i, round(len(list_filter(z, lambda x: x[1] > 0 AND x[2] > 0)) / CAST(len(list_filter(z, lambda x: x[1] > 0 OR x[2] > 0)) AS DOUBLE), 4) AS jaccard FROM p) SELECT * FROM j WHERE jaccard >= 0.45""",
    "label_means": "SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL",
    "gumbel_pvalues": _LEN + ", f AS (SELECT avg(x) AS mean, stddev_pop(x) * sqrt(6.0) / pi() AS beta FROM n) SELECT doc_id, round(1 - exp(-exp(-greatest((x - (mean - 0.5772::DOUBLE * beta)) / beta, -700))), 6) AS p FROM n, f",
    "z_scores": _LEN + "SELECT doc_id, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END, 5) AS z FROM n WINDOW w AS (PARTITION BY project_id)",
    "uniform_alphabet": _LEN + "SELECT doc_id, chr(CAST(65 + least(floor((x - min(x) OVER w) / CAST(greatest(1, max(x) OVER w - min(x) OVER w) AS DOUBLE) * 16), 15) AS INT)) AS letter FROM n WINDOW w AS (PARTITION BY project_id)",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM i GROUP BY user_id, k""",
    "revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}
