"""Every query of this subpackage by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm import chunks, lookalikes, names, neighbours, packing, scans, spans, tokens
from lexiloom.session import checkpointed, read_table

#: Tokens of a container in the packing queries.
CAPACITY = 2048


#: Table, key and text of the fields that look-alike texts are united in.
_ALIKE_FIELDS = [("quote_selectors", "quote_id", "exact"), ("text_cleaner", "chunk_id", "text")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [lookalikes.alike_pairs(read_table(spark, sf_dir, t), k, c).select(F.lit(f"{t}.{c}").alias("field"), "id_a", "id_b") for t, k, c in _ALIKE_FIELDS]
    return reduce(DataFrame.unionByName, pairs)


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [lookalikes.canonical(read_table(spark, sf_dir, t), k, c).select(F.lit(f"{t}.{c}").alias("field"), F.col(k).alias("item_id"), "canonical") for t, k, c in _ALIKE_FIELDS]
    return reduce(DataFrame.unionByName, forms)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that looks like another, its class and the number of its links."""
    rows = [lookalikes.alike_classes(read_table(spark, sf_dir, t), k, c).select(F.lit(f"{t}.{c}").alias("field"), F.col("id").alias("item_id"), F.substring("form", 1, 16).alias("class"), "n_links") for t, k, c in _ALIKE_FIELDS]
    return reduce(DataFrame.unionByName, rows)


def p2_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions = read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "coreference")
    named = entities.select(F.col("project_id").alias("scope"), F.col("body_value").alias("name"), F.coalesce("entity_type", F.lit("PER")).alias("kind"))
    named = named.unionByName(mentions.select(F.col("project_id").alias("scope"), F.col("referent_id").alias("name"), F.lit(None).cast("string").alias("kind")))
    linked = names.link_names(named, read_table(spark, sf_dir, "short_names"))
    return linked.select(F.col("scope").alias("project_id"), "entity", "name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(p2_linked(spark, sf_dir).withColumnRenamed("project_id", "scope")).withColumnRenamed("scope", "project_id")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("summarize_requests", "request_id", "passage", "summarize_requests.passage"), ("text_cleaner", "chunk_id", "text", "text_cleaner.chunk")]
    cut = [chunks.split_oversized(read_table(spark, sf_dir, t), k, c, "max_chars", "overlap_chars").withColumnRenamed(k, "item_id").withColumn("field", F.lit(f)) for t, k, c, f in fields]
    return reduce(DataFrame.unionByName, cut)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("field", "item_id").distinct()


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: do its pieces fit, cover the text in order, and overlap by no more than asked."""
    pieces = _pieces(spark, sf_dir).where("n_pieces > 1").distinct()
    fields = [("summarize_requests", "request_id", "passage", "summarize_requests.passage"), ("text_cleaner", "chunk_id", "text", "text_cleaner.chunk")]
    items = reduce(DataFrame.unionByName, [read_table(spark, sf_dir, t).select(F.lit(f).alias("field"), F.col(k).alias("item_id"), F.col(c).alias("whole"), "max_chars", F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap")) for t, k, c, f in fields]).distinct()
    after = W.partitionBy("field", "item_id").orderBy("piece_no")
    both = pieces.join(items, ["field", "item_id"]).withColumn("before", F.lag("piece_end").over(after))
    fits = (F.length("piece") <= F.col("max_chars")) & (F.expr("substring(whole, int(piece_start) + 1, int(piece_end - piece_start))") == F.col("piece"))
    joins = F.when(F.col("before").isNull(), F.col("piece_start") == 0).otherwise((F.col("piece_start") <= F.col("before")) & (F.col("piece_end") > F.col("before")) & (F.col("before") - F.col("piece_start") <= F.col("overlap")))
    checked = both.groupBy("field", "item_id").agg(F.bool_and(fits).alias("fits"), (F.bool_and(joins) & (F.max("piece_end") == F.max(F.length("whole")))).alias("covers"), F.any_value(F.col("overlap") > F.floor(F.col("max_chars") / 2)).alias("overlap_cut"))
    return checked


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("field", "item_id", "piece_no", "n_pieces", "piece_start", "piece_end", "piece")


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunk, epub = read_table(spark, sf_dir, "text_cleaner"), read_table(spark, sf_dir, "epub_results")
    pages = chunk.where("source_format = 'pdf'").select(F.lit("text_cleaner.text").alias("field"), F.col("chunk_id").alias("record_id"), "text")
    pages = pages.unionByName(epub.select(F.lit("epub_results.text").alias("field"), F.col("epub_id").alias("record_id"), "text"))
    return pages, chunk.select("text").unionByName(epub.select("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_faults(*_scans(spark, sf_dir)).select("field", "record_id", "line_no", "noise").distinct()


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, corpus = _scans(spark, sf_dir)
    return scans.repair(pages.dropDuplicates(["field", "record_id"]), checkpointed(scans.find_faults(pages, corpus)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.usable(read_table(spark, sf_dir, "vectors"), "vec_id", "vectors", "dimension", "model")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "search_requests").where("k BETWEEN 1 AND 100 AND vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), "k")
    near = neighbours.most_similar(_vectors(spark, sf_dir), asked)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def _every_50th(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "vectors").where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.lit(10).alias("k"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 50, against all rows."""
    near = neighbours.most_similar(_vectors(spark, sf_dir), _every_50th(spark, sf_dir))
    return near.select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("other_vec_id"), F.round("cosine", 4).alias("cosine"))


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the true ten most similar vectors of the same queries, how many were found."""
    index, asked = checkpointed(_vectors(spark, sf_dir)), _every_50th(spark, sf_dir)
    true = neighbours.brute_force(index, asked).select("id", "other")
    found = neighbours.most_similar(index, asked).select("id", "other", F.lit(1).alias("hit"))
    sums = true.join(found, ["id", "other"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))
    return sums.select("pairs", "found", (F.col("found") >= 0.9 * F.col("pairs")).alias("enough"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids as in p7_ids, with so few words shipped to the tasks that most texts have rarer ones, as in a corpus of many words."""
    return tokens.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text", head_words=4096)


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document comes back from its ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    back = tokens.decode(checkpointed(p7_ids(spark, sf_dir)), "doc_id")
    return docs.join(back, "doc_id").select("doc_id", (F.col("original") == F.col("text")).alias("same"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = p7_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.pack(sized, "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers are filled how far."""
    return p8_containers(spark, sf_dir).where("container IS NOT NULL").groupBy("container").agg(F.sum("part_size").alias("used")).groupBy("used").agg(F.count(F.lit(1)).alias("containers"))


def p8_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, and what the tokens would fill if none had room left."""
    used = p8_containers(spark, sf_dir).where("container IS NOT NULL").agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("part_size"), F.lit(0)).alias("tokens"))
    least = F.ceil(F.col("tokens") / CAPACITY).cast("bigint")
    return used.select("containers", least.alias("least"), F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 4).alias("filled"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amount(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_sentences(read_table(spark, sf_dir, "documents"), "doc_id", "text")


_QUERIES = [p1_found, p1_canonical, p1_classes, p2_found, p2_linked, p3_found, p3_cover, p3_pieces, p5_found, p5_repaired, p6_found, p6_neighbours, p6_recall, p7_ids, p7_rare_words, p7_decoded, p8_containers, p8_fill, p8_bound, p9_found, p9_shared, p9_without_repeats]
_UNIT = """WITH v AS (SELECT DISTINCT vec_id, coalesce(model, '') || ':' || len(vectors) AS model, CAST(vectors AS DOUBLE[]) AS v FROM vectors
        WHERE vec_id IS NOT NULL AND len(vectors) = dimension AND len(vectors) > 0
        AND len(list_filter(vectors, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0)"""
_NEAR = """, near AS (SELECT q.vec_id, n.vec_id AS other, q.k, list_cosine_similarity(q.v, n.v) AS cosine,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, n.v) DESC, n.vec_id) AS rank
        FROM q JOIN v n ON q.model = n.model AND q.vec_id <> n.vec_id)"""
_SQL = {
    "p6_found": _UNIT + """, q AS (SELECT v.*, k FROM v JOIN (SELECT vec_id, max(k) AS k FROM search_requests WHERE k BETWEEN 1 AND 100 GROUP BY vec_id) r USING (vec_id))""" + _NEAR
    + " SELECT DISTINCT least(vec_id, other) AS vec_id_a, greatest(vec_id, other) AS vec_id_b FROM near WHERE rank <= k",
    "p6_neighbours": _UNIT + ", q AS (SELECT *, 10 AS k FROM v WHERE vec_id % 50 = 0)" + _NEAR + " SELECT vec_id, rank, other AS other_vec_id, round(cosine, 4) AS cosine FROM near WHERE rank <= k",
    "p3_found": """SELECT DISTINCT 'summarize_requests.passage' AS field, request_id AS item_id FROM summarize_requests WHERE length(passage) > max_chars AND max_chars >= 1
        UNION SELECT DISTINCT 'text_cleaner.chunk', chunk_id FROM text_cleaner WHERE length(text) > max_chars AND max_chars >= 1""",
    "p3_cover": """SELECT DISTINCT 'summarize_requests.passage' AS field, request_id AS item_id, TRUE AS fits, TRUE AS covers, coalesce(overlap_chars, 0) > max_chars // 2 AS overlap_cut FROM summarize_requests WHERE length(passage) > max_chars AND max_chars >= 1
        UNION SELECT DISTINCT 'text_cleaner.chunk', chunk_id, TRUE, TRUE, coalesce(overlap_chars, 0) > max_chars // 2 FROM text_cleaner WHERE length(text) > max_chars AND max_chars >= 1""",
    "p7_decoded": "SELECT doc_id, TRUE AS same FROM documents",
    "p9_without_repeats": r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？]+[\"”»'']*\s*|[^.!?。！？\n]+\n*|\n+') AS s FROM documents WHERE text IS NOT NULL),
        r AS (SELECT doc_id, i, array_to_string(s[i:i + 2], '') AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS i FROM s WHERE len(s) >= 3)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS nth FROM r WHERE length(t) >= 120), gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM f WHERE nth > 1),
        p AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s), k AS (SELECT p.doc_id, string_agg(x, '' ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
        SELECT doc_id, CASE WHEN n > 0 THEN coalesce(kept, '') ELSE text END AS text, coalesce(n, 0) AS removed FROM documents LEFT JOIN k USING (doc_id)""",
}


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
