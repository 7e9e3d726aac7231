"""Queries over tracks: speech, sentiment, names, windows, features, domains, repeats."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import alignment, lexical
from lexiloom.operators import intervals as I
from lexiloom.operators import segments as S
from lexiloom.operators import tracks as K
from lexiloom.plans import sql as Q
from lexiloom.plans.q_spans import _P, _S, _spans
from lexiloom.session import read_table

BIG = "bigint"
# Words that begin a narrative segment.
CONNECTIVES = "additionally although because consequently conversely finally furthermore hence however meanwhile moreover next since subsequently then therefore thus ultimately".split()
FEATURES = ["sentiment", "entities", "dialogue", "lexical", "topics", "syntax"]


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


def _paras(spark, d):
    return S.paragraphs(_docs(spark, d))


def dialogue_spans(spark, d):
    """Quoted speech by four patterns, with its speaker."""
    return K.dialogue(_docs(spark, d))


def dialogue_by_mark(spark, d):
    """How many quotations each kind of quotation mark gives in a text."""
    found = K.dialogue(_docs(spark, d)).groupBy("doc_id").agg(*(F.sum((F.col("confidence") == c).cast(BIG)).alias(n) for n, c in (("curly", 0.92), ("straight", 0.85))))
    return found.where("curly + straight > 0")


def entity_clusters(spark, d):
    """The fullest name for each person of a document."""
    people = read_table(spark, d, "entities").where("entity_type IN ('PER', 'PERSON')").select("doc_id", F.col("body_value").alias("name"))
    return K.canonical_names(people)


def coreference_chains(spark, d):
    """Names of a document that come twice or more, whatever their case, with the longest spelling."""
    named = read_table(spark, d, "entities").where("entity_type IN ('PER', 'PERSON', 'GPE', 'LOC', 'ORG') AND trim(body_value) <> ''").dropDuplicates(["entity_id"])
    key = F.lower(F.trim("body_value"))
    chains = named.groupBy("doc_id", key.alias("key")).agg(F.count(F.lit(1)).alias("mentions"), F.min("start_pos").alias("first"), F.max(F.struct(F.length("body_value").alias("n"), "body_value")).alias("r"))
    return chains.where("mentions >= 2").select("doc_id", "key", "mentions", "first", F.col("r.body_value").alias("referent"))


def _valence(spark, d):
    words = S.sentences(_docs(spark, d)).select("doc_id", "idx", "start", "end", F.explode(T.words(F.col("text"))).alias("w"))
    table = spark.createDataFrame(sorted(K.VALENCE.items()), "w string, v double")
    per = words.join(F.broadcast(table), "w", "left").groupBy("doc_id", "idx", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.count("v").alias("told"))
    valence = F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15)
    return per.select("doc_id", "idx", "start", "end", valence.alias("valence"), (F.col("told") / F.col("n") / 2).alias("arousal"), (0.5 + 0.4 * F.abs(valence)).alias("confidence"))


def sentiment_spans(spark, d):
    """Valence, arousal and confidence of each sentence by a small lexicon."""
    return _valence(spark, d).select("doc_id", "idx", *(F.round(c, 6).alias(c) for c in ("valence", "arousal", "confidence")))


def sentiment_by_paragraph(spark, d):
    """Mean valence of the sentences that begin in each paragraph, and its spread where there are several."""
    paras = _paras(spark, d).select("doc_id", F.col("start").alias("p_start"), F.col("idx").alias("paragraph"))
    at = I.asof_join(_valence(spark, d).select("doc_id", "start", "valence"), paras, ["doc_id"], "start", "p_start", "paragraph").where("paragraph IS NOT NULL")
    per = at.groupBy("doc_id", "paragraph").agg(F.count(F.lit(1)).alias("n"), F.avg("valence").alias("mean"), F.stddev_pop("valence").alias("spread"))
    return per.select("doc_id", "paragraph", "n", F.round("mean", 6).alias("mean"), F.when(F.col("n") > 1, F.round("spread", 6)).otherwise(0.0).alias("spread"))


def _features(spark, d):
    """Per paragraph, the spans of each track that begin in it and their mean confidence; zeros where there are none."""
    paras = _paras(spark, d).select("doc_id", "idx", "start")
    ents = read_table(spark, d, "entities").where("start_pos < end_pos").dropDuplicates(["entity_id"]).select("doc_id", F.col("start_pos").alias("start"), "confidence", F.lit("entities").alias("track"))
    rows = _spans(spark, d).select("doc_id", "start", "confidence", "track").unionByName(ents)
    at = I.asof_join(rows, paras.withColumnRenamed("start", "p_start"), ["doc_id"], "start", "p_start", "idx").where("idx IS NOT NULL")
    counts = [F.sum((F.col("track") == t).cast(BIG)).alias(f"n_{t}") for t in FEATURES]
    means = [F.avg(F.when(F.col("track") == t, F.col("confidence"))).alias("mean_sentiment") for t in ("sentiment",)]
    per = at.groupBy("doc_id", "idx").agg(*counts, *means)
    joined = paras.select("doc_id", "idx").join(per, ["doc_id", "idx"], "left")
    return joined.select("doc_id", "idx", *(F.coalesce(f"n_{t}", F.lit(0)).alias(f"n_{t}") for t in FEATURES), F.coalesce("mean_sentiment", F.lit(0.0)).alias("mean_sentiment"))


def paragraph_features(spark, d):
    return _features(spark, d).withColumn("mean_sentiment", F.round("mean_sentiment", 6))


def _standard(rows, columns):
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    z = lambda c: ((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)).alias(f"z_{c}")
    return rows.join(F.broadcast(stats)).select("doc_id", "idx", *(z(c) for c in columns))


def state_descriptors(spark, d):
    """What is high or low in each paragraph, by standard scores over 0.8 or under -0.8."""
    columns = ["n_entities", "n_dialogue", "n_topics", "mean_sentiment"]
    z = _standard(_features(spark, d), columns)
    told = [F.when(F.round(f"z_{c}", 9) > 0.8, F.lit(f"high {c[c.index('_') + 1:]}")).when(F.round(f"z_{c}", 9) < -0.8, F.lit(f"low {c[c.index('_') + 1:]}")) for c in columns]
    return z.select("doc_id", "idx", F.coalesce(F.nullif(F.concat_ws(", ", *told), F.lit("")), F.lit("neutral")).alias("state"))


def alphabet(spark, d):
    """Paragraphs as letters A to P: clusters of standardised features, in the order of their centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    columns = ["n_entities", "n_dialogue", "n_lexical", "mean_sentiment"]
    z = _standard(_features(spark, d), columns).select("doc_id", "idx", array_to_vector(F.array(*(f"z_{c}" for c in columns))).alias("features"))
    model = KMeans(k=16, seed=42, maxIter=10).fit(z)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    letter = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(order) for x in (c, chr(65 + i)))), F.col("prediction"))
    return model.transform(z).select("doc_id", "idx", letter.alias("letter"))


def hidden_states(spark, d):
    """The hidden state of each paragraph of the documents with ten paragraphs or more."""
    rows = _features(spark, d)
    long = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("doc_id")
    return K.hidden_states(rows.join(long, "doc_id"), ["n_entities", "n_dialogue", "n_lexical", "mean_sentiment"], 4)


def topics(spark, d):
    """Ten topics over paragraphs: the share of the leading topic of each, and its words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(T.STOP_WORDS))
    rows = _paras(spark, d).select("doc_id", "idx", words.alias("w")).where("size(w) > 0")
    counted = CountVectorizer(inputCol="w", outputCol="features", vocabSize=10_000, minDF=2).fit(rows)
    model = LDA(k=10, maxIter=20, seed=42).fit(counted.transform(rows))
    share = vector_to_array("topicDistribution")
    top = model.transform(counted.transform(rows)).select("doc_id", "idx", F.array_max(share).alias("share"), (F.array_position(share, F.array_max(share)) - 1).cast("int").alias("topic"))
    names = F.array(*(F.lit(w) for w in counted.vocabulary))
    described = model.describeTopics(5).select("topic", F.array_join(F.transform("termIndices", lambda i: F.element_at(names, i + 1)), " ").alias("terms"))
    return top.join(F.broadcast(described), "topic").select("doc_id", "idx", "topic", "share", "terms")


def rqa_windows(spark, d):
    """Windows of 100 words, 50 apart, as runs of paragraphs."""
    return K.word_windows(_paras(spark, d).select("doc_id", "idx", T.word_count(F.col("text")).alias("words")))


def narrative_segments(spark, d):
    """Runs of sentences; a sentence that begins with a connective begins one."""
    first = F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))
    rows = S.sentences(_docs(spark, d)).withColumn("cut", first.isin(CONNECTIVES).cast(BIG))
    rows = rows.withColumn("segment", F.sum("cut").over(W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)))
    begins = F.min("idx").over(W.partitionBy("doc_id"))
    rows = rows.withColumn("segment", F.col("segment") - F.max(F.when(F.col("idx") == begins, F.col("cut"))).over(W.partitionBy("doc_id")))
    return rows.groupBy("doc_id", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("sentences"), F.sum(T.word_count(F.col("text"))).alias("words"))


def flow_metrics(spark, d):
    return narrative_segments(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("words") / F.count(F.lit(1)), 6).alias("mean_words"))


def label_compartments(spark, d):
    """Compartments and domains of the vectors of each label, in order of their ids."""
    rows = read_table(spark, d, "embeddings").select(F.col("label").cast(BIG).alias("doc"), F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return K.compartment_rows(rows)


def repeated_runs(spark, d):
    """Runs of chunks of 50 words that a document repeats, by seeds along diagonals."""
    return K.repeated_runs(S.word_chunks(_docs(spark, d)).select("doc_id", "idx", "chunk"))


def chunk_similarity(spark, d):
    """Chunks of 50 words of one document that share at least 0.3 of their content words."""
    return lexical.chunk_similarity(_docs(spark, d), T.STOP_WORDS).withColumn("jaccard", F.round("jaccard", 6))


def section_blocks(spark, d):
    """Sections with the paragraphs that begin in them; texts without headings are one."""
    heads = S.headings(_docs(spark, d)).select("doc_id", "start", F.col("text").alias("title"))
    docs = _docs(spark, d).where("length(text) > 0").select("doc_id", F.length("text").cast(BIG).alias("n"))
    whole = docs.join(heads.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).cast(BIG).alias("start"), F.lit("Full Text").alias("title"))
    all_ = heads.unionByName(whole).join(docs, "doc_id")
    ends = all_.withColumn("end", F.coalesce(F.lead("start").over(W.partitionBy("doc_id").orderBy("start")), F.col("n"))).select("doc_id", "title", "start", "end")
    starts = _paras(spark, d).select("doc_id", "idx", F.col("start").alias("r_start"), (F.col("start") + 1).alias("r_end"))
    per = I.interval_join(ends, starts, ["doc_id"]).groupBy("doc_id", "start").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("paragraphs"))
    return ends.join(per, ["doc_id", "start"], "left").select("doc_id", "start", "end", "title", "first", "last", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


def section_track_counts(spark, d):
    """How many spans of each track overlap each section, a column per track."""
    sections = section_blocks(spark, d).select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = I.interval_join(_spans(spark, d).select("ann_id", "doc_id", "track", "start", "end"), sections, ["doc_id"])
    names = ["dialogue", "lexical", "lithmm", "sentiment", "syntax", "topics"]
    return pairs.groupBy("doc_id", F.col("r_start").alias("start")).agg(*(F.sum((F.col("track") == t).cast(BIG)).alias(t) for t in names))


def hit_paragraphs(spark, d):
    """The paragraph of each place where a word stands, the first one for places between paragraphs."""
    hits = S.literal_hits(_docs(spark, d).select("doc_id", F.lower("text").alias("text")), "winter")
    paras = _paras(spark, d).select("doc_id", F.col("start").alias("p_start"), F.struct("idx", "end").alias("p"))
    at = I.asof_join(hits, paras, ["doc_id"], "start", "p_start", "p")
    return at.select("doc_id", "start", F.when(F.col("start") < F.col("p.end"), F.col("p.idx")).otherwise(0).cast(BIG).alias("paragraph"))


def nearest_annotation(spark, d):
    """The start of the annotation nearest to each entity, at most 500 characters away."""
    ents = read_table(spark, d, "entities").where("start_pos IS NOT NULL").dropDuplicates(["entity_id"]).select("entity_id", "doc_id", F.col("start_pos").alias("at"))
    marks = _spans(spark, d).select("doc_id", F.col("start").alias("mark"), F.col("start").alias("nearest")).distinct()
    return I.nearest(ents, marks, ["doc_id"], "at", "mark", "nearest", 500).select("entity_id", "nearest")


def following_paragraph(spark, d):
    """The first paragraph that ends at or after each entity's start."""
    ents = read_table(spark, d, "entities").where("start_pos IS NOT NULL").dropDuplicates(["entity_id"]).select("entity_id", "doc_id", "start_pos")
    return I.asof_join(ents, _paras(spark, d).select("doc_id", "end", "idx"), ["doc_id"], "start_pos", "end", "idx", forward=True).select("entity_id", "idx")


def active_spans(spark, d):
    """The disjoint pieces of each text under spans of speech and syntax, with the spans on each."""
    rows = _spans(spark, d).where("track IN ('dialogue', 'syntax')").select("doc_id", "start", "end", "ann_id")
    return I.active_sets(rows, "doc_id", "ann_id").select("doc_id", "start", "end", F.array_join("ids", ",").alias("ids"))


def _canonical(name):
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    kept = F.when(F.size(words) > 1, F.filter(words, lambda w: ~F.lower(w).isin("the", "a", "an"))).otherwise(words)
    return F.array_join(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def _characters(spark, d):
    ents = read_table(spark, d, "entities").dropDuplicates(["entity_id"]).where("entity_type IN ('PER', 'PERSON', 'ORG', 'GPE', 'LOC') AND length(trim(body_value)) >= 2").select("project_id", "doc_id", F.trim("body_value").alias("name"), "start_pos", F.lit(True).alias("alias"))
    refs = read_table(spark, d, "coreference").dropDuplicates(["mention_id"]).where("trim(referent_id) <> ''").select("project_id", "doc_id", F.trim("referent_id").alias("name"), "start_pos", F.lit(False).alias("alias"))
    both = ents.unionByName(refs).where("start_pos IS NOT NULL AND doc_id IS NOT NULL").withColumn("canonical", _canonical(F.col("name")))
    paras = _paras(spark, d).select("doc_id", F.col("start").alias("p_start"), F.struct("idx", "end").alias("p"))
    at = I.asof_join(both, paras, ["doc_id"], "start_pos", "p_start", "p")
    return at.withColumn("paragraph", F.when(F.col("start_pos") < F.col("p.end"), F.col("p.idx")).otherwise(-1).cast(BIG)).drop("p")


def character_profiles(spark, d):
    """Per project and name in one spelling of case: aliases, mentions, first and last place, paragraphs."""
    per = _characters(spark, d).groupBy("project_id", "canonical").agg(
        F.count(F.lit(1)).alias("mentions"), F.min("start_pos").alias("first"), F.max("start_pos").alias("last"),
        F.countDistinct(F.when(F.col("paragraph") >= 0, F.struct("doc_id", "paragraph"))).alias("paragraphs"), F.array_sort(F.collect_set(F.when(F.col("alias"), F.col("name")))).alias("aliases"),
    )
    return per.withColumn("aliases", F.array_join("aliases", "|"))


def paragraph_cooccurrence(spark, d):
    """Paragraphs that two of the 20 most mentioned names of a project share; a name with itself has all its own."""
    rows = _characters(spark, d)
    top = rows.groupBy("project_id", "canonical").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("n"), "canonical"))).where("r <= 20").select("project_id", "canonical")
    inside = rows.where("paragraph >= 0").join(top, ["project_id", "canonical"]).select("project_id", "doc_id", "paragraph", "canonical").distinct()
    a, b = inside.alias("a"), inside.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("project_id", "doc_id", "paragraph")]
    return a.join(b, [*same, F.col("a.canonical") <= F.col("b.canonical")]).groupBy(F.col("a.project_id").alias("project_id"), F.col("a.canonical").alias("name_a"), F.col("b.canonical").alias("name_b")).agg(F.count(F.lit(1)).alias("shared"))


def edition_rows(spark, d):
    """Paragraphs that a document keeps, changes, drops or adds against the next of its project with the same title."""
    docs = read_table(spark, d, "documents").where("title IS NOT NULL AND text IS NOT NULL").select("doc_id", "project_id", "title")
    after = docs.withColumn("next", F.lead("doc_id").over(W.partitionBy("project_id", "title").orderBy("doc_id"))).where("next IS NOT NULL").select("doc_id", "next")
    per = _paras(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"]).alias("p"))
    pairs = after.join(per, "doc_id").join(per.select(F.col("doc_id").alias("next"), F.col("p").alias("q")), "next")
    return alignment.edition_rows(pairs.select(F.col("doc_id").cast("string").alias("id"), F.col("p").alias("a"), F.col("q").alias("b")))


def vector_alignments(spark, d):
    """Local alignments of the vectors of one label with those of the next, with their chance."""
    per = read_table(spark, d, "embeddings").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    a, b = per.select(F.col("label").cast(BIG).alias("id_a"), F.col("v").alias("a")), per.select(F.col("label").cast(BIG).alias("id_b"), F.col("v").alias("b"))
    return alignment.align_vectors(a.join(b, F.col("id_b") == F.col("id_a") + 1), 10)


_CANON = "array_to_string(list_transform(CASE WHEN len({w}) > 1 THEN list_filter({w}, lambda w: lower(w) NOT IN ('the', 'a', 'an')) ELSE {w} END, lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_CHARS = "c AS (SELECT DISTINCT entity_id AS id, 1 AS k, project_id, doc_id, trim(body_value) AS name, start_pos, TRUE AS alias FROM entities WHERE entity_type IN ('PER', 'PERSON', 'ORG', 'GPE', 'LOC') AND length(trim(body_value)) >= 2 UNION SELECT DISTINCT mention_id, 2, project_id, doc_id, trim(referent_id), start_pos, FALSE FROM coreference WHERE trim(referent_id) <> ''), n AS (SELECT c.*, " + _CANON.format(w="list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '')") + " AS canonical FROM c WHERE start_pos IS NOT NULL AND doc_id IS NOT NULL), ch AS (SELECT n.*, CASE WHEN start_pos < p_end THEN idx ELSE -1 END AS paragraph FROM n ASOF LEFT JOIN para ON n.doc_id = para.doc_id AND n.start_pos >= para.p_start)"
_VAL = "WITH " + Q.SENT + ", lex(w, v) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in sorted(K.VALENCE.items())) + "), sw AS (SELECT doc_id, idx, start, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) AS w FROM sent), sv AS (SELECT doc_id, idx, start, count(*) AS n, coalesce(sum(v), 0) AS s, count(v) AS told FROM sw LEFT JOIN lex USING (w) GROUP BY ALL), val AS (SELECT doc_id, idx, start, s / sqrt(s * s + 15) AS valence, told / CAST(n AS DOUBLE) / 2 AS arousal FROM sv)"
_ROWS = "r AS (SELECT doc_id, start, confidence, track FROM span UNION ALL SELECT doc_id, start_pos, confidence, 'entities' FROM (SELECT DISTINCT * FROM entities WHERE start_pos < end_pos)), ra AS (SELECT r.*, idx FROM r ASOF JOIN para ON r.doc_id = para.doc_id AND r.start >= para.p_start), f AS (SELECT doc_id, idx, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN track = '{t}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_{t}" for t in FEATURES) + ", coalesce(avg(CASE WHEN track = 'sentiment' THEN confidence END), 0) AS mean_sentiment FROM para LEFT JOIN ra USING (doc_id, idx) GROUP BY ALL)"
_HEADS = """, hd AS (SELECT doc_id, start, """ + Q.STRIP.format("text") + r""" AS title FROM line WHERE regexp_matches(text || chr(10), '\A((?i:chapter)\s+[\divxlc]+\.?|[A-Z][A-Z ]{5,}|[IVXLC]+\.\s)')), hs AS (SELECT * FROM hd UNION ALL SELECT doc_id, 0, 'Full Text' FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM hd)),
sec AS (SELECT doc_id, hs.start, hs.title, coalesce(lead(hs.start) OVER (PARTITION BY doc_id ORDER BY hs.start), length(d.text)) AS "end" FROM hs JOIN documents d USING (doc_id))"""


def _z_sql():
    columns = ["n_entities", "n_dialogue", "n_topics", "mean_sentiment"]
    z = lambda c: f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END FROM f), 9)"
    return ", ".join(f"CASE WHEN {z(c)} > 0.8 THEN 'high {c[c.index('_') + 1:]}' WHEN {z(c)} < -0.8 THEN 'low {c[c.index('_') + 1:]}' END" for c in columns)


QUERIES = {
    q.__name__: q
    for q in (
        dialogue_spans, dialogue_by_mark, entity_clusters, coreference_chains, sentiment_spans, sentiment_by_paragraph, paragraph_features, state_descriptors, alphabet, hidden_states, topics, rqa_windows, narrative_segments, flow_metrics,
        label_compartments, repeated_runs, chunk_similarity, section_blocks, section_track_counts, hit_paragraphs, nearest_annotation, following_paragraph, active_spans, character_profiles, paragraph_cooccurrence, edition_rows, vector_alignments,
    )
}
SQL = {
    "dialogue_by_mark": """SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '“(.{1,500}?)”')) AS BIGINT) AS curly, CAST(len(regexp_extract_all(text, '"(.{1,500}?)"')) AS BIGINT) AS straight FROM documents WHERE text IS NOT NULL) WHERE curly + straight > 0""",
    "coreference_chains": """WITH e AS (SELECT DISTINCT entity_id, doc_id, body_value, start_pos FROM entities WHERE entity_type IN ('PER', 'PERSON', 'GPE', 'LOC', 'ORG') AND trim(body_value) <> '')
        SELECT doc_id, lower(trim(body_value)) AS key, count(*) AS mentions, min(start_pos) AS first, arg_max(body_value, (length(body_value), body_value)) AS referent FROM e GROUP BY ALL HAVING count(*) >= 2""",
    "sentiment_spans": _VAL + " SELECT doc_id, idx, round(valence, 6) AS valence, round(arousal, 6) AS arousal, round(0.5::DOUBLE + 0.4::DOUBLE * abs(valence), 6) AS confidence FROM val",
    "sentiment_by_paragraph": _VAL + _P.replace("s AS (", "s2 AS (", 1).replace("FROM s)", "FROM s2)", 1)
    + " SELECT val.doc_id, para.idx AS paragraph, count(*) AS n, round(avg(valence), 6) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(valence), 6) ELSE 0 END AS spread FROM val ASOF JOIN para ON val.doc_id = para.doc_id AND val.start >= para.p_start GROUP BY ALL",
    "paragraph_features": _S + _P + ", " + _ROWS + " SELECT * REPLACE (round(mean_sentiment, 6) AS mean_sentiment) FROM f",
    "state_descriptors": _S + _P + ", " + _ROWS + f" SELECT doc_id, idx, coalesce(nullif(concat_ws(', ', {_z_sql()}), ''), 'neutral') AS state FROM f",
    "rqa_windows": "WITH " + Q.PARA + r""", w AS (SELECT doc_id, idx, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS BIGINT) AS words FROM para), c AS (SELECT doc_id, idx, sum(words) OVER (PARTITION BY doc_id ORDER BY idx) AS a FROM w),
        a AS (SELECT doc_id, list_concat([CAST(0 AS HUGEINT)], list(a ORDER BY idx)) AS sums, count(*) AS n FROM c GROUP BY doc_id), p AS (SELECT doc_id, sums, n, unnest(range(0, CAST(sums[len(sums)] AS BIGINT), 50)) AS pos FROM a)
        SELECT doc_id, pos // 50 AS window, CAST(greatest(len(list_filter(sums, lambda s: s <= pos)) - 1, 0) AS BIGINT) AS first, CAST(least(len(list_filter(sums, lambda s: s <= pos + 100)) - 1, n - 1) AS BIGINT) AS last FROM p""",
    "section_blocks": "WITH " + Q.PARA + ", line AS (SELECT doc_id, p AS text, a AS start FROM l WHERE length(p) > 0)" + _HEADS
    + ' SELECT sec.doc_id, sec.start, sec."end", title, min(idx) AS first, max(idx) AS last, count(idx) AS paragraphs FROM sec LEFT JOIN para ON para.doc_id = sec.doc_id AND para.start >= sec.start AND para.start < sec."end" GROUP BY ALL',
    "section_track_counts": _S + ", " + Q.PARA + ", line AS (SELECT doc_id, p AS text, a AS start FROM l WHERE length(p) > 0)" + _HEADS
    + " SELECT sec.doc_id, sec.start, " + ", ".join(f"CAST(sum(CASE WHEN track = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}" for t in ("dialogue", "lexical", "lithmm", "sentiment", "syntax", "topics")) + ' FROM sec JOIN span ON span.doc_id = sec.doc_id AND span.start < sec."end" AND span."end" > sec.start GROUP BY ALL',
    "narrative_segments": "WITH " + Q.SENT + f", c AS (SELECT *, CAST(lower(regexp_extract(text, '^([A-Za-z]+)', 1)) IN ({', '.join(repr(w) for w in CONNECTIVES)}) AND idx > 0 AS BIGINT) AS cut FROM sent), g AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS segment FROM c)"
    + r""" SELECT doc_id, segment, min(start) AS start, max("end") AS "end", count(*) AS sentences, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))) AS BIGINT) AS words FROM g GROUP BY ALL""",
    "hit_paragraphs": "WITH h AS (SELECT doc_id, i - 1 AS start FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(lower(text), 'winter')) WHERE substr(t, i, 6) = 'winter')" + _P
    + " SELECT h.doc_id, h.start, CASE WHEN h.start < p_end THEN idx ELSE 0 END AS paragraph FROM h ASOF LEFT JOIN para ON h.doc_id = para.doc_id AND h.start >= para.p_start",
    "nearest_annotation": _S + """, e AS (SELECT DISTINCT entity_id, doc_id, start_pos AS pos FROM entities WHERE start_pos IS NOT NULL), m AS (SELECT DISTINCT doc_id, start FROM span),
        b AS (SELECT entity_id, e.doc_id, pos, m.start AS back FROM e ASOF LEFT JOIN m ON e.doc_id = m.doc_id AND e.pos >= m.start), f AS (SELECT b.*, m.start AS ahead FROM b ASOF LEFT JOIN m ON b.doc_id = m.doc_id AND b.pos <= m.start)
        SELECT entity_id, CASE WHEN least(coalesce(pos - back, 501), coalesce(ahead - pos, 501)) > 500 THEN NULL WHEN coalesce(pos - back, 501) <= coalesce(ahead - pos, 501) THEN back ELSE ahead END AS nearest FROM f""",
    "following_paragraph": "WITH e AS (SELECT DISTINCT entity_id, doc_id, start_pos FROM entities WHERE start_pos IS NOT NULL)" + _P + " SELECT entity_id, idx FROM e ASOF LEFT JOIN para ON e.doc_id = para.doc_id AND e.start_pos <= para.p_end",
    "active_spans": _S + """, x AS (SELECT * FROM span WHERE track IN ('dialogue', 'syntax')), b AS (SELECT doc_id, start AS pos FROM x UNION SELECT doc_id, "end" FROM x), p AS (SELECT doc_id, pos AS s, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM b)
        SELECT p.doc_id, p.s AS start, p.e AS "end", string_agg(CAST(ann_id AS VARCHAR), ',' ORDER BY ann_id) AS ids FROM p JOIN x ON x.doc_id = p.doc_id AND x.start < p.e AND x."end" > p.s GROUP BY ALL""",
    "chunk_similarity": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, i // 50 AS idx, w[i + 1:i + 50] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), 50)) AS i FROM w) WHERE len(w[i + 1:i + 50]) >= 5),
        t AS (SELECT doc_id, idx, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(w, ' ')), '([a-z'']+)', 1), lambda x: length(x) > 1 AND NOT list_contains([""" + ", ".join(repr(w) for w in T.STOP_WORDS) + r"""], x))) AS t FROM c),
        p AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, len(list_intersect(a.t, b.t)) AS k, len(a.t) + len(b.t) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.idx < b.idx WHERE len(a.t) > 0 AND len(b.t) > 0)
        SELECT doc_id, i, j, round(k / CAST(n - k AS DOUBLE), 6) AS jaccard FROM p WHERE k / CAST(n - k AS DOUBLE) >= 0.3""",
    "character_profiles": "WITH " + _P[2:] + ", " + _CHARS + """ SELECT project_id, canonical, count(*) AS mentions, min(start_pos) AS first, max(start_pos) AS last, count(DISTINCT CASE WHEN paragraph >= 0 THEN (doc_id, paragraph) END) AS paragraphs,
        coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE alias)), '|'), '') AS aliases FROM ch GROUP BY ALL""",
    "paragraph_cooccurrence": "WITH " + _P[2:] + ", " + _CHARS + """, t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, canonical) AS r FROM (SELECT project_id, canonical, count(*) AS n FROM ch GROUP BY ALL)),
        i AS (SELECT DISTINCT ch.project_id, doc_id, paragraph, ch.canonical FROM ch JOIN t ON ch.project_id = t.project_id AND ch.canonical = t.canonical WHERE r <= 20 AND paragraph >= 0)
        SELECT a.project_id, a.canonical AS name_a, b.canonical AS name_b, count(*) AS shared FROM i a JOIN i b ON a.project_id = b.project_id AND a.doc_id = b.doc_id AND a.paragraph = b.paragraph AND a.canonical <= b.canonical GROUP BY ALL""",
}
SQL["flow_metrics"] = "SELECT doc_id, count(*) AS segments, round(CAST(sum(words) AS DOUBLE) / count(*), 6) AS mean_words FROM (" + SQL["narrative_segments"] + ") GROUP BY doc_id"
