"""Text queries: lexical measures, cleaning, segmentation, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import lexical
from lexiloom.operators import segments as S
from lexiloom.plans import sql as Q
from lexiloom.session import read_table

BIG = "bigint"


def _docs(spark, d):
    return read_table(spark, d, "documents")


def lexical_stats(spark, d):
    """Per paragraph of five words or more: distinct words, words used once, mean length, Yule's K."""
    out = lexical.word_measures(S.paragraphs(_docs(spark, d)).select("doc_id", "idx", "text"))
    return out.select("doc_id", "idx", "n_words", "n_distinct", "n_once", *(F.round(c, 4).alias(c) for c in ("ttr", "mean_length", "yules_k")))


def text_signals(spark, d):
    """Entropies, diversity, dialogue, sentence statistics and a composite of complexity for each text."""
    out = lexical.text_signals(_docs(spark, d).where("length(text) > 0").select("doc_id", "text"))
    complexity = 0.4 * F.least(F.col("sentence_length_variance") / 100, F.lit(1.0)) + 0.3 * F.col("lexical_diversity") + 0.3 * F.least(F.col("avg_word_length") / 10, F.lit(1.0))
    return out.select("doc_id", "n_words", "n_sentences", *(F.round(c, 3).alias(c) for c in ("char_entropy", "word_entropy", "lexical_diversity", "dialog_ratio", "avg_sentence_length", "question_ratio", "exclamation_ratio")), F.round("sentence_length_variance", 8).alias("sentence_length_variance"), F.round(complexity, 3).alias("complexity"))


def document_checksums(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast(BIG).alias("n_code_points"), T.word_count(F.col("text")).alias("n_words"))


def normalised_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"))


def cleaned_chunks(spark, d):
    """Chunks cleaned in a fixed order of steps, with what that removed."""
    clean = T.cleaned(F.col("text"))
    return read_table(spark, d, "text_cleaner").distinct().select("chunk_id", F.md5(clean).alias("digest"), (F.length("text") - F.length(clean)).cast(BIG).alias("removed_chars"))


def cleaned_by_rules(spark, d):
    """Chunks cleaned as in cleaned_chunks but for composition by compatibility."""
    clean = T.cleaned_by_rules(F.col("text"))
    return read_table(spark, d, "text_cleaner").distinct().select("chunk_id", F.md5(clean).alias("digest"), (F.length("text") - F.length(clean)).cast(BIG).alias("removed_chars"))


def title_slugs(spark, d):
    return _docs(spark, d).where("title IS NOT NULL").select("doc_id", T.slug(F.col("title")).alias("slug"))


def paragraph_offsets(spark, d):
    return S.paragraphs(_docs(spark, d)).select("doc_id", "start", "end", F.md5("text").alias("digest"))


def heading_lines(spark, d):
    return S.headings(_docs(spark, d)).select("doc_id", "start", "end", F.col("text").alias("heading"))


def section_spans(spark, d):
    """From each heading to the next, or to the text's end."""
    from pyspark.sql import Window as W

    heads = heading_lines(spark, d).select("doc_id", "start", "heading")
    ends = heads.withColumn("next", F.lead("start").over(W.partitionBy("doc_id").orderBy("start")))
    return ends.join(_docs(spark, d).select("doc_id", F.length("text").cast(BIG).alias("n")), "doc_id").select("doc_id", "heading", "start", F.coalesce("next", "n").alias("end"))


def word_chunks(spark, d):
    return S.word_chunks(_docs(spark, d)).select("doc_id", "idx", "n_words", F.md5("chunk").alias("digest"))


def paragraph_windows(spark, d):
    """Windows of five paragraphs, overlapping by two."""
    per = S.paragraphs(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return per.select("doc_id", F.explode(S.windows(5, 2, F.col("n"))).alias("first"), "n").select("doc_id", F.col("first").cast(BIG).alias("first"), F.least(F.col("first") + 5, F.col("n")).cast(BIG).alias("after"))


def literal_hits(spark, d):
    """Every place, overlapping ones too, where a word stands, whatever its case."""
    rows = _docs(spark, d).select("doc_id", F.lower("text").alias("text")).where(F.col("text").contains("winter"))
    return S.literal_hits(rows, "winter")


def sentence_offsets(spark, d):
    return S.sentences(_docs(spark, d)).select("doc_id", "idx", "start", "end", F.md5("text").alias("digest"))


def sentence_windows(spark, d):
    """Windows of five sentences, overlapping by two."""
    per = S.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return per.select("doc_id", F.explode(S.windows(5, 2, F.col("n"))).alias("first"), "n").select("doc_id", F.col("first").cast(BIG).alias("first"), F.least(F.col("first") + 5, F.col("n")).cast(BIG).alias("after"))


def quoted_share(spark, d):
    """Characters inside double quotes, of all."""
    inside = F.aggregate(F.regexp_extract_all("text", F.lit('"([^"]+)"'), F.lit(1)), F.lit(0), lambda s, q: s + F.length(q))
    return _docs(spark, d).where("length(text) > 0").select("doc_id", F.round(inside / F.length("text"), 4).alias("dialog_ratio"))


def function_word_arc(spark, d):
    """Share of three sets of words in each fifth of a text."""
    w = _docs(spark, d).select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= 5)
    w = w.select("doc_id", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("segment")).withColumn("step", F.floor(F.col("n") / 5).cast("int"))
    part = F.slice("w", F.col("segment") * F.col("step") + 1, F.when(F.col("segment") < 4, F.col("step")).otherwise(F.col("n")))
    parts = w.select("doc_id", F.col("segment").cast(BIG).alias("segment"), part.alias("w"))
    share = lambda words: F.size(F.filter("w", lambda x: x.isin(words))) / F.size("w")
    return parts.select("doc_id", "segment", *(F.round(share(words), 4).alias(k) for k, words in T.ARC_WORDS.items()))


def tfidf_top_terms(spark, d):
    """The five terms of the highest tf-idf per document."""
    from pyspark.sql import Window as W

    docs = _docs(spark, d)
    tf = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("term")).where(F.length("term") >= 3).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    score = F.round(F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0), 6)
    # Words of many texts are few and would make the join skewed: they are sent to all tasks, at most a fixed number of them.
    common = df.orderBy(F.desc("df"), "term").limit(4096)
    rare = df.join(F.broadcast(common.select("term")), "term", "left_anti")
    scored = tf.join(F.broadcast(common), "term").unionByName(tf.join(F.broadcast(common.select("term")), "term", "left_anti").join(rare, "term"))
    ranked = scored.join(F.broadcast(n)).withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "term")).cast(BIG))
    return ranked.where("rank <= 5").select("doc_id", "rank", "term", F.round("score", 3).alias("score"))


def shared_lines(spark, d):
    """Texts of lines that stand in several documents: how often, and in how many."""
    rows = S.lines(_docs(spark, d)).where(F.length("text") >= 20).select(F.md5("text").alias("digest"), "doc_id").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("n_lines")).where("n_docs > 1").select("digest", "n_docs", "n_lines")


def speaker_verbs(spark, d):
    """Who says something in which quotation: the verb and the name after the closing quote."""
    pattern = r'" ?(said|whispered|asked|dit|sagte|dijo) ([^\s,.;"]+)'
    return S.lines(_docs(spark, d)).select(F.regexp_extract("text", pattern, 1).alias("verb"), F.regexp_extract("text", pattern, 2).alias("speaker")).where("verb <> ''").groupBy("verb", "speaker").agg(F.count(F.lit(1)).alias("n"))


_PARA, _LINE = "WITH " + Q.PARA + " ", "WITH " + Q.LINE + " "
_WORDS = "regexp_extract_all(lower({}), '([a-z'']+)', 1)"
_HEAD = r"""regexp_matches(text || chr(10), '\A((?i:chapter)\s+[\divxlc]+\.?|[A-Z][A-Z ]{5,}|[IVXLC]+\.\s)')"""


def _sql_tidy(t):
    per_line = rf"""array_to_string(list_transform(string_split({t}, chr(10)), lambda l: {Q.STRIP.format("regexp_replace(l, '[ \t]+', ' ', 'g')")}), chr(10))"""
    return Q.STRIP.format(rf"regexp_replace({per_line}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_clean():
    t = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')"
    for a, b in [*T.LIGATURES.items(), *T.MARKS.items()]:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])-\n{T.SPACE}*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    for patterns in ([T.PAGE_NUMBER], [f"(?i){p}" for p in T.BOILERPLATE]):
        hit = " OR ".join(f"regexp_matches(l, '{p}')" for p in patterns)
        t = f"array_to_string(list_filter(string_split({t}, chr(10)), lambda l: NOT ({hit})), chr(10))"
    return Q.STRIP.format(rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


QUERIES = {q.__name__: q for q in (lexical_stats, text_signals, document_checksums, normalised_texts, cleaned_chunks, cleaned_by_rules, title_slugs, paragraph_offsets, heading_lines, section_spans, word_chunks, paragraph_windows, sentence_offsets, sentence_windows, literal_hits, quoted_share, function_word_arc, tfidf_top_terms, shared_lines, speaker_verbs)}
SQL = {
    "lexical_stats": _PARA + ", w AS (SELECT doc_id, idx, unnest(" + _WORDS.format("text") + """) AS w FROM para), c AS (SELECT doc_id, idx, w, count(*) AS c FROM w GROUP BY ALL)
        SELECT doc_id, idx, CAST(sum(c) AS BIGINT) AS n_words, count(*) AS n_distinct, CAST(sum(CAST(c = 1 AS INT)) AS BIGINT) AS n_once, round(count(*) / CAST(sum(c) AS DOUBLE), 4) AS ttr,
        round(CAST(sum(c * length(w)) AS DOUBLE) / CAST(sum(c) AS DOUBLE), 4) AS mean_length, round(10000.0::DOUBLE * CAST(sum(c * c) - sum(c) AS DOUBLE) / CAST(sum(c) * sum(c) AS DOUBLE), 4) AS yules_k
        FROM c GROUP BY doc_id, idx HAVING sum(c) >= 5""",
    "text_signals": r"""WITH d AS (SELECT doc_id, text, lower(text) AS t, length(text) AS n FROM documents WHERE length(text) > 0),
        c AS (SELECT doc_id, log2(CAST(sum(k) AS DOUBLE)) - sum(k * log2(CAST(k AS DOUBLE))) / CAST(sum(k) AS DOUBLE) AS ce FROM (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(t, '')) AS c FROM d) GROUP BY ALL) GROUP BY doc_id),
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda x: x <> '') AS w FROM d),
        e AS (SELECT doc_id, log2(CAST(sum(k) AS DOUBLE)) - sum(k * log2(CAST(k AS DOUBLE))) / CAST(sum(k) AS DOUBLE) AS we FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY doc_id),
        s AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: list_filter(regexp_split_to_array(x, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda y: y <> '')), lambda z: len(z) > 0), lambda z: CAST(len(z) AS DOUBLE)) AS l, regexp_extract_all(text, '[.!?]') AS m,
            list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: CAST(length(x) AS DOUBLE)) AS g,
            coalesce(list_sum(list_transform(regexp_extract_all(text, '"[^"]*"'), lambda q: length(q))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(text, '\x27[^\x27]*\x27'), lambda q: length(q))), 0) AS q FROM d),
        f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_sentences, ce, coalesce(we, 0) AS we, coalesce(len(list_distinct(w)) / CAST(nullif(len(w), 0) AS DOUBLE), 0) AS ld, q / CAST(n AS DOUBLE) AS dr, coalesce(list_avg(l), 0) AS al,
            CASE WHEN len(l) > 1 THEN list_var_pop(l) ELSE 0 END AS v, len(list_filter(m, lambda x: x = '?')) / CAST(greatest(1, len(m)) AS DOUBLE) AS qr, len(list_filter(m, lambda x: x = '!')) / CAST(greatest(1, len(m)) AS DOUBLE) AS er, coalesce(list_avg(g), 0) AS wl
            FROM d JOIN c USING (doc_id) JOIN w USING (doc_id) LEFT JOIN e USING (doc_id) JOIN s USING (doc_id))
        SELECT doc_id, n_words, n_sentences, round(ce, 3) AS char_entropy, round(we, 3) AS word_entropy, round(ld, 3) AS lexical_diversity, round(dr, 3) AS dialog_ratio, round(al, 3) AS avg_sentence_length, round(v, 8) AS sentence_length_variance,
        round(qr, 3) AS question_ratio, round(er, 3) AS exclamation_ratio, round(0.4::DOUBLE * least(v / 100, 1) + 0.3::DOUBLE * ld + 0.3::DOUBLE * least(wl / 10, 1), 3) AS complexity FROM f""",
    "document_checksums": r"SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_code_points, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents",
    "normalised_texts": "SELECT doc_id, md5(" + _sql_tidy("translate(nfc_normalize(text), '“”«»‘’', chr(34) || chr(34) || chr(34) || chr(34) || chr(39) || chr(39))") + ") AS digest FROM documents",
    "cleaned_by_rules": f"SELECT chunk_id, md5({_sql_clean()}) AS digest, CAST(length(text) - length({_sql_clean()}) AS BIGINT) AS removed_chars FROM (SELECT DISTINCT * FROM text_cleaner)",
    "title_slugs": "SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE title IS NOT NULL",
    "paragraph_offsets": _PARA + 'SELECT doc_id, start, "end", md5(text) AS digest FROM para',
    "heading_lines": _LINE + f"SELECT doc_id, start, \"end\", {Q.STRIP.format('text')} AS heading FROM line WHERE {_HEAD}",
    "section_spans": _LINE + f', h AS (SELECT doc_id, start, {Q.STRIP.format("text")} AS heading FROM line WHERE {_HEAD}) SELECT doc_id, heading, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(d.text)) AS "end" FROM h JOIN documents d USING (doc_id)',
    "word_chunks": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(range(0, len(w), 50)) AS i, w FROM w)
        SELECT doc_id, CAST(i // 50 AS BIGINT) AS idx, CAST(len(w[i + 1:i + 50]) AS BIGINT) AS n_words, md5(array_to_string(w[i + 1:i + 50], ' ')) AS digest FROM c WHERE len(w[i + 1:i + 50]) >= 5""",
    "paragraph_windows": _PARA + ", n AS (SELECT doc_id, count(*) AS n FROM para GROUP BY doc_id) SELECT doc_id, f AS first, least(f + 5, n) AS after FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 5 THEN [0] ELSE range(0, n, 3) END) AS f FROM n)",
    "sentence_offsets": "WITH " + Q.SENT + ' SELECT doc_id, idx, start, "end", md5(text) AS digest FROM sent',
    "sentence_windows": "WITH " + Q.SENT + ", n AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) SELECT doc_id, f AS first, least(f + 5, n) AS after FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 5 THEN [0] ELSE range(0, n, 3) END) AS f FROM n)",
    "literal_hits": "SELECT doc_id, i - 1 AS start FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(lower(text), 'winter')) WHERE substr(t, i, 6) = 'winter'",
    "quoted_share": """SELECT doc_id, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda q: length(q))), 0) / CAST(length(text) AS DOUBLE), 4) AS dialog_ratio FROM documents WHERE length(text) > 0""",
    "function_word_arc": "WITH d AS (SELECT doc_id, " + _WORDS.format("text") + " AS w FROM documents), e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d WHERE len(w) >= 5) SELECT doc_id, least(pos // (n // 5), 4) AS segment, "
    + ", ".join(f"round(avg(CAST(word IN ({', '.join(repr(x) for x in words)}) AS DOUBLE)), 4) AS {name}" for name, words in T.ARC_WORDS.items()) + " FROM e GROUP BY ALL",
    "tfidf_top_terms": "WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _WORDS.format("text") + """) AS term FROM documents) WHERE length(term) >= 3 GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
        s AS (SELECT doc_id, term, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0), 6) AS score FROM t JOIN f USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s)
        SELECT doc_id, rank, term, round(score, 3) AS score FROM r WHERE rank <= 5""",
    "shared_lines": _LINE + "SELECT md5(text) AS digest, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM line WHERE length(text) >= 20 GROUP BY text HAVING count(DISTINCT doc_id) > 1",
    "speaker_verbs": _LINE + r""", v AS (SELECT regexp_extract(text, '" ?(said|whispered|asked|dit|sagte|dijo) ([^\s,.;"]+)', 1) AS verb, regexp_extract(text, '" ?(said|whispered|asked|dit|sagte|dijo) ([^\s,.;"]+)', 2) AS speaker FROM line)
        SELECT verb, speaker, count(*) AS n FROM v WHERE verb <> '' GROUP BY ALL""",
}
