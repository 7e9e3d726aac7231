"""Pieces of SQL that several twins share."""

from __future__ import annotations

STRIP = r"regexp_replace({}, '\A[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+\z', '', 'g')"
_LINES = """s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS m FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, m, p, CAST(coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM s)"""
#: line(doc_id, idx, text, start, "end"): the lines that aren't empty.
LINE = _LINES + """, line AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, p AS text, a AS start, a + length(p) AS "end" FROM l WHERE length(p) > 0)"""
#: para(doc_id, idx, start, "end", text): runs of lines that aren't empty; a line end that ends the text belongs to the last.
PARA = _LINES + f""", g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE length(p) > 0),
bl AS (SELECT doc_id, min(a) AS s, max(a + length(p)) AS e, max(i) AS last, any_value(m) AS m, {STRIP.format("string_agg(p, chr(10) ORDER BY i)")} AS t FROM g GROUP BY doc_id, g),
para AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, s AS start, e + CASE WHEN last + 1 = m THEN 1 ELSE 0 END AS "end", t AS text FROM bl WHERE t <> '')"""
#: sent(doc_id, idx, start, "end", text): sentences by their closing marks.
SENT = r"""x AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+') AS x FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM x),
z AS (SELECT doc_id, i, p, CAST(coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, regexp_replace(p, '\A[ \t\n\r\f\v]+', '') AS lt, regexp_replace(p, '\A[ \t\n\r\f\v]+|[ \t\n\r\f\v]+\z', '', 'g') AS t FROM y),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, a + length(p) - length(lt) AS start, a + length(p) - length(lt) + length(t) AS "end", t AS text FROM z WHERE t <> '')"""
