import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import alignment, intervals, segments, vectors
from lexiloom.plans import catalogue, q_signals
from lexiloom.sources import files
from lexiloom.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("word1   word2\t\tword3", "word1 word2 word3"), ("para1\n\n\npara2", "para1\n\npara2"), ("“x”", '"x"'), (None, None), ("", "")])
def test_normalised(spark, text, want):
    got = value(spark, T.normalised(F.lit(text).cast("string")))
    assert got == want and value(spark, T.normalised(F.lit(got).cast("string"))) == want


def test_paragraph_offsets(spark):
    docs = spark.createDataFrame([(1, "First paragraph.\n\nSecond paragraph.\n\nThird paragraph."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["start"], r["end"]) for r in segments.paragraphs(docs).orderBy("start").collect()] == [(0, 16), (18, 35), (37, 53)]


def test_density(spark):
    spans = spark.createDataFrame([("t", 0, 100), ("t", 50, 150), ("t", 900, 1000), ("t", 5, None)], "k string, start long, end long")
    assert {r["bin"]: r["n"] for r in intervals.density(spans, ["k"], F.lit(1000), 10).collect()} == {0: 2, 1: 1, 9: 1} | dict.fromkeys(range(2, 9), 0)


def test_interval_join_against_nested_loops(spark):
    rng = np.random.default_rng(1)
    a = [(int(rng.integers(0, 2)), int(s), int(s + rng.integers(0, 60)), i) for i, s in enumerate(rng.integers(-200, 200, 60))]
    b = [(int(rng.integers(0, 2)), int(s), int(s + rng.integers(0, 90)), i) for i, s in enumerate(rng.integers(-200, 200, 60))]
    got = intervals.interval_join(spark.createDataFrame(a, "k int, start long, end long, i int"), spark.createDataFrame(b, "k int, r_start long, r_end long, j int"), ["k"], width=16)
    want = {(i, j) for k, s, e, i in a for m, t, u, j in b if k == m and s < e and t < u and s < u and e > t}
    rows = [(r["i"], r["j"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_interval_join_of_huge_spans(spark):
    a = [(1, 0, 2**40, 0), (1, 5, 9, 1), (1, -(2**50), 2**50, 2), (1, 7, 7, 3), (1, None, 4, 4)]
    b = [(1, 2**39, 2**39 + 10, 0), (1, 0, 2**41, 1), (1, 8, 10, 2)]
    got = intervals.interval_join(spark.createDataFrame(a, "k int, start long, end long, i int"), spark.createDataFrame(b, "k int, r_start long, r_end long, j int"), ["k"])
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


@pytest.mark.parametrize("width", [16, 1 << 16])
def test_asof_and_nearest_against_loops(spark, width):
    rng = np.random.default_rng(3)
    points = [(int(rng.integers(0, 2)), int(x), i) for i, x in enumerate(rng.integers(-300, 300, 80))]
    marks = [(int(rng.integers(0, 3)), int(x), f"m{x}") for x in set(rng.integers(-250, 250, 30).tolist())]
    p, m = spark.createDataFrame(points, "k int, x long, i int"), spark.createDataFrame(marks, "k int, at long, v string")
    for forward in (False, True):
        want = {}
        for k, x, i in points:
            fit = [(a, v) for q, a, v in marks if q == k and (a >= x if forward else a <= x)]
            want[i] = (min(fit) if forward else max(fit))[1] if fit else None
        assert {r["i"]: r["v"] for r in intervals.asof_join(p, m, ["k"], "x", "at", "v", forward, width).collect()} == want
    near = {r["i"]: r["v"] for r in intervals.nearest(p, m, ["k"], "x", "at", "v", 20).collect()}
    for k, x, i in points:
        fit = [(abs(a - x), a, v) for q, a, v in marks if q == k and abs(a - x) <= 20]
        assert near[i] == (min(fit)[2] if fit else None)


@pytest.mark.parametrize("width", [16, 1 << 16])
def test_flatten_and_active_sets(spark, width):
    rng = np.random.default_rng(4)
    spans = [(int(rng.integers(0, 2)), int(s), int(s + rng.integers(0, 70)), i) for i, s in enumerate(rng.integers(-100, 100, 40))]
    df = spark.createDataFrame(spans, "k int, start long, end long, i int")
    got = {(r["k"], r["start"], r["end"]): r["active"] for r in intervals.flatten(df, "k", "i", width).collect()}
    want = {}
    for k in (0, 1):
        bounds = sorted({x for q, s, e, _ in spans if q == k and s < e for x in (s, e)})
        for a, b in zip(bounds, bounds[1:], strict=False):
            ids = sorted(i for q, s, e, i in spans if q == k and s < b and e > a)
            if ids:
                want[k, a, b] = ids
    assert got == {k: len(v) for k, v in want.items()}
    assert {(r["k"], r["start"], r["end"]): r["ids"] for r in intervals.active_sets(df, "k", "i").collect()} == want


def test_clean_text(spark):
    text = "Œuvre \u0085and ﬁne\u200a“x”—y…\nbro-\n  ken mé-\n\n lange\n 12 \nISBN: 978-3\nDistributed Proofreaders\n\n\n\nend\u00a0"
    assert value(spark, T.cleaned(F.lit(text))) == 'OEuvre and fine "x"--y...\nbroken mélange\n\nend'
    assert value(spark, T.normalised(F.lit("e\u0301 \u00a0\n«a»\u00a0"))) == 'é\n"a"'


def test_paragraphs_after_many_line_ends(spark):
    docs = spark.createDataFrame([(1, "\n\n\na\nb\n\n\n  c \n\n \n\nd\n")], "doc_id long, text string")
    assert [(r["start"], r["end"], r["text"]) for r in segments.paragraphs(docs).orderBy("start").collect()] == [(3, 6, "a\nb"), (9, 13, "c"), (18, 20, "d")]


def test_alignment():
    assert alignment.local_alignment(np.eye(20)) == (20.0, 0, 20, 0, 20)
    assert alignment.local_alignment(np.zeros((10, 10))) is None
    block = np.zeros((20, 20))
    block[5:10, 8:13] = 0.9
    score, *where = alignment.local_alignment(block)
    assert round(score, 6) == 4.0 and where == [5, 10, 8, 13]
    match = np.equal.outer(np.array(list("XXABCXX")), np.array(list("YYABCYY"))).astype(float)
    assert alignment.local_alignment(match) == (3.0, 2, 5, 2, 5)


def test_word_alignments_are_whole(spark, tmp_path):
    """A passage at the tail of one chunk and the head of the next, one over word 1,000, and both of them."""
    words = lambda mark, n: [mark + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(n)]
    a, b = words("k", 1500), words("m", 1200)
    a[1400:1420] = b[10:30] = words("x", 20)
    a[990:1010] = b[995:1015] = words("y", 20)
    rows = [(1, "s", 0, " ".join(a)), (2, "s", 1, " ".join(b))]
    spark.createDataFrame(rows, "chunk_id long, source_path string, chunk_index int, text string").write.parquet(str(tmp_path / "text_cleaner.parquet"))
    found = {tuple(r) for r in q_signals.word_alignments(spark, str(tmp_path)).collect()}
    assert found == {(1, 2, 20.0, 1400, 1420, 10, 30), (1, 2, 20.0, 990, 1010, 995, 1015)}


def test_edition_changes(spark):
    pairs = spark.createDataFrame([("e", ["Hello", "World"], ["Hello", "Earth", "New"])], "id string, a array<string>, b array<string>")
    assert {r["change"]: r["n"] for r in alignment.edition_changes(pairs).collect()} == {"unchanged": 1, "replaced": 1, "inserted": 1, "deleted": 0}


def test_similar_pairs(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)]
    got = vectors.similar_pairs(spark.createDataFrame(rows, "i long, v array<double>"), 0.5, block=2)
    assert [(r["i"], r["j"]) for r in got.collect()] == [(0, 1)]


def test_literal_hits_overlap(spark):
    docs = spark.createDataFrame([(1, "aXaa aaa"), (2, None)], "doc_id long, text string")
    assert sorted(r["start"] for r in segments.literal_hits(docs, "aa").collect()) == [2, 5, 6]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("naïve".encode("latin-1"))
    assert files.read_texts(spark, str(tmp_path / "t")).first()["text"] == "naïve"
    html = spark.createDataFrame([(1, "<p>a<script>x</script></p><div>b &amp; c</div>"), (2, None)], "page_id int, html string")
    assert [r["text"] for r in files.html_texts(html).orderBy("page_id").collect()] == ["a\n\nb & c", None]
    src = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, id) AS ts, 'x' AS event_type, 1.0D AS value FROM range(4)")
    src.write.parquet(str(tmp_path / "src"))
    events.run_available(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_catalogue_is_consistent():
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert len(queries) > 45 and set(sql) <= set(queries)
