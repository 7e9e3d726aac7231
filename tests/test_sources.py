import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import books, exports, files
from lexiloom.tracks import Registry, Track, default


def epub(chapters, identifier="urn:uuid:12345678-1234-1234-1234-123456789abc"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/a.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.html"/>' for i in range(len(chapters)))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
        z.writestr("OEBPS/a.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>The Book</dc:title><dc:creator>Ann Zell</dc:creator><dc:identifier>978-0-123-45678-6</dc:identifier><dc:identifier>{identifier}</dc:identifier></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for i, body in enumerate(chapters):
            z.writestr(f"OEBPS/c{i}.html", f"<html><head><title>x</title></head><body>{body}</body></html>")
    return out.getvalue()


def test_epub(spark):
    first = '<h1>One</h1><p>It was <b>night</b>.<a id="sdendnote1anc">1</a></p><script>no</script>'
    second = '<h2>Notes</h2><p><a id="sdendnote1sym">1</a> A note.</p><p><a id="sdendnote2sym">2</a> Lost.</p>'
    rows = spark.createDataFrame([("a", bytearray(epub([first, second]))), ("b", bytearray(b"no zip"))], "path string, content binary")
    out = {r["path"]: r for r in books.epub_books(rows).collect()}
    a = out["a"]
    assert (a["title"], a["author"], a["language"], a["isbn"], a["uuid"][:8], a["error"]) == ("The Book", "Ann Zell", "en", "978-0-123-45678-6", "urn:uuid", None)
    assert a["text"] == "One\n\nIt was night.1\n\nNotes\n\n1 A note.\n\n2 Lost.\n\n"
    assert [(h["level"], a["text"][h["start"] : h["end"]]) for h in a["headings"]] == [(1, "One"), (2, "Notes")]
    assert out["b"]["text"] is None and "BadZipFile" in out["b"]["error"]
    notes = {r["number"]: (r["call_at"], r["note_at"]) for r in books.resolved_notes(books.epub_books(rows).where("error IS NULL")).collect()}
    assert notes[1][0] == a["text"].index("1") and notes[1][1] > notes[1][0] and notes[2][0] == -1


def test_read_any(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.md").write_text("# Head\n**bold** [link](x) ![pic](y)\n- item\n1. one `code`")
    (tmp_path / "c.html").write_text("<p>x</p><p>y</p>")
    (tmp_path / "d.epub").write_bytes(epub(["<p>z</p>"]))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f").write_text("?")
    out = {r["format"]: (r["text"], r["error"]) for r in books.read_any(spark, str(tmp_path)).collect()}
    assert out == {"text": ("plain", None), "markdown": ("Head\nbold link !pic\nitem\none code", None), "html": ("x\n\ny", None), "epub": ("z\n\n", None), "pdf": (None, "no reader for pdf"), "unknown": (None, "no reader for unknown")}


def test_verses(spark):
    lines = ["head", "40:001:001 The book", "of it", "", "40:001:002 Abraham"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert {r["verse"]: r["text"] for r in books.verses(df).collect()} == {"40:001:001": "The book of it", "40:001:002": "Abraham"}


def test_annotations_round_trip(spark, tmp_path):
    rows = spark.sql("SELECT 'a1' AS id, 'topics' AS track, 5L AS start, 9L AS end, struct('t' AS type, 'v' AS value) AS body, struct('s' AS source, struct('TextPositionSelector' AS type, 5L AS start, 9L AS end) AS selector) AS target, 0.5D AS confidence, 'E3' AS evidenceLevel, 'c' AS creator")
    files.write_annotations(rows, str(tmp_path / "out"))
    (tmp_path / "topics.jsonl").write_text("\n".join(p.read_text() for p in (tmp_path / "out").rglob("*.json")) + "\n{broken\n")
    got = files.read_annotations(spark, str(tmp_path / "topics.jsonl")).collect()
    assert [(r["id"], r["track"], r["start"], r["end"], r["confidence"], r["evidence_level"]) for r in got] == [("a1", "topics", 5, 9, 0.5, "E3")]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_annotations(spark, str(tmp_path / "topics.jsonl"), strict=True).collect()


def test_paf(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t", "form.clause", 5, 9, 0.5, "E3", "c", "v" * 300, {"b": "2", "a": None}), (2, "t", None, None, 9, 2.0, "E9", None, None, {}), (3, "u", "x", 9, 5, None, "E1", "c", "", None)], "ann_id long, track string, lfo_type string, start_pos long, end_pos long, confidence double, evidence_level string, creator string, body_value string, extra map<string,string>")
    table = {r["annotation_id"]: r for r in exports.paf(rows).collect()}
    assert table["1"]["attributes"] == "a=;b=2" and len(table["1"]["value"]) == 200 and table["2"]["attributes"] == table["2"]["lfo_type"] == table["3"]["value"] == "."
    exports.write_paf(rows, str(tmp_path / "paf"))
    lines = spark.read.text(str(tmp_path / "paf")).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no")).unionByName(spark.createDataFrame([("# head", 90), ("", 91), ("a\tb", 92)], "line string, line_no long"))
    errors = sorted((r["error"]) for r in exports.paf_errors(lines, ["form.clause"]).collect())
    assert errors == sorted(["unknown term", "offsets are no integers", "confidence out of range", "unknown evidence level", "unknown term", "start not before end", "confidence is no number", "expected 10 columns"])
    keys = exports.extra_keys(rows)
    assert keys == ["a", "b"] and [r["extra_b"] for r in exports.csv_rows(rows.withColumn("body_type", F.lit("p:T")), keys).orderBy("id").collect()] == ["2", "", ""]


def test_annotation_rules(spark):
    import copy
    import json

    good = {"@context": "http://www.w3.org/ns/anno.jsonld", "id": "x", "type": "Annotation", "body": {"type": "t"}, "target": {"source": "s", "selector": {"type": "TextPositionSelector", "start": 1, "end": 2}}, "creator": "c", "confidence": 0.5, "evidenceLevel": "E1"}
    cases = {"good": good}
    for k in good:
        cases["no " + k] = {a: b for a, b in good.items() if a != k}
    for name, path, to in [("start", ("target", "selector", "start"), 5), ("text", ("target", "selector", "start"), "x"), ("body", ("body",), "text"), ("high", ("confidence",), 1.5), ("word", ("confidence",), "much"), ("level", ("evidenceLevel",), "E7"), ("below", ("target", "selector", "start"), -1)]:
        bad = copy.deepcopy(good)
        at = bad
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = to
        cases[name] = bad
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "id string, json string")
    found = {}
    for r in exports.annotation_errors(df).collect():
        found.setdefault(r["id"], []).append(r["error"])
    assert set(found) == set(cases) - {"good"} and found["start"] == ["start after end"] and found["below"] == ["negative start"] and found["word"] == ["confidence is no number"]


def test_registry(spark, tmp_path):
    made = []

    def track(name, *needs):
        return Track(name, lambda s, d: (made.append(name), s.range(1))[1], needs)

    r = Registry([track("b", "a"), track("c", "b", "_outside"), track("a")])
    assert r.order() == ["a", "b", "c"] and r.order(["b"]) == ["a", "b"]
    assert r.analyse(spark, "", str(tmp_path)) == dict.fromkeys("abc", "made") and made == ["a", "b", "c"]
    assert r.analyse(spark, "", str(tmp_path)) == dict.fromkeys("abc", "computed") and made == ["a", "b", "c"]
    with pytest.raises(ValueError, match="need each other"):
        Registry([track("x", "y"), track("y", "x")]).order()
    with pytest.raises(KeyError):
        r.order(["z"])
    with pytest.raises(ValueError, match="already"):
        r.register(track("a"))
    rows = spark.createDataFrame([("p", "a")], "project_id string, t string")
    status = {(x["project_id"], x["track"]): x["status"] for x in r.status(spark, rows, "project_id", "t", spark.createDataFrame([("p",), ("q",)], "project_id string")).collect()}
    assert status["p", "a"] == "computed" and status["p", "b"] == status["q", "a"] == "pending" and len(status) == 6
    assert default().order()
