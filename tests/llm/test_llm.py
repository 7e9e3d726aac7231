"""Each operator against brute force, round trips or hand-made cases, with nulls, empties, repeats and clashing names."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from lexiloom.llm import chunks, lookalikes, names, neighbours, packing, queries, scans, spans, tokens


def form(text):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out, _ = lookalikes.canonical_codes(codes, np.zeros(len(codes), int), lookalikes.mapping())
    return out.astype(np.uint32).tobytes().decode("utf-32-le")


def test_canonical_is_nfc_for_latin_marks():
    rng = random.Random(3)
    marks = [chr(c) for c in (0x301, 0x323, 0x307, 0x308, 0x304, 0x327)]
    for _ in range(500):
        text = "a" + "".join(rng.choice(["a", "o", "e", "u", *marks]) for _ in range(8))
        assert form(unicodedata.normalize("NFD", text)) == form(text) == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize(("a", "b", "same"), [("Ｆêｔｅ　ﬁn", "Fête fin", True), ("cоmpаss", "compass", True), ("a​b­c", "abc", True), ("toll‐bridge", "toll-bridge", True), ("Abc", "abc", False), ("e", "é", False), ("beſore", "besore", False), ("a\nb", "a b", False), ("한국", unicodedata.normalize("NFD", "한국"), True)])
def test_forms(a, b, same):
    assert (form(a) == form(b)) == same


def test_alike_pairs(spark):
    rows = [(1, "a b"), (2, "a b"), (2, "a b"), (3, "a b"), (4, None), (5, ""), (6, "​"), (7, "A b"), (None, "a b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, t string, raw int")
    assert {tuple(r) for r in lookalikes.alike_pairs(df, "id", "t").collect()} == {(1, 2), (2, 3)}
    assert lookalikes.alike_pairs(df.limit(0), "id", "t").collect() == []


def test_bisect_covers_and_fits():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc defg. \n。！x") for _ in range(rng.randint(0, 3000)))
        limit, overlap = rng.choice([1, 2, 10, 100, 500]), rng.choice([0, 1, 5, 40, 300])
        pieces = chunks.bisect(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b - a <= limit for a, b in pieces)
        assert all(q[0] <= p[1] < q[1] for p, q in zip(pieces, pieces[1:], strict=False))


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, "one two three. four five", 10, 2), (2, None, 5, 1), (3, "", 5, 1), (4, "long text", None, None), (5, "long text", 0, 1)], "id long, piece string, m int, o int")
    out = {}
    for r in chunks.split_oversized(df, "id", "piece", "m", "o").collect():
        out.setdefault(r["id"], []).append(r["piece"])
    assert set(out) == {1, 3, 4, 5} and len(out[1]) > 2 and out[3] == [""] and out[4] == out[5] == ["long text"]


def test_names():
    def linked(*texts, org=False):
        parsed = [names.parse(t, 1, org, {"sam": frozenset(["samuel"])}) for t in texts]
        return {frozenset(x.text for x in g) for g in names.resolve(parsed)}

    assert linked("Samuel Daskmoor", "Sam Daskmoor", "Daskmoor, S.", "SAMUEL DASKMOOR", "Dr. Daskmoor") == {frozenset(["Samuel Daskmoor", "Sam Daskmoor", "Daskmoor, S.", "SAMUEL DASKMOOR", "Dr. Daskmoor"])}
    assert len(linked("Ann Zell Jr.", "Ann Zell Sr.")) == 2
    assert len(linked("Tobias Daskmoor", "Samuel Daskmoor")) == 2
    assert len(linked("Jarrport Railway Association", "JRA", "Railway Association of Jarrport", "Jarrport Railway Association Ltd.", "Tarnlake Railway Association", org=True)) == 2


def test_link_names(spark):
    rows = [("p", "Samuel Daskmoor", "PER"), ("p", "Samuel Daskmoro", None), ("p", "Daskmoor, S.", "PERSON"), ("p", None, "PER"), ("p", "the old miller", None), (None, "Samuel Daskmoor", "PER"), ("q", "Samuel Daskmoor", "PER")]
    df = spark.createDataFrame([(*r, 1) for r in rows * 2], "scope string, name string, kind string, entity int")
    short = spark.createDataFrame([("Samuel", "Sam"), (None, "X")], "given_name string, short_name string")
    pairs = {tuple(r) for r in names.linked_pairs(names.link_names(df, short)).collect()}
    assert pairs == {("p", "Daskmoor, S.", "Samuel Daskmoor"), ("p", "Daskmoor, S.", "Samuel Daskmoro"), ("p", "Samuel Daskmoor", "Samuel Daskmoro")}


@pytest.mark.parametrize("text", ["see " + "x" * 60, "x" * 60 + " end", "so it is " + "x" * 60 + " at last"])
def test_long_runs_are_cut_off_whole(text):
    pieces = [text[a:b] for a, b in chunks.bisect(text, 62, 0)]
    assert "".join(pieces) == text and all(len(p) <= 62 for p in pieces) and any("x" * 60 in p for p in pieces)


def test_canonical_forms_of_both_fields(spark, tmp_path):
    spark.createDataFrame([(1, "a  b")], "quote_id long, exact string").write.parquet(str(tmp_path / "quote_selectors.parquet"))
    spark.createDataFrame([(1, "ﬁne"), (2, None)], "chunk_id long, text string").write.parquet(str(tmp_path / "text_cleaner.parquet"))
    rows = {tuple(r) for r in queries.p1_canonical(spark, str(tmp_path)).collect()}
    assert rows == {("quote_selectors.exact", 1, "a b"), ("text_cleaner.text", 1, "fine"), ("text_cleaner.text", 2, None)}


def test_link_names_of_large_blocks(spark):
    """A surname misspelt within, in blocks of over BLOCK names that the given name is misspelt in too."""
    consonants = "bdfgklmnprstvz"
    others = [f"K{a}{b}on R{a}{b}{c}okeld" for i, (a, b, c) in enumerate(itertools.product(consonants, repeat=3)) if i % 23 == 0][: 2 * names.BLOCK]
    rows = [("p", name, "PER") for name in ["Konstantin Rookivakeld", "Konstantni Rookivvakeld", *others]]
    short = spark.createDataFrame([("Samuel", "Sam")], "given_name string, short_name string")
    linked = names.link_names(spark.createDataFrame(rows, "scope string, name string, kind string"), short)
    entity = {r["name"]: r["entity"] for r in linked.collect()}
    assert len(entity) == len(rows) and entity["Konstantin Rookivakeld"] == entity["Konstantni Rookivvakeld"]


def test_page_lines():
    lines = ["THE IDLE SIGNET · 35", "In the rain the weaver whi-", "spered of 12", "pears near the piso", "228.", "", "- 36 -"]
    page = scans.read_page(lines)
    assert page.headers == [0] and page.numbers == [6]


def test_faults(spark):
    good = "the weaver whispered of every kettle and the kettle was near the moon-lit bridge"
    page = "THE IDLE SIGNET\nThe weaver whi-\nspered of cvery kettle near the moon-\nlit bridge.\n[12]"
    pages = spark.createDataFrame([("f", 1, page), ("f", 1, page), ("f", 2, None), ("f", 3, "")], "field string, record_id long, text string")
    corpus = spark.createDataFrame([(good,)] * 20 + [(page,), (None,), ("",)], "text string")
    faults = scans.find_faults(pages, corpus)
    assert {(r["line_no"], r["noise"]) for r in faults.collect()} == {(0, "header"), (1, "hyphen"), (2, "misread"), (4, "pageno")}
    fixed = {r["record_id"]: r["repaired"] for r in scans.repair(pages.distinct(), faults).collect()}
    assert fixed == {1: "The weaver whispered of every kettle near the moon-lit bridge.", 2: None, 3: ""}


def test_two_confusions(spark):
    rows = [("possessions", 9), ("p055e55i0ns", 1), ("modern", 30), ("rnodem", 3), ("chosen", 30), ("cb0sen", 1), ("tbe", 20), ("the", 90), ("zz0101015", 1)]
    found, chances = scans.suspects(spark.createDataFrame(rows, "word string, n long"))
    assert chances["b>h"] > chances["rn>m"] > 0
    found = {r["word"]: {(x["printed"], x["errors"]) for x in r["readings"]} for r in found.collect()}
    assert found == {"p055e55i0ns": {("possessions", 6)}, "rnodem": {("modern", 2)}, "cb0sen": {("cbosen", 1), ("chosen", 2)}, "tbe": {("the", 1)}}


def test_short_odd_words(spark):
    good = "the weaver of every kettle whispered that he was near one 5th bridge in 10 or 5m of water"
    page = "The weaver 0f every kettle whispered that 5he\nwas near 0ne 5th bridge 1n 10 or 5m of water."
    pages = spark.createDataFrame([("f", 1, page)], "field string, record_id long, text string")
    she = good.replace(" he ", " she ")
    faults = scans.find_faults(pages, spark.createDataFrame([(she,)] * 20 + [(page,)], "text string")).collect()
    assert {(r["line_no"], r["word"], r["printed"]) for r in faults} == {(0, "0f", "of"), (0, "5he", "she"), (1, "0ne", "one"), (1, "1n", "in")}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "m", [float(x) for x in rng.normal(size=8)], 8) for i in range(300)]
    rows += [rows[0], (900, "m", None, 8), (901, "m", [0.0] * 8, 8), (902, "m", [float("nan")] * 8, 8), (903, "m", [1.0], 8), (904, None, [1.0] * 8, 8)]
    index = neighbours.usable(spark.createDataFrame(rows, "id long, model string, v array<float>, d int"), "id", "v", "d", "model")
    asked = spark.createDataFrame([(1, 5), (2, 3), (900, 5), (3, 0), (4, None), (904, 2)], "id long, k int")
    found = {(r["id"], r["other"]) for r in neighbours.most_similar(index, asked).collect()}
    true = {(r["id"], r["other"]) for r in neighbours.brute_force(index, asked).collect()}
    assert found == true and len(true) == 8


@pytest.mark.parametrize("head", [1 << 17, 3])
def test_tokens(spark, head):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    rows = [(1, "a b  c　d \n\n e's we'll 🐉 x² <|endoftext|> \x85 z"), (2, None), (3, ""), (4, " "), (5, "twice"), (5, "twice"), (6, "x" * 5000 + " й слово"), (7, "ab\U00031350c 3\U0001e4f0 \U0001fae8 z\U0001e4d0y")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "id long, t string, ids int")
    encoded = tokens.encode(docs, "id", "t", head_words=head)
    want = sorted((i, tokenizer.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)
    assert sorted((r["id"], r["ids"]) for r in encoded.collect()) == want
    back = {r["id"]: r["text"] for r in tokens.decode(encoded.where("id <> 5"), "id").collect()}
    assert back == {i: t or "" for i, t in rows if i != 5}
    assert tokens.encode(docs.limit(0), "id", "t", head_words=head).collect() == []


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 7, 7, 7, rng.randint(1, 250)])) for i in range(500)]
    out = packing.pack(spark.createDataFrame(rows, "id long, n int"), "id", "n", 100).toPandas()
    assert out.groupby("id").part_size.sum().to_dict() == {i: n or 0 for i, n in rows}
    used = out.dropna().groupby("container").part_size.sum()
    assert used.max() <= 100 and len(used) <= 1.03 * used.sum() / 100 + 1
    assert (out.groupby("id").size()[[i for i, n in rows if (n or 0) <= 100]] == 1).all()
    assert packing._Room({60: 1, 40: 1, 25: 2}, 60, 100).fullest() == ((40, 1),)
    whole = packing.pack(spark.createDataFrame([(1, 300), (2, 100), (2, 100), (3, 50)], "id long, n int"), "id", "n", 100, per_salt=1).toPandas()
    assert sorted(whole.part_size) == [50, 100, 100, 100, 100, 100] and sorted(whole.container) == [0, 1, 2, 3, 4, 5] and (whole.part_start == whole.part * 100).all()
    assert packing.pack(spark.createDataFrame([], "id long, n int"), "id", "n", 100).collect() == []


def test_shared_spans(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    texts = {i: " ".join(word() for _ in range(120)) for i in range(12)}
    piece = " ".join(word() for _ in range(60))
    for i in (1, 2, 3):
        cut = rng.randint(0, 60)
        texts[i] = texts[i][:200] + piece[cut : cut + 260 - i] + texts[i][200:]
    texts |= {20: piece[:119], 21: piece[:119], 22: texts[5], 23: piece + piece, 24: None, 25: "", 26: "z" * 400, 27: "z" * 130}
    where = {}
    for i, t in texts.items():
        for p in range(len(t or "") - 119):
            where.setdefault(t[p : p + 120], set()).add(i)
    want = set()
    for i, t in texts.items():
        covered = sorted({q for p in range(len(t or "") - 119) if len(where[t[p : p + 120]]) > 1 for q in range(p, p + 120)})
        for q in covered:
            if q - 1 not in covered:
                start = q
            if q + 1 not in covered:
                want.add((i, start, q + 1))
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(5, texts[5], 1), (None, piece, 1)], "id long, t string, anchor int")
    assert {tuple(r) for r in spans.shared_spans(docs, "id", "t").collect()} == want
    assert spans.shared_spans(docs.limit(0), "id", "t").collect() == []


def test_remove_repeated_sentences(spark):
    run = "".join(f"This is the long sentence number {i} of the run that repeats. " for i in range(3))
    df = spark.createDataFrame([(1, run + "End."), (2, "Start of two. " + run), (3, None), (4, "Short.")], "id long, t string")
    out = {r["id"]: (r["text"], r["removed"]) for r in spans.remove_repeated_sentences(df, "id", "t").collect()}
    assert out == {1: (run + "End.", 0), 2: ("Start of two. ", 3), 3: (None, 0), 4: ("Short.", 0)}


def test_neighbours_in_parts(spark):
    """Clustered vectors fall into parts, of which a query meets few; the table scan orders as the product does."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, "m", [float(x) for x in centres[i % 12] + 0.1 * rng.normal(size=16)], 16) for i in range(3000)]
    index = neighbours.usable(spark.createDataFrame(rows, "id long, model string, v array<double>, d int"), "id", "v", "d", "model")
    x = np.stack([r[2] for r in rows]) / np.linalg.norm([r[2] for r in rows], axis=1, keepdims=True)
    model = neighbours.learn(x.astype(np.float32), 3000, 10, 0.3, 250, 100, 4, 0.99)
    assert len(model.centres) == 12 and model.probes < 12
    table = neighbours.tables(x[:3], model.books)
    codes = neighbours.assign(x.astype(np.float32), model.books, 2.0)
    sums = neighbours.scan_tables(table, neighbours.pack_codes(codes).T.astype(np.intp))
    decoded = model.books[np.arange(8)[None], codes].reshape(3000, -1)
    assert all(np.corrcoef(a, b)[0, 1] > 0.999 for a, b in zip(sums, x[:3] @ decoded.T, strict=True))
    asked = spark.createDataFrame([(i, 10) for i in range(0, 3000, 100)], "id long, k int")
    found = {(r["id"], r["other"]) for r in neighbours.most_similar(index, asked, rows_per_part=250, rows_per_block=100, queries_per_block=8, rerank_least=50).collect()}
    true = {(r["id"], r["other"]) for r in neighbours.brute_force(index, asked, 1000, 8).collect()}
    assert len(found & true) >= 0.9 * len(true) and len(found) == len(true) == 300


@pytest.mark.parametrize("others", [20, 70, 3 * names.BLOCK])
def test_links_do_not_depend_on_block_size(spark, others):
    consonants = "bdfgklmnprstvz"
    made = itertools.product(consonants, repeat=3)
    crowd = [f"S{a}{b}rel D{b}{c}{a}koor" for a, b, c in itertools.islice(made, others)]
    rows = [("p", name, "PER") for name in ["Spyopq Dasmkoor", "Spyopu Daskmoor", *crowd]]
    short = spark.createDataFrame([("Samuel", "Sam")], "given_name string, short_name string")
    entity = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame(rows, "scope string, name string, kind string"), short).collect()}
    assert len(entity) == len(rows) and entity["Spyopq Dasmkoor"] == entity["Spyopu Daskmoor"]


def test_names_without_capitals(spark):
    rows = [("p", "Samuel Daskmoor", "PER"), ("p", "samuel daskmoor", None), ("p", "王小明", "PER"), ("p", "de Grey Marcus", None), ("p", "Marcus de Grey", "PER"), ("p", "the old miller", "PER"), ("p", "both sisters", None), ("p", "ann zell", "PER"), ("p", "market", "LOC"), ("p", "  ", "PER")]
    short = spark.createDataFrame([], "given_name string, short_name string")
    out = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame(rows, "scope string, name string, kind string"), short).collect()}
    assert set(out) == {"Samuel Daskmoor", "samuel daskmoor", "王小明", "de Grey Marcus", "Marcus de Grey", "ann zell"}
    assert out["samuel daskmoor"] == out["Samuel Daskmoor"]


def test_compatible_pairs_are_all(spark):
    rng = random.Random(8)
    texts = [f"{rng.choice(['Samuel', 'Sam', 'S.', 'Tobias', 'Samule'])} {rng.choice(['Daskmoor', 'Dasmkoor', 'Zell', 'Zelll', 'Pellport'])}" for _ in range(40)] + ["Zell", "Daskmoor, S."]
    orgs = ["Jarrport Railway Association", "JRA", "J. Railway Association", "Railway Association of Jarrport", "Jarrprot Railway Association", "Tarnlake Railway Association", "TRA"]
    for parsed in ([names.parse(t, 1, False, {}) for t in set(texts)], [names.parse(t, 1, True, {}) for t in orgs]):
        want = {frozenset((a.text, b.text)) for a, b in itertools.combinations(parsed, 2) if names.compatible(a, b)}
        assert {frozenset((a.text, b.text)) for a, b in names.compatible_pairs(parsed)} == want
        half = len(parsed) // 2
        across = {frozenset((a.text, b.text)) for a in parsed[:half] for b in parsed[half:] if names.compatible(a, b)}
        assert {frozenset((a.text, b.text)) for a, b in names.compatible_pairs(parsed[:half], parsed[half:])} == across


def test_repair_is_by_line():
    """A misreading of one line says nothing of the same word elsewhere."""
    faults = [{"line_no": 0, "noise": "misread", "word": "bear", "printed": "hear"}]
    assert scans.mended("I bear you.\nThe bear ran.", faults) == "I hear you. The bear ran."
    broken = [{"line_no": 0, "noise": "hyphen", "word": "whispcred", "printed": None}, {"line_no": 1, "noise": "misread", "word": "whispcred", "printed": "whispered"}]
    assert scans.mended("he whi-\nspcred.\n\nEnd whispcred", broken) == "he whispered.\n\nEnd whispcred"


def test_chapter_headings_stay():
    assert scans.read_page(["Chapter One", "It was the night.", "3"]).headers == []
    assert scans.read_page(["Chapter One   3", "It was the night."]).headers == [0]
    assert scans.read_page(["THE IDLE SIGNET", "It was the night."]).headers == [0]


def test_long_lines_are_linear():
    line = " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{i % 97}x" for i in range(100_000))
    rows = list(scans.page_rows(line))
    assert sum(len(r[4] or ()) for r in rows) == 100_000
    words = rows[-1][4]
    assert len(scans.decode(words, {words[0]: [("x", -1.0, 3)]}, {}, {}, 1000)) == 100_000


def _fewest(items, capacity):
    """The least number of containers, by trying them all."""
    best, items = len(items), sorted(items, reverse=True)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                put(i + 1, [*rest, room - items[i]])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best


def test_fill_plan_is_exact_when_asked():
    rng = random.Random(9)
    for _ in range(60):
        items = [rng.randint(15, 70) for _ in range(rng.randint(1, 9))]
        histogram = {s: items.count(s) for s in items}
        for plan in (packing.fill_plan(histogram, 100, None), packing.fill_plan(histogram, 100)):
            held = {s: sum(n * dict(f).get(s, 0) for f, n in plan.plan) for s in histogram}
            assert held == histogram and all(sum(s * n for s, n in f) <= 100 for f, _ in plan.plan)
            assert plan.least <= _fewest(items, 100) <= plan.containers == sum(n for _, n in plan.plan)
        assert packing.fill_plan(histogram, 100, None).containers == _fewest(items, 100)


def test_fullest_filling_by_brute_force():
    rng = random.Random(10)
    for _ in range(60):
        counts = {rng.randint(3, 60): rng.randint(1, 3) for _ in range(7)}
        largest = max(counts)
        others = [s for s, n in counts.items() for _ in range(n - (s == largest))]
        totals = {sum(c) for k in range(len(others) + 1) for c in itertools.combinations(others, k) if sum(c) <= 100 - largest}
        assert sum(s * n for s, n in packing._Room(counts, largest, 100).fullest()) == max(totals)


@pytest.mark.parametrize(("a", "b"), [("ӏ", "l"), ("Ӏ", "I"), ("ѵ", "v"), ("ѡ", "w"), ("ӕ", "æ"), ("ո", "n"), ("Տ", "S"), ("Ꭺ", "A"), ("ꓮ", "A"), ("Ⅳ", "IV"), ("ǆ", "dž"), ("ĳ", "ij"), ("µ", "μ")])
def test_drawn_alike(a, b):
    assert form(a) == form(b)


def test_form_is_idempotent():
    every = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    changed = [c for c in every if form(form("x" + c + "x")) != form("x" + c + "x")]
    assert changed == []


def test_alike_classes(spark):
    rows = [(1, "a b"), (2, "a\u00a0b"), (2, "a\u00a0b"), (3, "a b"), (4, None), (5, ""), (7, "A b")]
    out = {(r["id"], r["n_links"]) for r in lookalikes.alike_classes(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert out == {(1, 1), (2, 2), (3, 1)}


def test_cuts_before_no_mark_of_any_script():
    text = "कि" * 50
    assert all(text[a] == "क" for a, _ in chunks.bisect(text, 21, 0))


def test_names_of_large_projects(spark):
    """What only many names bring: last names nearly alike, organisations named for the same places as persons, unlisted short forms, words with two typing errors."""
    rows = [("big", t, "PER") for t in ("Walter Cromuloquist", "Augustus Cromulloquist", "Dr. Cromuloquist")]
    # The last name stands in an organisation's in three projects.
    rows += [(f"t{i}", t, "PER") for i in range(5) for t in ("Ignatius Brynhaven", "Ignatius Brynhavrn")] + [(f"t{i}", "Savings Bank of Brynhaven", "ORG") for i in range(3)]
    families = list(zip(("Dunhaven", "Karnrigg", "Whitpool", "Cromsett"), ("Walter", "Ursula", "Tobias", "Matilda"), strict=True))
    rows += [(f"f{i}", f"{given} {last}", "PER") for i, (last, other) in enumerate(families) for given in ("Penelope", "Nell", other)]
    rows += [("org", t, "ORG") for t in ("Yarlund Insurance Office", "Y.I.O.", "YIO", "Yarlund Insurance Oefice", "Yarlund Insurance Offce")]
    rows += [("typed", t, "PER") for t in ("Josephine Strathenozine", "Joesphien Strathenozine", "Jo Strathenozine")]
    rows += [("rare", t, "PER") for t in ("Edward Daskrigg", "Ewdarf Daskrigg", "E. Daskrigg")] + [(f"e{i}", "Edward Holm", "PER") for i in range(9)]
    short = spark.createDataFrame([("Josephine", "Jo")], "given_name string, short_name string")
    linked = names.link_names(spark.createDataFrame(rows, "scope string, name string, kind string"), short)
    entity = {(r["scope"], r["name"]): r["entity"] for r in linked.collect()}
    assert entity["big", "Dr. Cromuloquist"] == entity["big", "Walter Cromuloquist"] != entity["big", "Augustus Cromulloquist"]
    assert all(entity[f"t{i}", "Ignatius Brynhaven"] == entity[f"t{i}", "Ignatius Brynhavrn"] for i in range(5))
    assert all(entity[f"f{i}", f"Nell {last}"] == entity[f"f{i}", f"Penelope {last}"] != entity[f"f{i}", f"{other} {last}"] for i, (last, other) in enumerate(families))
    assert len({v for (scope, _), v in entity.items() if scope == "org"}) == 1
    assert len({v for (scope, _), v in entity.items() if scope == "typed"}) == 1
    assert len({v for (scope, _), v in entity.items() if scope == "rare"}) == 1


def test_misspelt_names_gather_round_the_right_one():
    parsed = [names.parse(t, 1, False, {}, often=often) for t, often in (("Roosalinnd Rookhaven", 1), ("Rosakind Rookhaven", 1), ("Rosalind Rookhaven", 40))]
    assert len(names.resolve(parsed)) == 1


def test_words_are_read_without_the_pairs(spark, monkeypatch):
    """The words are read a dozen times; the pairs, many times as many rows, only once."""
    kept = []
    monkeypatch.setattr(scans, "checkpointed", lambda df: kept.append(names.checkpointed(df)) or kept[-1])
    pages = spark.createDataFrame([("f", 1, "the old mill stood by the river\nthe o1d mill")], "field string, record_id long, text string")
    found = {r["word"]: r["printed"] for r in scans.find_faults(pages, pages.select("text")).collect() if r["noise"] == "misread"}
    assert found == {"o1d": "old"}
    words = [df for df in kept if df.columns == ["word", "n"]]
    assert len(words) == 1 and {r["word"] for r in words[0].collect()} == {"the", "old", "mill", "stood", "by", "river", "o1d"}


@pytest.mark.parametrize("line, titled", [("THE OLD MILL", True), ("The Mill of Karn", True), ("The old mill", False), ("The Mill.", False), ("Mr. Karn", False), ("A", False), ("1 2 3", False), ("X" * 61, False), ("lSLAND AND SEA", True)])
def test_titled_lines(line, titled):
    assert scans._titled(line) is titled


def test_breaks():
    assert scans._BREAK.sub("", "mill-\n stone, mill -\nstone, 1-\n2, Müh¬ \nle, a--\nb") == "millstone, mill -\nstone, 1-\n2, Mühle, a--\nb"


def test_a_first_word_cut_short_does_not_hide_the_whole_one():
    parsed = [names.parse(t, 1, True, {}) for t in ("Brackarnesett Botanical Institute", "The Brackarnesett Botanical Institute", "Brackayosett Botanical Institute", "Brac. Botanical Institute", "Brackarnesett Botanical Inst.", "Bracksyosett Botanical Inst.")]
    groups = {frozenset(x.text for x in g) for g in names.resolve(parsed)}
    assert frozenset(["Brackarnesett Botanical Institute", "The Brackarnesett Botanical Institute", "Brackarnesett Botanical Inst."]) in groups
    assert frozenset(["Brackayosett Botanical Institute", "Bracksyosett Botanical Inst."]) in groups
