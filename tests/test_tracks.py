import numpy as np
from pyspark.sql import functions as F

from lexiloom.operators import alignment, tracks


def test_dialogue_spans(spark):
    text = '“Go,” said Ann Zell, and left. "Why?" he thought. Bob asked then "Now"\n—never to come back again, he wrote'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted((r["start"], r["text"], r["confidence"], r["speaker"], r["verb"]) for r in tracks.dialogue(docs).collect())
    assert rows[0] == (1, "Go,", 0.92, "Ann", "said") and ("Why?", 0.85) in {r[1:3] for r in rows} and rows[-1][2] == 0.70
    assert all(text[s : s + len(t)] == t for s, t, *_ in rows) and len({r[0] for r in rows}) == len(rows)


def test_name_clusters():
    assert tracks.name_clusters(["Hal", "Hal Incandenza", "Incandenza", "Mario Incandenza", "Ann"]) == {"Hal": "Mario Incandenza", "Hal Incandenza": "Mario Incandenza", "Incandenza": "Mario Incandenza", "Mario Incandenza": "Mario Incandenza", "Ann": "Ann"}


def test_word_windows(spark):
    paras = spark.createDataFrame([(1, i, 20) for i in range(5)] + [(2, 0, 0)], "doc_id long, idx long, words long")
    out = {r["window"]: (r["first"], r["last"]) for r in tracks.word_windows(paras, 40, 20).collect()}
    assert out == {0: (0, 2), 1: (1, 3), 2: (2, 4), 3: (3, 4), 4: (4, 4)}


def test_compartments():
    block = np.kron(np.eye(2), np.ones((6, 6))) + 0.01
    leading, direction, domain = tracks.compartments(block)
    assert len(set(np.sign(leading[:6]))) == 1 and np.sign(leading[0]) == -np.sign(leading[6]) and abs(direction[0] - 1) < 1e-9 and domain[6] > domain[4]
    assert [len(x) for x in tracks.compartments(np.zeros((0, 0)))] == [0, 0, 0]


def test_hidden_states():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), rng.normal(0, 0.1, (30, 2))])
    path = tracks.GaussianStates(x, 2).path(x)
    assert len(set(path[:30])) == len(set(path[30:60])) == 1 and path[0] == path[70] != path[40]


def test_edit_and_identity():
    assert tracks.token_edit_similarity(list("abcd"), list("abxd")) == 0.75
    assert tracks.token_edit_similarity(["a"], list("abcd")) == 0.0 and tracks.token_edit_similarity([], ["a"]) == 0.0
    assert tracks.token_edit_similarity(list("kitten"), list("sitting")) == 1 - 3 / 7
    assert tracks.character_identity("abcd", "abxd") == 0.75 and tracks.character_identity("", "a") == 0.0
    assert tracks.character_identity("a b " * 200, "a c") == 1 / 3


def test_best_cells_and_repeats():
    m = np.zeros((12, 12))
    m[0, 8], m[1, 9], m[2, 2] = 0.9, 0.8, 1.0
    assert tracks.best_cells(m, 5) == [(0, 8, 0.9)]
    rng = np.random.default_rng(2)
    chunks = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(8)) for _ in range(12)]
    chunks[8:11] = chunks[0:3]
    same = np.array([[float(a == b) for b in chunks] for a in chunks])
    assert tracks.seed_and_extend(chunks, same)[0] == (0, 2, 8, 10, 1.0)


def test_edition_rows(spark):
    pairs = spark.createDataFrame([("a", ["Hello", "World"], ["Hello", "Earth"]), ("b", ["x", "y", "z"], ["x", "y", "z"]), ("c", ["a", "b"], ["a", "c", "d"])], "id string, a array<string>, b array<string>")
    rows = alignment.edition_rows(pairs).collect()
    of = lambda i: [(r["change"], r["a_index"], r["b_index"]) for r in rows if r["id"] == i]
    assert of("a") == [("unchanged", 0, 0), ("replace", 1, 1)] and of("b") == [("unchanged", i, i) for i in range(3)]
    assert of("c") == [("unchanged", 0, 0), ("replace", 1, 1), ("insert", -1, 2)]


def test_gumbel():
    assert alignment.p_value(5, 2, 1) < alignment.p_value(1, 2, 1) <= 1 and alignment.p_value(1, 2, 0) == 1.0
    assert alignment.calibrate(np.zeros((2, 9))) == (0.0, 1.0) and alignment.calibrate(np.zeros((9, 9))) == (0.0, 1.0)
    place, scale = alignment.calibrate(np.random.default_rng(1).random((12, 12)), 10)
    assert scale > 0 and place > 0


def test_vector_alignments(spark):
    x = [[float(i == j) for j in range(20)] for i in range(20)]
    pairs = spark.createDataFrame([(1, 2, x, x), (1, 3, x, None)], "id_a long, id_b long, a array<array<double>>, b array<array<double>>")
    best = alignment.align_vectors(pairs, 5).orderBy(F.desc("score")).first()
    assert (best["score"], best["a_start"], best["a_end"], best["b_start"], best["b_end"]) == (20.0, 0, 20, 0, 20) and best["p"] < 0.05
