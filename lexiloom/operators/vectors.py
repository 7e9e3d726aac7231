"""Similarities of vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 1000) -> DataFrame:
    """(i, j, cosine), i < j, of vectors (i, v) of one length whose cosine is at least ``threshold``.

    Blocks of rows meet blocks of rows, each pair of blocks once, as one matrix product; only pairs over the
    threshold leave it. Norms count as 1e-8 at least.
    """
    n = vectors.count()
    blocks = -(-max(n, 1) // block)
    placed = vectors.where("i IS NOT NULL AND v IS NOT NULL").withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    left = placed.select("i", "v", F.col("b").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q")).where("p <= q")
    right = placed.select(F.col("i").alias("j"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"), F.col("b").alias("q")).where("p <= q")

    def unit(x: pd.Series) -> np.ndarray:
        m = np.stack(x).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1), 1e-8)[:, None]

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "cosine": []})
        scores = unit(a["v"]) @ unit(b["w"]).T
        x, y = np.nonzero(scores >= threshold)
        i, j, same = a["i"].to_numpy()[x], b["j"].to_numpy()[y], a["p"].iloc[0] == a["q"].iloc[0]
        keep = i < j if same else i != j
        i, j, s = i[keep], j[keep], scores[x, y][keep]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "cosine": np.clip(s, -1, 1)})

    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(product, "i long, j long, cosine double")


def binary_jaccard(vectors: DataFrame, asked: str, threshold: float, block: int = 4096) -> DataFrame:
    """(q, i, jaccard): of each vector (i, v) that the condition ``asked`` names, the others whose positive coordinates share at least ``threshold``.

    Blocks of queries meet blocks of rows as one product of zeros and ones.
    """
    n_rows = max(1, -(-vectors.count() // block))
    n_asked = max(1, -(-vectors.where(asked).count() // block))
    at = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.where("i IS NOT NULL AND v IS NOT NULL")
    left = held.where(asked).select(F.col("i").alias("q"), F.col("v").alias("w"), at(n_asked).alias("a"), every(n_rows).alias("b"))
    right = held.select(F.col("i").alias("i"), F.col("v").alias("v"), at(n_rows).alias("b"), every(n_asked).alias("a"))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"q": [], "i": [], "jaccard": []})
        p, q = ((np.stack(v) > 0).astype(np.float32) for v in (x["w"], y["v"]))
        both = p @ q.T
        either = p.sum(1)[:, None] + q.sum(1)[None] - both
        share = np.divide(both, either, out=np.zeros(both.shape), where=either > 0)
        r, c = np.nonzero((np.round(share, 4) >= threshold) & (x["q"].to_numpy()[:, None] != y["i"].to_numpy()[None]))
        return pd.DataFrame({"q": x["q"].to_numpy()[r], "i": y["i"].to_numpy()[c], "jaccard": share[r, c]})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(product, "q long, i long, jaccard double")


def recurrence(vectors: DataFrame, size: int, radius: float) -> DataFrame:
    """(window, n, recurrence_rate, determinism, laminarity) of consecutive windows of ``size`` vectors (i, v).

    Two vectors of a window recur if their cosine distance is under ``radius``. Determinism is the share of
    recurrent cells on diagonals of two or more, laminarity the same on columns. A window is one small matrix.
    """
    placed = vectors.withColumn("window", F.floor(F.col("i") / size).cast("bigint"))
    grouped = placed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("rows"))

    def share_in_runs(flags: np.ndarray) -> int:
        edge = np.diff(np.concatenate([[0], flags.astype(int), [0]]))
        length = np.nonzero(edge == -1)[0] - np.nonzero(edge == 1)[0]
        return int(length[length >= 2].sum())

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for window, rows in zip(frame["window"], frame["rows"], strict=True):
                m = np.array([r["v"] for r in rows], np.float64)
                n = len(m)
                m /= np.maximum(np.linalg.norm(m, axis=1), 1e-8)[:, None]
                hit = (1 - m @ m.T) < radius
                np.fill_diagonal(hit, False)
                total = int(hit.sum())
                diagonal = sum(share_in_runs(np.diagonal(hit, k)) for k in range(-n + 1, n) if k)
                column = sum(share_in_runs(hit[:, k]) for k in range(n))
                out.append((window, n, total / (n * n - n) if n > 1 else 0.0, diagonal / total if total else 0.0, column / total if total else 0.0))
            yield pd.DataFrame(out, columns=["window", "n", "recurrence_rate", "determinism", "laminarity"])

    return grouped.mapInPandas(measure, "window long, n long, recurrence_rate double, determinism double, laminarity double")
