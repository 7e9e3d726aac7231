"""Aligning sequences: local alignment with affine gaps, differences of editions."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GAP_OPEN, GAP_EXTEND = -2.0, -0.5
#: Alignments of a pair, at most.
MOST = 100


def local_alignment(similarity: np.ndarray, least: int = 3) -> tuple[float, int, int, int, int] | None:
    """The first of ``local_alignments`` by a matrix of similarities, or None."""
    found = local_alignments(*similarity.shape, lambda i, j: similarity[i, j], least, 1)
    return found[0] if found else None


def local_alignments(n: int, m: int, similarity: Callable[[np.ndarray, np.ndarray], np.ndarray], least: int = 3, most: int = MOST) -> list[tuple[float, int, int, int, int]]:
    """(score, query start, query end, target start, target end) of the ``most`` best local alignments of two sequences.

    A cell scores 2 * similarity - 1; gaps are affine. Three states per cell; each anti-diagonal is one vector
    step, of which only the last two are kept, and the start of the best path to a cell travels with its score.
    Every cell has one path, so paths of different starts share no cell: the best end of each start is an
    alignment. What has no positive score, or under ``least`` rows or columns, is none.
    """
    low = -1e18
    rows = np.arange(n + 1)
    best, before = np.zeros(n + 1), np.zeros(n + 1)
    start, start_before = rows * m + 1, rows * m
    gap_row, gap_col = np.full(n + 1, low), np.full(n + 1, low)
    start_row, start_col = start, start
    kept, waiting = [], 0
    for d in range(2, n + m + 1):
        here = slice(max(1, d - m), min(n, d - 1) + 1)
        up = slice(here.start - 1, here.stop - 1)
        i = rows[here]
        states = []
        for state, origin, at in ((gap_row, start_row, up), (gap_col, start_col, here)):
            opened, extended = best[at] + GAP_OPEN, state[at] + GAP_EXTEND
            fresh, came = np.full(n + 1, low), rows * m + d
            fresh[here] = np.maximum(opened, extended)
            came[here] = np.where(opened >= extended, start[at], origin[at])
            states += [fresh, came]
        gap_row, start_row, gap_col, start_col = states
        score = 2.0 * similarity(i - 1, d - i - 1) - 1.0
        through = before[up] + score
        now, start_now = np.zeros(n + 1), rows * m + d
        top, came = now[here], start_now[here]  # views
        for value, origin in ((through, start_before[up]), (gap_row[here], start_row[here]), (gap_col[here], start_col[here])):
            better = value > top
            top[better], came[better] = value[better], origin[better]
        ends = np.flatnonzero((score > 0) & (top == through))
        if len(ends):
            y, x = np.divmod(came[ends], m + 1)
            ends = ends[(i[ends] - y >= least) & (d - i[ends] - x >= least)]
            kept.append((came[ends], top[ends], i[ends] * (m + 1) + d - i[ends]))
            waiting += len(ends)
            if waiting > 1_000_000:
                kept, waiting = [_best_ends(kept)], 0
        before, best, start_before, start = best, now, start, start_now
    if not kept:
        return []
    starts, scores, ends = _best_ends(kept)
    order = np.lexsort((ends, -scores))[:most]
    return [(float(scores[k]), int(starts[k] // (m + 1)), int(ends[k] // (m + 1)), int(starts[k] % (m + 1)), int(ends[k] % (m + 1))) for k in order]


def _best_ends(parts: list[tuple]) -> tuple:
    """(starts, scores, ends) with the best end of each start, the first of equal ones."""
    starts, scores, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ends, -scores, starts))
    starts, scores, ends = starts[order], scores[order], ends[order]
    first = np.concatenate([[True], starts[1:] != starts[:-1]])[: len(starts)]
    return starts[first], scores[first], ends[first]


def align_words(pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, score, a_start, a_end, b_start, b_end) of pairs (id_a, id_b, a, b) of word lists, word for word.

    Lists are aligned whole; a pair has up to ``MOST`` alignments, none sharing a pair of words with another.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p, q, a, b in frame[["id_a", "id_b", "a", "b"]].itertuples(index=False):
                if a is not None and b is not None and len(a) and len(b):
                    codes: dict[str, int] = {}
                    x, y = (np.array([codes.setdefault(w, len(codes)) for w in words]) for words in (a, b))
                    out += [(p, q, *hit) for hit in local_alignments(len(x), len(y), lambda i, j, x=x, y=y: x[i] == y[j])]
            yield pd.DataFrame(out, columns=["id_a", "id_b", "score", "a_start", "a_end", "b_start", "b_end"])

    return pairs.mapInPandas(run, "id_a long, id_b long, score double, a_start long, a_end long, b_start long, b_end long")


def edition_rows(pairs: DataFrame) -> DataFrame:
    """(id, change, a_index, b_index, a_text, b_text) of pairs (id, a, b) of paragraph lists, unchanged paragraphs too.

    Replaced paragraphs are paired in order, what is over is deleted or inserted; an index of -1 stands for no
    paragraph. Texts are cut to 500 characters.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, a, b in frame[["id", "a", "b"]].itertuples(index=False):
                a, b = list(a), list(b)
                for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b).get_opcodes():
                    paired = min(a1 - a0, b1 - b0)
                    change = "unchanged" if kind == "equal" else "replace"
                    out += [(ident, change, a0 + k, b0 + k, a[a0 + k][:500], b[b0 + k][:500]) for k in range(paired)]
                    out += [(ident, "delete", k, -1, a[k][:500], "") for k in range(a0 + paired, a1)]
                    out += [(ident, "insert", -1, k, "", b[k][:500]) for k in range(b0 + paired, b1)]
            yield pd.DataFrame(out, columns=["id", "change", "a_index", "b_index", "a_text", "b_text"])

    return pairs.mapInPandas(run, "id string, change string, a_index long, b_index long, a_text string, b_text string")


def gumbel(scores: np.ndarray) -> tuple[float, float]:
    """Place and scale of a Gumbel distribution by moments; (mean, 1) if all scores are alike, (0, 1) without any."""
    if not len(scores):
        return 0.0, 1.0
    if scores.std() < 1e-10:
        return float(scores.mean()), 1.0
    scale = float(scores.std() * np.sqrt(6) / np.pi)
    return float(scores.mean() - 0.5772 * scale), scale


def p_value(score: float, place: float, scale: float) -> float:
    """The chance of a score as high; 1 without a scale."""
    return float(-np.expm1(-np.exp(-max((score - place) / scale, -700.0)))) if scale > 0 else 1.0


def calibrate(similarity: np.ndarray, shuffles: int = 30, seed: int = 42) -> tuple[float, float]:
    """``gumbel`` of the best alignments after shuffling rows; (0, 1) for fewer than three rows or columns."""
    if shuffles <= 0 or min(similarity.shape) < 3:
        return 0.0, 1.0
    rng, best = np.random.default_rng(seed), []
    for _ in range(shuffles):
        mixed = similarity[rng.permutation(len(similarity))]
        hit = local_alignment(mixed, 1)
        best.append(hit[0] if hit else 0.0)
    return gumbel(np.array(best))


def align_vectors(pairs: DataFrame, shuffles: int = 30) -> DataFrame:
    """(id_a, id_b, score, p, a_start, a_end, b_start, b_end) of pairs (id_a, id_b, a, b) of lists of vectors, by cosine."""

    def unit(rows) -> np.ndarray:
        x = np.stack([np.asarray(r, float) for r in rows])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p, q, a, b in frame[["id_a", "id_b", "a", "b"]].itertuples(index=False):
                if a is not None and b is not None and len(a) and len(b):
                    similarity = np.clip(unit(a) @ unit(b).T, -1, 1)
                    place, scale = calibrate(similarity, shuffles)
                    hits = local_alignments(*similarity.shape, lambda i, j, s=similarity: s[i, j])
                    out += [(p, q, h[0], p_value(h[0], place, scale), *h[1:]) for h in hits]
            yield pd.DataFrame(out, columns=["id_a", "id_b", "score", "p", "a_start", "a_end", "b_start", "b_end"])

    return pairs.mapInPandas(run, "id_a long, id_b long, score double, p double, a_start long, a_end long, b_start long, b_end long")


def edition_changes(pairs: DataFrame) -> DataFrame:
    """(id, change, n) of pairs (id, a, b) of paragraph lists: unchanged, replaced, inserted and deleted paragraphs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, a, b in frame[["id", "a", "b"]].itertuples(index=False):
                counts = dict.fromkeys(("unchanged", "replaced", "inserted", "deleted"), 0)
                for kind, a0, a1, b0, b1 in difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes():
                    left, right = a1 - a0, b1 - b0
                    if kind == "equal":
                        counts["unchanged"] += left
                    else:
                        counts["replaced"] += min(left, right)
                        counts["deleted"] += max(0, left - right)
                        counts["inserted"] += max(0, right - left)
                out += [(ident, k, n) for k, n in counts.items()]
            yield pd.DataFrame(out, columns=["id", "change", "n"])

    return pairs.mapInPandas(run, "id string, change string, n long")
