"""Measures of the words of a text, row by row: a text lies whole in its row, so nothing is shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_WORD = re.compile(r"[a-z']+")
_ANY_WORD = re.compile(r"\b\w+\b")


def _entropy(items) -> float:
    n = np.array(list(Counter(items).values()), float)
    total = n.sum()
    return float(np.log2(total) - (n * np.log2(n)).sum() / total) if total else 0.0


def word_measures(texts: DataFrame, least: int = 5) -> DataFrame:
    """(..., n_words, n_distinct, n_once, ttr, mean_length, yules_k) of texts (..., text) with ``least`` words or more."""
    kept = [c for c in texts.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words = _WORD.findall(text.lower()) if text else []
                counts = Counter(words)
                n = len(words)
                if n < least:
                    rows.append((n, 0, 0, 0.0, 0.0, 0.0))
                    continue
                squares = sum(c * c for c in counts.values())
                rows.append((n, len(counts), sum(c == 1 for c in counts.values()), len(counts) / n, sum(map(len, words)) / n, 10000.0 * (squares - n) / (n * n)))
            out = pd.DataFrame(rows, columns=["n_words", "n_distinct", "n_once", "ttr", "mean_length", "yules_k"])
            yield pd.concat([frame[kept].reset_index(drop=True), out], axis=1)[out["n_words"] >= least]

    kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "text")
    return texts.mapInPandas(run, f"{kinds}, n_words long, n_distinct long, n_once long, ttr double, mean_length double, yules_k double")


SIGNALS = "n_words long, n_chars long, char_entropy double, word_entropy double, lexical_diversity double, avg_word_length double, dialog_ratio double, n_sentences long, avg_sentence_length double, sentence_length_variance double, question_ratio double, exclamation_ratio double"


def text_signals(texts: DataFrame) -> DataFrame:
    """(..., signals) of texts (..., text): entropies, diversity, dialogue and sentence statistics; zeros for null and empty texts.

    Characters and words count in small letters; the share of dialogue adds what is in double and in single quotes.
    """
    kept = [c for c in texts.columns if c != "text"]
    names = [f.split()[0] for f in SIGNALS.split(", ")]

    def signals(text: str | None) -> tuple:
        text = text or ""
        small = text.lower()
        words = small.split()
        sentences = [len(s.split()) for s in re.split(r"[.!?]+", text) if s.strip()]
        ends = Counter(re.findall(r"[.!?]", text))
        marks = ends.total() or 1
        long = [len(w) for w in _ANY_WORD.findall(text)]
        quoted = sum(map(len, re.findall(r'"[^"]*"', text))) + sum(map(len, re.findall(r"'[^']*'", text)))
        mean = lambda x: float(np.mean(x)) if len(x) else 0.0
        return (
            len(words), len(text), _entropy(small), _entropy(words), len(set(words)) / len(words) if words else 0.0, mean(long), quoted / len(text) if text else 0.0,
            len(sentences), mean(sentences), float(np.var(sentences)) if len(sentences) > 1 else 0.0, ends["?"] / marks, ends["!"] / marks,
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([signals(t) for t in frame["text"]], columns=names)
            yield pd.concat([frame[kept].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "text")
    return texts.mapInPandas(run, f"{kinds}, {SIGNALS}")


def chunk_similarity(docs: DataFrame, stop: list[str], size: int = 50, least: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, i, j, jaccard), i < j: chunks of ``size`` words of one text (doc_id, text) that share at least ``threshold`` of their content words.

    A text lies whole in its row, so its chunks meet as one product of zeros and ones, in strips, and nothing is
    shuffled. Chunks under ``least`` words and those without content words are left out, null texts have none.
    """
    left_out = frozenset(stop)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = [w for w in re.split(r"[ \t\n\r]+", text) if w]
                chunks = [words[a : a + size] for a in range(0, len(words), size)]
                sets = [{w for w in _WORD.findall(" ".join(c).lower()) if len(w) > 1 and w not in left_out} if len(c) >= least else set() for c in chunks]
                codes: dict[str, int] = {}
                at = [(k, codes.setdefault(w, len(codes))) for k, s in enumerate(sets) for w in s]
                if not at:
                    continue
                x = np.zeros((len(sets), len(codes)), np.float32)
                x[tuple(np.array(at).T)] = 1
                n = x.sum(1)
                for a in range(0, len(x), 512):
                    both = (x[a : a + 512] @ x.T).astype(float)
                    share = both / np.maximum(n[a : a + 512, None] + n[None] - both, 1)
                    i, j = np.nonzero(share >= threshold)
                    later = j > i + a
                    parts.append(pd.DataFrame({"doc_id": doc, "i": i[later] + a, "j": j[later], "jaccard": share[i, j][later]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "i": [], "j": [], "jaccard": []})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, i long, j long, jaccard double")
