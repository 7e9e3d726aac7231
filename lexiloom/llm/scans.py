"""Repairing text read from scanned pages: a noisy channel between what was printed and what was read."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

# What is read for what was printed.
_READ_FOR = {
    "c": ["e"], "@": ["a"], "f": ["t"], "0": ["o", "O"], "1": ["i", "l"], "cl": ["d"], "5": ["s", "S"], "b": ["h"], "ii": ["u"], "rn": ["m"], "9": ["g"], "6": ["b"],
    "vv": ["w"], "ſ": ["f"], "m": ["in", "rn"], "h": ["li"], "j": ["i"], "l": ["I"], "F": ["E"], "8": ["B"], "$": ["S"], "d": ["cl"], "rm": ["nn"],
}
#: Characters that no printed word mixes with letters.
_ODD = re.compile(r"[015689@$ſ]")
_ORDINAL = re.compile(r"\d*(?:1st|2nd|3rd|\dth)", re.I)
#: The chance that a character that can be misread is, on a scanned page. The corpus, which holds clean texts too, tells how
#: the confusions differ from this mean: by a factor of ``_SPREAD`` at most, and as if ``_ERROR_WEIGHT`` characters had told it before.
_ERROR, _ERROR_WEIGHT, _SPREAD = 0.003, 1000, 3.0
_HYPHENS = "-¬\xad‐"
_BREAK = re.compile(r"[-¬\xad‐](?<=[^\W\d_].)[ ]*\n[ ]*(?=[^\W\d_])")  # begins with the hyphen, which is found faster than a letter before it
_PY_WORD = re.compile(r"[\w@$]+(?:-[\w@$]+)*")
_ROMAN = re.compile(r"(?=[ivxlcdm])(?:m{0,3})(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_NUMBER = re.compile(r"\s*(?:(page\s+)|([-–—\[(]+)\s*)?(\d{1,4}|[\dlO]*\d[\dlO]*|[ivxlcdm]+)(?:\s*([-–—\])]+)|(\.))?\s*$", re.I)
_CHAPTER = re.compile(r"\s*(?:Chapter|Part|Book|Volume|Act|Scene|Canto|Section|Prologue|Epilogue|Preface|Introduction)\b(?:\s+(?:[Tt]he\s+)?[\w-]+)?[.:]?\s*")
_CLOSED = re.compile(r"[.!?,;:\"]\s")
_HEADER_NUMBER = re.compile(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$|\s+[·•|]\s+\d{1,4}$")

#: Words, at most, that every task knows to be without a likelier reading; other words are joined.
HEAD_WORDS = 1 << 17


@dataclass
class Page:
    """Lines of a record by what they are."""

    headers: list[int]
    numbers: list[int]
    body: list[int]


def _header_core(line: str) -> tuple[str, bool]:
    line = line.strip()
    if not line[0].isdigit() and not line[-1].isdigit():
        return line, False
    core = _HEADER_NUMBER.sub("", line)
    return core, core != line


def _titled(core: str) -> bool:
    # What tells most lines of text apart costs least and comes first.
    if not 3 <= len(core) <= 60 or core[-1] in ".!?,;:\"'-¬\xad‐”»":
        return False
    words = core.split()
    if len(words) > 1 and words[1][0].islower() and words[1][0] not in "lſ" and words[1] not in ("of", "the", "and", "in"):
        return False
    if not all(w[0].isupper() or w[0] in "0158l" or w in ("of", "the", "and", "in") for w in words) and not all(c.isupper() or c in "lſ" or not c.isalpha() for c in core):
        return False
    return not _CLOSED.search(core) and any(map(str.isalpha, core))


def read_page(lines: list[str]) -> Page:
    """Which lines are running headers, page numbers and text.

    A header is a titled line (capitals, or every word capitalised, without closing punctuation) at the top:
    first of the record, or below a page number, or bearing a number beside it, or repeated in the record; the
    heading of a chapter, not all in capitals, is one only if it bears a number or is repeated. A
    page number stands alone on its line; a number with a full stop may also end a sentence that the line
    break cut, and then is text: it counts if it is indented or fits between the record's sure ones.
    """
    filled = [i for i, line in enumerate(lines) if line.strip()]
    numbers, dotted, sure = set(), {}, []
    for i in filled:
        m = _NUMBER.fullmatch(lines[i]) if len(lines[i].strip()) <= 16 else None
        value = m.group(3).replace("l", "1").replace("O", "0") if m and re.search(r"\d", m.group(3)) else m and m.group(3)
        if not m or len(value) > 4 and value.isdigit() or not value.isdigit() and (value.isupper() or not _ROMAN.match(value)):
            continue
        if value.isdigit() and m.group(5) and not m.group(1) and not m.group(2):
            before = lines[i - 1].strip() if i else ""
            after = lines[i + 1].strip() if i + 1 < len(lines) else None
            ended = not before or before[-1] in ".!?\"”»"
            dotted[i] = int(value)
            if lines[i][:1].isspace() or after and not before or ended and after is None and before or after is None and not before:
                sure.append(dotted[i])
        else:
            numbers.add(i)
    last = filled[-1] if filled else -1
    for i, value in dotted.items():
        indented = lines[i][:1].isspace()
        near = [s for s in sure if abs(s - value) <= len(lines) // 8 + 2]
        before = lines[i - 1].strip() if i else ""
        after = lines[i + 1].strip() if i + 1 < len(lines) else ""
        ended = before and before[-1] in ".!?\"”»"
        if indented or (i == last and (ended or not before)) or near and (after or i == last) and len(sure) + (value in sure) > 1 or near and after:
            numbers.add(i)
    titled = {}
    for i in filled:
        core, numbered = _header_core(lines[i])
        if i not in numbers and _titled(core):
            titled[i] = (re.sub(r"[^a-z]", "", core.lower()), numbered)
    repeated = Counter(name for name, _ in titled.values())
    headers = []
    above = {b: a for a, b in zip(filled, filled[1:], strict=False)}
    for i, (name, numbered) in titled.items():
        again = repeated[name] > 1 and not lines[i].startswith(" ")
        if numbered or again or (i == filled[0] or above[i] in numbers) and not _CHAPTER.fullmatch(lines[i]):
            headers.append(i)
    gone = numbers | set(headers)
    return Page(sorted(headers), sorted(numbers), [i for i in range(len(lines)) if i not in gone])


def printed_for(word: str) -> str | None:
    """A word of letters that an odd one may have been printed as, every odd character being misread."""
    capital = sum(c.isupper() for c in word) > sum(c.islower() for c in word)
    trues = [_READ_FOR[c] if _ODD.match(c) else [c] for c in word]
    return "".join(next((t for t in ts if t.isupper() == capital), ts[0]) for ts in trues)


def _is_odd(word: str) -> bool:
    return bool(_ODD.search(word)) and sum(c.isalpha() for c in word) >= 2 and not re.fullmatch(r"\d+\w{0,2}", word)


def _may_be_odd(word: str) -> bool:
    """Odd, or like a number with letters ('0f', '5he'), which stands as it is if no known word is likelier; ordinals are neither."""
    return bool(_ODD.search(word)) and any(c.isalpha() for c in word) and not _ORDINAL.fullmatch(word)


def word_counts(corpus: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(word, pair, n) over all texts of ``corpus`` (text): words with a null pair, and hashes of two words in sequence.

    Words broken at a line's end are joined first. Counts are made per batch before rows are.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            words: list[str | None] = []
            for text in frame["text"]:
                words += _PY_WORD.findall(_BREAK.sub("", text))
                words.append(None)  # no pair over a text's end
                if len(words) >= flush:
                    yield _counted(words)
                    words = []
            if words:
                yield _counted(words)

    rows = corpus.where(F.length("text") > 0).select("text").mapInArrow(lambda batches: (_counted_batch(f) for f in count(b.to_pandas() for b in batches)), "word string, pair long, n long")
    return rows.groupBy("word", "pair").agg(F.sum("n").alias("n"))


def _counted_batch(counted: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Words with a null pair, then pairs with a null word."""
    words, single, pairs, n = counted
    word = pa.concat_arrays([words, pa.nulls(len(pairs), pa.string())])
    pair = pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(pairs)])
    return pa.RecordBatch.from_arrays([word, pair, pa.array(np.concatenate([single, n]))], ["word", "pair", "n"])


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two words in sequence from the hashes of each."""
    mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _counted(words: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and how often they stand, hashes of pairs and how often they stand."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    size = len(coded.dictionary)
    codes = coded.indices.fill_null(size).to_numpy().astype(np.int64)
    single = np.bincount(codes, minlength=size + 1)[:size]
    inside = (codes[:-1] < size) & (codes[1:] < size)
    pairs, n = np.unique(codes[:-1][inside] * (size + 1) + codes[1:][inside], return_counts=True)
    hashes = _word_hashes(coded.dictionary.to_pylist())
    return coded.dictionary, single, _pair_hashes(hashes[pairs // (size + 1)], hashes[pairs % (size + 1)]) if len(pairs) else np.zeros(0, np.int64), n


#: The confusions of letters with letters: (read, true).
_LETTERS = [(read, true) for read, trues in _READ_FOR.items() for true in trues if read.isalpha() and true.isalpha() and read != "ſ"]


def _exchanged(words: DataFrame, source: str, old: str, new: str) -> DataFrame:
    """``words`` with ``changed``, ``source`` with one confusion of letters made (true to read) or undone (read to true).

    ``at`` and ``size`` are the place of the new letters, counted from 1, ``rule`` is the confusion as 'read>true'.
    """
    undo = (old, new) == ("read", "true")
    of: dict[str, list[tuple[str, str]]] = {}
    for read, true in _LETTERS:
        of.setdefault(read if undo else true, []).append((true if undo else read, f"{read}>{true}"))
    names = words.columns

    def change(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, double = ({k: v for k, v in of.items() if len(k) == n} for n in (1, 2))
        for frame in frames:
            rows, made = [], []
            for i, word in enumerate(frame[source]):
                for at, c in enumerate(word):
                    found = single.get(c, ())
                    longer = double.get(word[at : at + 2], ())
                    for size, tried in ((1, found), (2, longer)):
                        for after, rule in tried:
                            rows.append(i)
                            made.append((word[:at] + after + word[at + size :], at + 1, len(after), rule))
            out = frame.iloc[rows].reset_index(drop=True)
            out[["changed", "at", "size", "rule"]] = pd.DataFrame(made, columns=["changed", "at", "size", "rule"]) if made else pd.DataFrame(columns=["changed", "at", "size", "rule"])
            yield out

    kinds = ", ".join(f"{c} {t}" for c, t in words.dtypes)
    return words.select(*names).mapInPandas(change, f"{kinds}, changed string, at int, size int, rule string")


def confusion_chances(vocab: DataFrame, likely: DataFrame) -> dict[str, float]:
    """The chance of each confusion of letters, 'read>true', estimated from the corpus: how often it explains a word, of how often it could have happened.

    The chances are scaled to a mean (of logarithms, over the words explained) of ``_ERROR``. The rules are a
    fixed table, and so is what reaches the driver.
    """
    trues = sorted({true for _, true in _LETTERS})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy()
            yield pd.DataFrame({"true": trues, "n": [int((frame["word"].str.count(re.escape(t)).to_numpy() * n).sum()) for t in trues]})

    could = {r["true"]: r["n"] for r in vocab.select("word", "n").mapInPandas(count, "true string, n long").groupBy("true").agg(F.sum("n").alias("n")).collect()}
    did = {r["rule"]: r["n"] for r in likely.where("errors = 1").groupBy(F.col("rules")[0].alias("rule")).agg(F.sum("n").alias("n")).collect()}
    rate = {f"{read}>{true}": (did.get(f"{read}>{true}", 0) + _ERROR * _ERROR_WEIGHT) / (could.get(true, 0) + _ERROR_WEIGHT) for read, true in _LETTERS}
    seen = sum(did.values())
    mean = math.exp(sum(n * math.log(rate[rule]) for rule, n in did.items()) / seen) if seen else _ERROR
    return {rule: _ERROR * min(max(r / mean, 1 / _SPREAD), _SPREAD) for rule, r in rate.items()}


def _skeleton(word: Column) -> Column:
    """``word`` with one character for an odd one and all letters it is read for."""
    return F.translate(word, "oOilsS$bBgaſ", "0011555689@f")


def _read_as(printed: Column, read: Column) -> Column:
    """Whether ``printed``, of the same skeleton as ``read``, differs from it in nothing but the odd characters."""
    pairs = F.array(*(F.lit(c + true) for c, trues in _READ_FOR.items() if _ODD.match(c) for true in trues))
    letter = lambda word, i: F.substr(word, i, F.lit(1))
    return F.forall(F.sequence(F.lit(1), F.length(read)), lambda i: (letter(read, i) == letter(printed, i)) | F.array_contains(pairs, F.concat(letter(read, i), letter(printed, i))))


def suspects(vocab: DataFrame, ratio: float = 3.0) -> tuple[DataFrame, dict[str, float]]:
    """(word, n, readings), words for which likelier printed words exist, with these, and the chances of confusions.

    A reading has the printed word, its count m, the number of errors, and the confusions of letters among them.

    Up to two confusions of letters are undone, at any places of a word, and in odd words all odd characters
    besides. In words of letters two confusions are found by the form between them: one undone in the word
    read, the other made in the word printed.
    """
    def single_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(w, n, len(_ODD.findall(w)), printed_for(w), _is_odd(w)) for w, n in zip(frame["word"], frame["n"], strict=True) if _may_be_odd(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "places", "unknown", "sure"])

    lettered = F.col("word").rlike(r"^[\p{L}\p{M}-]+$") & ~F.col("word").contains("ſ")
    known = vocab.where(lettered).select(F.col("word").alias("printed"), F.col("n").alias("m"))
    undone = _exchanged(vocab.where(F.length("word") >= 3).where(lettered), "word", "read", "true")
    able = known.where(F.col("m") >= max(ratio, 2))  # n is at least 1
    none = F.array().cast("array<string>")
    made = _exchanged(able, "printed", "true", "read").select("changed", "printed", "m", F.lit(2).alias("errors"), F.col("at").alias("at_2"), F.col("size").alias("size_2"), F.array("rule").alias("rules_2"))
    whole = able.select(F.col("printed").alias("changed"), "printed", "m", F.lit(1).alias("errors"), F.lit(0).alias("at_2"), F.lit(0).alias("size_2"), none.alias("rules_2"))
    apart = (F.col("at") + F.col("size") <= F.col("at_2")) | (F.col("at_2") + F.col("size_2") <= F.col("at"))
    likely = undone.join(made.unionByName(whole), "changed").where((F.col("m") >= F.col("n") * ratio) & apart & (F.col("word") != F.col("printed")))
    likely = checkpointed(likely.select("word", "n", "printed", "errors", F.concat(F.array("rule"), "rules_2").alias("rules"), "m"))
    chances = confusion_chances(vocab.where(lettered), likely)

    # Odd words the same, but forms of one skeleton meet; only words of letters and odd characters can have been words of letters.
    odd = vocab.where(F.col("word").rlike(r"[015689@$ſ]") & F.col("word").rlike(r"^[\p{L}\p{M}015689@$-]+$"))
    odd = checkpointed(odd.mapInPandas(single_out, "word string, n long, places int, unknown string, sure boolean"))
    forms = odd.select("word", "n", "places", "sure", F.col("word").alias("form"), F.lit(0).alias("undone"), F.lit(0).alias("at"), F.lit(0).alias("size"), none.alias("rules"))
    one = lambda df: df.withColumn("rules", F.array("rule")).drop("rule")
    forms = forms.unionByName(one(_exchanged(odd.select("word", "n", "places", "sure"), "word", "read", "true")).withColumnRenamed("changed", "form").withColumn("undone", F.lit(1)))
    met = known.select("printed", "m", F.col("printed").alias("between"), F.lit(0).alias("made"), F.lit(0).alias("at_2"), F.lit(0).alias("size_2"), none.alias("rules_2"))
    met = met.unionByName(one(_exchanged(known, "printed", "true", "read")).withColumnsRenamed({"changed": "between", "at": "at_2", "size": "size_2", "rules": "rules_2"}).withColumn("made", F.lit(1)))
    met = forms.withColumn("skeleton", _skeleton(F.col("form"))).join(met.withColumn("skeleton", _skeleton(F.col("between"))), "skeleton").where("made <= undone").where(apart)
    met = met.where("substr(form, at_2, size_2) = substr(between, at_2, size_2)").where(_read_as(F.col("between"), F.col("form")))
    mended = met.where(F.col("sure") | (F.col("m") >= F.col("n") * ratio) & (F.col("m") >= 2)).select("word", "n", "printed", F.expr("places + undone + made").alias("errors"), F.concat("rules", "rules_2").alias("rules"), "m")
    # An unknown word stands for up to three odd characters; strings with more are codes, unless a known word is like them.
    unknown = odd.where("sure AND places <= 3").select("word", "n", F.col("unknown").alias("printed"), F.col("places").alias("errors"), none.alias("rules"), F.lit(0).cast("long").alias("m"))

    likely = likely.unionByName(mended).unionByName(unknown).groupBy("word", "printed").agg(F.any_value("n").alias("n"), F.min(F.struct("errors", "rules")).alias("how"), F.max("m").alias("m"))
    readings = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("rank"), F.col("how.errors").alias("errors"), "printed", "m", F.col("how.rules").alias("rules"))))
    plain = F.transform(readings, lambda r: F.struct(r["printed"].alias("printed"), r["errors"].alias("errors"), r["rules"].alias("rules"), r["m"].alias("m")))
    return likely.groupBy("word").agg(F.any_value("n").alias("n"), plain.alias("readings")), chances


def decode(words: list[str], readings: dict[str, list[tuple[str, float, int]]], counts: dict[str, int], pairs: dict[tuple[str, str], int], total: int) -> list[str]:
    """The likeliest printed words of a line, by Viterbi over the candidates of each word.

    ``readings`` has (printed, log of the channel's chance, n) of the suspicious words, ``counts`` their own n.
    What a word adds to the counts by standing here itself is taken off. One step back is kept for each
    candidate, so time and memory grow with the words.
    """
    smooth, here = 2.0, frozenset(words)
    steps: list[list[tuple[str, int]]] = []
    best = [(0.0, "")]
    for word in words:
        options = readings.get(word, [])
        if not options or not _is_odd(word):
            options = [(word, 0.0, max(counts.get(word, 50) - 1, 0)), *options]
        fresh, back = [], []
        for printed, channel, n in options:
            own = 1 if printed == word else 0
            base = (n + 0.05) / total
            top, source = -math.inf, 0
            for i, (score, last) in enumerate(best):
                seen = max(pairs.get((last, printed), 0) - own * (last in here), 0)
                before = max(counts.get(last, 50), 1)
                step = score + math.log((seen + smooth * base) / (before + smooth)) + channel
                if step > top:
                    top, source = step, i
            fresh.append((top, printed))
            back.append((printed, source))
        best = fresh
        steps.append(back)
    at = max(range(len(best)), key=lambda i: best[i][0])
    out = []
    for back in reversed(steps):
        printed, at = back[at]
        out.append(printed)
    return out[::-1]


def find_faults(pages: DataFrame, corpus: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """(field, record_id, line_no, noise, word, printed): faults of scanned pages by line.

    ``pages`` has (field, record_id, text), ``corpus`` (text), all texts that counts are made of. noise is
    hyphen (word is the unbroken word), misread (word was read for printed), header or pageno. Lines count
    from 0. Null and empty texts have no faults; repeated rows count once; other columns are ignored.

    Method: a noisy channel. Words of the whole corpus are counted; for each distinct word, confusions of
    characters, undone, give the words that may have been printed; where one is likelier, lines with the word
    are decoded by Viterbi, with the confusions' probabilities, estimated from the corpus, times the likelihood
    of word pairs in it. A
    break is a fault if the unbroken word is as frequent as the hyphenated one. Words common enough to be
    among ``head_words`` and without a likelier reading are known to every task, so only rare and
    suspicious ones take part in joins; no result depends on that number.
    """
    spark = pages.sparkSession
    counted = checkpointed(word_counts(corpus))
    vocab = checkpointed(counted.where("word IS NOT NULL").select("word", "n"))  # read many times, and few rows beside the pairs
    doubtful, chances = suspects(vocab)
    doubtful = checkpointed(doubtful)
    head = vocab.orderBy(F.desc("n"), "word").limit(head_words).join(doubtful.select("word"), "word", "left_anti")
    clean = spark.sparkContext.broadcast(frozenset(head.select("word").toArrow().column(0).to_pylist()))
    total = spark.sparkContext.broadcast(vocab.agg(F.sum("n")).first()[0] or 1)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = clean.value
        for frame in frames:
            rows = []
            for field, record, text in zip(frame["field"], frame["record_id"], frame["text"], strict=True):
                for line_no, noise, word, other, words in page_rows(text, known):
                    rows.append((field, record, line_no, noise, word, other, words))
            yield pd.DataFrame(rows, columns=["field", "record_id", "line_no", "noise", "word", "other", "words"])

    rows = pages.where(F.length("text") > 0).select("field", "record_id", "text").mapInPandas(parse, "field string, record_id long, line_no long, noise string, word string, other string, words array<string>")
    rows = checkpointed(rows)
    where = ["field", "record_id", "line_no"]
    plain = rows.where(F.col("noise").isin("header", "pageno")).select(*where, "noise", "word", F.lit(None).cast("string").alias("printed")).distinct()

    breaks = rows.where(F.col("noise") == "hyphen").select(*where, "noise", "word", "other").distinct()
    joined = vocab.select("word", "n")
    hyphened = vocab.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    breaks = breaks.join(joined, "word", "left").join(hyphened, "other", "left").where(F.coalesce("n", F.lit(0)) >= F.coalesce("n_other", F.lit(0)))
    breaks = breaks.select(*where, "noise", "word", F.lit(None).cast("string").alias("printed"))

    # A line's words and its doubtful words meet in one group; repeated records add nothing.
    doubt = rows.where(F.col("noise") == "word").select(*where, "word", "other").join(doubtful, "word")
    doubt = doubt.select(*where, F.lit(None).cast("array<string>").alias("words"), F.struct("word", "n", "readings", "other").alias("doubt"))
    whole = rows.where(F.col("noise") == "line").select(*where, "words").withColumn("doubt", F.lit(None).cast(doubt.schema["doubt"].dataType))
    lines = whole.unionByName(doubt).groupBy(*where).agg(F.max("words").alias("words"), F.collect_set("doubt").alias("doubts")).where(F.size("doubts") > 0)
    lines = checkpointed(lines)

    # Each line with the counts of its own pairs.
    edges = lines.mapInPandas(_line_pairs, "field string, record_id long, line_no long, a string, b string, pair long")
    counts = edges.join(counted.where("pair IS NOT NULL").select("pair", "n"), "pair").groupBy(*where).agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))

    logs = {rule: math.log(p) for rule, p in chances.items()}

    def channel(errors: int, rules) -> float:
        return sum(logs[r] for r in rules) + (errors - len(rules)) * math.log(_ERROR)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for field, record, line_no, words, doubts, pairs in frame[["field", "record_id", "line_no", "words", "doubts", "pairs"]].itertuples(index=False):
                readings = {d["word"]: [(r["printed"], channel(r["errors"], r["rules"]), r["m"]) for r in d["readings"]] for d in doubts}
                seen = {d["word"]: d["n"] for d in doubts}
                table = {(p["a"], p["b"]): p["n"] for p in (pairs if pairs is not None else ())}
                broken = {d["word"]: d["other"] for d in doubts}
                for word, printed in zip(words, decode(list(words), readings, seen, table, total.value), strict=True):
                    if word != printed:
                        out.append((field, record, line_no + _error_line(word, printed, broken.get(word)), "misread", word, printed))
            yield pd.DataFrame(out, columns=["field", "record_id", "line_no", "noise", "word", "printed"])

    misread = lines.join(counts, where, "left").mapInPandas(settle, "field string, record_id long, line_no long, noise string, word string, printed string")
    return plain.unionByName(breaks).unionByName(misread)


def _line_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for field, record, line_no, words, doubts in frame[["field", "record_id", "line_no", "words", "doubts"]].itertuples(index=False):
            options = {d["word"]: [d["word"], *(r["printed"] for r in d["readings"])] for d in doubts}
            pairs = {(a, b) for x, y in zip(words, words[1:], strict=False) if x in options or y in options for a in options.get(x, [x]) for b in options.get(y, [y])}
            out += [(field, record, line_no, a, b) for a, b in sorted(pairs)]
        rows = pd.DataFrame(out, columns=["field", "record_id", "line_no", "a", "b"])
        yield rows.assign(pair=_pair_hashes(_word_hashes(rows["a"].tolist()), _word_hashes(rows["b"].tolist())) if len(rows) else [])


def _error_line(word: str, printed: str, first_part: str | None) -> int:
    """0 if the first misread character stands in the first part of a broken word, 1 if in the second."""
    if not first_part:
        return 0
    same = next((i for i, (a, b) in enumerate(zip(word, printed, strict=False)) if a != b), min(len(word), len(printed)))
    return int(same >= len(first_part))


def page_rows(text: str, known=frozenset()) -> Iterator[tuple]:
    """(line_no, noise, word, other, words) of one record: headers, page numbers, breaks, and words to look up.

    A broken word belongs to the line that it begins on, with its first part as ``other``. A line with words to
    look up has one row, of noise line, with all its words.
    """
    lines = text.split("\n")
    page = read_page(lines)
    for i in page.headers:
        yield i, "header", lines[i].strip(), None, None
    for i in page.numbers:
        yield i, "pageno", lines[i].strip(), None, None
    body = [i for i in page.body if lines[i].strip()]
    carried = ""  # the rest of a broken word, to leave out at the next line's start
    for place, i in enumerate(body):
        line = lines[i].strip()
        if carried and line.startswith(carried):
            line = line[len(carried) :]
        carried, first = "", None
        words = [w for w in _PY_WORD.findall(line)]
        if line and line[-1] in _HYPHENS and len(line) > 1 and line[-2].isalpha() and place + 1 < len(body):
            following = re.match(r"[\w@$]+(?:-[\w@$]+)*", lines[body[place + 1]].strip())
            piece = re.search(r"[\w@$]+(?:-[\w@$]+)*(?=.$)", line)
            if following and piece:
                carried, first = following.group(), piece.group()
                yield i, "hyphen", first + carried, first + "-" + carried, None
                words = _PY_WORD.findall(line[: piece.start()]) + [first + carried]
        unknown = [k for k, word in enumerate(words) if word not in known and (len(word) > 2 or _may_be_odd(word))]
        for word, other in {(words[k], first if k == len(words) - 1 else None) for k in unknown}:
            yield i, "word", word, other, None
        if unknown:
            yield i, "line", None, None, words


def repair(pages: DataFrame, faults: DataFrame) -> DataFrame:
    """(field, record_id, repaired): pages as paragraphs without the faults found; null and empty texts as they are.

    Headers and page numbers go, broken words are joined, misread words are put right, and the lines of a
    paragraph become one line; blank lines stay between paragraphs, unless a page's end cut a sentence.
    """
    of = faults.groupBy("field", "record_id").agg(F.collect_list(F.struct("line_no", "noise", "word", "printed")).alias("faults"))
    both = pages.select("field", "record_id", "text").join(of, ["field", "record_id"], "left")

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [mended(t, f) if t and f is not None else t for t, f in zip(frame["text"], frame["faults"], strict=True)]
            yield pd.DataFrame({"field": frame["field"], "record_id": frame["record_id"], "repaired": out})

    return both.mapInPandas(mend, "field string, record_id long, repaired string")


def mended(text: str, faults) -> str:
    gone = {f["line_no"] for f in faults if f["noise"] in ("header", "pageno")}
    breaks = {f["line_no"] for f in faults if f["noise"] == "hyphen"}
    wrong = {(f["line_no"], f["word"]): f["printed"] for f in faults if f["noise"] == "misread"}
    pieces: list[str] = []
    starts, numbers = [], []  # where each line begins in the text put together, and its number
    size, joint, cut, last = 0, "", False, ""
    for i, line in enumerate(text.split("\n")):
        line = line.strip()
        if i in gone:
            cut = True
            continue
        if not line:
            joint = joint if cut and last and last not in ".!?\"”»" else "\n\n" if last else ""
            continue
        starts.append(size + len(joint))
        numbers.append(i)
        last, cut = line[-1], False
        kept = line[:-1] if i in breaks else line
        pieces += [joint, kept]
        size += len(joint) + len(kept)
        joint = "" if i in breaks or last in _HYPHENS else " "

    def printed(m: re.Match) -> str:
        """A word as it was printed on its own line; a broken one may have been misread on the second."""
        first, after = (numbers[bisect_right(starts, at) - 1] for at in (m.start(), m.end() - 1))
        return wrong.get((first, m.group())) or wrong.get((after, m.group())) or m.group()

    return _PY_WORD.sub(printed, "".join(pieces)) if wrong else "".join(pieces)
