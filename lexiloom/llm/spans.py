"""Long exact spans that stand in more than one document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.operators.periods import continuous_periods
from lexiloom.session import checkpointed

#: Code points of an anchor; with spans of 120, each span holds at least one chosen anchor.
ANCHOR = 64
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_WORK = 1 << 20  # code points worked on at once


def _gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` code points from each place on, by doubling; length is a power of two."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    n, power = 1, _BASE
    while n < length:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each ``width`` neighbours."""
    n, out = 1, values
    while 2 * n <= width:
        out = best(out[:-n], out[n:])
        n *= 2
    return best(out[: len(out) - (width - n)], out[width - n :]) if width > n else out


def anchors(codes: np.ndarray, bounds: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors chosen in the texts between ``bounds``.

    In each window that has the length of a span, the anchor with the least hash is chosen, so what is chosen
    depends on nothing outside the window, and equal spans choose the same.
    """
    width = span - anchor + 1
    if len(codes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(codes, anchor)
    for end in bounds[1:-1]:  # anchors that reach over a bound are none
        h[max(0, end - anchor + 1) : end] = _TOP
    least = _sliding(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.nonzero((_sliding(padded, width, np.maximum) == h) & (h != _TOP))[0]
    return at, h[at]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points, bounds) of some rows at a time."""
    texts, rows, size = [], [], 0
    for i, text in enumerate(batch["text"].to_pylist()):
        texts.append(text)
        rows.append(i)
        size += len(text)
        if size >= _WORK:
            yield _joined(texts, rows)
            texts, rows, size = [], [], 0
    if texts:
        yield _joined(texts, rows)


def _joined(texts: list[str], rows: list[int]):
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.array(rows), codes, np.append(0, np.cumsum([len(t) for t in texts]))


def _bloom(shared: DataFrame, bits: int) -> np.ndarray:
    """One bit for each shared hash, in a map of 2**bits bits, whatever the data's size."""
    slot = F.pmod(F.col("anchor"), F.lit(1 << bits)) + 1  # Spark's bitmap functions count from 1
    parts = shared.groupBy(F.call_function("bitmap_bucket_number", slot).alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", slot)).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = (row["b"] - 1) * 4096
        piece = np.frombuffer(row["m"], np.uint8)[: max(0, len(out) - at)]
        out[at : at + len(piece)] |= piece
    return out


def shared_spans(docs: DataFrame, key: str, text: str, length: int = 120, anchor: int = ANCHOR, max_bloom_bits: int = 30) -> DataFrame:
    """(key, span_start, span_end): maximal stretches made of substrings of ``length`` that another key has too.

    Sentences can't serve as units here, since a span may start and end within one; so the text is cut at
    places that its content fixes (winnowed anchors, at least one in any ``length`` code points), and the runs
    around them are hashed and joined globally as runs of sentences would be:

    1. Anchors are grouped by hash; those of a single key are done with. The first and last key are kept, so
       the groups combine before the shuffle and a group of any size is one row.
    2. Of the anchors that remain, a bitmap of bounded size (2**max_bloom_bits bits at most) goes to the
       second pass over the texts, which yields the surroundings of each such anchor; an exact semi-join
       removes what the bitmap let through by chance.
    3. Surroundings that two keys share settle all their substrings at once. The others, at the ends of copied
       passages, are compared with one representative of their anchor; only where two keys agree beyond what
       that tells, each substring of ``length`` is hashed (96 bits) and counted by first and last key.
    4. The stretches found are united on run bitmaps.

    Repetition within one key is no case. Null texts, texts under ``length`` and null keys give no rows; whole
    texts are searched; repeated rows change nothing; other columns are ignored.
    """
    around = length - anchor
    named = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    kind = named.schema["doc"].dataType.simpleString()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, bounds in _groups(batch):
                at, h = anchors(codes, bounds, length, anchor)
                row = np.searchsorted(bounds, at, "right") - 1
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(row)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch["doc"].take(pa.array(rows[row[new]]))], ["anchor", "doc"])

    found = named.mapInArrow(first_pass, f"anchor long, doc {kind}")
    grouped = found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = checkpointed(grouped.where("lo <> hi").select("anchor"))
    bits = min(max_bloom_bits, max(20, (16 * shared.count()).bit_length()))
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(shared, bits))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for batch in batches:
            texts = batch["text"]
            for rows, codes, bounds in _groups(batch):
                at, h = anchors(codes, bounds, length, anchor)
                slot = h & np.uint64((1 << bits) - 1)
                keep = (known[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at, h = at[keep], h[keep]
                row = np.searchsorted(bounds, at, "right") - 1
                start = np.maximum(at - around, bounds[row])
                end = np.minimum(at + anchor + around, bounds[row + 1])
                base = bounds[row]
                context, last, whole = [], -1, ""
                for r, a, b, z in zip(row, start, end, base, strict=True):
                    if r != last:
                        last, whole = r, texts[int(rows[r])].as_py()
                    context.append(whole[a - z : b - z])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch["doc"].take(pa.array(rows[row])), pa.array(start - base), pa.array((at - start).astype(np.int32)), pa.array(context, pa.string())],
                    ["anchor", "doc", "start", "lead", "context"],
                )

    seen = named.mapInArrow(second_pass, f"anchor long, doc {kind}, start long, lead int, context string")
    seen = seen.join(shared, "anchor", "left_semi").withColumn("class", F.xxhash64("context", "lead"))
    seen = checkpointed(seen)
    classes = seen.groupBy("anchor", "class").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.any_value("context").alias("context"), F.any_value("lead").alias("lead"))
    classes = classes.withColumn("several", F.col("lo") != F.col("hi"))

    # Surroundings shared as a whole, and what is shared of those that aren't.
    settled = classes.where("several").select("anchor", "class", F.array(F.struct(F.lit(0).alias("a"), F.length("context").alias("b"))).alias("parts"))
    stretches = _partly_shared(classes, length, anchor)
    parts = settled.unionByName(stretches.groupBy("anchor", "class").agg(F.collect_set(F.struct("a", "b")).alias("parts")))
    stretches = seen.select("anchor", "class", "doc", "start").join(parts, ["anchor", "class"]).select("doc", "start", F.explode("parts").alias("p"))
    stretches = stretches.select("doc", (F.col("start") + F.col("p.a")).alias("span_start"), (F.col("start") + F.col("p.b")).alias("span_end"))
    united = continuous_periods(checkpointed(stretches), ["doc"], "span_start", "span_end").where("kind = 'period'")
    return united.select(F.col("doc").alias(key), "span_start", "span_end")


def _common(a: str, b: str) -> int:
    """How many characters two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _partly_shared(classes: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, class, a, b): stretches of the surroundings of one key only that another key has too.

    ``classes`` has (anchor, class, lo, hi, several, context, lead): distinct surroundings of an anchor, which
    begins ``lead`` characters in, with their first and last key. Each is compared with one representative
    of the anchor, of several keys if there is one: what both have around the anchor is shared if it is long
    enough. Beyond that, on the left or on the right, something can be shared only with surroundings that
    leave the representative at the same place by the same character; where two keys do, all substrings of
    ``length`` that reach there are hashed and counted. Anchors with different surroundings in the
    representative's own and only key have all their substrings hashed.
    """
    around = length - anchor
    open_ = classes.where("NOT several").select("anchor").distinct()
    classes = classes.join(open_, "anchor", "left_semi")
    chosen = classes.groupBy("anchor").agg(F.max(F.struct("several", "class", "lo", "lead", "context")).alias("r"))
    chosen = chosen.select(F.col("anchor").alias("r_anchor"), *(F.col(f"r.{c}").alias(f"r_{c}") for c in ("several", "class", "lo", "lead", "context")))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left, right = [], []
            for text, lead, other, other_lead in zip(frame["context"], frame["lead"], frame["r_context"], frame["r_lead"], strict=True):
                if text[lead : lead + anchor] != other[other_lead : other_lead + anchor]:  # a chance hit of hashes
                    left.append(-1)
                    right.append(-1)
                else:
                    left.append(_common(text[:lead][::-1], other[:other_lead][::-1]))
                    right.append(_common(text[lead + anchor :], other[other_lead + anchor :]))
            yield frame.drop(columns="r_context").assign(left=left, right=right)

    fields = "anchor long, class long, lo {0}, hi {0}, several boolean, context string, lead int, r_several boolean, r_class long, r_lo {0}, r_lead int".format(classes.schema["lo"].dataType.simpleString())
    pairs = classes.join(chosen, F.col("anchor") == F.col("r_anchor")).drop("r_anchor")
    pairs = checkpointed(pairs.select(*(f.split()[0] for f in fields.split(", ")), "r_context").mapInPandas(compare, fields + ", left int, right int"))
    other = F.col("class") != F.col("r_class")
    entangled = pairs.where(other & ~F.col("several") & ~F.col("r_several") & (F.col("lo") == F.col("r_lo"))).select("anchor").distinct()
    plain = pairs.where(other).join(entangled, "anchor", "left_anti")

    meets = plain.where(F.col("left") + F.col("right") >= around)
    with_chosen = meets.where("NOT several").select("anchor", "class", (F.col("lead") - F.col("left")).alias("a"), (F.col("lead") + anchor + F.col("right")).alias("b"))
    of_chosen = meets.where("NOT r_several").groupBy("anchor", F.col("r_class").alias("class")).agg(F.max(F.col("r_lead")).alias("lead"), F.max("left").alias("left"), F.max("right").alias("right"))
    of_chosen = of_chosen.select("anchor", "class", (F.col("lead") - F.col("left")).alias("a"), (F.col("lead") + anchor + F.col("right")).alias("b"))

    # Where surroundings leave the representative: the anchor with all up to the first different character.
    to_left = F.when(F.col("left") < F.col("lead"), F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring("context", F.col("lead") - F.col("left"), F.col("left") + 1 + anchor)).alias("piece")))
    to_right = F.when(F.col("lead") + anchor + F.col("right") < F.length("context"), F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring("context", F.col("lead") + 1, F.col("right") + 1 + anchor)).alias("piece")))
    leaving = plain.select("anchor", "class", "lo", "hi", "several", F.explode(F.filter(F.array(to_left, to_right), lambda p: p.isNotNull())).alias("p")).select("anchor", "class", "lo", "hi", "several", "p.*")
    forks = leaving.groupBy("anchor", "side", "piece").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.bool_and("several").alias("known")).where("first <> last AND NOT known").select("anchor", "side", "piece")
    forked = leaving.join(forks, ["anchor", "side", "piece"], "left_semi").groupBy("anchor", "class").agg(F.max((F.col("side") == 0).cast("int")).alias("on_left"), F.max((F.col("side") == 1).cast("int")).alias("on_right"))

    columns = ["anchor", "class", "lo", "hi", "several", "context", "lead", "left", "right"]
    whole = pairs.join(entangled, "anchor", "left_semi").select(*columns, F.lit(1).alias("on_left"), F.lit(1).alias("on_right")).withColumns({"left": F.lit(-1), "right": F.lit(-1)})
    looked = plain.select(*columns).join(forked, ["anchor", "class"]).unionByName(whole).where(F.length("context") >= length)
    # A substring begins ``lead - o`` characters before the anchor and ends ``around`` less that after it.
    beyond = ((F.col("on_left") == 1) & (F.col("lead") - F.col("o") > F.col("left"))) | ((F.col("on_right") == 1) & (around - F.col("lead") + F.col("o") > F.col("right")))
    window = F.substring("context", F.col("o") + 1, F.lit(length))
    windows = looked.withColumn("o", F.explode(F.sequence(F.lit(0), F.length("context") - length))).where(beyond)
    windows = windows.select("anchor", "class", "lo", "hi", "several", "o", F.xxhash64(window).alias("h"), F.hash(window).alias("g"))
    common = windows.groupBy("h", "g").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first <> last").select("h", "g")
    found = windows.where("NOT several").join(common, ["h", "g"], "left_semi").select("anchor", "class", F.col("o").alias("a"), (F.col("o") + length).alias("b"))
    return with_chosen.unionByName(of_chosen).unionByName(found)


def shared_amount(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """(key, n_chars, n_spans, shared_chars): how much of each row stands elsewhere; zeros for null texts and none."""
    spans = shared_spans(docs, key, text, **how)
    per = spans.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("c"))
    rows = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("bigint").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.join(per, F.col(key) == F.col("__key"), "left").select(key, "n_chars", zero(F.col("n")).alias("n_spans"), zero(F.col("c")).alias("shared_chars"))


#: Sentences end after a full stop, question or exclamation mark (and a closing quote), or at a line end; put together they are the text again.
_SENTENCES = re.compile(r"[^.!?。！？\n]*[.!?。！？]+[\"”»']*\s*|[^.!?。！？\n]+\n*|\n+")


def remove_repeated_sentences(docs: DataFrame, key: str, text: str, run: int = 3, min_chars: int = 120) -> DataFrame:
    """(key, text, removed): texts without the sentences that a non-first copy of a repeated run covers.

    Every run of ``run`` consecutive sentences with ``min_chars`` code points or more is hashed and grouped
    globally; the copy with the least (key, place) is the first and stays, within one text too. Keys must be
    unique. Null texts stay null with removed 0; texts of fewer sentences than ``run`` stay as they are.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            docs_, places, hashes = [], [], []
            for doc, body in zip(frame["doc"], frame["text"], strict=True):
                parts = _SENTENCES.findall(body)
                for i in range(len(parts) - run + 1):
                    joined = "".join(parts[i : i + run])
                    if len(joined) >= min_chars:
                        docs_.append(doc)
                        places.append(i)
                        hashes.append(hashlib.blake2b(joined.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc": docs_, "i": places, "h": both[:, 0], "g": both[:, 1]})

    runs = rows.where(F.col("text").isNotNull()).mapInPandas(hashed, f"doc {kind}, i long, h long, g long")
    first = runs.groupBy("h", "g").agg(F.min(F.struct("doc", "i")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = runs.join(first, ["h", "g"]).where((F.col("doc") != F.col("first.doc")) | (F.col("i") != F.col("first.i")))
    starts = later.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list("i").alias("starts"))
    both = rows.join(starts, F.col("doc") == F.col("__doc"), "left").drop("__doc")

    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, removed = [], []
            for body, at in zip(frame["text"], frame["starts"], strict=True):
                parts = _SENTENCES.findall(body)
                gone = np.zeros(len(parts), bool)
                for k in range(run):
                    gone[np.asarray(at) + k] = True
                texts.append("".join(np.asarray(parts, object)[~gone]))
                removed.append(int(gone.sum()))
            yield pd.DataFrame({"doc": frame["doc"], "text": texts, "removed": removed})

    cut = both.where(F.col("starts").isNotNull()).select("doc", "text", "starts").mapInPandas(drop, f"doc {kind}, text string, removed long")
    kept = both.where(F.col("starts").isNull()).select("doc", "text", F.lit(0).cast("bigint").alias("removed"))
    return kept.unionByName(cut).select(F.col("doc").alias(key), "text", "removed")
