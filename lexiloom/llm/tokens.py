"""Encoding whole corpora with a public byte-level tokenizer through a table of distinct words."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to the vocabulary; (?U) makes \s cover Unicode's white space in Java too.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The most frequent words, at most this many, are looked up in place; the rest are joined by a shuffle.
HEAD_WORDS = 1 << 17


def split_words(text: Column) -> Column:
    """The tokenizer's words of a text, which put together are the text again; none of a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0)), F.array().cast("array<string>"))


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def word_table(docs: DataFrame, text: str, vocabulary: bytes) -> DataFrame:
    """(word, n, ids): each distinct word of the corpus, how often it stands there, and its ids, encoded once."""
    counted = docs.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            ids = pa.array([encoder.encode_ordinary(w) for w in batch["word"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], ids], ["word", "n", "ids"])

    return counted.mapInArrow(encode, "word string, n long, ids array<int>")


def _gather(found: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, word_offsets: np.ndarray) -> pa.ListArray:
    """The lists numbered ``found`` one after the other, as one list per row of words."""
    size = lengths[found]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    take = np.arange(total) + np.repeat(starts[found] - (ends - size), size)
    at = np.concatenate([[0], ends])[word_offsets].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values[take], pa.int32()))


def _plain(words: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in one array, and where each row's words start."""
    offsets = words.offsets.to_numpy()
    return words.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def encode(docs: DataFrame, key: str, text: str, vocabulary_path: str = VOCABULARY, head_words: int = HEAD_WORDS) -> DataFrame:
    """(key, ids array<int>): the ids of every row's text, without special tokens.

    Method: words are split in the JVM; each distinct word is encoded once; ids come back to the words by
    position. Word counts are steep, so the table's head, at most ``head_words`` words and so of bounded
    size, is shipped to every task and looked up there; a rarer word leaves a gap. If the table has a tail,
    rows are written once with their gaps, the distinct words of the gaps are encoded, joined by word and
    spliced in by position. One row comes out for each row that goes in, repeated keys too; null and empty
    texts have the ids []; other columns are ignored. ``vocabulary_path`` is read by the driver.

    Texts with a code point that the JVM's Unicode tables don't have yet, which they can't tell to be a letter
    or not, are split by newer tables in the task.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    docs = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    known_to_jvm = ~F.coalesce(F.col("__text").rlike(r"\p{Cn}"), F.lit(False))
    table = word_table(docs.where(known_to_jvm), "__text", vocabulary)
    head_rows = table.orderBy(F.desc("n"), "word").limit(head_words + 1).select("word", "ids").toArrow()
    whole = head_rows.num_rows <= head_words
    head = spark.sparkContext.broadcast(head_rows.slice(0, head_words).combine_chunks())
    shipped = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema["__key"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, exact = head.value, None
        words, lists = (known[c].combine_chunks() if known.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        # The last list, empty, stands for words that aren't in the head.
        starts, lengths = starts.astype(np.int64), np.append(np.diff(starts), 0)
        for batch in batches:
            flat, offsets = _plain(batch["words"])
            found = pc.fill_null(pc.index_in(flat, value_set=words), len(words)).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
            gap = np.flatnonzero(found == len(words))
            ends = np.append(0, np.cumsum(lengths[found]))
            row = np.searchsorted(offsets, gap, "right") - 1
            gaps = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(batch)))).astype(np.int32))
            ids = _gather(found, starts, lengths, values, offsets)
            if batch["odd"].null_count < len(batch):
                exact = exact or _exact(shipped.value)
                ids = pa.array([i if t is None else exact(t) for i, t in zip(ids.to_pylist(), batch["odd"].to_pylist(), strict=True)], pa.list_(pa.int32()))
            rare = pa.ListArray.from_arrays(gaps, flat.take(pa.array(gap)))
            at = pa.ListArray.from_arrays(gaps, pa.array((ends[gap] - ends[offsets[row]]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["__key"], batch["h"], batch["g"], ids, rare, at], ["__key", "h", "g", "ids", "rare", "at"])

    body = F.coalesce("__text", F.lit(""))
    hashes = [F.xxhash64(body).alias("h"), F.hash(body).alias("g")] if not whole else [F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("g")]
    split = docs.select("__key", *hashes, split_words(F.when(known_to_jvm, F.col("__text"))).alias("words"), F.when(~known_to_jvm, F.col("__text")).alias("odd"))
    rows = split.mapInArrow(look_up, f"__key {kind}, h long, g int, ids array<int>, rare array<string>, at array<int>")
    if whole:
        return rows.select(F.col("__key").alias(key), "ids")

    rows = checkpointed(rows)
    gapped = rows.where(F.size("rare") > 0)
    each = gapped.select("h", "g", F.explode(F.array_distinct("rare")).alias("word")).distinct()
    own = each.join(_encoded(each.select("word").distinct(), shipped), "word").groupBy("h", "g").agg(F.collect_list(F.struct("word", "ids")).alias("own"))

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, rare, at, words in zip(batch["ids"], batch["rare"].to_pylist(), batch["at"].to_pylist(), batch["own"].to_pylist(), strict=True):
                mine = {w["word"]: w["ids"] for w in words}
                fill = [mine[w] for w in rare]
                out.append(np.insert(ids.values.to_numpy(), np.repeat(at, [len(f) for f in fill]), [i for f in fill for i in f]))
            yield pa.RecordBatch.from_arrays([batch["__key"], pa.array(out, pa.list_(pa.int32()))], ["__key", "ids"])

    filled = gapped.join(own, ["h", "g"]).select("__key", "ids", "rare", "at", "own").mapInArrow(splice, f"__key {kind}, ids array<int>")
    return rows.where(F.size("rare") == 0).select("__key", "ids").unionByName(filled).select(F.col("__key").alias(key), "ids")


def _encoded(words: DataFrame, shipped) -> DataFrame:
    """(word, ids) of distinct words (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            ids = pa.array([encoder.encode_ordinary(w) for w in batch["word"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["word"], ids], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _exact(vocabulary: bytes):
    """The ids of a text, its words split by the tables of the ``regex`` module."""
    import regex

    pattern, encoder = regex.compile(SPLIT.removeprefix("(?U)")), _encoder(vocabulary)
    return lambda text: [i for w in pattern.findall(text) for i in encoder.encode_ordinary(w)]


def id_pieces(spark, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(id, piece): the bytes of every id of the vocabulary."""
    with open(vocabulary_path, "rb") as f:
        rows = [(int(rank), bytearray(base64.b64decode(piece))) for piece, rank in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, key: str, ids: str = "ids", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(key, text): the inverse of ``encode``, through a join with the id-to-piece table, which is of fixed size.

    Keys must be unique; an empty list gives ''. A null list gives a null text.
    """
    pieces = F.broadcast(id_pieces(encoded.sparkSession, vocabulary_path))
    rows = encoded.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{ids}`").alias("__ids"))
    each = rows.select("__key", F.posexplode("__ids").alias("pos", "id")).join(pieces, "id")
    joined = each.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("hex")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda p: p["hex"]), "")), "UTF-8")
    back = rows.join(joined.select("__key", text.alias("text")), "__key", "left")
    return back.select(F.col("__key").alias(key), F.when(F.col("__ids").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"))
