"""The most similar vectors of many vectors: coarse parts, scans of four-bit tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import checkpointed

#: Vectors of a model, at most, that parts and probes are fitted on, and those of them that codebooks are fitted on.
SAMPLE, CODE_SAMPLE = 16_384, 4_096
#: Coordinates per code; each code has four bits.
BLOCK = 2
_CODES = 16
#: Parts of a model, at most; larger models have larger parts, which are cut into blocks of rows.
MAX_PARTS = 1024
#: Neighbours of a sampled vector that the number of probes is fitted on.
_NEAR = 100
_SCANNED_AT_ONCE = (4096, 64)  # rows, queries


@dataclass
class Model:
    """What is known of a model's vectors from its sample."""

    books: np.ndarray  # (blocks, 16, BLOCK)
    centres: np.ndarray  # (parts, dimension)
    sizes: np.ndarray  # rows of each part, estimated
    probes: int  # parts a query looks into
    row_blocks: np.ndarray  # of each part
    query_blocks: int


def _parts(x: np.ndarray) -> np.ndarray:
    """(n, blocks, BLOCK), padded with zeros."""
    pad = -x.shape[1] % BLOCK
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, BLOCK)


def assign(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (n, blocks) that make the score-aware error small: the squared error, its part along x weighted by eta.

    One block at a time, given the error along x of all the others.
    """
    parts = _parts(x)
    # With p a part and c an entry: (p - c).p and |p - c|^2, from the products of all parts with all entries.
    dots = np.matmul(parts.transpose(1, 0, 2), books.transpose(0, 2, 1))
    whole = (parts**2).sum(2).T[:, :, None]
    own, square = whole - dots, whole - 2 * dots + (books**2).sum(2)[:, None, :]
    codes = square.argmin(2)
    picked = lambda m: own[m][np.arange(len(x)), codes[m]]
    along = sum((picked(m) for m in range(len(own))), np.zeros(len(x), x.dtype))
    for _ in range(rounds):
        for m in range(len(own)):
            others = along - picked(m)
            codes[m] = (square[m] + (eta - 1) * (others[:, None] + own[m]) ** 2).argmin(1)
            along = others + picked(m)
    return codes.T.astype(np.uint8)


def fit(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Codebooks (blocks, 16, BLOCK) for unit vectors, by turns of assigning and weighted least squares."""
    parts = _parts(x)
    rng = np.random.default_rng(seed)
    books = np.stack([parts[rng.integers(0, len(x), _CODES), m] for m in range(parts.shape[1])])
    books += rng.normal(0, 1e-4, books.shape).astype(x.dtype)
    for turn in range(rounds):
        weight = eta if turn >= rounds // 2 else 1.0
        codes = assign(x, books, weight, 1 if weight > 1 else 0)
        decoded = np.stack([books[m][codes[:, m]] for m in range(books.shape[0])], 1)
        along = ((parts - decoded) * parts).sum((1, 2))
        for m in range(books.shape[0]):
            p = parts[:, m]
            others = along - ((p - decoded[:, m]) * p).sum(1)
            outer = np.eye(BLOCK)[None] + (weight - 1) * p[:, :, None] * p[:, None, :]
            target = p * (1 + (weight - 1) * (others + (p * p).sum(1)))[:, None]
            mine = (codes[:, m, None] == np.arange(_CODES)).astype(x.dtype)
            used = mine.any(0)
            left, right = (mine.T @ outer.reshape(len(x), -1)).reshape(_CODES, BLOCK, BLOCK), mine.T @ target
            books[m, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
    return books.astype(np.float32)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte, the first in the low half."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries): for each byte of two codes, each query's table entries added, in steps of one size per query.

    An entry for one code has eight bits; a sum over a whole vector fits into 16.
    """
    entry = np.einsum("qmd,mjd->mjq", _parts(queries), books)
    entry -= entry.min(1, keepdims=True)
    small = np.round(entry * (255 / np.maximum(entry.max((0, 1), keepdims=True), 1e-30))).astype(np.uint16)
    if len(small) % 2:
        small = np.concatenate([small, np.zeros_like(small[:1])])
    return (small[::2, None, :, :] + small[1::2, :, None, :]).reshape(len(small) // 2, 256, -1)


def scan_tables(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(queries, rows): the sum of table entries for each row of packed codes (bytes, rows), which orders rows by score."""
    out = np.empty((table.shape[2], packed.shape[1]), np.int32)
    for a in range(0, packed.shape[1], _SCANNED_AT_ONCE[0]):
        some = packed[:, a : a + _SCANNED_AT_ONCE[0]]
        total = table[0].take(some[0], 0)
        entry = np.empty_like(total)
        for byte, code in zip(table[1:], some[1:], strict=True):
            total += byte.take(code, 0, out=entry, mode="clip")
        out[:, a : a + some.shape[1]] = total.T
    return out


def weight_along(dimension: int, threshold: float) -> float:
    """How much more an error along the vector counts, when scores over ``threshold`` matter."""
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


def _matrix(vectors: pd.Series, dimension: int) -> np.ndarray:
    """Vectors of stored numbers, of four or eight bytes each, scaled to length 1."""
    dtype = np.float32 if len(vectors.iloc[0]) == 4 * dimension else np.float64
    x = np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), dimension).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str, dimension: str, model: str) -> DataFrame:
    """(model, id, dim, v): vectors that can be compared, each id once; v has the stored numbers as bytes.

    Null vectors and ids, those of another length than ``dimension``, with a null, NaN or infinite number, or
    without any but zeros are left out. The model is told apart by dimension too; a null model is one of its
    own. Of different vectors with one id, the least (model, bytes) stays.
    """
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    numbers, kind = (pa.float32(), np.float32) if single else (pa.float64(), np.float64)
    rows = vectors.select(F.coalesce(F.col(f"`{model}`"), F.lit("")).alias("model"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{dimension}`").cast("int").alias("dim"), F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND size(v) = dim AND dim > 0")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"]
            flat = v.flatten().cast(numbers).to_numpy(zero_copy_only=False).astype(kind)  # nulls become NaN
            dims = batch["dim"].to_numpy()
            starts = np.cumsum(dims) - dims
            keep = np.zeros(0, bool)
            if len(dims):
                bad = np.logical_or.reduceat(~np.isfinite(flat), starts)
                keep = ~bad & np.logical_or.reduceat(flat != 0, starts)
            whole, size = flat.tobytes(), flat.itemsize
            held = pa.array([whole[s * size : (s + d) * size] for s, d in zip(starts[keep].tolist(), dims[keep].tolist(), strict=True)], pa.binary())
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch["model"].take(at), batch["id"].take(at), batch["dim"].take(at), held], ["model", "id", "dim", "v"])

    checked = rows.mapInArrow(check, "model string, id long, dim int, v binary")
    named = checked.withColumn("model", F.concat_ws(":", "model", F.col("dim").cast("string")))
    return named.groupBy("id").agg(F.min(F.struct("model", "dim", "v")).alias("r")).select("r.model", "id", "r.dim", "r.v")


def _centres(x: np.ndarray, n: int, rounds: int = 6, seed: int = 2) -> np.ndarray:
    """``n`` unit vectors that the rows of x lie near to; a part left empty takes a row of the fullest one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds if n > 1 else 1):
        part = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        empty = np.bincount(part, minlength=n) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def learn(x: np.ndarray, n_rows: int, n_queries: int, threshold: float, rows_per_part: int, rows_per_block: int, queries_per_block: int, probe_recall: float) -> Model:
    """Codebooks, parts and probes of a model of ``n_rows`` vectors from a sample x of unit vectors.

    Probes are as many parts, nearest centre first, as hold the share ``probe_recall`` of the nearest
    ``_NEAR`` rows of the sample to some of its rows; the nearest in the whole model are nearer still.
    """
    books = fit(x[:CODE_SAMPLE], weight_along(x.shape[1], threshold))
    n_parts = int(min(max(1, n_rows // rows_per_part), MAX_PARTS, max(1, len(x) // 64)))
    centres = _centres(x, n_parts)
    part = (x @ centres.T).argmax(1)
    share = np.bincount(part, minlength=n_parts) / len(x)
    probes = n_parts
    if n_parts > 1:
        q = x[:256]
        near = np.argsort(-(q @ x.T), 1)[:, 1 : _NEAR + 1]
        place = np.argsort(np.argsort(-(q @ centres.T), 1), 1)  # of each part, by query
        depth = np.sort(np.take_along_axis(place, part[near], 1).ravel())
        probes = int(depth[min(len(depth) - 1, int(np.ceil(probe_recall * len(depth))))]) + 1
    sizes = np.maximum(share * n_rows, 1)
    return Model(books, centres, sizes, probes, np.ceil(sizes / rows_per_block).astype(int), -(-max(n_queries, 1) // queries_per_block))


def _models(index: DataFrame, queries: DataFrame, sample: int, **how) -> dict[str, Model]:
    """What the samples tell, by model; small arrays of fixed size reach the driver."""
    of = lambda df: {r["model"]: r["n"] for r in df.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows, n_queries = of(index), of(queries)
    places = 1 << 30
    least = F.lit(0)
    for name, n in n_rows.items():
        least = F.when(F.col("model") == name, F.lit(places if n <= sample else int(places * sample / n))).otherwise(least)
    place = F.pmod(F.xxhash64("id"), F.lit(places))
    chosen = index.where(F.col("model").isin(list(n_queries))).where(place < least).select("model", "dim", place.alias("place"), "id", "v")

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "id"]).iloc[:sample]
        name = frame["model"].iloc[0]
        m = learn(_matrix(frame["v"], int(frame["dim"].iloc[0])).astype(np.float32), n_rows[name], n_queries[name], **how)
        return pd.DataFrame({"model": [name], "books": [m.books.tobytes()], "centres": [m.centres.tobytes()], "dim": [m.centres.shape[1]], "sizes": [m.sizes.tobytes()], "probes": [m.probes], "blocks": [m.row_blocks.astype(np.int64).tobytes()], "query_blocks": [m.query_blocks]})

    rows = chosen.groupBy("model").applyInPandas(train, "model string, books binary, centres binary, dim int, sizes binary, probes int, blocks binary, query_blocks int").collect()
    return {
        r["model"]: Model(np.frombuffer(r["books"], np.float32).reshape(-1, _CODES, BLOCK), np.frombuffer(r["centres"], np.float32).reshape(-1, r["dim"]), np.frombuffer(r["sizes"]), r["probes"], np.frombuffer(r["blocks"], np.int64), r["query_blocks"])
        for r in rows
    }


def most_similar(
    index: DataFrame, asked: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, rerank: int = 6, rerank_least: int = 320, rows_per_part: int = 8_192, rows_per_block: int = 32_768, queries_per_block: int = 8_192, probe_recall: float = 0.995
) -> DataFrame:
    """(id, rank, other, cosine): the k most similar other vectors of each vector asked for, within its model.

    ``index`` is as ``usable`` gives it; ``asked`` has (id, k). Ids without a usable vector and k under 1 or
    null give no rows; of several k for one id the largest counts. Ties go to the smaller id. If a model has
    fewer than k others, all of them come out. Models must be few: a sample of each is one task.

    Method: codebooks of 16 entries for every two coordinates are fitted on a bounded sample, under a loss in
    which an error along the vector, which shifts its score, weighs more than one across it. Every row is
    encoded and belongs to the part of its nearest centre; a query meets as many parts as the sample needs for
    ``probe_recall`` of its neighbours, all of them if its vectors have no parts. Large parts are cut into
    blocks of rows, many queries into blocks of queries. In a block, each query's table of eight-bit entries is
    summed over the four-bit codes in integers; the best max(rerank_least, rerank * k) rows by these sums are
    compared exactly there, and k of them leave the block.
    """
    spark = index.sparkSession
    index = checkpointed(index)
    queries = asked.where((F.col("k") >= 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("k").cast("int").alias("k"))
    queries = checkpointed(index.join(queries, "id").select("model", "id", "dim", "v", "k"))
    known = spark.sparkContext.broadcast(_models(index, queries, sample, threshold=threshold, rows_per_part=rows_per_part, rows_per_block=rows_per_block, queries_per_block=queries_per_block, probe_recall=probe_recall))

    def spread(ids: np.ndarray, n, seed: int) -> np.ndarray:
        mixed = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.asarray(n, np.uint64)).astype(np.int64)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, mine in frame.groupby("model", sort=False):
                m = known.value.get(name)
                if m is None:
                    continue
                x = _matrix(mine["v"], m.centres.shape[1]).astype(np.float32)
                part = (x @ m.centres.T).argmax(1)
                codes = pack_codes(assign(x, m.books, weight_along(x.shape[1], threshold)))
                ids = mine["id"].to_numpy()
                out = pd.DataFrame({"model": name, "part": part, "rb": spread(ids, m.row_blocks[part], 1), "id": ids, "v": mine["v"].to_numpy(), "codes": [c.tobytes() for c in codes]})
                for qb in range(m.query_blocks):
                    yield out.assign(qb=qb)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, mine in frame.groupby("model", sort=False):
                m = known.value[name]
                x = _matrix(mine["v"], m.centres.shape[1]).astype(np.float32)
                order = np.argsort(-(x @ m.centres.T), 1)
                enough = np.cumsum(m.sizes[order], 1) >= 50 * mine["k"].to_numpy()[:, None]
                depth = np.maximum(m.probes, np.where(enough[:, -1], enough.argmax(1) + 1, order.shape[1]))
                row, at = np.nonzero(np.arange(order.shape[1])[None] < depth[:, None])
                part = order[row, at]
                again = m.row_blocks[part]
                row, part = np.repeat(row, again), np.repeat(part, again)
                rb = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
                out = mine.iloc[row].assign(part=part, rb=rb)
                yield out.assign(qb=spread(out["id"].to_numpy(), m.query_blocks, 2))[["model", "part", "rb", "qb", "id", "v", "k"]]

    keys = ["model", "part", "rb", "qb"]
    coded = index.select("model", "id", "v").mapInPandas(encode, "model string, part long, rb long, qb long, id long, v binary, codes binary")
    probing = queries.select("model", "id", "v", "k").mapInPandas(probe, "model string, part long, rb long, qb long, id long, v binary, k int")

    def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            m = known.value[q["model"].iloc[0]]
            packed = np.ascontiguousarray(np.frombuffer(b"".join(c["codes"]), np.uint8).reshape(len(c), -1).T).astype(np.intp)
            x, rows = _matrix(q["v"], m.centres.shape[1]), _matrix(c["v"], m.centres.shape[1])
            ids, asked_ids, k = c["id"].to_numpy(), q["id"].to_numpy(), q["k"].to_numpy()
            wants = np.maximum(rerank_least, rerank * k) + 1
            for a in range(0, len(x), _SCANNED_AT_ONCE[1]):
                some = slice(a, a + _SCANNED_AT_ONCE[1])
                most = min(int(wants[some].max()), len(ids))
                if most < len(ids):
                    best = np.argpartition(-scan_tables(tables(x[some], m.books), packed), most - 1, 1)[:, :most]
                else:
                    best = np.broadcast_to(np.arange(len(ids)), (len(x[some]), len(ids)))
                out += [_nearest(asked_ids[i], k[i], x[i], rows, ids, near[ids[near] != asked_ids[i]]) for i, near in enumerate(best, a)]
        return _rows(out)

    near = probing.groupBy(*keys).cogroup(coded.groupBy(*keys)).applyInPandas(scan, "id long, k int, other long, cosine double")
    return _ranked(near)


def _nearest(query: int, k: int, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, near: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(query, k, others, cosines): the k rows out of ``near`` with the largest cosines; numbers that differ by rounding only are ties."""
    cosine = np.round(np.einsum("ij,j->i", rows[near], x), 12)
    first = np.lexsort((ids[near], -cosine))[:k]
    return query, k, ids[near[first]], cosine[first]


def _rows(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    n = [len(f[2]) for f in found]
    joined = lambda at, kind: np.concatenate([f[at] for f in found]) if found else np.zeros(0, kind)
    return pd.DataFrame({"id": np.repeat([f[0] for f in found], n).astype(np.int64), "k": np.repeat([f[1] for f in found], n).astype(np.int32), "other": joined(2, np.int64), "cosine": joined(3, np.float64)})


def _ranked(near: DataFrame) -> DataFrame:
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= F.col("k")).select("id", F.col("rank").cast("bigint").alias("rank"), "other", "cosine")


def brute_force(index: DataFrame, asked: DataFrame, rows_per_block: int = 32_768, queries_per_block: int = 2_048) -> DataFrame:
    """(id, rank, other, cosine) as ``most_similar`` gives it, from all cosines; to measure recall with.

    Blocks of queries meet all blocks of rows of their model.
    """
    queries = asked.where((F.col("k") >= 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("k").cast("int").alias("k"))
    queries = index.join(queries, "id").select("model", "id", "dim", "v", "k")
    n_rb, n_qb = -(-max(index.count(), 1) // rows_per_block), -(-max(queries.count(), 1) // queries_per_block)
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["model", "rb", "qb"]
    left = queries.select("model", "dim", "id", "v", "k", block(n_qb, 1).alias("qb"), every(n_rb).alias("rb"))
    right = index.select(F.col("model").alias("model"), F.col("id").alias("other"), F.col("v").alias("w"), block(n_rb, 2).alias("rb"), every(n_qb).alias("qb"))

    def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, rows = (_matrix(v, int(q["dim"].iloc[0])) for v in (q["v"], c["w"]))
            ids, k = c["other"].to_numpy(), q["k"].to_numpy()
            for i, query in enumerate(q["id"]):
                near = np.flatnonzero(ids != query)
                if len(near) > 2 * k[i]:  # those that rounding could let in as well
                    rough = rows[near] @ x[i]
                    near = near[rough >= np.partition(rough, -k[i])[-k[i]] - 1e-9]
                out.append(_nearest(query, k[i], x[i], rows, ids, near))
        return _rows(out)

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, "id long, k int, other long, cosine double")
    return _ranked(near)
