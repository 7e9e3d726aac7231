"""Continuous periods and gaps of spans, on run-compressed bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

#: Units of a bitmap word, as a power of two: one BIGINT holds 64 of them.
WORD_BITS = 6
_WORD = 1 << WORD_BITS


def _bits(first: Column, last: Column) -> Column:
    """A word with the bits ``first`` to ``last`` set."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (_WORD - 1 - last + first).cast("int"))
    return F.call_function("shiftleft", ones, first.cast("int"))


def span_words(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Each span as at most two literal words and one fill (a run of full words): (keys, word, n_words, bits)."""
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    last = e - 1
    low, high = F.shiftright(s, WORD_BITS), F.shiftright(last, WORD_BITS)
    a, b = s.bitwiseAND(_WORD - 1), last.bitwiseAND(_WORD - 1)
    one = F.lit(1).cast("bigint")

    def part(word: Column, n: Column, bits: Column) -> Column:
        return F.struct(word.alias("word"), n.alias("n_words"), bits.alias("bits"))

    whole = part(low, one, _bits(a, b))
    pieces = F.array(part(low, one, _bits(a, F.lit(_WORD - 1))), part(high, one, _bits(F.lit(0), b)), part(low + 1, high - low - 1, F.lit(-1).cast("bigint")))
    parts = F.when(low == high, F.array(whole)).otherwise(F.filter(pieces, lambda p: p["n_words"] > 0))
    valid = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (s < e))
    return valid.select(*keys, F.explode(parts).alias("part")).select(*keys, "part.*")


def set_runs(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of set bits of each word or fill: (keys, run_start, run_end), half-open, in units."""
    bits, base = F.col("bits"), F.shiftleft(F.col("word"), WORD_BITS)
    starts = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1)))
    ends = bits.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(bits, 1)))
    upward = bits
    for step in (1, 2, 4, 8, 16, 32):  # all bits from the lowest set one upwards
        upward = upward.bitwiseOR(F.shiftleft(upward, step))
    first = _WORD - F.bit_count(upward)

    def places(mask: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda i: F.getbit(mask, i) == 1)

    def run(a: Column, b: Column) -> Column:
        return F.struct((base + a).cast("bigint").alias("run_start"), (base + b).cast("bigint").alias("run_end"))

    many = F.transform(F.arrays_zip(places(starts).alias("a"), places(ends).alias("b")), lambda p: run(p["a"], p["b"] + 1))
    runs = (
        F.when(F.col("n_words") > 1, F.array(run(F.lit(0), F.shiftleft(F.col("n_words"), WORD_BITS))))
        .when(F.bit_count(starts) == 1, F.array(run(first, first + F.bit_count(bits))))
        .otherwise(many)
    )
    return words.select(*keys, F.explode(runs).alias("run")).select(*keys, "run.*")


def continuous_periods(spans: DataFrame, keys: Sequence[str], start: str = "start_pos", end: str = "end_pos", shard_bits: int = 16) -> DataFrame:
    """Maximal covered stretches (``period``) and the stretches between them (``gap``) per entity.

    Returns (keys..., kind, <start>, <end>). Method: every span becomes a run-compressed bitmap of exact
    units (literal words and fills of full words); the words of an entity are united with ``bit_or``, which
    combines before the shuffle; set runs are read off the united words per entity and shard of
    2**shard_bits units, and the clear runs between them are the gaps. A shard knows what reaches into it
    from one summary row per earlier shard, so no task ever holds a whole entity.

    Rows with a null bound or start >= end are no spans; other bounds, negative ones too, count as stored.
    Null keys form an entity of their own. Repeated rows change nothing, an empty table gives no rows, other
    columns are ignored. Spans that touch are one period.
    """
    keys = list(keys)
    k = [f"__k{i}" for i in range(len(keys))]
    named = spans.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k, strict=True)), F.col(f"`{start}`").alias("__s"), F.col(f"`{end}`").alias("__e"))
    words = span_words(named, k, "__s", "__e")
    united = words.groupBy(*k, "word", "n_words").agg(F.bit_or("bits").alias("bits"))
    runs = checkpointed(set_runs(united, k).withColumn("shard", F.shiftright("run_start", shard_bits)))  # read three times

    # What lies before a shard, and what comes after: one row per entity and shard.
    by_entity = W.partitionBy(*k).orderBy("shard")
    reach = runs.groupBy(*k, "shard").agg(F.max("run_end").alias("reach"))
    reach = reach.select(*k, "shard", F.max("reach").over(by_entity.rowsBetween(W.unboundedPreceding, -1)).alias("carry"), F.max("reach").over(W.partitionBy(*k)).alias("entity_end"))
    runs = _join_null_safe(runs, reach, [*k, "shard"])

    in_shard = W.partitionBy(*k, "shard").orderBy("run_start")
    covered = F.greatest("carry", F.max("run_end").over(in_shard.rowsBetween(W.unboundedPreceding, -1)))
    opens = runs.withColumn("covered", covered).where(F.col("covered").isNull() | (F.col("run_start") > F.col("covered")))
    opens = opens.withColumn("next_covered", F.lead("covered").over(in_shard))
    firsts = opens.groupBy(*k, "shard").agg(F.min("covered").alias("first_covered"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.select(*k, "shard", F.lead("first_covered").over(by_entity).alias("after"))
    opens = _join_null_safe(opens, firsts, [*k, "shard"])

    def row(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    closes = F.coalesce("next_covered", "after", "entity_end")
    period, gap = row("period", F.col("run_start"), closes), row("gap", F.col("covered"), F.col("run_start"))
    rows = opens.select(*k, F.explode(F.when(F.col("covered").isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("r"))
    return rows.select(*(F.col(a).alias(c) for c, a in zip(keys, k, strict=True)), "r.kind", F.col("r.a").alias(start), F.col("r.b").alias(end))


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*(F.col(c).alias(f"__r{c}") if c in on else F.col(c) for c in right.columns))
    condition = [F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in on]
    return left.join(renamed, condition).drop(*(f"__r{c}" for c in on))
