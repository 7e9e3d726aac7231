"""Joins and histograms over spans [start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bins of one level are so many times as wide as those of the level before.
_STEP = 64


def _binned(spans: DataFrame, start: str, end: str, width: int, levels: DataFrame) -> DataFrame:
    """``spans`` in bins of the level of their own length (``__own``), two at most, and of each higher level in ``levels``."""
    level = lambda size: F.greatest(F.lit(0), F.ceil(F.log(float(_STEP), size / width))).cast("int")
    rows = spans.withColumn("__level", level(F.col(end) - F.col(start))).join(F.broadcast(levels))
    both = F.concat(F.array(F.struct(F.col("__level").alias("level"), F.lit(True).alias("own"))), F.transform(F.filter("__levels", lambda x: x > F.col("__level")), lambda x: F.struct(x.alias("level"), F.lit(False).alias("own"))))
    rows = rows.withColumn("__at", F.explode(both))
    wide = (F.lit(width) * F.pow(F.lit(float(_STEP)), F.col("__at.level"))).cast("bigint")
    rows = rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor((F.col(end) - 1) / wide))))
    return rows.withColumns({"__own": F.col("__at.own"), "__level": F.col("__at.level"), "__wide": wide}).drop("__at", "__levels")


def _levels(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row with the levels that spans have; under a dozen."""
    level = F.greatest(F.lit(0), F.ceil(F.log(float(_STEP), (F.col(end) - F.col(start)) / width))).cast("int")
    return spans.agg(F.collect_set(level).alias("__levels"))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int = 1024, how: str = "inner") -> DataFrame:
    """Pairs of spans of the same key that overlap: left (on, start, end, ...), right (on, r_start, r_end, ...).

    Each span lies in at most two bins of a level that fits its length, and in bins of the other side's higher
    levels, so a span of any length makes few rows. The join is an equi-join on (key, level, bin) with the
    overlap as a residual; a pair counts at the level of its longer span, in the bin where its overlap begins,
    so none comes twice. Null or empty spans match nothing. ``how`` is inner or left; other columns must have
    different names.
    """
    a, b = left.where("start < end"), right.where("r_start < r_end")
    a_levels, b_levels = _levels(a, "start", "end", width), _levels(b, "r_start", "r_end", width)
    a = _binned(a, "start", "end", width, b_levels)
    hidden = ("__own", "__level", "__bin", "__wide")
    b = _binned(b, "r_start", "r_end", width, a_levels).withColumnsRenamed({c: f"__r{c}" for c in (*on, *hidden)})
    same = [F.col(c) == F.col(f"__r{c}") for c in (*on, "__level", "__bin")]
    begins = F.floor(F.greatest(F.col("start"), F.col("r_start")) / F.col("__wide")) == F.col("__bin")
    condition = [*same, F.col("__own") | F.col("__r__own"), F.col("start") < F.col("r_end"), F.col("end") > F.col("r_start"), begins]
    pairs = a.join(b, condition).drop(*hidden, *(f"__r{c}" for c in (*on, *hidden)))
    if how == "inner":
        return pairs
    alone = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def asof_join(points: DataFrame, marks: DataFrame, on: Sequence[str], point: str, mark: str, value: str, forward: bool = False, width: int = 1 << 16) -> DataFrame:
    """Each point with the ``value`` of the last mark at or before it, or with ``forward`` of the first at or after it; null without one.

    One sort per key and shard of ``width`` units over both sides instead of a range join. What a shard takes
    over from those before it comes from one row per shard with marks, so no task sorts a whole key.
    """
    sign = -1 if forward else 1
    shard = F.floor(F.col("__at") / width)
    kind = marks.schema[value].dataType
    a = points.select(*points.columns, (F.col(point) * sign).alias("__at"), F.lit(1).alias("__side"), F.struct(F.lit(None).cast(kind).alias("v")).alias("__v")).withColumn("__v", F.lit(None).cast(f"struct<v:{kind.simpleString()}>"))
    b = marks.where(F.col(mark).isNotNull()).select(*(F.col(c) if c in on else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns), (F.col(mark) * sign).alias("__at"), F.lit(0).alias("__side"), F.struct(F.col(value).alias("v")).alias("__v"))
    both = a.unionByName(b).withColumn("__shard", shard)
    inside = W.partitionBy(*on, "__shard").orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    last = both.where("__side = 0").groupBy(*on, "__shard").agg(F.max_by("__v", "__at").alias("__last"))
    known = last.unionByName(found.where("__found IS NULL").select(*on, "__shard", F.lit(None).cast(last.schema["__last"].dataType).alias("__last")).distinct())
    known = known.groupBy(*on, "__shard").agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = W.partitionBy(*on).orderBy("__shard").rowsBetween(W.unboundedPreceding, -1)
    carry = known.select(*(F.col(c).alias(f"__k{c}") for c in on), F.col("__shard").alias("__kshard"), F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    condition = [F.col(c) == F.col(f"__k{c}") for c in on] + [F.col("__shard") == F.col("__kshard")]
    out = found.join(carry, condition, "left")
    return out.select(*points.columns, F.coalesce("__found", "__carry")["v"].alias(value))


def nearest(points: DataFrame, marks: DataFrame, on: Sequence[str], point: str, mark: str, value: str, reach: int) -> DataFrame:
    """Each point with the ``value`` of the mark nearest to it, at most ``reach`` away; the one before it if two are as near."""
    at = marks.select(*on, mark, F.struct(F.col(mark).alias("at"), F.col(value).alias("v")).alias("__m"))
    both = asof_join(points, at, on, point, mark, "__m").withColumnRenamed("__m", "__before")
    both = asof_join(both, at, on, point, mark, "__m", forward=True)
    back, ahead = F.col(point) - F.col("__before.at"), F.col("__m.at") - F.col(point)
    far = reach + 1
    near = F.when(F.least(F.coalesce(back, F.lit(far)), F.coalesce(ahead, F.lit(far))) > reach, None)
    near = near.when(F.coalesce(back, F.lit(far)) <= F.coalesce(ahead, F.lit(far)), F.col("__before.v")).otherwise(F.col("__m.v"))
    return both.select(*points.columns, near.alias(value))


def density(spans: DataFrame, by: Sequence[str], length: Column, bins: int) -> DataFrame:
    """(by..., bin, n): how many spans touch each of ``bins`` bins of a text of ``length``, for all bins of each group.

    A bin is max(1, length // bins) wide; the last takes what is over. A long span counts in each bin it touches.
    """
    width = F.greatest(F.lit(1), F.floor(length / bins))
    at = lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(x / width))).cast("bigint")
    each = spans.where("start < end").select(*by, F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))).alias("bin"))
    counted = each.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(i.cast("bigint").alias("bin"), F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0)).cast("bigint").alias("n")))
    return per.select(*by, F.explode(every).alias("b")).select(*by, "b.bin", "b.n")


def flatten(spans: DataFrame, key: str, ident: str, width: int = 1 << 16) -> DataFrame:
    """(key, start, end, active): disjoint pieces between the bounds of spans, with the number of spans on each.

    An event sweep: +1 at starts, -1 at ends, summed along each shard of ``width`` units; what reaches into a
    shard comes from one row per earlier shard, so no task sorts a whole key.
    """
    valid = spans.where("start < end")
    events = valid.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).withColumn("shard", F.floor(F.col("at") / width))
    along = W.partitionBy(key).orderBy("shard")
    sums = steps.groupBy(key, "shard").agg(F.sum("d").alias("all"), F.min("at").alias("first"))
    sums = sums.select(F.col(key).alias("__key"), F.col("shard").alias("__shard"), F.coalesce(F.sum("all").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carry"), F.lead("first").over(along).alias("after"))
    inside = W.partitionBy(key, "shard").orderBy("at")
    run = steps.withColumn("own", F.sum("d").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(inside))
    run = run.join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("shard") == F.col("__shard")))
    run = run.select(key, F.col("at").alias("start"), F.coalesce("next", "after").alias("end"), (F.col("own") + F.col("carry")).alias("active"))
    return run.where("active > 0 AND end IS NOT NULL")


def active_sets(spans: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, start, end, ids): the pieces of ``flatten`` with the sorted ids of the spans on each."""
    pieces = flatten(spans, key, ident).select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    on = interval_join(spans.select(key, "start", "end", ident), pieces, [key])
    return on.groupBy(key, F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.array_sort(F.collect_set(ident)).alias("ids"))
