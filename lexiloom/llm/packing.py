"""Filling containers of one capacity with items of varying size."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

#: Containers tried in the search for a packing with fewer than the incumbent has.
NODES = 2000
#: Items of a size in one task, about, where they are numbered.
PER_SALT = 250_000

#: Sizes with how many of each lie in a container, the largest first, and the number of such containers.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


@dataclass
class Packing:
    plan: Plan
    containers: int
    least: int  # no packing has fewer

    @property
    def proven(self) -> bool:
        return self.containers == self.least


class _Room:
    """What can lie beside the largest item left: every total that the smaller sizes reach, from each place in their order on.

    Totals are the bits of one number, so the waste of the best filling that still can come is known exactly.
    """

    def __init__(self, counts: dict[int, int], largest: int, capacity: int):
        self.room = capacity - largest
        left = ((s, min(n - (s == largest), self.room // s)) for s, n in counts.items() if s <= self.room)
        self.sizes = sorted(((s, n) for s, n in left if n > 0), reverse=True)
        mask = (1 << self.room + 1) - 1
        self.reach = [1]
        for size, n in reversed(self.sizes):
            bits, step = self.reach[-1], 1
            while n:
                take = min(step, n)
                bits |= bits << size * take & mask
                n -= take
                step *= 2
            self.reach.append(bits)
        self.reach.reverse()

    def fullest(self) -> tuple[tuple[int, int], ...]:
        """The filling with the least waste; of several, the one with the largest items, which none dominates."""
        return next(self.fillings(self.room - self.reach[0].bit_length() + 1))

    def fillings(self, waste: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """The fillings that leave exactly ``waste``, those with larger items first."""

        def at(place: int, total: int, chosen: tuple) -> Iterator[tuple[tuple[int, int], ...]]:
            while place < len(self.sizes) and (total == 0 or self.sizes[place][0] > total):
                place += 1
            if total == 0:
                yield chosen
                return
            if place == len(self.sizes):
                return
            size, n = self.sizes[place]
            for k in range(min(n, total // size), -1, -1):
                if self.reach[place + 1] >> (total - k * size) & 1:
                    yield from at(place + 1, total - k * size, (*chosen, (size, k)) if k else chosen)

        if 0 <= waste <= self.room and self.reach[0] >> (self.room - waste) & 1:
            yield from at(0, self.room - waste, ())

    def undominated(self, most_waste: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
        """(waste, filling) from little waste to much, without those that another filling dominates.

        A filling is dominated if an item left out fits into its waste, or into the place of a smaller one.
        """
        for waste in range(min(most_waste, self.room) + 1):
            for filling in self.fillings(waste):
                used = dict(filling)
                free = sorted(s for s, n in self.sizes if n > used.get(s, 0))
                if free and free[0] <= waste:
                    continue
                if any((at := bisect_left(free, c + 1)) < len(free) and free[at] <= c + waste for c in used):
                    continue
                yield waste, filling


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit in falling order, all items of a size and all containers of like content at once."""
    groups: dict[tuple[int, tuple], int] = Counter()
    rooms: list[tuple[int, tuple]] = []

    def add(room: int, content: tuple, n: int) -> None:
        if n and (room, content) not in groups:
            insort(rooms, (room, content))
        if n:
            groups[room, content] += n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, (size,))
            room, content = rooms[at] if at < len(rooms) else (capacity, ())
            n = groups[room, content] if at < len(rooms) else left
            each = room // size
            whole, rest = min(n, left // each), left % each if left // each < n else 0
            if at < len(rooms):
                groups[room, content] -= whole + (rest > 0)
                if not groups[room, content]:
                    del groups[room, content]
                    rooms.pop(at)
            add(room - each * size, (*content, (size, each)), whole)
            if rest:
                add(room - rest * size, (*content, (size, rest)), 1)
            left -= whole * each + rest
    return [(content, n) for (_, content), n in groups.items()]


def _take(counts: dict[int, int], filling: dict[int, int], times: int) -> None:
    for s, n in filling.items():
        counts[s] -= n * times
        if not counts[s]:
            del counts[s]


def _with(largest: int, filling: tuple[tuple[int, int], ...]) -> dict[int, int]:
    both = Counter(dict(filling))
    both[largest] += 1
    return dict(sorted(both.items(), reverse=True))


def completed(histogram: dict[int, int], capacity: int) -> Plan:
    """Each container in turn takes the fullest filling around the largest item left, as often as the sizes last."""
    counts, plan = dict(histogram), []
    while counts:
        largest = max(counts)
        room = capacity - largest
        whole = counts.get(room, 0) > (room == largest)  # one item that leaves nothing
        filling = _with(largest, ((room, 1),) if whole else _Room(counts, largest, capacity).fullest())
        times = min(counts[s] // n for s, n in filling.items())
        plan.append((tuple(filling.items()), times))
        _take(counts, filling, times)
    return plan


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing goes below: the total, or large items with what can't go beside them."""
    total = sum(s * n for s, n in histogram.items())
    best = -(-total // capacity)
    sizes = sorted(histogram, reverse=True)
    for k in [s for s in sizes if s <= capacity // 2] + [0]:
        alone = sum(n for s, n in histogram.items() if s > capacity - k)
        pairs = sum(n for s, n in histogram.items() if capacity - k >= s > capacity // 2)
        free = pairs * capacity - sum(s * n for s, n in histogram.items() if capacity - k >= s > capacity // 2)
        small = sum(s * n for s, n in histogram.items() if k <= s <= capacity // 2)
        best = max(best, alone + pairs + max(0, -(-(small - free) // capacity)))
    return best


def fill_plan(histogram: dict[int, int], capacity: int, nodes: int | None = NODES) -> Packing:
    """A packing of so many items of each size; items of one size are alike.

    Bin completion: the incumbent is the better of best fit in falling order and of the fullest filling around
    the largest item left. If it has more containers than must be, the search goes on over containers:
    around the largest item left, undominated fillings are tried from little waste to much, and a branch ends
    where its waste exceeds what a packing with fewer containers can have. At most ``nodes`` containers are
    tried, each filling being used as often as its sizes last; with ``nodes`` None the search is exact: one
    container at a time, until fewer containers are found or ruled out. That may take very long.
    """
    histogram = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    if not histogram:
        return Packing([], 0, 0)
    size = lambda plan: sum(n for _, n in plan)
    best = min((completed(histogram, capacity), best_fit(histogram, capacity)), key=size)
    least, total = least_containers(histogram, capacity), sum(s * n for s, n in histogram.items())
    seen = 0
    while size(best) > least:
        better, budget = None, (size(best) - 1) * capacity - total
        stack = [(iter([None]), dict(histogram), 0, None)]  # fillings to try, sizes left, waste so far, what led here
        while stack and better is None and (nodes is None or seen < nodes):
            options, counts, waste, step = stack[-1]
            option = next(options, False)
            if option is False:
                stack.pop()
                continue
            seen += 1
            if option is None:
                now, spent, made = counts, waste, None
            else:
                now = dict(counts)
                filling = _with(max(counts), option[1])
                times = 1 if nodes is None else min(counts[s] // n for s, n in filling.items())
                spent = waste + option[0] * times
                if spent > budget:
                    continue
                _take(now, filling, times)
                made = (tuple(filling.items()), times)
                if not now:
                    better = [s for *_, s in stack if s] + [made]
                    break
            stack.append((_Room(now, max(now), capacity).undominated(budget - spent), now, spent, made))
        if better is None:
            if nodes is None:
                least = size(best)
            break
        best = better
    return Packing(best, size(best), least)


def _slots(plan: Plan) -> dict[str, np.ndarray]:
    """Where the items of a size lie, by their number: from ``rank`` on, ``each`` in a container, in the containers from ``first`` on."""
    rows, used, first = [], Counter(), 0
    for filling, times in plan:
        for s, n in filling:
            rows.append((s, used[s], first, n))
            used[s] += times * n
        first += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return {"place": columns[0] << 40 | columns[1], "rank": columns[1], "first": columns[2], "each": columns[3]}


def pack(items: DataFrame, key: str, size: str, capacity: int, nodes: int | None = NODES, per_salt: int = PER_SALT) -> DataFrame:
    """(key, part, part_start, part_size, container): every item in a container of ``capacity`` units, under 2**22.

    An item larger than the capacity is split into full parts and a rest, no other; full parts have containers
    of their own, after the others. Items of one size can stand for each other, so the fillings are planned on
    the histogram of sizes, which has fewer rows than ``capacity`` however many items there are (see
    ``fill_plan``); so has the plan a bounded size, which is sent to the tasks. Items find their places by their
    number within their size; numbers are given per salt and shifted by the counts of the salts before, and
    there are more salts the more items there are, so a size that a third of all items share is spread.

    Items of size null, 0 or less take no room and come out with container null, in one part. Repeated rows are
    items of their own. Ties are broken by the key. An empty table gives no rows; other columns are ignored.
    """
    spark = items.sparkSession
    zero = F.lit(0).cast("bigint")
    named = items.select(F.col(f"`{key}`").alias("__key"), F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint"), zero).alias("__n"))
    named = checkpointed(named.select("__key", "__n", F.expr(f"__n div {capacity}").alias("full"), (F.col("__n") % capacity).alias("n")))
    salts = max(64, -(-named.count() // per_salt))
    named = named.withColumn("salt", F.pmod(F.xxhash64("__key", "__n"), F.lit(salts)))

    rests = named.where("n > 0")
    by_salt = rests.groupBy("n", "salt").agg(F.count(F.lit(1)).alias("items"))
    packing = fill_plan({r["n"]: r["items"] for r in by_salt.groupBy("n").agg(F.sum("items").alias("items")).collect()}, capacity, nodes)
    slots = spark.sparkContext.broadcast(_slots(packing.plan))

    before = by_salt.select(F.col("n").alias("__bn"), F.col("salt").alias("__bs"), (F.sum("items").over(W.partitionBy("n").orderBy("salt")) - F.col("items")).alias("before"))
    own = F.row_number().over(W.partitionBy("n", "salt").orderBy("__key")) - 1
    ranked = rests.withColumn("own", own).join(before, (F.col("n") == F.col("__bn")) & (F.col("salt") == F.col("__bs")))
    ranked = ranked.select("__key", F.col("full").alias("part"), (F.col("full") * capacity).alias("start"), "n", (F.col("own") + F.col("before")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = slots.value
        for frame in frames:
            rank = frame["rank"].to_numpy()
            at = np.searchsorted(s["place"], frame["n"].to_numpy() << 40 | rank, "right") - 1
            frame["container"] = s["first"][at] + (rank - s["rank"][at]) // s["each"][at]
            yield frame.drop(columns="rank")

    kind = named.schema["__key"].dataType.simpleString()
    placed = ranked.mapInPandas(place, f"__key {kind}, part long, start long, n long, container long")

    # Full parts: numbered by item, in the order of salt and key, then spread.
    large = named.where("full > 0")
    of_salt = large.groupBy("salt").agg(F.sum("full").alias("parts"))
    of_salt = of_salt.select(F.col("salt").alias("__bs"), (F.sum("parts").over(W.partitionBy(F.lit(0)).orderBy("salt")) - F.col("parts")).alias("before"))
    along = F.sum("full").over(W.partitionBy("salt").orderBy("__key").rowsBetween(W.unboundedPreceding, 0)) - F.col("full")
    large = large.withColumn("own", along).join(of_salt, F.col("salt") == F.col("__bs"))
    large = large.select("__key", (F.col("own") + F.col("before") + packing.containers).alias("first"), F.explode(F.sequence(zero, F.col("full") - 1)).alias("part"))
    large = large.select("__key", "part", (F.col("part") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n"), (F.col("first") + F.col("part")).alias("container"))

    empty = named.where("__n = 0").select("__key", zero.alias("part"), zero.alias("start"), zero.alias("n"), F.lit(None).cast("bigint").alias("container"))
    out = placed.unionByName(large).unionByName(empty)
    return out.select(F.col("__key").alias(key), F.col("part").cast("bigint").alias("part"), F.col("start").alias("part_start"), F.col("n").alias("part_size"), "container")
