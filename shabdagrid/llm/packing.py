"""Problem 8: fixed-capacity containers with as little unused room as possible.

Method: bin completion branch-and-bound.  The largest item left opens a container; the fillings of the rest of it are enumerated, fullest
first, without those that another filling dominates.  A branch ends where its waste exceeds what the number of containers aimed at
allows, or where it leaves items that already failed; then the last choice is undone.  The aim starts at a lower bound and rises to the
incumbent, which is best-fit, so that the first plan found is one of fewest containers.  Items of one size are interchangeable, so
the search runs over the histogram of sizes, which has at most `capacity` classes however many items there are: that, and nothing
else, reaches the driver.  A filling is applied as often as its classes allow before fewer times are tried.  The items then take their
places by distributed ranks within their size class.

The problem is NP-hard: where SEARCH_STEPS fillings do not settle it, the best plan so far is taken, with a warning that names its gap to
the lower bound.  Every item is packed in any case.

Defined results: an item over the capacity is divided into full pieces and a rest; no other item is divided.  Items of size 0
are spread evenly over the containers (over one container if nothing else exists).  Null sizes count as 0.
"""

from __future__ import annotations

import math
import random
import warnings
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shabdagrid.lineage import Scratch

CAPACITY = 2048
SEARCH_STEPS, RUNS = 400_000, 8
RANK_ROWS = 1_000_000
PLACES_MAX = 100_000

Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: the incumbent solution."""
    open_: dict[int, list[tuple[Filling, int]]] = defaultdict(list)
    done: Plan = []

    def put(filling: Filling, room: int, times: int) -> None:
        (open_[room] if room else done).append((filling, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size and open_[r]), default=None)
            if room is None:
                filling, room, times = (), capacity, max(1, left // (capacity // size))
            else:
                filling, times = open_[room].pop()
            most = room // size
            full = min(times, left // most)
            if full:
                put((*filling, (size, most)), room - most * size, full)
                left -= full * most
            rest = times - full
            if rest and left and left < most:
                put((*filling, (size, left)), room - left * size, 1)
                rest, left = rest - 1, 0
            if rest and filling:
                open_[room].append((filling, rest))
    return done + [x for xs in open_.values() for x in xs]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any plan needs: items over half share none, and room left beside those that go with items of at least k is lost."""
    sizes = sorted((s, n) for s, n in counts.items() if n)
    best = math.ceil(sum(s * n for s, n in sizes) / capacity)
    for k in {0, *(s for s, _ in sizes if 2 * s <= capacity)}:
        alone = sum(n for s, n in sizes if s > capacity - k)
        half = [(s, n) for s, n in sizes if capacity - k >= s and 2 * s > capacity]
        small = sum(s * n for s, n in sizes if k <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, math.ceil((small - room) / capacity)))
    return best


def fillings(left: dict[int, int], capacity: int, waste: int, steps: list[int]) -> Iterator[tuple[Filling, int]]:
    """(filling, waste) around the largest item left, fullest first; those that waste too much or are dominated are passed over.

    A filling is dominated where an item left out would fit beside it, in the place of a smaller item, or in that of two items.
    """
    sizes = sorted(left, reverse=True)
    largest = sizes[0]
    have = [left[s] - (s == largest) for s in sizes]
    steps[0] -= len(sizes) // 100
    rest = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        rest[i] = rest[i + 1] + sizes[i] * have[i]

    def exactly(i: int, room: int, chosen: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        steps[0] -= 1
        if room == 0:
            yield chosen
        while i < len(sizes) and room and steps[0] > 0 and rest[i] >= room:
            s = sizes[i]
            i += 1
            for n in range(min(room // s, have[i - 1]), 0, -1):
                yield from exactly(i, room - n * s, [*chosen, (s, n)])

    for w in range(min(waste, capacity - largest) + 1):
        for chosen in exactly(0, capacity - largest - w, []):
            used = dict(chosen)
            out = sorted(s for s, h in zip(sizes, have) if h > used.get(s, 0))
            fits = lambda low, high: bisect_right(out, high) > bisect_left(out, low)  # noqa: E731, B023
            items = [s for s, n in chosen for _ in range(min(n, 2))]
            if w and (fits(1, w) or any(fits(s + 1, s + w) for s in used)):
                continue
            if any(fits(x + y, x + y + w) for i, x in enumerate(items) for y in items[i + 1 :]):
                continue
            used[largest] = used.get(largest, 0) + 1
            yield tuple(sorted(used.items(), reverse=True)), w
        if steps[0] <= 0:
            return


def _shuffled(options: Iterator[tuple[Filling, int]], rnd: random.Random) -> Iterator[tuple[Filling, int]]:
    """The same fillings, those of a handful that come together in another order."""
    while some := list(islice(options, 16)):
        rnd.shuffle(some)
        yield from sorted(some, key=lambda x: x[1])


def search(counts: dict[int, int], capacity: int, bins: int, steps: list[int], run: int = 0) -> Plan | None:
    """A plan of at most `bins` containers, None where there is none or the steps ran out (steps[0] <= 0).

    Runs other than the first take fillings that waste the same in another order: where one order is lost in a branch without
    a plan, another seldom is.
    """
    rnd = random.Random(run)
    left = {s: n for s, n in counts.items() if n}
    waste = bins * capacity - sum(s * n for s, n in left.items())
    if waste < 0:
        return None
    failed: set[tuple] = set()

    def choices(left: dict[int, int], waste: int) -> Iterator[tuple[Filling, int, int]]:
        options = fillings(left, capacity, waste, steps)
        for filling, w in _shuffled(options, rnd) if run else options:
            most = min(left[s] // n for s, n in filling)
            for times in range(min(most, waste // w) if w else most, 0, -1):
                yield filling, w, times

    stack = [(left, waste, choices(left, waste))]
    plan: Plan = []
    while stack:
        left, waste, options = stack[-1]
        if not left:
            return plan
        step = next(options, None)
        if steps[0] <= 0:
            return None
        if step is None:
            failed.add(tuple(sorted(left.items())))
            stack.pop()
            if plan:
                plan.pop()
            continue
        filling, w, times = step
        after = {s: n for s, n in ((s, n - times * dict(filling).get(s, 0)) for s, n in left.items()) if n}
        if tuple(sorted(after.items())) in failed:
            continue
        plan.append((filling, times))
        stack.append((after, waste - w * times, choices(after, waste - w * times) if after else iter(())))
    return None


def fill(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> Plan:
    """Fillings and how often each is used, for a histogram of sizes from 1 to capacity."""
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    if used * capacity - sum(s * n for s, n in counts.items()) < capacity:
        return best  # less than one container's room is unused: the finer bound cannot ask for fewer
    least = lower_bound(counts, capacity)
    low, aim = least, least
    while low < used:  # the lower bound first, then between what is ruled out and the incumbent
        plan, left = None, [0]
        for run in range(RUNS):
            left = [steps // (2 if run == 0 else 2 * RUNS)]
            plan = search(counts, capacity, aim, left, run)
            if plan is not None or left[0] > 0:
                break
        if plan is not None:
            best, used = plan, sum(n for _, n in plan)
        else:
            least = aim + 1 if left[0] > 0 and aim >= least else least
            low = aim + 1
        aim = (low + used) // 2
        steps = steps // 2
    if least < used:
        warnings.warn(f"{used} containers; the search did not settle whether fewer, at least {least}, would do", stacklevel=2)
    return best


def _places(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, items of that size in a container, first container) for every filling."""
    at: dict[int, int] = defaultdict(int)
    rows, container = [], 1
    for filling, times in plan:
        for size, n in filling:
            rows.append((size, at[size], at[size] + n * times, n, container))
            at[size] += n * times
        container += times
    return rows


def divided(sizes: DataFrame, id_col: str, size: str, capacity: int) -> DataFrame:
    """One row per item, or per piece of an item over the capacity."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = sizes.select(id_col, n.alias("_n"), F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int").alias("n_pieces"))
    parts = parts.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece_no").cast("long") * capacity
    return parts.select(id_col, "piece_no", "n_pieces", start.alias("start"), F.least(F.lit(capacity), F.col("_n") - start).alias("size"))


def pack(sizes: DataFrame, id_col: str, size: str, capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> DataFrame:
    """(id_col, piece_no, n_pieces, start, size, container) for every item of `sizes`."""
    spark: SparkSession = sizes.sparkSession
    items = Scratch(spark, "packing").cut(divided(sizes, id_col, size, capacity))
    counts = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # at most capacity + 1 rows
    empty = counts.pop(0, 0)
    plan = fill(counts, capacity, steps)
    used = sum(n for _, n in plan)
    slices = max(8, math.ceil(max([empty, *counts.values()], default=1) / RANK_ROWS))
    cell = items.withColumn("_cell", F.pmod(F.xxhash64(id_col, "piece_no"), F.lit(slices)).cast("int"))
    w = Window.partitionBy("size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cell.groupBy("size", "_cell").count().select("size", "_cell", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("size", "_cell").orderBy(id_col, "piece_no")
    ranked = cell.withColumn("_in", F.row_number().over(inner) - 1).join(before, ["size", "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in"))
    rows = _places(plan) or [(1, 0, 0, 1, 1)]
    places = spark.createDataFrame(rows, "_s long, _from long, _to long, _each long, _first long")
    # a few rows for each of at most `capacity` sizes: bounded by the histogram, not by the items; sent to all tasks only while small
    placed = ranked.join(
        F.broadcast(places) if len(rows) <= PLACES_MAX else places, (F.col("size") == F.col("_s")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")), "left"
    )
    at = F.when(F.col("size") == 0, F.col("_rank") % max(1, used) + 1).otherwise(
        F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))
    )
    return placed.select(id_col, "piece_no", "n_pieces", "start", "size", at.cast("long").alias("container"))
