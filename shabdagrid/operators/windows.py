"""Order-aware operators over ordered rows: runs, forward fills, resetting counters, spans, files seen before.

A group (a file, a user) may hold a third of all rows.  Every operator therefore takes `block`, a column that is
non-decreasing in the order, such as floor(line_no / 50000) or the day of a timestamp: rows are then scanned by (group,
block) in parallel, one summary row per block is scanned by group, and what a block inherits from those before it is joined back on
the same partitioning.  Without `block` a group is one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _join(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys; right has the same key names."""
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return df.join(r, on, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def running_count(df: DataFrame, group: list[str], order: list[str], flag: Column, out: str, before: bool = False, block: Column | None = None) -> DataFrame:
    """Number of rows up to this one (or before it) that are flagged."""
    x = df.withColumn("__w_f", F.coalesce(flag.cast("long"), F.lit(0)))
    end = -1 if before else 0
    if block is None:
        w = _w(group, order).rowsBetween(Window.unboundedPreceding, end)
        return x.withColumn(out, F.coalesce(F.sum("__w_f").over(w), F.lit(0))).drop("__w_f")
    x = x.withColumn("__w_b", block)
    keys = [*group, "__w_b"]
    x = x.withColumn("__w_n", F.coalesce(F.sum("__w_f").over(_w(keys, order).rowsBetween(Window.unboundedPreceding, end)), F.lit(0)))
    prior = F.coalesce(F.sum("__w_t").over(_w(group, ["__w_b"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = x.groupBy(*keys).agg(F.sum("__w_f").alias("__w_t")).withColumn("__w_p", prior).drop("__w_t")
    return _join(x, sums, keys).withColumn(out, F.col("__w_n") + F.coalesce("__w_p", F.lit(0))).drop("__w_f", "__w_b", "__w_n", "__w_p")


def last_known(df: DataFrame, group: list[str], order: list[str], value: str, out: str, block: Column | None = None, before: bool = False) -> DataFrame:
    """The last non-null value up to this row (or before it) in its group."""
    end = -1 if before else 0
    if block is None:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(_w(group, order).rowsBetween(Window.unboundedPreceding, end)))
    x = df.withColumn("__w_b", block)
    keys = [*group, "__w_b"]
    x = x.withColumn("__w_v", F.last(value, ignorenulls=True).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, end)))
    newest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    prior = F.last("__w_l", ignorenulls=True).over(_w(group, ["__w_b"]).rowsBetween(Window.unboundedPreceding, -1))
    sums = x.groupBy(*keys).agg(newest.alias("__w_l")).withColumn("__w_p", prior).drop("__w_l")
    return _join(x, sums, keys).withColumn(out, F.coalesce("__w_v", "__w_p")).drop("__w_b", "__w_v", "__w_p")


def run_id(df: DataFrame, group: list[str], order: list[str], key: Column, out: str = "run", block: Column | None = None) -> DataFrame:
    """Number of the run of equal keys a row belongs to; a key that returns later starts a new run.  Nulls equal nulls.

    One scan by block counts the changes inside it; its first and last key tell whether it goes on with the run before."""
    x = df.withColumn("__w_b", F.lit(0) if block is None else block).withColumn("__w_k", F.struct(key.alias("k")))
    keys = [*group, "__w_b"]
    w = _w(keys, order)
    prev = F.lag("__w_k").over(w)
    x = x.withColumn("__w_c", (prev.isNotNull() & ~prev["k"].eqNullSafe(F.col("__w_k.k"))).cast("long"))
    x = x.withColumn("__w_n", F.sum("__w_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if block is None:
        return x.withColumn(out, F.col("__w_n") + 1).drop("__w_b", "__w_k", "__w_c", "__w_n")
    at = F.struct(*order)
    sums = x.groupBy(*keys).agg(F.sum("__w_c").alias("__w_t"), F.min_by("__w_k", at).alias("__w_a"), F.max_by("__w_k", at).alias("__w_z"))
    g = _w(group, ["__w_b"])
    before = F.lag("__w_z").over(g)
    sums = sums.withColumn("__w_o", (before.isNull() | ~before["k"].eqNullSafe(F.col("__w_a.k"))).cast("long"))
    upto = F.sum(F.col("__w_t") + F.col("__w_o")).over(g.rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("__w_p", upto - F.col("__w_t")).select(*keys, "__w_p")
    return _join(x, sums, keys).withColumn(out, F.col("__w_n") + F.col("__w_p")).drop("__w_b", "__w_k", "__w_c", "__w_n", "__w_p")


def carry_forward(df: DataFrame, group: list[str], order: list[str], levels: list[str], block: Column | None = None) -> DataFrame:
    """Every level filled with its last known value; a lower level is forgotten when a level above it is set anew.

    One scan finds for every level where it was set last and to what; a value stands if no level above was set after it."""
    at = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    x = df.withColumn("__w_b", F.lit(0) if block is None else block)
    keys = [*group, "__w_b"]
    for n, level in enumerate(levels):
        x = x.withColumn(f"__w_s{n}", F.when(F.col(level).isNotNull(), F.struct(F.struct(*at).alias("at"), F.col(level).alias("v"))))
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    ns = range(len(levels))
    y = x.select("*", *[F.last(f"__w_s{n}", ignorenulls=True).over(w).alias(f"__w_l{n}") for n in ns])
    if block is not None:
        sums = x.groupBy(*keys).agg(*[F.max_by(f"__w_s{n}", F.col(f"__w_s{n}.at")).alias(f"__w_m{n}") for n in ns])
        prior = _w(group, ["__w_b"]).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*keys, *[F.last(f"__w_m{n}", ignorenulls=True).over(prior).alias(f"__w_p{n}") for n in ns])
        y = _join(y, sums, keys).select("*", *[F.coalesce(f"__w_l{n}", f"__w_p{n}").alias(f"__w_f{n}") for n in ns])
    last = "__w_l" if block is None else "__w_f"
    filled = {}
    for n, level in enumerate(levels):
        stands = F.lit(True)
        for above in range(n):
            stands = stands & F.coalesce(F.col(f"{last}{above}.at") <= F.col(f"{last}{n}.at"), F.lit(True))
        filled[level] = F.when(stands, F.col(f"{last}{n}.v"))
    return y.select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def reset_counter(df: DataFrame, group: list[str], order: list[str], key: Column, out: str, block: Column | None = None) -> DataFrame:
    """1 for the first run of `key` in a group, 2 for the next, ..."""
    return run_id(df, group, order, key, out, block)


def span_to_next(df: DataFrame, group: list[str], order: list[str], start: str, end: Column, out: str = "span_end") -> DataFrame:
    """Where a row's span ends: at the start of the next row, for the last row at `end`.  Meant for the few marker rows of a group."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(_w(group, order)), end))


def shifted_groups(df: DataFrame, group: list[str], order: list[str], closes: Column, out: str = "grp", block: Column | None = None) -> DataFrame:
    """Group number of lines buffered until a closing line; the closing line ends its group."""
    return running_count(df, group, order, closes, out, before=True, block=block)


def first_files(df: DataFrame, file: str, order: list[str], text: str, block: Column | None = None) -> DataFrame:
    """(file, first_file): the first file with the same lines in the same order; unlike files stand for themselves.

    A file's lines are reduced to an order-sensitive digest through (position, hash) pairs that are combined before the shuffle.
    """
    lines = running_count(df.where(F.col(text).isNotNull()), [file], order, F.lit(True), "__pos", block=block)
    digest = lines.groupBy(file).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.pmod(F.xxhash64("__pos", text), F.lit(1 << 30))).alias("d1"),
        F.bit_xor(F.xxhash64(F.lit(7), "__pos", text)).alias("d2"),
    )
    firsts = digest.groupBy("lines", "d1", "d2").agg(F.min(file).alias("first_file"))
    return digest.join(firsts, ["lines", "d1", "d2"]).select(file, "first_file", "lines")
