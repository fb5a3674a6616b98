"""Grouping and lookup operators that stay balanced when one key holds a third of all rows.

The common device is a salt computed from a row's own id.  Per-key facts are first aggregated by
(key, salt), so no task sees more than one part in salts_for() of a hot key, then by key over as many rows at most, and
come back to the rows through a join on (key, salt).  Nothing is dropped, capped or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 32


def hash128(*cols: Column | str) -> Column:
    """Two independently seeded 64-bit hashes as a struct; equal values give equal hashes.

    A null column is skipped by xxhash64, so callers that tell null from empty pass an isnull flag as well.
    """
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("\u0001seed"), *cols).alias("b"))


def salts_for(spark: SparkSession) -> int:
    """A quarter of the shuffle partitions, SALTS at least: a key that holds a third of all rows then fills tasks no larger than a few
    others', however large the cluster is set up for."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def salt_of(id_col: str, salts: int = SALTS) -> Column:
    """A salt fixed by the row's id, so that a recomputed task gives the same one."""
    return F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(salts)).cast("int")


def with_group(
    df: DataFrame, keys: list[str], id_col: str, aggs: dict[str, tuple[Column, str]], at_least: int = 1, salts: int | None = None
) -> DataFrame:
    """Rows of df with per-key aggregates attached, for keys that have at_least rows.

    aggs maps an output name to (expression over rows, "min" | "max" | "sum").  A column `group_rows` with the
    number of rows of the key is always added.  Rows with a null key part form groups of their own (nulls equal).
    """
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    salted = df.withColumn("_salt", salt_of(id_col, salts or salts_for(df.sparkSession)))
    part = salted.groupBy(*keys, "_salt").agg(
        F.count(F.lit(1)).alias("group_rows"), *[fold[how](e).alias(n) for n, (e, how) in aggs.items()]
    )
    whole = part.groupBy(*keys).agg(
        F.sum("group_rows").alias("group_rows"),
        F.collect_list("_salt").alias("_salts"),
        *[fold[how](n).alias(n) for n, (_, how) in aggs.items()],
    )
    if at_least > 1:
        whole = whole.where(F.col("group_rows") >= at_least)
    spread = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_salt"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        salted.alias("l")
        .join(spread.alias("r"), cond)
        .select("l.*", *[f"r.{n}" for n in ["group_rows", *aggs]])
        .drop("_salt")
    )


def lookup(df: DataFrame, key: str, right: DataFrame, right_key: str, values: list[str], id_col: str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join values of `right`, which is unique by right_key, to df on a key that may be hot in df.

    The distinct (key, salt) pairs of df, at most `salts` per key, take the values first; df then joins them on
    (key, salt).  A null key finds nothing.
    """
    salted = df.withColumn("_salt", salt_of(id_col, salts or salts_for(df.sparkSession)))
    pairs = salted.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col("_salt").alias("_s")).distinct()
    found = pairs.join(right.select(F.col(right_key).alias("_k"), *values), "_k")
    out = salted.join(found, (salted[key] == found["_k"]) & (salted["_salt"] == found["_s"]), how)
    return out.drop("_k", "_s", "_salt")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the cluster has cores: small rows that cost much Python time would otherwise be
    coalesced by size into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
