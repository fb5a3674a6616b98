"""Problem 3: one group identifier for all records linked directly or through others.

Method: deterministic Boruvka hooking.  Every component selects its smallest outgoing edge under one total order, the
trees that these edges form collapse to their roots by pointer doubling, edges are relabelled with the roots and
deduplicated, until none remain.  The number of components that still have edges at least halves in every round.

Vertices are 16-byte digests of the names, so nothing needs to be numbered.  Each round's table is written to the shared folder;
the parent maps of the rounds are composed backwards, so the work over all vertices is done once.  Lookups on labels,
which may be hot (a hub, a giant component), go through the salted lookup().

Defined results: a null end is no link; a name linked only to itself forms no group; repeated and reversed pairs count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shabdagrid.lineage import Scratch
from shabdagrid.operators.skew import lookup

SALTS = 16


def _relabel(df: DataFrame, col: str, parent: DataFrame, id_col: str) -> DataFrame:
    r = parent.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
    return lookup(df, col, r, "_v", ["_p"], id_col, salts=SALTS).drop(col).withColumnRenamed("_p", col)


def hook(edges: DataFrame) -> DataFrame:
    """(v, p): for every component with an edge, the other end of its smallest edge; the smaller end of a pair that
    selected each other becomes the root and points to itself."""
    e = F.struct("lo", "hi").alias("e")
    ends = edges.select(F.col("lo").alias("v"), e).unionByName(edges.select(F.col("hi").alias("v"), e))
    best = ends.groupBy("v").agg(F.min("e").alias("e"))  # combined on the map side, so a hub is no burden
    other = F.when(F.col("v") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo"))
    picks = best.select("v", "e", other.alias("p"))
    mutual = picks.groupBy("e").agg((F.count(F.lit(1)) == 2).alias("mutual"))
    root = F.col("mutual") & (F.col("v") == F.col("e.lo"))
    return picks.join(mutual, "e").select("v", F.when(root, F.col("v")).otherwise(F.col("p")).alias("p"))


def collapse_trees(scratch: Scratch, parent: DataFrame) -> DataFrame:
    """Pointer doubling: p becomes the root of v's tree."""
    cur = scratch.cut(parent)
    while True:
        up = cur.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        nxt = lookup(cur, "p", up, "_v", ["_p"], "v", salts=SALTS).select("v", F.col("_p").alias("p"), (F.col("p") != F.col("_p")).alias("moved"))
        nxt = scratch.cut(nxt)
        scratch.drop(cur)
        cur = nxt.drop("moved")
        cur._scratch_path = nxt._scratch_path
        if nxt.where("moved").isEmpty():
            return cur


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(name, group_name) for every name that is linked to another one; group_name is the smallest of its group."""
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    raw = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null and a != b")
    named = scratch.cut(raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    digest = lambda c: F.unhex(F.md5(F.encode(F.col(c), "UTF-8")))
    edges = named.select(F.least(digest("a"), digest("b")).alias("lo"), F.greatest(digest("a"), digest("b")).alias("hi"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        parent = collapse_trees(scratch, hook(edges))
        maps.append(parent)
        step = _relabel(edges.withColumn("_id", F.concat("lo", "hi")), "lo", parent, "_id")
        step = _relabel(step, "hi", parent, "_id").where("lo != hi")
        edges = scratch.cut(step.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
    names = named.select(F.col("a").alias("name")).unionByName(named.select(F.col("b").alias("name"))).distinct()
    if not maps:
        return names.select("name", F.col("name").alias("group_name"))
    final = maps[-1]
    for m in reversed(maps[:-1]):
        up = final.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        final = lookup(m, "p", up, "_v", ["_p"], "v", how="left", salts=SALTS).select("v", F.coalesce("_p", "p").alias("p"))
    rooted = scratch.cut(names.withColumn("v", digest("name")).join(final, "v").select("name", F.col("p").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("name").alias("group_name"))
    return lookup(rooted, "root", heads.withColumnRenamed("root", "_r"), "_r", ["group_name"], "name", salts=SALTS).select("name", "group_name")
