"""The fact graph as a stored table: load with checks and fallback, incremental upsert and delete, mirror, migration with a count check.

A store is a folder of Parquet versions; a small file names the current one, and is written last, so that readers never see half a change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shabdagrid.operators import kg
from shabdagrid.sources.files import path_exists

FACT = "subject string, relation string, object string, citation string, note string, provenance string, seq long"
KEYS = ["subject_key", "relation", "object_key"]


def load(spark: SparkSession, path: str) -> DataFrame:
    """The current facts of a store, an empty table where there is none; rows without subject, relation or object are left out."""
    pointer = f"{path}/current"
    if not path_exists(spark, pointer):
        return spark.createDataFrame([], FACT)
    (name,) = spark.read.text(pointer).first()
    return spark.read.schema(FACT).parquet(f"{path}/{name}").where("subject is not null and relation is not null and object is not null")


def load_or(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """The facts of a store; those of the fallback where it is absent or empty."""
    stored = load(spark, path)
    return fallback if stored.isEmpty() else stored


def save(facts: DataFrame, path: str, mirror: str | None = None) -> int:
    """Write facts as the next version and return their number as counted in what was written; a mirror is JSON, one object a line."""
    spark = facts.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    facts.select(*[c.split()[0] for c in FACT.split(", ")]).write.parquet(f"{path}/{name}")
    written = spark.read.schema(FACT).parquet(f"{path}/{name}")
    n = written.count()
    if mirror:
        written.write.mode("overwrite").json(mirror)
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return n


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored facts and new ones: a triple that is there already takes the new statement's citation and note where it has them, and the
    higher trust; new statements come after the stored ones in `seq`."""
    last = stored.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("seq", F.col("seq") + last + 1).withColumn("_new", F.lit(1)))
    keyed = both.withColumn("subject_key", kg.entity_key(F.col("subject"))).withColumn("object_key", kg.entity_key(F.col("object")))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_new", "seq")))
    first = F.min(F.struct("seq", "subject", "object"))
    g = keyed.groupBy(*KEYS).agg(first.alias("f"), newest("citation").alias("citation"), newest("note").alias("note"), F.max_by("provenance", F.struct(kg.trust(F.col("provenance")), -F.col("seq"))).alias("provenance"))
    return g.select("f.subject", "relation", "f.object", "citation", "note", "provenance", "f.seq")


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored facts without the triples of gone(subject, relation, object), whatever the spelling of their names."""
    key = lambda df: df.select(kg.entity_key(F.col("subject")).alias("subject_key"), "relation", kg.entity_key(F.col("object")).alias("object_key")).distinct()
    keyed = stored.withColumn("subject_key", kg.entity_key(F.col("subject"))).withColumn("object_key", kg.entity_key(F.col("object")))
    return keyed.join(key(gone), KEYS, "left_anti").drop("subject_key", "object_key")


def migrate(entities: DataFrame, path: str) -> int:
    """Entities with nested relations into a store as triples; raises if the store then holds another number of facts."""
    t = kg.triples(entities)
    have = set(t.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in (x.split() for x in FACT.split(", ") if not x.startswith("seq"))]
    facts = t.select(*cols, F.monotonically_increasing_id().alias("seq")).where("subject is not null and relation is not null and object is not null")
    expected, n = facts.count(), save(facts, path)
    if n != expected:
        raise RuntimeError(f"{n} of {expected} facts arrived in {path}")
    return n
