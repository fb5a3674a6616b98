"""Problem 2: records that are the same but for white space, letter case, punctuation or field order.

Method: progressive partition refinement.  Every record first falls into a class by cheap invariants (which fields are null,
how many letters and digits each has); only inside classes with several members a histogram of all letters of each field is taken; only inside
the classes that remain, the costly key - the canonically composed word sequence of every field - is computed, and equal
keys make copies.  Each step is balanced for classes of any size by with_group().

Defined results: a null field equals only a null field; a field without any word ('', '—') equals any other such field.
Letters with their marks and numerals make words; everything else, the underscore too, parts them.
Equal ids in two tables do not meet: the table name is part of every key.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shabdagrid.lineage import Scratch
from shabdagrid.operators.skew import with_group

FIELDS = ["subject", "relation", "object", "citation"]


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Precomposed letters and their base letters, as the two arguments of translate()."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x2000), *range(0xF900, 0xFB50)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if d != chr(cp) and unicodedata.category(d[0])[0] == "L":
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


def stripped(c: Column) -> Column:
    """Letters and digits alone, lower case, without marks: the same for every formatting of one text."""
    return F.regexp_replace(F.lower(F.translate(c, *_bases())), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(T.StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([t if t is None else unicodedata.normalize("NFC", t) for t in s], dtype=object)


def word_key(fields: list[str]) -> Column:
    """The word sequences of all fields in one string; null fields are marked."""
    clean = [F.translate(F.col(f), "\u0001\u0002", "  ") for f in fields]
    joined = F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in clean])
    words = F.regexp_replace(F.lower(_composed(joined)), "[^\\p{L}\\p{M}\\p{N}\u0001\u0002]+", " ")
    return F.regexp_replace(words, "^ +| +$| *(\u0001) *", "$1")


def parse_objects(lines: DataFrame, id_col: str, line: str, fields: list[str] = FIELDS) -> DataFrame:
    """Records of landed JSON lines: the object between the first and last brace, field names in any case.

    Lines that hold no well-formed object are no records and give no row; a field that is absent or null is null.
    """
    body = F.nullif(F.regexp_extract(F.col(line), r"(?s)\{.*\}", 0), F.lit(""))
    m = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    kept = lines.select(F.col(id_col).alias("id"), F.map_entries(m).alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0))
    named = lambda f: F.filter("e", lambda x: F.lower(F.trim(x["key"])) == f)
    return kept.select("id", *[F.try_element_at(named(f), F.lit(1))["value"].alias(f) for f in fields])


def copies(df: DataFrame, id_col: str, fields: list[str] = FIELDS, tag: str = "tbl") -> DataFrame:
    """(tag, keep_id, copy_id, copies): keep_id is the lowest id of each class, copy_id every other row's."""
    scratch = Scratch(df.sparkSession, "format-copies")
    bare = [stripped(F.col(f)) for f in fields]
    cheap = F.xxhash64(*[F.coalesce(F.length(b), F.lit(-1)) for b in bare])
    cur = df.select(tag, F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
    # Each level's key is written once: both branches of with_group() read it, the counting one without the texts.
    cur = scratch.cut(cur.withColumn("_b", F.concat_ws(" ", *bare)).withColumn("_k", cheap))
    cur = with_group(cur, [tag, "_k"], "id", {}, at_least=2)
    # The letters of a field in sorted order are its histogram, whatever the script.
    histograms = F.transform(F.split("_b", " "), lambda b: F.sort_array(F.split(b, "")))
    cur = scratch.cut(cur.withColumn("_k", F.xxhash64("_k", histograms)).select(tag, "id", *fields, "_k"))
    cur = with_group(cur, [tag, "_k"], "id", {}, at_least=2)
    words = cur.withColumn("_w", word_key(fields))
    slim = scratch.cut(words.select(tag, "id", F.xxhash64("_w").alias("k1"), F.xxhash64(F.lit("\u0001seed"), "_w").alias("k2")))
    grouped = with_group(slim, [tag, "k1", "k2"], "id", {"keep_id": (F.col("id"), "min")}, at_least=2)
    return grouped.where("id != keep_id").select(tag, "keep_id", F.col("id").alias("copy_id"), F.col("group_rows").alias("copies"))


def collapse(df: DataFrame, id_col: str, fields: list[str] = FIELDS, tag: str = "tbl") -> DataFrame:
    """One row per record with the number of its copies (1 where it stands alone)."""
    found = Scratch(df.sparkSession, "format-collapse").cut(copies(df, id_col, fields, tag))
    heads = found.groupBy(tag, F.col("keep_id").alias(id_col)).agg(F.max("copies").alias("copies"))
    gone = found.select(tag, F.col("copy_id").alias(id_col))
    kept = df.select(tag, id_col, *fields).join(gone, [tag, id_col], "left_anti")
    return kept.join(heads, [tag, id_col], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
