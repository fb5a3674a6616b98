"""Landed lines -> verses -> chunks -> postings and lexicon, each a table of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shabdagrid.operators import lexical, parse, search

MARKER = r"(?:॥|।।|\|\|)\s*((?:[A-Z]{2} )?\d+\.\d+\.\d+)\s*(?:॥|।।|\|\|)\s*$"


def current_lines(lines: DataFrame) -> DataFrame:
    """The version of every (file, line_no) that was loaded last.

    One pre-aggregation by key: a line sent again any number of times is combined before the shuffle.
    """
    best = F.max_by(F.struct("text"), F.struct("loaded_at", F.coalesce("text", F.lit("")).alias("t")))
    return lines.groupBy("file", "line_no").agg(best.alias("b"), F.count(F.lit(1)).alias("versions")).select("file", "line_no", "b.text", "versions")


def verses(lines: DataFrame) -> DataFrame:
    """(file, line_no, corpus, book, hymn, verse, text) of the lines that end with a verse marker, in any of its spellings."""
    vid = F.regexp_extract("text", MARKER, 1)
    n = lambda i: F.regexp_extract(vid, r"(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    t = F.trim(F.regexp_replace("text", MARKER, ""))
    v = lines.where(F.col("text").isNotNull() & (vid != ""))
    return v.select("file", "line_no", F.regexp_extract(vid, "^([A-Z]{2})", 1).alias("corpus"), n(1).alias("book"), n(2).alias("hymn"), n(3).alias("verse"), t.alias("text"))


def passages(v: DataFrame) -> DataFrame:
    """(file, passage, n_verses, text): the verses of a hymn under its header, ordered by their numbers."""
    p = v.withColumn("passage", F.concat_ws(".", "book", "hymn"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("verse", "line_no", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("file", "passage").agg(F.count(F.lit(1)).alias("n_verses"), body.alias("text"))


def layer_of(mandala: Column) -> Column:
    """Books 2 to 7 are the first layer, the others the second."""
    return F.when(mandala.between(2, 7), 1).otherwise(2)


def build(lines: DataFrame, path: str) -> dict[str, DataFrame]:
    """Run the pipeline into Parquet tables below `path`, each stage from the files of the one before."""
    spark = lines.sparkSession
    out: dict[str, DataFrame] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
        return out[name]

    v = put("verses", verses(current_lines(lines)))
    p = put("passages", passages(v).withColumn("passage_id", F.concat_ws("/", "file", "passage")))
    c = put("chunks", parse.chunk_documents(p, "passage_id", "text"))
    c = c.withColumn("chunk_key", F.concat_ws("#", "passage_id", "pos"))
    put("postings", search.postings(c, "chunk_key", "page_content"))
    put("lexicon", lexical.build_lexicon(v, "text", romanise=True))
    return out


def ingest_report(v: DataFrame) -> DataFrame:
    """Verses, hymns, books and the span of line numbers of every file."""
    return v.groupBy("file").agg(
        F.count(F.lit(1)).alias("verses"), F.countDistinct("book", "hymn").alias("hymns"), F.countDistinct("book").alias("books"),
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count_if(F.col("verse") == 1).alias("opening_verses"),
    )
