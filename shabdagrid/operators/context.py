"""Passages around a hit: verse lookup, neighbours, whole sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shabdagrid.operators.lexical import VERSE_ID, verse_lines
from shabdagrid.operators.windows import running_count

MAX_EXPAND, MAX_CHARS = 3, 6000


def verse_lookup(verses: DataFrame, corpus: str, path: list[int]) -> DataFrame:
    """Verses of one address or of the section it names: equality on the leading levels of `path`."""
    cond = F.col("corpus") == corpus
    for i, p in enumerate(path):
        cond = cond & (F.get("path", F.lit(i)) == p)
    return verses.where(cond)


def neighbour_window(rows: DataFrame, group: list[str], order: list[str], focus, before: int = 15, size: int = 30, block: Column | None = None) -> DataFrame:
    """Up to `size` rows of the group around every focus row, from `before` rows ahead of it (or the group's start).

    Result rows carry `focus_no`, the row number of their focus.
    """
    r = running_count(rows, group, order, F.lit(True), "_n", before=True, block=block)
    f = r.where(focus).select(*group, F.col("_n").alias("focus_no"), F.greatest(F.lit(0), F.col("_n") - before).alias("_from"))
    cells = f.select(*group, "focus_no", F.explode(F.sequence(F.col("_from"), F.col("_from") + size - 1)).alias("_n"))
    return r.join(cells, [*group, "_n"]).withColumnRenamed("_n", "row_no")


def expand_context(hits: DataFrame, corpus_docs: DataFrame, text: str, pos: str, order: list[str], top: int = MAX_EXPAND, max_chars: int = MAX_CHARS) -> DataFrame:
    """The first hits with their text replaced by the whole sections they touch, where that is longer.

    Sections come in order of mention, verses in numeric order, the last document's line standing for a verse that several
    hold.  hits(pos, text) are few; the corpus is filtered to their sections by a broadcast semi-join of at most
    `top` texts' section ids before anything is grouped.
    """
    ids = F.regexp_extract_all(F.col(text), F.lit(VERSE_ID), F.lit(1))
    head = hits.where(F.col(pos) < top).select(pos, F.posexplode(F.array_distinct(F.transform(ids, lambda v: F.regexp_extract(v, r"^(.*)\.\d+$", 1)))).alias("_i", "section"))
    wanted = head.select("section").distinct()
    v = verse_lines(corpus_docs, text, order).withColumn("section", F.regexp_extract("vid", r"^(.*)\.\d+$", 1))
    v = v.join(F.broadcast(wanted), "section", "left_semi")
    line = v.groupBy("section", F.col("path")[2].alias("no")).agg(F.max_by("line", F.struct(*order, "_n")).alias("line"))
    sect = line.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("_t"))
    body = head.join(sect, "section").groupBy(pos).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "section", "_t"))), lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n"), x["_t"])), "\n\n").alias("_full")
    )
    full = F.substring(F.col("_full"), 1, max_chars)
    out = hits.join(body, pos, "left")
    longer = F.coalesce(F.length(full) > F.length(F.col(text)), F.lit(False))
    return out.withColumn("expanded", longer).withColumn(text, F.when(longer, full).otherwise(F.col(text))).drop("_full")
