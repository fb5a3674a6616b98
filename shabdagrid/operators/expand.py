"""Terms and documents that a question implies: staged term lookup, noun expansion, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.functions.text import normalize_latin, romanisation_variants, search_key
from shabdagrid.functions.translit import to_devanagari
from shabdagrid.operators import search


def query_terms(questions: DataFrame, id_col: str, question: str, themes: DataFrame, names: DataFrame, lexicon: DataFrame, skip: list[str]) -> DataFrame:
    """(id, terms) in order: Devanagari words as they are; for each Latin token the terms of its theme, else of its name and its
    lexicon key, else its transliterations.

    themes(key, tokens) and names(key, tokens) are gazetteers, lexicon(kind, key, tokens) as built from the corpus.  Words of `skip`
    and tokens under four letters reach no later stage.  All stages are equi-joins for a whole table of questions.
    """
    token = F.regexp_extract_all(F.col(question), F.lit(r"[\x{0900}-\x{097F}]+|[\p{L}&&[^\x{0900}-\x{097F}]][\p{L}\p{M}-]{2,}"), F.lit(0))
    t = questions.select(id_col, F.posexplode(token).alias("p", "w")).withColumn("deva", F.col("w").rlike(r"^[\x{0900}-\x{097F}]"))
    t = t.withColumn("norm", normalize_latin(F.col("w"))).withColumn("key", search_key(F.col("w")))
    th = themes.select(F.col("key").alias("_tk"), F.col("tokens").alias("theme"))
    na = names.select(F.col("key").alias("_nk"), F.col("tokens").alias("name"))
    lx = lexicon.where("kind = 'primary'").select(F.col("key").alias("_lk"), F.slice("tokens", 1, 4).alias("lex"))
    j = t.join(th, F.col("norm") == F.col("_tk"), "left").join(na, F.col("norm") == F.col("_nk"), "left").join(lx, F.col("key") == F.col("_lk"), "left")
    j = j.withColumn("v", F.explode_outer(F.when(~F.col("deva"), romanisation_variants(F.col("w")))))
    j = j.withColumn("auto", to_devanagari(F.col("v")))
    empty = F.array().cast("array<string>")
    autos = F.sort_array(F.collect_set(F.when((F.length("norm") >= 4) & F.col("auto").rlike(r"^[\x{0900}-\x{097F}]{2,}$"), F.col("auto"))))
    g = j.groupBy(id_col, "p", "w", "deva", "norm").agg(F.first("theme").alias("theme"), F.first("name").alias("name"), F.first("lex").alias("lex"), autos.alias("auto"))
    found = F.concat(F.coalesce("name", empty), F.when(F.length("norm") >= 4, F.coalesce("lex", empty)).otherwise(empty))
    terms = (
        F.when(F.col("deva"), F.array("w"))
        .when(F.col("theme").isNotNull(), F.col("theme"))
        .when(F.col("norm").isin(skip), empty)
        .when(F.size(found) > 0, found)
        .otherwise(F.col("auto"))
    )
    g = g.select(id_col, "p", terms.alias("t"))
    return g.groupBy(id_col).agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]))).alias("terms"))


def noun_expansion(ranked: DataFrame, docs: DataFrame, id_col: str, text: str, nouns: list[list[str]], keep: int = search.TOP_K, per_noun: int = search.EXPANSION, most: int = 8) -> DataFrame:
    """The first `keep` of ranked(id, pos), then up to `per_noun` documents for each of the first nouns, found by any of its forms.

    Documents already ranked are left out; a document found by two nouns counts for the first.
    """
    head = ranked.where(F.col("pos") < keep).select(id_col, "pos")
    lists = nouns[:most]
    if not lists:
        return head
    found = search.bm25_many(docs, id_col, text, lists, max(keep, search.TOP_K)).withColumnRenamed("q", "noun")
    found = found.drop("pos").join(ranked.select(id_col), id_col, "left_anti")
    first = found.groupBy(id_col).agg(F.min(F.struct("noun", (-F.col("score")).alias("s"))).alias("b"))
    w = Window.partitionBy("b.noun").orderBy("b.s", id_col)
    kept = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_noun)
    tail = kept.select(id_col, (F.row_number().over(Window.orderBy("b.noun", "r")) - 1 + keep).alias("pos"))
    return head.unionByName(tail)


def question_terms(question: Column, lexicon: dict[str, list[str]]) -> Column:
    """All terms of every lexicon word that occurs in the question, in the order of the lexicon."""
    low, empty = F.lower(question), F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(low.contains(k), F.array(*[F.lit(x) for x in v])).otherwise(empty) for k, v in lexicon.items()]))


def enrich(question: Column, lexicon: dict[str, list[str]], most: int = 3) -> Column:
    """The question and the first terms of every lexicon word that occurs in it."""
    low = F.lower(question)
    empty = F.array().cast("array<string>")
    extra = F.array_distinct(F.flatten(F.array(*[F.when(low.contains(k), F.array(*[F.lit(x) for x in v[:most]])).otherwise(empty) for k, v in lexicon.items()])))
    return F.concat_ws(" ", question, F.nullif(F.array_join(extra, " "), F.lit("")))


def enrich_chunks(chunks: DataFrame, text: str, title: str) -> DataFrame:
    """Chunks with book, canto and section told from their headers and named in front of the text, once."""
    t, name = F.col(text), F.lower(F.coalesce(F.col(title), F.lit("")))
    first = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit(""))
    epic, prose = name.contains("ramayana"), name.rlike("pancavi[mṃ]sa|pancavamsa")
    book, canto = F.when(epic, first(r"#\s+Book\s+([IVXLC]+)\.")), F.when(epic, first(r"##\s+Canto\s+([IVXLC]+)\."))
    section = F.when(prose, first(r"(?m)^\s*(\d+)\.\s+"))
    said = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c, F.lit(". "))).otherwise("")
    prefix = F.concat(said("Book ", book), said("Canto ", canto), said("Section ", section))
    out = chunks.withColumn("book", book).withColumn("canto", canto).withColumn("pb_section", section)
    deva = t.rlike(r"[\x{0900}-\x{097F}]")
    out = out.withColumn("preprocessing", F.when(deva, "sanskrit")).withColumn("original_content_length", F.when(deva, F.length(t)))
    return out.withColumn(text, F.when((prefix != "") & ~t.startswith(prefix), F.concat(prefix, t)).otherwise(t))
