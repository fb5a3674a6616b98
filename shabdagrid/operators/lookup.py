"""Dictionary and proper-noun lookups: one join for a whole table of terms.

Reference tables are dimension tables; Spark broadcasts them by their measured size, never by a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.functions.text import dictionary_key, key_terms, words

CATEGORIES = ["given_name", "place", "tribe", "deity"]


def variant_index(proper: DataFrame) -> DataFrame:
    """(variant, canonical, category): every form, the canonical one included, to one canonical name; the last category, then name, wins."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    forms = F.array_union(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))
    v = proper.where("canonical is not null").select("canonical", "category", rank.alias("_o"), F.explode(forms).alias("variant"))
    g = v.groupBy("variant").agg(F.max_by(F.struct("canonical", "category"), F.struct("_o", "canonical")).alias("b"))
    return g.select("variant", "b.canonical", "b.category")


def to_canonical(terms: DataFrame, term: str, proper: DataFrame) -> DataFrame:
    """terms with `canonical`: the name a variant stands for, the term itself where none is known."""
    idx = variant_index(proper).select(F.col("variant").alias("_v"), F.col("canonical").alias("_c"))
    return terms.join(idx, terms[term] == idx["_v"], "left").withColumn("canonical", F.coalesce("_c", term)).drop("_v", "_c")


def variants_of(proper: DataFrame) -> DataFrame:
    """(canonical, forms): all forms over all categories, sorted, the canonical one included."""
    forms = F.array_union(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))
    return proper.where("canonical is not null").select("canonical", F.explode(forms).alias("f")).groupBy("canonical").agg(F.sort_array(F.collect_set("f")).alias("forms"))


def suffix_variants(word: Column) -> Column:
    """A name with and without the endings of plural and nominative; a fallback for names that no list has."""
    stem = F.regexp_replace(word, "(s|h|ḥ|as|ah|aḥ)$", "")
    return F.array_distinct(F.array(word, stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("ḥ"))))


def noun_context(proper: DataFrame) -> DataFrame:
    """(canonical, category, role, context, sources) of the first category that has the name."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    w = Window.partitionBy("canonical").orderBy(rank)
    return proper.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("canonical", "category", "role", "context", "sources")


def disambiguate(mentions: DataFrame, noun: str, context: str, hints: DataFrame) -> DataFrame:
    """mentions with the form and role of the first hint (by priority) of the noun that the context contains.

    hints(noun, hint, form, role, priority); an equi-join on the noun, the containment as its condition.
    """
    m = mentions.withColumn("_id", F.monotonically_increasing_id())
    j = m.join(hints.withColumnRenamed("noun", "_n"), (F.col(noun) == F.col("_n")) & F.lower(F.col(context)).contains(F.lower("hint")), "left")
    w = Window.partitionBy("_id").orderBy(F.col("priority").asc_nulls_last(), "form")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_id", "_n", "hint", "priority")


def source_forms(terms: DataFrame, term: str, proper: DataFrame, source: str) -> DataFrame:
    """terms with `forms`: all forms of a name that is attested in the source; any other term stands for itself."""
    there = proper.where(F.array_contains("sources", source)).select("canonical").distinct()
    known = variants_of(proper).join(there, "canonical", "left_semi").select(F.col("canonical").alias("_c"), "forms")
    return terms.join(known, terms[term] == known["_c"], "left").withColumn("forms", F.coalesce("forms", F.array(term))).drop("_c")


def is_proper_noun(terms: DataFrame, term: str, proper: DataFrame) -> DataFrame:
    """terms with `known`: whether the term, trimmed and in lower case, is a form of a listed name; null terms are none."""
    forms = variant_index(proper).select(F.lower(F.trim("variant")).alias("_v")).distinct()
    j = terms.join(forms, F.lower(F.trim(F.col(term))) == F.col("_v"), "left")
    return j.withColumn("known", F.col("_v").isNotNull()).drop("_v")


def noun_info(proper: DataFrame, noun: str) -> DataFrame:
    """The entry of one name, under any of its forms."""
    names = variant_index(proper).where(F.lower("variant") == noun.strip().lower()).select("canonical").distinct()
    return noun_context(proper).join(names, "canonical", "left_semi")


def group_of_member(groups: DataFrame) -> DataFrame:
    """(member, grp) of groups(grp, members)."""
    return groups.select(F.explode("members").alias("member"), "grp")


def with_groups(terms: DataFrame, id_col: str, term: str, groups: DataFrame) -> DataFrame:
    """(id, term) of terms, of the groups they are members of, and of all members of those groups and of groups named themselves."""
    t = terms.select(id_col, F.col(term).alias("term"))
    of = t.join(group_of_member(groups), F.col("term") == F.col("member")).select(id_col, F.col("grp").alias("term"))
    named = t.unionByName(of)
    inside = named.join(groups, F.col("term") == F.col("grp")).select(id_col, F.explode("members").alias("term"))
    return named.unionByName(inside).where("term is not null").distinct()


def concept_lookup(terms: DataFrame, term: str, index: DataFrame, concepts: DataFrame, romanised: str | None = None) -> DataFrame:
    """terms with their concept: by the normalised key, else by that of the romanised form; misses have found = false.

    index(normalized, primary_key); concepts(primary_key, devanagari, iast_variants, headwords, definitions, vedic_refs, ...).
    """
    i1 = index.select(F.col("normalized").alias("_k1"), F.col("primary_key").alias("_p1"))
    t = terms.withColumn("normalized", dictionary_key(F.col(term))).join(i1, F.col("normalized") == F.col("_k1"), "left")
    key = F.col("_p1")
    if romanised:
        i2 = index.select(F.col("normalized").alias("_k2"), F.col("primary_key").alias("_p2"))
        t = t.join(i2, dictionary_key(F.col(romanised)) == F.col("_k2"), "left")
        key = F.coalesce("_p1", "_p2")
    t = t.withColumn("primary_key", key).drop("_k1", "_p1", "_k2", "_p2")
    j = t.join(concepts, "primary_key", "left").withColumn("found", F.col("primary_key").isNotNull())
    for c, n in (("iast_variants", 10), ("headwords", 10), ("definitions", 5), ("vedic_refs", 10)):
        if c in j.columns:
            j = j.withColumn(c, F.coalesce(F.slice(c, 1, n), F.array().cast("array<string>")))
    return j


SHORTEST, TERMS_MOST, PER_TERM, ADDED_MOST = 3, 3, 2, 5


def _words_found(queries: DataFrame, id_col: str, query: str, index: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, p, word, concept columns) of every word of a query that is long enough and has a concept."""
    w = queries.select(id_col, F.posexplode(words(F.col(query))).alias("p", "word")).where(F.length("word") >= SHORTEST)
    return concept_lookup(w, "word", index, concepts).where("found")


def expand_queries(queries: DataFrame, id_col: str, query: str, index: DataFrame, concepts: DataFrame) -> DataFrame:
    """queries with `expanded`: behind the query, for its first TERMS_MOST words that have a concept, two key words of the first definition and
    two variants each, without repetitions, ADDED_MOST in all."""
    hit = _words_found(queries, id_col, query, index, concepts)
    hit = hit.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy("p"))).where(F.col("_r") <= TERMS_MOST)
    empty = F.array().cast("array<string>")
    of_word = F.concat(F.slice(F.coalesce(key_terms(F.get("definitions", F.lit(0))), empty), 1, PER_TERM), F.slice("iast_variants", 1, PER_TERM))
    g = hit.groupBy(id_col).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", of_word.alias("t")))), lambda x: x["t"])).alias("_t"))
    out = queries.join(g, id_col, "left")
    return out.withColumn("expanded", F.concat_ws(" ", query, F.nullif(F.array_join(F.slice(F.array_distinct(F.coalesce("_t", empty)), 1, ADDED_MOST), " "), F.lit("")))).drop("_t")


def references_of(queries: DataFrame, id_col: str, query: str, index: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, references): a map from every word of a query that has references to them."""
    hit = _words_found(queries, id_col, query, index, concepts).where(F.size("vedic_refs") > 0)
    one = hit.groupBy(id_col, "word").agg(F.min_by("vedic_refs", "p").alias("refs"))
    return one.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "refs")))).alias("references"))


def all_variants(terms: DataFrame, term: str, index: DataFrame, concepts: DataFrame) -> DataFrame:
    """terms with `variants`, sorted: the term, its concept's Devanagari, romanised forms and headwords; a term without concept alone."""
    j = concept_lookup(terms, term, index, concepts)
    found = F.array_union(F.array(F.col(term), F.col("devanagari")), F.array_union(F.col("iast_variants"), F.col("headwords")))
    every = F.filter(F.coalesce(F.when(F.col("found"), found), F.array(term)), lambda v: v.isNotNull() & (v != ""))
    return j.select(*terms.columns, F.array_sort(F.array_distinct(every)).alias("variants"))


def dictionary_stats(index: DataFrame, concepts: DataFrame) -> DataFrame:
    """(total_concepts, total_lookup_keys), one row."""
    both = concepts.select(F.lit(1).alias("c"), F.lit(0).alias("k")).unionByName(index.select(F.lit(0).alias("c"), F.lit(1).alias("k")))
    return both.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total_concepts"), F.coalesce(F.sum("k"), F.lit(0)).alias("total_lookup_keys"))


def attach_context(docs: DataFrame, context: list[str], out: str = "dictionary_terms") -> DataFrame:
    """docs with the dictionary terms of the question that found them; a context that is there already stays, an empty one adds nothing."""
    return docs if out in docs.columns or not context else docs.withColumn(out, F.array(*[F.lit(c) for c in context]))


# How sure a term is by where it comes from.
CONFIDENCE = {"dictionary": 0.95, "name": 0.90, "synonym": 0.85}


def translate_word(words_: DataFrame, word: str, dictionary: DataFrame, names: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(word, term, kind, confidence) from dictionary(word, term, kind, synonyms) and names(word, term, kind), surest first.

    The same term from two places counts once with each confidence."""
    low = F.lower(F.trim(F.col(word)))
    w = words_.select(low.alias("word")).where("word is not null").distinct()
    d = w.join(dictionary.withColumnRenamed("word", "_w"), F.col("word") == F.lower("_w"))
    kind = F.coalesce("kind", F.lit("noun"))
    parts = [
        d.where("term is not null").select("word", "term", kind.alias("kind"), F.lit(CONFIDENCE["dictionary"]).alias("confidence")),
        d.select("word", F.explode("synonyms").alias("term"), kind.alias("kind"), F.lit(CONFIDENCE["synonym"]).alias("confidence")),
        w.join(names.withColumnRenamed("word", "_w"), F.col("word") == F.lower("_w")).select(
            "word", F.coalesce("term", "_w").alias("term"), F.coalesce("kind", F.lit("proper_noun")).alias("kind"), F.lit(CONFIDENCE["name"]).alias("confidence")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("confidence") >= threshold).distinct()


def dictionary_terms(dictionary: DataFrame, word: str) -> DataFrame:
    """The first five listed terms of an English word that are longer than two letters and hold no digit."""
    ok = F.slice(F.filter("terms", lambda t: (F.length(t) > 2) & ~t.rlike("[0-9]")), 1, 5)
    return dictionary.where(F.lower("word") == word.lower()).select("word", ok.alias("terms"))


def translate_words(queries: DataFrame, query: str, id_col: str, terms: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, terms): the best term of every word of a query, of terms(word, term, confidence) at or above the threshold."""
    w = queries.select(id_col, F.posexplode(words(F.lower(F.col(query)))).alias("p", "word"))
    best = terms.where(F.col("confidence") >= threshold).groupBy("word").agg(F.max_by("term", F.struct("confidence", "term")).alias("term"))
    return w.join(best, "word").groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("terms"))


def prepared_answer(questions: DataFrame, question: str, answers: DataFrame) -> DataFrame:
    """Answers prepared for a question, matched on its normalised text."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    a = answers.select(norm("question").alias("_k"), "answer")
    return questions.join(a, norm(question) == F.col("_k"), "left").drop("_k")


def source_names(docs: DataFrame, group: list[str], name: str, fallback: str = "the corpus") -> DataFrame:
    """Distinct source names of a group as a readable list."""
    g = docs.groupBy(*group).agg(F.sort_array(F.collect_set(name)).alias("n"))
    k = F.size("n")
    text = F.when(k == 0, fallback).when(k == 1, F.get("n", F.lit(0))).when(k == 2, F.array_join("n", " and ")).otherwise(
        F.concat(F.array_join(F.slice("n", F.lit(1), k - 1), ", "), F.lit(", and "), F.element_at("n", -1))
    )
    return g.select(*group, text.alias("sources"))
