"""Question -> ranked evidence, as one chain of plans; the driver holds result lists of some k rows, never the corpus.

The stages, in order: what the question itself says (keyword form, names, sources, mode) - dictionary and transliteration variants - keyword
and semantic search of all of them - union and rank fusion - boosts by script, source and topic - substring hits in front - whole sections -
concordance in front - layers balanced - more of the one source asked for - source filter - passages of the names - dictionary context - cut.
Every stage runs only if the index and the question give what it needs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.functions import questions as Q
from shabdagrid.functions import text as T
from shabdagrid.functions import translit
from shabdagrid.operators import context, expand, lexical, lookup, search

FINAL_ROWS = search.TOP_K + 2 * search.EXPANSION
CONCORDANCE_ROWS = 60
# Words in a source's name that make it a commentary.
COMMENTARY = ["brahmana", "commentary", "footnote"]


@dataclass
class Index:
    """A corpus to search: documents(id, text, ...), vectors(vid = id, vec), reference tables, and what its columns mean."""

    docs: DataFrame
    id: str
    text: str
    vectors: DataFrame | None = None
    vid: str = ""
    vec: str = ""
    veda: str | None = None
    layer: str | None = None
    layer_name: str | None = None
    title: str | None = None
    fields: list[str] = field(default_factory=list)  # further columns that may name a source
    original: Column | None = None  # row is in the original script; told from its letters if not given
    translation: Column | None = None
    proper: DataFrame | None = None
    dictionary: tuple[DataFrame, DataFrame] | None = None  # lookup index and concepts
    semantic: Callable[[list[str]], DataFrame] | None = None  # texts -> (q, id, score, pos)


@dataclass
class Question:
    text: str
    vector: list[float] | None = None
    terms: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    strict: bool = False
    patterns: dict[str, list[str]] = field(default_factory=dict)  # source -> names by which a question may ask for it
    topics: list[tuple[list[list[str]], Column]] = field(default_factory=list)
    synonyms: dict[str, str] = field(default_factory=dict)
    names_for: list[tuple[list[str], list[str]]] = field(default_factory=list)  # keywords -> names to look up as well


def ranked(hits: DataFrame, id_col: str) -> DataFrame:
    """hits(id, score) with pos."""
    return hits.withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)) - 1)


def held(rows: DataFrame) -> DataFrame:
    """A result list of some k rows as local rows, so that later stages do not search again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def renumber(hits: DataFrame, *order: Column | str) -> DataFrame:
    return hits.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def features(index: Index, q: Question) -> dict:
    """What the question itself says, from one local row."""
    one, c = index.docs.sparkSession.createDataFrame([(q.text,)], "q string"), F.col("q")
    one = search.detect_sources(one, "q", q.patterns) if q.patterns else one.withColumn("sources", F.array().cast("array<string>")).withColumn("strict", F.lit(False))
    row = one.select(
        T.keyword_query(c).alias("keyword"), T.is_english_query(c).alias("english"), T.preprocess(c).alias("stemmed"), T.proper_nouns(c).alias("nouns"),
        Q.keyword_expansion(c, q.names_for).alias("names") if q.names_for else F.array().cast("array<string>").alias("names"),
        F.col("sources"), F.col("strict"), T.is_diachronic(c).alias("diachronic"), T.asks_for_all(c).alias("all"),
    ).first()
    f = row.asDict()
    if q.sources:
        f |= {"sources": q.sources, "strict": q.strict}
    return f


def enhance(index: Index, q: Question, f: dict) -> tuple[str, list[str], list[str]]:
    """(query with dictionary terms and synonyms, spellings in both scripts, dictionary keys met); an English question stays as it is."""
    if f["english"]:
        return q.text, [], []
    variants = translit.query_variants(q.text)
    out, met = variants[0] if variants else q.text, []
    if index.dictionary is not None:
        spark = index.docs.sparkSession
        ws = sorted({w for v in variants[:3] for w in v.split() if len(w) >= lookup.SHORTEST})
        if ws:
            found = lookup.concept_lookup(spark.createDataFrame([(w,) for w in ws], "word string"), "word", *index.dictionary)
            met = sorted({r["primary_key"] for r in found.where("found").select("primary_key").collect()})
        if met:
            out = lookup.expand_queries(spark.createDataFrame([(0, out)], "n int, q string"), "n", "q", *index.dictionary).first()["expanded"]
    low = out.lower()
    return " ".join([out, *[s for t, s in q.synonyms.items() if t in low]]), variants[:3], met


def semantic_lists(index: Index, q: Question, texts: list[str]) -> DataFrame | None:
    """(q, id, score, pos) of every text, the question's own first; its vector serves it, the others need the index's model."""
    parts = []
    if index.vectors is not None and q.vector is not None:
        near = search.dense_topk(index.vectors, index.vid, index.vec, q.vector).withColumnRenamed(index.vid, index.id)
        parts.append(ranked(near, index.id).select(F.lit(0).alias("q"), index.id, "score", "pos"))
        texts = [""] + texts[1:] if index.semantic else []
    if index.semantic is not None and any(texts):
        more = index.semantic(texts).select("q", index.id, "score", "pos")
        parts.append(more.where("q > 0") if parts else more)
    return held(reduce(DataFrame.unionByName, parts)) if parts else None


def matches(index: Index, names: list[str]) -> Column:
    return search.source_match(names, [c for c in [index.veda, *index.fields] if c], index.title)


def boosts(index: Index, q: Question, f: dict) -> list[tuple[Column, float]]:
    """Original script over translations, the sources of the names asked for over commentaries, the rows of a topic over others."""
    original = T.contains_devanagari(F.col(index.text)) if index.original is None else index.original
    rules = search.script_rules(original, F.lit(False) if index.translation is None else index.translation)
    named = [c for c in [index.veda, *index.fields, index.title] if c]
    if index.proper is not None and f["nouns"] and named:
        about = lookup.noun_context(index.proper).where(F.col("canonical").isin(f["nouns"]) & F.col("sources").isNotNull())
        primary = sorted({x.lower() for r in about.select("sources").collect() for x in r["sources"] if x})
        if primary:
            comment = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(w), F.lit(False)) for c in named for w in COMMENTARY])
            rules += search.source_rules(matches(index, primary), comment)
    return rules + search.topic_rules(q.text, q.topics)


def expansion(index: Index, f: dict, taken: DataFrame, most: int) -> DataFrame | None:
    """(id, pos) of passages that name the question's names, in any of their forms."""
    nouns = list(dict.fromkeys([*f["nouns"], *f["names"]]))[:most]
    if not nouns:
        return None
    forms = {n: [n] for n in nouns}
    if index.proper is not None:
        known = lookup.variants_of(index.proper).where(F.exists("forms", lambda x: x.isin(nouns)))
        for r in known.collect():
            for n in set(nouns) & set(r["forms"]):
                forms[n] = list(dict.fromkeys([*forms[n], *r["forms"]]))
    return expand.noun_expansion(taken, index.docs, index.id, index.text, [forms[n] for n in nouns], 0, most=most)


def retrieve(index: Index, q: Question, rows: int = FINAL_ROWS) -> DataFrame:
    """(id, text, ..., score, pos): the ranked evidence.  The text itself is the identity in the fusion, as repeated passages must count
    as one; a concordance row has no id."""
    key, txt, k = index.id, index.text, search.TOP_K
    docs = index.docs.where(F.col(txt).isNotNull())
    f = features(index, q)
    enhanced, variants, met = enhance(index, q, f)
    texts = list(dict.fromkeys([enhanced, *([] if f["english"] else [f["stemmed"]]), *variants]))
    keyword = held(ranked(search.bm25(docs, key, txt, f["keyword"]), key))
    lists = semantic_lists(index, q, [t for t in texts if t])
    ids = sorted({r[0] for part in (lists, keyword) if part is not None for r in part.select(key).collect()})  # some k for each text
    meta = held(docs.where(F.col(key).isin(ids)))
    content = meta.select(key, txt)
    if lists is None:
        semantic = keyword.limit(0).join(content, key).select(txt, "pos")
    else:
        union = search.union_variants(lists.join(content, key), "q", "pos", txt)
        semantic = renumber(union, "q", "pos").where(F.col("pos") < 2 * k).select(txt, "pos")
    both = search.fuse(semantic, keyword.join(content, key).select(txt, "pos"), txt)
    first = meta.groupBy(txt).agg(F.min(key).alias(key))
    hits = both.join(first, txt).join(meta.drop(txt), key)
    hits = renumber(search.boost(hits, boosts(index, q, f)), F.col("score").desc(), "arrival")
    if q.terms:
        lex = lexical.lexical_hits(docs, key, txt, q.terms, max(3, k // 3)).withColumnRenamed("score", "lex").withColumnRenamed("pos", "lp")
        lex = lex.join(docs, key).withColumn("score", F.col("lex").cast("double")).withColumn("arrival", F.lit(0).cast("long")).withColumn("pos", F.col("lp") - 1000).drop("lex", "lp")
        hits = renumber(lex.unionByName(hits.join(lex.select(key), key, "left_anti")), "pos")
    listed = hits.collect()
    hits = docs.sparkSession.createDataFrame(listed, hits.schema)
    if any(re.search(lexical.VERSE_ID, r[txt]) for r in listed if r["pos"] < context.MAX_EXPAND):
        hits = context.expand_context(hits, docs, txt, "pos", [key]).drop("expanded")
    if q.terms and f["all"]:
        lines = lexical.concordance(docs, txt, q.terms, [key], limit=CONCORDANCE_ROWS).orderBy("corpus", "path").collect()
        if lines:
            block = "\n".join([f"{lines[0]['total']} verses", *[r["line"] for r in lines]])
            front = docs.sparkSession.createDataFrame([(block, 0.0, -1)], f"`{txt}` string, score double, pos int")
            hits = renumber(hits.unionByName(front, allowMissingColumns=True), "pos")
    if index.layer and f["diachronic"]:
        hits = search.interleave(hits, index.layer)
        if index.title and index.layer_name:
            hits = search.tag_layers(hits, txt, F.col(index.title), F.col(index.layer_name), index.layer)
    if f["sources"] and (index.veda or index.fields or index.title):
        match = matches(index, f["sources"])
        if f["strict"] and len(f["sources"]) == 1:
            near = search.dense_topk(index.vectors.join(docs.where(match).select(F.col(key).alias(index.vid)), index.vid, "left_semi"), index.vid, index.vec, q.vector, 2 * k) if index.vectors is not None and q.vector is not None else None
            near = search.bm25(docs.where(match), key, txt, enhanced, 2 * k) if near is None else near.withColumnRenamed(index.vid, key)
            more = held(ranked(near, key).join(docs, key).withColumn("arrival", F.lit(0).cast("long")))
            hits = search.backfill(hits, more.select(*hits.columns), txt)
        hits = search.filter_source(hits, match, f["strict"])
    hits = held(hits)
    tail = expansion(index, f, hits.where(F.col(key).isNotNull()).select(key, "pos"), 12 if f["names"] else 8) if search.EXPANSION else None
    if tail is not None:
        tail = held(tail.select(key, (F.col("pos") + k).alias("pos")).join(docs, key).withColumn("score", F.lit(0.0)).withColumn("arrival", F.lit(0).cast("long")))
        if f["sources"]:
            tail = tail.where(matches(index, f["sources"])) if f["strict"] else tail
        hits = renumber(hits.where(F.col("pos") < k).unionByName(tail.select(*hits.columns)), "pos")
    hits = lookup.attach_context(hits, met)
    return hits.where(F.col("pos") < rows)
