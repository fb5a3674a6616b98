"""Queries over the test tables, one or more for each family of operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shabdagrid import lineage
from shabdagrid.functions import citations as C
from shabdagrid.functions import cleaners
from shabdagrid.functions import questions as Q
from shabdagrid.functions import text as T
from shabdagrid.functions import translit
from shabdagrid.operators import context, expand, kg, lexical, lookup, parse, search, windows
from shabdagrid.plans import hybrid, ingest
from shabdagrid.session import table
from shabdagrid.streaming import turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERY = "river hymn singer altar the the"
TERMS = ["river", "hymn", "yāga", "Nubāḥ", "refrain", "ladle"]
SCAN_TERMS = ["पुध", "यमीनः", "pudha"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _vector(s: SparkSession, d: str) -> list[float]:
    row = table(s, d, "embeddings").where("vec_id = 1").select("embedding").first()
    return list(row[0]) if row else []


# ── search ──


@query
def bm25_topk(s, d):
    return search.bm25(_docs(s, d), "doc_id", "text", QUERY)


@query
def bm25_indexed(s, d):
    """The same search from index tables, written first."""
    index = search.write_index(_docs(s, d), "doc_id", "text", f"{lineage.shared_dir(s)}/shabdagrid/index-{lineage.fresh_name()}")
    return search.bm25_indexed(index, "doc_id", QUERY)


@query
def dense_topk(s, d):
    return search.dense_topk(table(s, d, "embeddings"), "vec_id", "embedding", _vector(s, d))


@query
def dense_topk_filtered(s, d):
    return search.dense_topk(table(s, d, "embeddings"), "vec_id", "embedding", _vector(s, d), where=F.col("label") == 1)


def _dense_all(s: SparkSession, d: str, where=None) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    return search.dense_topk_all(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", where=where)


@query
def dense_topk_all(s, d):
    """Every twentieth vector as a query against all of them."""
    return _dense_all(s, d)


@query
def dense_topk_all_filtered(s, d):
    return _dense_all(s, d, F.col("label") == 1)


@query
def rank_fusion(s, d):
    """Two keyword rankings, contents being the texts; repeated texts occur in both."""
    docs = _docs(s, d)
    rank = lambda q, k: hybrid.ranked(search.bm25(docs, "doc_id", "text", q, k), "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    f = search.fuse(rank("river hymn", 40), rank("hymn singer", 40), "text")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return f.join(first, "text").select("doc_id", "score", "arrival")


@query
def hybrid_search(s, d):
    """Dense and keyword search fused over documents; vectors belong to documents of the same number."""
    i = hybrid.Index(_docs(s, d), "doc_id", "text", table(s, d, "embeddings"), "vec_id", "embedding", veda="veda")
    return hybrid.retrieve(i, hybrid.Question(QUERY, _vector(s, d))).select("doc_id", F.round("score", 6).alias("score"), "pos")


@query
def hybrid_full(s, d):
    """All stages: lexical hits in front, layers balanced, one corpus preferred."""
    c = table(s, d, "chunk").where("page_content is not null").select("chunk_id", "page_content", F.col("metadata.veda").alias("veda"), F.col("metadata.chronology_layer").alias("layer"))
    i = hybrid.Index(c, "chunk_id", "page_content", veda="veda", layer="layer")
    q = hybrid.Question("how does the river evolve from the early to the later layer", terms=SCAN_TERMS, sources=["nadiveda"])
    return hybrid.retrieve(i, q).select("chunk_id", F.round("score", 6).alias("score"), "pos", "layer", "veda")


@query
def score_boosts(s, d):
    docs = _docs(s, d)
    hits = search.bm25(docs, "doc_id", "text", QUERY, 60).join(docs.select("doc_id", "text", "lang", "filename"), "doc_id")
    trans = F.coalesce(F.lower("lang") == "en", F.lit(False))
    hits = search.boost(hits, search.script_rules(T.contains_devanagari(F.col("text")), trans))
    primary, comment = (F.coalesce(F.col("filename").startswith(p), F.lit(False)) for p in ("v", "kp"))
    return search.boost(hits, search.source_rules(primary, comment)).select("doc_id", F.round("score", 6).alias("score"))


@query
def detected_sources(s, d):
    p = {"vanaveda": ["vana samhita", "vn"], "nadiveda": ["nadi samhita", "nd"], "kapila_brahmana": ["kapila brahmana", "kp"]}
    return search.detect_sources(_docs(s, d).where("text is not null").select("doc_id", F.col("text").alias("q")), "q", p).select("doc_id", "sources", "strict")


def _filtered(s, d, strict: bool, names: list[str]) -> DataFrame:
    docs = _docs(s, d)
    hits = hybrid.ranked(search.bm25(docs, "doc_id", "text", QUERY, 60), "doc_id").join(docs.select("doc_id", "veda", "filename"), "doc_id")
    return search.filter_source(hits, search.source_match(names, ["veda", "filename"]), strict).select("doc_id", "pos")


@query
def source_filter_strict(s, d):
    return _filtered(s, d, True, ["vanaveda"])


@query
def source_filter_soft(s, d):
    return _filtered(s, d, False, ["nadiveda"])


@query
def source_filter_fallback(s, d):
    return _filtered(s, d, True, ["no_such_corpus"])


@query
def variant_union_dedup(s, d):
    docs = _docs(s, d).where("text is not null")
    lists = [docs.where(F.col("text").contains(w)).select(F.lit(i).alias("variant"), F.col("doc_id").alias("pos"), "doc_id", "text") for i, w in enumerate(("river", "hymn", "पुध"))]
    return search.union_variants(lists[0].unionByName(lists[1]).unionByName(lists[2]), "variant", "pos", "text").select("variant", "doc_id")


@query
def anti_backfill(s, d):
    docs = _docs(s, d)
    ranked = hybrid.ranked(search.bm25(docs, "doc_id", "text", QUERY), "doc_id").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "pos")
    more = hybrid.ranked(search.bm25(docs, "doc_id", "text", "refrain river", 30), "doc_id").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "pos")
    return search.backfill(ranked, more, "text").select("doc_id", "pos")


@query
def layer_interleave(s, d):
    c = table(s, d, "chunk").select("chunk_id", "page_content", F.col("metadata.chronology_layer").alias("layer"))
    top = lexical.lexical_scores(c, "chunk_id", "page_content", SCAN_TERMS).orderBy(F.col("score").desc(), "chunk_id").limit(40)
    r = top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id")) - 1).join(c.select("chunk_id", "layer"), "chunk_id")
    return search.interleave(r, "layer").select("chunk_id", "layer", "pos")


# ── lexical ──


@query
def lexical_score(s, d):
    return lexical.lexical_scores(_docs(s, d), "doc_id", "text", TERMS).select("doc_id", F.size("matched").alias("n_terms"), "hits", "score")


@query
def term_df(s, d):
    return lexical.term_df(_docs(s, d), "text", TERMS)


@query
def lexical_hits(s, d):
    return lexical.lexical_hits(_docs(s, d), "doc_id", "text", TERMS)


@query
def concordance(s, d):
    return lexical.concordance(table(s, d, "chunk"), "page_content", SCAN_TERMS, ["chunk_id"]).select("corpus", "vid", "line", "total")


@query
def concordance_page(s, d):
    """The first sixty verses with the number of all."""
    return lexical.concordance(table(s, d, "chunk"), "page_content", SCAN_TERMS, ["chunk_id"], limit=60).select("vid", "total")


@query
def lexicon_build(s, d):
    return lexical.build_lexicon(_docs(s, d), "text", romanise=True)


@query
def lexicon_devanagari(s, d):
    return lexical.build_lexicon(table(s, d, "chunk"), "page_content", romanise=True)


@query
def lexicon_lookup(s, d):
    return lexical.lexicon_lookup(lexical.build_lexicon(_docs(s, d), "text", romanise=True), ["river", "sing"])


# ── context ──


@query
def verse_lookup(s, d):
    v = lexical.verse_lines(table(s, d, "chunk"), "page_content", ["chunk_id"])
    return context.verse_lookup(v, "KP", [2]).select("chunk_id", "vid", "line")


@query
def neighbour_window(s, d):
    lines = ingest.current_lines(table(s, d, "corpus_line"))
    return context.neighbour_window(lines, ["file"], ["line_no"], F.coalesce(F.col("text").contains("यमीनः"), F.lit(False)), block=parse.line_block()).select("file", "focus_no", "row_no", "line_no")


@query
def context_expansion(s, d):
    """The best substring hits with the sections they touch."""
    c = table(s, d, "chunk").where("page_content is not null").select("chunk_id", "page_content")
    top = lexical.lexical_scores(c, "chunk_id", "page_content", SCAN_TERMS).orderBy(F.col("score").desc(), "chunk_id").limit(search.TOP_K)
    top = top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id")) - 1)
    hits = hybrid.held(top.select("chunk_id", "pos").join(c, "chunk_id").select("pos", "chunk_id", "page_content"))
    return context.expand_context(hits, c, "page_content", "pos", ["chunk_id"]).select("pos", "expanded", "page_content")


# ── fact graph ──


def _edges(s: SparkSession, d: str) -> DataFrame:
    return kg.edges(table(s, d, "kg_seed"), "fact_id")


@query
def kg_upsert(s, d):
    return _edges(s, d).select("subject_key", "relation", "object_key", F.array_join("citations", "|").alias("cites"), "trust", "first_seq")


@query
def kg_inverse(s, d):
    return kg.with_inverses(lineage.cut(_edges(s, d), "edges")).select("subject_key", "relation", "object_key", "trust", "stated")


@query
def kg_nodes(s, d):
    return kg.nodes(_edges(s, d)).select("entity", "out_degree")


@query
def kg_degree(s, d):
    return kg.degree(_edges(s, d))


@query
def kg_members(s, d):
    return kg.members(_edges(s, d))


@query
def kg_two_hop(s, d):
    """Everything within two steps of the subjects of every twentieth fact."""
    e = lineage.cut(_edges(s, d), "edges")
    start = table(s, d, "kg_seed").where("fact_id % 20 = 0 and subject is not null").select(kg.entity_key(F.col("subject")).alias("entity"))
    return kg.walk(e, start, 2)


@query
def kg_context(s, d):
    return kg.context_lines(_edges(s, d)).select("subject_key", "relation", "object_key", "line")


@query
def kg_digraph(s, d):
    return kg.directed_graph(_edges(s, d))


@query
def kg_rejected(s, d):
    """Facts outside the listed relations, by relation: the quarantine count."""
    f = table(s, d, "kg_seed")
    return f.where(~F.col("relation").isin(kg.RELATIONS)).groupBy("relation").agg(F.count(F.lit(1)).alias("facts"))


@query
def kg_fk_walk(s, d):
    """Orders, customers, nations and regions as triples, walked from one region's nations outwards."""
    t = lambda df, a, r, b: df.select(F.concat(F.lit(a[0]), F.col(a[1]).cast("string")).alias("subject_key"), F.lit(r).alias("relation"), F.concat(F.lit(b[0]), F.col(b[1]).cast("string")).alias("object_key"))
    e = t(table(s, d, "nation"), ("n", "n_nationkey"), "in_region", ("r", "n_regionkey")).unionByName(
        t(table(s, d, "customer"), ("c", "c_custkey"), "in_nation", ("n", "c_nationkey"))
    )
    e = e.unionByName(t(table(s, d, "orders"), ("o", "o_orderkey"), "placed_by", ("c", "o_custkey")))
    start = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("entity"))
    return kg.walk(e, start, 3).groupBy("relation", "hop").agg(F.count(F.lit(1)).alias("edges"))


@query
def metadata_override(s, d):
    bulk = table(s, d, "corpus_metadata").select("filename", "title", "summary", "source_url")
    cur = _docs(s, d).where("filename is not null").groupBy("filename").agg(F.max("citation").alias("summary"), F.min("source").alias("first_source"))
    return kg.override_merge(bulk, cur, "filename")


# ── lookups ──


@query
def variant_index(s, d):
    return lookup.variant_index(table(s, d, "proper_noun"))


@query
def canonical_names(s, d):
    """Canonical name of every word of the facts' subjects, with the number of facts that have it."""
    t = table(s, d, "kg_seed").select("fact_id", F.explode(T.words(F.col("subject"))).alias("term"))
    return lookup.to_canonical(t, "term", table(s, d, "proper_noun")).groupBy("canonical").agg(F.count_distinct("fact_id").alias("facts"))


@query
def noun_variants(s, d):
    return lookup.variants_of(table(s, d, "proper_noun"))


@query
def noun_context(s, d):
    return lookup.noun_context(table(s, d, "proper_noun"))


@query
def source_names(s, d):
    c = table(s, d, "chunk").select(F.col("metadata.veda").alias("veda"), F.col("metadata.title").alias("title"))
    return lookup.source_names(c, ["veda"], "title")


# ── parsing and order ──


@query
def latest_lines(s, d):
    return ingest.current_lines(table(s, d, "corpus_line"))


@query
def verse_parse(s, d):
    return ingest.verses(ingest.current_lines(table(s, d, "corpus_line")))


@query
def ingest_counts(s, d):
    return ingest.ingest_report(ingest.verses(ingest.current_lines(table(s, d, "corpus_line"))))


@query
def passage_build(s, d):
    return ingest.passages(ingest.verses(ingest.current_lines(table(s, d, "corpus_line"))))


def _headed(s: SparkSession, d: str) -> DataFrame:
    lines = ingest.current_lines(table(s, d, "corpus_line"))
    return lines.withColumn("h", F.nullif(F.regexp_extract("text", r"^## (.*)$", 1), F.lit("")))


@query
def carry_forward(s, d):
    """The section of every line: the last header above it."""
    return windows.carry_forward(_headed(s, d), ["file"], ["line_no"], ["h"], parse.line_block()).select("file", "line_no", F.col("h").alias("section"))


@query
def carry_levels(s, d):
    """Book and hymn of every line, the hymn forgotten when a book begins."""
    x = _headed(s, d).withColumn("book", F.nullif(F.regexp_extract("text", r"^# (.*)$", 1), F.lit(""))).withColumnRenamed("h", "hymn")
    return windows.carry_forward(x, ["file"], ["line_no"], ["book", "hymn"], parse.line_block()).select("file", "line_no", "book", "hymn")


@query
def run_group(s, d):
    """Runs of equal event types of a user."""
    r = windows.run_id(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"), block=F.to_date("ts"))
    return r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


@query
def reset_counter(s, d):
    v = ingest.verses(ingest.current_lines(table(s, d, "corpus_line")))
    return windows.reset_counter(v, ["file", "book"], ["line_no"], F.col("hymn"), "hymn_no", parse.line_block()).select("file", "line_no", "book", "hymn", "hymn_no")


@query
def closed_groups(s, d):
    """Lines buffered until a verse marker closes their group."""
    x = ingest.current_lines(table(s, d, "corpus_line")).where("text is not null and trim(text) != ''")
    return windows.shifted_groups(x, ["file"], ["line_no"], F.col("text").rlike(ingest.MARKER), block=parse.line_block()).select("file", "line_no", "grp")


@query
def line_spans(s, d):
    """From one section header to the next, or to the end of the file."""
    h = _headed(s, d).where("h is not null").select("file", "line_no", "h")
    last = ingest.current_lines(table(s, d, "corpus_line")).groupBy("file").agg((F.max("line_no") + 1).alias("end"))
    return windows.span_to_next(h.join(last, "file"), ["file"], ["line_no"], "line_no", F.col("end")).select("file", "h", "line_no", "span_end")


@query
def file_dedup(s, d):
    return windows.first_files(ingest.current_lines(table(s, d, "corpus_line")), "file", ["line_no"], "text", parse.line_block())


@query
def section_sink(s, d):
    """Every file as Markdown with a header before each hymn."""
    v = ingest.verses(ingest.current_lines(table(s, d, "corpus_line")))
    return parse.emit_sections(v, ["file"], ["book", "hymn"], ["line_no"], F.concat_ws(".", F.concat(F.lit("## "), F.col("book").cast("string")), F.col("hymn").cast("string")), F.col("text"), parse.line_block())


@query
def chunk_documents(s, d):
    return parse.chunk_documents(_docs(s, d), "doc_id", "text")


@query
def book_headers(s, d):
    return parse.book_headers(_docs(s, d).select("doc_id", "text"), "text").select("doc_id", "book", "canto", "section")


# ── text functions ──


def _text_query(name: str, col: Callable, source: str = "documents") -> None:
    key, txt = {"documents": ("doc_id", "text"), "kg_seed": ("fact_id", "subject")}[source]

    def run(s, d):
        return table(s, d, source).where(F.col(txt).isNotNull()).select(key, col(F.col(txt)).alias("value"))

    run.__name__ = name
    QUERIES[name] = run


def _word_query(name: str, col: Callable) -> None:
    """A value for every word of every fact's subject, at its position."""

    def run(s, d):
        w = table(s, d, "kg_seed").select("fact_id", F.posexplode(T.words(F.col("subject"))).alias("pos", "word"))
        return w.select("fact_id", "pos", col(F.col("word")).alias("value"))

    run.__name__ = name
    QUERIES[name] = run


_text_query("script_ratio", lambda c: F.round(T.script_ratio(c), 6))
_text_query("script_flags", lambda c: F.concat_ws(",", T.any_devanagari(c).cast("string"), T.contains_iast(c).cast("string"), T.is_english_query(c).cast("string")))
_text_query("proper_nouns", lambda c: F.array_join(T.proper_nouns(c), "|"), "kg_seed")
_text_query("stem_tokens", lambda c: F.array_join(T.stems(T.fallback_tokens(c)), " "), "kg_seed")
_text_query("search_keys", T.search_key, "kg_seed")
_word_query("sandhi_keys", lambda c: F.array_join(T.sandhi_variants(T.search_key(c)), "|"))
_word_query("romanisations", lambda c: F.array_join(T.romanisation_variants(c), "|"))
_text_query("plain_latin", T.remove_diacritics, "kg_seed")
_text_query("keyword_queries", T.keyword_query, "kg_seed")
_text_query("dictionary_keys", T.dictionary_key, "kg_seed")
_text_query("bare_devanagari", T.strip_devanagari_marks)
_text_query("speech_text", T.clean_for_speech)
_text_query("key_terms", lambda c: F.array_join(T.key_terms(c), "|"))
_text_query("citation_extract", C.verse_reference)
_text_query("section_titles", C.section_title)
_text_query("citation_labels", lambda c: C.citation_label(c, F.lit(None).cast("string"), F.lit(1)))
_text_query("url_fragments", C.url_fragment)
_text_query("to_devanagari", translit.to_devanagari, "kg_seed")
_text_query("query_variants", translit.normalize_query, "kg_seed")


_text_query("query_types", Q.query_type)
_text_query("follow_ups", Q.is_follow_up)
_text_query("question_modes", T.question_mode)
_text_query("model_terms", lambda c: F.array_join(Q.model_terms(c), "|"), "kg_seed")
_text_query("edition_marks", cleaners.strip_edition_marks, "kg_seed")
_text_query("edition_devanagari", lambda c: cleaners.edition_to_devanagari(c, accents=True, variants=True, labels=True), "kg_seed")
_text_query("enriched_queries", lambda c: expand.enrich(c, {"river": ["nadī", "sindhu"], "fire": ["agni"], "king": ["rājan"]}))
_text_query("place_expansion", lambda c: F.array_join(Q.keyword_expansion(c, [(Q.LOCATION, ["Asānadī", "Ditpura"]), (Q.TRIBAL, ["Dikātsu"])]), "|"))


@query
def query_terms(s, d):
    """Search terms implied by every note of a fact, through deities as themes and given names as gazetteer."""
    p = table(s, d, "proper_noun").where("canonical is not null")
    gaz = lambda c: p.where(F.col("category") == c).select(T.normalize_latin(F.col("canonical")).alias("key"), F.array("canonical").alias("tokens"))
    one = lambda g: g.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    facts = table(s, d, "kg_seed").where("note is not null").select("fact_id", "note")
    lex = lexical.build_lexicon(table(s, d, "chunk"), "page_content", romanise=True)
    return expand.query_terms(facts, "fact_id", "note", one(gaz("deity")), one(gaz("given_name")), lex, ["compare", "the", "see", "read", "with", "from", "once"])


@query
def noun_expansion(s, d):
    docs = _docs(s, d)
    ranked = hybrid.ranked(search.bm25(docs, "doc_id", "text", QUERY, 40), "doc_id")
    return expand.noun_expansion(ranked, docs, "doc_id", "text", [["Nubāḥ", "Nubāḥ."], ["Gam", "Gam."], ["nosuchnoun"]])


@query
def enriched_chunks(s, d):
    c = table(s, d, "chunk").select("chunk_id", "page_content", F.col("metadata.title").alias("title"))
    return expand.enrich_chunks(c, "page_content", "title").select("chunk_id", "preprocessing", "original_content_length", "page_content")


@query
def roman_numbers(s, d):
    r = F.upper(F.regexp_extract("p_name", "(?i)([ivxlcdm]+)", 1))
    return table(s, d, "part").select("p_partkey", C.roman_to_int(r).alias("value"))


# ── sessions and events ──


@query
def json_props(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def visit_counts(s, d):
    return turns.visit_counts(table(s, d, "events"), "ts", "event_type")


@query
def pinned_turns(s, d):
    e = table(s, d, "events")
    return turns.pinned(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), F.col("event_type") == "error", block=F.to_date("ts")).select("event_id", "pinned")


@query
def rows_by_source(s, d):
    from shabdagrid.sources.files import count_by

    return count_by(_docs(s, d), "source")
