"""Further queries: the whole retrieval chain, planner, dictionary, graph context, editions.  Same registry as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shabdagrid import lineage
from shabdagrid.functions import citations as C
from shabdagrid.functions import questions as Q
from shabdagrid.functions import text as T
from shabdagrid.functions import translit
from shabdagrid.operators import expand, kg, lookup, parse, search
from shabdagrid.plans import agent, editions, hybrid
from shabdagrid.plans.queries import QUERIES, SCAN_TERMS, _text_query, query
from shabdagrid.session import table
from shabdagrid.sources import graph

LEXICON = {"river": ["nadī", "sindhu", "sarit", "dhunī"], "fire": ["agni"], "king": ["rājan", "rāj"]}
MANY = [["river", "hymn"], ["hymn", "singer", "altar"], ["refrain"], ["nosuchword"], ["ladle", "ladle"]]


# ── retrieval ──


@query
def bm25_batch(s, d):
    """Five queries in one pass."""
    return search.bm25_many(table(s, d, "documents"), "doc_id", "text", MANY)


def _index(s: SparkSession, d: str) -> hybrid.Index:
    m = F.col("metadata")
    c = table(s, d, "chunk").where("page_content is not null").select("chunk_id", "page_content", m.veda.alias("veda"), m.filename.alias("filename"), m.title.alias("title"), m.chronology_layer.alias("layer"), m.chronology_name.alias("layer_name"))
    semantic = lambda texts: search.bm25_many(c, "chunk_id", "page_content", [t.split() for t in texts])
    return hybrid.Index(c, "chunk_id", "page_content", veda="veda", layer="layer", layer_name="layer_name", title="title", fields=["filename"], proper=table(s, d, "proper_noun"), dictionary=_dictionary(s, d), semantic=semantic)


PATTERNS = {"vanaveda": ["vana samhita", "vn"], "nadiveda": ["nadi samhita", "nd"], "kapila_brahmana": ["kapila brahmana", "kp"]}


def _chain(s: SparkSession, d: str, text: str, **kw) -> DataFrame:
    out = hybrid.retrieve(_index(s, d), hybrid.Question(text, patterns=PATTERNS, **kw))
    return out.select("chunk_id", F.round("score", 6).alias("score"), "pos", "veda", F.md5("page_content").alias("content"))


@query
def chain_strict_source(s, d):
    """One source asked for: its passages alone, filled up from a search within it."""
    return _chain(s, d, "which ritual offering does the Nadi Samhita describe")


@query
def chain_diachronic(s, d):
    """Layers in turn, the first passages tagged with source and layer."""
    return _chain(s, d, "how does the offering change from the early to the later layer of the ritual", terms=SCAN_TERMS)


@query
def chain_concordance(s, d):
    """All verses with a term in front."""
    return _chain(s, d, "which verses mention the stone", terms=SCAN_TERMS)


@query
def chain_names(s, d):
    """Passages of the names and places behind the ranked ones."""
    return _chain(s, d, "where did Giśitpati cross the river with the king", names_for=[(Q.LOCATION, ["Asānadī", "Ditpura"])])


@query
def chain_topic(s, d):
    """A named topic triples the passages of its source."""
    return _chain(s, d, "offering to the river and the altar", topics=[([["river"], ["altar", "stone"]], F.coalesce(F.lower("title").contains("kapila"), F.lit(False)))])


# ── dictionary ──


def _dictionary(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The list of proper nouns as a dictionary: names are concepts, their contexts definitions."""
    p = table(s, d, "proper_noun").where("canonical is not null")
    p = p.groupBy("canonical").agg(F.min_by(F.struct("variants", "context", "sources"), "category").alias("b")).select("canonical", "b.*")
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    concepts = p.select(F.col("canonical").alias("primary_key"), none.alias("devanagari"), F.coalesce(F.array_sort("variants"), empty).alias("iast_variants"), F.array("canonical").alias("headwords"),
                        F.when(F.col("context").isNull(), empty).otherwise(F.array("context")).alias("definitions"), F.coalesce("sources", empty).alias("vedic_refs"))
    index = concepts.select(F.explode(F.array_union(F.col("headwords"), F.col("iast_variants"))).alias("v"), "primary_key")
    index = index.select(T.dictionary_key(F.col("v")).alias("normalized"), "primary_key").where("normalized != ''").groupBy("normalized").agg(F.min("primary_key").alias("primary_key"))
    return index, concepts


def _notes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "kg_seed").where("subject is not null").select("fact_id", "subject")


@query
def dictionary_expansion(s, d):
    """Every fact's subject expanded by the concepts of its words."""
    return lookup.expand_queries(_notes(s, d), "fact_id", "subject", *_dictionary(s, d)).select("fact_id", "expanded")


@query
def dictionary_references(s, d):
    r = lookup.references_of(_notes(s, d), "fact_id", "subject", *_dictionary(s, d))
    return r.select("fact_id", F.explode("references").alias("word", "refs")).select("fact_id", "word", F.array_join("refs", "|").alias("refs"))


@query
def dictionary_variants(s, d):
    """All forms of every distinct first word of a subject."""
    t = _notes(s, d).select(F.get(T.words(F.col("subject")), F.lit(0)).alias("term")).where("term is not null").distinct()
    return lookup.all_variants(t, "term", *_dictionary(s, d))


@query
def dictionary_stats(s, d):
    return lookup.dictionary_stats(*_dictionary(s, d))


@query
def source_forms(s, d):
    """Every listed name in the forms it has in one source; names the source does not have stand for themselves."""
    p = table(s, d, "proper_noun")
    return lookup.source_forms(p.where("canonical is not null").select("canonical").distinct(), "canonical", p, "v01")


@query
def known_names(s, d):
    """Whether the words of subjects are forms of listed names."""
    t = _notes(s, d).select(F.explode(T.words(F.col("subject"))).alias("word")).distinct()
    return lookup.is_proper_noun(t, "word", table(s, d, "proper_noun"))


@query
def noun_entry(s, d):
    return lookup.noun_info(table(s, d, "proper_noun"), "dikātsu").select("canonical", "category", "role", "context", "sources")


@query
def group_members(s, d):
    """Subjects with the dynasties they are members of and the other members of these."""
    e = lineage.cut(kg.edges(table(s, d, "kg_seed"), "fact_id"), "edges")
    groups = kg.members(e).select(F.col("dynasty").alias("grp"), "members")
    t = e.select(F.col("first_seq").alias("id"), F.col("subject_key").alias("name")).where("id % 20 = 0")
    return lookup.with_groups(t, "id", "name", groups)


@query
def word_translations(s, d):
    """Terms for English words of the notes, from a small dictionary and the list of names."""
    words = table(s, d, "kg_seed").where("note is not null").select(F.explode(T.words(F.col("note"))).alias("w")).distinct()
    dic = s.createDataFrame([("river", "nadī", "noun", ["sindhu", "sarit"]), ("once", "sakṛt", "adverb", None), ("read", None, None, ["paṭh"])], "word string, term string, kind string, synonyms array<string>")
    names = table(s, d, "proper_noun").where("canonical is not null").select(F.col("canonical").alias("word"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("kind")).distinct()
    return lookup.translate_word(words, "w", dic, names)


# ── questions ──


_text_query("planned_types", agent.plan_type)
_text_query("planned_tools", lambda c: agent.next_tool(agent.plan_type(c)))
_text_query("planned_words", lambda c: F.array_join(agent.words_to_translate(c), "|"))
_text_query("lexicon_terms", lambda c: F.array_join(expand.question_terms(c, LEXICON), "|"))
_text_query("embedding_texts", T.preprocess_for_embedding)
_text_query("stemmed_queries", T.preprocess)
_text_query("expanded_spellings", translit.expand_query, "kg_seed")
_text_query("accented_devanagari", translit.to_devanagari_with_accents, "kg_seed")
_text_query("kannada", translit.to_kannada, "kg_seed")


@query
def html_pages(s, d):
    """Documents as pages: entities decoded, tags out, footer cut."""
    return parse.html_text(table(s, d, "documents").where("text is not null").select("doc_id", "text"), "text", "plain").select("doc_id", F.col("plain").alias("value"))


# ── citations ──


@query
def metadata_citations(s, d):
    """A citation from each chunk's metadata: mandala with the passage's number where it has one."""
    c = table(s, d, "chunk").select("chunk_id", F.col("metadata.mandala").alias("m"), F.nullif("metadata.pb_section", F.lit("")).alias("section"), F.when(F.col("metadata.mandala").isNotNull(), F.col("pos")).alias("h"))
    return c.select("chunk_id", C.from_metadata({"mandala": F.col("m"), "hymn_number": F.col("h"), "verse_number": F.col("section")}).alias("citation"))


@query
def citation_rows(s, d):
    """The citation list of a search."""
    docs = table(s, d, "documents")
    hits = hybrid.held(hybrid.ranked(search.bm25(docs, "doc_id", "text", "river hymn"), "doc_id").join(docs.select("doc_id", "text", "source"), "doc_id"))
    label = C.citation_label(F.col("text"), F.lit(None).cast("string"), F.col("pos") + 1)
    return C.citation_list(hits.withColumn("label", label), "label", "source")


@query
def citation_passages(s, d):
    """The evidence block of a search, one row."""
    docs = table(s, d, "documents")
    hits = hybrid.held(hybrid.ranked(search.bm25(docs, "doc_id", "text", "river hymn"), "doc_id").join(docs.select("doc_id", "text"), "doc_id"))
    return C.citation_block(hits.withColumn("label", F.concat(F.lit("Passage "), (F.col("pos") + 1).cast("string"))), "text", "label")


# Texts that the test tables do not have: headers, references and marks of every kind the operators read.
REFERENCES = [
    (1, "# Book II.\n## Canto XIV. The Vow.\n[007] He spoke.", "Ramayana of V."), (2, "## [05-061] HYMN LXI. Maruts.", "Rigveda"), (3, "as RV 7.18.9 says", None), (4, "VSM 3.60 and more", "Yajurveda"),
    (5, "PBr. XXV. 10. 16 tells", "Pancavimsa Brahmana"), (6, "12. They went on", "Pancavimsa"), (7, "Satapatha 1.2.3.4", None), (8, "### Hymn 12: To Dawn", None), (9, "Book IV", None), (10, "nothing", "x"), (11, "अग्निम् ईळे", "Ramayana"), (12, None, None),
]


def _references(s: SparkSession) -> DataFrame:
    return s.createDataFrame(REFERENCES, "id int, t string, title string")


@query
def reference_kinds(s, d):
    """The label of a reference of every kind, with the headers of the text."""
    r = parse.book_headers(_references(s), "t")
    return r.select("id", C.verse_reference(F.col("t")).alias("citation"), C.section_title(F.col("t")).alias("head"), "book", "canto", "section")


@query
def enriched_kinds(s, d):
    return expand.enrich_chunks(_references(s), "t", "title").select("id", "book", "canto", "pb_section", "preprocessing", "original_content_length", F.col("t").alias("text"))


# ── graph ──


@query
def kg_question_context(s, d):
    """The facts around the entities of one word that facts mention, their objects taken as questions."""
    e = lineage.cut(kg.edges(table(s, d, "kg_seed"), "fact_id"), "edges")
    names = e.where(~F.col("subject").rlike(r"\s")).select(T.normalize_latin(F.col("subject")).alias("key"))
    asked = table(s, d, "kg_seed").where("object is not null and fact_id % 20 = 0").select("fact_id", "object")
    return kg.question_context(asked, "fact_id", "object", names, e).select("fact_id", "subject_key", "relation", "object_key", "hop")


@query
def kg_stored(s, d):
    """Facts saved, extended by later ones, reduced by deleted ones and loaded again."""
    path = f"{lineage.shared_dir(s)}/shabdagrid/graph-{lineage.fresh_name()}"
    f = kg.valid_facts(table(s, d, "kg_seed")).select("subject", "relation", "object", "citation", "note", "provenance", F.col("fact_id").alias("seq"))
    graph.save(f.where("seq % 3 != 0"), path)
    graph.save(graph.upsert(graph.load(s, path), f.where("seq % 3 = 0")), path)
    graph.save(graph.delete(graph.load(s, path), f.where("seq % 7 = 0")), path)
    return graph.load(s, path).select(kg.entity_key(F.col("subject")).alias("subject_key"), "relation", kg.entity_key(F.col("object")).alias("object_key"))


# ── editions: landed samples in the form of each ──

SAMPLES = {
    "AVS": "(AVŚ_5,22.1a) agnis takmānam |\n(AVŚ_5,22.1c) vedir barhiḥ ||1||\n\n(AVŚ_2,17.1a) ojo me dāḥ svāhā |1||",
    "PB": "x (PB 1.1.1) mahan me (PB 1.1.2) bhargo me\n(PB 2.1.1) agne",
    "SB": "SATAPATHA\n1.1.1.[1]\nvratam upaiṣyan\nantareṇa\n1.1.1.[2]\napa upaspṛśati\n2.1.1.[1]\nsa yad vai",
    "RV": "# head\nagnim īḷe |\npurohitam || 1.1.1\n\nhotāram || 1.1.2",
    "AB": "Chapter: 7 Paragraph: 13 Sentence: 1 hariścandro ha Sentence: 2 tasya ha<br>This text is part of x",
    "VS": "Paragraph: 1 Verse: 1 Sentence: a iṣe tvā Sentence: b ūrje tvā Verse: 2 Sentence: a vasoḥ pavitram",
    "TS": "Book: 1 Chapter: 1 Paragraph: 1 Verse: 1 Sentence: 1 iṣe tvā {F x} Sentence: 2=b ūrje tvā Paragraph: 2 Verse: 1 Sentence: 1 yajñasya ghoṣad asi",
}


def _landed(s: SparkSession, name: str) -> DataFrame:
    if name in ("AB", "VS", "TS"):
        return s.createDataFrame([("p1", 1, SAMPLES[name])], "file string, page int, text string")
    return s.createDataFrame([("f", i, t) for i, t in enumerate(SAMPLES[name].split("\n"))], "file string, line_no int, text string")


@query
def edition_verses(s, d):
    """The verses of the sample of every edition."""
    out = None
    for name, e in editions.EDITIONS.items():
        v = editions.verses_of(e, _landed(s, name)).select(F.lit(name).alias("work"), "address", "text")
        out = v if out is None else out.unionByName(v)
    return out


@query
def edition_markdown(s, d):
    """The Markdown view of one edition with two header levels, with the editorial gloss."""
    e = editions.EDITIONS["AB"]
    m = editions.markdown(e, editions.verses_of(e, _landed(s, "AB")))
    return m.select(F.concat_ws("/", *[F.col(f"line_no.{x}").cast("string") for x in [*e.levels, "_p"]]).alias("line_no"), "text")


@query
def edition_chunks(s, d):
    e = editions.EDITIONS["RV"]
    return editions.chunks_of(e, editions.verses_of(e, _landed(s, "RV")))


@query
def answer_scores(s, d):
    """Events as answers: right ones and all, by user and kind."""
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("right"), F.count(F.lit(1)).alias("answers"))


__all__ = ["QUERIES"]
