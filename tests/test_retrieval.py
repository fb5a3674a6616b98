"""The retrieval chain on a small corpus: what every stage adds."""

import pytest
from pyspark.sql import functions as F

from shabdagrid.operators import search
from shabdagrid.plans import hybrid

DOCS = [
    (1, "the river hymn of the altar", "vana", "Vana Samhita", 1, "early"),
    (2, "the altar and the river and the stone", "kapila", "Kapila Brahmana", 2, "late"),
    (3, "nothing of it", "vana", "Vana Samhita", 1, "early"),
    (4, "नदी वहति ॥ VN 1.1.1 ॥", "vana", "Vana Samhita", 1, "early"),
    (5, "सोमः पवते ॥ VN 1.1.2 ॥", "vana", "Vana Samhita", 2, "late"),
    (6, "Vipas flows", "nadi", "Nadi Samhita", 2, "late"),
    (7, None, "nadi", "Nadi Samhita", 2, "late"),
    (8, "altar altar river", "nadi", "Nadi Samhita", None, None),
]
PROPER = [("place", "Vipāś", ["Vipas"], None, "river of the north", ["nadi"])]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "id long, t string, veda string, title string, layer int, layer_name string").coalesce(1)
    proper = spark.createDataFrame(PROPER, "category string, canonical string, variants array<string>, role string, context string, sources array<string>")
    lookup_index = spark.createDataFrame([("नदी", "nadi"), ("nadī", "nadi")], "normalized string, primary_key string")
    concepts = spark.createDataFrame([("nadi", None, ["nadī"], ["nadi"], ["flowing stream water"], ["VN 1.1"])], "primary_key string, devanagari string, iast_variants array<string>, headwords array<string>, definitions array<string>, vedic_refs array<string>")
    semantic = lambda texts: search.bm25_many(docs, "id", "t", [t.split() for t in texts])
    return hybrid.Index(docs, "id", "t", veda="veda", title="title", layer="layer", layer_name="layer_name", proper=proper, dictionary=(lookup_index, concepts), semantic=semantic)


def got(index, text, **kw):
    return hybrid.retrieve(index, hybrid.Question(text, **kw)).orderBy("pos").collect()


def test_batch_equals_single_searches(index):
    qs = [["river", "altar"], ["altar", "altar"], ["none"], []]
    many = search.bm25_many(index.docs, "id", "t", qs).collect()
    for i, q in enumerate(qs):
        one = {(r["id"], r["score"]) for r in search.bm25(index.docs, "id", "t", q).collect()}
        assert {(r["id"], r["score"]) for r in many if r["q"] == i} == one
    tables = search.index_tables(index.docs, "id", "t")
    assert {tuple(r) for r in search.bm25_indexed(tables, "id", "river altar").collect()} == {tuple(r) for r in search.bm25(index.docs, "id", "t", "river altar").collect()}
    assert search.bm25_many(index.docs.limit(0), "id", "t", qs).count() == 0


def test_topic_and_plain_ranking(index):
    plain = got(index, "the river altar")
    assert [r["pos"] for r in plain] == list(range(len(plain))) and {r["id"] for r in plain} >= {1, 2, 8}
    topic = got(index, "the river altar", topics=[([["river"], ["altar"]], F.col("title").contains("Kapila"))])
    assert topic[0]["id"] == 2 and {r["id"] for r in topic} == {r["id"] for r in plain}


def test_one_source_asked_for(index):
    rows = got(index, "river altar in the nadi samhita", patterns={"nadi": ["nadi samhita"], "vana": ["vana samhita"]})
    assert rows and all(r["veda"] == "nadi" for r in rows)
    both = got(index, "compare the river altar in the nadi samhita and before", patterns={"nadi": ["nadi samhita"]})
    assert both[0]["veda"] == "nadi" and len({r["veda"] for r in both}) > 1


def test_concordance_and_sections(index):
    rows = got(index, "which verses mention the stone", terms=["नदी"])
    assert rows[0]["id"] is None and rows[0]["t"].splitlines() == ["1 verses", "नदी वहति ॥ VN 1.1.1 ॥"]
    whole = next(r for r in rows if r["id"] == 4)
    assert whole["t"] == "## VN 1.1\nनदी वहति ॥ VN 1.1.1 ॥\nसोमः पवते ॥ VN 1.1.2 ॥"


def test_layers_names_and_dictionary(index):
    rows = got(index, "how does the river altar change from the early to the later layer")
    assert rows[0]["layer"] == 1 and rows[1]["layer"] == 2 and rows[0]["t"].startswith("[SOURCE: Vana Samhita — chronology: early, layer 1]\n")
    named = got(index, "altar beside it", names_for=[(["beside"], ["Vipāś"])])
    assert named[-1]["id"] == 6
    deva = got(index, "नदी")
    assert deva[0]["id"] == 4 and deva[0]["dictionary_terms"] == ["nadi"]
    assert got(index, "zzz") == []
