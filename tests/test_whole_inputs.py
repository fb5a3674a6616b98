"""Queries take whole values: fixtures whose answer stands beyond the first characters or words."""

import pytest

import __spark_entry__ as entry


@pytest.fixture
def folder(spark, tmp_path):
    def put(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def test_sources_are_found_in_the_whole_text(spark, folder):
    far = "x " * 400
    d = folder(documents=([(1, far + "the Nadi Samhita"), (2, "vn " + far + "kp"), (3, "vn " + far + "compare"), (4, far), (5, None)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["sources"], r["strict"]) for r in entry.queries()["detected_sources"](spark, d).collect()}
    assert got == {1: (["nadiveda"], True), 2: (["vanaveda", "kapila_brahmana"], False), 3: (["vanaveda"], False), 4: ([], False)}


SUBJECTS = ([(1, "Rishabha Ambarisha"), (2, "rājā  Gam\tUlupika"), (3, "Gamya"), (4, " "), (5, None), (6, "Gam Gamya")], "fact_id long, subject string")


def test_every_word_of_a_subject_gets_its_keys(spark, folder):
    d = folder(kg_seed=SUBJECTS)
    keys = {(r["fact_id"], r["pos"]): r["value"] for r in entry.queries()["sandhi_keys"](spark, d).collect()}
    assert set(keys) == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (6, 0), (6, 1)}
    assert (keys[1, 0], keys[1, 1], keys[2, 1], keys[2, 2]) == ("rishabha", "ambarisha|mbarisha", "gam", "ulupika|olupika")
    forms = {(r["fact_id"], r["pos"]): r["value"] for r in entry.queries()["romanisations"](spark, d).collect()}
    assert set(forms) == set(keys)
    assert (forms[1, 1], forms[2, 1]) == ("ambarisha|ambariśa|ambaṛśa|ambariṣa", "gam")


def test_every_word_of_a_subject_is_looked_up(spark, folder):
    proper = ([("given_name", "Gam", ["Gamya"]), ("given_name", "Ulūpikā", ["Ulupika"])], "category string, canonical string, variants array<string>")
    got = {tuple(r) for r in entry.queries()["canonical_names"](spark, folder(kg_seed=SUBJECTS, proper_noun=proper)).collect()}
    assert got == {("Rishabha", 1), ("Ambarisha", 1), ("rājā", 1), ("Gam", 3), ("Ulūpikā", 1)}


def test_url_fragment_of_the_whole_text(spark, folder):
    d = folder(documents=([(1, "Book 1.2 " + "a" * 50 + " End."), (2, "")], "doc_id long, text string"))
    got = {tuple(r) for r in entry.queries()["url_fragments"](spark, d).collect()}
    assert got == {(1, "book-1-2-" + "a" * 50 + "-end-"), (2, "")}


def test_lexicon_has_words_with_marks_and_devanagari(spark, folder):
    d = folder(documents=([(1, "nadī Ṛṣabha river rivermārga नदी"), (2, None)], "doc_id long, text string"))
    got = {(r["kind"], r["key"]): r["tokens"] for r in entry.queries()["lexicon_build"](spark, d).collect()}
    assert got["primary", "nadi"] == ["nadī", "नदी"]
    assert got["primary", "rishabha"] == got["skeleton", "risabha"] == ["ṛṣabha"]
    assert {k for kind, k in got if kind == "primary"} == {"nadi", "rishabha", "river", "rivermarga"}
    found = [r["token"] for r in entry.queries()["lexicon_lookup"](spark, d).orderBy("pos").collect()]
    assert found == ["river", "rivermārga"]


def test_every_twentieth_vector_is_a_query(spark, folder, monkeypatch):
    import random

    from shabdagrid.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 40)
    rnd = random.Random(7)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)], i % 2) for i in range(1, 161)]
    rows[59] = (60, [0.0, 0.0, 0.0], 0)
    rows[0], rows[2], rows[4] = (1, None, 1), (3, [1.0, None, 2.0], 1), (5, [1.0, 2.0], 1)
    d = folder(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    for name, where in (("dense_topk_all", None), ("dense_topk_all_filtered", v["label"] == 1)):
        got = {}
        for r in entry.queries()[name](spark, d).orderBy("query", "pos").collect():
            got.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert set(got) == {20, 40, 80, 100, 120, 140, 160}
        for q, hits in got.items():
            one = search.dense_topk(v, "vec_id", "embedding", rows[q - 1][1], where=where).orderBy("score", ascending=False)
            assert hits == sorted(((r["vec_id"], r["score"]) for r in one.collect()), key=lambda x: (-x[1], x[0])), (name, q)
