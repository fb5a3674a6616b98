import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from shabdagrid.llm.visual_form import consistent_form, same_look, with_consistent_form

ALIKE = [
    ("Ravi Kumar", "Ｒａｖｉ　Ｋｕｍａｒ"),
    ("Ravi Kumar", "  Ravi\r\n\tKumar "),
    ("Ravi Kumar", "R​a­vi Kumar﻿"),
    ("āśṛ", unicodedata.normalize("NFD", "āśṛ")),
    ("Purudasa", "Ρuruԁаѕа"),
    ("Kuru-Vana", "Kuru‐Vana"),
    ("prefix", "preﬁx"),
    ("॥ 1 ॥", "।। 1 ।।"),
    ("मः", "म:"),
    ("आत्मा", "अात्मा"),
    ("ऐ औ ओ", "एे अौ अो"),
    ("grip", "gɾip".replace("ɾ", "r").replace("i", "ι").replace("p", "ρ")),
    ("huk", "հuк"),
    ("Wand", "Ꮃand"),
]
APART = [("Ravi", "ravi"), ("Jeno", "Jeno²"), ("Rama", "Rāma"), ("Ravi", "Ravi."), ("a-b", "a—b"), ("क्‌ष", "क्ष"), ("a b", "ab"), ("“x”", '"x"'), ("॥ 1 ॥", "। 1 ।"), ("a:", "aः"), ("िa", "ाa"), ("12:", "12ः")]


def test_alike_and_apart():
    for a, b in ALIKE:
        assert consistent_form(a) == consistent_form(b), (a, b)
    for a, b in APART:
        assert consistent_form(a) != consistent_form(b), (a, b)


def test_genuine_words_keep_their_script():
    assert consistent_form("Σημείωση του εκδότη") == "Σημείωση του εκδότη"
    assert consistent_form("Примечание") == "Примечание"
    assert consistent_form("Примeчaние") == "Примечание"
    assert consistent_form("καλός") == "καλός"
    assert consistent_form("υιός") == "υιός"
    assert consistent_form("հայ") == "հայ"


def test_fold_case():
    assert consistent_form("STRASSE", True) == consistent_form("straße", True)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA éāр​‍्क ﬁ²\n。Κ", max_size=30))
def test_idempotent(t):
    once = consistent_form(t)
    assert consistent_form(once) == once


def test_same_look(spark):
    rows = [(3, "Ravi"), (1, "Ｒａｖｉ"), (2, "Ravi"), (4, "ravi"), (5, None), (6, " "), (7, "​"), (8, "x" * 50_000), (9, "x" * 50_000 + "​"), (10, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "id long, t string, form string")
    assert sorted(map(tuple, same_look(df, "id", "t").collect())) == [(1, 2), (1, 3), (8, 9)]
    assert same_look(df.limit(0), "id", "t").count() == 0


def test_form_column_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "​"), (4, "ａ")], "id long, t string")
    assert [r["f"] for r in with_consistent_form(df, "t", "f").orderBy("id").collect()] == [None, "", "", "a"]
