from shabdagrid.llm.name_variants import BANDS, ROWS, TYPO_JACCARD, RECALL, edit_distance, fold, link_names, monge_elkan, spelling_pairs

PROPER = [("given_name", "Lokagopa", ["Cattya"]), ("given_name", "Tarasena", ["Vibbo"]), ("given_name", "Ojashasta", []), ("tribe", "Phīnika", ["Phinika"]), ("given_name", "Lakshavana", None)]


def linked(spark, names):
    df = spark.createDataFrame([(n, 1) for n in names], "name string, v long")
    return link_names(df, spark.createDataFrame(PROPER, "category string, canonical string, variants array<string>"))


def test_variants_and_persons(spark):
    one = ["Lokagopa Chaparalinutha", "Chaparalinutha, Lokagopa", "LOKAGOPA CHAPARALINUTHA", "Lōkagopa Chaparaleenūth", "Cattya Chaparalinutha", "Lokagopa Chaprralinutha", "Lokagopa Chaparalinutha Phīnika", "King Lokagopa Chaparalinutha", "Lokagopa Chapara.", "LokagopaChaparalinutha", "Lokagopa_Chaparalinutha", "L. Chaparalinutha", "Lokagopa Chaparalinutha of Vana"]
    two = ["Tarasena Chaparalinutha", "T Chaparalinutha"]
    three = ["Lokagopa Rayarabaritha", "Lakshavana Rayarabaritha"]
    alone = ["L. Rayarabaritha", "Cattya", "", " ", None, "X" * 20_000]
    names = one + two + three + alone
    got = {r["name"]: r["person"] for r in linked(spark, names + one[:3]).collect()}
    assert len({got[n] for n in one}) == 1 and len({got[n] for n in two}) == 1
    assert len({got[n] for n in one + two + three}) == 4
    assert got["L. Rayarabaritha"] is None and "Cattya" not in got and None not in got
    pairs = {tuple(r) for r in spelling_pairs(linked(spark, names)).collect()}
    assert len(pairs) == len(one) * (len(one) - 1) // 2 + 1 and all(a < b for a, b in pairs)


def test_empty(spark):
    assert linked(spark, [None]).count() == 0


def test_parts():
    assert 1 - (1 - TYPO_JACCARD**ROWS) ** BANDS >= RECALL > 1 - (1 - TYPO_JACCARD**ROWS) ** (BANDS - 1)
    assert edit_distance("abcd", "acbd", 3) == 1 and edit_distance("abc", "xyz", 1) == 2
    assert fold("Dhroovahotraa") == fold("Druvahotra") and monge_elkan(["a"], []) == 0.0
