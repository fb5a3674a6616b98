from shabdagrid.llm.name_variants import FINE_ROWS, RECALL, TYPO_JACCARD, bands, link_names


def test_fine_bands_reach_the_recall():
    n = len(bands("chaparalinut")[1])
    assert 1 - (1 - TYPO_JACCARD**FINE_ROWS) ** n >= RECALL > 1 - (1 - TYPO_JACCARD**FINE_ROWS) ** (n - 1)


def test_cut_names_with_a_typo_in_front_or_few_letters(spark):
    names = ["Lokagopa Chaparalinut", "Lokagopa Capxr.", "Lokagopa Kaparal.", "Lokagopa Cap.", "Lokagopa Xap.", "Tarasena Rumatidu", "Tarasena Rumitadu", "Tarasena Rumat.", "Tarasena Urmatid."]
    proper = spark.createDataFrame([("given_name", "Lokagopa", ["Cattya"]), ("given_name", "Tarasena", None)], "category string, canonical string, variants array<string>")
    got = {r["name"]: r["person"] for r in link_names(spark.createDataFrame([(n,) for n in names], "name string"), proper).collect()}
    assert len({got[n] for n in names[:4]}) == 1
    assert got["Lokagopa Xap."] not in {got[names[0]], None}
    assert got["Tarasena Rumat."] == got["Tarasena Rumatidu"]


def test_given_names_that_are_errors_of_several_listed_ones(spark):
    names = ["Pururatha Yatunarutiyana", "Pruuratha Yatunarutiyana", "P. Yatunarutiyana", "Praratha Nulanijakutha", "Prartha Nulanijakuta", "Zzzz Yatunarutiyana", "Pruratha Somavidupana"]
    proper = spark.createDataFrame([("given_name", "Pururatha", None), ("given_name", "Praratha", None)], "category string, canonical string, variants array<string>")
    got = {r["name"]: r["person"] for r in link_names(spark.createDataFrame([(n,) for n in names], "name string"), proper).collect()}
    assert got[names[0]] == got[names[1]] == got[names[2]] and got[names[3]] == got[names[4]]
    assert len({got[n] for n in names}) == 4  # a given name like none, and one whose family nobody else has, stand for themselves
