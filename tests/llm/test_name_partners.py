import random

import pytest

from shabdagrid.llm import name_variants
from shabdagrid.llm.name_variants import AGREE, edit_distance, link_names, spared

LETTERS = "abcdegiklmnoprstuv"


def changed(form, times, rng):
    """The form after some typing errors: letters changed, left out, added or exchanged with their neighbour."""
    t = list(form)
    for _ in range(times):
        i, kind = rng.randrange(len(t) - 1), rng.randrange(4)
        if kind == 0:
            t[i] = rng.choice(LETTERS)
        elif kind == 1:
            del t[i]
        elif kind == 2:
            t.insert(i, rng.choice(LETTERS))
        else:
            t[i], t[i + 1] = t[i + 1], t[i]
    return "".join(t)


def test_forms_that_agree_have_letters_in_common():
    rng, tried = random.Random(3), 0
    for _ in range(2000):
        a = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 16)))
        b = changed(a, rng.randrange(1, 4), rng)
        n = max(len(a), len(b))
        if 1 - edit_distance(a, b, n) / n >= 2 * AGREE - 1:
            tried += 1
            assert spared(a) & spared(b), (a, b)
    assert tried > 300


def persons(spark, names):
    proper = spark.createDataFrame([("given_name", "Lokagopa", ["Cattya"])], "category string, canonical string, variants array<string>")
    return {r["name"]: r["person"] for r in link_names(spark.createDataFrame([(n,) for n in names], "name string"), proper).collect()}


@pytest.mark.parametrize("crowd", [3, name_variants.CROWD, 10_000])
def test_rare_forms_meet_among_many_used_ones(spark, monkeypatch, crowd):
    """Two spellings that agree with each other alone share every bucket with forms that are used more."""
    monkeypatch.setattr(name_variants, "CROWD", crowd)
    rng = random.Random(6)
    one, two = "rupatokidunel", "rupatokigunel"
    others = set()
    while len(others) < 250:
        t = list(one)
        for i in rng.sample(range(len(t)), 4):
            t[i] = rng.choice(LETTERS)
        t = "".join(t)
        if min(edit_distance(t, one, 9), edit_distance(t, two, 9)) >= 4 and not t.endswith("a"):
            others.add(t)
    rare = [f"Lokagopa {t.title()}" for t in (one, two)]
    got = persons(spark, rare + [f"Lokagopa {t.title()}" for t in sorted(others)] * 3)
    assert got[rare[0]] == got[rare[1]]
    assert sum(p == got[rare[0]] for p in got.values()) == 2


def test_who_fits_no_centre_is_held_against_the_members(spark):
    full = ["Lokagopa Chaparalinutu"] * 3 + ["Lokagopa Chxpxralinutu", "Cattya Rumatidunelo", "Lokagopa Xumatixunelo", "Lokagopa Rumatidunelo"]
    rest = ["L. Chxpxralinuto", "Lokagopa Xumatixun."]
    got = persons(spark, full + rest)
    assert got["L. Chxpxralinuto"] == got[full[0]] == got[full[3]]
    assert got["Lokagopa Xumatixun."] == got["Lokagopa Rumatidunelo"] == got["Lokagopa Xumatixunelo"]
    assert got[full[0]] != got["Lokagopa Rumatidunelo"]
