import random

import pytest

from shabdagrid.llm.splitting import split_items, split_pattern


def pieces(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "old", {"k": "v"}) for i, t in enumerate(texts)], "id long, t string, piece string, meta map<string,string>")
    out = {}
    for r in split_items(df, "t", **kw).orderBy("id", "piece_no").collect():
        out.setdefault(r["id"], []).append((r["piece_no"], r["n_pieces"], r["piece_start"], r["piece"], r["meta"]))
    return out


def test_properties(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcकि \n.।𝒳,") for _ in range(rnd.randint(0, 3000))) for _ in range(40)]
    texts += ["", " ", "a" * 512, "a" * 513, "x" * 60_000, None, "á" * 900]
    got = pieces(spark, texts)
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        g = got[i]
        assert [x[0] for x in g] == list(range(g[0][1])) and (len(g) == 1) == (len(t) <= 512)
        assert all(len(x[3]) <= 512 and x[4] == {"k": "v"} for x in g)
        at = 0
        for k, (_, _, start, piece, _) in enumerate(g):
            assert t[start : start + len(piece)] == piece
            assert start == (0 if k == 0 else at - 64)
            at = start + len(piece)
        assert at == len(t)


def test_natural_boundaries(spark):
    line = "One sentence of the text stands here. "
    (g,) = pieces(spark, [(line * 10).strip() + "\n\n" + line * 30]).values()
    assert g[0][3].endswith("\n\n")
    assert all(x[3].endswith(". ") for x in g[1:-1])


def test_marks_stay_with_their_letter(spark):
    (g,) = pieces(spark, ["á" * 900]).values()
    assert all(x[3].endswith("́") for x in g)


def test_parameters(spark):
    with pytest.raises(ValueError):
        split_pattern(10, 10)
    (g,) = pieces(spark, ["abcdefghij" * 3], size=10, overlap=0).values()
    assert "".join(x[3] for x in g) == "abcdefghij" * 3


def test_other_spaces_and_unspaced_dandas(spark):
    nbsp = " ".join(["word"] * 300)
    danda = ("क" * 40 + "।") * 40
    a, b = pieces(spark, [nbsp, danda]).values()
    assert all(x[3].endswith(" ") for x in a[:-1]) and all(x[3].endswith("।") for x in b[:-1])


def test_early_boundaries_before_long_runs(spark):
    a, b, c = pieces(spark, ["One two three four. " * 4 + "x" * 500 + " tail words here", "word " * 24 + "y" * 1000, "z" * 700 + " end of it all " + "w" * 600]).values()
    assert a[0][3] == "One two three four. " * 4
    assert b[0][3] == "word " * 24
    assert c[1][3].endswith(" ") and c[1][3][64:].startswith("z")
