import random
import re
import unicodedata

from shabdagrid.llm.format_copies import collapse, copies, parse_objects


def brute(rows):
    seen, out = {}, []
    for tbl, i, *fs in sorted(rows):
        words = lambda s: None if s is None else tuple(re.findall(r"(?:[^\W_]|[̀-ͯ])+", unicodedata.normalize("NFC", s).lower()))
        k = (tbl, *map(words, fs))
        if k in seen:
            out.append((tbl, seen[k], i))
        else:
            seen[k] = i
    return out


SCHEMA = "tbl string, id long, subject string, relation string, object string, citation string"


def test_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["Rāma of Vana", "Sita", None, "", "—", "A-b c", "ab c", "Śiva_x 12"]
    ways = [str, str.upper, str.lower, lambda s: f"«{s}»", lambda s: s.replace(" ", " /\n"), lambda s: s + "...", lambda s: unicodedata.normalize("NFD", s)]
    rows = []
    for i in range(1500):
        f = [rnd.choice(base) for _ in range(4)]
        rows.append((rnd.choice("tu"), i, *[None if x is None else rnd.choice(ways)(x) for x in f]))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["tbl"], r["keep_id"], r["copy_id"]) for r in copies(df, "id").collect())
    assert got == sorted(brute(rows))


def test_hot_class_and_counts(spark):
    rows = [("t", i, "Same  Name" if i % 2 else "same, name", "has_x", None, "c 1") for i in range(700)] + [("t", 9999, "x", "y", "z", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert copies(df, "id").count() == 699
    got = {r["id"]: r["copies"] for r in collapse(df, "id").collect()}
    assert got == {0: 700, 9999: 1}
    assert copies(df.limit(0), "id").count() == 0


def test_swapped_fields_are_apart(spark):
    df = spark.createDataFrame([("t", 1, "a", "r", "b", None), ("t", 2, "b", "r", "a", None), ("t", 3, "a r", "", "b", None), ("t", 4, "a", "r", "b", "")], SCHEMA)
    assert copies(df, "id").count() == 0


def test_parse_objects(spark):
    lines = [
        (1, '{"subject":"A","relation":"r","object":"B","citation":"c"}'),
        (2, ' {\n "Object": "B", "SUBJECT" : "\\u0041", "relation":"r"},\r'),
        (3, '{"subject": "A", "rel'),
        (4, "// note"),
        (5, None),
        (6, ""),
        (7, '{"subject": null, "relation":"r", "object": 5}'),
    ]
    got = {r["id"]: tuple(r)[1:] for r in parse_objects(spark.createDataFrame(lines, "line_id long, line string"), "line_id", "line").collect()}
    assert got == {1: ("A", "r", "B", "c"), 2: ("A", "r", "B", None), 7: (None, "r", "5", None)}
