import random

from shabdagrid.llm.components import connected_components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "c") for a, b in pairs], "subject string, object string, name string")
    return {r["name"]: r["group_name"] for r in connected_components(df, "subject", "object").collect()}


def test_random_chain_and_hub(spark):
    rnd = random.Random(2)
    pairs = [(f"n{rnd.randint(0, 300)}", f"n{rnd.randint(0, 300)}") for _ in range(150)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(60)]
    pairs += [("hub", f"h{i}") for i in range(200)]
    pairs += [(None, "x"), ("x", None), ("self", "self"), ("", "é"), ("Ω", "é")] + [("n1", "n2")] * 5
    want = union_find(pairs)
    assert run(spark, pairs) == want
    assert "self" not in want


def test_empty(spark):
    assert run(spark, [("a", None)]) == {}
