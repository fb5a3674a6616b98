import random

from pyspark.sql import functions as F

from shabdagrid.operators.skew import lookup, with_group


def test_with_group_and_lookup_on_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, str(i)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string")
    count, least = {}, {}
    for i, k in rows:
        count[k] = count.get(k, 0) + 1
        least[k] = min(least.get(k, i), i)
    got = {r["id"]: (r["group_rows"], r["m"]) for r in with_group(df, ["k"], "id", {"m": (F.col("id"), "min")}).collect()}
    assert got == {i: (count[k], least[k]) for i, k in rows}
    assert with_group(df, ["k"], "id", {}, at_least=2).count() == sum(1 for _, k in rows if count[k] > 1)
    right = spark.createDataFrame([("hot", 1), ("a", 2)], "rk string, v int")
    inner = {r["id"]: r["v"] for r in lookup(df, "k", right, "rk", ["v"], "id").collect()}
    assert inner == {i: {"hot": 1, "a": 2}[k] for i, k in rows if k in ("hot", "a")}
    assert lookup(df, "k", right, "rk", ["v"], "id", how="left").count() == 3000
