import random

from pyspark.sql import functions as F

from shabdagrid.operators import windows


def rows(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("abc") if i % 3 else "hot", i, rnd.choice(["x", "y", None]), rnd.choice([None, None, None, i]), rnd.choice([None, None, i])) for i in range(600)]
    return spark.createDataFrame(data, "file string, line_no int, k string, book int, hymn int")


def test_blocks_change_nothing(spark):
    df = rows(spark)
    g, o, b = ["file"], ["line_no"], F.floor(F.col("line_no") / 7)
    for f in (
        lambda block: windows.run_id(df, g, o, F.col("k"), block=block),
        lambda block: windows.carry_forward(df, g, o, ["book", "hymn"], block),
        lambda block: windows.shifted_groups(df, g, o, F.col("k") == "x", block=block),
        lambda block: windows.running_count(df, g, o, F.lit(True), "n", block=block),
    ):
        plain, blocked = f(None), f(b)
        cols = sorted(plain.columns)
        assert sorted(map(str, plain.select(cols).collect())) == sorted(map(str, blocked.select(cols).collect()))


def test_carry_forward_forgets_lower_levels(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, 5), (3, None, None), (4, 2, None), (5, None, 6)], "n int, book int, hymn int")
    got = [(r["book"], r["hymn"]) for r in windows.carry_forward(df, [], ["n"], ["book", "hymn"]).orderBy("n").collect()]
    assert got == [(1, None), (1, 5), (1, 5), (2, None), (2, 6)]


def test_runs_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "n int, k string")
    assert [r["run"] for r in windows.run_id(df, [], ["n"], F.col("k")).orderBy("n").collect()] == [1, 1, 2, 2, 3]
    assert windows.run_id(df.limit(0), [], ["n"], F.col("k")).count() == 0


def test_first_files(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "x"), ("b", 9, "y"), ("c", 1, "y"), ("c", 2, "x"), ("d", 1, None)], "file string, line_no int, text string")
    got = {r["file"]: r["first_file"] for r in windows.first_files(df, "file", ["line_no"], "text").collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
