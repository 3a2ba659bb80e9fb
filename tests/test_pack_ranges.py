"""Running sums over a file that holds most rows."""

from itertools import accumulate

from pyspark.sql import functions as F

from loomdoc.operators import ranking, retrieve

ROWS = [("hot", i, (i * 7) % 5) for i in range(400)] + [(f"k{i % 20}", i, 3) for i in range(100)] + [(None, 0, 2), (None, 1, 2)]


def test_sums_of_a_hot_group(spark):
    df = spark.createDataFrame(ROWS, "g string, i int, n long")
    got = ranking.spread_before(df, ["g"], [F.col("i").asc()], "n", partitions=7).collect()
    for g in {r[0] for r in ROWS}:
        values = [n for a, _, n in sorted((r for r in ROWS if r[0] == g), key=lambda r: r[1])]
        assert [r["before"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])] == list(accumulate(values, initial=0))[:-1]


def test_no_file_is_summed_in_one_window(spark):
    df = spark.createDataFrame([("g", i, f"c{i:03}", "x" * 50) for i in range(200)], "g string, i int, k string, t string")
    packed = retrieve.pack_context(df, ["g"], "i", "k", "t")
    assert [r["taken"] for r in packed.orderBy("k").collect()] == [50] * 80
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g" in plan and all("_range" in w for w in plan.split("\n") if "Window [" in w)
