import random

from pyspark.sql import functions as F

from enrichflow.operators.ranking import ranked


def test_positions_equal_a_window(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2, 3, None]), i) for i in range(400)] + [("hot", 5, i) for i in range(900)]
    frame = spark.createDataFrame(rows, "run string, position int, id int").repartition(7)
    got = ranked(frame, [F.col("position").asc_nulls_first(), F.col("id").asc()], by=["run"]).collect()
    want = {}
    for run in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r: k for k, r in enumerate(mine)})
    assert {tuple(r)[:3]: r["rank"] for r in got} == want and len(got) == len(rows)


def test_equal_rows_get_different_positions_and_spread(spark):
    frame = spark.range(5000).select(F.lit(1).alias("k"), F.lit("x").alias("_value"), "id")
    got = ranked(frame, [F.col("k").asc()], tie=F.xxhash64("id"))
    assert sorted(r["rank"] for r in got.collect()) == list(range(5000))
    assert got.columns == ["k", "_value", "id", "rank"]


def test_empty(spark):
    assert ranked(spark.createDataFrame([], "a int"), [F.col("a").asc()]).collect() == []
