import random

from pyspark.sql import functions as F

from terrane.operators import ranks


def test_running_sums_of_groups_that_span_ranges(spark):
    rng = random.Random(2)
    rows = [(0 if k % 3 else k % 7, k * 37 % 1009, float(rng.randrange(100))) for k in range(1000)]
    df = spark.createDataFrame(rows, "g long, o long, v double")
    got = {(r["g"], r["o"]): (r["step"], r["g_v"]) for r in ranks.running(df.repartition(5), ["g"], ["o"], ["v"]).collect()}
    want, total, step = {}, 0.0, 0
    last = None
    for g, o, v in sorted(rows):
        total, step = (v, 1) if g != last else (total + v, step + 1)
        last, want[g, o] = g, (step, total)
    assert got == want and ranks.running(df.where("false"), ["g"], ["o"], ["v"]).count() == 0


def test_first_rows_by_narrow_keys(spark):
    df = spark.range(500).select(F.col("id").alias("fid"), (F.col("id") * 7919 % 97).cast("double").alias("x"), F.repeat(F.lit("wide"), 50).alias("geom"))
    want = [r["fid"] for r in sorted(df.collect(), key=lambda r: (r["x"], r["fid"]))]
    for k in (0, 1, 37, 499, 500, 800):
        assert sorted(r["fid"] for r in ranks.first(df, k, "x", "fid").collect()) == sorted(want[:k])
    assert ranks.kth(df, 37, "x", "fid")["fid"] == want[37] and ranks.kth(df, 500, "x", "fid") is None
