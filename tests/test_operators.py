import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import lines, network, points, polygons, selection, simplify, topology

POINTS = "fid long, easting double, northing double, dip double, dip_dir double"


def square(x, y, n=10.0):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


def mosaic(spark, rows):
    return spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in ring], a, b) for f, ring, a, b in rows], "fid long, ring array<struct<x:double,y:double>>, strat1 string, lith string")


def layer(spark, rows):
    return spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in g]) for f, g in rows], "fid long, geom array<struct<x:double,y:double>>")


def test_grid_average_of_one_cell(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 30.0, 80.0), (2, 2.0, 2.0, 30.0, 100.0)], POINTS)
    row = points.grid_average(df, 100.0).collect()[0]
    assert (row["dip"], row["dip_dir"], row["n"]) == (29, 90, 2)


def test_order_of_rows_does_not_matter(spark):
    df = spark.range(300).select(F.col("id").alias("fid"), (F.col("id") * 37 % 101).cast("double").alias("easting"), (F.col("id") * 53 % 97).cast("double").alias("northing"), (F.col("id") * 7 % 91).cast("double").alias("dip"), (F.col("id") * 11 % 360).cast("double").alias("dip_dir"))
    for method, more in (("kent", {"size": 25.0}), ("outlier", {"size": 25.0}), ("decimation", {"n": 7}), ("stochastic", {"fraction": 0.2})):
        a, b = (sorted(map(str, points.subsample(method, d, **more).select("easting", "northing", *(["n"] if method in ("kent", "outlier") else [])).collect())) for d in (df, df.repartition(7, "dip")))
        assert a == b, method


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        points.subsample("nothing", spark.range(1))


def test_radical_law():
    assert selection.target_count(1000, 0.1, 1) == 316 and selection.target_count(1000, 0.1, 2) == 100 and selection.target_count(1000, 0.1, 3) == 32
    assert selection.target_count(0, 0.1, 1) == 0 and selection.target_count(3, 0.0001, 3) == 1
    assert selection.ratio_schedule(0.1, 0.1) == [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1] and selection.ratio_schedule(0.3, 0) == [0.3]


def test_lengths_and_filter(spark):
    df = layer(spark, [(i, [(0, 0), (n, 0)]) for i, n in enumerate((1, 5, 0.5, 10))])
    assert {r["fid"] for r in lines.min_length(df, 2.0).collect()} == {1, 3}
    s = lines.length_statistics(df, 2.0).first()
    assert (s["original_count"], s["removed_count"], s["removed_percent"]) == (4, 2, 50.0)


def test_merge_joins_a_chain(spark):
    df = layer(spark, [(0, [(0, 0), (10, 0)]), (1, [(10, 0), (20, 0.5)]), (2, [(30, 1), (20, 0.5)]), (3, [(100, 100), (110, 100)])])
    got = {tuple(sorted(r["members"])): len(r["geom"]) for r in lines.merge_lines(df, 1.0, 30.0, 150.0).collect()}
    assert got == {(0, 1, 2): 4, (3,): 2}


def test_network_contraction_keeps_length(spark):
    df = layer(spark, [(0, [(0, 0), (1, 0), (2, 0)]), (1, [(2, 0), (3, 0)]), (2, [(2, 0), (2, 1), (2, 2)])])
    nodes, edges = network.build(df)
    chains = network.contract(nodes, edges).collect()
    assert sorted(c["segments"] for c in chains) == [1, 2, 2] and math.isclose(sum(c["length"] for c in chains), 5.0)
    assert {r["node_type"]: 1 for r in network.degrees(nodes, edges).collect()}.keys() == {"Z", "Y", "X"}


def test_betweenness_of_a_path(spark):
    nodes, edges = network.build(layer(spark, [(0, [(0, 0), (1, 0), (2, 0)])]))
    got = {r["x"]: r["betweenness"] for r in network.centrality(nodes, edges).collect()}
    assert got == {0.0: 0.0, 1.0: 1.0, 2.0: 0.0}


def test_small_polygons_merge_and_area_stays(spark):
    p = mosaic(spark, [(0, square(0, 0), "a", "x"), (1, square(10, 0), "a", "y"), (2, [(20, 0), (22, 0), (22, 10), (20, 10), (20, 0)], "b", "y"), (3, [(22, 0), (30, 0), (30, 10), (22, 10), (22, 0)], "b", "z")])
    got, reasons = polygons.clean_small(p, 50.0, ["strat1", "lith"])
    rows = {r["fid"]: (r["area"], r["inherit"]) for r in got.collect()}
    assert rows == {0: (100.0, [0]), 1: (100.0, [1]), 3: (100.0, [2, 3])} and reasons.collect()[0]["reason"] == "same_strat1"
    whole = polygons.dissolve(p, got.select(F.explode("inherit").alias("member"), F.col("fid").alias("group")))
    assert sorted(len(r["ring"]) for r in whole.collect()) == [5, 5, 7]


def test_triangles_fill_the_polygon(spark):
    p = mosaic(spark, [(0, square(0, 0), "d", "x"), (1, square(10, 0), "e", "x")])
    got = polygons.triangulate(p, ["d"], "strat1", 1e6).collect()
    assert sum(r["area"] for r in got if r["fid"] == 0) == 100.0 and [r["rec_type"] for r in got if r["fid"] == 1] == ["polygon"]


def test_junctions_survive_simplification(spark):
    p = mosaic(spark, [(0, [(0, 0), (10, 0), (10, 5), (10, 10), (0, 10), (0, 0)], "a", "x"), (1, [(10, 0), (20, 0), (20, 10), (10, 10), (10, 5), (10, 0)], "b", "x")])
    done = simplify.simplify_mosaic(p, 4.0)
    sides = topology.shared_segments(done).where("polygons = 2").collect()
    assert len(sides) == 1 and not topology.invalid_rings(done).collect()


def test_no_pairs_by_nested_loop(spark):
    p = mosaic(spark, [(0, square(0, 0), "a", "x")])
    plan = polygons.adjacency(p)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
