"""Sides that explode() makes are not broadcast, however small Spark reckons them to be."""

import pytest

from terrane.operators import lines, points, topology

RING = "array<struct<x: double, y: double>>"


def joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def stored(spark, folder, rows, schema):
    """Rows as a table of a file, whose size Spark reckons from the file's."""
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def measured(spark, folder):
    return stored(spark, folder / "points", [(1, 0.0, 1.0, 30.0, 90.0), (2, 50.0, 90.0, 30.0, 0.0)], "fid long, easting double, northing double, dip double, dip_dir double")


def side(spark, folder):
    return stored(spark, folder / "contacts", [(7, 0, 0.0, 0.0, 0.0, 100.0, 0.0)], "fid long, s int, x0 double, y0 double, x1 double, y1 double, azimuth double")


def squares(spark, folder, scale=1.0):
    """Two squares beside each other."""
    ring = lambda i: [(i * scale, 0.0), ((i + 1) * scale, 0.0), ((i + 1) * scale, scale), (i * scale, scale), (i * scale, 0.0)]
    return stored(spark, folder / "squares", [(i, ring(i), f"U{i}") for i in range(2)], f"fid long, ring {RING}, unit string")


def test_merge_candidates(spark, tmp_path):
    rows = [(i, [(i * 10.0, 0.0), (i * 10.0 + 9.0, 0.0)]) for i in range(3)]
    got = lines.merge_candidates(stored(spark, tmp_path / "lines", rows, f"fid long, geom {RING}"), 2.0)
    assert joins(got) == (1, 0) and sorted((r["fid1"], r["end1"], r["fid2"], r["end2"]) for r in got.collect()) == [(0, "end", 1, "start"), (1, "end", 2, "start")]


def test_first_order(spark, tmp_path):
    got = points.first_order(measured(spark, tmp_path), side(spark, tmp_path), 60.0)
    assert joins(got) == (2, 0) and [r["fid"] for r in got.collect()] == [1]


def test_methods(spark, tmp_path):
    got = points.run_methods(measured(spark, tmp_path), {"firstorder": {"buffer": 60.0}}, side(spark, tmp_path))
    assert joins(got)[1] == 0 and [tuple(r) for r in got.collect()] == [("firstorder", 1)]


@pytest.mark.parametrize("scale, q", [(10.0, 0.1), (1e-4, 1e-6)])
def test_exterior_vertices(spark, tmp_path, scale, q):
    got = topology.exterior_vertices(squares(spark, tmp_path, scale), q)
    assert joins(got) == (1, 0) and {tuple(r) for r in got.collect()} == {(x, y) for x in (0, 200) for y in (0, 100)}


def test_contacts(spark, tmp_path):
    got = topology.contacts(squares(spark, tmp_path), "unit")
    assert joins(got)[0] > 0 and [(r["code_a"], r["code_b"], r["length"], r["vertices"]) for r in got.collect()] == [("U0", "U1", 1.0, 2)]
