"""What queries over many lines exchange, and what their rounds leave behind."""

import random

from pyspark.sql import functions as F

from terrane.operators import lines, offsets, spatial

RING = "array<struct<x: double, y: double>>"


def test_close_pairs_are_those_of_all_pairs_in_cells_of_any_width(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)] + [(300, 0.0, 0.0), (301, 3.0, 0.0)]
    want = {(i, j) for i, x, y in rows for j, u, v in rows if (x - u) ** 2 + (y - v) ** 2 <= 9.0}
    a, b = spark.createDataFrame(rows, "i long, xa double, ya double"), spark.createDataFrame(rows, "j long, xb double, yb double")
    dealt = []
    monkeypatch.setattr(spatial, "spread", lambda df: dealt.append(df.count()) or df)
    for compared in (0, 16, 10_000):
        monkeypatch.setattr(spatial, "COMPARED", compared)
        assert {(r["i"], r["j"]) for r in spatial.close_pairs(a, b, 3.0).collect()} == want
    assert dealt[0] > 2500 and dealt[2] < 600


def test_merging_leaves_only_its_result_on_disk(spark):
    shared = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    held = lambda: {str(f.getPath().getName()) for f in shared.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(shared)}
    rows = [(i, [(i * 10.0, 0.0), (i * 10.0 + 10.0, 0.0)]) for i in range(9)]
    before = held() if shared.getFileSystem(spark._jsc.hadoopConfiguration()).exists(shared) else set()
    got = lines.merge_lines(spark.createDataFrame(rows, f"fid long, geom {RING}"), 1.0)
    assert [sorted(r["members"]) for r in got.collect()] == [list(range(9))]
    assert len(held() - before) == 1


def test_units_of_probes_in_features_of_few_and_many_sides(spark):
    """A square with a hole and a round feature; probes outside and in the hole have no units."""
    import math

    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    disc = [(300 + 90 * math.cos(k * math.pi / 30), 90 * math.sin(k * math.pi / 30)) for k in range(60)]
    rows = [(1, box(-100.0, -100.0, 100.0, 100.0), "square"), (1, box(-60.0, -10.0, -40.0, 10.0), "square"), (2, [*disc, disc[0]], "round")]
    polygons = spark.createDataFrame(rows, f"fid long, ring {RING}, unit string")
    faults = spark.createDataFrame([(7, [(-50.0, 0.0), (320.0, 0.0)]), (8, [(0.0, 150.0), (0.0, 90.0)])], f"fid long, geom {RING}")
    probes = offsets.probe_points(faults, 5.0)
    units = polygons.dropDuplicates(["fid"]).select("fid", "unit")
    inside = spatial.points_in_polygons(probes.select(F.struct("fid", "location", "side").alias("pid"), "x", "y"), polygons)
    want = {(r["pid"]["fid"], r["pid"]["location"], r["pid"]["side"], r["unit"]) for r in inside.join(units, "fid").collect()}
    assert want == {(7, "end", "side1", "round"), (7, "end", "side2", "round"), (8, "end", "side1", "square"), (8, "end", "side2", "square")}
    found = offsets.units_inside(probes, polygons.where("ring[0].x <> -60"), ["unit"])
    assert {(r["fid"], r["location"], r["side"], r["unit"]) for r in found.collect()} == want | {(7, "start", s, "square") for s in ("side1", "side2")}
