import math
import random

from pyspark.sql import functions as F

from terrane.operators import offsets, spatial


def test_nearest_segment_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    segments = [(i, 0, *(rng.uniform(-900, 900) for _ in range(4)), 0.0) for i in range(40)] + [(40, 0, 3.0, -800.0, 3.0, 800.0, 0.0), (41, 0, -800.0, 7.0, 800.0, 7.0, 0.0), (42, 0, 5.0, 5.0, 5.0, 5.0, 0.0)]
    points = [(i, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for i in range(300)]

    def distance(p, s):
        dx, dy = s[4] - s[2], s[5] - s[3]
        t = max(0.0, min(1.0, ((p[1] - s[2]) * dx + (p[2] - s[3]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(p[1] - s[2] - t * dx, p[2] - s[3] - t * dy)

    want = {p[0]: min((round(distance(p, s), 9), s[0]) for s in segments) for p in points}
    got = spatial.nearest_segment(spark.createDataFrame(points, "fid long, easting double, northing double"), spark.createDataFrame(segments, "fid long, s int, x0 double, y0 double, x1 double, y1 double, azimuth double"), 60.0)
    assert {r["fid"]: r["seg_fid"] for r in got.collect()} == {f: s for f, (d, s) in want.items() if d <= 60}


def test_probes_of_odd_lines(spark):
    lines = [(1, [(0.0, 0.0), (0.0, 0.0), (10.0, 0.0)]), (2, []), (3, None), (4, [(1.0, 1.0)]), (5, [(2.0, 2.0), (2.0, 2.0)]), (6, [(0.0, 0.0), (None, 1.0)])]
    df = spark.createDataFrame(lines, "fid int, geom array<struct<x: double, y: double>>")
    got = offsets.probe_points(df, 5.0)
    assert got.schema["fid"].dataType.simpleString() == "int"
    assert {(r["fid"], r["location"], r["side"]): (round(r["x"], 6), round(r["y"], 6)) for r in got.collect()} == {(1, at, side): (x, y) for at, x in (("start", 0.0), ("midpoint", 5.0), ("end", 10.0)) for side, y in (("side1", 5.0), ("side2", -5.0))}
    assert offsets.probe_points(df.where(F.lit(False))).count() == 0
