import math
import random

from terrane.functions import kernels as K
from terrane.operators import polygons, topology
from terrane.operators.spatial import segments


def square(x, y, n=10.0):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


def layer(spark, rows):
    return spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in ring]) for f, ring in rows], "fid long, ring array<struct<x:double,y:double>>")


def test_areas_of_overlays_add_up():
    rng = random.Random(2)
    blob = lambda cx, cy: (lambda p: [*p, p[0]])([(cx + rng.uniform(3, 6) * math.cos(t * math.pi / 6), cy + rng.uniform(3, 6) * math.sin(t * math.pi / 6)) for t in range(12)])
    for a, b in [(blob(0, 0), blob(3, 1)) for _ in range(15)] + [(square(0.0, 0.0), square(x, y, n)) for x, y, n in ((5, 5, 10), (10, 0, 10), (2, 2, 3), (0, 0, 10), (0, 0, 5), (5, 0, 10), (30, 0, 1))]:
        area = lambda f: K.covered_area(K.overlay([a], [b], f))  # noqa: B023, E731
        own, other, both = abs(K.area2(a)) / 2, abs(K.area2(b)) / 2, area(lambda p, q: p and q)
        assert math.isclose(area(lambda p, q: p or q), own + other - both, abs_tol=1e-6) and math.isclose(area(lambda p, q: p and not q), own - both, abs_tol=1e-6)


def test_keys_hold_in_degrees(spark):
    p = layer(spark, [(0, square(0.1, 0.1, 0.3)), (1, square(0.5, 0.5, 0.3)), (2, square(0.8, 0.5, 0.25)), (3, [(0.4, 0.1), (0.45, 0.1), (0.45, 0.4), (0.4, 0.4), (0.4, 0.1)])])
    assert [(r["fid1"], r["fid2"], round(r["shared"], 9)) for r in polygons.adjacency(p).collect()] == [(0, 3, 0.3)]
    assert segments(p, q=0.1).where("fid = 0 and s = 0").first()["seg_key"]["ax"] == 1


def test_overlaps_go_to_the_least_fid(spark):
    p = layer(spark, [(0, square(0, 0)), (1, square(5, 5)), (2, square(9, 9)), (3, square(2, 2, 3)), (4, square(20, 0)), (5, square(-1, -1, 30))])
    assert {(r["fid1"], r["fid2"]): round(r["overlap"], 6) for r in topology.overlaps(p).where("fid2 < 5").collect()} == {(0, 1): 25.0, (0, 2): 1.0, (0, 3): 9.0, (1, 2): 36.0}
    got: dict[int, list] = {}
    for r in topology.fix_overlaps(p).collect():
        got.setdefault(r["fid"], []).append([(v["x"], v["y"]) for v in r["ring"]])
    area = {f: round(K.covered_area(rings), 6) for f, rings in got.items()}
    assert area == {0: 100.0, 1: 75.0, 2: 64.0, 4: 100.0, 5: 900.0 - 329.0}


def test_gaps_that_touch_are_apart_and_get_filled(spark):
    cells = [(i * 4 + j, square(10 * i, 10 * j)) for i in range(4) for j in range(4)]
    holed = layer(spark, [c for c in cells if c[0] not in (5, 10)])
    gaps = topology.gap_rings(holed).collect()
    assert sorted((g["area"], g["filler"]) for g in gaps) == [(100.0, 1), (100.0, 6)] and all(len(g["ring"]) == 5 for g in gaps)
    filled = topology.fill_gaps(holed)
    assert {r["fid"]: abs(K.area2([(v["x"], v["y"]) for v in r["ring"]])) / 2 for r in filled.collect() if r["fid"] in (1, 6, 2)} == {1: 200.0, 6: 200.0, 2: 100.0}
    assert filled.count() == 14 and topology.gap_rings(filled).count() == 0


def test_holes_take_triangles(spark):
    p = spark.createDataFrame([(0, [{"x": x, "y": y} for x, y in square(0.0, 0.0)], "d")], "fid long, ring array<struct<x:double,y:double>>, kind string")
    hole = layer(spark, [(0, [(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)])])
    assert polygons.triangulate(p, ["d"], "kind", 1e9).count() == 2 and polygons.triangulate(p, ["d"], "kind", 1e9, hole).count() == 0
