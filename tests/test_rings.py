"""Members and holes through the polygon operators."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import kernels as K
from terrane.operators import polygons, rings, simplify, spatial, topology
from terrane.sources import layers

RINGS = "fid long, member int, ring_no int, ring array<struct<x: double, y: double>>, unit string"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def table(spark, rows):
    return spark.createDataFrame([(f, m, k, [{"x": float(x), "y": float(y)} for x, y in ring], u) for f, m, k, ring, u in rows], RINGS)


def areas(df):
    return {r["fid"]: (round(r["area"], 6), r["members"], r["holes"]) for r in rings.areas(df).collect()}


def nested(spark):
    """A frame with two holes; one holds an island with a lake, the other is the second member of a feature that also lies outside."""
    return table(spark, [(1, 0, 0, box(0, 0, 100, 100), "a"), (1, 0, 1, box(10, 10, 30, 30)[::-1], "a"), (1, 0, 2, box(60, 60, 20, 20), "a"), (2, 0, 0, box(10, 10, 30, 30), "b"), (2, 0, 1, box(20, 20, 10, 10), "b"), (3, 0, 0, box(100, 0, 50, 100), "c"), (3, 1, 0, box(60, 60, 20, 20), "c")])


def test_rings_nest_in_any_order(spark):
    flat = nested(spark).union(table(spark, [(2, 0, 2, box(22, 22, 4, 4), "b"), (2, 0, 3, box(500, 0, 60, 60), "b")])).select("fid", "ring").orderBy(F.rand(3))
    got = {(r["fid"], r["member"], r["ring_no"]): round(abs(K.area2([(p["x"], p["y"]) for p in r["ring"]])) / 2) for r in rings.nested(flat).collect()}
    assert got == {(1, 0, 0): 10000, (1, 0, 1): 900, (1, 0, 2): 400, (2, 0, 0): 3600, (2, 1, 0): 900, (2, 1, 1): 100, (2, 2, 0): 16, (3, 0, 0): 5000, (3, 1, 0): 400}


def test_areas_neighbours_and_points(spark):
    p = nested(spark)
    assert areas(p) == {1: (8700.0, 1, 2), 2: (800.0, 1, 1), 3: (5400.0, 2, 0)}
    assert {(r["fid1"], r["fid2"]): r["shared"] for r in polygons.adjacency(p).collect()} == {(1, 2): 120.0, (1, 3): 180.0}
    points = spark.createDataFrame([(0, 5.0, 5.0), (1, 15.0, 15.0), (2, 25.0, 25.0), (3, 70.0, 70.0), (4, 120.0, 50.0), (5, 170.0, 50.0), (6, 99.0, 70.0)], "pid long, x double, y double")
    assert {(r["pid"], r["fid"]) for r in spatial.points_in_polygons(points, p).collect()} == {(0, 1), (1, 2), (3, 3), (4, 3), (6, 1)}
    centre = {r["fid"]: (round(r["x"], 6), round(r["y"], 6)) for r in rings.centroids(p).collect()}
    assert centre[2] == (25.0, 25.0) and centre[3] == (round((5000 * 125 + 400 * 70) / 5400, 6), round((5000 * 50 + 400 * 70) / 5400, 6))


def test_dissolve_keeps_what_is_left_open(spark):
    p = nested(spark)
    got = polygons.dissolve(p, spark.createDataFrame([(1, 7), (3, 7), (2, 8)], "member long, group long"))
    assert areas(got) == {7: (14100.0, 1, 1), 8: (800.0, 1, 1)}


def test_own_holes_are_gaps_and_others_stay(spark):
    p = nested(spark).where("fid <> 2")
    filled = topology.fill_gaps(p)
    assert areas(filled) == {1: (9600.0, 1, 1), 3: (5400.0, 2, 0)} and {r["unit"] for r in filled.collect()} == {"a", "c"}


def test_overlaps_leave_parts_and_holes(spark):
    p = table(spark, [(1, 0, 0, box(140, 0, 20, 100), "a"), (1, 1, 0, box(20, 20, 10, 10), "a"), (2, 0, 0, box(0, 0, 300, 100), "b"), (3, 0, 0, box(300, 0, 100, 100), "c"), (4, 0, 0, box(21, 21, 5, 5), "d"), (5, 0, 0, box(0, 100, 400, 100), "e")])
    fixed = topology.fix_overlaps(p)
    assert areas(fixed) == {1: (2100.0, 2, 0), 2: (27900.0, 2, 1), 3: (10000.0, 1, 0), 5: (40000.0, 1, 0)}
    done = simplify.simplify_map(p.where("fid <> 4"), 1.0, "unit")["polygons"]
    assert areas(done) == {1: (2100.0, 2, 0), 2: (27900.0, 2, 1), 3: (10000.0, 1, 0), 5: (40000.0, 1, 0)}  # no part is lost


def test_invalid_rings_are_made_anew(spark):
    bow, folded = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], [(20, 0), (30, 0), (30, 10), (25, 10), (25, 15), (25, 10), (20, 10), (20, 0)]
    p = table(spark, [(1, 0, 0, bow, "a"), (2, 0, 0, box(40, 0, 5, 5), "b"), (3, 0, 0, [(0, 0), (1, 1), (0, 0)], "c"), (4, 0, 0, folded, "d"), (5, 0, 0, box(60, 0, 5, 5)[:-1], "e")]).union(table(spark, [(6, 0, 0, [(0, 0), (0, 0)], "f")]).withColumn("ring", F.lit(None).cast(rings.RING)))
    got = topology.repair_rings(p)
    assert areas(got) == {1: (50.0, 2, 0), 2: (25.0, 1, 0), 4: (100.0, 1, 0), 5: (25.0, 1, 0)}
    assert not topology.invalid_rings(got).collect() and {r["fid"]: r["unit"] for r in got.collect()} == {1: "a", 2: "b", 4: "d", 5: "e"}


def test_an_island_and_its_hole_are_thinned_alike(spark):
    wavy = [(50 + (20 + k % 3) * math.cos(k * math.pi / 30), 50 + (20 + k % 3) * math.sin(k * math.pi / 30)) for k in range(60)]
    turned = [*wavy[17:], *wavy[:17]]
    p = table(spark, [(1, 0, 0, box(0, 0, 100, 100), "a"), (1, 0, 1, [*wavy, wavy[0]], "a"), (2, 0, 0, [*turned, turned[0]][::-1], "b")])
    done = simplify.simplify_map(p, 8.0, "unit")["polygons"]
    found = {(r["fid"], r["ring_no"]): {(v["x"], v["y"]) for v in r["ring"]} for r in done.collect()}
    assert found[1, 1] == found[2, 0] and 3 < len(found[2, 0]) < 40 and math.isclose(sum(a for a, _, _ in areas(done).values()), 10_000.0)


def test_members_survive_writing_and_reading(spark, tmp_path):
    members = rings.to_members(nested(spark))
    for kind in ("csv", "geojson"):
        layers.write_layer(members, f"{tmp_path}/{kind}", kind, geom="members", shape="Polygon")
        back = layers.read_layer(spark, f"{tmp_path}/{kind}", kind)
        fid = F.col("fid") if kind == "csv" else F.col("properties")["fid"]
        assert areas(rings.from_members(back.select(fid.cast("long").alias("fid"), "members"))) == {1: (8700.0, 1, 2), 2: (800.0, 1, 1), 3: (5400.0, 2, 0)}


def test_a_large_box_is_dealt_to_few_cells(spark):
    small = spark.range(20_000).select("id", (F.col("id") % 200 * 10.0).alias("x0"), (F.floor(F.col("id") / 200) * 10.0).alias("y0"))
    small = small.select(F.col("id").alias("fid"), "x0", "y0", (F.col("x0") + 9).alias("x1"), (F.col("y0") + 9).alias("y1"))
    whole = spark.createDataFrame([(10**6, 0.0, 0.0, 2000.0, 1000.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    both = small.union(whole)
    dealt = spatial.deal_level(spatial.with_level(both, 9.0), *(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("level"), 9.0)
    assert dealt.where("fid = 1000000").count() <= 4 and dealt.count() <= 4 * 20_001
    pairs = spatial.meeting_boxes(both)
    assert pairs.count() == pairs.distinct().count() == 20_000 and pairs.where("fid2 <> 1000000").count() == 0


def test_shapefiles_come_back_as_they_went(spark, tmp_path):
    members = rings.to_members(nested(spark)).withColumns({"a_long_name_1": F.concat(F.lit("Ärea "), F.col("fid").cast("string")), "a_long_name_2": F.col("fid") / 3, "even": F.col("fid") % 2 == 0, "text": F.repeat(F.lit("é"), 200), "none": F.lit(None).cast("string")})
    layers.write_layer(members.repartition(3), f"{tmp_path}/polygons", "shapefile", geom="members", shape="Polygon")
    back = layers.read_layer(spark, f"{tmp_path}/polygons", "shapefile").select(F.col("properties")["fid"].cast("long").alias("fid"), "parts", "properties").cache()
    assert areas(rings.nested(back.select("fid", F.explode("parts").alias("ring")))) == {1: (8700.0, 1, 2), 2: (800.0, 1, 1), 3: (5400.0, 2, 0)}
    got = {r["fid"]: r["properties"] for r in back.collect()}
    assert got[2]["a_long_nam"] == "Ärea 2" and float(got[2]["a_long_n_1"]) == 2 / 3 and (got[2]["even"], got[3]["even"]) == ("T", "F") and got[2]["text"] == "é" * 127 and got[2]["none"] is None
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 2.5)]), (2, None)], "fid long, geom array<struct<x: double, y: double>>")
    layers.write_layer(lines, f"{tmp_path}/lines", "shapefile")
    held = {r["properties"]["fid"]: r["geom"] for r in layers.read_layer(spark, f"{tmp_path}/lines", "shapefile").collect()}
    assert [(p["x"], p["y"]) for p in held["1"]] == [(0.0, 0.0), (1.0, 2.5)] and not held["2"]
    with pytest.raises(FileExistsError):
        layers.write_layer(lines, f"{tmp_path}/lines", "shapefile")
    assert sorted({p.suffix for p in (tmp_path / "lines").iterdir()}) == [".dbf", ".shp", ".shx"]  # nothing pending is left


def test_simplified_pieces_do_not_cross(spark):
    """A spike of one piece reaches through the gap that thinning would close in its neighbour."""
    deep = [(0, 0), (45, 0), (50, -40), (55, 0), (100, 0)]
    poke = [(0, -60), (49, -50), (50, -30), (51, -50), (100, -60)]
    lens = [(0, 100), (50, 100.5), (100, 100)], [(0, 100), (50, 99.5), (100, 100)]
    rows = [(1, [(float(x), float(y)) for x, y in deep]), (2, [(float(x), float(y)) for x, y in poke]), (3, lens[0]), (4, lens[1])]
    pieces = spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in g]) for f, g in rows], "fid long, points array<struct<x: double, y: double>>")
    poked = pieces.where("fid > 2").union(pieces.where("fid = 1").withColumn("points", F.transform("points", lambda p: F.struct(p["x"].alias("x"), (p["y"] + F.when(p["x"] == 50, -5.0).otherwise(0.0)).alias("y")))))
    assert topology.crossings(pieces, "points").count() == 2  # the spike crosses both flanks of the poke as it is
    done = {r["fid"]: len(r["points"]) for r in simplify.thin_apart(poked, 1e6).collect()}
    assert done[1] == 2 and max(done[3], done[4]) == 3  # the lens does not collapse
    crossed = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 10.0, "y": 0.0}, {"x": 0.0, "y": 10.0}])], "fid long, points array<struct<x: double, y: double>>")
    assert [tuple(r) for r in topology.crossings(crossed, "points").collect()] == [(1, 1)]
