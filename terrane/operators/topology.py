"""Junctions, shared sides, contacts and repair of noded line work."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import kernels
from terrane.functions.scalar import quantum, ring_area, ring_turn, step_length, steps
from terrane.operators.graphs import cut
from terrane.operators.rings import as_rings, boxes
from terrane.operators.spatial import bucket, cell_size, close_pairs, meeting_boxes, segments, spread

#: Fixed values, equal to those of the map tools whose results are to be matched: words in the name of a column that may hold units.
UNIT_WORDS = ("code", "unit", "lith", "rock", "type", "formation", "strat", "map", "symbol", "abbrev", "short")


def unit_candidates(df: DataFrame, order: str = "fid") -> DataFrame:
    """Column, type, up to five first values, and whether it may hold units:
    text named by a unit word, or with two short values at least. One pass with a
    bounded result for each column."""
    out = None
    for field in df.schema:
        if field.name == order:
            continue
        text = F.col(field.name).cast("string")
        firsts = df.where(text.isNotNull() & (F.trim(text) != "")).groupBy(text.alias("value")).agg(F.min(order).alias("at")).orderBy("at").limit(5)
        one = firsts.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("samples"))
        named = any(w in field.name.lower() for w in UNIT_WORDS)
        short = (F.size("samples") >= 2) & (F.aggregate("samples", F.lit(0), lambda a, s: a + F.length(s)) <= 20 * F.size("samples"))
        is_text = field.dataType.typeName() == "string"
        row = one.select(F.lit(field.name).alias("column"), F.lit(field.dataType.simpleString()).alias("type"), "samples", (F.lit(is_text) & (F.lit(named) | short)).alias("candidate"))
        out = row if out is None else out.union(row)
    return out


def snap_to_grid(df: DataFrame, decimals: int = 7, geom: str = "ring") -> DataFrame:
    """Coordinates rounded half to even, consecutive repeats kept; `changed` marks rows that moved."""
    moved = F.transform(geom, lambda p: F.struct(F.bround(p["x"], decimals).alias("x"), F.bround(p["y"], decimals).alias("y")))
    return df.withColumn("__old", F.col(geom)).withColumn(geom, moved).withColumn("changed", F.col(geom) != F.col("__old")).drop("__old")


def _key(x: Column, y: Column, q: float) -> list[Column]:
    return [quantum(x, q).alias("qx"), quantum(y, q).alias("qy")]


def vertices(df: DataFrame, geom: str = "ring", q: float = 0.1) -> DataFrame:
    """P20: fid, v, x, y and quantised place of every vertex."""
    return spread(df.select("fid", F.posexplode(geom).alias("v", "p"))).select("fid", "v", "p.x", "p.y", *_key(F.col("p.x"), F.col("p.y"), q))


def junctions(df: DataFrame, geom: str = "ring", q: float = 0.1) -> DataFrame:
    """Qx, qy of vertices that have different sets of neighbours in
    different rings or lines. Ends of a coordinate list have one neighbour, and
    of a place that a ring visits again the first visit counts."""
    w = Window.partitionBy("fid").orderBy("v")
    rows = vertices(df, geom, q)
    p = F.struct("qx", "qy")
    rows = rows.withColumn("before", F.lag(p).over(w)).where("before is null or before <> struct(qx, qy)")
    rows = rows.select("fid", "v", "qx", "qy", F.lag(p).over(w).alias("a"), F.lead(p).over(w).alias("b"))
    around = F.array_sort(F.array_distinct(F.filter(F.array("a", "b"), lambda x: x.isNotNull())))
    first = rows.groupBy("fid", "qx", "qy").agg(F.min_by(around, "v").alias("around"))
    return first.groupBy("qx", "qy").agg(F.count_distinct("around").alias("kinds")).where("kinds > 1").select("qx", "qy")


def shared_segments(df: DataFrame) -> DataFrame:
    """seg_key, polygons on it, length."""
    return segments(df).groupBy("seg_key").agg(F.count_distinct("fid").alias("polygons"), F.max("length").alias("length"))


def significance(polygons: DataFrame, faults: DataFrame) -> DataFrame:
    """Number of segments by kind: fault-polygon, polygon-polygon, other."""
    both = segments(polygons).select("seg_key", F.lit(1).alias("p"), F.lit(0).alias("f")).union(segments(faults, "geom").select("seg_key", F.lit(0), F.lit(1)))
    n = both.groupBy("seg_key").agg(F.sum("p").alias("p"), F.sum("f").alias("f")).where("p + f >= 2")
    kind = F.when((F.col("p") > 0) & (F.col("f") > 0), "fault_polygon").when(F.col("p") >= 2, "polygon_polygon").otherwise("other")
    return n.groupBy(kind.alias("kind")).agg(F.count("*").alias("segments"))


def exterior_vertices(df: DataFrame, q: float = 0.1) -> DataFrame:
    """Qx, qy of vertices on sides of one polygon only, and never on shared ones."""
    rows = segments(df)
    ends = rows.select("seg_key", "fid", F.explode(F.array(F.struct(*_key(F.col("x0"), F.col("y0"), q)), F.struct(*_key(F.col("x1"), F.col("y1"), q)))).alias("p")).select("seg_key", "fid", "p.qx", "p.qy")
    uses = rows.groupBy("seg_key").agg(F.count_distinct("fid").alias("n"))
    return ends.join(uses, "seg_key").groupBy("qx", "qy").agg(F.max("n").alias("n")).where("n = 1").select("qx", "qy")


def extent(df: DataFrame, geom: str = "ring") -> DataFrame:
    p = vertices(df, geom)
    return p.agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))


def box_vertices(df: DataFrame, q: float = 0.1) -> DataFrame:
    """Vertices within one quantum of the bounding box."""
    rows = vertices(df).crossJoin(F.broadcast(extent(df)))  # one row
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= q
    return rows.where(near("x", "minx") | near("x", "maxx") | near("y", "miny") | near("y", "maxy")).select("qx", "qy").distinct()


def is_rectangular(df: DataFrame, tolerance: float = 1e-4) -> bool:
    """The hull fills the bounding box. Hulls of tasks' own vertices are merged level by level."""
    points = vertices(df).select("x", "y")

    def hulls(batches):
        own: list = []
        for pdf in batches:
            own = kernels.hull([*own, *zip(pdf["x"], pdf["y"])])
        yield pd.DataFrame(own, columns=["x", "y"])

    for n in (64, 8, 1):  # exchanged, not coalesced, which would draw the scan into few tasks
        points = points.mapInPandas(hulls, "x double, y double").repartition(n)
    ring = kernels.hull([(r["x"], r["y"]) for r in points.mapInPandas(hulls, "x double, y double").collect()])
    b = extent(df).first()
    box = (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])
    return box > 0 and len(ring) > 3 and 1 - abs(kernels.area2(ring)) / 2 / box < tolerance


def boundary_pins(df: DataFrame, mode: str = "hard", q: float = 0.1) -> DataFrame:
    """Places that must stay on the outer boundary: all on the box of a
    rectangular map, else the exterior vertices (mode hard), else none."""
    if is_rectangular(df):
        return box_vertices(df, q)
    return exterior_vertices(df, q) if mode == "hard" else exterior_vertices(df, q).where("false")


def soft_boundary(df: DataFrame, q: float = 0.1) -> DataFrame:
    """Z15, soft: places (qx, qy) on the outer boundary of a map that is not rectangular, junctions
    apart, which simplification is to thin less; those of a rectangular map are pinned instead."""
    exterior = exterior_vertices(df, q).select("qx", "qy").distinct()
    if is_rectangular(df):
        return exterior.where("false")
    return exterior.join(junctions(df, "ring", q).select("qx", "qy"), ["qx", "qy"], "left_anti")


def contacts(df: DataFrame, unit: str) -> DataFrame:
    """For each unordered pair of different units that touch: the first pair
    of polygons, their shared length and vertex count, and the shared vertex nearest to the contact's centre."""
    s = segments(df).join(df.select("fid", F.col(unit).cast("string").alias("unit")).distinct(), "fid").where("unit is not null")
    a = s.select(F.col("fid").alias("f1"), F.col("unit").alias("u1"), "seg_key", "x0", "y0", "x1", "y1", "length")
    b = s.select(F.col("fid").alias("f2"), F.col("unit").alias("u2"), "seg_key")
    rows = spread(a).join(b, "seg_key").where("f1 < f2 and u1 <> u2").withColumns({"code_a": F.least("u1", "u2"), "code_b": F.greatest("u1", "u2")})
    first = rows.groupBy("code_a", "code_b").agg(F.min(F.struct("f1", "f2")).alias("p"))
    own = rows.join(first, ["code_a", "code_b"]).where("p.f1 = f1 and p.f2 = f2")
    middle = own.groupBy("code_a", "code_b", "f1", "f2").agg(
        F.sum("length").alias("length"), F.try_divide(F.sum(F.col("length") * (F.col("x0") + F.col("x1")) / 2), F.sum("length")).alias("cx"), F.try_divide(F.sum(F.col("length") * (F.col("y0") + F.col("y1")) / 2), F.sum("length")).alias("cy")
    )
    ends = own.select("code_a", "code_b", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("code_a", "code_b", "p.x", "p.y").distinct()
    d = F.round((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")), 6)
    best = ends.join(middle, ["code_a", "code_b"]).groupBy("code_a", "code_b").agg(F.count("*").alias("vertices"), F.min(F.struct(d.alias("d"), "x", "y")).alias("b"))
    return middle.join(best, ["code_a", "code_b"]).select("code_a", "code_b", "f1", "f2", "length", "vertices", F.col("b.x").alias("x"), F.col("b.y").alias("y"))


def contact_health(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each contact: preserved, minimal, shape_lost or boundary_diverged."""
    n = after.select("code_a", "code_b", F.col("vertices").alias("n"))
    state = F.when(F.col("n") >= 3, "preserved").when(F.col("n") == 2, "minimal").when(F.col("n") == 1, "shape_lost").otherwise("boundary_diverged")
    return before.select("code_a", "code_b").join(n, ["code_a", "code_b"], "left").withColumn("health", state)


def thin_bodies(df: DataFrame, threshold: float) -> DataFrame:
    """Fid, area, perimeter of polygons whose mean width 2A/P is under half the root of threshold."""
    rows = df.select("fid", ring_area(F.col("ring")).alias("area"), F.aggregate(steps(F.col("ring")), F.lit(0.0), lambda s, e: s + step_length(e)).alias("perimeter"))
    return rows.where(2 * F.col("area") / F.col("perimeter") < 0.5 * math.sqrt(threshold))


def midpoint_snaps(faults: DataFrame, polygons: DataFrame, distance: float = 0.01, decimals: int = 7) -> tuple[DataFrame, DataFrame]:
    """(x, y, mx, my) for fault vertices and for polygon vertices: each
    fault vertex and the polygon vertex nearest within distance meet half way.
    Ties go to the least vertex; a polygon vertex chosen twice follows the last fault vertex."""
    f = vertices(faults, "geom").groupBy(F.col("x").alias("xa"), F.col("y").alias("ya")).agg(F.min(F.struct("fid", "v")).alias("order"))
    p = vertices(polygons).select(F.col("x").alias("xb"), F.col("y").alias("yb")).distinct()
    near = close_pairs(f, p, distance).groupBy("xa", "ya").agg(F.min(F.struct(F.round("distance", 12).alias("d"), "xb", "yb", "order")).alias("b")).select("xa", "ya", "b.xb", "b.yb", "b.order")
    near = near.withColumns({"mx": F.bround((F.col("xa") + F.col("xb")) / 2, decimals), "my": F.bround((F.col("ya") + F.col("yb")) / 2, decimals)})
    of_polygons = near.groupBy("xb", "yb").agg(F.max_by(F.struct("mx", "my"), "order").alias("m"))
    return near.select(F.col("xa").alias("x"), F.col("ya").alias("y"), "mx", "my"), of_polygons.select(F.col("xb").alias("x"), F.col("yb").alias("y"), "m.mx", "m.my")


def apply_snaps(df: DataFrame, snaps: DataFrame, geom: str = "ring", decimals: int = 7) -> DataFrame:
    """Fid and geom with mapped vertices moved and all others rounded."""
    rows = vertices(df, geom).join(snaps, ["x", "y"], "left")
    p = F.struct("v", F.coalesce("mx", F.bround("x", decimals)).alias("x"), F.coalesce("my", F.bround("y", decimals)).alias("y"))
    new = rows.groupBy("fid").agg(F.array_sort(F.collect_list(p)).alias("g")).select("fid", F.transform("g", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias(geom))
    return df.drop(geom).join(new, "fid")


def node_segments(df: DataFrame, cell: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Rings with every vertex of the layer that lies on one of their sides put into it, so that neighbours share sides."""
    s = segments(df).select("fid", "s", "x0", "y0", "x1", "y1", "length")
    cell = cell or cell_size(s.select(F.col("length").alias("size")))
    p = vertices(df).select("x", "y").distinct().withColumns({"bx": bucket(F.col("x"), cell), "by": bucket(F.col("y"), cell)})
    boxes = s.withColumn("bx", F.explode(F.sequence(bucket(F.least("x0", "x1") - tolerance, cell), bucket(F.greatest("x0", "x1") + tolerance, cell)))).withColumn("by", F.explode(F.sequence(bucket(F.least("y0", "y1") - tolerance, cell), bucket(F.greatest("y0", "y1") + tolerance, cell))))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, dx * dx + dy * dy)
    off = F.abs((F.col("x") - F.col("x0")) * dy - (F.col("y") - F.col("y0")) * dx) / F.hypot(dx, dy)
    inner = boxes.join(p, ["bx", "by"]).withColumns({"t": t, "off": off}).where((F.col("t") > 1e-9) & (F.col("t") < 1 - 1e-9) & (F.col("off") <= tolerance)).select("fid", "s", "t", "x", "y")
    corner = vertices(df).select("fid", F.col("v").alias("s"), F.lit(0.0).alias("t"), "x", "y")
    ring = corner.union(inner).groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("s", "t", "x", "y"))).alias("g"))
    return df.drop("ring").join(ring.select("fid", F.transform("g", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring")), "fid")


def gap_rings(df: DataFrame) -> DataFrame:
    """Gap, ring, area and filler (the polygon that shares most of its
    boundary) of each hole of a noded mosaic of polygons or rings; a feature's own hole that nothing fills is one.

    Sides of one polygon only, walked with the polygon on the left, have no
    polygon on their right. Each is followed by the first side counterclockwise
    from it at its end, so each empty face is one cycle of sides, and its signed
    area, a grouped sum, tells holes from the outline. Only holes are put together in tasks."""
    from terrane.operators.graphs import components

    wrong = (ring_turn(F.col("ring")) < 0) == (F.col("ring_no") == 0)  # holes turn the other way
    turned = as_rings(df).withColumn("ring", F.when(wrong, F.reverse("ring")).otherwise(F.col("ring")))
    once = segments(turned).groupBy("seg_key").agg(F.count("*").alias("n"), F.min(F.struct("fid", "x0", "y0", "x1", "y1", "length")).alias("e")).where("n = 1")
    once = cut(once.select(F.xxhash64("seg_key").alias("side"), "seg_key", "e.*"))
    out = once.select(F.col("side").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("to"))
    back = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1"))
    around = F.pmod(F.col("to") - F.col("back"), F.lit(2 * math.pi))
    follows = once.select("side", "x1", "y1", back.alias("back")).join(out, ["x1", "y1"]).groupBy("side").agg(F.min(F.struct(around.alias("d"), "next")).alias("b")).select(F.col("side").alias("a"), F.col("b.next").alias("b"))
    faces = once.join(components(follows).select(F.col("id").alias("side"), F.col("component").alias("gap")), "side")
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    faces = cut(faces.join(faces.groupBy("gap").agg(area.alias("signed")).where("signed < 0").select("gap", (-F.col("signed")).alias("area")), "gap"))

    def stitch(key: tuple[int], own: pd.DataFrame) -> pd.DataFrame:
        points = kernels.chain([((a, b), (c, d)) for a, b, c, d in own[["x0", "y0", "x1", "y1"]].itertuples(index=False)])
        return pd.DataFrame({"gap": [key[0]], "ring": [[{"x": x, "y": y} for x, y in points]]})

    ring = faces.groupBy("gap").applyInPandas(stitch, "gap long, ring array<struct<x: double, y: double>>")
    share = faces.groupBy("gap", "area", "fid").agg(F.sum("length").alias("shared"))
    best = share.groupBy("gap", "area").agg(F.max_by("fid", F.struct(F.round("shared", 6), -F.col("fid"))).alias("filler"))
    return ring.join(best, "gap").select("gap", "ring", "area", "filler")


def fill_gaps(df: DataFrame, least: float = 0.0) -> DataFrame:
    """The mosaic's ring table with each gap larger than least given to the neighbour with
    which it shares most of its boundary. Other features, all other rings and all attributes stay."""
    from terrane.operators.polygons import dissolve

    df = as_rings(df).withColumn("fid", F.col("fid").cast("long"))
    gaps = cut(gap_rings(df).where(F.col("area") > least))
    taken = gaps.select(F.col("filler").alias("fid")).distinct()
    parts = df.join(taken, "fid", "left_semi").select(F.col("fid").alias("group"), "ring").union(gaps.select("filler", "ring"))
    new = dissolve(parts.select(F.col("group").alias("fid"), "ring"), taken.select(F.col("fid").alias("member"), F.col("fid").alias("group")))
    return df.join(taken, "fid", "left_anti").unionByName(with_attributes(new, df))


def with_attributes(rings: DataFrame, df: DataFrame) -> DataFrame:
    """A ring table made anew (fid, member, ring_no, ring), with the other columns that its features have in df."""
    rest = [c for c in df.columns if c not in ("fid", "member", "ring_no", "ring")]
    return rings.join(df.select("fid", *rest).dropDuplicates(["fid"]), "fid").select(*df.columns) if rest else rings.select(*df.columns)


def _meeting_pairs(df: DataFrame, cell: float | None) -> DataFrame:
    """fid1 < fid2 and their rings (arrays, outer rings and holes) of features whose boxes share a place, each
    pair once. Boxes alone are dealt to cells; rings go only to the pairs that are found."""
    held = as_rings(df).select(F.col("fid").cast("long").alias("fid"), "member", "ring_no", "ring")
    pairs = cut(meeting_boxes(boxes(held), cell))
    shapes = held.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "ring_no", "ring"))), lambda s: F.struct(s["ring"].alias("ring"))).alias("rings"))
    a, b = shapes.select(F.col("fid").alias("fid1"), F.col("rings").alias("rings_a")), shapes.select(F.col("fid").alias("fid2"), F.col("rings").alias("rings_b"))
    return pairs.join(a, "fid1").join(b, "fid2")


def _xy(ring) -> list[kernels.Point]:
    return [(p["x"], p["y"]) for p in ring]


def _all(rings) -> list[list[kernels.Point]]:
    """Of an array of structs with a ring each: arrays of arrays of unequal lengths do not reach pandas."""
    return [_xy(r["ring"]) for r in rings]


def overlaps(df: DataFrame, least: float = 1e-6, cell: float | None = None) -> DataFrame:
    """Z3: pairs fid1 < fid2 of polygons of any shape that overlap by more than least, and by how much."""

    def measure(batches):
        for pdf in batches:
            areas = []
            for p, q in zip(pdf["rings_a"], pdf["rings_b"]):
                areas.append(kernels.covered_area(kernels.overlay(_all(p), _all(q), lambda a, b: a and b)))
            yield pd.DataFrame({"fid1": pdf["fid1"], "fid2": pdf["fid2"], "overlap": areas})

    return _meeting_pairs(df, cell).mapInPandas(measure, "fid1 long, fid2 long, overlap double").where(F.col("overlap") > least)


def fix_overlaps(df: DataFrame, least: float = 1e-6, cell: float | None = None) -> DataFrame:
    """Z3: the ring table (fid, member, ring_no, ring) of the layer in which each feature has lost
    what features of lesser fids cover. Taking them away one after the other comes to
    the same, so all is one join. All parts and holes that are left stay; overlaps up to least stay
    too; a feature that is covered whole has no row."""

    pairs = _meeting_pairs(df, cell)
    over = pairs.groupBy("fid2").agg(F.first("rings_b").alias("own"), F.array_sort(F.collect_list(F.struct("fid1", F.col("rings_a").alias("rings")))).alias("others"))

    def subtract(batches):
        for pdf in batches:
            out = []
            for fid, own, others in zip(pdf["fid2"], pdf["own"], pdf["others"]):
                left, changed = _all(own), False
                for other in (_all(o["rings"]) for o in others):
                    if left and kernels.covered_area(kernels.overlay(left, other, lambda a, b: a and b)) > least:
                        left, changed = kernels.overlay(left, other, lambda a, b: a and not b), True
                if changed:
                    out += [(fid, m, k, [{"x": x, "y": y} for x, y in r]) for m, k, r in kernels.nest(left)] or [(fid, 0, 0, None)]
            yield pd.DataFrame(out, columns=["fid", "member", "ring_no", "ring"])

    found = cut(over.mapInPandas(subtract, "fid long, member int, ring_no int, ring array<struct<x: double, y: double>>"))
    rest = as_rings(df).select(F.col("fid").cast("long").alias("fid"), "member", "ring_no", "ring").join(found.select("fid").distinct(), "fid", "left_anti")
    return rest.union(found.where("ring is not null").select("fid", "member", "ring_no", "ring"))


def repair_rings(df: DataFrame) -> DataFrame:
    """The ring table with the rings of features that cross or touch themselves made anew: all of a
    feature's sides are split where they meet, and its inside is what lies in an odd number of
    its rings. Rings that end open are closed; features without a place inside have no row. Attributes stay."""
    df = as_rings(df).withColumn("fid", F.col("fid").cast("long"))
    shapes = df.where("ring is not null").groupBy("fid").agg(F.collect_list(F.struct("ring")).alias("rings"))

    def repair(batches):
        for pdf in batches:
            out = []
            for fid, rings in zip(pdf["fid"], pdf["rings"]):
                own = [r if r[0] == r[-1] else [*r, r[0]] for r in _all(rings) if r]
                if all(len(r) > 3 and kernels.is_simple(r) for r in own) and len(own) == len(rings) and all(r[0] == r[-1] for r in _all(rings)):
                    continue
                left = kernels.nest(kernels.overlay([r for r in own if len(r) > 3], [], lambda a, b: a))
                out += [(fid, m, k, [{"x": x, "y": y} for x, y in r]) for m, k, r in left] or [(fid, 0, 0, None)]
            yield pd.DataFrame(out, columns=["fid", "member", "ring_no", "ring"])

    found = cut(shapes.mapInPandas(repair, "fid long, member int, ring_no int, ring array<struct<x: double, y: double>>"))
    stays = df.where("ring is not null").join(found.select("fid").distinct(), "fid", "left_anti")
    return stays.unionByName(with_attributes(found.where("ring is not null"), df))


def crossings(df: DataFrame, geom: str = "ring") -> DataFrame:
    """(fid1, fid2), fid1 <= fid2, once for each two sides that cross inside both, and for each
    side that two different rows have in common. df: a ring or line in each row, with fids of
    their own. Sides meet through boxes on the level of their size; the test is arithmetic on columns."""
    rows = df.select("fid", F.posexplode(steps(F.col(geom))).alias("s", "e")).select("fid", "s", "e.*").where("x0 <> x1 or y0 <> y1")
    rows = cut(rows.withColumn("id", F.xxhash64("fid", "s")))
    box = rows.select(F.col("id").alias("fid"), F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    a = rows.select(F.col("id").alias("fid1"), F.col("fid").alias("f"), *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    b = rows.select(F.col("id").alias("fid2"), F.col("fid").alias("g"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))

    def side(p: str, q: str, r: str) -> Column:
        """On which side of the line from p0 to p1 a point lies."""
        x, y = F.col(f"{q}x{r}"), F.col(f"{q}y{r}")
        return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (y - F.col(f"{p}y0")) - (F.col(f"{p}y1") - F.col(f"{p}y0")) * (x - F.col(f"{p}x0"))

    apart = lambda p, q: F.signum(side(p, q, "0")) * F.signum(side(p, q, "1")) < 0
    met = meeting_boxes(box).join(a, "fid1").join(b, "fid2").where(apart("a", "b") & apart("b", "a")).select("f", "g")
    twice = segments(df, geom).groupBy("seg_key").agg(F.min("fid").alias("f"), F.max("fid").alias("g")).where("f < g").select("f", "g")
    return met.union(twice).select(F.least("f", "g").alias("fid1"), F.greatest("f", "g").alias("fid2"))


def invalid_rings(df: DataFrame, geom: str = "ring") -> DataFrame:
    """Fid and reason of rings that are missing, too short, or cross themselves."""

    def check(batches):
        for pdf in batches:
            out = []
            for fid, ring in zip(pdf["fid"], pdf[geom]):
                points = [] if ring is None else [(p["x"], p["y"]) for p in ring]
                reason = "missing" if not points else "too short" if len(points) < 4 else "open" if points[0] != points[-1] else None if kernels.is_simple(points) else "crosses itself"
                if reason:
                    out.append((fid, reason))
            yield pd.DataFrame(out, columns=["fid", "reason"])

    return df.select(F.col("fid").cast("long").alias("fid"), geom).mapInPandas(check, "fid long, reason string")
