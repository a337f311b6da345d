"""Spatial joins as equi-joins on grid buckets.

Each side of a join is dealt to square buckets; the exact predicate follows as a
residual. A bucket that holds very many rows is spread by AQE's skew handling,
as only plain joins and grouped minima are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import azimuth, quantum, steps


def bucket(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def spread(df: DataFrame) -> DataFrame:
    """df as a side that no join broadcasts. Spark reckons what explode makes as large as what it was made
    from, and a table as large as its compressed file, so it would broadcast sides that no driver holds."""
    return df.hint("merge")


def explode_buckets(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """df with a row, bx and by for each bucket that the box touches."""
    df = df.withColumn("bx", F.explode(F.sequence(bucket(x0, size), bucket(x1, size))))
    return df.withColumn("by", F.explode(F.sequence(bucket(y0, size), bucket(y1, size))))


def segment_azimuths(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """Fid, s, ends and axial azimuth of every segment that has a length."""
    rows = layer.select("fid", F.posexplode(steps(F.col(geom))).alias("s", "e")).select("fid", "s", "e.*")
    return rows.withColumn("azimuth", azimuth(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("azimuth is not null")


def cell_size(sizes: DataFrame) -> float:
    """Side of buckets for things of these sizes (column size): twice their mean, so that most are in a few buckets."""
    mean = sizes.agg(F.avg("size")).first()[0]
    return 2 * mean if mean else 1.0


def segments(layer: DataFrame, ring: str = "ring", q: float | None = None) -> DataFrame:
    """Fid, s, ends, length and seg_key of every side. The key, the two ends
    (ax, ay, bx, by) in order, reads the same from both sides. It is exact, so it
    holds in metres and degrees alike; with q, ends are counted in steps of q."""
    rows = layer.select("fid", F.posexplode(steps(F.col(ring))).alias("s", "e")).select("fid", "s", "e.*")
    at = (lambda c: F.col(c) + F.lit(0.0)) if q is None else (lambda c: quantum(F.col(c), q))  # no negative zero
    x0, y0, x1, y1 = (at(c) for c in ("x0", "y0", "x1", "y1"))
    first, last = F.struct(x0.alias("x"), y0.alias("y")), F.struct(x1.alias("x"), y1.alias("y"))
    low, high = F.least(first, last), F.greatest(first, last)
    key = F.struct(low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"))
    return spread(rows).withColumn("seg_key", key).withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def distance_to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def _along_buckets(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, radius: float) -> DataFrame:
    """df with a row, bx and by for each bucket of side radius that may hold a point
    within radius of the segment: in each column of buckets only those beside the
    part of the segment within radius of that column, so rows grow with length, not with its square."""
    margin = radius * (1 + 1e-6)  # the exact distance is tested later
    df = df.withColumn("bx", F.explode(F.sequence(bucket(F.least(x0, x1) - margin, radius), bucket(F.greatest(x0, x1) + margin, radius))))
    left, right = F.col("bx") * radius - margin, (F.col("bx") + 1) * radius + margin
    inside = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    share = lambda at, flat: inside(F.coalesce(F.try_divide(at - x0, x1 - x0), F.lit(flat)))
    ya, yb = (y0 + share(at, flat) * (y1 - y0) for at, flat in ((left, 0.0), (right, 1.0)))
    return df.withColumn("by", F.explode(F.sequence(bucket(F.least(ya, yb) - margin, radius), bucket(F.greatest(ya, yb) + margin, radius))))


def nearest_segment(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Points with the distance and azimuth of the nearest segment within
    radius; ties go to the least (segment fid, s). Points without one are dropped."""
    left = points.withColumns({"bx": bucket(F.col("easting"), radius), "by": bucket(F.col("northing"), radius)})
    x = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    right = spread(_along_buckets(segments.withColumnRenamed("fid", "seg_fid"), *x, radius))
    near = left.select("fid", "easting", "northing", "bx", "by").join(right, ["bx", "by"]).withColumn("distance", distance_to_segment(F.col("easting"), F.col("northing"), *x)).where(F.col("distance") <= radius)
    best = near.groupBy("fid").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "seg_fid", "s", "distance", "azimuth")).alias("b")).select("fid", "b.distance", "b.seg_fid", "b.azimuth")
    return spread(points).join(best, "fid")


def base_size(boxes: DataFrame) -> float:
    """Side of the cells of level 0: the median extent of boxes (x0, y0, x1, y1), so that one large thing does not change it."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return boxes.where(size > 0).agg(F.percentile_approx(size, 0.5)).first()[0] or 1.0


def point_cell(boxes: DataFrame) -> float:
    """Side of the cells in which points meet boxes: the largest extent, if that is under twice the
    median, so that points look up one level only, else the median."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    most, middle = boxes.where(size > 0).agg(F.max(size), F.percentile_approx(size, 0.5)).first()
    return (most if most and most < 2 * middle else middle) or 1.0


def with_level(boxes: DataFrame, base: float) -> DataFrame:
    """boxes (x0, y0, x1, y1) with level: cells of side base * 2^level are the first that are as large as the box."""
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(base)) / base)).cast("int")))


def levels_of(dealt: DataFrame) -> list[int]:
    """The levels that any box is on: some sixty at most, as sizes are doubles over their median."""
    return sorted(r["level"] for r in dealt.select("level").distinct().collect())


def deal_level(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, level: Column, base: float) -> DataFrame:
    """df with a row, bx and by for each cell of the level that the box touches: four at most for boxes of the level or below."""
    size = F.lit(base) * F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(v / size).cast("bigint")
    df = df.withColumn("bx", F.explode(F.sequence(at(x0), at(x1))))
    return df.withColumn("by", F.explode(F.sequence(at(y0), at(y1))))


def meeting_boxes(boxes: DataFrame, base: float | None = None) -> DataFrame:
    """(fid1, fid2), fid1 < fid2, of boxes (fid, x0, y0, x1, y1) that share a place, each pair once.

    Each box is on the level of its size and looks up those of its level and above,
    so neither a large thing nor a small one is dealt to many cells."""
    x = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    base = base or base_size(boxes)
    own = with_level(boxes.select("fid", "x0", "y0", "x1", "y1"), base)
    known = levels_of(own)
    held = deal_level(own, *x, F.col("level"), base).select(*(F.col(c).alias(f"{c}_b") for c in ("fid", "x0", "y0", "x1", "y1", "level")), F.col("level").alias("at"), "bx", "by")
    asked = own.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, known)) if known else F.array().cast("array<int>"), lambda k: k >= F.col("level"))))
    asked = spread(deal_level(asked, *x, F.col("at"), base))
    first = (F.col("level") < F.col("level_b")) | (F.col("fid") < F.col("fid_b"))
    met = (F.col("x0") < F.col("x1_b")) & (F.col("x0_b") < F.col("x1")) & (F.col("y0") < F.col("y1_b")) & (F.col("y0_b") < F.col("y1"))
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("at"))
    # each pair in one cell: that of the lower left corner of what the boxes share
    one = (F.col("bx") == F.floor(F.greatest("x0", "x0_b") / size)) & (F.col("by") == F.floor(F.greatest("y0", "y0_b") / size))
    pairs = asked.join(held, ["at", "bx", "by"]).where((F.col("fid") != F.col("fid_b")) & first & met & one)
    return pairs.select(F.least("fid", "fid_b").alias("fid1"), F.greatest("fid", "fid_b").alias("fid2"))


#: Sides of a polygon that a stripe of it holds, about.
SIDES_TOGETHER = 8


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float | None = None, ring: str = "ring") -> DataFrame:
    """(pid, fid) of each point (pid, x, y) strictly inside a feature (rows fid and ring, any
    number for a feature: members and holes): parity of the sides that a ray to the right crosses.

    Points look boxes up on each level that holds any. Each feature is cut into
    horizontal stripes of a few sides each, so a point inside a box meets the sides
    of its own stripe only, however many the feature has. One of so few sides in all meets them in its box."""
    from terrane.operators.rings import boxes

    held = polygons.select("fid", F.col(ring).alias("ring"))
    box = boxes(held)
    base = cell or point_cell(box)
    stripe = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-300)) / F.greatest(F.ceil(F.col("sides") / SIDES_TOGETHER), F.lit(1))
    own = with_level(box, base).withColumn("stripe", stripe)
    known = levels_of(own)
    px, py = F.col("px"), F.col("py")
    # a ray to the right crosses the side
    hit = lambda x0, y0, x1, y1: ((y0 > py) != (y1 > py)) & (px < x0 + F.try_divide((py - y0) * (x1 - x0), y1 - y0))
    # features of a few sides in all take them along to the cells
    few = held.select("fid", steps(F.col("ring")).alias("e")).groupBy("fid").agg(F.sum(F.size("e")).alias("n"), F.flatten(F.collect_list(F.when(F.size("e") <= SIDES_TOGETHER, F.col("e")))).alias("own"))
    own = spread(own).join(few.select("fid", F.when(F.col("n") <= SIDES_TOGETHER, F.col("own")).alias("own")), "fid", "left")
    dealt = deal_level(own, *(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("level"), base)
    asked = points.select("pid", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("level", F.explode(F.array(*map(F.lit, known)) if known else F.array().cast("array<int>")))
    size = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    asked = asked.withColumns({"bx": F.floor(px / size).cast("bigint"), "by": F.floor(py / size).cast("bigint")})
    boxed = spread(asked).join(dealt, ["level", "bx", "by"]).where((px >= F.col("x0")) & (px <= F.col("x1")) & (py >= F.col("y0")) & (py <= F.col("y1")))
    at_once = boxed.where(F.col("own").isNotNull()).where(F.size(F.filter("own", lambda e: hit(e["x0"], e["y0"], e["x1"], e["y1"]))) % 2 == 1).select("pid", "fid")
    near = boxed.where(F.col("own").isNull()).select("pid", "px", "py", "fid", F.floor((py - F.col("y0")) / F.col("stripe")).cast("bigint").alias("part"))
    sides = spread(held.select("fid", F.explode(steps(F.col("ring"))).alias("e"))).select("fid", "e.*").where("y0 <> y1").join(own.where("own is null").select("fid", F.col("y0").alias("bottom"), "stripe"), "fid")
    at = lambda y: F.floor((y - F.col("bottom")) / F.col("stripe")).cast("bigint")
    sides = sides.withColumn("part", F.explode(F.sequence(at(F.least("y0", "y1")), at(F.greatest("y0", "y1"))))).drop("bottom", "stripe")
    hits = spread(near).join(sides, ["fid", "part"]).where(hit(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).groupBy("pid", "fid").agg(F.count("*").alias("n"))
    return at_once.union(hits.where("n % 2 = 1").select("pid", "fid"))


#: Rows of b that a row of a may be compared with, about, when close_pairs takes cells wider than the radius.
COMPARED = 16


def close_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of a (id_a, xa, ya) and b (id_b, xb, yb) within radius of each other. Rows of b go to each cell
    within radius; where they are sparse cells are wider than the radius, so that few rows go to several."""
    n, wide, high = b.agg(F.count("*"), F.max("xb") - F.min("xb"), F.max("yb") - F.min("yb")).first()
    dense = n * radius * radius / max((wide or 0.0) * (high or 0.0), radius * radius)
    cell = next((k for k in (8, 4, 2) if (k + 2) ** 2 * dense <= COMPARED), 1) * radius
    margin = radius * (1 + 1e-6)  # the exact distance is tested later
    reach = lambda c: F.explode(F.sequence(bucket(F.col(c) - margin, cell), bucket(F.col(c) + margin, cell)))
    near = spread(b.withColumn("bx", reach("xb")).withColumn("by", reach("yb")))
    own = a.withColumns({"bx": bucket(F.col("xa"), cell), "by": bucket(F.col("ya"), cell)})
    return own.join(near, ["bx", "by"]).drop("bx", "by").withColumn("distance", F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))).where(F.col("distance") <= radius)
