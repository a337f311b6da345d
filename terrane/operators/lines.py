"""Polylines: attributes, filters, and end-to-end merging."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import end_azimuth, length_in, line_length, line_mid_latitude
from terrane.operators.graphs import cut, discard
from terrane.operators.spatial import close_pairs


def add_length(df: DataFrame, name: str = "line_length", unit: str = "meters", geom: str = "geom") -> DataFrame:
    """Length in a unit; in degrees also the centroid's latitude."""
    out = df.withColumn(name, length_in(F.col(geom), unit))
    return out.withColumn("centroid_lat", line_mid_latitude(F.col(geom))) if unit == "degrees" else out


def min_length(df: DataFrame, least: float, column: str | None = None, geom: str = "geom") -> DataFrame:
    """Rows at least so long."""
    return df.where((F.col(column) if column else line_length(F.col(geom))) >= least)


def min_length_parts(df: DataFrame, least: float, parts: str = "parts") -> DataFrame:
    """Of multi-part lines the parts at least so long; rows without any are dropped."""
    return df.withColumn(parts, F.filter(parts, lambda p: line_length(p) >= least)).where(F.size(parts) > 0)


def length_statistics(df: DataFrame, least: float, geom: str = "geom") -> DataFrame:
    """Counts and lengths before and after the filter."""
    n, kept = F.count("*"), F.count_if(F.col("__l") >= least)
    total, kept_total = F.coalesce(F.sum("__l"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("__l") >= least, F.col("__l"))), F.lit(0.0))
    return df.select(line_length(F.col(geom)).alias("__l")).agg(
        n.alias("original_count"), kept.alias("filtered_count"), (n - kept).alias("removed_count"), total.alias("original_length"), kept_total.alias("filtered_length"), F.coalesce(F.try_divide((n - kept) * 100.0, n), F.lit(0.0)).alias("removed_percent")
    )


def add_azimuth(df: DataFrame, name: str = "endpt_az", geom: str = "geom") -> DataFrame:
    """Axial azimuth between the ends."""
    return df.withColumn(name, end_azimuth(F.col(geom)))


def explode_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """One row for each part; attributes are lost."""
    return df.select("fid", F.posexplode(parts).alias("part_no", "geom"))


# ---------------------------------------------------------------- merging
def ends(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Both ends of each line: position, the vertex next to it, and the direction of the terminal step as it is drawn."""
    v = F.col(geom)
    first, second, last, before = F.element_at(v, 1), F.element_at(v, 2), F.element_at(v, -1), F.element_at(v, -2)

    def end(name: str, at: Column, inner: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(name).alias("end"), at["x"].alias("x"), at["y"].alias("y"), inner["x"].alias("ix"), inner["y"].alias("iy"), F.atan2(b["y"] - a["y"], b["x"] - a["x"]).alias("angle"))

    both = F.array(end("start", first, second, first, second), end("end", last, before, before, last))
    return df.where(F.size(v) > 1).select("fid", F.explode(both).alias("e")).select("fid", "e.*")


def angle_difference(a: Column, b: Column) -> Column:
    """Smaller way around, in degrees; may be negative for differences above a full turn."""
    d = F.abs(a - b)
    return F.degrees(F.least(d, 2 * math.pi - d))


def merge_candidates(df: DataFrame, distance: float = 10.0, angle: float = 30.0, join_angle: float = 150.0, geom: str = "geom") -> DataFrame:
    """Pairs of line ends (fid1 < fid2) that may be joined, and their
    score: distance, bend between the lines and bend at the joint, all in units of
    distance. Ends meet through buckets, so no pair of far ends is formed."""
    e = ends(df, geom)
    a = e.select(*(F.col(c).alias(n) for c, n in (("fid", "fid1"), ("end", "end1"), ("x", "xa"), ("y", "ya"), ("ix", "ixa"), ("iy", "iya"), ("angle", "angle1"))))
    b = e.select(*(F.col(c).alias(n) for c, n in (("fid", "fid2"), ("end", "end2"), ("x", "xb"), ("y", "yb"), ("ix", "ixb"), ("iy", "iyb"), ("angle", "angle2"))))
    pairs = close_pairs(a, b, distance).where("fid1 < fid2")
    bend = F.least(angle_difference(F.col("angle1"), F.col("angle2")), angle_difference(F.col("angle1"), F.col("angle2") + math.pi))
    # the joint is the first line's end
    ax, ay, bx, by = F.col("ixa") - F.col("xa"), F.col("iya") - F.col("ya"), F.col("ixb") - F.col("xb"), F.col("iyb") - F.col("yb")
    cosine = F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
    at_joint = F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), F.lit(180.0))
    pairs = pairs.withColumns({"bend": bend, "joint": at_joint}).where((F.col("bend") <= angle) & (F.col("joint") >= join_angle))
    penalty = (180.0 - F.col("joint")) / (180.0 - join_angle) if join_angle < 180 else F.lit(0.0)
    return pairs.select("fid1", "end1", "fid2", "end2", "distance", "bend", "joint", (F.col("distance") + F.col("bend") / angle * distance + penalty * distance).alias("score"))


def join_lines(g1: Column, end1: Column, g2: Column, end2: Column) -> Column:
    """L3: the two lines as one; the second operand's joint vertex is dropped."""
    rest = lambda v: F.slice(v, F.lit(2), F.size(v) - 1)
    return (
        F.when((end1 == "end") & (end2 == "start"), F.concat(g1, rest(g2)))
        .when((end1 == "end") & (end2 == "end"), F.concat(g1, rest(F.reverse(g2))))
        .when((end1 == "start") & (end2 == "start"), F.concat(F.reverse(g1), rest(g2)))
        .otherwise(F.concat(g2, rest(g1)))
    )


#: Pairs that a task walks at once, about; the result does not depend on it.
PAIRS_TOGETHER = 50_000


def _settle_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """One step of a pass over some lines' pairs: own, other, score, both ends, own and other's block and other's last neighbour.

    The sequential pass goes through lines from the last to the first, and each takes its best
    free partner. A line is decided here as soon as nothing that the walk does before it can
    change its choice: none of its own free neighbours comes before it any more, and of its best
    one's free neighbours it comes first. Lines of other blocks count as undecided."""
    near: dict[int, list] = {}
    foreign: dict[int, int] = {}
    for own, other, score, own_end, other_end, inside, last in rows[["own", "other", "score", "own_end", "other_end", "inside", "last"]].itertuples(index=False):
        near.setdefault(own, []).append((score, other, own_end, other_end))
        if not inside:
            foreign[other] = last
    used, empty, out = set(), set(), []
    for own in sorted(near, reverse=True):
        if own in used:
            continue
        free = sorted(c for c in near[own] if c[1] not in used)
        if not free:
            empty.add(own)
            continue
        if any(c[1] > own and c[1] not in empty for c in free):
            continue
        score, other, own_end, other_end = free[0]
        if other in foreign:
            first = foreign[other] == own
        else:
            first = not any(c[1] > own and c[1] not in used and c[1] not in empty for c in near[other])
        if first:
            used |= {own, other}
            out.append((own, own_end, other, other_end))
    return pd.DataFrame(out, columns=["fid1", "end1", "fid2", "end2"])


def _matches(pairs: DataFrame) -> DataFrame:
    """Disjoint pairs of one pass, those of the sequential walk, whatever the size of a component.

    Lines are dealt to blocks by ranges of fid. In each round every block decides what the
    walk would have decided by its pairs alone; pairs of lines that are taken are dropped, until none
    is left. The last line that has a pair is always decided, and a block follows a chain of choices
    through all of its own lines, so rounds are few unless choices go to and fro between blocks."""
    names = ("fid1", "end1", "fid2", "end2")
    both = pairs.select(F.col("fid1").alias("own"), F.col("fid2").alias("other"), "score", F.col("end1").alias("own_end"), F.col("end2").alias("other_end"))
    both = cut(both.union(pairs.select("fid2", "fid1", "score", "end2", "end1")))
    done = None
    while True:
        left = both.count()
        if not left:
            discard(both)
            return done if done is not None else pairs.select(*names).where("false")
        dealt = cut(both.repartitionByRange(max(1, -(-left // PAIRS_TOGETHER)), "own").withColumn("block", F.spark_partition_id()))
        lines_ = dealt.groupBy("own").agg(F.max("other").alias("last"), F.min("block").alias("of"))
        held = dealt.join(lines_.select(F.col("own").alias("other"), "last", "of"), "other").withColumn("inside", F.col("of") == F.col("block"))
        took = cut(held.groupBy("block").applyInPandas(_settle_pairs, "fid1 long, end1 string, fid2 long, end2 string"))
        gone = took.select(F.explode(F.array("fid1", "fid2")).alias("fid"))
        before, both = both, cut(both.join(gone, F.col("own") == F.col("fid"), "left_anti").join(gone, F.col("other") == F.col("fid"), "left_anti"))
        discard(dealt, before)
        if done is None:
            done = took
        else:
            old, done = done, cut(done.union(took))
            discard(old, took)


def merge_lines(df: DataFrame, distance: float = 10.0, angle: float = 30.0, join_angle: float = 150.0, most_passes: int | None = None) -> DataFrame:
    """Lines joined end to end until no pair is left: fid (of the first
    operand), geom, members (fids in it). Attributes are lost, lineage is kept.
    Raises if pairs are left after most_passes (default: no bound)."""
    now = cut(df.select(F.col("fid").cast("long").alias("fid"), "geom", F.array(F.col("fid").cast("long")).alias("members")))
    for turn in itertools.count():
        pairs = cut(merge_candidates(now, distance, angle, join_angle))
        if not pairs.take(1):
            discard(pairs)
            break
        if turn == most_passes:
            raise RuntimeError(f"lines are left to merge after {most_passes} passes")
        chosen = _matches(pairs)
        g1, g2 = now.select(F.col("fid").alias("fid1"), F.col("geom").alias("g1"), F.col("members").alias("m1")), now.select(F.col("fid").alias("fid2"), F.col("geom").alias("g2"), F.col("members").alias("m2"))
        joined = chosen.join(g1, "fid1").join(g2, "fid2").select(F.col("fid1").alias("fid"), join_lines(F.col("g1"), F.col("end1"), F.col("g2"), F.col("end2")).alias("geom"), F.concat("m1", "m2").alias("members"))
        gone = chosen.select(F.explode(F.array("fid1", "fid2")).alias("fid"))
        before, now = now, cut(now.join(gone, "fid", "left_anti").union(joined))
        discard(before, pairs, chosen)
    return now


def rose(df: DataFrame, azimuth_column: str, width: int = 10) -> DataFrame:
    """Counts of axial azimuths by bins of `width` degrees, the last one closed, and the opposite bin's start."""
    bin_ = F.least(F.floor(F.col(azimuth_column) / width), F.lit(180 // width - 1))
    return df.where(F.col(azimuth_column).isNotNull()).groupBy((bin_ * width).alias("bin_start")).agg(F.count("*").alias("n")).withColumn("opposite_start", F.col("bin_start") + 180)
