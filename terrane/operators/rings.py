"""Polygons of several members with holes, as a table of rings.

A ring table has a row for each ring: fid, member (from 0), ring_no (0: the member's outer
ring, others its holes), ring (closed), and the feature's attributes, repeated. A layer
of plain polygons (fid, ring) is one whose features have one ring. What is inside a
feature is told by parity over all its rings, so joins need no cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import kernels
from terrane.functions.scalar import ring_area

RING = "array<struct<x: double, y: double>>"
KEY = ("fid", "member", "ring_no")


def as_rings(df: DataFrame) -> DataFrame:
    """df with member and ring_no: 0 where it has no such columns."""
    return df.withColumns({c: F.lit(0) for c in ("member", "ring_no") if c not in df.columns})


def nested(df: DataFrame) -> DataFrame:
    """(fid, member, ring_no, ring) of rings (fid, ring) in any order: a ring inside an even
    number of its feature's others is a member's outer ring, else a hole of the smallest
    such ring around it. Members and holes go by falling area."""
    held = df.groupBy("fid").agg(F.collect_list(F.struct("ring")).alias("rings"))  # structs: arrays of arrays of unequal lengths do not reach pandas

    def nest(batches):
        for pdf in batches:
            out = [(fid, m, k, [{"x": x, "y": y} for x, y in ring]) for fid, rings in zip(pdf["fid"], pdf["rings"]) for m, k, ring in kernels.nest([[(p["x"], p["y"]) for p in r["ring"]] for r in rings])]
            yield pd.DataFrame(out, columns=["fid", "member", "ring_no", "ring"])

    one = held.where(F.size("rings") == 1).select(F.col("fid").cast("long").alias("fid"), F.lit(0).alias("member"), F.lit(0).alias("ring_no"), F.col("rings")[0]["ring"].alias("ring"))
    return one.union(held.where(F.size("rings") > 1).select(F.col("fid").cast("long").alias("fid"), "rings").mapInPandas(nest, f"fid long, member int, ring_no int, ring {RING}"))


def areas(df: DataFrame) -> DataFrame:
    """Fid, area (outer rings less holes), members, holes, perimeter of each feature."""
    from terrane.functions.scalar import line_length

    own = ring_area(F.col("ring"))
    return as_rings(df).groupBy("fid").agg(F.sum(F.when(F.col("ring_no") == 0, own).otherwise(-own)).alias("area"), F.count_if(F.col("ring_no") == 0).alias("members"), F.count_if(F.col("ring_no") > 0).alias("holes"), F.sum(line_length(F.col("ring"))).alias("perimeter"))


def centroids(df: DataFrame) -> DataFrame:
    """Fid, x, y: the centre of gravity, from sums over all rings; the first vertex of features without area."""
    first = F.col("ring")[0]
    x0, y0 = first["x"], first["y"]  # moments about the ring's first vertex, so that large coordinates cancel

    def moments(s, i):
        p, q = F.get("ring", i), F.get("ring", i + 1)
        px, py, qx, qy = p["x"] - x0, p["y"] - y0, q["x"] - x0, q["y"] - y0
        turn = px * qy - qx * py
        return F.struct((s["a"] + turn).alias("a"), (s["x"] + (px + qx) * turn).alias("x"), (s["y"] + (py + qy) * turn).alias("y"))

    zero = F.struct(*(F.lit(0.0).alias(c) for c in "axy"))
    rows = as_rings(df).where(F.size("ring") > 0).withColumn("m", F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("ring") - 2, F.lit(0))), zero, moments))
    sign = F.signum(F.col("m.a")) * F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)  # holes count against, whichever way they turn
    rows = rows.select("fid", "member", "ring_no", (sign * F.col("m.a") / 2).alias("a"), (sign * F.col("m.x") / 6).alias("mx"), (sign * F.col("m.y") / 6).alias("my"), x0.alias("x0"), y0.alias("y0"))
    got = rows.groupBy("fid").agg(F.sum("a").alias("a"), F.sum(F.col("mx") + F.col("a") * F.col("x0")).alias("mx"), F.sum(F.col("my") + F.col("a") * F.col("y0")).alias("my"), F.min_by(F.struct("x0", "y0"), F.struct("member", "ring_no")).alias("p"))
    at = lambda m, p: F.coalesce(F.try_divide(m, F.when(F.col("a") != 0, F.col("a"))), p)
    return got.select("fid", at(F.col("mx"), F.col("p.x0")).alias("x"), at(F.col("my"), F.col("p.y0")).alias("y"))


def boxes(df: DataFrame) -> DataFrame:
    """fid, x0, y0, x1, y1 and sides of each feature."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    own = df.select("fid", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), (F.size("ring") - 1).alias("n"))
    return own.groupBy("fid").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("sides"))


def to_members(df: DataFrame) -> DataFrame:
    """fid and members, an array of members, each an array of its rings, for sinks."""
    one = as_rings(df).groupBy("fid", "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))), lambda s: s["ring"]).alias("rings"))
    return one.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "rings"))), lambda s: s["rings"]).alias("members"))


def from_members(df: DataFrame, column: str = "members") -> DataFrame:
    """The ring table of such an array; other columns of df stay."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("member", "__rings")).select(*rest, "member", F.posexplode("__rings").alias("ring_no", "ring"))


def ring_key(df: DataFrame) -> DataFrame:
    """The table with a key of the ring in fid, for operators that treat rings one by one; the feature's own is in `feature`."""
    return df.withColumn("feature", F.col("fid")).withColumn("fid", F.xxhash64(*(F.col(c).cast("long") for c in KEY)))
