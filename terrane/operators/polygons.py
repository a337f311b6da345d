"""Polygon mosaics: adjacency, merging of small polygons with lineage, dissolve, dykes.

Polygons are (fid, ring, attributes), ring a closed vertex array, or ring tables (see
rings.py) where features have members and holes. Mosaics are noded: neighbours share sides."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terrane.functions import kernels
from terrane.functions.scalar import ring_area
from terrane.operators import rings as R
from terrane.operators.graphs import cut
from terrane.operators.points import hash_order
from terrane.operators.ranks import kth
from terrane.operators.selection import order_statistic, ratio_schedule, target_count
from terrane.operators.spatial import segments

STRATA = ("strat1", "strat2", "strat3", "strat4")


def with_area(df: DataFrame, ring: str = "ring") -> DataFrame:
    """G4."""
    return df.withColumn("area", ring_area(F.col(ring)))


def without_small_holes(rings: DataFrame, least: float) -> DataFrame:
    """Ring rows (fid, ring_no, ring) less the inner ones smaller than least."""
    return rings.where((F.col("ring_no") == 0) | (ring_area(F.col("ring")) >= least))


def large(df: DataFrame, least: float) -> DataFrame:
    """Polygons at least so large; those without area never."""
    return df.where((ring_area(F.col("ring")) > 0) & (ring_area(F.col("ring")) >= least))


def adjacency(df: DataFrame) -> DataFrame:
    """G1, M3: pairs fid1 < fid2 that share sides of any of their rings, with the shared length."""
    s = segments(df).select("fid", "seg_key", "length")
    return s.select(F.col("fid").alias("fid1"), "seg_key", "length").join(s.select(F.col("fid").alias("fid2"), "seg_key"), "seg_key").where("fid1 < fid2").groupBy("fid1", "fid2").agg(F.sum("length").alias("shared"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("fid1").alias("fid"), F.col("fid2").alias("nbr"), "shared").union(pairs.select(F.col("fid2").alias("fid"), F.col("fid1").alias("nbr"), "shared"))


def _tier(columns: list[str]) -> tuple[Column, Column]:
    """Rank of the first column that both sides share (null equals nothing), and its name."""
    rank, reason = F.lit(len(columns)), F.lit("fallback_boundary_length")
    for i, c in reversed(list(enumerate(columns))):
        same = F.col(c).cast("string") == F.col(f"n_{c}").cast("string")
        rank, reason = F.when(same, i).otherwise(rank), F.when(same, f"same_{c}").otherwise(reason)
    return rank, reason


def merge_targets(small: DataFrame, nodes: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """M2, T5: for each of small (fid) the neighbour of the first matching tier
    (columns in order, then any), there the longest shared boundary, then the
    least fid: fid, target, shared, reason."""
    near = both_ways(pairs).join(small.select("fid"), "fid", "left_semi")
    own = nodes.select("fid", *columns)
    other = nodes.select(F.col("fid").alias("nbr"), *(F.col(c).alias(f"n_{c}") for c in columns))
    rank, reason = _tier(columns)
    rows = near.join(own, "fid").join(other, "nbr").select("fid", "nbr", "shared", rank.alias("tier"), reason.alias("reason"))
    best = rows.groupBy("fid").agg(F.min(F.struct("tier", (-F.round("shared", 6)).alias("s"), "nbr", "shared", "reason")).alias("b"))
    return best.select("fid", F.col("b.nbr").alias("target"), F.col("b.shared").alias("shared"), F.col("b.reason").alias("reason"))


def settle(chosen: DataFrame) -> DataFrame:
    """The merges of one round, those of a sequential walk: fid, target, reason.

    The walk takes targets in the order of the least polygon that chose them, and a target takes
    all its choosers unless it has itself gone before. So a target stands if and only if its own
    choice does not stand or comes later: along the chain of ever earlier choices every second
    one stands. Chains are followed by doubling, so rounds grow with the logarithm of the
    longest, and neither a star nor a chain meets in one task."""
    chosen = cut(chosen.select("fid", "target", "reason"))
    order = chosen.groupBy("target").agg(F.min("fid").alias("turn"))
    own = order.join(chosen.select(F.col("fid").alias("target"), F.col("target").alias("next")), "target", "left")
    later = order.select(F.col("target").alias("next"), F.col("turn").alias("next_turn"))
    chain = own.join(later, "next", "left").select("target", F.when(F.col("next_turn") < F.col("turn"), F.col("next")).alias("next"))
    chain = cut(chain.withColumn("odd", F.col("next").isNotNull()))
    while chain.where("next is not null").take(1):
        ahead = chain.select(F.col("target").alias("next"), F.col("next").alias("after"), F.col("odd").alias("more"))
        chain = cut(chain.join(ahead, "next", "left").select("target", F.col("after").alias("next"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd")))
    return chosen.join(chain.where("not odd").select("target"), "target", "left_semi").select("fid", "target", "reason")


def _nodes(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each feature of polygons or rings: area, moments of its centroid, box, and the columns."""
    got = R.areas(df).select("fid", "area").join(R.centroids(df), "fid").join(R.boxes(df).drop("sides"), "fid")
    got = got.select(F.col("fid").cast("long").alias("fid"), "area", (F.col("area") * F.col("x")).alias("mx"), (F.col("area") * F.col("y")).alias("my"), "x0", "y0", "x1", "y1")
    return cut(got.join(df.select(F.col("fid").cast("long").alias("fid"), *columns).dropDuplicates(["fid"]), "fid"))


def _merge(nodes: DataFrame, pairs: DataFrame, labels: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, pairs and labels after merges: areas, moments, boxes and shared lengths combine, the target's attributes stay, no geometry is touched."""
    to = done.select(F.col("fid"), "target")
    sums, lows, highs = ("area", "mx", "my"), ("x0", "y0"), ("x1", "y1")
    moved = nodes.join(to, "fid").groupBy(F.col("target").alias("fid")).agg(*(F.sum(c).alias(f"__{c}") for c in sums), *(F.min(c).alias(f"__{c}") for c in lows), *(F.max(c).alias(f"__{c}") for c in highs))
    new = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0.0)) for c in sums} | {c: F.least(c, f"__{c}") for c in lows} | {c: F.greatest(c, f"__{c}") for c in highs}
    nodes = cut(nodes.join(to, "fid", "left_anti").join(moved, "fid", "left").withColumns(new).select(*nodes.columns))
    one, two = to.select(F.col("fid").alias("fid1"), F.col("target").alias("t1")), to.select(F.col("fid").alias("fid2"), F.col("target").alias("t2"))
    ends = pairs.join(one, "fid1", "left").join(two, "fid2", "left").select(F.coalesce("t1", "fid1").alias("a"), F.coalesce("t2", "fid2").alias("b"), "shared").where("a <> b")
    pairs = cut(ends.groupBy(F.least("a", "b").alias("fid1"), F.greatest("a", "b").alias("fid2")).agg(F.sum("shared").alias("shared")))
    labels = cut(labels.join(to.select(F.col("fid").alias("group"), "target"), "group", "left").select("fid", F.coalesce("target", "group").alias("group")))
    return nodes, pairs, labels


def _labels(df: DataFrame) -> DataFrame:
    fid = F.col("fid").cast("long")
    return cut(df.select(fid.alias("fid"), fid.alias("group")).distinct())


def clean_small(df: DataFrame, threshold: float, columns: list[str], most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M1, M4, M6: polygons (or the features of a ring table) under threshold merge into their best neighbour, round
    after round. Gives (fid, area, columns, inherit: all fids inside, in order)
    and the number of merges for each reason; those that stay under threshold, as they have no neighbour,
    count as `orphan`. Rounds work on the adjacency graph; dissolve() makes the geometry once, at the end."""
    nodes, pairs, labels, reasons = _nodes(df, columns), cut(adjacency(df)), _labels(df), None
    for turn in itertools.count():
        chosen = cut(merge_targets(nodes.where(F.col("area") < threshold), nodes, pairs, columns))
        if not chosen.take(1):
            break
        if turn == most_rounds:
            raise RuntimeError(f"polygons are left to merge after {most_rounds} rounds")
        done = cut(settle(chosen))
        reasons = done.select("reason") if reasons is None else reasons.union(done.select("reason"))
        nodes, pairs, labels = _merge(nodes, pairs, labels, done)
    lineage = labels.groupBy("group").agg(F.array_sort(F.collect_list("fid")).alias("inherit")).withColumnRenamed("group", "fid")
    orphans = nodes.where(F.col("area") < threshold).select(F.lit("orphan").alias("reason"))
    counts = (orphans if reasons is None else reasons.union(orphans)).groupBy("reason").agg(F.count("*").alias("n"))
    return nodes.select("fid", "area", *columns).join(lineage, "fid"), counts


def _by_centroid(nodes: DataFrame, small: Row) -> DataFrame:
    """For a feature without neighbours the one of nearest centroid among those whose boxes meet its own: fid, target, shared, reason; none if none does."""
    own = small.asDict()
    near = (F.col("x0") <= own["x1"]) & (F.col("x1") >= own["x0"]) & (F.col("y0") <= own["y1"]) & (F.col("y1") >= own["y0"])
    dx, dy = (F.try_divide(F.col(f"m{c}"), F.col("area")) - own[f"m{c}"] / (own["area"] or 1.0) for c in "xy")
    best = nodes.where(near & (F.col("fid") != own["fid"])).agg(F.min(F.struct(F.round(F.hypot(dx, dy), 6).alias("d"), "fid")).alias("b")).where("b is not null")
    return best.select(F.lit(own["fid"]).cast("long").alias("fid"), F.col("b.fid").alias("target"), F.lit(0.0).alias("shared"), F.lit("nearest_centroid").alias("reason"))


def merge_to_count(df: DataFrame, target: int, columns: list[str]) -> DataFrame:
    """The smallest polygon (ties: least fid) merges into its best neighbour, one after the other, until
    `target` are left: fid, area, columns, inherit. One without neighbours goes to the nearest centroid
    among those whose boxes meet its own, and without any such it is dropped.

    Rounds take all merges at once that a walk one by one would make just so: a polygon is the smallest
    among all within two steps, so nothing that goes before it changes its neighbours or their
    attributes; it is among the `excess` smallest, so the walk reaches it; and none without neighbours is
    smaller. The smallest of all always is such a one."""
    nodes, pairs, labels = _nodes(df, columns), cut(adjacency(df)), _labels(df)
    key = F.struct("area", "fid")
    while True:
        excess = nodes.count() - target
        if excess <= 0:
            break
        linked = both_ways(pairs).select("fid").distinct().withColumn("linked", F.lit(True))
        held = cut(nodes.join(linked, "fid", "left").select("fid", "area", F.coalesce("linked", F.lit(False)).alias("linked")))
        least = held.agg(F.min(key).alias("all"), F.min(F.when(~F.col("linked"), key)).alias("alone")).first()
        if least["alone"] is not None and least["alone"] == least["all"]:
            done = cut(_by_centroid(nodes, nodes.where(F.col("fid") == least["all"]["fid"]).first()))
            if not done.take(1):  # nothing near: it goes, and its members with it
                nodes, labels = cut(nodes.where(F.col("fid") != least["all"]["fid"])), cut(labels.where(F.col("group") != least["all"]["fid"]))
                continue
        else:
            bound = kth(held, excess, "area", "fid")
            small = held.where(F.col("linked"))
            for limit in (bound, least["alone"]):
                if limit is not None:
                    small = small.where(key < F.struct(F.lit(limit["area"]).alias("area"), F.lit(limit["fid"]).alias("fid")))
            small = cut(small.select("fid", key.alias("k")))
            # the least key of each polygon's neighbours, and of theirs; those that are not small cannot be it
            around = both_ways(pairs).select("fid", "nbr")
            near = around.join(small.select(F.col("fid").alias("nbr"), "k"), "nbr").select("fid", "k").union(small).groupBy("fid").agg(F.min("k").alias("k"))
            further = around.join(near.select(F.col("fid").alias("nbr"), "k"), "nbr").select("fid", "k").union(near).groupBy("fid").agg(F.min("k").alias("k2"))
            ready = small.join(further, "fid").where(F.col("k") == F.col("k2")).select("fid")
            done = cut(merge_targets(ready, nodes, pairs, columns))
        nodes, pairs, labels = _merge(nodes, pairs, labels, done)
    lineage = labels.groupBy("group").agg(F.array_sort(F.collect_list("fid")).alias("inherit")).withColumnRenamed("group", "fid")
    return nodes.select("fid", "area", *columns).join(lineage, "fid")


def scale_polygons(df: DataFrame, ratio: float, columns: list[str]) -> DataFrame:
    """About round(N * ratio^1.5) polygons: first all under the area at that place of the order, then to the count."""
    area = R.areas(df).select("fid", "area")
    n = area.count()
    keep = target_count(n, ratio, 3)
    if keep >= n:
        return area.join(df.select("fid", *columns).dropDuplicates(["fid"]), "fid").select("fid", "area", *columns, F.array("fid").alias("inherit"))
    threshold = order_statistic(area, "area", min(n - keep, n - 1)) * (1 + 1e-9) + 1e-6
    cleaned, _ = clean_small(df, threshold, columns)
    cleaned = cut(cleaned)
    if cleaned.count() <= keep:
        return cleaned
    geom = dissolve(df, cleaned.select(F.explode("inherit").alias("member"), F.col("fid").alias("group")))
    merged = merge_to_count(cut(geom.join(cleaned.select("fid", *columns), "fid")), keep, columns)
    # the members of what was merged, by their own fids
    inside = merged.select("fid", F.explode("inherit").alias("part")).join(cleaned.select(F.col("fid").alias("part"), "inherit"), "part")
    return merged.drop("inherit").join(inside.groupBy("fid").agg(F.array_sort(F.flatten(F.collect_list("inherit"))).alias("inherit")), "fid")


def _shaped(df: DataFrame, merged: DataFrame) -> DataFrame:
    """The ring table of merged features (fid, area, columns, inherit) from the rings of df that they are made of."""
    geom = dissolve(df, merged.select(F.explode("inherit").alias("member"), F.col("fid").alias("group")))
    return geom.join(merged, "fid")


def multi_scale_polygons(df: DataFrame, ratio: float, increment: float, columns: list[str]) -> dict[float, DataFrame]:
    """T8 for polygons: each step scales the one before by the ratio between them. Ring tables with
    area, the columns and inherit, the original fids inside; 1.0 is the layer itself."""
    fid = F.col("fid").cast("long")
    now = cut(R.as_rings(df).select(fid.alias("fid"), "member", "ring_no", "ring", *columns).join(R.areas(df).select("fid", "area"), "fid").withColumn("inherit", F.array("fid")))
    out, last = {1.0: now}, 1.0
    for step in ratio_schedule(ratio, increment):
        plain = now.drop("area", "inherit")
        merged = cut(scale_polygons(plain, step / last, columns))
        parts = merged.select("fid", F.explode("inherit").alias("part")).join(now.select(F.col("fid").alias("part"), "inherit").dropDuplicates(["part"]), "part")
        lineage = parts.groupBy("fid").agg(F.array_sort(F.flatten(F.collect_list("inherit"))).alias("inherit"))
        now, last = cut(_shaped(plain, merged).drop("inherit").join(lineage, "fid")), step
        out[step] = now
    return out


def clean_series(df: DataFrame, thresholds: list[float], columns: list[str]) -> dict[float, DataFrame]:
    """M7: the layer cleaned at each threshold, each time from the start: ring tables with area, the columns and inherit."""
    return {t: _shaped(df, cut(clean_small(df, t, columns)[0])) for t in thresholds}


def threshold_series(diameter_km: float, increment: float | None = None, geographic: bool = False) -> list[float]:
    """M7: area thresholds of circles of growing diameter, in map units."""
    steps = [diameter_km] if not increment else [k * increment for k in range(int((diameter_km + 0.001) / increment) + 1)]
    return [math.pi * (d / 2) ** 2 * 1e6 / (110_000.0**2 if geographic else 1.0) for d in steps]


def dissolve(df: DataFrame, groups: DataFrame) -> DataFrame:
    """The ring table (fid, member, ring_no, ring) of each group of polygons or rings
    (member, group): sides that occur an odd number of times in the group, stitched and nested."""
    rows = segments(df).join(groups.select(F.col("member").alias("fid"), "group"), "fid")
    sides = rows.groupBy("group", "seg_key").agg(F.count("*").alias("n"), F.min(F.struct("x0", "y0", "x1", "y1")).alias("e")).where("n % 2 = 1").select("group", "e.*")

    def stitch(key: tuple[int], own: pd.DataFrame) -> pd.DataFrame:
        found = kernels.nest(kernels.rings([((a, b), (c, d)) for a, b, c, d in own[["x0", "y0", "x1", "y1"]].itertuples(index=False)]))
        return pd.DataFrame([(key[0], m, k, [{"x": x, "y": y} for x, y in r]) for m, k, r in found], columns=["fid", "member", "ring_no", "ring"])

    return sides.groupBy("group").applyInPandas(stitch, "fid long, member int, ring_no int, ring array<struct<x: double, y: double>>")


def overflow(text: Column, name: str = "inherit", width: int = 254, columns: int = 4) -> list[Column]:
    """M4 at a sink of narrow fields: text cut into name, name1, ...; text that the
    columns cannot hold raises, so no lineage is lost. Other sinks take it whole."""
    text = F.when(F.length(text) > width * columns, F.raise_error(F.lit(f"text is longer than {columns} fields of {width}"))).otherwise(text)
    return [F.substring(text, 1 + i * width, width).alias(name if i == 0 else f"{name}{i}") for i in range(columns)]


# ---------------------------------------------------------------- dykes
def triangulate(df: DataFrame, ids: list[str], column: str, least: float = 1.0, holes: DataFrame | None = None) -> DataFrame:
    """Polygons named by ids and smaller than least become their
    triangles (fid, rec_type 'triangle', tri_id, ring, area), all others stay
    (rec_type 'polygon'). A triangle counts if its centroid is inside, or more
    than half of it; not if its centroid lies in one of holes (fid, ring) or
    more than a tenth of it. Codes of triangles are unique, so a later merge goes by boundary length."""
    hit = F.col(column).cast("string").isin([str(i) for i in ids]) & (ring_area(F.col("ring")) < least)
    schema = "fid long, tri_id int, ring array<struct<x: double, y: double>>"
    xy = lambda ring: [(p["x"], p["y"]) for p in ring]

    def split(batches):
        for pdf in batches:
            out = []
            for fid, ring, inner in zip(pdf["fid"], pdf["ring"], pdf["holes"]):
                points, gaps = xy(ring), [xy(h["ring"]) for h in inner] if inner is not None else []
                kept = 0
                for t in kernels.triangles(points):
                    centre = (sum(p[0] for p in t) / 3, sum(p[1] for p in t) / 3)
                    whole = abs(kernels.area2([*t, t[0]])) / 2
                    own = kernels.inside(centre, points) or kernels.clipped_area(points, list(t)) > 0.5 * whole
                    if own and not any(kernels.inside(centre, h) or kernels.clipped_area(h, list(t)) > 0.1 * whole for h in gaps):
                        out.append((fid, kept, [{"x": x, "y": y} for x, y in (*t, t[0])]))
                        kept += 1
            yield pd.DataFrame(out, columns=["fid", "tri_id", "ring"])

    own = df.where(hit).select(F.col("fid").cast("long").alias("fid"), "ring")
    if holes is None:
        own = own.withColumn("holes", F.lit(None).cast("array<struct<ring: array<struct<x: double, y: double>>>>"))
    else:
        own = own.join(holes.groupBy(F.col("fid").cast("long").alias("fid")).agg(F.collect_list(F.struct("ring")).alias("holes")), "fid", "left")
    split_up = own.mapInPandas(split, schema)
    rest = df.where(~F.coalesce(hit, F.lit(False))).select(F.col("fid").cast("long").alias("fid"), F.lit(None).cast("int").alias("tri_id"), "ring")
    code = F.when(F.col("tri_id").isNotNull(), F.concat(F.lit("tri"), F.col("fid").cast("string"), F.lit("_"), F.col("tri_id").cast("string")))
    return split_up.union(rest).select("fid", F.when(F.col("tri_id").isNotNull(), "triangle").otherwise("polygon").alias("rec_type"), "tri_id", code.alias("code"), "ring", ring_area(F.col("ring")).alias("area"))


def filler(kind: str, seed: int = 42) -> Column:
    """Reproducible filler for an attribute of a type, from fid and seed by multiplication modulo a prime, the same in every engine."""
    h = hash_order(seed) % 100_000 + 1
    return {"int": h.cast("int"), "float": F.round(h / 1000.0, 3)}.get(kind, F.concat(F.lit("s"), h.cast("string")))
