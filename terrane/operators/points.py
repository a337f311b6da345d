"""Thinning and averaging of orientation measurements."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalar import GRID_METRES_PER_DEGREE, TINY, Moments, axial_difference, direction_cosines, strike_to_dip_direction, turn, whole, with_spread
from terrane.operators.ranks import first, ranked, running


@dataclass(frozen=True)
class Roles:
    """Names of the columns that hold position and orientation."""

    easting: str = "easting"
    northing: str = "northing"
    dip: str = "dip"
    dip_dir: str = "dip_dir"


def set_up(df: DataFrame, roles: Roles = Roles(), strike: str | None = None) -> DataFrame:
    """Fid, easting, northing, dip, dip_dir; from strike if one is named."""
    direction = strike_to_dip_direction(F.col(strike).cast("double")) if strike else F.col(roles.dip_dir).cast("double")
    return df.select("fid", *(F.col(getattr(roles, c)).cast("double").alias(c) for c in ("easting", "northing", "dip")), direction.alias("dip_dir"))


def standardise(df: DataFrame, roles: Roles = Roles(), strike: str | None = None, equals: tuple[str, object] | None = None) -> DataFrame:
    """Optional equality filter, direction modulo a turn (strike: 90 degrees on), rows with a null dropped."""
    if equals:
        df = df.where(F.col(equals[0]) == F.lit(equals[1]))
    direction = strike_to_dip_direction(F.col(strike).cast("double"), left=False) if strike else turn(F.col(roles.dip_dir).cast("double"))
    out = df.select("fid", *(F.col(getattr(roles, c)).cast("double").alias(c) for c in ("easting", "northing", "dip")), direction.alias("dip_dir"))
    return out.dropna(subset=["easting", "northing", "dip", "dip_dir"])


def grid_size(size: float, geographic: bool = False) -> float:
    return size / GRID_METRES_PER_DEGREE if geographic else size


def bounds(df: DataFrame, floor_bounds: bool = False) -> DataFrame:
    """One row minx, maxx, miny, maxy; truncated toward zero, the upper ones plus one."""
    cut = (lambda c: F.floor(c).cast("bigint")) if floor_bounds else whole
    return df.agg(cut(F.min("easting")).alias("minx"), (cut(F.max("easting")) + 1).alias("maxx"), cut(F.min("northing")).alias("miny"), (cut(F.max("northing")) + 1).alias("maxy"))


def with_cells(df: DataFrame, size: float, floor_bounds: bool = False) -> DataFrame:
    """Cell numbers cx, cy of the points inside the bounds, and the bounds' corner."""
    inside = (F.col("easting") >= F.col("minx")) & (F.col("easting") < F.col("maxx")) & (F.col("northing") >= F.col("miny")) & (F.col("northing") < F.col("maxy"))
    return (
        df.crossJoin(F.broadcast(bounds(df, floor_bounds)))  # one row
        .where(inside)
        .withColumns({"cx": F.floor((F.col("easting") - F.col("minx")) / size), "cy": F.floor((F.col("northing") - F.col("miny")) / size)})
    )


def _centre(df: DataFrame, size: float) -> list[Column]:
    return [whole(F.col("minx") + (F.col("cx") + 0.5) * size).alias("easting"), whole(F.col("miny") + (F.col("cy") + 0.5) * size).alias("northing")]


def _sums() -> list[Column]:
    return [F.sum(c).alias(f"s_{n}") for n, c in zip(Moments.NAMES, (getattr(Moments.terms(*direction_cosines(F.col("dip"), F.col("dip_dir"))), n) for n in Moments.NAMES))]


def cell_moments(df: DataFrame, size: float, floor_bounds: bool = False) -> DataFrame:
    """Sums of each occupied cell; distributive, so combined before the shuffle."""
    return with_cells(df, size, floor_bounds).groupBy("cx", "cy", "minx", "miny").agg(*_sums())


def decimate(df: DataFrame, n: int = 5, dense: bool = False) -> DataFrame:
    """O1: rows 0, n, 2n, ... in order of fid. With dense fids (0..N-1) no order is needed.

    Otherwise ranks come from range partitions, whose sizes are summed first, so no task sorts the whole layer."""
    if dense:
        return df.where(F.col("fid") % n == 0)
    return ranked(df, "fid", name="__rank").where(F.col("__rank") % n == 0).drop("__rank")


def stochastic(df: DataFrame, fraction: float = 0.5, seed: int = 42, replace: bool = False, total: int | None = None) -> DataFrame:
    """O2: exactly round(fraction * N) rows by a hash of fid and seed; with replacement, about as many."""
    if replace:
        return df.sample(True, fraction, seed)
    want = round((df.count() if total is None else total) * fraction)
    return first(df.withColumn("__order", hash_order(seed)), want, "__order", "fid").drop("__order")


def hash_order(seed: int) -> Column:
    """An order of fids that looks random and is the same in every engine: multiplication modulo a prime."""
    return F.pmod((F.col("fid") + seed) * 48271, F.lit(2147483647))


def grid_average(df: DataFrame, size: float = 1000.0, floor_bounds: bool = False) -> DataFrame:
    """O3: mean orientation of each occupied cell, at its centre; null orientation where the measurements cancel out."""
    dip, direction = Moments.of().mean()
    return cell_moments(df, size, floor_bounds).select(*_centre(df, size), whole(dip).alias("dip"), whole(direction).alias("dip_dir"), F.col("s_n").alias("n"))


def spherical_kent(df: DataFrame, size: float = 1000.0, floor_bounds: bool = False) -> DataFrame:
    """grid_average with concentration and ovalness; cells without a mean are dropped."""
    dip, direction = Moments.of().mean()
    cells = cell_moments(df, size, floor_bounds)
    cells = with_spread(cells.where(Moments.of().resultant() >= TINY), Moments.of())  # a filter on kappa would be rewritten into all that makes it
    return cells.select(*_centre(df, size), whole(dip).alias("dip"), whole(direction).alias("dip_dir"), F.col("s_n").alias("n"), "kappa", "beta")


def _terms() -> Moments:
    return Moments.terms(*direction_cosines(F.col("dip"), F.col("dip_dir")))


def _with_sums(rows: DataFrame) -> DataFrame:
    """rows of cells (cx, cy) of more than three points with the cell's sums s_ of
    its terms t_. The sums are combined before they are exchanged and joined back,
    so AQE can split a cell of very many points, which a window would hold in one task."""
    sums = rows.groupBy("cx", "cy").agg(*(F.sum(f"t_{n}").alias(f"s_{n}") for n in Moments.NAMES)).where("s_n > 3")
    return rows.join(sums, ["cx", "cy"])


def remove_outlier(df: DataFrame, size: float = 1000.0, floor_bounds: bool = False) -> DataFrame:
    """Of each cell of more than three points, the one whose removal raises
    the concentration most is left out (the first fid on ties).

    Leave-one-out sums are the cell's sums less the point's own, so the cost is linear."""
    rows = with_cells(df, size, floor_bounds).select("fid", "cx", "cy", "minx", "miny", *_terms().columns("t_"))
    rows = _with_sums(rows)
    rows = with_spread(rows, Moments.of("s_"), "k0", "b0")
    rows = rows.select("fid", "cx", "cy", "minx", "miny", "k0", *Moments.of("s_").minus(Moments.of("t_")).columns("r_"))
    rows = with_spread(rows, Moments.of("r_"))
    gain = F.round(F.coalesce(F.col("kappa"), F.lit(1e-6)) - F.coalesce(F.col("k0"), F.lit(1e-6)), 9)
    best = rows.groupBy("cx", "cy", "minx", "miny").agg(F.max_by(F.struct("fid", "kappa", "beta", *(f"r_{n}" for n in Moments.NAMES)), F.struct(gain, -F.col("fid"))).alias("b")).select("cx", "cy", "minx", "miny", "b.*")
    dip, direction = Moments.of("r_").mean()
    return best.where(F.col("kappa").isNotNull()).select(*_centre(df, size), whole(dip).alias("dip"), whole(direction).alias("dip_dir"), F.col("r_n").alias("n"), "kappa", "beta", F.col("fid").alias("removed_fid"))


def remove_outliers_by_break(df: DataFrame, size: float = 1000.0, floor_bounds: bool = False) -> DataFrame:
    """Points are taken away farthest from the mean first, up to half of the
    cell; the removals up to the largest rise of the concentration hold.

    Cells are closed on both sides, so a point on a side belongs to each cell it touches."""
    corner = df.crossJoin(F.broadcast(bounds(df, floor_bounds)))

    def candidates(at: str, low: str, high: str) -> Column:
        cells = F.floor((F.col(high) - F.col(low) - 1e-9) / size)
        own = F.floor((F.col(at) - F.col(low)) / size)
        touching = F.when((F.col(at) - F.col(low)) == own * size, F.array(own - 1, own)).otherwise(F.array(own))
        return F.filter(touching, lambda c: (c >= 0) & (c <= cells))

    rows = corner.select("*", F.explode(candidates("easting", "minx", "maxx")).alias("cx")).select("*", F.explode(candidates("northing", "miny", "maxy")).alias("cy"))
    rows = rows.select("fid", "cx", "cy", "minx", "miny", *_terms().columns("t_"))
    rows = _with_sums(rows)
    s = Moments.of("s_")
    rows = rows.where(s.resultant() >= 1e-12)
    dot = F.col("t_l") * s.l + F.col("t_m") * s.m + F.col("t_z") * s.z
    away = F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / s.resultant())))), 9)
    # farthest first, then the greatest fid; a cell of any size is walked in ranges
    terms = [f"t_{n}" for n in Moments.NAMES]
    rows = running(rows.withColumns({"away": -away, "last": -F.col("fid")}), ["cx", "cy"], ["away", "last"], terms).where(F.col("step") <= F.floor(F.col("s_n") / 2))
    rows = with_spread(rows, s, "k0", "b0")
    gone = Moments(*(F.col(f"g_t_{n}") for n in Moments.NAMES))
    kept, before = s.minus(gone), s.minus(gone.minus(Moments.of("t_")))
    rows = rows.select("fid", "cx", "cy", "minx", "miny", "step", "k0", "b0", *s.columns("s_"), *kept.columns("r_"), *before.columns("p_"))
    rows = with_spread(with_spread(rows, Moments.of("r_")), Moments.of("p_"), "k_before", "b_before")
    k = F.coalesce(F.col("kappa"), F.lit(1e-6))
    # the concentration one step before, from the sums that hold this point
    rise = F.round(k - F.when(F.col("step") == 1, F.col("k0")).otherwise(F.coalesce(F.col("k_before"), F.lit(1e-6))), 9)
    rows = rows.withColumn("rise", rise)
    names = ("kappa", "beta", *(f"r_{n}" for n in Moments.NAMES))
    best = rows.groupBy("cx", "cy", "minx", "miny").agg(
        F.max_by(F.struct("rise", "step", *names), F.struct("rise", -F.col("step"))).alias("b"), F.first(F.struct(F.col("k0").alias("kappa"), F.col("b0").alias("beta"), *(F.col(f"s_{n}").alias(f"r_{n}") for n in Moments.NAMES))).alias("a")
    )
    helps = F.col("b.rise") > 0
    out = best.select("cx", "cy", "minx", "miny", F.when(helps, F.col("b.step")).otherwise(0).alias("n_removed"), *(F.when(helps, F.col(f"b.{n}")).otherwise(F.col(f"a.{n}")).alias(n) for n in names))
    dip, direction = Moments.of("r_").mean()
    centre = [whole(F.col("minx") + F.col("cx") * size + size / 2).alias("easting"), whole(F.col("miny") + F.col("cy") * size + size / 2).alias("northing")]
    return out.where(F.col("kappa").isNotNull()).select(*centre, whole(dip).alias("dip"), whole(direction).alias("dip_dir"), F.col("r_n").alias("n"), "kappa", "beta", "n_removed")


def first_order(df: DataFrame, contacts: DataFrame, buffer: float = 500.0, tolerance: float = 15.0) -> DataFrame:
    """Points within buffer of a contact (segments: fid, s, x0, y0, x1, y1)
    whose strike runs along the nearest segment."""
    from terrane.operators.spatial import nearest_segment

    near = nearest_segment(df, contacts, buffer)
    strike = strike_to_dip_direction(F.col("dip_dir"))
    return near.where(axial_difference(F.col("azimuth"), strike % 180) <= tolerance)


METHODS: dict[str, Callable[..., DataFrame]] = {
    "decimation": decimate,
    "stochastic": stochastic,
    "gridcell": grid_average,
    "kent": spherical_kent,
    "outlier": remove_outlier,
    "carmichael": remove_outliers_by_break,
    "firstorder": first_order,
}


def subsample(method: str, df: DataFrame, **parameters) -> DataFrame:
    """A method by name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](df, **parameters)


def run_methods(df: DataFrame, methods: dict[str, dict], contacts: DataFrame | None = None) -> DataFrame:
    """Method and count of rows for each; contacts missing: no first-order."""
    counts = None
    for name, parameters in methods.items():
        if name == "firstorder":
            if contacts is None:
                continue
            parameters = {**parameters, "contacts": contacts}
        one = subsample(name, df, **parameters).agg(F.count("*").alias("n")).select(F.lit(name).alias("method"), "n")
        counts = one if counts is None else counts.union(one)
    return counts


def cell_counts(df: DataFrame, sizes: list[float], more_than: int = 0) -> DataFrame:
    """Output cells of several grid sizes in one job."""
    one = df.select("easting", "northing").crossJoin(F.broadcast(bounds(df)))
    each = one.select("*", F.explode(F.array(*(F.lit(float(s)) for s in sizes))).alias("size"))
    inside = (F.col("easting") >= F.col("minx")) & (F.col("easting") < F.col("maxx")) & (F.col("northing") >= F.col("miny")) & (F.col("northing") < F.col("maxy"))
    cells = each.where(inside).groupBy("size", F.floor((F.col("easting") - F.col("minx")) / F.col("size")).alias("cx"), F.floor((F.col("northing") - F.col("miny")) / F.col("size")).alias("cy")).agg(F.count("*").alias("points"))
    return cells.where(F.col("points") > more_than).groupBy("size").agg(F.count("*").alias("cells"))


def grid_size_for(df: DataFrame, target: int, more_than: int = 0, tolerance: float = 0.15, ladder: int = 12) -> float:
    """A grid size that leaves about `target` cells.

    Starts from sqrt(area / target); a ladder of sizes around it is counted in
    one job, and one more between the two that bracket the target."""
    b = bounds(df).first()
    start = math.sqrt(max((b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"]), 1) / max(target, 1))
    sizes = [start * 2 ** ((k - ladder // 2) / 2) for k in range(ladder)]
    best = (math.inf, start)
    for _ in range(2):
        counts = sorted((r["size"], r["cells"]) for r in cell_counts(df, sizes, more_than).collect())
        best = min([best, *((abs(c - target), s) for s, c in counts)])
        if best[0] <= tolerance * target:
            break
        above, below = [s for s, c in counts if c >= target], [s for s, c in counts if c < target]
        if not above or not below:
            break
        low, high = max(above), min(s for s in below if s > max(above)) if any(s > max(above) for s in below) else max(below)
        sizes = [low + (high - low) * (k + 1) / (ladder + 1) for k in range(ladder)]
    return best[1]
