"""Column expressions for angles, directions, lengths and map-scale arithmetic.

Bearings are degrees clockwise from north; axial values lie in [0, 180).
Vertex arrays are array<struct<x: double, y: double>>. Expressions only, all
evaluated in the JVM; those over arrays (aggregate, transform, zip_with) are
interpreted, the others are part of generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree as used for grid sizes and for line lengths, and length units in metres.
GRID_METRES_PER_DEGREE, LINE_METRES_PER_DEGREE = 110_000.0, 111_139.0
UNITS = {"meters": 1.0, "kilometers": 0.001, "feet": 3.28084, "miles": 0.000621371}
#: A resultant below this has no direction.
TINY = 1e-12


def turn(angle: Column, full: float = 360.0) -> Column:
    """Angle modulo a full turn, never negative."""
    return F.pmod(angle, F.lit(full))


def strike_to_dip_direction(strike: Column, left: bool = True) -> Column:
    """Dip direction from strike: 90 degrees back (`left`) or, as stage 0 of the
    standardisation has it, 90 degrees on."""
    return turn(strike - 90.0 if left else strike + 90.0)


def direction_cosines(dip: Column, dip_dir: Column) -> tuple[Column, Column, Column]:
    d, a = F.radians(dip), F.radians(dip_dir)
    return F.sin(d) * F.sin(a), F.sin(d) * F.cos(a), F.cos(d)


def dip_and_direction(l: Column, m: Column, n: Column) -> tuple[Column, Column]:  # noqa: E741
    """Dip and dip direction of a unit vector; vectors that point up are turned over."""
    direction = turn(360.0 + F.degrees(F.atan2(l, m)))
    dip = 90.0 - F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n))))
    over = dip > 90.0
    return F.when(over, 180.0 - dip).otherwise(dip), F.when(over, turn(direction + 180.0)).otherwise(direction)


def whole(value: Column) -> Column:
    """Truncation toward zero as bigint, steady against the last bits of a sum."""
    r = F.round(value, 9)
    return F.when(r >= 0, F.floor(r)).otherwise(F.ceil(r)).cast("bigint")


def axial(angle: Column) -> Column:
    return turn(angle, 180.0)


def azimuth(dx: Column, dy: Column) -> Column:
    """Axial bearing of a step; null without length."""
    return F.when((dx != 0) | (dy != 0), axial(F.degrees(F.atan2(dx, dy)) + 360.0))


def axial_difference(a: Column, b: Column) -> Column:
    d = axial(F.abs(a - b))
    return F.least(d, 180.0 - d)


def axial_to_plane(angle: Column) -> tuple[Column, Column]:
    """Angle doubling: axial values on the unit circle."""
    return F.cos(F.radians(axial(angle) * 2)), F.sin(F.radians(axial(angle) * 2))


def plane_to_axial(x: Column, y: Column) -> Column:
    return axial(F.degrees(F.atan2(y, x)) / 2)


def steps(vertices: Column) -> Column:
    """Array of (x0, y0, x1, y1), one for each pair of consecutive vertices."""
    return F.when(
        F.size(vertices) > 1,
        F.zip_with(
            F.slice(vertices, F.lit(1), F.size(vertices) - 1),
            F.slice(vertices, F.lit(2), F.size(vertices) - 1),
            lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")),
        ),
    ).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + value(e))


def step_length(s: Column) -> Column:
    return F.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"])


def line_length(vertices: Column) -> Column:
    """Length of a vertex array; null for fewer than two vertices."""
    return F.when(F.size(vertices) > 1, _total(steps(vertices), step_length))


def line_mid_latitude(vertices: Column) -> Column:
    """y of the length-weighted centroid."""
    s = steps(vertices)
    length = _total(s, step_length)
    return F.when(length > 0, F.try_divide(_total(s, lambda e: step_length(e) * (e["y0"] + e["y1"]) / 2), length)).otherwise(vertices[0]["y"])


def length_in(vertices: Column, unit: str) -> Column:
    """Length in a unit of UNITS; in degrees, metres by the latitude of the centroid; unknown units are not scaled."""
    if unit == "degrees":
        return line_length(vertices) * LINE_METRES_PER_DEGREE * F.cos(F.radians(line_mid_latitude(vertices)))
    return line_length(vertices) * UNITS.get(unit, 1.0)


def end_azimuth(vertices: Column) -> Column:
    """Axial bearing from the first vertex to the last; null where they coincide."""
    a, b = F.element_at(vertices, 1), F.element_at(vertices, -1)
    return F.when(F.size(vertices) > 1, azimuth(b["x"] - a["x"], b["y"] - a["y"]))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, without sign."""
    return F.abs(_total(steps(ring), lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"])) / 2


def ring_turn(ring: Column) -> Column:
    """Signed shoelace area of a closed ring: positive counterclockwise."""
    return _total(steps(ring), lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]) / 2


def quantum(value: Column, q: float = 0.1) -> Column:
    """Half-even multiple of q, as bigint key."""
    return F.bround(value / q).cast("bigint")


def radical_count(on: Column | int, ratio: float, exponent: int) -> Column:
    """Features that a scale ratio leaves: exponent 1 for points, 2 for lines, 3 for areas."""
    on = F.lit(on) if isinstance(on, int) else on
    if ratio <= 0:
        return F.lit(0).cast("bigint")
    return F.when(on <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(on * ratio ** (exponent / 2)))).cast("bigint")


def edge_rank(edge_type: Column) -> Column:
    """Connected edges first: X-X 0, mixed 1, none 2, Z-Z 3."""
    t = F.lower(F.trim(edge_type))
    return F.when(t.isNull() | (t == ""), 2).when(t == "x-x", 0).when(t == "z-z", 3).otherwise(1)


def node_class(degree: Column) -> Column:
    return F.when(degree == 0, "I").when(degree == 1, "Z").when(degree == 2, "Y").otherwise("X")


def edge_class(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


@dataclass(frozen=True)
class Moments:
    """Sums over a cell, enough for its mean direction and spread; they add and subtract."""

    n: Column
    l: Column  # noqa: E741
    m: Column
    z: Column
    ll: Column
    mm: Column
    zz: Column
    lm: Column
    lz: Column
    mz: Column

    NAMES = ("n", "l", "m", "z", "ll", "mm", "zz", "lm", "lz", "mz")

    @classmethod
    def terms(cls, l: Column, m: Column, z: Column) -> Moments:  # noqa: E741
        return cls(F.lit(1), l, m, z, l * l, m * m, z * z, l * m, l * z, m * z)

    @classmethod
    def of(cls, prefix: str = "s_") -> Moments:
        return cls(*(F.col(prefix + c) for c in cls.NAMES))

    def map(self, f) -> Moments:
        return Moments(*(f(getattr(self, c)) for c in self.NAMES))

    def minus(self, other: Moments) -> Moments:
        return Moments(*(getattr(self, c) - getattr(other, c) for c in self.NAMES))

    def columns(self, prefix: str = "s_") -> list[Column]:
        return [getattr(self, c).alias(prefix + c) for c in self.NAMES]

    def resultant(self) -> Column:
        return F.sqrt(self.l * self.l + self.m * self.m + self.z * self.z)

    def mean(self) -> tuple[Column, Column]:
        """Dip and dip direction of the mean; null without a resultant."""
        r = self.resultant()
        dip, direction = dip_and_direction(F.try_divide(self.l, r), F.try_divide(self.m, r), F.try_divide(self.z, r))
        return F.when(r >= TINY, dip), F.when(r >= TINY, direction)


def with_spread(df, moments: Moments, kappa: str = "kappa", beta: str = "beta"):
    """Adds concentration and ovalness of the distribution that moments describe
    (moment estimator on the unnormalised resultant); null without a resultant.

    Stepwise, so that each intermediate is computed once. With p, q the first
    two axes of the frame of the mean and M the second moments by n, the spread
    Q is that of (p, q) after the turn that makes them principal axes."""
    s, c = moments, "__k_"
    df = df.withColumn(c + "r", s.resultant())
    ok = F.col(c + "r") >= TINY
    n_mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(s.z, F.col(c + "r"))))
    l_mean, m_mean = F.try_divide(s.l, F.col(c + "r")), F.try_divide(s.m, F.col(c + "r"))
    df = df.withColumns({
        c + "t": F.acos(n_mean),
        c + "p": F.when(F.abs(l_mean) > TINY, F.atan(F.try_divide(m_mean, l_mean))).otherwise(F.when(m_mean >= 0, F.lit(3.141592653589793 / 2)).otherwise(-3.141592653589793 / 2)),
    })
    t, p = F.col(c + "t"), F.col(c + "p")
    a = (F.cos(t) * F.cos(p), -F.sin(p), F.sin(t) * F.cos(p))
    b = (F.cos(t) * F.sin(p), F.cos(p), F.sin(t) * F.sin(p))
    m = ((s.ll, s.lm, s.lz), (s.lm, s.mm, s.mz), (s.lz, s.mz, s.zz))

    def form(u, v):
        return F.try_divide(sum((u[i] * m[i][j] * v[j] for i in range(3) for j in range(3)), F.lit(0.0)), s.n)

    df = df.withColumns({c + "ab": form(a, b), c + "d": form(a, a) - form(b, b)})
    ab, d = F.col(c + "ab"), F.col(c + "d")
    df = df.withColumn(c + "w", F.when(F.abs(d) > TINY, F.atan(F.try_divide(2 * ab, d))).otherwise(0.0))
    w = F.col(c + "w")
    df = df.withColumn(c + "q", F.cos(w) * d + 2 * F.sin(w) * ab)
    inf = F.lit(float("inf"))
    parts = [F.when(F.abs(x) > TINY, F.try_divide(F.lit(1.0), x)).otherwise(inf) for x in (2 - 2 * F.col(c + "r") - F.col(c + "q"), 2 - 2 * F.col(c + "r") + F.col(c + "q"))]
    df = df.withColumns({c + "i": parts[0], c + "j": parts[1]})
    total, half = F.col(c + "i") + F.col(c + "j"), (F.col(c + "i") - F.col(c + "j")) * 0.5
    df = df.withColumn(kappa, F.when(ok, F.when(F.isnan(total) | (total < 1e-6), 1e-6).otherwise(total)))
    top = F.col(kappa) / 2 - 1e-9
    df = df.withColumn(beta, F.when(ok, F.when(F.isnan(half), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(half, top)))))
    return df.drop(*(c + x for x in ("r", "t", "p", "ab", "d", "w", "q", "i", "j")))
