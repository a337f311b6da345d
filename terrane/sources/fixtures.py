"""Layers derived from the shipped tables by integer arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation measurements from events."""
    e, u = F.col("event_id"), F.col("user_id")
    return _table(spark, sf_dir, "events").select(
        e.alias("fid"),
        ((e * 7919 + u * 104729) % 100003).cast("double").alias("easting"),
        ((e * 15485863 + u * 1299709) % 100019).cast("double").alias("northing"),
        ((e * 31 + u * 17) % 91).cast("double").alias("dip"),
        ((e * 97 + u * 13) % 360).cast("double").alias("dip_dir"),
        F.col("event_type").alias("kind"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines of 3 to 7 vertices from orders, with their attributes."""
    k = F.col("o_orderkey")

    def vertex(v: Column) -> Column:
        x = (k * 6151) % 100003 + v * 400 + ((k * 53 + v * 31) % 301) - 150
        y = (k * 3079) % 100019 + v * ((k % 7) - 3) * 150 + ((k * 97 + v * 17) % 301) - 150
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return _table(spark, sf_dir, "orders").select(k.alias("fid"), F.transform(F.sequence(F.lit(0).cast("bigint"), 2 + k % 5), vertex).alias("geom"), "o_orderpriority", "o_orderstatus", "o_totalprice")


def _corner(i: Column, j: Column) -> Column:
    return F.struct((i * 2500 + ((i * 7 + j * 13) % 11 - 5) * 100).cast("double").alias("x"), (j * 2500 + ((i * 5 + j * 3) % 11 - 5) * 100).cast("double").alias("y"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap-free mosaic of quadrilaterals from customer: fid, ring (closed), unit columns."""
    k = F.col("c_custkey")
    i, j = k % 40, F.floor(k / 40.0)
    return _table(spark, sf_dir, "customer").select(
        k.alias("fid"),
        F.array(_corner(i, j), _corner(i + 1, j), _corner(i + 1, j + 1), _corner(i, j + 1), _corner(i, j)).alias("ring"),
        F.concat(F.lit("U"), F.col("c_nationkey").cast("string")).alias("strat1"),
        F.concat(F.lit("G"), (F.col("c_nationkey") % 5).cast("string")).alias("strat2"),
        F.col("c_mktsegment").alias("lith"),
    )


def nested_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mosaic as a ring table: a square hole in every 50th polygon, filled by an island; two
    consecutive islands are the two members of one feature, whose fid is above ten million."""
    poly = polygons(spark, sf_dir)
    i, j = F.col("fid") % 40, F.floor(F.col("fid") / 40.0)
    cx, cy = (i * 2500 + 1250).cast("double"), (j * 2500 + 1250).cast("double")
    square = F.array(*(F.struct((cx + a * 100).alias("x"), (cy + b * 100).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    rest = ("strat1", "strat2", "lith")
    holed = poly.where("fid % 50 = 0")
    outer = poly.select("fid", F.lit(0).alias("member"), F.lit(0).alias("ring_no"), "ring", *rest)
    holes = holed.select("fid", F.lit(0), F.lit(1), F.reverse(square), *rest)
    island = F.floor(F.col("fid") / 100).cast("bigint")
    islands = holed.select((island + 10_000_000).alias("fid"), (F.floor(F.col("fid") / 50) % 2).cast("int"), F.lit(0), square, F.lit("island"), F.concat(F.lit("I"), island.cast("string")), F.lit("sand"))
    return outer.union(holes).union(islands)


def cells_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of lines along the mosaic's sides, with loose ends: lower side
    for all polygons but every 7th, left side for all but every 5th."""
    poly = polygons(spark, sf_dir)
    lower = poly.where("fid % 7 <> 0").select((F.col("fid") * 2).alias("fid"), F.slice("ring", 1, 2).alias("geom"))
    left = poly.where("fid % 5 <> 0").select((F.col("fid") * 2 + 1).alias("fid"), F.array(F.col("ring")[0], F.col("ring")[3]).alias("geom"))
    return lower.union(left)


def in_degrees(layer: DataFrame, geom: str = "ring") -> DataFrame:
    """The layer with coordinates like degrees: none is a whole number."""
    return layer.withColumn(geom, F.transform(geom, lambda p: F.struct((p["x"] / 110_001).alias("x"), (p["y"] / 110_001).alias("y"))))


#: The same layers in SQL, for the oracle.
POINTS_SQL = """points as (select event_id fid, cast((event_id*7919 + user_id*104729) % 100003 as double) easting,
 cast((event_id*15485863 + user_id*1299709) % 100019 as double) northing, cast((event_id*31 + user_id*17) % 91 as double) dip,
 cast((event_id*97 + user_id*13) % 360 as double) dip_dir, event_type kind from events)"""
LINES_SQL = """verts as (select o_orderkey fid, v, cast((o_orderkey*6151)%100003 + v*400 + ((o_orderkey*53 + v*31)%301) - 150 as double) x,
 cast((o_orderkey*3079)%100019 + v*((o_orderkey%7)-3)*150 + ((o_orderkey*97 + v*17)%301) - 150 as double) y,
 o_orderpriority, o_orderstatus, o_totalprice, 2 + o_orderkey%5 last_v from orders, unnest(range(0, 3+o_orderkey%5)) t(v))"""
POLYGONS_SQL = """polys as (select c_custkey fid, c_custkey % 40 i, cast(floor(c_custkey/40e0) as bigint) j, 'U'||c_nationkey strat1, 'G'||(c_nationkey%5) strat2, c_mktsegment lith from customer),
corners as (select fid, strat1, strat2, lith, v, i + case when v in (1,2) then 1 else 0 end ci, j + case when v in (2,3) then 1 else 0 end cj from polys, unnest(range(0, 5)) t(v)),
pverts as (select fid, strat1, strat2, lith, v, cast(ci*2500 + ((ci*7 + cj*13) % 11 - 5)*100 as double) x, cast(cj*2500 + ((ci*5 + cj*3) % 11 - 5)*100 as double) y from corners),
psteps as (select * from (select fid, strat1, strat2, lith, v s, x x0, y y0, lead(x) over w x1, lead(y) over w y1 from pverts window w as (partition by fid order by v)) q where x1 is not null),
segs as (select *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) length, case when x0 < x1 or (x0 = x1 and y0 <= y1)
 then concat_ws('|', x0, y0, x1, y1) else concat_ws('|', x1, y1, x0, y0) end seg_key from psteps)"""
#: The mosaic of in_degrees.
DEGREES_SQL = POLYGONS_SQL.replace("cast(ci*2500 + ((ci*7 + cj*13) % 11 - 5)*100 as double) x", "cast(ci*2500 + ((ci*7 + cj*13) % 11 - 5)*100 as double)/110001 x").replace("cast(cj*2500 + ((ci*5 + cj*3) % 11 - 5)*100 as double) y", "cast(cj*2500 + ((ci*5 + cj*3) % 11 - 5)*100 as double)/110001 y")
#: Rings of nested_mosaic: sides by feature.
NESTED_SQL = POLYGONS_SQL + """,
square as (select fid, i*2500e0 + 1250e0 cx, j*2500e0 + 1250e0 cy from polys where fid % 50 = 0),
inner_ as (select fid, s, cx + 100e0*a x0, cy + 100e0*b y0, cx + 100e0*c x1, cy + 100e0*d y1 from square, (values (0, -1, -1, 1, -1), (1, 1, -1, 1, 1), (2, 1, 1, -1, 1), (3, -1, 1, -1, -1)) t(s, a, b, c, d)),
nsegs as (select fid, 1 sign, x0, y0, x1, y1 from psteps union all select fid, -1, x0, y0, x1, y1 from inner_ union all select 10000000 + fid//100, 1, x0, y0, x1, y1 from inner_),
nunits as (select fid, strat1, strat2, lith from polys union select 10000000 + fid//100, 'island', 'I' || fid//100, 'sand' from square)"""
