"""Reading and writing layers: Parquet, CSV with WKT, GeoJSON lines, shapefiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources import shapefile
from terrane.sources.shapesink import ShapefileSink

_VERTEX = "struct<x: double, y: double>"


def _pairs(text: Column) -> Column:
    """'1 2, 3 4' as vertices."""
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def from_wkt(df: DataFrame, column: str = "wkt") -> DataFrame:
    """Parts array<array<vertex>> from POINT, LINESTRING, POLYGON and their
    MULTI forms (rings and members in order); geom, the first part; and of polygons
    members, an array of members, each an array of rings, the outer one first (null for other kinds)."""
    ring = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), _pairs)
    member = F.regexp_extract_all(F.col(column), F.lit(r"\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)"), F.lit(1))
    polygon = F.col(column).rlike(r"(?i)^\s*(MULTI)?POLYGON")
    return df.withColumn("parts", ring(F.col(column))).withColumn("geom", F.get("parts", F.lit(0))).withColumn("members", F.when(polygon, F.transform(member, ring)))


def _depth(df: DataFrame, geom: str) -> int:
    """1: one part, 2: several parts or rings, 3: members of rings."""
    return df.schema[geom].dataType.simpleString().count("array<")


def to_wkt(df: DataFrame, geom: str = "geom", kind: str = "LINESTRING") -> DataFrame:
    """S3: a wkt column in place of geom, which is one part; or an array of parts for POLYGON and
    MULTILINESTRING; or an array of members, each an array of rings, which gives a MULTIPOLYGON."""
    depth = _depth(df, geom)
    listed = lambda part: F.concat_ws(", ", F.transform(part, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))))
    bracketed = lambda parts: F.concat_ws(", ", F.transform(parts, lambda part: F.concat(F.lit("("), listed(part), F.lit(")"))))
    if depth == 3:
        body = F.concat_ws(", ", F.transform(geom, lambda rings: F.concat(F.lit("("), bracketed(rings), F.lit(")"))))
        kind = kind if kind.startswith("MULTI") else f"MULTI{kind}"
    else:
        body = bracketed(F.col(geom)) if depth == 2 else listed(F.col(geom))
    left, right = ("((", "))") if kind == "POLYGON" and depth == 1 else ("(", ")")
    return df.withColumn("wkt", F.concat(F.lit(f"{kind} {left}"), body, F.lit(right))).drop(geom)


def read_layer(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A layer by its format. csv holds WKT in the column wkt; geojson is
    one feature a line, its properties as strings; shapefile is one .shp file or a
    folder of them, with .dbf beside. Text formats and shapefiles give parts (all rings or members, in order) and
    geom, the first; csv and geojson also give members (see from_wkt), which rings.from_members() makes a ring table
    of, as rings.nested() does of a shapefile's rings."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        reader = spark.read.option("header", True)
        return from_wkt(reader.schema(schema).csv(path) if schema else reader.csv(path))
    if kind == "geojson":
        rows = spark.read.text(path).where(F.col("value").contains('"geometry"'))
        at = lambda p: F.get_json_object("value", p)
        held = lambda depth: F.from_json(at("$.geometry.coordinates"), "array<" * depth + "double" + ">" * depth)
        kind_of = at("$.geometry.type")
        lists = F.when(kind_of == "Point", F.array(F.array(held(1)))).when(kind_of.isin("MultiPoint", "LineString"), F.array(held(2)))
        lists = lists.when(kind_of.isin("MultiLineString", "Polygon"), held(3)).when(kind_of == "MultiPolygon", F.flatten(held(4)))
        parts = F.transform(lists, lambda part: F.transform(part, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
        properties = F.from_json(at("$.properties"), "map<string, string>")
        nested = F.when(kind_of == "Polygon", F.array(held(3))).when(kind_of == "MultiPolygon", held(4))
        members = F.transform(nested, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
        return rows.select(properties.alias("properties"), parts.alias("parts"), members.alias("members")).withColumn("geom", F.get("parts", F.lit(0)))
    if kind == "shapefile":
        return shapefile.read(spark, path)
    raise ValueError(f"unknown kind of layer {kind!r}; known: parquet, csv, geojson, shapefile")


def output_path(folder: str, layer: str, method: str, parameter: float | None = None) -> str:
    """Where a result goes, by layer, method and whole parameter."""
    name = re.sub(r"[^A-Za-z0-9_.-]", "_", f"{layer}_{method}" + ("" if parameter is None else f"_{int(parameter)}"))
    return f"{folder.rstrip('/')}/{name}"


def write_layer(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", geom: str = "geom", shape: str = "LineString") -> None:
    """Csv gets WKT, geojson one feature a line, shapefile a folder of files, one or more a task (field
    names are cut to ten characters, text to 254 bytes); names that are taken raise, unless mode says otherwise.

    shape: LineString, or Polygon, of which geom is the outer ring. A geom of
    several parts (an array of arrays) is written as MultiLineString, or as one Polygon whose later rings are
    holes, and one of several members (see rings.to_members) as MultiPolygon."""
    if shape not in ("LineString", "Polygon"):
        raise ValueError(f"unknown shape {shape!r}; known: LineString, Polygon")
    depth = _depth(df, geom) if kind in ("csv", "geojson") else 0
    several = depth > 1
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        to_wkt(df, geom, ("MULTI" if several and shape == "LineString" else "") + shape.upper()).write.mode(mode).option("header", True).csv(path)
    elif kind == "geojson":
        listed = lambda part: F.transform(part, lambda p: F.array(p["x"], p["y"]))
        coordinates = F.transform(geom, lambda rings: F.transform(rings, listed)) if depth == 3 else F.transform(geom, listed) if several else F.array(listed(F.col(geom))) if shape == "Polygon" else listed(F.col(geom))
        name = "MultiPolygon" if depth == 3 else "MultiLineString" if several and shape == "LineString" else shape
        feature = F.struct(F.lit("Feature").alias("type"), F.struct(*(c for c in df.columns if c != geom)).alias("properties"), F.struct(F.lit(name).alias("type"), coordinates.alias("coordinates")).alias("geometry"))
        df.select(F.to_json(feature).alias("value")).write.mode(mode).text(path)
    elif kind == "shapefile":
        if mode not in ("errorifexists", "error", "append"):
            raise ValueError("shapefiles are added to a folder: modes errorifexists and append")
        spark = df.sparkSession
        spark.dataSource.register(ShapefileSink)
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # known to whatever Spark knows paths by
        if mode != "append" and there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            raise FileExistsError(path)
        df.write.format("shapefile_sink").mode("append").option("geom", geom).option("shape", shape).save(path)
    else:
        raise ValueError(f"unknown kind of layer {kind!r}; known: parquet, csv, geojson, shapefile")


def cell_points(cells: DataFrame, with_empty: bool = False) -> DataFrame:
    """Cell results as points; without those that have no orientation, unless asked for."""
    return cells if with_empty else cells.where("dip is not null and dip <> -999")
