"""Reading ESRI shapefiles: geometry (.shp) and attributes (.dbf) through Spark's binary reader."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fid long, parts array<array<struct<x: double, y: double>>>, properties map<string, string>, file string"


def shapes(data: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """Parts of each record of a .shp file; none for null shapes. Points are parts of one vertex; heights and measures are left out."""
    at, end = 100, min(len(data), 2 * struct.unpack(">i", data[24:28])[0])
    while at + 12 <= end:
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            yield [[struct.unpack("<2d", body[4:20])]]
        elif kind == 8:
            n = struct.unpack("<i", body[36:40])[0]
            yield [[struct.unpack_from("<2d", body, 40 + 16 * i) for i in range(n)]]
        elif kind in (3, 5):
            n_parts, n = struct.unpack("<2i", body[36:44])
            first = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * n_parts)
            points = list(zip(flat[::2], flat[1::2]))
            yield [points[a:b] for a, b in zip(first, first[1:])]
        else:
            yield []
        at += 8 + size


def attributes(data: bytes) -> Iterator[dict[str, str | None]]:
    """Fields of each record of a .dbf file as text; blank: null. Deleted records keep their place."""
    n, header, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at < header - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for i in range(n):
        row, at, out = data[header + i * size : header + (i + 1) * size], 1, {}
        for name, width in fields:
            raw = row[at : at + width]
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            out[name] = text.strip(" \0") or None
            at += width
        yield out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Fid (place in its file, from 0), geom (the first part), parts, properties and file of each record.

    path: a .shp file or a folder. Files are the unit of work, as the format
    bounds each at 2 GB; a large layer is a folder of many. A missing .dbf leaves properties empty."""
    if path.lower().endswith(".shp"):
        folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
        names = re.escape(name[:-4])
    else:
        folder, names = path, ".*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,SHP,dbf,DBF}").load(folder)
    base = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    files = files.select("path", "content", F.regexp_replace("path", r"\.[^./]+$", "").alias("file")).where(F.regexp_like(base, F.lit(f"^{names}$")))
    is_shape = F.lower("path").endswith(".shp")
    both = files.where(is_shape).select("file", F.col("content").alias("shp")).join(files.where(~is_shape).select("file", F.col("content").alias("dbf")), "file", "left")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, shp, dbf in zip(pdf["file"], pdf["shp"], pdf["dbf"]):
                rows, known = [], attributes(bytes(dbf)) if dbf is not None else iter(())
                for fid, parts in enumerate(shapes(bytes(shp))):
                    rows.append((fid, [[{"x": x, "y": y} for x, y in part] for part in parts], next(known, {}), file))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["fid", "parts", "properties", "file"])
                        rows = []
                yield pd.DataFrame(rows, columns=["fid", "parts", "properties", "file"])

    return both.mapInPandas(parse, SCHEMA).withColumn("geom", F.get("parts", F.lit(0)))
