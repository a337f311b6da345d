from terrane.operators import points
from terrane.sources import layers
from terrane.streaming.cells import streaming_average


def test_layers_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, [{"x": 0.0, "y": 1.5}, {"x": 2.0, "y": 3.0}])], "fid long, geom array<struct<x:double,y:double>>")
    for kind in ("parquet", "csv", "geojson"):
        path = layers.output_path(str(tmp_path), "faults", kind, 3.7)
        assert path.endswith(f"faults_{kind}_3")
        layers.write_layer(df, path, kind)
        got = layers.read_layer(spark, path, kind).first()["geom"]
        assert [(p["x"], p["y"]) for p in got] == [(0.0, 1.5), (2.0, 3.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 50), float(i % 30), float(i % 90), float(i % 360)) for i in range(500)], "fid long, easting double, northing double, dip double, dip_dir double")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = streaming_average(stream, 0.0, 0.0, 10.0).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    run.processAllAvailable()
    run.stop()
    want = points.grid_average(rows, 10.0)
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, want.select("easting", "northing", "dip", "dip_dir", "n").collect()))


def test_polygons_and_parts_in_sinks(spark, tmp_path):
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    df = spark.createDataFrame([(1, [square(0, 9), square(2, 3)])], "fid long, geom array<array<struct<x:double,y:double>>>")
    for shape, name in (("Polygon", "POLYGON"), ("LineString", "MULTILINESTRING")):
        for kind in ("csv", "geojson"):
            path = f"{tmp_path}/{shape}-{kind}"
            layers.write_layer(df, path, kind, shape=shape)
            got = layers.read_layer(spark, path, kind).first()
            assert [[(p["x"], p["y"]) for p in part] for part in got["parts"]] == [[(p["x"], p["y"]) for p in part] for part in (square(0, 9), square(2, 3))]
            text = spark.read.text(path).where(f"value like '%{name}%' or value like '%\"{'Multi' if shape == 'LineString' else ''}{shape}\"%'")
            assert text.count() == 1


def test_shapefile(spark, tmp_path):
    import struct

    def record(n, body):
        return struct.pack(">2i", n, len(body) // 2) + body

    line = struct.pack("<i4d2i2i", 3, 0, 0, 3, 3, 2, 4, 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 2.5)
    body = record(1, line) + record(2, struct.pack("<i", 0)) + record(3, struct.pack("<i2d", 1, 7.5, 8.0))
    header = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    (tmp_path / "faults.shp").write_bytes(header + body)
    (tmp_path / "other.shp").write_bytes(header + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    rows = b"".join(b" " + t.ljust(6) for t in (b"one", b"", "zwö".encode()))
    (tmp_path / "faults.dbf").write_bytes(struct.pack("<4BIHH", 3, 1, 1, 1, 3, 32 + 32 + 1, 7) + b"\0" * 20 + field + b"\r" + rows)
    got = sorted(layers.read_layer(spark, f"{tmp_path}/faults.shp", "shapefile").collect(), key=lambda r: r["fid"])
    assert [[[(p["x"], p["y"]) for p in part] for part in r["parts"]] for r in got] == [[[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 2.5)]], [], [[(7.5, 8.0)]]]
    assert [r["properties"]["NAME"] for r in got] == ["one", None, "zwö"] and got[1]["geom"] is None
    assert layers.read_layer(spark, str(tmp_path), "shapefile").count() == 6
