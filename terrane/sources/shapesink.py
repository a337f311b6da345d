"""A Spark sink for ESRI shapefiles: each task writes files of bounded size under a name of its
own, which the driver moves into the folder when all tasks are done."""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, Row, ShortType, StructType

#: Fixed values of the format: shape types, longest field name and text, file code and version.
NULL, LINE, POLYGON = 0, 3, 5
NAME, TEXT = 10, 254
CODE, VERSION = 9994, 1000
#: Records and bytes of geometry that a task holds before it writes a file.
MOST_RECORDS, MOST_BYTES = 50_000, 64 << 20


def field_names(names: list[str]) -> list[str]:
    """Names of at most ten characters, all different: later ones of a kind get a number in place of their end."""
    out: list[str] = []
    for name in names:
        short, k = name[:NAME], 1
        while short.lower() in (o.lower() for o in out):
            short, k = f"{name[: NAME - 1 - len(str(k))]}_{k}", k + 1
        out.append(short)
    return out


def shape(value, kind: int) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """The content of a record and its box. value: vertices, parts, or members of rings; of rings
    the first of each member turns clockwise, the others the other way, as the format asks."""
    if value is None:
        return struct.pack("<i", NULL), None
    if kind == POLYGON:
        members = value if value and value[0] and isinstance(value[0][0], (list, tuple)) and not hasattr(value[0][0], "x") else [value] if value and not hasattr(value[0], "x") else [[value]]
        parts = [_turned([(p["x"], p["y"]) for p in ring], k == 0) for rings in members for k, ring in enumerate(rings)]
    else:
        parts = [[(p["x"], p["y"]) for p in part] for part in (value if value and not hasattr(value[0], "x") else [value])]
    parts = [p for p in parts if p]
    if not parts:
        return struct.pack("<i", NULL), None
    points = [p for part in parts for p in part]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box, starts, at = (min(xs), min(ys), max(xs), max(ys)), [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    flat = [c for p in points for c in p]
    return struct.pack(f"<i4d2i{len(starts)}i{len(flat)}d", kind, *box, len(parts), len(points), *starts, *flat), box


def _turned(ring: list[tuple[float, float]], clockwise: bool) -> list[tuple[float, float]]:
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring if (twice < 0) == clockwise else ring[::-1]


def files(shapes: list[tuple[bytes, tuple | None]], kind: int) -> tuple[bytes, bytes]:
    """The bytes of .shp and .shx."""
    boxes = [b for _, b in shapes if b]
    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
    head = lambda size: struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, kind, *box, 0, 0, 0, 0)
    main, index, at = [], [], 100
    for k, (content, _) in enumerate(shapes):
        main += [struct.pack(">2i", k + 1, len(content) // 2), content]
        index.append(struct.pack(">2i", at // 2, len(content) // 2))
        at += 8 + len(content)
    return head(at) + b"".join(main), head(100 + 8 * len(index)) + b"".join(index)


def table(rows: list[tuple], schema: StructType) -> bytes:
    """The bytes of .dbf. Whole and decimal numbers, booleans and dates keep their kind, all else
    is text, cut to 254 bytes between characters. Null is blank."""
    kinds, columns = [], list(zip(*rows)) if rows else [() for _ in schema]
    for field, values in zip(schema, columns):
        t = field.dataType
        if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
            kinds.append((b"N", 20, 0, [b"" if v is None else str(v).encode() for v in values]))
        elif isinstance(t, (FloatType, DoubleType)):
            kinds.append((b"F", 24, 15, [b"" if v is None else repr(float(v)).encode() for v in values]))
        elif isinstance(t, BooleanType):
            kinds.append((b"L", 1, 0, [b"?" if v is None else b"T" if v else b"F" for v in values]))
        elif isinstance(t, DateType):
            kinds.append((b"D", 8, 0, [b"" if v is None else v.strftime("%Y%m%d").encode() for v in values]))
        else:
            texts = [b"" if v is None else str(v).encode()[:TEXT].decode(errors="ignore").encode() for v in values]
            kinds.append((b"C", max([1, *map(len, texts)]), 0, texts))
    names = field_names([f.name for f in schema])
    today, width = datetime.date.today(), 1 + sum(w for _, w, _, _ in kinds)
    head = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), 33 + 32 * len(kinds), width)
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:NAME], k, w, d) for n, (k, w, d, _) in zip(names, kinds))
    body = [b" " + b"".join(v[i].rjust(w) if k in (b"N", b"F") else v[i].ljust(w) for k, w, _, v in kinds) for i in range(len(rows))]
    return head + fields + b"\r" + b"".join(body) + b"\x1a"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.geom = options["path"], options.get("geom", "geom")
        self.kind = POLYGON if options.get("shape", "LineString") == "Polygon" else LINE
        self.schema = StructType([f for f in schema if f.name != self.geom])
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = self._store()
        store.create_dir(f"{folder}/{self.pending}", recursive=True)
        task = TaskContext.get()
        base, names, shapes, rows, size = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", [], [], [], 0

        def flush() -> None:
            name = f"{base}-{len(names):04d}"
            main, index = files(shapes, self.kind)
            for end, data in (("shp", main), ("shx", index), ("dbf", table(rows, self.schema))):
                with store.open_output_stream(f"{folder}/{self.pending}/{name}.{end}") as out:
                    out.write(data)
            names.append(name)

        for row in iterator:
            shapes.append(shape(row[self.geom], self.kind))
            rows.append(tuple(row[f.name] for f in self.schema))
            size += len(shapes[-1][0])
            if len(rows) >= MOST_RECORDS or size >= MOST_BYTES:
                flush()
                shapes, rows, size = [], [], 0
        if rows:
            flush()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = self._store()
        for name in (n for m in messages if m is not None for n in m.names):
            for end in ("dbf", "shx", "shp"):  # the file that readers look for comes last
                store.move(f"{folder}/{self.pending}/{name}.{end}", f"{folder}/{name}.{end}")
        self._drop(store, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(*self._store())

    def _drop(self, store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{folder}/{self.pending}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.pending}")


class ShapefileSink(DataSource):
    """format("shapefile_sink"), mode append. Options: geom (name of the geometry column), shape (LineString or Polygon)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_sink"

    def schema(self) -> str:
        return "fid long"  # written only

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("shapefiles are added to a folder; write to a new one instead")
        return _Writer(self.options, schema)
