"""Shared pieces of the corpus operators: written tables, byte-level text kernels
in numpy, and connected components by DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.graphs import components, cut

#: Bytes of text that a numpy kernel handles at once; a longer document is handled alone.
SLICE_BYTES = 1 << 19
#: Bits of the broadcast table of among(), 64 a row.
MARKS = 1 << 24

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------- the session
def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder (spark.checkpoint.dir) and read
    back: lineage is cut, and a lost executor costs no recomputation. name says what it is to a reader of the code."""
    return cut(df)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 marks the held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda h: ascii(h)::bigint)), lambda c, b: {bits}), 4294967295::bigint)"


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and whole text (null: empty) and the given columns only; other
    columns of docs, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


# ---------------------------------------------------------------- Arrow and bytes
def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column without nulls."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) so that a slice has about `most`
    bytes, or one longer row."""
    data, offs = arrow_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def padded(data: np.ndarray, offsets: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The rows with `gap` spaces after each, so that nothing spans two rows;
    offsets then give where each row starts (n + 1)."""
    sizes = np.diff(offsets)
    starts = np.concatenate(([0], np.cumsum(sizes + gap)))
    out = np.full(starts[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * gap, sizes)] = data
    return out, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def salts(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(_BASE))


_LETTER = salts(11, 256)
_LOWER = _LETTER.copy()
_LOWER[65:91] = _LETTER[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), np.uint64(_BASE if kind == "up" else _INVERSE))
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Running polynomial hash (n + 1), for span_hash."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER if fold_case else _LETTER)[data] * _power("up", len(data)))))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start..end; equal bytes give equal hashes wherever they stand."""
    inverse = _power("down", len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than gaps (\\x20 and \\x09-\\x0D), A-Z lower-cased.

    Gives each word's hash, its start and end among the padded bytes, the first
    word of each row (n + 1) and the padded bytes."""
    flat, starts = padded(data, offsets)
    inside = ~gaps[flat]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    first, last = edge[::2], edge[1::2]
    return span_hash(prefix_hash(flat, True), first, last), first, last, np.searchsorted(first, starts), flat


def frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """Of counts, the rows from that count on at which `most` are left at most, by a
    histogram of 16 bins an octave: no task and no driver sorts what is not wanted. If more
    rows than that share the topmost bin, the first `most` of them by count and then by the other columns."""
    octave = F.floor(F.log2(column) * 16).cast("int")
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(octave.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    left, least = 0, 0
    for b, n in bins:
        left += n
        if left > most:
            least = b + 1
            if b == bins[0][0]:
                return counts.where(octave == b).orderBy(F.desc(column), *(c for c in counts.columns if c != column)).limit(most)
            break
    return counts.where(octave >= least)


def among(rows: DataFrame, column: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows that a join of `column` (long) with the one column of ids may need, or if not inside those
    that it surely does not: whole texts are then exchanged for few others than the rows that such a join keeps.

    ids set bits in a broadcast table of MARKS bits at most, however many they are. Rows of an id are
    always inside; another row is where its hash meets a set bit, so an exact join has to follow."""
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(MARKS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (slot(c) % 64).cast("int"))
    word = lambda c: F.floor(slot(c) / 64)
    id_ = F.col(ids.columns[0])
    marks = ids.groupBy(word(id_).alias("__word")).agg(F.bit_or(bit(id_)).alias("__bits"))
    met = (word(rows[column]) == marks["__word"]) & (marks["__bits"].bitwiseAND(bit(rows[column])) != 0)
    return rows.join(F.broadcast(marks), met, "left_semi" if inside else "left_anti")


# ---------------------------------------------------------------- connected components
def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): each end of an edge (a, b) with the smallest id that it reaches."""
    return components(edges.where("a <> b"))
