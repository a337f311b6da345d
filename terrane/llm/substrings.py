"""Repeated substrings: every byte covered by a string of `length` bytes that
also starts anywhere else in the collection.

Column-wise construction over whole documents needs one pass over the transform
of the whole collection for each byte of its longest document; see the README.
Here it runs where strings may repeat and differ, on short aligned pieces:

1. Anchors. Of each window of `length` bytes the k-byte string with the least
   hash is its anchor, so equal windows have equal anchors at equal places.
   Windows whose anchor is unique in the collection cannot repeat.
2. Contexts. An anchor that repeats is looked at with all the bytes its windows
   reach. Where the whole context repeats as well, all its windows do.
3. Columns. What is left lies near the ends of repeated passages. The different
   contexts of an anchor, aligned at it, are a collection whose suffixes are
   sorted column by column: each round inserts one symbol for each context and
   updates the order (the transform) and the common prefixes of neighbours. A
   window repeats if it shares `length` symbols with a neighbour of its column.

Windows of one context start within `length` bytes of each other, so only its
first and last repeated window matter. Strings are compared by 64-bit hashes.
Counts are summed before the shuffle; an anchor with very many contexts leaves
the grouped path and is counted window by window, so nothing hot meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string, of an anchor; window starts of a document that are handled at once.
LENGTH, ANCHOR, CHUNK = 400, 64, 1 << 22
#: Contexts of one group, and of one anchor beyond which it is counted window by window.
GROUP, HOT = 2000, 20_000


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i: the better of a block's suffix and the next block's prefix."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    wide = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    wide[: len(x)] = x
    wide = wide.reshape(-1, width)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    back = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(prefix: np.ndarray, lo: int, hi: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows inside bytes lo..hi of the hashed slice: place of
    each (from lo), and the first and last window start that it serves. Of equal
    strings in a window the leftmost is the anchor."""
    n = hi - lo
    at = np.arange(lo, hi - k + 1)
    h = common.span_hash(prefix, at, at + k)
    order = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_minimum(order, length - k + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return (least[first] & np.uint64((1 << 28) - 1)).astype(np.int64), first, np.append(first[1:], n - length + 1) - 1


def occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    """One row for each anchor of each document: key, anchor, context (hashes), place, first, last (window starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = common.column_of(batch, "key").to_numpy()
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                prefix = common.prefix_hash(data)
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for i in np.flatnonzero(np.diff(offsets) >= length):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    for at in range(begin, end - length + 1, CHUNK):
                        p, first, last = anchors(prefix, at, min(end, at + CHUNK + length - 1), length, k)
                        anchor = common.span_hash(prefix, at + p, at + p + k)
                        context = common.mix(common.span_hash(prefix, at + first, at + last + length) * np.uint64(3) + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        for column, values in zip(out, (np.full(len(p), keys[lo + i]), anchor.view(np.int64), context.view(np.int64), p + at - begin, first + at - begin, last + at - begin)):
                            column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "anchor", "context", "place", "first", "last"])

    return docs.mapInArrow(run, "key long, anchor long, context long, place long, first long, last long")


def _contexts(involved: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of each involved context, cut from its document."""
    wanted = involved.groupBy("key").agg(F.collect_list(F.struct("anchor", "context", "n", "contexts", "place", "first", "last")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "n", "contexts", "place", "first", "last"]
        for batch in batches:
            keys, text, parts = (common.column_of(batch, c) for c in ("key", "text", "parts"))
            for i in range(len(keys)):
                raw = text[i].as_buffer()
                view = memoryview(raw)
                rows = parts[i].as_py()
                columns = [[r[c] for r in rows] for c in names]
                cut = [bytes(view[r["first"] : r["last"] + length]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i].as_py()] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(cut, pa.binary())], ["key", *names, "bytes"])

    return docs.join(wanted, "key").select("key", "text", "parts").mapInArrow(run, "key long, anchor long, context long, n long, contexts long, place long, first long, last long, bytes binary")


def repeated_columns(contexts: list[bytes], before: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts aligned so that before[i] bytes of each precede the anchor:
    the first and last window (from the context's start) that another context
    repeats, or -1.

    Column-wise: from the last column to the first, all contexts insert their
    symbol before what they have; `order` then lists their suffixes sorted and
    `common` how many symbols each shares with the one before it. A stable sort
    of the old order by the new symbols is the new order, and two neighbours of
    one symbol share one more than the least shared between them before."""
    left = length - k  # the most that can precede an anchor
    size = np.array([len(c) for c in contexts])
    n, width = len(contexts), left + length
    symbols = np.zeros((width, n), np.uint16)  # 0: no symbol, equal to nothing
    flat = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    row = np.repeat(np.arange(n), size)
    symbols[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + (left - before)[row], row] = flat
    order, common_ = np.arange(n), np.zeros(n + 1, np.int32)
    first, last = np.full(n, -1), np.full(n, -1)
    windows = size - length
    for column in range(width - 1, -1, -1):
        s = symbols[column][order]
        sort = np.argsort(s, kind="stable")
        order, s = order[sort], s[sort]
        pair = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] > 0))
        new = np.zeros(n + 1, np.int32)
        if len(pair):
            new[pair + 1] = np.minimum.reduceat(common_, np.stack((sort[pair] + 1, sort[pair + 1] + 1), 1).ravel())[::2] + 1
        common_ = new
        if column <= left:
            hit = order[np.maximum(common_[:-1], common_[1:]) >= length]
            at = column - left + before[hit]
            hit, at = hit[(at >= 0) & (at <= windows[hit])], at[(at >= 0) & (at <= windows[hit])]
            first[hit] = at
            last[hit] = np.maximum(last[hit], at)
    return first, last


def _windows(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of each context, and the context's place in rows."""
    size = rows["bytes"].str.len().to_numpy()
    starts = np.concatenate(([0], np.cumsum(size)))
    prefix = common.prefix_hash(np.frombuffer(b"".join(rows["bytes"]), np.uint8))
    n = size - length + 1
    row = np.repeat(np.arange(len(rows)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = (rows["place"] - rows["first"]).to_numpy()[row] - at  # from the window to the anchor
    key = common.mix(rows["anchor"].to_numpy(np.int64).view(np.uint64))[row] ^ shift.astype(np.uint64)
    return common.mix(common.span_hash(prefix, starts[row] + at, starts[row] + at + length) + common.mix(key)), row


def covered(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """key, start, end: byte ranges of docs (key, text) whose union is all that repeats."""
    found = common.materialize(occurrences(docs, length, k), "substring-anchors")
    # a context's only row, if it has one, is its least
    contexts = common.materialize(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "first", "last")).alias("one")).select("anchor", "context", "n", "one.*"), "substring-contexts")
    twice = contexts.where("n > 1").select("anchor", "context")
    whole = found.join(twice, ["anchor", "context"], "left_semi").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    mixed = contexts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("anchor", "contexts")
    cut = common.materialize(_contexts(contexts.join(mixed, "anchor"), docs, length), "substring-bytes")
    schema = "key long, start long, end long"

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "context"]).reset_index(drop=True)
        first, last = repeated_columns(list(rows["bytes"]), (rows["place"] - rows["first"]).to_numpy(), length, k)
        hit = np.flatnonzero((first >= 0) & (rows["n"] == 1).to_numpy())
        start = rows["first"].to_numpy()[hit]
        return pd.DataFrame({"key": rows["key"].to_numpy()[hit], "start": start + first[hit], "end": start + last[hit] + length})

    few = cut.where(F.col("contexts") <= hot)
    groups = few.count() // GROUP + 1
    near = few.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("g")).applyInPandas(compare, schema)
    out = whole.union(near)
    if contexts.join(mixed.where(F.col("contexts") > hot), "anchor", "left_semi").take(1):
        out = out.union(_hot(cut.where(F.col("contexts") > hot).dropDuplicates(["anchor", "context"]), length))
    return out


def _hot(cut: DataFrame, length: int) -> DataFrame:
    """As the grouped path, for anchors with very many contexts: windows are
    rows, counted by hash with partial sums, and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                rows = batch.slice(lo, GROUP).to_pandas()
                h, row = _windows(rows, length)
                n = np.bincount(row, minlength=len(rows))
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + rows["first"].to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rows["key"].to_numpy()[row]), pa.array(rows["anchor"].to_numpy()[row]), pa.array(rows["n"].to_numpy()[row]), pa.array(at)], ["h", "key", "anchor", "n", "at"])

    windows = common.materialize(cut.mapInArrow(run, "h long, key long, anchor long, n long, at long"), "substring-windows")
    repeated = windows.groupBy("h").count().where("count > 1").select("h")
    # a context's windows start within `length` of each other: bins of that size keep its ends apart from other contexts of the key
    hit = windows.where("n = 1").join(repeated, "h", "left_semi").groupBy("key", "anchor", F.floor(F.col("at") / length)).agg(F.min("at").alias("start"), (F.max("at") + length).alias("end"))
    return hit.select("key", "start", "end")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of ranges; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[new], ends[np.append(new[1:], len(ends)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each maximal removed run), kept
    (remaining bytes) for every row of docs.

    Texts are UTF-8 bytes (null: empty); no string spans two documents, and all
    are judged on the input. Texts shorter than length lose nothing; repeated
    rows count as two documents. Empty tables: an empty result.
    Whole texts of any length are used; other columns of the table are not read, whatever their names."""
    keyed = common.texts(docs).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    ranges = common.materialize(covered(keyed, length, k, hot), "substring-ranges")
    of_key = ranges.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, text, ranges = (common.column_of(batch, c) for c in ("doc_id", "text", "ranges"))
            for lo, hi, data, offsets in common.slices(text):
                n, spans, kept = [], [], []
                for i in range(lo, hi):
                    raw = data[offsets[i - lo] : offsets[i - lo + 1]]
                    n.append(len(raw))
                    if not ranges[i].is_valid:
                        spans.append([])
                        kept.append(raw.tobytes())
                        continue
                    both = ranges[i].values
                    starts, ends = merged(both.field("start").to_numpy(), both.field("end").to_numpy())
                    stay = np.ones(len(raw), bool)
                    for a, b in zip(starts, ends):
                        stay[a:b] = False
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)])
                    kept.append(raw[stay].tobytes())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return keyed.join(of_key, "key", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of what each document keeps; cases as in remove_repeats()."""
    out = remove_repeats(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
