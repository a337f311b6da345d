"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens of a sequence, sequences of a mixture window, queues whose sizes every task
#: holds (more are joined, with the same layout), rows up to which a table is broadcast.
SEQUENCE, WINDOW, HELD_QUEUES, MOST_BROADCAST = 1024, 64, 256, 200_000
#: The id after each document.
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- tokens
def _byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks, if the file is plain byte-level BPE whose ids follow the order of its merges; else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type") not in (None, "BPE") or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    at = sorted(i for b, i in ranks.items() if len(b) > 1)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merged = [ranks.get(bytes(chars[c] for c in a + b)) for a, b in merges]
    return ranks if merged == at and sum(len(b) == 1 for b in ranks) == 256 else None


#: White space in a row from which a text goes to the file's own library: the faster one
#: keeps a step back for each of its characters and runs out of stack from about a million.
LONG_GAP = 100_000


class Encoder:
    """Ids of texts by a tokenizer file, its added tokens included. Plain byte-level
    BPE runs through a faster library with the same ranks, which like the file's own
    first splits a text at added tokens; anything else through the file's own."""

    #: Fixed value: how byte-level BPE splits text into words.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, content: str):
        self._own = None
        spec = json.loads(content)
        ranks, added = _ranks(spec), spec.get("added_tokens") or []
        names = [t["content"] for t in added]
        plain = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) and not any(a != b and a in b for a in names for b in names)
        if ranks is not None and plain:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

            def encode(text: str) -> list[int]:
                if len(text) > LONG_GAP and any(m.end() - m.start() > LONG_GAP for m in re.finditer(r"\s\s+", text)):
                    return self.own(content).encode(text, add_special_tokens=False).ids
                return own.encode(text, allowed_special="all") if any(n in text for n in names) else own.encode_ordinary(text)

            self.encode = encode
        else:
            self.encode = lambda text: self.own(content).encode(text, add_special_tokens=False).ids

    def own(self, content: str):
        """The file's own library, loaded when first needed."""
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_str(content)
        return self._own


_encoders: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, queue, part, before, n, ids (little-endian unsigned 32 or 16 bits),
    written to the shared folder. before: ids of the queue that precede the
    document within its task's part."""
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    width = np.uint16 if len(json.loads(content)["model"]["vocab"]) < 1 << 16 else np.uint32
    held = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, gone = encoder(held.value).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, text, queue = (common.column_of(batch, c) for c in ("doc_id", "text", "queue"))
            for lo, hi, _, _ in common.slices(text):
                out, n, before = [], [], []
                for i in range(lo, hi):
                    q = queue[i].as_py()
                    got = np.array([*encode(text[i].as_py()), END_ID], width)
                    out.append(got.tobytes())
                    n.append(len(got))
                    before.append(gone.get(q, 0))
                    gone[q] = before[-1] + len(got)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), queue.slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "queue", "part", "before", "n", "ids"],
                )

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    named = common.texts(docs, source.alias("queue"))
    return common.materialize(named.mapInArrow(run, "doc_id long, queue string, part int, before long, n long, ids binary"), "packing-tokens")


# ---------------------------------------------------------------- layout
def _curve(ends: list[tuple[float, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Times, and the ids that all queues have given by then, of queues that end at these times: (end, ids, weight)."""
    at, size, weight = (np.array(c, float) for c in zip(*sorted(ends)))
    left = weight.sum() - np.concatenate(([0.0], np.cumsum(weight)[:-1]))
    done = np.concatenate(([0.0], np.cumsum(size)[:-1]))
    return np.concatenate(([0.0], at)), np.concatenate(([0.0], done + left * at))


def _rounded(end: float) -> float:
    """An end time to 12 bits, so that any number of queues has few different ones."""
    step = 2.0 ** (np.floor(np.log2(end)) - 11)
    return float(np.floor(end / step + 0.5) * step)


def _rounded_column(end: Column) -> Column:
    step = F.pow(F.lit(2.0), F.floor(F.log2(end)) - 11)
    return F.floor(end / step + 0.5) * step


@dataclass
class Layout:
    """Where each id of each queue goes, in closed form, so that windows need
    not be filled one after another.

    At time t queue s has given min(size_s, floor(weight_s * t)) ids; what the
    floor holds back is its deficit, carried to the next window. Window w ends
    at the time when all queues together have given about w * tokens ids (a curve
    through few points), so an empty queue's share goes to the others in proportion.
    Inside a window the queues follow each other by name. Any task can place any document."""

    times: np.ndarray
    given: np.ndarray
    total: int
    tokens: int
    sequence: int

    @property
    def windows(self) -> int:
        return max(1, -(-self.total // self.tokens))

    def time(self, w: np.ndarray) -> np.ndarray:
        """When window w begins; after the last one all is given."""
        t = np.interp(np.minimum(w, self.windows) * float(self.tokens), self.given, self.times)
        return np.where(w >= self.windows, np.inf, t)

    def taken(self, size: np.ndarray | int, weight: np.ndarray | float, w: np.ndarray) -> np.ndarray:
        """Ids that queues of these sizes and weights have given before window w."""
        return np.minimum(size, np.floor(weight * np.minimum(self.time(w), 1e300))).astype(np.int64)

    def window_of(self, size: int, weight: float, at: int) -> int:
        """The window that holds id `at` of a queue."""
        low, high = 0, self.windows - 1
        near = int(np.interp(at / weight, self.times, self.given) // self.tokens)
        if 0 < near < self.windows - 1:
            a = self.taken(size, weight, np.arange(near - 1, near + 3))
            if a[0] <= at < a[-1]:
                return near - 1 + int(np.searchsorted(a, at, "right")) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.taken(size, weight, np.array([mid]))[0] <= at:
                low = mid
            else:
                high = mid - 1
        return low

    def shares(self, size: int, weight: float, start: int, n: int) -> list[tuple[int, int, int, int]]:
        """(window, start in the document, length, place among the queue's ids of the window) of ids start..start + n of a queue."""
        first, last = self.window_of(size, weight, start), self.window_of(size, weight, start + n - 1)
        taken = self.taken(size, weight, np.arange(first, last + 2))
        out = []
        for k in range(last - first + 1):
            a, b = max(start, int(taken[k])), min(start + n, int(taken[k + 1]))
            if a < b:
                out.append((first + k, a - start, b - a, a - int(taken[k])))
        return out

    def cut(self, a: int, n: int, at: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset): n ids from place `at` on, cut at the ends of sequences."""
        out = []
        while n:
            size = min(n, self.sequence - at % self.sequence)
            out.append((a, size, at // self.sequence, at % self.sequence))
            a, n, at = a + size, n - size, at + size
        return out


_PIECES = "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _ids(raw: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw.size == 2 * n else np.uint32).astype("<u4")


def _batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], most: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, whose last column is bytes: `most` bytes or one row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held), schema)], [n for n, _ in schema])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held), schema)], [n for n, _ in schema])


_ARROW = [("doc_id", pa.int64()), ("queue", pa.string()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())]


def _place_held(placed: DataFrame, layout: Layout, queues: list[str], sizes: np.ndarray, weights: np.ndarray) -> DataFrame:
    """Pieces, where every task holds all queues' sizes."""
    number = {q: i for i, q in enumerate(queues)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            begins: dict[int, list[int]] = {}  # where each queue begins in a window
            for batch in batches:
                doc_id, queue, n, at = (common.column_of(batch, c).to_pylist() for c in ("doc_id", "queue", "n", "at"))
                ids = common.column_of(batch, "ids")
                for i in range(len(doc_id)):
                    s, own = number[queue[i]], _ids(ids[i].as_buffer(), n[i])
                    for w, a, k, into in layout.shares(int(sizes[s]), float(weights[s]), at[i], n[i]):
                        if w not in begins:
                            if len(begins) > 4096:
                                begins.clear()
                            before, after = layout.taken(sizes, weights, np.array([w])), layout.taken(sizes, weights, np.array([w + 1]))
                            begins[w] = (before.sum() + np.cumsum(after - before) - (after - before)).tolist()
                        for b, size, sequence, offset in layout.cut(a, k, begins[w][s] + into):
                            yield doc_id[i], queue[i], b, size, n[i], sequence, offset, own[b : b + size].tobytes()

        yield from _batches(rows(), _ARROW, common.SLICE_BYTES)

    return placed.mapInArrow(run, _PIECES)


def _place_joined(placed: DataFrame, layout: Layout, stats: DataFrame) -> DataFrame:
    """The same pieces where the queues are too many for that: documents are cut
    at windows by their own queue's size, what each queue has in each window is
    summed, and running sums over range partitions say where it begins."""
    from terrane.operators.graphs import cut

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                doc_id, queue, n, at, size, weight = (common.column_of(batch, c).to_pylist() for c in ("doc_id", "queue", "n", "at", "size", "weight"))
                ids = common.column_of(batch, "ids")
                for i in range(len(doc_id)):
                    own = _ids(ids[i].as_buffer(), n[i])
                    for w, a, k, into in layout.shares(size[i], weight[i], at[i], n[i]):
                        yield doc_id[i], queue[i], w, a, k, into, n[i], own[a : a + k].tobytes()

        kinds = [("doc_id", pa.int64()), ("queue", pa.string()), *((c, pa.int64()) for c in ("window", "a", "k", "into", "n")), ("ids", pa.binary())]
        yield from _batches(rows(), kinds, common.SLICE_BYTES)

    stats = F.broadcast(stats) if stats.count() <= MOST_BROADCAST else stats
    shares = common.materialize(placed.join(stats, "queue").mapInArrow(split, "doc_id long, queue string, window long, a long, k long, into long, n long, ids binary"), "packing-shares")
    held = cut(shares.groupBy("window", "queue").agg(F.sum("k").alias("k")).repartitionByRange("window", "queue").withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window

    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("part").agg(F.sum("k").alias("k")).select("part", F.coalesce(F.sum("k").over(up_to), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("window", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.join(F.broadcast(parts), "part").select("window", "queue", (F.col("before") + F.coalesce(F.sum("k").over(inside), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                doc_id, queue, a, k, into, base, n = (common.column_of(batch, c).to_pylist() for c in ("doc_id", "queue", "a", "k", "into", "base", "n"))
                ids = common.column_of(batch, "ids").to_pylist()
                for i in range(len(doc_id)):
                    for b, size, sequence, offset in layout.cut(a[i], k[i], base[i] + into[i]):
                        yield doc_id[i], queue[i], b, size, n[i], sequence, offset, ids[i][4 * (b - a[i]) : 4 * (b - a[i] + size)]

        yield from _batches(rows(), _ARROW, common.SLICE_BYTES)

    return shares.join(bases, ["window", "queue"]).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, mixture: dict[str, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """Pieces of every document: doc_id, queue, start, length, doc_tokens,
    sequence_id, offset, ids (little-endian unsigned 32 bits).

    mixture: weights of the sources (default: their shares of all ids; sources
    that it leaves out get the least weight named). Every window of about `window`
    sequences holds each queue's share to within one id, until a queue is empty.
    Every source has a queue of its own, however many there are. All sequences
    but the last are full. Null text: only the end id. Null source or no such
    column: one queue, named by the empty text. Repeated rows are packed each. Very
    long texts are cut where sequences end. Empty table: no pieces."""
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer or default_tokenizer())
    parts = common.materialize(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "packing-parts")
    stats = common.materialize(parts.groupBy("queue").agg(F.sum("n").alias("size")), "packing-queues")
    total = stats.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], _PIECES)
    named = {q: float(w) for q, w in (mixture or {}).items() if w > 0}
    known = spark.createDataFrame(list(named.items()) or [("", 0.0)], "queue string, weight double")
    if named:
        weight = F.coalesce("weight", F.lit(min(named.values())))
        rest = stats.join(F.broadcast(known.select("queue")), "queue", "left_anti").groupBy("size").agg(F.count("*").alias("n"))
        # by size: few rows once ends are rounded
        ends = [(r["end"], r["ids"], r["w"]) for r in rest.withColumn("end", _rounded_column(F.col("size") / min(named.values()))).groupBy("end").agg(F.sum(F.col("size") * F.col("n")).alias("ids"), (F.sum("n") * min(named.values())).alias("w")).collect()]
        ends += [(_rounded(r["size"] / r["weight"]), r["size"], r["weight"]) for r in stats.join(F.broadcast(known), "queue").collect()]
        times, given = _curve(ends)
        given = given * (total / given[-1])
    else:
        weight, times, given = F.col("size") / total, np.array([0.0, total]), np.array([0.0, total])
    stats = stats.join(F.broadcast(known), "queue", "left").withColumn("weight", weight) if named else stats.withColumn("weight", weight)
    layout = Layout(times, given, total, window * sequence, sequence)

    # where each task's part of a queue starts; narrow rows, one for each queue and task
    from pyspark.sql import Window

    running = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    if parts.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", "n", (F.col("base") + F.col("before")).alias("at"), "ids")
    some = sorted((r["queue"], r["size"], r["weight"]) for r in stats.limit(HELD_QUEUES + 1).collect())
    if len(some) > HELD_QUEUES:
        return _place_joined(placed, layout, stats.select("queue", "size", "weight"))
    queues, sizes, weights = zip(*some)
    return _place_held(placed, layout, list(queues), np.array(sizes, np.int64), np.array(weights, float))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids. crc32 of Spark reads the same bytes."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024; cases as in pack(). Rows with a null doc_id are packed under a null id."""
    return digests(pack(common.read(spark, sf_dir, "documents")))
