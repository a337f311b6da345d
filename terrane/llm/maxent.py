"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

A word is reached by choices among at most 33 children: P(word | context) is the
product of P(child | node, context) on its way. The most frequent words stand in
classes by rank, one choice of the class and one of the word. The last class holds
all others, however many: its words, the unseen one included, are dealt to groups
by hash, reached digit by digit through classes of 32, and in its group a word has
its smoothed share of counts. The number of levels follows the vocabulary. All
choices are softmaxes, linear in hashed features of the two words before: the
word before, the pair, and the word before that alone (skip).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Classes and words of a class, rounds of averaged updates, words of a batch, step size.
CLASSES, SIZE, ROUNDS, BATCH, STEP = 32, 32, 2, 8192, 0.08
#: Bits of hashed features, and levels of groups by hash: at least and at most (they follow the vocabulary).
BITS, LEVELS = (14, 16), (1, 2)
#: Features of choices below the root: the word before and the pair.
BELOW = 2
#: Most frequent words whose counts every task holds; all others are joined.
HELD = 300_000
#: Rows of weights that travel together, deltas summed by one group.
ROWS, FAN_IN = 512, 64
#: Bytes of a word of text, about.
BYTES = 6
#: Additive smoothing of counts.
ALPHA = 0.1

_END = common.salts(71, 3)[0]
_START = common.salts(71, 3)[1]
_TEMPLATE = common.salts(73, 3)
_NEVER = -1e4


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each row and one end after them, where each row starts (n + 1), the row of each token."""
    hashes, _, _, firsts, _ = common.words(data, offsets)
    n = len(offsets) - 1
    starts = firsts + np.arange(n + 1)
    row = np.repeat(np.arange(n), np.diff(starts))
    out = np.full(starts[-1], _END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(firsts))] = hashes
    return out, starts, row


def count(docs: DataFrame) -> DataFrame:
    """token, c over all rows of docs (doc_id, text); summed in slices and in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.slices(common.column_of(batch, "text"), 4 * common.SLICE_BYTES):
                key, c = np.unique(tokens(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], ["token", "c"])

    return docs.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Head words, priors and weights. A head word's rank gives its class and place.

    Nodes below the root: one for each class of head words, then the levels of groups."""

    total: int  # training tokens
    types: int
    bits: int
    levels: int
    head: np.ndarray  # sorted hashes
    rank: np.ndarray  # of each
    count: np.ndarray  # of each
    class_prior: np.ndarray  # (CLASSES + 1)
    node_prior: np.ndarray  # (nodes, SIZE)
    group_mass: np.ndarray  # smoothed count of each group
    class_weights: np.ndarray
    node_weights: np.ndarray

    @property
    def mass(self) -> float:
        return self.total + ALPHA * (self.types + 1)

    def target(self, token: np.ndarray) -> np.ndarray:
        """Rank of each token among the head words, or -1."""
        if not len(self.head):
            return np.full(len(token), -1)
        at = np.minimum(np.searchsorted(self.head, token), len(self.head) - 1)
        return np.where(self.head[at] == token, self.rank[at], -1)

    def group(self, token: np.ndarray) -> np.ndarray:
        return group_of(token, self.levels)

    def steps(self, token: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The choices below the root: place among the tokens, node, child."""
        head, tail = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        at, node, child = [head], [rank[head] // SIZE], [rank[head] % SIZE]
        group, first = self.group(token[tail]), CLASSES
        for level in range(self.levels):
            way = group // SIZE ** (self.levels - level)
            at.append(tail)
            node.append(first + way)
            child.append(group // SIZE ** (self.levels - level - 1) % SIZE)
            first += SIZE**level
        return np.concatenate(at), np.concatenate(node), np.concatenate(child)


def group_of(token: np.ndarray, levels: int) -> np.ndarray:
    """Group of a word: SIZE ** levels of them, by hash."""
    return (common.mix(token + _TEMPLATE[0]) % np.uint64(SIZE**levels)).astype(np.int64)


def start(counts: DataFrame) -> Model:
    """A model of word frequencies: all weights zero. At most HELD words and
    SIZE ** 2 group sums reach the driver. Head words are the most frequent ones;
    where nearly all words are equally frequent, there are fewer."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    bits = int(np.clip(np.floor(np.log2(max(v, 2))) - 2, *BITS))
    levels = int(np.clip(np.round(np.log(max(v, 2) / SIZE) / np.log(SIZE)), *LEVELS))
    top = common.frequent(counts, "c", HELD).toArrow()
    c = top["c"].to_numpy()
    best = np.lexsort((top["token"].to_numpy(), -c))[: CLASSES * SIZE]
    words, c = top["token"].to_numpy()[best].view(np.uint64), c[best]
    share = np.full(CLASSES * SIZE, 0.0)
    share[: len(c)] = c + ALPHA
    share = share.reshape(CLASSES, SIZE)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(SIZE**levels)
        for batch in batches:
            token, c = common.column_of(batch, "token").to_numpy().view(np.uint64), common.column_of(batch, "c").to_numpy()
            rare = ~np.isin(token, words)
            mass += np.bincount(group_of(token[rare], levels), c[rare] + ALPHA, len(mass))
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mass[some])], ["g", "mass"])

    group_mass = np.full(SIZE**levels, ALPHA)  # of each group's unseen word
    for r in counts.mapInArrow(sums, "g long, mass double").groupBy("g").agg(F.sum("mass").alias("mass")).collect():
        group_mass[r["g"]] += r["mass"]
    with np.errstate(divide="ignore"):
        by_class = np.append(share.sum(1), group_mass.sum())
        class_prior = np.maximum(np.log(by_class / by_class.sum()), _NEVER)
        rows = [np.maximum(np.log(share / np.maximum(share.sum(1, keepdims=True), 1e-9)), _NEVER)]
        for level in range(levels):
            below = group_mass.reshape(SIZE**level, SIZE, -1).sum(2)
            rows.append(np.log(below / below.sum(1, keepdims=True)))
    order = np.argsort(words)
    d = 1 << bits
    return Model(n, v, bits, levels, words[order], order, c[order], class_prior.astype(np.float32), np.concatenate(rows).astype(np.float32), group_mass, np.zeros((d, CLASSES + 1), np.float32), np.zeros((d, SIZE), np.float32))


def _features(token: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(3, len(token)) hashed contexts."""
    before, skip = np.empty_like(token), np.empty_like(token)
    before[1:], skip[2:] = token[:-1], token[:-2]
    first = starts[:-1]
    before[first] = _START
    skip[first] = _START
    second = first + 1
    skip[second[second < starts[1:]]] = _START
    return np.stack((common.mix(before + _TEMPLATE[0]), common.mix(before * np.uint64(31) + skip + _TEMPLATE[1]), common.mix(skip + _TEMPLATE[2])))


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Log probabilities."""
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits) @ np.ones((logits.shape[1], 1), logits.dtype))
    return logits


def _logits(prior: np.ndarray, weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    out = weights.take(slots[0], axis=0)
    out += prior
    for s in slots[1:]:
        out += weights.take(s, axis=0)
    return out


def _forward(model: Model, f: np.ndarray, token: np.ndarray, rank: np.ndarray) -> tuple:
    """Log probabilities of classes, and of children for each choice below, with the
    slots that made them: (class slots, by class), (place, child, slots, by child)."""
    slots = lambda h: (h >> np.uint64(64 - model.bits)).astype(np.uint16)
    top = slots(f)
    by_class = _softmax(_logits(model.class_prior, model.class_weights, top))
    at, node, child = model.steps(token, rank)
    low = slots(common.mix(f[:BELOW, at] + (node + 1).astype(np.uint64)))
    by_child = _softmax(_logits(model.node_prior.take(node, axis=0), model.node_weights, low))
    return (top, by_class), (at, child, low, by_child)


def _update(weights: np.ndarray, seen: np.ndarray, slots: np.ndarray, error: np.ndarray) -> None:
    """One AdaGrad step with a rate for each row of weights: gradients of a slot are summed first."""
    flat = slots.ravel()
    order = np.argsort(flat, kind="stable")
    rows = flat[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    order %= len(error)
    gradient = error.take(order[first], axis=0)
    size = np.diff(np.append(first, len(order)))
    several = size > 1  # most slots are met once, and need no sum
    if several.any():
        own = error.take(order[np.repeat(several, size)], axis=0)
        size = size[several]
        gradient[several] = np.add.reduceat(own, np.cumsum(size) - size, axis=0)
    rows = rows[first]
    seen[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
    gradient *= (STEP / np.sqrt(seen[rows] + 1e-3))[:, None]
    gradient += weights.take(rows, axis=0)
    weights[rows] = gradient


def train(docs: DataFrame, model: Model) -> Model:
    """Every round, each task walks its share of docs once from the common
    weights, batch by batch; the weights then move by the tasks' mean change,
    weighed by tokens. Each document is in one round. Changes are summed in
    groups of FAN_IN, level by level, so no group grows with the corpus, and the
    driver gets one model's worth of numbers. A task walks four times as many bytes
    of text as the model has (fewer only where cores would be idle), so that changes
    are at most about a quarter of the text."""
    spark = docs.sparkSession
    size = model.class_weights.nbytes + model.node_weights.nbytes
    tasks = max(spark.sparkContext.defaultParallelism, model.total * BYTES // (4 * size))
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            base = shared.value
            own = Model(**{**base.__dict__, "class_weights": base.class_weights.copy(), "node_weights": base.node_weights.copy()})
            seen = [np.zeros(1 << base.bits, np.float32), np.zeros(1 << base.bits, np.float32)]
            n = 0
            for batch in batches:
                for _, _, data, offsets in common.slices(common.column_of(batch, "text")):
                    token, starts, _ = tokens(data, offsets)
                    f, rank = _features(token, starts), own.target(token)
                    n += len(token)
                    for a in range(0, len(token), BATCH):
                        b = slice(a, a + BATCH)
                        (top, by_class), (_, child, low, by_child) = _forward(own, f[:, b], token[b], rank[b])
                        error = -np.exp(by_class)
                        error[np.arange(len(error)), np.where(rank[b] >= 0, rank[b] // SIZE, CLASSES)] += 1
                        _update(own.class_weights, seen[0], top, error)
                        error = -np.exp(by_child)
                        error[np.arange(len(error)), child] += 1
                        _update(own.node_weights, seen[1], low, error)
            part = TaskContext.get().partitionId()
            for which, (new, old) in enumerate(((own.class_weights, base.class_weights), (own.node_weights, base.node_weights))):
                for at in range(0, len(new) if n else 0, ROWS):
                    if not (new[at : at + ROWS] != old[at : at + ROWS]).any():
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([at], pa.int32()), pa.array([part], pa.int64()), pa.array([float(n)]), pa.array([((new[at : at + ROWS] - old[at : at + ROWS]) * n).tobytes()], pa.binary())], ["which", "at", "part", "n", "change"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(c, np.float32) for c in rows["change"]], axis=0, dtype=np.float64)
            return pd.DataFrame({"which": rows["which"][:1], "at": rows["at"][:1], "part": rows["part"][:1] // FAN_IN, "n": [rows["n"].sum()], "change": [total.astype(np.float32).tobytes()]})

        # rows that a task left alone count with its tokens all the same

        schema = "which int, at int, part long, n double, change binary"
        turn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS)) == number).select("text")
        changes, parts = turn.coalesce(tasks).mapInArrow(run, schema), tasks
        while parts > 1:
            changes, parts = changes.groupBy("which", "at", F.expr(f"part div {FAN_IN}").alias("of")).applyInPandas(add, schema), -(-parts // FAN_IN)
        class_weights, node_weights = model.class_weights.copy(), model.node_weights.copy()
        got = changes.collect()  # one model's worth
        shared.destroy()  # or each worker would keep every round's model
        walked = max((r["n"] for r in got), default=1.0)
        for r in got:
            into = (class_weights, node_weights)[r["which"]]
            change = np.frombuffer(r["change"], np.float32).reshape(-1, into.shape[1]) / max(walked, 1.0)
            into[r["at"] : r["at"] + len(change)] += change
        model = Model(**{**model.__dict__, "class_weights": class_weights, "node_weights": node_weights})
    return model


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Counts of head words and of about the HELD most frequent ones are in every task,
    all other words' are joined: those are rare, so the join has no hot key."""
    spark = docs.sparkSession
    top = common.frequent(counts, "c", HELD).toArrow()
    token, first = np.unique(np.concatenate((model.head, top["token"].to_numpy().view(np.uint64))), return_index=True)
    c = np.concatenate((model.count, top["c"].to_numpy()))[first]
    order = np.argsort(token)
    held = spark.sparkContext.broadcast((model, token[order], np.log10(c[order] + ALPHA)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, logs = held.value
        row_key = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = common.column_of(batch, "doc_id")
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                tok, starts, row = tokens(data, offsets)
                n = hi - lo
                f, rank = _features(tok, starts), model.target(tok)
                made = np.zeros(len(tok))
                for a in range(0, len(tok), BATCH):
                    b = slice(a, a + BATCH)
                    (_, by_class), (at, child, _, by_child) = _forward(model, f[:, b], tok[b], rank[b])
                    made[b] = by_class[np.arange(len(by_class)), np.where(rank[b] >= 0, rank[b] // SIZE, CLASSES)]
                    made[b] += np.bincount(at, by_child[np.arange(len(at)), child], len(by_class))
                different, back = np.unique(tok, return_inverse=True)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
                    known = keys[at] == different
                    value = np.where(known, logs[at], 0.0)
                else:
                    known, value = np.zeros(len(different), bool), np.zeros(len(different))
                known, value, tail = known[back], value[back], rank < 0
                made[tail] -= np.log(model.group_mass[model.group(tok[tail])])
                rare = np.flatnonzero(~known)
                lists = pa.ListArray.from_arrays(np.searchsorted(row[rare], np.arange(n + 1)).astype(np.int32), pa.array(tok[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row_key, row_key + n)), ids.slice(lo, n), pa.array(np.diff(starts)), pa.array(np.bincount(row, known, n).astype(np.int64)),
                        pa.array(np.bincount(row, value, n)), pa.array(np.bincount(row, np.where(tail, value, 0.0), n)), pa.array(np.bincount(row, made, n) / np.log(10)), lists,
                    ],
                    ["row", "doc_id", "n_tokens", "n_held", "log_all", "log_tail", "made", "rare"],
                )
                row_key += n

    parts = common.materialize(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, n_held long, log_all double, log_tail double, made double, rare array<long>"), "maxent-parts")
    rare = parts.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("log_rare"), F.count("c").alias("n_rare"))
    zero = F.lit(0.0)
    return parts.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_held") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("log_all") + F.coalesce("log_rare", zero) - F.col("n_tokens") * float(np.log10(model.mass))).alias("base_score"),
        (F.col("made") + F.col("log_tail") + F.coalesce("log_rare", zero)).alias("score"),
    )


def language_model(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns counts and weights from all rows outside the held-out split. Null
    text is empty: one end token. Repeated rows count and are scored each; with
    no training rows, every token is the unseen one. Empty table: no rows.
    Whole texts of any length are used; other columns of the table are not read, whatever their names."""
    held = common.texts(docs)
    known = held.where(common.split_of(F.col("doc_id"), modulus) != 0)
    counts = common.materialize(count(known), "maxent-counts")
    scored = score(held, counts, train(known, start(counts)))
    return scored.select("doc_id", (common.split_of(F.col("doc_id"), modulus) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; cases as in language_model()."""
    return language_model(common.read(spark, sf_dir, "documents"))
