"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that are fitted on, at most (by a hash of the id), and entries of the lexicon.
MOST_ROWS, MOST_ENTRIES = 10_000, 4096
#: Byte lengths of the word beginnings that may stand in the lexicon beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself ur u tu te toi vous votre vos du dich dir dein deine ihr euch sie usted ustedes tú ti vosotros".split()
NAMES = ("log_words", "density", "strong_density", "distinct_hits", "top", "second", "third", "mean_hit", "log_hits", "near_person", "person", "caps", "exclaim", "punct", "obfuscated", "high_bytes")


def _hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return common.words(raw, np.array([0, len(raw)]))[0][0]


_PERSON = np.sort(np.array([_hash(w) for w in SECOND_PERSON], np.uint64))


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _bare(first: np.ndarray, last: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Ends of words without the punctuation that follows them."""
    last = last.copy()
    for _ in range(4):
        c = flat[last - 1]
        last[((c < 48) | ((c > 57) & (c < 65))) & (last - first > 1)] -= 1
    return last


def _forms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Words (start, bare end, row), their forms' hashes (whole; beginnings, 0 where the word is shorter), padded bytes."""
    _, first, last, firsts, flat = common.words(data, offsets)
    last = _bare(first, last, flat)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    prefix = common.prefix_hash(flat, True)
    whole = common.span_hash(prefix, first, last)
    parts = [np.where(last - first > k, common.mix(common.span_hash(prefix, first, np.minimum(first + k, last)) + np.uint64(k)), np.uint64(0)) for k in BEGINNINGS]
    return first, last, doc, [whole, *parts], flat


def lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log odds of the word forms that mark label 1 in sample (doc_id, text, label): from how many
    documents of each class hold them; counts are summed within a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = common.column_of(batch, "label").to_numpy()
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                _, _, doc, forms, _ = _forms(data, offsets)
                keys, rows = np.concatenate(forms), np.tile(doc, len(forms))
                rows, keys = rows[keys != 0], keys[keys != 0]
                order = np.lexsort((rows, keys))
                keys, rows = keys[order], rows[order]
                once = np.ones(len(keys), bool)
                once[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                keys, toxic = keys[once], labels[lo:hi][rows[once]]
                key, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, toxic, len(key)).astype(np.int64)), pa.array(np.bincount(at, 1 - toxic, len(key)).astype(np.int64))], ["key", "yes", "no"])

    counts = sample.mapInArrow(run, "key long, yes long, no long").groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    n = sample.agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).first()
    if not n["yes"] or not n["no"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    odds = F.log((F.col("yes") + 0.25) / (n["yes"] + 0.5)) - F.log((F.col("no") + 0.25) / (n["no"] + 0.5))
    # weighed by how often it is seen: a word of one document says little
    kept = counts.where("yes >= 3").withColumn("odds", odds * F.col("yes") / (F.col("yes") + 3)).where("odds > 0.9")
    rows = kept.orderBy(F.desc(F.col("odds") * F.sqrt("yes")), "key").limit(MOST_ENTRIES).select("key", "odds").collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in rows], float)[order]


_UPPER = np.zeros(256, np.float32)
_UPPER[65:91] = 1
_PUNCT = np.zeros(256, np.float32)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = 1
_ODD = np.zeros(256, np.float32)  # what stands for letters in obfuscated words
_ODD[[ord(c) for c in "0134578@$*#!+"]] = 1


def dense(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)); finite for every text."""
    n = len(offsets) - 1
    first, last, doc, forms, flat = _forms(data, offsets)
    starts = offsets + np.arange(n + 1)
    size = np.maximum(np.diff(offsets), 1)
    per_byte = lambda table: np.add.reduceat(table[flat], starts[:-1]) / size
    weight = np.zeros(len(first))
    if len(keys):
        whole, at, back = np.unique(forms[0], return_index=True, return_inverse=True)
        best = np.zeros(len(whole))
        for form in forms:
            place = _member(keys, form[at])
            best = np.maximum(best, np.where(place >= 0, odds[place], 0.0))
        weight = best[back]
    n_words = np.maximum(np.bincount(doc, minlength=n), 1)
    hit = weight > 0
    strong = weight > 2.0
    hits = np.bincount(doc, hit, n)
    top = np.zeros((n, 3))
    if hit.any():
        h_doc, h_w, h_key = doc[hit], weight[hit], forms[0][hit]
        order = np.lexsort((h_key, -h_w, h_doc))
        h_doc, h_w, h_key = h_doc[order], h_w[order], h_key[order]
        new = np.ones(len(h_doc), bool)
        new[1:] = (h_doc[1:] != h_doc[:-1]) | (h_key[1:] != h_key[:-1])
        h_doc, h_w = h_doc[new], h_w[new]
        rank = np.arange(len(h_doc)) - np.searchsorted(h_doc, h_doc)
        top[h_doc[rank < 3], rank[rank < 3]] = h_w[rank < 3]
        different = np.bincount(h_doc, minlength=n)
    else:
        different = np.zeros(n)
    person = _member(_PERSON, forms[0]) >= 0
    near = np.zeros(len(first), bool)
    for step in range(1, 6):
        same = doc[step:] == doc[:-step]
        near[step:] |= person[:-step] & same
        near[:-step] |= person[step:] & same
    odd = np.concatenate(([0.0], np.cumsum(_ODD[flat])))
    upper = np.concatenate(([0.0], np.cumsum(_UPPER[flat])))
    inner = np.maximum(last - 1, first + 1)
    obfuscated = (odd[inner] - odd[np.minimum(first + 1, inner)]) > 0
    return np.column_stack([
        np.log1p(np.bincount(doc, minlength=n)), hits / n_words, np.bincount(doc, strong, n) / n_words, np.log1p(different), top,
        np.bincount(doc, weight, n) / np.maximum(hits, 1), np.log1p(np.bincount(doc, strong, n)), np.bincount(doc, near & hit, n) / n_words, np.bincount(doc, person, n) / n_words,
        np.bincount(doc, (upper[last] - upper[first]) > np.maximum(1, 0.6 * (last - first)), n) / n_words, per_byte(np.where(np.arange(256) == 33, 1.0, 0.0)), per_byte(_PUNCT), np.bincount(doc, obfuscated, n) / n_words, per_byte(np.where(np.arange(256) > 127, 1.0, 0.0)),
    ])


@dataclass
class Trees:
    """Boosted trees for the log odds, splits on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, int, int, float]]] = field(default_factory=list)  # feature, bin, left, right, value
    base: float = 0.0
    steps_x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps_y: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 1), int)
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            table = np.array([n[:4] for n in nodes], int)
            at = np.zeros(len(x), int)
            while True:
                inner = table[at, 0] >= 0
                if not inner.any():
                    break
                f, b = table[at, 0], table[at, 1]
                down = np.where(bins[np.arange(len(x)), np.maximum(f, 0)] <= b, table[at, 2], table[at, 3])
                at = np.where(inner, down, at)
            out += np.array([n[4] for n in nodes])[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not len(self.steps_x):
            return 1 / (1 + np.exp(-raw))
        return np.interp(raw, self.steps_x, self.steps_y)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, ridge: float = 2.0, least: int = 5) -> Trees:
    """Second-order boosting with histogram splits; ties go to the first feature and bin."""
    model = Trees(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)], 1)
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[int, int, int, int, float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            value = rate * sum_g / (sum_h + ridge)
            nodes.append((-1, 0, 0, 0, value))
            best = (1e-3, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                for j in range(x.shape[1]):
                    c = code[rows, j]
                    size = len(model.edges[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[rows], h[rows], None))
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] < 0:
                f[rows] += value
                return me
            go = code[rows, best[1]] <= best[2]
            left, right = grow(rows[go], level + 1), grow(rows[~go], level + 1)
            nodes[me] = (best[1], best[2], left, right, 0.0)
            return me

        grow(np.arange(len(y)), 0)
        model.trees.append(nodes)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw scores and their calibrated values, at block centres."""
    xs, at = np.unique(raw, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []
    for x, w, t in zip(xs, weight, total):
        blocks.append([x * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rows = np.array(blocks)
    return rows[:, 0] / rows[:, 1], (rows[:, 2] + 0.02) / (rows[:, 1] + 0.04)


@dataclass
class Model:
    keys: np.ndarray
    odds: np.ndarray
    trees: Trees


def _features(rows: DataFrame, keys: np.ndarray, odds: np.ndarray, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [common.column_of(batch, c) for c in ("doc_id", *more)]
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                x = dense(data, offsets, keys, odds)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in kept), lists], ["doc_id", *more, "x"])

    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{c} int, " for c in more) + "x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5) -> Model:
    """Fits on a bounded sample of labelled rows: MOST_ROWS of each class by a
    hash of the id, outside the held-out split. Half of it finds the lexicon,
    half fits the trees, so that a word's own rows don't vouch for it; a quarter
    of the latter calibrates. A sample with one class scores all by the prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (common.split_of(F.col("doc_id"), modulus) != 0))
    key = F.xxhash64("doc_id")
    picked = known.where("label = 1").orderBy(key).limit(MOST_ROWS).union(known.where("label = 0").orderBy(key).limit(MOST_ROWS))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(8)).cast("int")
    # at most 2 x MOST_ROWS ids, so the broadcast is bounded and no text is shuffled
    sample = common.materialize(common.texts(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", part.alias("part")), "toxicity-sample")
    keys, odds = lexicon(sample.where("part < 4"))
    rows = _features(sample.where("part >= 4"), keys, odds, "label", "part").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(NAMES))
    y, part_of = np.array([r["label"] for r in rows], float), np.array([r["part"] for r in rows], int)
    order = np.argsort(np.array([r["doc_id"] for r in rows], np.int64), kind="stable")
    x, y, part_of = x[order], y[order], part_of[order]
    if len(np.unique(y)) < 2:
        return Model(keys, odds, Trees(base=-6.0))
    fit = part_of < 7
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[~fit])) < 2 or (~fit).sum() < 30:
        return Model(keys, odds, boost(x, y))
    trees = boost(x[fit], y[fit])
    trees.steps_x, trees.steps_y = isotonic(trees.raw(x[~fit]), y[~fit])
    return Model(keys, odds, trees)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of docs; null text counts as empty."""
    keys, odds, trees = model.keys, model.odds, model.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = common.column_of(batch, "doc_id")
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                got = np.clip(trees.score(dense(data, offsets, keys, odds)), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(got)], ["doc_id", "score"])

    return common.texts(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null text counts as
    empty; empty texts get a score as well; repeated rows give repeated results;
    unlabelled tables give low scores; empty tables an empty result.
    Whole texts of any length are used; other columns of the table are not read, whatever their names."""
    scored = score(docs, train(docs, labels, label, modulus))
    return scored.select("doc_id", (common.split_of(F.col("doc_id"), modulus) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches threshold; same columns."""
    model = train(docs, labels)
    keys, odds, trees, schema = model.keys, model.odds, model.trees, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = common.column_of(batch, "text").fill_null("")
            toxic = [trees.score(dense(data, offsets, keys, odds)) >= threshold for _, _, data, offsets in common.slices(column)]
            yield batch.filter(pa.array(~np.concatenate(toxic))) if toxic else batch

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; cases as in classify()."""
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
