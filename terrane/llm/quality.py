"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAMES = (
    "log_bytes", "log_words", "upper", "digit", "space", "newline", "symbol", "exclaim", "stop", "comma", "pipe", "high",
    "word_mean", "word_sd", "distinct", "top_word", "same_as_before", "caps_words", "mixed_words", "line_repeat", "words_per_line", "bigram_repeat",
)
_CLASS = np.zeros((256, 10), np.float32)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[32, 9, 13], 2] = 1
_CLASS[10, 3] = 1
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]=+\\/_`"], 4] = 1
_CLASS[ord("!"), 5] = 1
_CLASS[[ord("."), ord("?")], 6] = 1
_CLASS[[ord(","), ord(";"), ord(":")], 7] = 1
_CLASS[ord("|"), 8] = 1
_CLASS[128:, 9] = 1


def _distinct(group: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each group, and the count of the most frequent."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]))))
    top = np.zeros(n)
    np.maximum.at(top, g[new], np.diff(np.append(new, len(g))))
    return np.bincount(g[new], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) transformed statistics of whole texts; all finite, also for empty ones."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    hashes, first, last, firsts, flat = common.words(data, offsets)
    starts = offsets + np.arange(n + 1)
    by_class = np.stack([np.add.reduceat(_CLASS[:, c][flat], starts[:-1]) for c in range(_CLASS.shape[1])], 1)
    by_class[:, 2] -= 1  # the space that padding adds
    n_words = np.diff(firsts)
    doc = np.repeat(np.arange(n), n_words)
    length = (last - first).astype(np.float64)
    w = np.maximum(n_words, 1)
    mean = np.bincount(doc, length, n) / w
    sd = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / w - mean**2, 0))
    distinct, top = _distinct(doc, hashes, n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    upper = np.concatenate(([0.0], np.cumsum(_CLASS[:, 0][flat])))
    caps = (upper[last] - upper[first]) >= np.maximum(2, 0.6 * length)
    odd = np.concatenate(([0.0], np.cumsum((_CLASS[:, 1] + _CLASS[:, 4] + _CLASS[:, 5] + _CLASS[:, 8])[flat])))
    mixed = (odd[last] - odd[first]) > 0
    pairs = common.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[doc[1:] == doc[:-1]]
    pair_doc = doc[1:][doc[1:] == doc[:-1]]
    n_pairs, _ = _distinct(pair_doc, pairs, n)
    at = np.flatnonzero(flat == 10)
    line_first = np.unique(np.concatenate((starts[:-1], at + 1)))
    line_first = line_first[line_first < starts[-1]]
    line_doc = np.searchsorted(starts, line_first, "right") - 1
    line_end = np.append(line_first[1:], starts[-1]) - 1
    prefix = common.prefix_hash(flat)
    n_lines = np.bincount(line_doc, minlength=n)
    lines, _ = _distinct(line_doc, common.span_hash(prefix, line_first, np.maximum(line_end, line_first)), n)
    rate = np.sqrt(np.maximum(by_class, 0) / np.maximum(size, 1)[:, None])
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), rate, np.log1p(mean), np.log1p(sd), distinct / w, np.sqrt(top / w), np.sqrt(np.bincount(doc, again, n) / w),
        np.sqrt(np.bincount(doc, caps, n) / w), np.sqrt(np.bincount(doc, mixed, n) / w), 1 - lines / np.maximum(n_lines, 1), np.log1p(n_words / np.maximum(n_lines, 1)),
        1 - n_pairs / np.maximum(np.bincount(pair_doc, minlength=n), 1),
    ])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x array<double> for every row of docs; narrow, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = common.column_of(batch, "doc_id")
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                x = statistics(data, offsets)
                rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), rows], ["doc_id", "x"])

    return common.texts(docs).mapInArrow(run, "doc_id long, x array<double>")


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of factor z = b for a lower triangular factor."""
    z = np.empty_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Per class: mean, Cholesky factor of the shrunk covariance, log prior; and a scale of the log odds."""

    means: np.ndarray
    factors: np.ndarray
    priors: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            z = _forward(factor, (x - mean).T)
            out.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(0))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(x) + self.shift, -35, 35)))


def shrink(n: np.ndarray, total: np.ndarray, square: np.ndarray, to_pooled: float = 0.2, to_sphere: float = 0.05) -> Discriminant:
    """From counts, sums and sums of products of each class: covariances pulled
    to the pooled one, then each to a multiple of the standardised identity."""
    p = total.shape[1]
    means = total / np.maximum(n, 1)[:, None]
    own = np.stack([square[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = own.sum(0) / max(n.sum() - 2, 1)
    unit = np.maximum(np.diag(pooled), 1e-6)
    factors = []
    for k in (0, 1):
        weight = max(to_pooled, p / (n[k] + p))  # few rows: nearer to the pooled one
        cov = (1 - weight) * own[k] / max(n[k] - 1, 1) + weight * pooled
        factors.append(np.linalg.cholesky((1 - to_sphere) * cov + to_sphere * np.diag(unit)))
    return Discriminant(means, np.stack(factors), np.log((n + 1) / (n.sum() + 2)))


def fit(rows: DataFrame) -> Discriminant:
    """rows: x, label 0/1. Moments are summed in tasks, then by class: all rows
    count and only 2 x p x p numbers reach the driver. A class without rows
    leaves a model that scores every text by the prior."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(NAMES)
        n, total, square = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
        for batch in batches:
            x = common.column_of(batch, "x").flatten().to_numpy().reshape(-1, p)
            label = common.column_of(batch, "label").to_numpy()
            for k in (0, 1):
                own = x[label == k]
                n[k] += len(own)
                total[k] += own.sum(0)
                square[k] += own.T @ own
        flat = np.concatenate([np.concatenate(([n[k]], total[k], square[k].ravel())) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "v"])

    p = len(NAMES)
    got = rows.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * (1 + p + p * p))
    for r in got:
        flat[r["at"]] = r["v"]
    flat = flat.reshape(2, -1)
    n, total, square = flat[:, 0], flat[:, 1 : 1 + p], flat[:, 1 + p :].reshape(2, p, p)
    if n.min() == 0:
        return Discriminant(np.zeros((2, p)), np.stack([np.eye(p)] * 2), np.log((n + 1) / (n.sum() + 2)))
    model = shrink(n, total, square)
    model.scale = 0.5  # correlated statistics make the plain log odds too sure
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from labelled rows outside the held-out split. Null text counts as
    empty; empty texts get the model's score of an empty text. A repeated row
    gives a repeated result; labels that are null or neither 0 nor 1 are left out,
    and an id labelled twice counts twice. Empty tables: an empty result.
    Whole texts of any length are used; other columns of the table are not read, whatever their names."""
    x = common.materialize(features(docs), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (common.split_of(F.col("doc_id"), modulus) != 0))
    model = fit(x.join(known, "doc_id").select("x", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = common.column_of(batch, "x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([common.column_of(batch, "doc_id"), pa.array(model.score(rows) if len(rows) else [], pa.float64())], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.split_of(F.col("doc_id"), modulus) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; cases as in classify()."""
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
