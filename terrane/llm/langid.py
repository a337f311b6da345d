"""Language ID: nearest clustered centroid over TF-IDF vectors of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hashed dimensions, n-gram lengths in bytes, centroids of a language, and sampled rows of a language at most.
DIMENSIONS, LENGTHS, CENTROIDS, MOST_ROWS = 4096, (1, 2, 3), 4, 400
#: Rows that are held as dense vectors at once.
BLOCK = 256
#: Fixed value: the answer for a text that is null or has no letter.
NONE = "und"

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_FOLD[65:91] += 32
_WEIGHT = common.salts(23, 3)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, DIMENSIONS) counts of hashed byte n-grams; A-Z fold to a-z, other
    ASCII than letters to one space. Runs of spaces count as they are."""
    n = len(offsets) - 1
    flat, starts = common.padded(data, offsets, 2)
    code = _FOLD[flat]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts)) * DIMENSIONS
    out = np.zeros(n * DIMENSIONS)
    key = np.zeros(len(code), np.uint64)
    for k in LENGTHS:
        key[: len(code) - k + 1] += code[k - 1 :] * _WEIGHT[k - 1] if len(code) >= k else 0
        slot = ((key + np.uint64(k)) * common.salts(29, 1)[0] >> np.uint64(52)).astype(np.int64) % DIMENSIONS
        out += np.bincount(row + slot, minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for lo, hi, data, offsets in common.slices(common.column_of(batch, "text"), common.SLICE_BYTES // 2):
        for a in range(0, hi - lo, BLOCK):
            b = min(a + BLOCK, hi - lo)
            yield lo + a, lo + b, counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other, ties to the first."""
    centres = [v.mean(0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin((v @ np.array(centres).T).max(1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    lang_of: np.ndarray  # of each centroid
    least: np.ndarray  # of each language: the cosine under which a text is rejected


def train(docs: DataFrame, modulus: int = 5) -> Model:
    """Document frequencies come from all training rows; centroids from MOST_ROWS
    rows of each language at most, taken by a hash of the id. Training rows are
    those with a language and outside the held-out split."""
    known = common.texts(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (common.split_of(F.col("doc_id"), modulus) != 0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS + 1), 0
        for batch in batches:
            for lo, hi, tf in _blocks(batch):
                df[:-1] += (tf > 0).sum(0)
                n += hi - lo
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1), pa.int32()), pa.array(df)], ["at", "df"])

    df = np.zeros(DIMENSIONS + 1)
    for r in known.select("text").mapInArrow(frequencies, "at int, df double").groupBy("at").agg(F.sum("df").alias("df")).collect():
        df[r["at"]] = r["df"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.05

    # the first rows of each language by a hash: a share of twice as many as are wanted, cut exactly;
    # the counts, a row for each language where the model has CENTROIDS vectors, are broadcast, so that only that share is dealt by language
    counted = known.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    known_ids = known.select("doc_id", "lang").join(F.broadcast(counted), "lang").where(share * F.col("rows") <= 2 * MOST_ROWS + 50)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known_ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= MOST_ROWS).select("doc_id", "lang")
    picked = common.materialize(picked.distinct(), "langid-sample")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = common.column_of(batch, "lang")
            for lo, hi, tf in _blocks(batch):
                v = vectors(tf, idf).astype(np.float32)
                yield pa.RecordBatch.from_arrays([lang.slice(lo, hi - lo), pa.array([r.tobytes() for r in v], pa.binary())], ["lang", "v"])

    def centroids(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.frombuffer(b, np.float32) for b in sorted(rows["v"])]).astype(float)
        c = _cluster(v, CENTROIDS)
        near = (v @ c.T).max(1)
        least = max(0.0, float(np.quantile(near, 0.005)) - 2 * float(near.std()))
        return pd.DataFrame({"lang": [key[0]] * len(c), "centre": [r.astype(np.float32).tobytes() for r in c], "least": [least] * len(c)})

    taken = known.join(picked, ["doc_id", "lang"], "left_semi").mapInArrow(sample, "lang string, v binary")
    got = sorted(taken.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, least double").collect(), key=lambda r: (r["lang"], bytes(r["centre"])))
    langs = sorted({r["lang"] for r in got})
    return Model(
        idf, langs, np.stack([np.frombuffer(r["centre"], np.float32) for r in got]).astype(float) if got else np.zeros((0, DIMENSIONS)),
        np.array([langs.index(r["lang"]) for r in got], int), np.array([next(r["least"] for r in got if r["lang"] == x) for x in langs]),
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs. Null texts and
    texts without a letter, and all texts if no language was learned: und, 0,
    rejected. A text farther from its centroid than the sample's rows were is
    marked rejected and its score halved. Ties go to the first language by name."""
    idf, langs, centres, lang_of, least = model.idf, model.langs, model.centres, model.lang_of, model.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, letter = common.column_of(batch, "doc_id"), common.column_of(batch, "letter").to_numpy(zero_copy_only=False)
            for lo, hi, tf in _blocks(batch):
                cosine = vectors(tf, idf) @ centres.T
                best = np.zeros((hi - lo, max(len(langs), 1)))
                for j in range(len(langs)):
                    best[:, j] = np.clip(cosine[:, lang_of == j].max(1), 0, 1)
                at = best.argmax(1)
                top = best[np.arange(hi - lo), at]
                sharp = best**8
                score = np.where(top > 0, sharp[np.arange(hi - lo), at] / np.maximum(sharp.sum(1), 1e-300), 0.0)
                far = top < least[at] if langs else np.ones(hi - lo, bool)
                out = letter[lo:hi] & bool(langs)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([langs[a] if ok else NONE for a, ok in zip(at, out)], pa.string()), pa.array(np.where(out, np.where(far, score / 2, score), 0.0)), pa.array(far | ~out)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return common.texts(docs, letter).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs.

    Learns from rows with a language outside the held-out split; a table without
    any gives und throughout. Null and empty texts, and those without a letter: und,
    0. Very long texts count whole. Repeated rows give repeated results and count
    twice in what is learned; other columns, whatever their names, are left behind. Empty table: no rows."""
    got = predict(docs, train(docs, modulus))
    return got.select("doc_id", (common.split_of(F.col("doc_id"), modulus) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; cases as in identify()."""
    return identify(common.read(spark, sf_dir, "documents"))
