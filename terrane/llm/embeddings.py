"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Width of a quantised projection of unit vectors, recall at the threshold, rows of a block.
WIDTH, RECALL, BLOCK = 2.0, 0.995, 512


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one Gaussian projection puts two points at this distance into one cell."""
    x = width / distance
    below = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def parameters(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections of a table so that a vector meets about one unrelated vector
    of n in it, and tables so that a pair at the threshold meets in one with the given chance."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2.0))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _hashes(x: np.ndarray, k: int, tables: int, seed: int = 5) -> np.ndarray:
    """(rows, tables) bucket keys of unit vectors."""
    rng = np.random.default_rng([seed, x.shape[1], k, tables])
    axes, shift = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, WIDTH, tables * k)
    # one component after another: a matrix product may round by the number of rows, and a key must not depend on that
    at = np.tile(shift, (len(x), 1))
    for j in range(x.shape[1]):
        at += x[:, j, None] * axes[j]
    cells = np.floor(at / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    h = np.tile(common.salts(61, tables), (len(x), 1))
    for j in range(k):
        h = common.mix(h * np.uint64(31) + cells[:, :, j])
    return h


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key (digest of the vector), v (unit vector as doubles; null
    for a vector that is null, empty, zero, or holds null or non-finite components)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = common.column_of(batch, "embedding")
            out, keys = [], []
            for i in range(len(column)):
                value = column[i]
                x = np.array(value.as_py() if value.is_valid and value.values.null_count == 0 else [], float)
                scale = np.abs(x).max(initial=0.0)
                if not len(x) or not np.isfinite(x).all() or scale == 0:
                    out.append(None)
                    keys.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()))
                x = x / scale
                out.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([common.column_of(batch, "vec_id"), common.column_of(batch, "label"), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "label", "key", "v"])

    # exact double components: a float widened to double is the same number
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, key binary, v binary")


def _first_meeting(x: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Of pairs (i, j) found in a table, those that share no bucket of an earlier one: each link is counted in one table only."""
    keep = np.ones(len(i), bool)
    rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    h = _hashes(x[rows], k, tables) if len(rows) else np.zeros((0, tables), np.uint64)
    left, right = at[: len(i)], at[len(i) :]
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        earlier = np.arange(tables)[None, :] < table[b, None]
        keep[b] = ~((h[left[b]] == h[right[b]]) & earlier).any(1)
    return keep


def _pairs_of_blocks(x: np.ndarray, block: np.ndarray, a: int, b: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    hit = (x[left] @ x[right].T) >= cosine
    if a == b:
        hit &= np.triu(np.ones(hit.shape, bool), 1)
    i, j = np.nonzero(hit)
    return left[i], right[j]


def _pairs_of_small(x: np.ndarray, bucket: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal buckets, by distance of the rows."""
    found, step = [], 1
    while step < len(x):
        i = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(i):
            break
        found.append(np.stack((i, i + step))[:, np.einsum("ij,ij->i", x[i], x[i + step]) >= cosine])
        step += 1
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, int), np.zeros(0, int))


def _spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of edges that keep the components of a block's link graph."""
    label, kept = {}, []

    def root(x: int) -> int:
        while label.setdefault(x, x) != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for e, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            label[b] = a
            kept.append(e)
    return np.array(kept, np.int64)


def links(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """(id, n_links, other): per block and class, how many rows it links with
    there; and, with n_links 0, the edges of a forest that joins what is linked.

    classes: id, label, size, v. Buckets of one class are left out before any
    vector moves. A bucket's classes are dealt to blocks of about BLOCK rows,
    each pair of blocks a group of its own, however large the bucket; pairs
    within a group are counted there and never leave it."""
    k, tables = parameters(n, cosine)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, labels = (common.column_of(batch, c).to_pylist() for c in ("id", "v", "label"))
            by_size: dict[int, list[int]] = {}
            for at, r in enumerate(raw):
                by_size.setdefault(len(r), []).append(at)
            for rows in by_size.values():
                for lo in range(0, len(rows), BLOCK):
                    part = rows[lo : lo + BLOCK]
                    h = _hashes(np.stack([np.frombuffer(raw[a]) for a in part]), k, tables)
                    own = np.array([hash_label(labels[a]) for a in part], np.uint64)
                    h = common.mix(h ^ own[:, None] ^ np.uint64(len(raw[part[0]])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([ids[a] for a in part], tables), pa.int64()), pa.array(np.tile(np.arange(tables), len(part)), pa.int32()), pa.array(h.ravel().view(np.int64))], ["id", "table", "bucket"]
                    )

    dealt = common.materialize(classes.mapInArrow(deal, "id long, table int, bucket long"), "embedding-buckets")
    sized = dealt.groupBy("table", "bucket").count().where("count > 1")
    members = common.materialize(dealt.join(sized, ["table", "bucket"]), "embedding-members")
    vectors = classes.select("id", "size", "v")

    def result(ids: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        name, at = np.unique(ids, return_inverse=True)
        count = np.bincount(at[i], size[j], len(name)) + np.bincount(at[j], size[i], len(name))
        some, edge = np.flatnonzero(count), _spanning(at[i], at[j])
        return pd.DataFrame({
            "id": np.concatenate((name[some], ids[i[edge]])).astype(np.int64),
            "n_links": np.concatenate((count[some], np.zeros(len(edge)))).astype(np.int64),
            "other": np.concatenate((name[some], ids[j[edge]])).astype(np.int64),
        })

    def compare(rows: pd.DataFrame, pairs, *more) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby(rows["v"].str.len()):  # vectors of one length
            x = np.stack([np.frombuffer(r) for r in own["v"]])
            i, j = pairs(x, own, *more)
            keep = _first_meeting(x, i, j, own["table"].to_numpy()[i], k, tables)
            found.append(result(own["id"].to_numpy(), own["size"].to_numpy(), i[keep], j[keep]))
        return pd.concat(found)

    def small(rows: pd.DataFrame) -> pd.DataFrame:
        return compare(rows.sort_values(["table", "bucket", "id"]), lambda x, own: _pairs_of_small(x, common.mix(own["bucket"].to_numpy().view(np.uint64) + own["table"].to_numpy().astype(np.uint64)), cosine))

    def large(key: tuple[int, int, int, int], rows: pd.DataFrame) -> pd.DataFrame:
        return compare(rows.sort_values("id"), lambda x, own: _pairs_of_blocks(x, own["block"].to_numpy(), key[2], key[3], cosine))

    groups = members.count() // (4 * BLOCK) + 1
    few = members.where(F.col("count") <= BLOCK).select("id", "table", "bucket", F.pmod(F.xxhash64("table", "bucket"), F.lit(groups)).alias("group"))
    many = members.where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = many.select("*", other).select("id", "table", "bucket", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    schema = "id long, n_links long, other long"
    return few.join(vectors, "id").groupBy("group").applyInPandas(small, schema).union(paired.join(vectors, "id").groupBy("table", "bucket", "a", "b").applyInPandas(large, schema))


def hash_label(label: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(label.encode())


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    Only vectors of one label (not null) and one length are compared. Equal
    vectors of a label are one class with its number of rows, so copies never
    make pairs: a row links with the other rows of its class and all rows of
    linked classes. A vector that is null, empty, zero, or holds null or
    non-finite components links with nothing. vec_id is expected to be unique.
    Empty tables: an empty result. Other columns are not read, whatever their names."""
    units = common.materialize(unit_vectors(vectors), "embedding-units")
    usable = units.where(F.col("v").isNotNull() & F.col("label").isNotNull())
    classes = common.materialize(usable.groupBy("label", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v")), "embedding-classes")
    found = common.materialize(links(classes, classes.count(), cosine), "embedding-links")
    counts = found.where("n_links > 0").groupBy("id").agg(F.sum("n_links").alias("linked"))
    components = common.connected_components(found.where("n_links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("label", "key", "id", "size").join(counts, "id", "left").join(components, "id", "left").select("label", "key", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.least("id", F.coalesce("component", "id")).alias("c"))
    out = units.select("vec_id", "label", "key").join(of_class, ["label", "key"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within a label at cosine 0.93; cases as in near_duplicates()."""
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
