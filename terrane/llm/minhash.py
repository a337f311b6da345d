"""MinHash near-dedup: chosen-path set similarity join.

Each of several independent trees branches the documents: a node names one or
two minhash positions, and a document goes to the child of each by its value
there, so that two documents of similarity s share a child with probability s.
Nodes of few documents are compared exhaustively; others branch again, down to
a fixed depth, where what is left together is near-identical and is compared in
blocks. Sketches pick candidates; links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Minhash positions, of which the first PATH_POSITIONS steer the trees; one bit of each makes the sketch.
POSITIONS, PATH_POSITIONS = 128, 64
#: Independent trees, rows of a node compared exhaustively, levels, rows of a block in nodes left at the last level.
TREES, SMALL, DEPTH, BLOCK = 16, 48, 5, 400
#: Sketch bits of 128 that agree, at least: 3.3 deviations below the mean at similarity 0.8.
AGREE = 104
#: Trees whose large nodes are compared before components are known; shingles of a block of full sets.
DENSE_TREES, MOST_WEIGHT = 3, 1_000_000

_SALT = common.salts(41, POSITIONS)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words, of the whole sequence; none for no words."""
    if not len(hashes):
        return hashes
    if len(hashes) < k:
        h = np.uint64(len(hashes))
        with np.errstate(over="ignore"):
            for w in hashes:
                h = common.mix(np.array([h * np.uint64(31) + w]))[0]
        return np.array([h], np.uint64)
    h = hashes[: len(hashes) - k + 1]
    for i in range(1, k):
        h = common.mix(h * np.uint64(31) + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(h)


def minima(s: np.ndarray) -> np.ndarray:
    """The minwise value of a set at each position."""
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096]
        for j in range(0, POSITIONS, 16):
            x = part[None, :] * _SALT[j : j + 16, None]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[j : j + 16] = np.minimum(out[j : j + 16], x.min(1))
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), sketch (two longs), path (16 bits of each steering minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = common.column_of(batch, "doc_id")
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                hashes, _, _, firsts, _ = common.words(data, offsets)
                n, key, bits, path = [], [], np.zeros((hi - lo, POSITIONS), np.uint8), np.zeros((hi - lo, PATH_POSITIONS), np.uint16)
                for i in range(hi - lo):
                    s = shingles(hashes[firsts[i] : firsts[i + 1]], k)
                    n.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if len(s):
                        m = common.mix(minima(s))
                        bits[i] = (m >> np.uint64(20)) & np.uint64(1)
                        path[i] = m[:PATH_POSITIONS] & np.uint64(0xFFFF)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array([p.tobytes() for p in path], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "s1", "s2", "path"],
                )

    return common.texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, s1 long, s2 long, path binary")


def _children(node: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (repeated) and child keys: one position for each node, for a quarter of the nodes a second one (1.25 = 1 / 0.8)."""
    h = common.mix(node * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
    first = (h % np.uint64(PATH_POSITIONS)).astype(np.int64)
    two = np.flatnonzero((h >> np.uint64(40)) & np.uint64(3) == 0)
    second = (first + 1 + ((h >> np.uint64(20)) % np.uint64(PATH_POSITIONS - 1)).astype(np.int64)) % PATH_POSITIONS
    rows = np.concatenate((np.arange(len(node)), two))
    at = np.concatenate((first, second[two]))
    value = path[rows, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(16))
    return rows, common.mix(node[rows] + common.mix(value + np.uint64(1)))


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """rows: id, path and, below the roots, node and tree; gives (node, tree, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = common.column_of(batch, "id").to_numpy()
            path = np.frombuffer(b"".join(common.column_of(batch, "path").to_pylist()), np.uint16).reshape(-1, PATH_POSITIONS)
            if level == 0:
                node, tree, at = np.tile(common.salts(53, TREES), len(ids)), np.tile(np.arange(TREES, dtype=np.int32), len(ids)), np.repeat(np.arange(len(ids)), TREES)
            else:
                node, tree, at = common.column_of(batch, "node").to_numpy().view(np.uint64), common.column_of(batch, "tree").to_numpy(), np.arange(len(ids))
            back, child = _children(node, path[at])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(tree[back]), pa.array(ids[at][back])], ["node", "tree", "id"])

    return rows.mapInArrow(run, "node long, tree int, id long")


def _bits(rows: pd.DataFrame) -> np.ndarray:
    """Sketches as rows of +1 and -1."""
    sketch = np.ascontiguousarray(rows[["s1", "s2"]].to_numpy(np.int64))
    return np.unpackbits(sketch.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch bits that each row of a has in common with each row of b."""
    return (a @ b.T + POSITIONS) / 2


def _dense(members: DataFrame) -> DataFrame:
    """Of nodes still large at the last level, each row's best partner in its own
    block and in the node's first block, so that a node costs rows in proportion to its
    size: a group is one block and the first, a row of which goes to every block."""
    sized = members.groupBy("node").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).select("node", "blocks")
    own = members.join(sized, "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = own.select("node", "id", "s1", "s2", "block", F.explode(meets).alias("at")).withColumn("g", F.struct("node", "at"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values("id")
        bits, ids, at = _bits(rows), rows["id"].to_numpy(), rows["at"].iloc[0]
        left = np.flatnonzero(rows["block"] == at)
        found = []
        for right in {at, 0}:
            right = np.flatnonzero(rows["block"] == right)
            if len(left) and len(right):
                m = np.where(ids[left][:, None] != ids[right][None, :], _agree(bits[left], bits[right]), 0)
                best = m.argmax(1)
                i = np.flatnonzero(m[np.arange(len(left)), best] >= AGREE)
                found.append((ids[left][i], ids[right][best[i]]))
        p, q = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in (0, 1))
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})

    return dealt.groupBy("g").applyInPandas(compare, "a long, b long")


def _forest(label: np.ndarray, touches: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (row, its partners), those of a spanning forest over rows already joined where labels are equal."""
    label, found = label.copy(), []
    for i, partners in touches:
        partners = partners[label[partners] != label[i]]
        for j in partners[np.unique(label[partners], return_index=True)[1]]:
            found.append((i, j))
            label[label == label[j]] = label[i]
    p = np.array(found, np.int64).reshape(-1, 2)
    return p[:, 0], p[:, 1]


def _outside(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows (key, id, c, weight, ...) dealt to groups (g) so that each row
    outside its key's largest component c meets each row of the key in one group.

    Rows of the largest component never meet each other, and keys of one component
    vanish. A group has two blocks, each of about BLOCK rows and MOST_WEIGHT at most on
    average, however large the key."""
    rows = common.materialize(rows, name)
    parts = rows.groupBy(key, "c").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    top = parts.groupBy(key).agg(F.max(F.struct("n", "c", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > m.n")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / MOST_WEIGHT), F.lit(1)).cast("int")
    sized = top.select(key, F.col("m.c").alias("main"), blocks(F.col("n"), F.col("w")).alias("all"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("few"))
    held = rows.join(sized, key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    asks = held.where("c <> main").select(*rows.columns, place("few").alias("at"), every("all").alias("with"), F.lit(True).alias("asks"))
    dealt = asks.union(held.select(*rows.columns, every("few").alias("at"), place("all").alias("with"), F.lit(False).alias("asks")))
    # one column names a group: of several Spark would take the partitioning by key for good enough
    return dealt.withColumn("g", F.xxhash64(key, "at", "with")).drop("at", "with")


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A group's different rows, the places of those that ask and are asked, and every row's component as a small number."""
    asks, asked = rows.loc[rows["asks"], "id"], rows.loc[~rows["asks"], "id"]
    rows = rows.drop_duplicates("id").sort_values("id")
    return rows, np.flatnonzero(rows["id"].isin(asks)), np.flatnonzero(rows["id"].isin(asked)), np.unique(rows["c"].to_numpy(), return_inverse=True)[1]


def _clusters(members: DataFrame) -> DataFrame:
    """(c, cluster): components that candidates in large nodes hold together.

    members: node, id, s1, s2, c. Every candidate pair of a node (AGREE bits, different
    components) is looked at; a group returns a spanning forest of its candidates."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows, left, right, label = _sides(rows)
        near = _agree(_bits(rows.iloc[left]), _bits(rows.iloc[right])) >= AGREE
        i, j = _forest(label, ((x, right[near[n]]) for n, x in enumerate(left)))
        c = rows["c"].to_numpy()
        return pd.DataFrame({"a": np.minimum(c[i], c[j]), "b": np.maximum(c[i], c[j])})

    dealt = _outside(members.withColumn("weight", F.lit(0)), "node", "minhash-nodes")
    found = common.connected_components(dealt.groupBy("g").applyInPandas(compare, "a long, b long"))
    return common.materialize(found.select(F.col("id").alias("c"), F.col("component").alias("cluster")), "minhash-clusters")


def _bridges(sets: DataFrame, labels: DataFrame, clusters: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): confirmed links between components of a cluster. Candidates are compared
    on full sets within groups; a group returns a spanning forest of its links."""
    rows = common.materialize(sets.drop("path").join(labels, "id", "left").withColumn("c", F.coalesce("c", "id")).join(clusters, "c"), "minhash-rows")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = common.column_of(batch, "doc_id")
            for lo, hi, data, offsets in common.slices(common.column_of(batch, "text")):
                hashes, _, _, firsts, _ = common.words(data, offsets)
                held = [shingles(hashes[firsts[i] : firsts[i + 1]], k).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(held, pa.binary())], ["id", "held"])

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows, left, right, label = _sides(rows)
        near = _agree(_bits(rows.iloc[left]), _bits(rows.iloc[right])) >= AGREE
        held = [np.frombuffer(x, np.uint64) for x in rows["held"]]
        size, at = np.array([len(x) for x in held]), np.concatenate(([0], np.cumsum([len(x) for x in held])))
        word = np.unique(np.concatenate(held), return_inverse=True)[1] if len(held) else np.zeros(0, np.int64)
        inside = np.zeros(len(word) + 1, bool)

        def linked() -> Iterator[tuple[int, np.ndarray]]:
            for n, x in enumerate(left):
                others = right[near[n]]
                others = others[label[others] != label[x]]
                if len(others):
                    mine = word[at[x] : at[x + 1]]
                    inside[mine] = True
                    both = np.array([np.count_nonzero(inside[word[at[y] : at[y + 1]]]) for y in others])
                    inside[mine] = False
                    yield x, others[100 * both >= percent * (size[x] + size[others] - both)]

        i, j = _forest(label, linked())
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    def hopeful(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of a group that have a candidate of another component there."""
        rows, left, right, label = _sides(rows)
        near = (_agree(_bits(rows.iloc[left]), _bits(rows.iloc[right])) >= AGREE) & (label[left][:, None] != label[right][None, :])
        ids, g = rows["id"].to_numpy(), rows["g"].iloc[0]
        sides = [(left[near.any(1)], True), (right[near.any(0)], False)]
        return pd.concat([pd.DataFrame({"g": g, "id": ids[at], "asks": asks}) for at, asks in sides])

    # narrow rows meet first; full sets travel only to groups in which they have a candidate
    dealt = _outside(rows.select("cluster", "id", "c", "s1", "s2", F.col("n_shingles").alias("weight")), "cluster", "minhash-bridges")
    wanted = common.materialize(dealt.groupBy("g").applyInPandas(hopeful, "g long, id long, asks boolean"), "minhash-hopeful")
    some = wanted.select(F.col("id").alias("doc_id")).distinct()
    held = common.materialize(common.among(common.texts(docs), "doc_id", some).join(some, "doc_id", "left_semi").mapInArrow(full, "id long, held binary"), "minhash-sets")
    met = wanted.join(rows.select("id", "c", "s1", "s2"), "id").join(held, "id")
    return met.groupBy("g").applyInPandas(compare, "a long, b long")


def branch(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over sets (id, s1, s2, path, n_shingles), one row per different set: the pairs
    a < b that small nodes find, with their agreeing bits, and the members (node, tree, id,
    s1, s2) of nodes still large at the last level."""
    sketches = sets.select("id", "s1", "s2")
    found, active, large = [], None, None
    for level in range(DEPTH):
        steered = sets.select("id", "path") if active is None else active.join(sets.select("id", "path"), "id")
        children = common.materialize(_branch(steered, level), "minhash-level").distinct()
        counts = children.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        members = common.materialize(children.join(counts, "node").join(sketches, "id"), "minhash-members")
        small = members.where(F.col("n") <= SMALL)
        left, right = small.select("node", F.col("id").alias("a"), "s1", "s2"), small.select("node", F.col("id").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
        differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
        found.append(left.join(right.hint("merge"), "node").where((F.col("a") < F.col("b")) & (differ <= POSITIONS - AGREE)).select("a", "b", (POSITIONS - differ).alias("agree")))
        large = members.where(F.col("n") > SMALL).select("node", "tree", "id", "s1", "s2")
        active = large.select("node", "tree", "id")
    return common.materialize(reduce(DataFrame.union, found).distinct(), "minhash-pairs"), large


def links(sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that join all that candidates join.

    First every set's strongest candidates are confirmed, and in large nodes of a few
    trees the best in two blocks. Of the other candidates only those between different
    components can matter then: pairs of small nodes are confirmed one by one, large
    nodes are compared by clusters of components, every candidate on full sets."""
    pairs, large = branch(sets)
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b")).union(pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b"))
    first = common.materialize(best.union(_dense(large.where(F.col("tree") < DENSE_TREES).select("node", "id", "s1", "s2"))).distinct(), "minhash-first")
    sure = common.materialize(verify(first, docs, k, percent), "minhash-links")
    labels = common.materialize(common.connected_components(sure).withColumnRenamed("component", "c"), "minhash-labels")
    a, b = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    rest = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = common.materialize(rest.join(first, ["a", "b"], "left_anti"), "minhash-rest")
    more = sure.union(common.materialize(verify(rest, docs, k, percent), "minhash-links"))
    if not large.take(1):
        return more
    clusters = _clusters(large.select("node", "id", "s1", "s2").join(labels, "id", "left").withColumn("c", F.coalesce("c", "id")))
    return more.union(common.materialize(_bridges(sets, labels, clusters, docs, k, percent), "minhash-links"))


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets have 100 * common >= percent * union.
    Texts that are in no pair are not exchanged, but for a few."""
    held = lambda end, text: common.among(common.texts(docs).select(F.col("doc_id").alias(end), F.col("text").alias(text)), end, pairs.select(end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array, lo: int, hi: int) -> Iterator[np.ndarray]:
            for _, _, data, offsets in common.slices(column.slice(lo, hi - lo)):
                hashes, _, _, firsts, _ = common.words(data, offsets)
                yield from (shingles(hashes[firsts[i] : firsts[i + 1]], k) for i in range(len(offsets) - 1))

        for batch in batches:
            a, b, ta, tb = (common.column_of(batch, c) for c in ("a", "b", "ta", "tb"))
            keep = []
            for lo in range(0, len(a), 256):
                for x, y in zip(sets(ta, lo, min(lo + 256, len(a))), sets(tb, lo, min(lo + 256, len(a)))):
                    both = len(np.intersect1d(x, y, True))
                    keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return pairs.join(held("a", "ta"), "a").join(held("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _key(doc_id: Column, text: Column) -> Column:
    """What names a row: its id, or if that is null a hash of its text, which equal texts share."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, named (whether the key is an id), n_shingles, component_id, kept for every row of docs."""
    rows = common.texts(docs)
    unnamed = rows.where("doc_id is null")
    some = bool(unnamed.take(1))
    found = signatures(rows.where("doc_id is not null") if some else rows, k).withColumn("named", F.lit(True))
    if some:
        unnamed = unnamed.select(_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
        found = found.union(signatures(unnamed, k).withColumn("named", F.lit(False)))
        rows = rows.where("doc_id is not null").union(unnamed.dropDuplicates(["doc_id"]))
    sigs = common.materialize(found, "minhash-signatures")
    full = sigs.where("n_shingles > 0")
    classes = common.materialize(full.groupBy("set_key").agg(F.min(F.struct("doc_id", "s1", "s2", "path", "n_shingles")).alias("m")).select("set_key", F.col("m.doc_id").alias("id"), "m.s1", "m.s2", "m.path", "m.n_shingles"), "minhash-classes")
    sets = classes.select("id", "s1", "s2", "path", "n_shingles").dropDuplicates(["id"])
    components = common.connected_components(links(sets, rows, k, percent))
    of_class = classes.join(components, "id", "left").select("set_key", F.least("id", F.coalesce("component", "id")).alias("c"))
    out = sigs.join(of_class, "set_key", "left").select(F.col("doc_id").alias("key"), "named", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("c"))
    if not some:
        return out.select("key", "named", "n_shingles", F.col("c").alias("component_id"), (F.col("key") == F.col("c")).alias("kept"))
    # groups with unnamed rows go by their smallest id, if they have one
    out = common.materialize(out, "minhash-groups")
    mixed = out.groupBy("c").agg(F.min(F.when(F.col("named"), F.col("key"))).alias("first"), F.bool_and("named").alias("all_named")).where("not all_named").select("c", "first", F.lit(True).alias("mixed"))
    out = out.join(mixed, "c", "left")
    return out.select("key", "named", "n_shingles", F.when(F.col("mixed"), F.col("first")).otherwise(F.col("c")).alias("component_id"), (F.col("key") == F.coalesce("first", "c")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents of equal sets are one class, of which the smallest id stands for
    all; classes are joined, so copies never make pairs. Null text, no text or no
    word: an empty set that links with nothing. doc_id is expected to be unique;
    a repeated row gets a repeated result, and of different texts with one id all
    count as that id. Rows with a null id link as others do, and equal texts of
    them count as one repeated row. They are kept only in groups without an id,
    whose component_id is null. Empty tables: an empty result.
    Whole texts of any length are used; other columns of the table are not read, whatever their names."""
    return _grouped(docs, k, percent).select(F.when(F.col("named"), F.col("key")).alias("doc_id"), "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each group the smallest doc_id stays (of
    one without ids, one text), once if its row is repeated; rows with neither
    id nor words all stay; same columns."""
    lone = ~F.col("named") & (F.col("n_shingles") == 0)
    rows = common.materialize(_grouped(docs, k, percent).select(F.col("key").alias("__kept"), lone.alias("__lone"), F.col("kept").alias("__stays")), "minhash-kept")
    stays = rows.where("__stays").select("__kept", "__lone")
    kept = stays.distinct()
    # a key of one row that stays needs no join: its row, texts and all, is not exchanged
    asked = rows.groupBy("__kept").agg(F.count("*").alias("n"), F.bool_and("__stays").alias("all")).where("n > 1 or not all").select("__kept")
    keyed = docs.withColumn("__key", _key(F.col("doc_id"), F.col("text")))
    sure, keyed = common.among(keyed, "__key", asked, inside=False), common.among(keyed, "__key", asked)
    of = lambda d, k: d.join(k, F.col("__key") == F.col("__kept"), "left_semi")
    if stays.count() == kept.count():
        return sure.union(of(keyed, kept)).drop("__key")
    once = of(keyed, kept.where("not __lone")).dropDuplicates(["__key"])
    return sure.union(once).union(of(keyed.where("doc_id is null"), kept.where("__lone"))).drop("__key")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by two-word shingles at 0.8; cases as in near_duplicates()."""
    return near_duplicates(common.read(spark, sf_dir, "documents"), k=2)
