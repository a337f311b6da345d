"""Connected components over edge tables, for networks, chains and merges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task joins at once before it passes on what is left of them.
TOGETHER = 1 << 18


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder and read back: lineage ends, and
    so do size estimates that a loop of joins would multiply without end. Only a
    local session may do without a shared folder; it gets one of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote and nothing reads any more, so that rounds do not fill the disk; others stay."""
    for df in tables:
        if path := df.__dict__.pop("_cut", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ends of some edges, and the least end that each reaches."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return ids, ids[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _combined(edges: DataFrame) -> DataFrame:
    """Fewer edges (a < b) that connect the same: a task joins TOGETHER at a time
    and passes on a star of each piece. A combiner, so any part may be left undone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars() -> pa.RecordBatch:
            ids, root = least_reached(*np.concatenate(held, axis=1))
            arm = ids != root
            return pa.RecordBatch.from_arrays([pa.array(root[arm]), pa.array(ids[arm])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
            if sum(h.shape[1] for h in held) >= TOGETHER:
                yield stars()
                held = []
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _packed(edges: DataFrame) -> DataFrame:
    """edges in as few partitions as hold TOGETHER each."""
    return edges.coalesce(max(1, -(-edges.count() // TOGETHER)))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and parents have none."""
    ends = edges.select(F.col("b").alias("id"), F.col("a").alias("up")).union(edges.select(F.col("a").alias("id"), F.lit(None).cast("long").alias("up")))
    state = ends.groupBy("id").agg(F.min("up").alias("m"), F.max("up").alias("n"), F.count_if(F.col("up").isNull()).alias("below"))
    return not state.where("m <> n or (m is not null and below > 0)").take(1)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) for each end of edges (a, b): the least id it reaches.

    Rounds of large stars (a node's larger neighbours go to its least neighbour)
    and small stars (a node and its smaller neighbours go to the least of them)
    over a written edge table; their number grows with the logarithm of the
    nodes, not with the diameter. Steps are grouped minima, combined before the
    shuffle, and joins of written tables, whose hot keys Spark can split, so
    neither a hub nor a component meets in one task. Edges with a null end are
    left out; an edge from a node to itself only names the node."""
    known = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    known = cut(known)
    alone = known.where("a = b").select(F.col("a").alias("id")).distinct()
    now = cut(_combined(_packed(known.where("a <> b"))))
    for turn in range(most_rounds + 1):
        if _settled(now):
            children = now.select(F.col("b").alias("id"), F.col("a").alias("component")).distinct()
            found = children.union(now.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("component")))
            return cut(found.union(alone.join(found, "id", "left_anti").select("id", F.col("id").alias("component"))))
        if turn == most_rounds:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(_combined(both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b")))
        least = cut(large.groupBy("b").agg(F.min("a").alias("m")))
        held = large.join(least, "b")
        small = held.select(F.col("m").alias("a"), "b").union(held.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = cut(_combined(_packed(cut(small))))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
