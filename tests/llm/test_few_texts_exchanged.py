"""Near-dedup exchanges the texts that its joins need, not all; results stay."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.llm import common, minhash


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _exchanged(spark, run):
    """What run() gives, and the bytes that its stages wrote for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: [store.stageList(None, False, False, none, None).apply(i) for i in range(store.stageList(None, False, False, none, None).size())]
    before = max((s.stageId() for s in stages()), default=-1)
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > before)


def test_texts_in_no_pair_are_not_exchanged(spark, no_broadcast, tmp_path):
    rng = random.Random(5)
    word = lambda: f"{rng.getrandbits(40):x}"
    rows = [(i, " ".join(word() for _ in range(3000))) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} {word()}") for i in range(5)] + [(2000, rows[7][1]), (3000, None), (3001, "")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    kept, written = _exchanged(spark, lambda: sorted(r["doc_id"] for r in minhash.keep_first(docs, 5).select("doc_id", "text").collect()))
    assert kept == [*range(300), 3000, 3001]
    assert written < sum(len(t or "") for _, t in rows) / 4


def test_repeated_rows_and_shared_ids(spark, no_broadcast):
    """Of a repeated row one stays, rows with neither id nor words all stay, whichever way they are looked up."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (4, c), (None, c), (None, None), (None, ""), (None, b + " x y"), (5, None), (5, None)]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, ""), (1, a), (3, b), (4, c), (5, "")]


@pytest.mark.parametrize("marks", [64, 1 << 10, common.MARKS])
def test_among_loses_no_row(spark, monkeypatch, marks):
    monkeypatch.setattr(common, "MARKS", marks)
    rows = spark.range(-500, 500).select(F.col("id").alias("k"), F.lit("x").alias("__word")).union(spark.createDataFrame([(None, "y")], "k long, w string"))
    ids = spark.range(0, 1000, 7).select(F.col("id").alias("any"))
    inside, outside = ({r["k"] for r in common.among(rows, "k", ids, side).collect()} for side in (True, False))
    assert inside | outside == {*range(-500, 500), None} and not inside & outside
    assert {*range(0, 500, 7)} <= inside
    assert marks < 1 << 24 or len(inside) < 100
    empty = common.among(rows, "k", ids.limit(0), True), common.among(rows, "k", ids.limit(0), False)
    assert [e.count() for e in empty] == [0, 1001]
