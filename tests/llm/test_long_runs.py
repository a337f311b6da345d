"""Texts that are one long run of the same kind of character, and counts that tie."""

import time

import pytest
from pyspark.sql import functions as F

from terrane.llm import common, packing, secrets


@pytest.mark.parametrize("gap", [" ", "\n", " \n", "\u3000"])
def test_long_white_space_is_tokenised(gap):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        encode = packing.Encoder(file.read()).encode
    own = Tokenizer.from_file(path)
    for n in (1_000, 99_999, 2_000_000):
        text = "a" + gap * (n // len(gap)) + "b"
        assert list(encode(text)) == own.encode(text, add_special_tokens=False).ids


def test_words_of_a_long_name_are_counted_once_through(spark):
    began = time.perf_counter()
    texts = ["pass" * 250_000, "token_" * 200_000 + ": hidden", "auth" + " " * 1_000_000 + "x", "a" * 1_000_000, None, "", "Plain words, my PASSWORD=plain and plain wörds"]
    ranks = secrets.word_ranks(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert time.perf_counter() - began < 30
    assert {"plain", "words"} <= set(ranks) and "hidden" not in ranks and ranks["plain"] < ranks["words"]


def test_as_many_as_asked_of_equally_frequent_rows(spark):
    counts = spark.range(1000).select(F.format_string("w%04d", "id").alias("word"), F.lit(7).alias("count"))
    assert sorted(r["word"] for r in common.frequent(counts, "count", 10).collect()) == [f"w{k:04d}" for k in range(10)]
    mixed = counts.union(spark.range(5).select(F.format_string("top%d", "id"), F.lit(100)))
    assert {r["word"] for r in common.frequent(mixed, "count", 10).collect()} == {f"top{k}" for k in range(5)}
