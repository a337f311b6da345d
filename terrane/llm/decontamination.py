"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap checks."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: BM25's constants; share of an item's own score from which it is retrieved; share of shingles that must overlap.
K1, B, RETRIEVE, OVERLAP = 1.2, 0.75, 0.6, 0.8
#: Words of a shingle, words of a passage at least, items of an index block, items indexed at once.
SHINGLE, PASSAGE, BLOCK, MOST_ITEMS = 5, 128, 16, 20_000

#: Words end at any ASCII character that is neither letter nor digit.
_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = False
_GAPS[128:] = False


def _tokens(texts: list[str]) -> list[np.ndarray]:
    column = pa.array(texts, pa.string())
    out = []
    for _, _, data, offsets in common.slices(column):
        h, _, _, firsts, _ = common.words(data, offsets, _GAPS)
        out += [h[firsts[i] : firsts[i + 1]] for i in range(len(offsets) - 1)]
    return out


def _shingles(h: np.ndarray) -> np.ndarray:
    k = max(1, min(SHINGLE, len(h)))
    if not len(h):
        return h
    s = h[: len(h) - k + 1]
    for i in range(1, k):
        s = common.mix(s * np.uint64(31) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of an item is its answer, what precedes is the question;
    of a single sentence, the last third of its words."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if p.strip()]
    if len(parts) >= 2:
        return ". ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:]) or " ".join(words[-1:])


@dataclass
class Index:
    """Weights are BM25 impacts over an item's own score, so each item's sum to 1. Postings are in the order of items."""

    ids: np.ndarray
    terms: np.ndarray  # sorted hashes
    posting: np.ndarray  # term * number of items + item, sorted
    weight: np.ndarray
    block_ptr: np.ndarray  # of each term: its blocks, and the largest weight there
    block_of: np.ndarray
    block_max: np.ndarray
    essential: np.ndarray  # of each term: whether it counts in block bounds by itself
    rest: np.ndarray  # of each block: the most that its items' other terms can add
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    passage: int

    @property
    def blocks(self) -> int:
        return len(self.rest)


@dataclass
class Statistics:
    """Number of items, their mean length, and for how many of them each term (sorted hashes) stands."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def statistics(items: DataFrame) -> tuple[int, float, int, DataFrame]:
    """n, mean and greatest number of words and the table (term, df) of all items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in _tokens(common.column_of(batch, "text").to_pylist()):
                key, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(np.arange(len(key)) == 0), pa.array(np.full(len(key), len(h)))], ["term", "tf", "first", "words"])

    terms = common.materialize(items.select("text").mapInArrow(run, "term long, tf long, first boolean, words long"), "decontamination-terms")
    one = terms.agg(F.count_if("first").alias("n"), F.sum("tf").alias("words"), F.max("words").alias("longest")).first()
    return one["n"], (one["words"] or 0) / max(one["n"], 1), one["longest"] or 0, terms.groupBy("term").agg(F.count("*").alias("df"))


def build(rows: list[tuple[int, str]], known: Statistics | None = None) -> Index | None:
    """Index of (item_id, text), with the statistics of all items (default: of these). None if no item has a word."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t})
    tokens = _tokens([t for _, t in rows])
    keep = [k for k, h in enumerate(tokens) if len(h)]
    if not keep:
        return None
    rows, tokens = [rows[k] for k in keep], [tokens[k] for k in keep]
    n, lengths = len(rows), np.array([len(h) for h in tokens], float)
    item = np.repeat(np.arange(n), lengths.astype(int))
    terms, term = np.unique(np.concatenate(tokens), return_inverse=True)
    pair, tf = np.unique(term * np.int64(n) + item, return_counts=True)
    term, item = pair // n, pair % n
    own = np.bincount(term, minlength=len(terms))
    all_n, mean, df = (n, lengths.mean(), own) if known is None else (known.n, known.mean, known.df[np.searchsorted(known.terms, terms)])
    idf = np.log(1 + (all_n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
    weight /= np.bincount(item, weight, n)[item]
    # common terms are left to a bound as long as no item's sum of them passes half of the threshold
    gone, rest = np.zeros(len(terms), bool), np.zeros(n)
    ptr = np.concatenate(([0], np.cumsum(own)))
    for t in np.argsort(-own, kind="stable"):
        if own[t] <= max(2, 0.02 * n):
            break
        here = slice(ptr[t], ptr[t + 1])
        if (rest[item[here]] + weight[here]).max() <= RETRIEVE / 2:
            gone[t] = True
            rest[item[here]] += weight[here]
    blocks = (n - 1) // BLOCK + 1
    rest_of = np.zeros(blocks)
    np.maximum.at(rest_of, np.arange(n) // BLOCK, rest)
    key, at = np.unique(term * np.int64(blocks) + item // BLOCK, return_inverse=True)
    most = np.zeros(len(key))
    np.maximum.at(most, at, weight)
    split = [question_and_answer(t) for _, t in rows]
    return Index(
        np.array([i for i, _ in rows], np.int64), terms, pair, weight, np.searchsorted(key // blocks, np.arange(len(terms) + 1)), key % blocks, most, ~gone, rest_of,
        [_shingles(h) for h in _tokens([q for q, _ in split])], [_shingles(h) for h in _tokens([a for _, a in split])], max(PASSAGE, 2 * int(lengths.max())),
    )


def wand(index: Index, terms: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
    """(item, score) of a block's items that score RETRIEVE or more for a passage's
    terms: weak-AND over their posting lists in the order of items. The pivot is the
    first item at which the lists' largest weights in the block can add up to the
    threshold; lists before it are moved on to it unread, and it is scored once all stand there."""
    n, lists = np.int64(len(index.ids)), []
    begin = np.searchsorted(index.posting, terms * n + block * BLOCK)
    end = np.searchsorted(index.posting, terms * n + min((block + 1) * BLOCK, int(n)))
    for a, b in zip(begin.tolist(), end.tolist()):
        if a < b:
            weight = index.weight[a:b].tolist()
            lists.append([0, (index.posting[a:b] % n).tolist(), weight, max(weight)])
    while True:
        lists = sorted((c for c in lists if c[0] < len(c[1])), key=lambda c: c[1][c[0]])
        bound, pivot = 0.0, None
        for at, items, _, most in lists:
            bound += most
            if bound >= RETRIEVE - 1e-9:
                pivot = items[at]
                break
        if pivot is None:
            return
        if lists[0][1][lists[0][0]] == pivot:
            score = 0.0
            for c in lists:
                if c[1][c[0]] == pivot:
                    score += c[2][c[0]]
                    c[0] += 1
            if score >= RETRIEVE - 1e-9:
                yield pivot, score
        else:
            for c in lists:
                c[0] = bisect.bisect_left(c[1], pivot, c[0])


def _expand(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its entries ptr[row]..ptr[row + 1]: (place in rows, entry)."""
    size = ptr[rows + 1] - ptr[rows]
    back = np.repeat(np.arange(len(rows)), size)
    return back, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ptr[rows], size)


def search(index: Index, hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word of the passage) of verified items, best passage of each."""
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == hashes)
    if not len(known):
        return []
    stride = index.passage // 2
    row = np.searchsorted(firsts, known, "right") - 1
    window = (known - firsts[row]) // stride
    # passages are numbered along the rows, with a gap after each; a word is in its own and the one before
    base = np.concatenate(([0], np.cumsum(np.diff(firsts) // stride + 2)))
    own = base[row] + window + 1
    passage = np.concatenate((own, own - 1))
    size = np.int64(len(index.terms))
    pair = np.unique(passage * size + np.tile(place[known], 2))
    passage, term = pair // size, pair % size
    # which blocks of items a passage may reach at all: sums of their largest weights
    sure = np.flatnonzero(index.essential[term])
    back, entry = _expand(index.block_ptr, term[sure])
    key, at = np.unique(passage[sure[back]] * np.int64(index.blocks) + index.block_of[entry], return_inverse=True)
    bound = np.bincount(at, index.block_max[entry], len(key)) + index.rest[key % index.blocks]
    open_ = key[bound >= RETRIEVE - 1e-9]
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for k in open_.tolist():
        p = k // index.blocks
        own = term[np.searchsorted(passage, p) : np.searchsorted(passage, p, "right")]
        for i, score in wand(index, own, k % index.blocks):
            r = int(np.searchsorted(base, p, "right")) - 1
            start = int(firsts[r] + max(0, (p - base[r] - 1) * stride))
            text = hashes[start : min(start + index.passage, firsts[r + 1])]
            overlap = [_share(text, part) for part in (index.questions[i], index.answers[i])]
            if min(overlap) >= OVERLAP and ((r, i) not in best or score > best[r, i][0]):
                best[r, i] = (score, overlap[0], overlap[1], start - int(firsts[r]))
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def _share(text: np.ndarray, part: np.ndarray) -> float:
    """Share of a part's shingles that text holds; a part shorter than a shingle is looked for at its own length."""
    if not len(part):
        return 1.0
    most = 0.0
    for k in (SHINGLE,) if len(part) > 1 else range(1, SHINGLE + 1):
        if len(text) >= k:
            s = text[: len(text) - k + 1]
            for i in range(1, k):
                s = common.mix(s * np.uint64(31) + text[i : len(text) - k + 1 + i])
            most = max(most, np.isin(part, s).mean())
    return float(most)


def _known(items: DataFrame, n: int, mean: float, df: DataFrame) -> Statistics:
    """Of all items' statistics the part that these need; bounded as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in _tokens(common.column_of(batch, "text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], ["term"])

    own = df.join(items.select("text").mapInArrow(run, "term long").distinct(), "term").toArrow()
    terms, count = own["term"].to_numpy().view(np.uint64), own["df"].to_numpy()
    order = np.argsort(terms)
    return Statistics(n, mean, terms[order], count[order])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id,
    score (share of the item's own BM25 score), question_overlap, answer_overlap,
    first_word of the passage.

    Whole texts are cut into passages that overlap by half and are at least
    twice as long as any item, so that each item lies in one. Null and empty
    texts, and items that are null or without a word, match nothing; question and
    answer of few words have to occur whole; copies of an item under other ids match each.
    Repeated rows give repeated results. Rows with a null doc_id count under a null
    id. The index holds MOST_ITEMS items at most; more are searched in so many
    passes, all with the statistics of all items, so results do not depend on it."""
    items = common.materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null"), "decontamination-items")
    count = items.count()
    passes = max(1, -(-count // (MOST_ITEMS * 3 // 4))) if count > MOST_ITEMS else 1
    n, mean, longest, df = statistics(items.distinct()) if passes > 1 else (0, 0.0, 0, None)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    held = common.texts(docs)
    found = None
    for number in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        index = build([(r["item_id"], r["text"]) for r in own.collect()], None if passes == 1 else _known(own, n, mean, df))
        if index is not None and passes > 1:
            index.passage = max(PASSAGE, 2 * longest)  # of the longest of all items, as in a single pass
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = common.column_of(batch, "doc_id")
                rows = []
                for lo, _, data, offsets in common.slices(common.column_of(batch, "text")):
                    hashes, _, _, firsts, _ = common.words(data, offsets, _GAPS)
                    rows += [(ids[lo + r].as_py(), int(index.ids[i]), *v) for r, i, *v in search(index, hashes, firsts)]
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = held.where("false").mapInArrow(lambda x: iter(()), schema) if index is None else held.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a test item; same columns."""
    found = common.materialize(contaminated(docs, items).select(F.col("doc_id").alias("__leak_id")).distinct(), "decontamination-leaks")
    return docs.join(found, F.col("doc_id").cast("long") == F.col("__leak_id"), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents; cases as in contaminated()."""
    return contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
