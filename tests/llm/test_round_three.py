"""Prefix trie, Merkle manifest and line rules against plain Python, with odd rows."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terrane.llm import cleaning, manifest, prefix_trie

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string, path string, grp string, words string"


# ---------------------------------------------------------------- prefix trie
def _trie(sequences):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of {conv: [turns]}."""
    members = collections.defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    under = {k: [x for x in members if x[: len(k)] == k] for k in members}
    out = {}
    for k, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(sequences[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under[k] if x)
        out[min(own), len(k)] = (min(members[k[:-1]]) if k else None, len(own), kids[k], sum(not kids[x] for x in under[k]), saved, H(ends))
    return out


def _rebuilt(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((r or "", x or ""))
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def _conversations():
    rows = [(None, 0, "user", "x"), (0, 1, "assistant", "b"), (0, None, "user", "first"), (0, 2, None, "cé😀"), (0, 3, "user", None), (70, 0, "user", "lonely"), (70, 0, "user", "lonely")]
    for c in range(1, 60):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}-{(c * 7 + t) % (2 + t)}") for t in range(c % 9)]
    for c in (100, 101, 102, 250, 251, 999):
        rows += [(c, t, "user", "same " * t) for t in range(12)]
    return rows + [(300 + k, t, "user", f"deep {min(t, 30)}" if t < 30 or k == 0 else f"own {k}") for k in range(12) for t in range(31)]


@pytest.mark.parametrize("most", [(3, 10_000), (2, 9), (1000, 100_000)])
def test_prefix_trie_equals_all_prefixes(spark, most):
    rows = _conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash"))
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns_of(frame)), *most).collect()
    assert len({(r.conv_id, r.depth) for r in found}) == len(found)
    assert {(r.conv_id, r.depth): tuple(r[2:]) for r in found} == _trie(_rebuilt(rows))


def test_prefix_trie_of_whole_conversations_and_none(spark):
    rows = [r for r in _conversations() if r[0] is not None and r[0] > 7]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sequences = prefix_trie.whole(prefix_trie.turns_of(frame)).cache()
    nodes = prefix_trie.prefix_trie(sequences, 4).cache()
    turns = collections.defaultdict(list)
    for c, _, r, x in sorted(rows):
        turns[c].append((r, x))
    assert {(r.conv_id, r.depth): tuple(r[2:]) for r in nodes.collect()} == _trie(turns)
    for r in prefix_trie.with_turns(nodes, sequences, frame).collect():
        assert (r.role, r.text) == (turns[r.conv_id][r.depth - 1] if r.depth else (None, None))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns_of(frame.where("false")))).count() == 0


def test_digests_of_many_ids_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER", 7)
    frame = spark.range(0, 500).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") % 5 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = prefix_trie.suffixes(prefix_trie.whole(prefix_trie.turns_of(frame))).where("n > 1").collect()
    hot = [c for c in range(500) if c % 5]
    assert [(r["first"], r.n, r.ends) for r in found] == [(1, 400, H(",".join(map(str, hot))))]


# ---------------------------------------------------------------- manifest
def _manifest(rows):
    """{(doc_id, leaf): [(subroot, root, proof, folded)]} by plain recursion."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*(part(v) for v in (r[0], r[1], r[2], r[3], text)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            out.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
            at //= 3
        return out

    groups = collections.defaultdict(list)
    for r in rows:
        changed = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        groups[r[1]].append((r[0], leaf(r, r[4]), leaf(r, changed)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    over = climb([trees[s][-1][0] for s in order])
    out = collections.Counter()
    for k, s in enumerate(order):
        for at, (doc_id, own, start) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            steps, d = path(trees[s], at) + path(over, k), start
            for left, right in steps:
                d = H(left, d, right)
            root = over[-1][0]
            out[doc_id, own, trees[s][-1][0], root, H(*(x for step in steps for x in step)), d, d == root] += 1
    return out


def _documents():
    rows = [(None, "a", None, None, None), (None, "a", "en", 3, "x\ny"), (None, None, None, None, ""), (-5, "a", "en", 1, "é\n"), (-70, "a", "en", 1, "z"), (2**62, "a", "en", 1, "far\n"), (-(2**63), "a", "en", 1, "least"), (2**63 - 1, "a", "en", 1, "most\n")]
    rows += [(4, "a", "en", 1, "twice\n"), (4, "a", "en", 1, "twice\n"), (4, "a", "de", 1, "third"), (5, "a", "en", 1, "after"), (4, "b", "en", 1, "alone\n"), (9, None, "en", 1, "no source"), (1, "Ä", "en", 1, "q"), (2, "z", "en", 1, "w")]
    return rows + [(k * 37 % 4001, "hot", "fr", k, f"text {k}\n\nend") for k in range(900)] + [(10_000 + k, f"s{k}", "fr", k, "\n" * k) for k in range(300)]


def test_manifest_equals_plain_trees(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame([(*r, "p", "g", "w") for r in rows], DOCS).repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = manifest.op12_merkle_manifest(spark, f"file://{tmp_path}").collect()
    assert collections.Counter(map(tuple, found)) == _manifest(rows)
    assert any(not r.verified for r in found) and any(r.verified for r in found)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 245])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(k, "a", "en", k, f"t{k}\n") for k in range(n)]
    spark.createDataFrame([(*r, "p", "g", "w") for r in rows], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert collections.Counter(map(tuple, manifest.op12_merkle_manifest(spark, f"file://{tmp_path}").collect())) == _manifest(rows)


# ---------------------------------------------------------------- line rules
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The river ran past the old mill and nobody in the village could say who had built it, or when."


def _base(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_line_rules_count_like_plain_python(spark):
    long = "\n".join(f"{PROSE} {k} Sentence number {k} ends{k % 7} here." for k in range(3000))
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a b c", "a b c a b c", "x " * 500, "a b c d\x1fe 😀é " * 20, "#1 $2 %3|&<>*" * 9, PROSE, long, "l one\nl one\n l one\n\n\nl one", "\n".join([PROSE] * 4), "line\rline line\x85line " * 20]
    docs = spark.createDataFrame([(k if k % 3 else None, t, "w", "l", 1) for k, t in enumerate(texts)] + [(1, "", "w", "l", 2)], "doc_id long, text string, words string, lines string, n_words long")
    found = cleaning.clean_lines(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(tuple(r[c] for c in names) for r in found) == sorted([*map(_base, texts), _base("")])
    assert all(not r.kept for r in found if r.base_failed) and cleaning.clean_lines(docs.where("false")).count() == 0


def test_lines_that_fail_go_and_documents_that_lose_too_much(spark):
    prose = "\n".join(" ".join(f"{w}{k * k}" for w in ("river", "mill", "village", "stone", "bread")) + f", said chapter{k}." for k in range(20))
    menu, shout, cut = "Home | News | Sports | Weather | Contact", "BUY!! NOW!! AND!! SAVE!!", "Related articles and links"
    texts = [prose, f"{menu}\n{prose}\nAll rights reserved.\n{cut}\n\n{shout}", "\n".join(f"{menu} | {k}" for k in range(40)), prose + " and then the page was torn off in the middle of", f"{prose}\n" + "\n".join(f"see also topic {k} of {k * k}" for k in range(60))]
    found = {r.doc_id: r for r in cleaning.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k].kept for k in range(5)] == [True, True, False, True, False]
    assert found[1].cleaned_text == f"{prose}\n" and (found[1].n_navigation, found[1].n_punctuation, found[1].n_boilerplate) == (1, 2, 1)
    assert found[0].cleaned_text == prose and not found[4].base_failed
