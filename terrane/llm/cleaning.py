"""Quality rules, line first: punctuation, navigation and boilerplate rules judge each
line, lines that fail are removed, and documents that lose too much text are rejected.

DataFrame functions only. A document stays one row throughout (no explode, no
shuffle); repeated word windows are found by sorting the row's own windows."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
SHOUTS = "[!?][!?]"
#: What may end a line of prose, closing marks included.
MARKS = ".!?:;\"')]…”’»。！？"
#: A sentence that ends inside the line, so that prose cut off at its end is no menu.
ENDS_INSIDE = r"[\p{L}\p{N}][.!?。！？][\x20\x09-\x0D]"
#: Phrases of pages rather than of texts, in lower case.
BOILERPLATE = ("licensed under", " license", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookies", "javascript", "lorem ipsum", "click here", "subscribe to", "powered by")
#: Boilerplate stands on short lines; a longer one that holds a phrase is taken for prose.
MOST_BOILERPLATE_WORDS = 30
#: Of 100 words, so many may stand on removed lines.
MOST_LOST = 30
#: A document of fewer words, or one with a larger share (of 100) of words in repeated windows, fails whatever its lines are.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, f"{GAP}+"), lambda w: w != "")


def with_repeated_words(df: DataFrame, words: str, name: str, window: int = WINDOW) -> DataFrame:
    """df with the count of words that stand in windows of so many words which the row holds
    twice or more. Windows and their places are sorted inside the row and compared with the
    next one as text; each repeated window covers its words up to the next repeated one."""
    n = F.size(words) - window + 1
    at = [F.slice(words, k + 1, n).alias(f"w{k}") for k in range(window)]
    windows = F.when(n > 1, F.sort_array(F.arrays_zip(*at, F.sequence(F.lit(0), n - 1).alias("i")))).otherwise(F.array())
    follows = F.arrays_zip(F.col("__sorted").alias("a"), F.slice("__sorted", 2, F.greatest(F.size("__sorted") - 1, F.lit(0))).alias("b"))
    equal = lambda x: reduce(and_, (x["a"][f"w{k}"] == x["b"][f"w{k}"] for k in range(window)))
    places = F.flatten(F.transform(F.filter("__pairs", equal), lambda x: F.array(x["a"]["i"], x["b"]["i"])))
    covered = F.aggregate("__steps", F.lit(0).cast("long"), lambda a, x: a + F.least(F.lit(window), F.coalesce(x["b"] - x["a"], F.lit(window))))
    steps = F.arrays_zip(F.col("__places").alias("a"), F.slice("__places", 2, F.greatest(F.size("__places") - 1, F.lit(0))).alias("b"))
    out = df.withColumn("__sorted", windows).withColumn("__pairs", follows).withColumn("__places", F.sort_array(F.array_distinct(places))).withColumn("__steps", steps)
    return out.withColumn(name, covered).drop("__sorted", "__pairs", "__places", "__steps")


def _holds_phrase(text: Column) -> Column:
    """Whether text holds one of the fixed phrases in any case; it is lower-cased once."""
    return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, (F.contains(t, F.lit(p)) for p in BOILERPLATE)))


def line_rule(line: Column, with_phrases: Column) -> Column:
    """The rule that a line with words fails, or null: `navigation` (separators for a tenth of its
    words, three at least, or symbols for over a tenth), `punctuation` (doubled marks after over a quarter of its words, or
    no closing mark and no sentence inside) or `boilerplate` (a fixed phrase; asked only of texts that hold one)."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    n = count(f"{WORD}+")
    navigation = ((count(SEPARATORS) >= 3) & (count(SEPARATORS) * 10 >= n)) | (count(SYMBOLS) * 10 > n)
    # most lines hold none of the counted characters, and a run of others is skipped at once
    plain = F.regexp_replace(line, "[^#*$%&|<>»›•·!?]+", "") == ""
    odd = F.when(~plain, F.when(navigation, "navigation").when(count(SHOUTS) * 4 > n, "punctuation"))
    ended = F.endswith(line, F.lit(".")) | (F.instr(F.lit(MARKS), F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))) > 0)
    return F.coalesce(odd, F.when(~ended & ~line.rlike(ENDS_INSIDE), "punctuation"), F.when(with_phrases & _holds_phrase(line) & (n <= MOST_BOILERPLATE_WORDS), "boilerplate"))


def judge_lines(text: Column) -> Column:
    """Each \\n-split line: text, worded (it has a word), rule (null: the line stays; lines without a word always do)."""

    def judged(line: Column, with_phrases: Column) -> Column:
        return F.struct(line.alias("text"), line.rlike(WORD).alias("worded"), F.when(line.rlike(WORD), line_rule(line, with_phrases)).alias("rule"))

    # an array of one holds what is asked of the whole text, or each line would ask it anew
    return F.flatten(F.transform(F.array(_holds_phrase(text)), lambda p: F.transform(F.split(text, "\n"), lambda x: judged(x, p))))


def clean_lines(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, n_punctuation, n_navigation, n_boilerplate (lines
    removed by rule), n_lost_words (on them), kept, cleaned_text (the lines that stay).

    A null text is empty; an empty text has no words, so it fails. A null doc_id and
    repeated rows are judged like any other. An empty table gives an empty one. Other
    columns of docs, whatever their names, are left behind. Texts of any length are
    judged whole, in a row of their own; a line of any length is one line. Of equal
    lines all but the first count as repeated, and all are judged alike."""
    held = common.texts(docs).withColumn("words", split_words(F.col("text"))).withColumn("lines", judge_lines(F.col("text")))
    held = with_repeated_words(held, "words", "n_repeat_words").withColumn("worded", F.transform(F.filter("lines", lambda x: x["worded"]), lambda x: x["text"]))
    failing = lambda rule: F.size(F.filter("lines", lambda x: x["rule"] == rule)).cast("long")
    lost = F.aggregate(F.filter("lines", lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + F.regexp_count(x["text"], F.lit(f"{WORD}+")))
    counted = held.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", f"[^{SYMBOLS[1:]}+", "")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"), "n_repeat_words", F.size("lines").cast("long").alias("n_lines"), *(failing(r).alias(f"n_{r}") for r in ("punctuation", "navigation", "boilerplate")),
        lost.alias("n_lost_words"), F.array_join(F.transform(F.filter("lines", lambda x: x["rule"].isNull()), lambda x: x["text"]), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_lost_words") <= MOST_LOST * F.col("n_words")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_lines() over all documents, without the cleaned texts; cases as there."""
    found = clean_lines(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def _sql() -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    count = lambda pattern: f"len(regexp_extract_all(t, {quoted(pattern)}))"
    has = lambda pattern: f"regexp_matches(t, {quoted(pattern)})"
    phrase = " or ".join(f"contains(lower(t), {quoted(p)})" for p in BOILERPLATE)
    return f"""with d as (select row_number() over () k, doc_id, coalesce(text, '') t from documents), w as (select k, doc_id, t, regexp_extract_all(t, {quoted(WORD + "+")}) w from d),
l as (select k, unnest(string_split(t, chr(10))) t from d), n as (select k, t, {count(WORD + "+")} n from l),
j as (select k, t, n, ({count(SEPARATORS)} >= 3 and {count(SEPARATORS)}*10 >= n) or {count(SYMBOLS)}*10 > n or {count(SHOUTS)}*4 > n
  or (not contains({quoted(MARKS)}, right(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) and not {has(ENDS_INSIDE)}) or (n <= {MOST_BOILERPLATE_WORDS} and ({phrase})) bad from n where n > 0),
ls as (select k, count(*) - count(distinct t) dup, coalesce(sum(n) filter (bad), 0) lost from j group by k),
x as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from w, unnest(range(1, len(w) - 1)) u(i)), r as (select k, i from (select k, i, count(*) over (partition by k, s) c from x) where c > 1),
g as (select k, sum(least({WINDOW}, coalesce(lead_i - i, {WINDOW}))) c from (select k, i, lead(i) over (partition by k order by i) lead_i from r) group by k),
m as (select w.k, doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(t, {quoted(SYMBOLS)}))::bigint n_symbols, coalesce(dup, 0)::bigint n_dup_lines, coalesce(c, 0)::bigint n_repeat_words, coalesce(lost, 0)::bigint n_lost_words
from w left join ls on ls.k = w.k left join g on g.k = w.k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} or 100*n_repeat_words > {MOST_REPEATED}*n_words base_failed,
not (n_words < {LEAST_WORDS} or 100*n_repeat_words > {MOST_REPEATED}*n_words) and 100*n_lost_words <= {MOST_LOST}*n_words kept, n_lost_words from m"""


SQL = _sql()
