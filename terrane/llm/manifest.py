"""Merkle manifest of a dataset, its leaves placed by the ranks of compressed bitmaps.

Each group's doc_ids are a sparse bitmap: words of 64 ids, of which only those that
hold an id exist, merged from all tasks by bitwise or. A directory of counts above
them (1,024 words to an entry, entries of entries as far as the ids' span needs) gives
the ids before each word, and the bits below an id's own the rest, so that a leaf gets
its place in its group by one lookup; leaves are never sorted. Nodes then meet in
arrays keyed by their slots, five levels of threes to an array, so a tree of n leaves
takes log243(n) exchanges. Proofs come down the same arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.operators.ranks import ranked

from . import common

#: Children of a node, levels folded in one array of slots, and words of an entry of the directory (as bits).
FAN, LEVELS, ENTRY_BITS = 3, 5, 10
SLOTS = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; `-` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**other: Column) -> Column:
    """Digest of a document's fields; `other` stands for the columns of its names."""
    return digest(*(field(other.get(c, F.col(c))) for c in FIELDS))


def group_key(source: Column) -> Column:
    """A key in the sources' order (null first, then by bytes) that is never null."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("s"), source.cast("string")))


# ---------------------------------------------------------------- places
def _directory(words: DataFrame, sizes: DataFrame, low: int, high: int) -> DataFrame:
    """words (grp, word, bits, ids) with before (leaves of the group before the word) and n (all of the group)."""
    levels = [words.withColumnRenamed("word", "key")]
    while low != high and (low, high) != (-1, 0):
        levels.append(levels[-1].groupBy("grp", F.shiftright("key", ENTRY_BITS).alias("key")).agg(F.sum("ids").alias("ids")))
        low, high = low >> ENTRY_BITS, high >> ENTRY_BITS
    above, parent = sizes.select("grp", F.lit(0).cast("long").alias("parent"), F.col("nulls").alias("before"), "n"), F.lit(0).cast("long")
    for level in reversed(levels):
        # a group's one or two topmost entries, or those of one parent: 1,024 at most
        earlier = Window.partitionBy("grp", "parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        held = level.withColumn("parent", parent).join(above, ["grp", "parent"])
        placed = held.withColumn("before", F.col("before") + F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
        above, parent = placed.select("grp", F.col("key").alias("parent"), "before", "n"), F.shiftright("key", ENTRY_BITS)
    return placed.select("grp", F.col("key").alias("word"), "bits", "before", "n")


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (grp, doc_id, leaf, row and more; written) with slot, their place in their group, and
    n, its size; and the largest size. Null ids come first, and equal ids in the order of
    their leaves; only such rows are sorted, by ranges that split any of them."""
    word, low = F.shiftright("doc_id", 6), F.expr("cast(doc_id & 63 as int)")
    sizes = common.materialize(rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")), "sizes")
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    words = common.materialize(rows.where("doc_id is not null").groupBy("grp", word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("ids")), "words")
    span = words.agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max(F.col("ids") - F.bit_count("bits")).alias("more")).first()
    most = sizes.agg(F.max("n").alias("n"), F.sum("nulls").alias("nulls")).first()
    found = _directory(words.select("grp", "word", "bits", "ids"), sizes, span["low"] or 0, span["high"] or 0)
    ids = rows.where("doc_id is not null").withColumn("word", word).join(found, ["grp", "word"])
    ids = ids.withColumn("slot", F.col("before") + F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(doc_id & 63 as int))"))).drop("bits", "before")
    if not (span["more"] or most["nulls"]):
        return ids.drop("word"), most["n"] or 0
    # ids of several rows: the rows beyond the first of each lesser id of the word, and the place among equals
    again = words.where("ids > bit_count(bits)").select("grp", "word")
    counted = rows.where("doc_id is not null").withColumn("word", word).join(again, ["grp", "word"]).groupBy("grp", "word", "doc_id").agg(F.count("*").alias("c")).where("c > 1")
    counted = common.materialize(counted, "repeated ids")
    extras = counted.groupBy("grp", "word").agg(F.collect_list(F.struct(low.alias("low"), (F.col("c") - 1).alias("more"))).alias("extras"))
    beyond = F.aggregate(F.coalesce("extras", F.array()), F.lit(0).cast("long"), lambda a, x: a + F.when(x["low"] < low, x["more"]).otherwise(0))
    ids = ids.join(extras, ["grp", "word"], "left").withColumn("slot", F.col("slot") + beyond).drop("extras", "word")
    tied = rows.join(counted.select("grp", "doc_id"), ["grp", "doc_id"], "left_semi").select("grp", "doc_id", "leaf", "row").union(rows.where("doc_id is null").select("grp", "doc_id", "leaf", "row"))
    tied = common.materialize(ranked(tied, "grp", "doc_id", "leaf", "row", name="place"), "ties")
    least = tied.groupBy("grp", "doc_id").agg(F.min("place").alias("least"))
    after = tied.join(least, (tied["grp"] == least["grp"]) & tied["doc_id"].eqNullSafe(least["doc_id"])).select("row", (F.col("place") - F.col("least")).alias("after"))
    nulls = rows.where("doc_id is null").join(sizes.select("grp", "n"), "grp").withColumn("slot", F.lit(0).cast("long"))
    both = ids.unionByName(nulls).join(after, "row", "left")
    return both.withColumn("slot", F.col("slot") + F.coalesce("after", F.lit(0))).drop("after"), most["n"]


# ---------------------------------------------------------------- trees
def _folds(n: Column) -> Column:
    """Levels that a group of n nodes has in one array."""
    return sum(((n > FAN**j).cast("int") for j in range(LEVELS)), F.lit(0))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, slot, n, digest, own) by blocks of SLOTS slots: their array, the levels above
    it up to the group's top or LEVELS of them, the block's digest, and the nodes left in the group."""
    slots = F.sort_array(F.collect_list(F.struct((F.col("slot") % SLOTS).cast("int").alias("i"), "digest", "own")))
    out = nodes.groupBy("grp", "n", F.expr(f"slot div {SLOTS}").alias("block")).agg(slots.alias("slots"))
    out = out.withColumn("folds", _folds(F.col("n"))).withColumn("l0", F.transform("slots", lambda s: s["digest"]))

    def above(level: str) -> Column:
        runs = F.sequence(F.lit(0), F.expr(f"(size({level}) - 1) div {FAN}"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, FAN), ""), 256))

    for j in range(LEVELS):
        out = out.withColumn(f"l{j + 1}", F.when(F.col("folds") > j, above(f"l{j}")))
    top = F.coalesce(*(F.col(f"l{j}") for j in range(LEVELS, -1, -1)))
    return out.withColumn("digest", F.get(top, F.lit(0))).withColumn("left_n", F.expr(f"(n + {SLOTS - 1}) div {SLOTS}"))


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Written blocks of one tree a group, from the leaves up; the largest group has `most` leaves."""
    phases = []
    while True:
        phases.append(common.materialize(_blocks(nodes), "blocks"))
        if most <= SLOTS:
            return phases
        most = -(-most // SLOTS)
        nodes = phases[-1].select("grp", F.col("block").alias("slot"), F.col("left_n").alias("n"), "digest", F.lit(None).cast("string").alias("own"))


def _descend(phases: list[DataFrame], upper: DataFrame, keep: list[str]) -> DataFrame:
    """The first phase's nodes (grp, slot, digest, own) with path: left and right siblings at each
    level up to the root. upper has path and the columns of keep for each group's top."""
    for k, blocks in reversed(list(enumerate(phases))):
        on = ["grp"] if k == len(phases) - 1 else ["grp", "block"]
        held = blocks.join(upper.withColumnRenamed("slot", "block").select(*on, "path", *keep), on)

        def siblings(s: Column, j: int) -> Column:
            q = F.expr("0") + F.floor(s["i"] / FAN**j).cast("int")
            level, first = F.col(f"l{j}"), q - q % FAN
            return F.when(F.col("folds") > j, F.struct(F.array_join(F.slice(level, first + 1, q - first), "").alias("left"), F.array_join(F.slice(level, q + 2, first + FAN - 1 - q), "").alias("right")))

        own_path = lambda s: F.concat(F.filter(F.array(*(siblings(s, j) for j in range(LEVELS))), lambda p: p.isNotNull()), F.col("path"))
        each = F.transform("slots", lambda s: F.struct(s["i"].alias("i"), s["digest"].alias("digest"), s["own"].alias("own"), own_path(s).alias("path")))
        upper = held.select("grp", "block", *keep, F.inline(each)).withColumn("slot", F.col("block") * SLOTS + F.col("i")).drop("i", "block")
    return upper


def manifest(rows: DataFrame) -> DataFrame:
    """rows (grp, doc_id, leaf, row and one column `own`; written) as grp, slot, leaf, own, subroot, root
    and path, the siblings (left, right) of each level from the leaf to the root.

    A group's leaves ascend by doc_id, null ids first, equal ids by leaf; groups ascend by
    their key. Every three nodes in a row become their parent, a last run of fewer too,
    until one is left. No rows give no rows."""
    leaves, most = placed(rows)
    phases = _climb(leaves.select("grp", "slot", "n", F.col("leaf").alias("digest"), "own"), most)
    tops = common.materialize(ranked(phases[-1].select("grp", "digest"), "grp", name="slot"), "subroots")
    n = tops.count()
    over = _climb(tops.select(F.lit("").alias("grp"), "slot", F.lit(n).cast("long").alias("n"), "digest", F.col("grp").alias("own")), n)
    root = over[-1].select("grp", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    subroots = _descend(over, root, ["root"]).select(F.col("own").alias("grp"), F.col("digest").alias("subroot"), "path", "root")
    return _descend(phases, subroots, ["subroot", "root"]).withColumnRenamed("digest", "leaf")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda d, p: digest(p["left"], d, p["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, and what a check of it finds where texts lost their newlines.

    Null fields are hashed as `-`; empty and very long texts like any other; repeated rows are leaves of their own; rows with
    a null doc_id come first in their source and are not tampered with; an empty table gives no rows; other columns are not read."""
    docs = common.read(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.coalesce(common.split_of(F.col("doc_id"), 2) == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    docs = docs.withColumn("leaf", leaf())
    started = F.when(tampered, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), started.alias("start"))
    rows = docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", own.alias("own"), F.monotonically_increasing_id().alias("row"))
    found = manifest(common.materialize(rows, "leaves"))
    found = found.select("own.doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("own.start"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf_of = lambda text: f"sha256({' || '.join(part(c) for c in FIELDS[:-1])} || {part(text)})"
    up = lambda t: f"select g, lvl + 1, slot//3, sha256(string_agg(d, '' order by slot)), any_value((n + 2)//3) from {t} where n > 1 group by g, lvl, slot//3"
    side = lambda t, s, sign: f"coalesce((select string_agg(d, '' order by slot) from {t} x where x.g = {s}.g and x.lvl = {s}.lvl and x.slot//3 = {s}.q//3 and x.slot {sign} {s}.q), '')"
    return f"""with recursive d as (select row_number() over () k, doc_id, case when source is null then '-' else 's' || source end g, {leaf_of("text")} leaf,
  case when {common.crc32_sql("doc_id::varchar")} % 2 = 0 then {leaf_of("replace(text, chr(10), '')")} end other from documents),
p as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 slot, count(*) over (partition by g) n from d),
t(g, lvl, slot, d, n) as (select g, 0, slot, leaf, n from p union all {up("t")}), s as (select g, d, row_number() over (order by g) - 1 slot, count(*) over () n from t where n = 1),
u(g, lvl, slot, d, n) as (select '', 0, slot, d, n from s union all {up("u")}), h as (select g, lvl, any_value(n) n from t group by g, lvl having any_value(n) > 1), v as (select lvl, any_value(n) n from u group by lvl having any_value(n) > 1),
a as (select k, p.g, h.lvl, slot//(3**h.lvl)::bigint q from p join h on h.g = p.g), b as (select s.g own, '' g, v.lvl, slot//(3**v.lvl)::bigint q from s, v),
w as (select k, lvl, {side("t", "a", "<")} l, {side("t", "a", ">")} r from a union all select k, 1000 + b.lvl, {side("u", "b", "<")}, {side("u", "b", ">")} from b join p on p.g = b.own),
o as (select k, l, r, row_number() over (partition by k order by lvl) i from w),
f(k, i, d) as (select k, 0, coalesce(other, leaf) from d union all select f.k, f.i + 1, sha256(l || f.d || r) from f join o on o.k = f.k and o.i = f.i + 1),
z as (select k, arg_max(d, i) d from f group by k), e as (select k, sha256(string_agg(l || r, '' order by i)) proof from o group by k)
select p.doc_id, leaf, s.d subroot, (select d from u where n = 1) root, coalesce(e.proof, sha256('')) proof_sha256, z.d folded_root, z.d = (select d from u where n = 1) verified
from p join s on s.g = p.g join z on z.k = p.k left join e on e.k = p.k"""


SQL = _sql()
