"""Prefix trie of conversations as a burst trie.

A turn is a 128-bit id, a conversation the string of its turns' ids. Equal
conversations are one suffix with the digest of their ids. All suffixes begin in one
container under the root. A container of too many suffixes bursts: what its suffixes
share becomes a chain of heads, and they are dealt by the next turn id to containers
below. When no container is too large, shards of containers are sorted and swept once:
a stack of open nodes gives every node's totals, and a container's totals go up to its heads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.ranks import ranked

from . import common

#: Suffixes and turns from which on a container bursts; the result does not depend on them.
MOST_SUFFIXES, MOST_TURNS = 256, 1 << 14
#: Bytes of a turn id, and ids that one row of a digest's text holds.
ID, IDS_TOGETHER = 16, 20_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations
def _turn_id(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, ID)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, points): each conversation's turns in order, null turns first, equal
    ones by their ids; null role or text is empty; rows without a conv_id are left out. Ranks
    are taken over ranges of rows without texts, so one conversation may have any share of them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _turn_id(role, text).alias("id"), F.length(text).cast("int").alias("points"), F.monotonically_increasing_id().alias("row"))
    placed = common.materialize(ranked(common.materialize(rows, "turns"), "conv_id", "turn", "id", "row", name="at"), "places")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "id", "points")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path, points) of every conversation c after its first h turns were replaced by those
    of conversation c - c % every (fewer if it has fewer, none if it is absent), h = crc32(c) % most. c % every has c's sign."""
    turns = common.materialize(turns, "ordered turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    heads = turns.where(F.col("pos") < most - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "points"))).alias("head")).withColumnRenamed("conv_id", "base")
    every_one = turns.where("pos = 0").select("conv_id", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    tails = turns.withColumn("h", h).where("pos >= h").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "points"))).alias("tail"))
    both = every_one.join(heads, "base", "left").join(tails, "conv_id", "left")
    none = F.array().cast("array<struct<pos: bigint, id: binary, points: int>>")
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.coalesce("tail", none)).alias("seq")).select("conv_id", *_sequence(F.col("seq")))


def whole(turns: DataFrame) -> DataFrame:
    """(conv_id, path, points) of the conversations as they are."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "points"))).alias("seq")).select("conv_id", *_sequence(F.col("seq")))


def _sequence(seq: Column) -> list[Column]:
    path = F.unhex(F.array_join(F.transform(seq, lambda s: F.hex(s["id"])), ""))
    return [path.alias("path"), F.transform(seq, lambda s: s["points"]).alias("points")]


# ---------------------------------------------------------------- equal conversations
def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, conv_id): runs of a key as key, first id, count and the ids' text."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, lo = [], 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi] != keys[lo] or hi - lo == IDS_TOGETHER:
                out.append((keys[lo], ids[lo], hi - lo, ",".join(map(str, ids[lo:hi]))))
                lo = hi
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "first", "n", "text"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted runs: key, first id, count and the digest of the whole text, streamed."""
    key = first = run = None
    n, done = 0, []

    def end() -> None:
        if run is not None:
            done.append((key, first, n, run.hexdigest()))

    for batch in batches:
        for k, f, c, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if run is None or k != key:
                end()
                key, first, n, run = k, f, 0, hashlib.sha256()
            else:
                run.update(b",")
            n += c
            run.update(text.encode())
        if len(done) > 4096:
            yield _digest_batch(done)
            done = []
    end()
    yield _digest_batch(done)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "first", "n", "ends"])


def suffixes(sequences: DataFrame) -> DataFrame:
    """Different sequences: path, points, first (least conv_id), n and ends (digest of all ids, ascending).
    Ids are sorted by ranges, and only their texts meet by sequence, where they are hashed as they come."""
    sequences = common.materialize(sequences.withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 32))), "sequences")
    texts = sequences.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_id_texts, "key binary, first long, n long, text string")
    found = texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_id_digests, "key binary, first long, n long, ends string")
    return found.join(sequences.select(F.col("conv_id").alias("first"), "path", "points"), "first").select("path", "points", "first", "n", "ends")


# ---------------------------------------------------------------- bursts
def _shared(low: Column, high: Column) -> Column:
    """How many whole turns two paths begin with, by halving what is left to compare."""
    turns = F.least(F.octet_length(low), F.octet_length(high)) / ID
    steps = F.sequence(F.lit(1), F.ceil(F.log2(turns + 1)).cast("int") + 1)
    span = F.struct(F.lit(0).alias("lo"), turns.cast("int").alias("hi"))  # lo turns are equal, more than hi are not

    def halve(s: Column, _: Column) -> Column:
        mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.substring(low, 1, mid * ID) == F.substring(high, 1, mid * ID)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same | (s["lo"] == s["hi"]), s["hi"]).otherwise(mid - 1).alias("hi"))

    return F.aggregate(steps, span, halve)["lo"]


def _burst(suffix: DataFrame, most_suffixes: int, most_turns: int) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes by container (head: its path's digest, depth, up: the burst it came from, up_conv), and the bursts of each round."""
    now = suffix.withColumns({"head": F.lit(b""), "depth": F.lit(0), "up": F.lit(None).cast("binary"), "up_conv": F.lit(None).cast("long")})
    done, rounds = [], []
    while True:
        now = common.materialize(now, "containers")
        size = F.size("points") - F.col("depth")
        stats = now.groupBy("head", "depth", "up", "up_conv").agg(
            F.count("*").alias("suffixes"), F.sum(size).alias("turns"), F.min("first").alias("conv"), F.sum("n").alias("n_convs"), F.min("path").alias("low"), F.max("path").alias("high"), F.min_by("points", "path").alias("low_points")
        )
        large = stats.where((F.col("suffixes") > most_suffixes) | ((F.col("turns") > most_turns) & (F.col("suffixes") > 1)))
        large = common.materialize(large.withColumn("at", _shared(F.col("low"), F.col("high"))).drop("low", "high"), "bursts")
        if not large.take(1):
            done.append(now)
            return _union(done), rounds
        done.append(now.join(large.select("head"), "head", "left_anti"))
        held = now.drop("depth", "up", "up_conv").join(large.select("head", "at", "conv"), "head").withColumn("over", F.size("points") > F.col("at"))
        own = held.where("not over").select(F.col("head").alias("h"), "ends")
        rounds.append(common.materialize(large.join(own, large["head"] == own["h"], "left").drop("h"), "heads"))
        next_head = F.unhex(F.substring(F.sha2(F.substring("path", F.lit(1), (F.col("at") + 1) * ID), 256), 1, 32))
        now = held.where("over").select("path", "points", "first", "n", "ends", next_head.alias("head"), (F.col("at") + 1).alias("depth"), F.col("head").alias("up"), F.col("conv").alias("up_conv"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- sweep
class _Open:
    """A node whose subtree is being read."""

    __slots__ = ("conv", "n", "points", "ends", "children", "leaves", "saved", "below")

    def __init__(self, points: int) -> None:
        self.conv, self.n, self.points, self.ends = None, 0, points, _NONE
        self.children = self.leaves = self.saved = 0
        self.below: list[list] = []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by container and path: all nodes; a container's top also names the burst above it."""
    types = (*[pa.int64()] * 7, pa.string(), pa.binary())
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "up")
    ready: list[list] = []
    head = path = None
    stack: list[_Open] = []
    base = top = up_conv = None

    def close(to: int) -> None:
        """Ends the open nodes deeper than `to` levels below the container's top; -1 ends all."""
        while len(stack) - 1 > to:
            x = stack.pop()
            depth = base + len(stack)
            leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.points
            for row in x.below:  # its children were waiting for its conv_id
                row[2] = x.conv
            ready.extend(x.below)
            row = [x.conv, depth, None, x.n, x.children, leaves, saved, x.ends, None]
            if stack:
                over = stack[-1]
                over.children, over.leaves, over.saved, over.n = over.children + 1, over.leaves + leaves, over.saved + saved, over.n + x.n
                over.conv = x.conv if over.conv is None or x.conv < over.conv else over.conv
                over.below.append(row)
            else:
                row[2], row[8] = up_conv, top
                ready.append(row)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names)

    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for h, d, u, uc, p, points, first, n, ends in zip(*(columns[c] for c in ("head", "depth", "up", "up_conv", "path", "points", "first", "n", "ends"))):
            if path is None or h != head:
                close(-1)
                head, base, top, up_conv = h, d, u, uc
                stack.append(_Open(points[d - 1] if d else 0))
            else:
                same, most = base, min(len(path), len(p)) // ID
                while same < most and path[same * ID : same * ID + ID] == p[same * ID : same * ID + ID]:
                    same += 1
                close(same - base)
            for k in range(base + len(stack) - 1, len(points)):
                stack.append(_Open(points[k]))
            last = stack[-1]
            last.n, last.ends = last.n + n, ends
            last.conv = first if last.conv is None or first < last.conv else last.conv
            path = p
        if len(ready) > 4096:
            yield batch_of(ready)
            ready = []
    close(-1)
    yield batch_of(ready)


def prefix_trie(sequences: DataFrame, most_suffixes: int = MOST_SUFFIXES, most_turns: int = MOST_TURNS) -> DataFrame:
    """The trie's nodes of sequences (conv_id, path, points; conv_id differs): conv_id (least
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: members but one, times the code points of the node's last turn) and ends_sha256
    (ids of the members that end there). (conv_id, depth) names a node.

    A sequence is held whole by a task, and the open nodes of a sweep are as many as the
    longest has turns. No sequences give no nodes, not even a root."""
    contained, rounds = _burst(suffixes(sequences), most_suffixes, most_turns)
    swept = contained.select("head", "depth", "up", "up_conv", "path", "points", "first", "n", "ends").repartition("head").sortWithinPartitions("head", "path").mapInArrow(_sweep, f"{NODE}, up binary")
    if not rounds:
        return swept.drop("up")
    swept = common.materialize(swept, "nodes")
    # what containers pass up to the burst above them, and bursts from round to round
    below = [swept.where("up is not null").groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))]
    heads = []
    for large in reversed(rounds):
        parts = _union(below).groupBy(F.col("up").alias("head")).agg(*(F.sum(c).alias(f"sub_{c}") for c in ("n_children", "n_leaves", "saved_tokens")))
        # the burst's chain: nodes of depth..at, the suffixes' last common turns
        own = F.transform(F.sequence("depth", "at"), lambda d: F.when(d > 0, (F.col("n_convs") - 1) * F.get("low_points", d - 1)).otherwise(0).cast("long"))
        chain = large.join(parts, "head").withColumn("own", own).withColumn("all", F.aggregate("own", F.col("sub_saved_tokens"), lambda a, x: a + x))
        chain = common.materialize(chain, "chains")
        heads.append(chain)
        below.append(chain.where("up is not null").select("up", F.lit(1).cast("long").alias("n_children"), F.col("sub_n_leaves").alias("n_leaves"), F.col("all").alias("saved_tokens")))

    def nodes(chain: DataFrame) -> DataFrame:
        each = chain.select("*", F.explode(F.sequence("depth", "at")).alias("d"))
        bottom = F.col("d") == F.col("at")
        saved = F.aggregate(F.slice("own", F.col("d") - F.col("depth") + 1, F.col("at") - F.col("d") + 1), F.col("sub_saved_tokens"), lambda a, x: a + x)
        return each.select(
            F.col("conv").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") > F.col("depth"), F.col("conv")).otherwise(F.col("up_conv")).alias("parent_conv_id"), "n_convs",
            F.when(bottom, F.col("sub_n_children")).otherwise(1).alias("n_children"), F.col("sub_n_leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.when(bottom, F.coalesce("ends", F.lit(_NONE))).otherwise(_NONE).alias("ends_sha256"),
        )

    return _union([swept.drop("up"), *map(nodes, heads)])


def with_turns(nodes: DataFrame, sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn (null at the root). Each different turn's
    text is read once, by its id; sequences give the ids of a node's least member."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = conversations.select(_turn_id(role, text).alias("id"), role.alias("role"), text.alias("text")).dropDuplicates(["id"])
    ids = sequences.select("conv_id", F.posexplode(F.sequence(F.lit(1), F.size("points"))).alias("at", "depth"), "path").where("depth > 0")
    ids = ids.select("conv_id", F.col("depth").cast("long").alias("depth"), F.substring("path", (F.col("depth") - 1) * ID + 1, F.lit(ID)).alias("id"))
    named = nodes.select("conv_id", "depth").join(ids, ["conv_id", "depth"]).join(words, "id").drop("id")
    return nodes.join(named, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations.

    Null turns come first, equal turns in the order of their ids (repeated rows are turns of their own); null roles and texts are
    empty; rows with a null conv_id belong to no conversation; an empty table gives no nodes; texts of any length are hashed whole;
    other columns are not read."""
    return prefix_trie(rebuilt(turns_of(common.read(spark, sf_dir, "conversations"))))


SQL = f"""with o as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 p, [coalesce(role, ''), coalesce(text, '')] x from conversations where conv_id is not null),
s as (select c, list(x order by p) s, {common.crc32_sql("c::varchar")} % 6 h from o group by c),
r as (select s.c, list_concat(coalesce(b.s, [])[1:s.h], s.s[s.h + 1:]) s from s left join s b on b.c = s.c - s.c % 100),
m as (select c, s[1:d] k, d, len(s) = d last from r, unnest(range(0, len(s) + 1)) t(d)),
n as (select k, any_value(d) d, min(c) c, count(*) n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) e from m group by k),
f as (select n.k, n.c, n.d, p.k pk, p.c pc, n.n, n.e, case when n.d = 0 then 0 else (n.n - 1)*length(n.k[n.d][2]) end v from n left join n p on n.d > 0 and p.k = n.k[1:n.d - 1]),
g as (select pk k, count(*) ch from f where pk is not null group by pk), a as (select f.k[1:d2] k, sum(v) saved, count(*) filter (g.ch is null) leaves from f left join g on g.k = f.k, unnest(range(0, f.d + 1)) t(d2) group by 1)
select f.c conv_id, f.d depth, f.pc parent_conv_id, f.n n_convs, coalesce(g.ch, 0) n_children, a.leaves n_leaves, a.saved::bigint saved_tokens, f.e ends_sha256 from f left join g on g.k = f.k join a on a.k = f.k"""
