"""Conversations as a trie of shared prefixes: distinct prefix digests get slots of a minimal perfect hash, shard by shard, and
counts are scattered into flat arrays and summed up through the slots of their parents, deepest first."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .sharding import CRC32_SQL

#: A rebuilt conversation begins with up to MOST_SHARED - 1 turns of the first of its group of FAMILY ids.
FAMILY, MOST_SHARED = 5, 9
#: Turns are numbered in stretches of so many, so that a long conversation is not one task's.
STRETCH = 256
#: Nodes with many members are the top of the trie, MOST_HEAVY at most; none with fewer than LEAST_HEAVY members is.
MOST_HEAVY, LEAST_HEAVY = 1 << 18, 4096
#: Nodes of a shard that are aimed at.
SHARD_NODES = 1 << 17
KEY = ["depth", "k1", "k2"]
_NO_CONVERSATION = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def turns(conversations: DataFrame) -> DataFrame:
    """c, p (from 1, in the order of turn, null first), two digests of role and text, bytes of the text: all that is needed,
    without the texts. Turns are numbered in stretches, and stretches counted up."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, F.lit(2), role).alias("b"), F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = rows.withColumn("s", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60))))
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("c", "s").count().select("c", "s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("c", "s").orderBy(F.asc_nulls_first("turn"), "a", "b")
    return rows.withColumn("p", F.row_number().over(inside)).join(counts, ["c", "s"]).select("c", (F.col("p") + F.col("before")).alias("p"), "a", "b", "bytes")


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one too: c, depth, k1 and k2 (the prefix's digest: the
    exclusive or of its turns' digests, each hashed with its place), p1 and p2 (its parent's), bytes of the last turn's
    text, last (no turn follows)."""
    numbered = common.stored(turns(conversations), "turns")
    head = numbered.where((F.col("c") % FAMILY == 0) & (F.col("p") < MOST_SHARED)).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "a", "b", "bytes"))).alias("head"))
    sizes = numbered.groupBy("c").agg(F.max("p").alias("n")).withColumns({"h": shared_turns(F.col("c")).cast("int"), "base": F.col("c") - F.col("c") % FAMILY})
    plan = sizes.join(head, "base", "left").withColumn("head", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<p:bigint,a:bigint,b:bigint,bytes:bigint>>")))
    plan = plan.withColumns({"g": F.size("head"), "total": F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))})
    shared = plan.select("c", "total", F.explode("head").alias("t")).select("c", "total", F.col("t.p").alias("depth"), "t.a", "t.b", "t.bytes")
    own = numbered.join(plan.select("c", "h", "g", "total"), "c").where("p > h").select("c", "total", (F.col("p") - F.col("h") + F.col("g")).alias("depth"), "a", "b", "bytes")
    rows = shared.unionByName(own).select("c", "total", "depth", F.floor(F.col("depth") / STRETCH).alias("s"), F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64(F.lit(3), "b", "a", "depth").alias("y"), "bytes")
    upto = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("c", "s").agg(F.bit_xor("x").alias("x0"), F.bit_xor("y").alias("y0"))
    earlier = earlier.select("c", "s", *(F.coalesce(F.bit_xor(v).over(upto), F.lit(0)).alias(v) for v in ("x0", "y0")))
    inside = Window.partitionBy("c", "s").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"k1": F.bit_xor("x").over(inside), "k2": F.bit_xor("y").over(inside)}).join(earlier, ["c", "s"])
    k1, k2 = F.col("k1").bitwiseXOR(F.col("x0")), F.col("k2").bitwiseXOR(F.col("y0"))
    below = summed.select("c", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x")).alias("p1"), k2.bitwiseXOR(F.col("y")).alias("p2"), "bytes", (F.col("depth") == F.col("total")).alias("last"))
    zero = F.lit(0).cast("long")
    top = plan.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"), (F.col("total") == 0).alias("last"))
    return top.unionByName(below)


class Slots:
    """A minimal perfect hash of distinct keys (rows of whole numbers): keys that are alone at their place of a bit table are
    placed there, the others go on to the next, smaller table; a key's slot is the number of placed keys before it. Every
    slot keeps its key, so that a look-up of a key that isn't there gives -1."""

    _TABLES = 48

    def __init__(self, keys: np.ndarray):
        self.tables: list[tuple[int, np.ndarray, int]] = []
        self.keys = np.empty_like(keys)
        rest, done = np.arange(len(keys)), 0
        codes = _codes(keys)
        for level in range(self._TABLES):
            if not len(rest):
                break
            size = 2 * len(rest) + 1
            place = _place(codes[rest], level, size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.cumsum(alone) - alone + done
            self.tables.append((size, np.where(alone, ranks, -1), level))
            self.keys[ranks[place[alone[place]]]] = keys[rest[alone[place]]]
            done += int(alone.sum())
            rest = rest[~alone[place]]
        # keys of one 64-bit code can't be told apart by tables
        self.crowded = {tuple(keys[row]): slot for slot, row in enumerate(rest, done)}
        for key, slot in self.crowded.items():
            self.keys[slot] = key

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        codes = _codes(keys)
        for size, ranks, level in self.tables:
            slot = ranks[_place(codes, level, size)]
            hit = (out < 0) & (slot >= 0)
            hit[hit] = (self.keys[slot[hit]] == keys[hit]).all(axis=1)
            out[hit] = slot[hit]
        if self.crowded:
            for i in np.flatnonzero(out < 0):
                out[i] = self.crowded.get(tuple(keys[i]), -1)
        return out


def _codes(keys: np.ndarray) -> np.ndarray:
    code = np.zeros(len(keys), np.uint64)
    for column in keys.T:
        code = common.mixed(code * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return code


def _place(codes: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)
    return (common.mixed(codes + salt) % np.uint64(size)).astype(np.int64)


def summed(table: pa.Table) -> pa.Table:
    """Nodes of a shard with children, leaves and saved summed over their subtrees. What children elsewhere add is in the
    columns before they come in."""
    column = {n: table.column(n).to_numpy() for n in ("n", "bytes", "enders", "children", "leaves", "saved")}
    keys = np.stack([table.column(n).to_numpy() for n in KEY], axis=1)
    slots = Slots(keys)
    slot, parent_of = slots.find(keys), np.empty(len(keys), np.int64)
    # a root is no one's child
    up = np.stack([keys[:, 0] - 1, table.column("p1").to_numpy(), table.column("p2").to_numpy()], axis=1)
    parent_of[slot] = slots.find(up)
    flat = {}
    for name, values in column.items():
        flat[name] = np.empty(len(keys), np.int64)
        flat[name][slot] = values
    depth, alone = slots.keys[:, 0], flat["n"] == 1
    has = parent_of >= 0
    children = flat["children"] + np.bincount(parent_of[has], minlength=len(keys))
    # whoever has one member is followed by a line of its own turns
    children[alone] = 1 - flat["enders"][alone]
    leaves = flat["leaves"] + ((children == 0) | alone)
    saved = flat["saved"] + (flat["n"] - 1) * flat["bytes"]
    order = np.argsort(-depth, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        rows = rows[has[rows]]
        np.add.at(leaves, parent_of[rows], leaves[rows])
        np.add.at(saved, parent_of[rows], saved[rows])
    out = table
    for name, values in (("children", children), ("leaves", leaves), ("saved", saved)):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values[slot]))
    return out


def _endings(batches):
    """The digest of the sorted ids of each key's rows, which come one after the other: only a hash's state is kept."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        ids = batch.column(3).to_pylist()
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else np.zeros(1, int)
        done = []
        for begin, end in zip(cuts[:-1], cuts[1:]):
            text = ",".join(map(str, ids[begin:end])).encode()
            if tuple(keys[begin]) == now:
                digest.update(b"," + text)
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = tuple(keys[begin].tolist()), hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done) if done else ([], [], [], []), schema)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, digest.hexdigest()), schema)], schema=schema)


def trie(conversations: DataFrame, most_heavy: int = MOST_HEAVY, least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; other columns don't matter. Rows without conv_id are left out; null roles and
    texts are empty ones; turns are in order, null first, and rows of one turn in an order that depends on their roles and
    texts alone (repeated rows are turns of their own). Every conversation counts, also one that is rebuilt without turns.
    A prefix is known by 128 bits; that all its rows have one parent and one length of text is verified, and an error
    otherwise. An empty table gives no rows.

    Counts are aggregated within tasks before they meet, however many conversations share a prefix. Nodes with least_heavy
    members and more are the top, `most_heavy` at most. The shards hold whole subtrees below it, of fewer members each;
    the top is summed up last, from one row a node. Nodes of one conversation whose parents have no other either are in no
    shard, so that long conversations don't fill one. Ids that end at a node are hashed in a sorted stream, one after the
    other, as SHA-256 wants them.
    """
    rows = common.stored(prefixes(conversations), "prefixes")
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("c").alias("conv"), *(F.min(c).alias(c) for c in ("p1", "p2", "bytes")), *(F.max(c).alias(f"{c}_most") for c in ("p1", "p2", "bytes")), F.sum(F.col("last").cast("long")).alias("enders"))
    one = (F.col("p1") == F.col("p1_most")) & (F.col("p2") == F.col("p2_most")) & (F.col("bytes") == F.col("bytes_most"))
    nodes = common.stored(found.withColumn("n", F.when(one, F.col("n")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))).drop("p1_most", "p2_most", "bytes_most"), "nodes")
    # the smallest power of two that few enough nodes reach
    sizes = dict(nodes.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect())
    bits, many = 63, 0
    while bits and many + sizes.get(bits - 1, 0) <= most_heavy:
        bits -= 1
        many += sizes.get(bits, 0)
    least = max(least_heavy, 1 << bits)
    heavy, light = nodes.where(F.col("n") >= least), nodes.where(F.col("n") < least)

    above = lambda t, *more: t.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), *more)
    up = ["depth", "p1", "p2"]
    known = nodes.join(F.broadcast(above(heavy, F.col("conv").alias("top"))), up, "left")
    rest = known.where("top IS NULL").drop("top").join(above(light, F.col("conv").alias("parent"), (F.col("n") == 1).alias("tail")), up, "left")
    linked = common.stored(known.where("top IS NOT NULL").withColumnRenamed("top", "parent").withColumn("tail", F.lit(False)).unionByName(rest.withColumn("tail", F.coalesce("tail", F.lit(False)))), "linked")

    # the first node of a conversation's path that isn't part of the top is the root of its subtree
    roots = rows.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti").groupBy("c").agg(F.min(F.struct(*KEY)).alias("root"))
    blank = {c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    shards = max(1, -(-sum(sizes.values()) // SHARD_NODES))
    inner = linked.where((F.col("n") < least) & ~F.col("tail")).withColumns(blank)
    kept = [*KEY, "p1", "p2", "n", "conv", "parent", "bytes", "enders", *blank]
    inner = inner.join(roots, F.col("conv") == F.col("c")).select(F.pmod(F.xxhash64("root"), F.lit(shards)).alias("shard"), *kept)
    schema = ", ".join(f"{c} long" for c in kept)
    subtrees = common.stored(inner.groupBy("shard").applyInArrow(lambda t: summed(t.select(kept)), schema), "subtrees")

    added = subtrees.join(F.broadcast(above(heavy)), up, "left_semi").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    added = added.agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    top = linked.where(F.col("n") >= least).join(added, KEY, "left").fillna(0, list(blank)).select(kept)
    # at most `most_heavy` rows
    top = top.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: summed(t.select(kept)), schema)
    alone = linked.where("tail").withColumns({"children": 1 - F.col("enders"), "leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")}).select(kept)

    ends = rows.where("last").select(*KEY, "c").repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(_endings, "depth long, k1 long, k2 long, ends_sha256 string")
    out = subtrees.unionByName(top).unionByName(alone).join(ends, KEY, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_CONVERSATION)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


#: A node's leaves and savings are summed over conversations: each has those nodes of its path whose smallest member it is.
OP13_SQL = (
    CRC32_SQL.rsplit("hexed AS", 1)[0]
    + f"""
o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT c, ts, c - c % {FAMILY} AS base, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i::INT + 1, 1))::UBIGINT)),
  lambda a, x: xor(a >> 8, t[(xor(a & 255, x))::INT + 1])), 4294967295::UBIGINT) % {MOST_SHARED})::INT AS h FROM o, crc_table),
r AS (SELECT a.c, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts FROM hs a LEFT JOIN o b ON b.c = a.base),
m AS (SELECT c, d, md5(to_json(ts[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(ts[1:d - 1])::VARCHAR) END AS pk, CASE WHEN d > 0 THEN octet_length(encode(ts[d].t)) ELSE 0 END AS b, d = len(ts) AS fin
  FROM r, range(0, 100000) g(d) WHERE d <= len(ts)),
n AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (fin), '')) AS ends FROM m GROUP BY d, k),
kids AS (SELECT pk, d - 1 AS d, count(*) AS n_children FROM n GROUP BY ALL),
w AS (SELECT m.c, m.d, m.k, CASE WHEN c = conv AND n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN c = conv THEN (n - 1) * n.b ELSE 0 END AS saved FROM m JOIN n USING (d, k) LEFT JOIN kids ON kids.pk = m.k AND kids.d = m.d),
s AS (SELECT d, k, sum(leaf) OVER p AS leaves, sum(saved) OVER p AS saved FROM w WINDOW p AS (PARTITION BY c ORDER BY d DESC)),
t AS (SELECT d, k, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM s GROUP BY ALL)
SELECT n.conv AS conv_id, n.d AS depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends AS ends_sha256
FROM n JOIN t USING (d, k) LEFT JOIN n p ON p.k = n.pk AND p.d = n.d - 1 LEFT JOIN kids ON kids.pk = n.k AND kids.d = n.d
"""
)

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": OP13_SQL}
