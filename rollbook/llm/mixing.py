"""Mixing sources to target weights by Pfair scheduling: each source's text is cut into blocks, every block has a release
time and a deadline from its source's target weight, and in every slot the released block with the earliest deadline is
served. No source is ever a whole block ahead of or behind its weight.

While all sources last, block j of a source with the share w of the weights has the release time floor(j / w) and the
deadline ceil((j + 1) / w). A source that runs out leaves its slots to the others in proportion to their weights, from the
moment at which it runs out at its ideal rate; times are then those at which the ideal, fluid division reaches the block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A block has this many bytes of text, or the 2^-16th part of all text if that is more: a schedule has 2^17 slots at most.
BLOCK_BYTES, MOST_BLOCKS = 64 << 10, 1 << 16
#: Default target: each source's share of the bytes to this power, so that small sources count for more.
FLATTENING = 0.7
#: Rows of a source that one task puts in order.
BUCKET_ROWS = 5_000
#: Weights are whole numbers, of about this sum.
WEIGHT_UNITS = 10**12


class Fluid:
    """The ideal division of slots among sources with `blocks` (over 0) and `weights` (whole numbers over 0): at any moment
    each source that isn't done is served in proportion to its weight, one block a slot in all."""

    def __init__(self, blocks: list[int], weights: list[int]):
        self.weights = weights
        # sources in the order in which they run out: when each has been served n / w a unit of weight
        order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
        self.ends = [(blocks[s], weights[s]) for s in order]
        self.done = list(accumulate((blocks[s] for s in order), initial=0))
        self.active = list(accumulate((weights[s] for s in reversed(order)), initial=0))[::-1]

    def time(self, source: int, j: int, up: bool) -> int:
        """The slot in which the source's service reaches j blocks, rounded down or up."""
        w = self.weights[source]
        k, high = 0, len(self.ends)
        while k < high:  # how many sources have run out by then
            middle = (k + high) // 2
            n, v = self.ends[middle]
            k, high = (middle + 1, high) if n * w <= j * v else (k, middle)
        return self.done[k] - (-j * self.active[k] // w if up else -(j * self.active[k] // w))


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks, in the order of slots: earliest deadline first among the
    released blocks; of equal deadlines the source with the greater weight, then the first."""
    fluid = Fluid(blocks, weights)
    waiting = [(0, s, 0) for s, n in enumerate(blocks) if n]
    ready: list[tuple[int, int, int, int, int]] = []
    out = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (fluid.time(s, j + 1, True), -weights[s], s, j, fluid.time(s, j, False)))
        deadline, _, s, j, release = heapq.heappop(ready)
        out.append((s, j, release, deadline, slot))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (max(fluid.time(s, j + 1, False), slot + 1), s, j + 1))
    return out


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")


def weighed(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, bytes, weight) of every source, as a table: weights are whole numbers whose sum is about WEIGHT_UNITS."""
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be over 0")
    known = documents.groupBy(_source().alias("source")).agg(F.sum(_size()).alias("bytes"))
    if not weights:
        raw = known.withColumn("w", F.round(F.pow(F.col("bytes"), FLATTENING) * 1000).cast("decimal(38,0)"))
    else:
        # a source without a weight has its share of all bytes, beside the given weights
        given = documents.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, given double")
        total = known.agg(F.sum("bytes")).first()[0] or 1
        share = F.col("bytes") / total * sum(weights.values())
        raw = known.join(given, "source", "left").withColumn("w", F.round(F.coalesce("given", share) / sum(weights.values()) * 1e15).cast("decimal(38,0)"))
    total = raw.agg(F.sum("w")).first()[0] or 1
    return raw.select("source", "bytes", F.greatest(F.lit(1), F.round(F.col("w").cast("double") / float(total) * WEIGHT_UNITS)).cast("long").alias("weight"))


def blocked(documents: DataFrame, streams: DataFrame, block_bytes: int) -> DataFrame:
    """row, source, size, stream, block (from 0) and order (within the stream) of each document. A stream's documents stand
    in a random order that is fixed by a hash, in buckets of about BUCKET_ROWS rows; sums over buckets tell where each
    begins, so that a stream with most of the rows is put in order by many tasks. streams (source, stream) has the
    sources with more than a block, of which there are MOST_BLOCKS at most; all others are in stream -1."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), _source().alias("source"), F.xxhash64("doc_id", F.octet_length("text"), F.lit(23)).alias("key"), _size().alias("size"))
    rows = common.stored(rows.join(F.broadcast(streams), "source", "left").withColumn("stream", F.coalesce("stream", F.lit(-1))), "mixing")
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    # equal keys are told apart by the row, so that copies of one row are spread like others
    at = F.pmod(F.xxhash64("key", "row"), F.lit(1 << 40))
    rows = rows.withColumn("at", at).withColumn("bucket", F.floor(F.col("at") * buckets / float(1 << 40)).cast("int"))
    sums = rows.groupBy("stream", "bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k"))
    over = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stream", "bucket", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("k").over(over), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("stream", "bucket").orderBy("at", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"run": F.sum("size").over(own) - F.col("size"), "k": F.row_number().over(own) - 1}).join(sums, ["stream", "bucket"])
    return rows.select("row", "source", "size", "stream", F.floor((F.col("bytes_before") + F.col("run")) / block_bytes).cast("long").alias("block"), (F.col("rows_before") + F.col("k")).alias("order"))


def planned(documents: DataFrame, weights: dict[str, float] | None = None, block_bytes: int | None = None) -> DataFrame:
    """row, source, size, block, order, slot, release and deadline (in slots from the start) of each document.

    Sources that have no more than a block of text are never a block off their weight, whenever they are served: they
    make one stream together, with the sum of their weights, and `block` and `order` count in it. Every other source is a
    stream of its own. The driver gets a row for each stream, MOST_BLOCKS at most; the schedule is made in one task, which
    has twice that many slots at most, however much text there is.
    """
    spark = documents.sparkSession
    known = common.stored(weighed(documents, weights), "sources")
    total = known.agg(F.sum("bytes")).first()[0] or 0
    block_bytes = block_bytes or max(BLOCK_BYTES, -(-total // MOST_BLOCKS))
    large = [tuple(r) for r in known.where(F.col("bytes") > block_bytes).orderBy(F.desc("weight"), "source").collect()]
    small = known.where(F.col("bytes") <= block_bytes).agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    streams = [(k, n, w) for k, (_, n, w) in enumerate(large)] + ([(-1, *small)] if small["bytes"] else [])
    names = spark.createDataFrame([(s, k) for k, (s, _, _) in enumerate(large)], "source string, stream int")
    dealt = common.stored(blocked(documents, names, block_bytes), "blocks")
    # a stream has a block for each full or begun block of bytes
    blocks, parts = [-(-n // block_bytes) for _, n, _ in streams], [w for *_, w in streams]

    def scheduled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([(streams[s][0], j, slot, release, deadline) for s, j, release, deadline, slot in schedule(blocks, parts)], columns=["stream", "block", "slot", "release", "deadline"])

    table = spark.range(1 if streams else 0).repartition(1).mapInPandas(scheduled, "stream int, block long, slot long, release long, deadline long")
    return dealt.join(table, ["stream", "block"]).select("row", "source", "size", "block", "order", "slot", "release", "deadline")


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, block_bytes: int | None = None) -> DataFrame:
    """documents, with all their columns and rows, in the order in which sources are mixed: sorted by slot, and in a slot
    by the stream's own order. Written and read file by file, the rows stand in that order.

    weights: target share of the bytes by source (any scale; null means each source's bytes to the power 0.7). A source
    without a given weight has its share of the bytes for a weight, and weights of sources that there are not are
    ignored. Any number of sources may have any weights over 0, as exactly as 10^-12 of their sum. A source that runs out
    leaves its slots to the others in proportion. Null sources count as ''; null texts as empty (16 bytes); repeated rows
    and rows with equal ids all stay; an empty table gives an empty table; a text longer than a block stands in the block
    in which it begins. documents must give the same rows in the same order when read again.
    """
    names = documents.columns
    plan = planned(documents.select("doc_id", "text", "source"), weights, block_bytes).select("row", "slot", "order")
    rows = documents.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row")).join(plan, "row")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "slot", "order").sortWithinPartitions("slot", "order").select("doc.*")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    ids = documents.select("doc_id", F.monotonically_increasing_id().alias("row"))
    return planned(documents.select("doc_id", "text", "source")).join(ids, "row").select("doc_id", "source", "size", "block", "slot", "release", "deadline", "order")


QUERIES = {"op2_pfair_mixing": op2_pfair_mixing}
ORACLES: dict[str, str] = {}
