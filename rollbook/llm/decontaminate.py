"""Benchmark decontamination by suffix arrays of the training text: each shard of documents gets a suffix array, every
suffix of every benchmark item is looked up in it by binary search, and what matches word for word is located."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Text bytes of a shard that gets one suffix array; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Text bytes of benchmark items that are looked up in one pass over the documents. The block is what is broadcast.
BLOCK_BYTES = 4 << 20


class Block:
    """A block of test items: their words as numbers from 1 (0 is any other word), and their distinct windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        column = pa.array([text for _, text in items], pa.string())
        raw, starts = common.utf8(column)
        hashes, _, _, begins = common.words(raw, starts, common.IN_ALNUM)
        self.ids = [str(i) for i, _ in items]
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        self.words = np.concatenate([words.astype(np.int32) + 1, np.zeros(1, np.int32)])
        self.begins = begins
        counts = np.diff(begins)
        self.item = np.repeat(np.arange(len(items)), counts)
        self.left = np.repeat(begins[1:], counts) - np.arange(len(hashes))  # length of the suffix that begins here
        self.longest = int(counts.max(initial=0))
        # a window begins at each word with enough words after it; a shorter item is one window
        size = np.minimum(counts, window)[self.item] if len(self.item) else np.zeros(0, np.int64)
        self.window = np.where(self.left >= size, size, 0)

    @cached_property
    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The items' words with a 0 after each item, and their suffix array."""
        apart = np.insert(self.words[:-1], self.begins[1:], 0)
        return apart, suffix_array(apart, max(self.longest, 1))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes that begin with a token over 0, in order of their first `depth` tokens or more, where a
    0 ends a suffix. Prefix doubling: in each round only suffixes that aren't told apart yet are sorted again."""
    n = len(tokens)
    rank = np.concatenate([tokens.astype(np.int64), np.zeros(1, np.int64)])
    order = np.flatnonzero(tokens)
    order = order[np.argsort(rank[order], kind="stable")]
    # rank of a suffix: where its group begins in the order, plus 1
    new = np.ones(len(order), bool)
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    heads = np.flatnonzero(new)
    group = np.repeat(heads, np.diff(np.append(heads, len(order))))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = group + 1
    sizes = np.repeat(np.diff(np.append(heads, len(order))), np.diff(np.append(heads, len(order))))
    open_at = np.flatnonzero(sizes > 1)
    k = 1
    while k < depth and len(open_at):
        some = order[open_at]
        after = rank[np.minimum(some + k, n)]
        key = rank[some] * np.int64(n + 2) + after
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[open_at] = some
        first = np.ones(len(some), bool)
        first[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(first)
        lengths = np.diff(np.append(heads, len(some)))
        rank[some] = np.repeat(open_at[heads], lengths) + 1
        open_at = open_at[np.repeat(lengths, lengths) > 1]
        k *= 2
    return order


def look_up(tokens: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of the block's items, by binary search in the order: length of its longest match, the range of
    `order` with those longest matches, and for those that begin a window the range of suffixes that begin with it."""
    n, q = len(order), len(block.item)
    padded = np.concatenate([tokens, np.zeros(block.longest + 1, tokens.dtype)])
    low, high = np.zeros(q, np.int64), np.full(q, n, np.int64)
    matched = np.zeros(q, np.int64)
    window_low, window_high = np.zeros(q, np.int64), np.zeros(q, np.int64)
    live = np.flatnonzero(block.left > 0) if n else np.zeros(0, np.int64)
    depth = 0
    while len(live):
        goal = block.words[live + depth]
        edges = []
        for side in (0, 1):  # the first suffix whose token at this depth is at least, then over, the goal
            a, b = low[live].copy(), high[live].copy()
            while (more := a < b).any():
                middle = (a + b) >> 1
                token = padded[order[np.minimum(middle, n - 1)] + depth]
                below = (token < goal + side) & more
                a, b = np.where(below, middle + 1, a), np.where(more & ~below, middle, b)
            edges.append(a)
        hit = edges[0] < edges[1]
        live, first, last = live[hit], edges[0][hit], edges[1][hit]
        low[live], high[live] = first, last
        depth += 1
        matched[live] = depth
        full = live[block.window[live] == depth]
        window_low[full], window_high[full] = low[full], high[full]
        live = live[block.left[live] > depth]
    return matched, np.stack([low, high]), window_low, window_high


def reach(tokens: np.ndarray, places: np.ndarray, items: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """How many words from each place on match some item word for word, by binary search in the items' suffix array."""
    apart, order = items
    padded, after = np.concatenate([tokens, np.zeros(longest + 1, tokens.dtype)]), np.concatenate([apart, np.zeros(longest + 1, apart.dtype)])
    low, high, length = np.zeros(len(places), np.int64), np.full(len(places), len(order), np.int64), np.zeros(len(places), np.int64)
    live, depth = np.arange(len(places)), 0
    while len(live):
        goal = padded[places[live] + depth]
        live, goal = live[goal > 0], goal[goal > 0]
        edges = []
        for side in (0, 1):
            a, b = low[live].copy(), high[live].copy()
            while (more := a < b).any():
                middle = (a + b) >> 1
                below = (after[order[np.minimum(middle, len(order) - 1)] + depth] < goal + side) & more
                a, b = np.where(below, middle + 1, a), np.where(more & ~below, middle, b)
            edges.append(a)
        hit = edges[0] < edges[1]
        live = live[hit]
        low[live], high[live] = edges[0][hit], edges[1][hit]
        depth += 1
        length[live] = depth
    return length


class Shard:
    """A run of documents with the suffix array of their words."""

    def __init__(self, column: pa.Array, block: Block):
        raw, starts = common.utf8(column)
        hashes, _, _, self.begins = common.words(raw, starts, common.IN_ALNUM)
        self.counts = np.diff(self.begins)
        # words of all documents with a 0 after each, so that no match spans two
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts + 1)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(self.counts)), self.counts)
        self.tokens = np.zeros(len(self.owner), np.int32)
        if len(block.vocabulary) and len(hashes):
            at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
            self.tokens[place] = np.where(block.vocabulary[at] == hashes, at + 1, 0)
        self.order = suffix_array(self.tokens, max(block.longest, 1))


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Lists by row of values whose rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def shard_hits(rows: pa.Array, column: pa.Array, block: Block, located: bool = False) -> pa.RecordBatch:
    """For each document its words, the spans of words that windows of items cover, and those items; located: also the length
    of its longest match with an item and the word at which it begins."""
    shard = Shard(column, block)
    n = len(shard.counts)
    _, _, low, high = look_up(shard.tokens, shard.order, block)
    wide = np.flatnonzero(high > low)
    # equal windows of several items have one range of the order, which is expanded once
    spans, which = np.unique(np.stack([low[wide], high[wide], block.window[wide]], 1), axis=0, return_inverse=True)
    which = which.ravel()
    lengths = spans[:, 1] - spans[:, 0]
    window = np.repeat(np.arange(len(spans)), lengths)
    begin = shard.order[np.arange(len(window)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + spans[window, 0]]
    size = len(shard.tokens)
    cover = np.cumsum(np.bincount(begin, minlength=size + 1) - np.bincount(begin + spans[window, 2], minlength=size + 1))[:size] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    owner = shard.owner[first] if len(first) else np.zeros(0, np.int64)
    base = shard.begins[owner] + owner
    covered = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["first", "last"])
    # items of each window, then of each document
    of = np.unique(np.stack([which, block.item[wide]], 1), axis=0)
    at = np.searchsorted(of[:, 0], np.arange(len(spans) + 1))
    docs = np.unique(np.stack([shard.owner[begin], window], 1), axis=0)
    many = np.diff(at)[docs[:, 1]]
    item = of[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[docs[:, 1]], many), 1]
    both = np.unique(np.stack([np.repeat(docs[:, 0], many), item], 1), axis=0)
    names = pa.array(block.ids, pa.string()).take(pa.array(both[:, 1]))
    columns = {"row": rows, "n_words": pa.array(shard.counts), "spans": _lists(owner, covered, n), "items": _lists(both[:, 0], names, n)}
    if located:  # a match of a window or more begins with a window
        places, whose = np.unique(begin, return_inverse=True)
        length = reach(shard.tokens, places, block.suffixes, block.longest) if len(places) else np.zeros(0, np.int64)
        shorter = np.zeros(len(places), np.int64)  # below a window only whole items count
        np.maximum.at(shorter, whose, spans[window, 2])
        length = np.where(length >= WINDOW, length, shorter)
        best = np.lexsort([-places, length])  # the last of a document is its longest, of equal ones its first
        longest, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        longest[shard.owner[places[best]]] = length[best]
        at[shard.owner[places[best]]] = places[best] - shard.begins[shard.owner[places[best]]] - shard.owner[places[best]]
        columns |= {"longest": pa.array(longest), "at": pa.array(at, mask=longest == 0)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def shard_longest(rows: pa.Array, column: pa.Array, block: Block, least: int) -> pa.RecordBatch:
    """For each suffix of an item its longest match in this shard, of `least` words or more, and one place of it."""
    shard = Shard(column, block)
    matched, ranges, _, _ = look_up(shard.tokens, shard.order, block)
    suffix = np.flatnonzero(matched >= least)
    place = shard.order[ranges[0, suffix]] if len(suffix) else np.zeros(0, np.int64)
    owner = shard.owner[place] if len(place) else np.zeros(0, np.int64)
    ids = pa.array(block.ids, pa.string()).take(pa.array(block.item[suffix]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(suffix - block.begins[block.item[suffix]]), pa.array(matched[suffix]), rows.take(pa.array(owner)), pa.array(place - shard.begins[owner] - owner)],
        ["item_id", "item_word", "n_matched", "row", "doc_word"],
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        for first, last in common.pieces(batch.column("text"), SHARD_BYTES):
            part = batch.slice(first, last - first)
            yield part.column("row"), part.column("text")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id (a string; '' for null), text and size. An item longer than a block is cut into pieces of the same id that
    overlap by WINDOW - 1 words, so that every window of it is in a piece."""
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text IS NOT NULL").withColumn("size", F.octet_length("text"))
    step = max(BLOCK_BYTES // 16, WINDOW)
    words = F.array_remove(F.split(F.regexp_replace("text", common.NON_WORD + "+", " "), " "), "")
    long = sized.where(F.col("size") > BLOCK_BYTES).withColumn("words", words).where(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)), F.lit(step)))
    cut = long.withColumn("first", first).select("item_id", F.array_join(F.slice("words", F.col("first"), F.lit(step + WINDOW - 1)), " ").alias("text"))
    return sized.where(F.col("size") <= BLOCK_BYTES).union(cut.withColumn("size", F.octet_length("text")))


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES of text. Each block is collected by itself when it is asked for, and there
    are as many passes over the documents as blocks."""
    sized = common.stored(_items(benchmark), "items")
    if (total := sized.agg(F.sum("size")).first()[0] or 0) <= BLOCK_BYTES:
        yield Block([(r["item_id"], r["text"]) for r in sized.collect()])
        return
    n = -(-2 * total // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", F.octet_length("text"), F.substring("text", 1, 200)), F.lit(n))
    for k in range(n):
        yield Block([(r["item_id"], r["text"]) for r in sized.where(part == k).collect()])


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words of the
    longest stretch that is in an item word for word, a window of it at least; 0 without a hit), match_word (the word at which the first one of
    that length begins; else null), and items (the ids).

    A-Z are in lower case and words are runs of digits, letters a-z and anything beyond ASCII. Every window of 10 words
    of an item (a shorter item: all its words) is looked up; a document's word is hit if it stands in any occurrence.
    Null and empty texts have no words and no hits; items without words match nothing; several items with one id count
    as one. An item without an id counts as one whose id is the empty string. Repeated documents are each judged in their
    own row. Empty tables give no rows, or no hits. Columns other than doc_id and text, item_id and text are ignored.
    Of an item longer than a block, matches end with its pieces. documents must give the same rows in the same order when read again, if the items take more than one block.
    """
    out = _passes(documents, benchmark, partial(shard_hits, located=True), "n_words long, spans array<struct<first:bigint,last:bigint>>, items array<string>, longest long, at long")
    if isinstance(out, list):  # as many rows of a document as there are blocks of items
        out = reduce(DataFrame.union, out).groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max(F.struct("longest", (-F.col("at")).alias("minus"))).alias("x"))
        out = out.select("*", "x.longest", (-F.col("x.minus")).alias("at"))
    covered = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(x["last"] - F.greatest(x["first"], a["end"]), F.lit(0))).alias("n"), F.greatest(x["last"], a["end"]).alias("end")))["n"]
    items = F.array_sort(F.array_distinct("items"))
    return out.select(
        "row.doc_id", "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"), F.col("at").alias("match_word"), items.alias("items"),
    )


def _passes(documents: DataFrame, benchmark: DataFrame, function, fields: str, key: str = "row struct<doc_id:{},k:bigint>, ") -> DataFrame | list[DataFrame]:
    """What the function gives for runs of documents and a block of items. With several blocks each pass is written and its
    block let go before the next is collected."""
    spark = documents.sparkSession
    schema = key.format(documents.schema["doc_id"].dataType.simpleString()) + fields
    rows = documents.select(F.struct("doc_id", F.monotonically_increasing_id().alias("k")).alias("row"), "text")

    def over(block: Block) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(block)

        def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, column in _shards(batches):
                yield function(ids, column, sent.value)

        return rows.mapInArrow(matched, schema), sent

    several = blocks(benchmark)
    df, sent = over(next(several))
    out = []
    for block in several:
        out.append(common.stored(df, "hits"))
        sent.unpersist()
        df, sent = over(block)
    return [*out, common.stored(df, "hits")] if out else df


def longest_matches(documents: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """(item_id, item_word, n_matched, doc_id, doc_word): for each place of an item at which `least` words or more match
    some document word for word, the longest such match and one place of it (the least doc_id and word). Places of items
    longer than a block are counted from the beginning of their piece."""
    fields = "item_id string, item_word long, n_matched long, row struct<doc_id:{},k:bigint>, doc_word long".format(documents.schema["doc_id"].dataType.simpleString())
    parts = _passes(documents, benchmark, partial(shard_longest, least=least), fields, "")
    best = (reduce(DataFrame.union, parts) if isinstance(parts, list) else parts).groupBy("item_id", "item_word").agg(F.max("n_matched").alias("n_matched"), F.max_by(F.struct("row.doc_id", "doc_word"), F.struct("n_matched", -F.col("row.doc_id"), -F.col("doc_word"))).alias("x"))
    return best.select("item_id", "item_word", "n_matched", "x.doc_id", "x.doc_word")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents, with all their columns, without those that hold a window of an item, by the rules of contamination(): null
    and empty texts stay, copies go with each other, items without an id count, no items leave all. Each row is judged by
    its own text, so nothing is joined or shuffled; with several blocks of items what is left is written after each, but
    for the last."""
    spark = documents.sparkSession
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("row"), "text")
    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType)])

    def over(rows: DataFrame, block: Block) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, column in _shards(batches):
                hits = shard_hits(pa.nulls(len(ids), pa.int64()), column, sent.value)
                none = pa.compute.equal(pa.compute.list_value_length(hits.column("spans")), 0)
                yield pa.RecordBatch.from_arrays([ids.filter(none)], ["row"])

        return rows.mapInArrow(clean, kind).select("row", "row.text"), sent

    several = blocks(benchmark)
    rows, sent = over(rows, next(several))
    for block in several:
        rows = common.stored(rows, "clean")
        sent.unpersist()
        rows, sent = over(rows, block)
    return rows.select("row.*")


def op4_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS w FROM (
  SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1), lambda k: ws[k:k + {WINDOW - 1}])) AS w FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, k, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT rid, k, n, item_id FROM grams JOIN win USING (n, w)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM hit)) GROUP BY rid),
places AS (SELECT item, j, n, array_to_string(ws[j:j + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS j, least(len(ws), {WINDOW}) AS n FROM (SELECT ws, row_number() OVER () AS item FROM i WHERE len(ws) > 0))),
runs AS (SELECT rid, min(k) AS k, count(*) + any_value(n) - 1 AS size FROM (SELECT rid, k, n, item, k - j AS diagonal, k - row_number() OVER (PARTITION BY rid, item, k - j ORDER BY k) AS run FROM grams JOIN places USING (n, w)) GROUP BY rid, item, diagonal, run),
best AS (SELECT rid, max(size) AS longest_match, arg_min(k, (-size, k)) - 1 AS match_word FROM runs GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match, match_word
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid) LEFT JOIN best USING (rid)
"""

QUERIES = {"op4_suffix_array_decontamination": op4_suffix_array_decontamination}
ORACLES = {"op4_suffix_array_decontamination": OP4_SQL}
