"""Near-duplicates by min-max hashing: of each permutation both the least and the greatest value are kept, so that half
the hash evaluations fill a signature; bands of it give candidates, and full shingle sets confirm every link."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: Links need 100 * intersection >= percent * union; this percent where the caller gives none.
PERCENT = 85
#: 50 permutations give 100 values.
PERMUTATIONS = 50
#: A pair of just the least similarity has no band in common with this chance at most.
MOST_MISSED = 1e-5
#: Buckets with more pairs across components than this are resolved by the prefix join.
MOST_PAIRS = 48
#: Bits of the filter that tells which texts are wanted.
MOST_FILTER_BITS = 1 << 26
#: A shingle with more than this part of all rows of shingles is joined by broadcast: there are no more than so many.
HOT_PART = 4096

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def band_rows(percent: int) -> int:
    """Values in a band: as many as MOST_MISSED allows. 85 gives 20 bands of 5 (no band in common once in 120,000), 80
    gives 25 of 4 (once in 500,000)."""
    if not 11 <= percent <= 100:
        raise ValueError("percent must be from 11 to 100: below, single values miss too many pairs")
    return max(r for r in range(1, 2 * PERMUTATIONS + 1) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MOST_MISSED)


def least_estimate(percent: int) -> float:
    """Pairs whose signatures agree in a smaller share are not looked at further: 4.75 standard deviations below percent
    (0.68 for 85, 0.61 for 80)."""
    p = percent / 100
    return math.floor(100 * (p - 4.75 * math.sqrt(p * (1 - p) / (2 * PERMUTATIONS)))) / 100


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of up to 256, sorted, as 64-bit numbers (row in the top 8 bits, 56 bits of
    hash below), and where each row's begin (with the end last)."""
    raw, starts = common.utf8(column)
    hashes, _, _, begins = common.words(raw, starts, common.IN_SPACED)
    counts = np.diff(begins)
    n = len(counts)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    powers = common.powers(SHINGLE)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    rows = np.repeat(np.arange(n, dtype=np.uint64), counts)
    left = np.repeat(begins[1:], counts) - np.arange(len(hashes))  # words from here to the end of the text
    folded = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        folded += np.where(left > k, padded[k : k + len(hashes)] * powers[k], np.uint64(0))
    short = np.repeat(counts < SHINGLE, counts)
    first = np.arange(len(hashes)) == np.repeat(begins[:-1], counts)
    keep = (left >= SHINGLE) | (short & first)
    folded[short] += np.minimum(left, SHINGLE).astype(np.uint64)[short]
    keys = np.sort((rows[keep] << np.uint64(56)) | (common.mixed(folded[keep]) >> np.uint64(8)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.searchsorted(keys >> np.uint64(56), np.arange(n + 1, dtype=np.uint64))


def signatures(keys: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free sums over each row's set, and its min-max values (all 0 for an empty set)."""
    n = len(begins) - 1
    full = np.flatnonzero(np.diff(begins))
    one, two, values = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, 2 * PERMUTATIONS), np.uint64)
    if len(full):
        at = begins[:-1][full]
        own = keys & np.uint64((1 << 56) - 1)
        one[full] = np.add.reduceat(common.mixed(own + np.uint64(0x1234567)), at)
        two[full] = np.add.reduceat(common.mixed(own ^ np.uint64(0x5DEECE66D5DEECE6)), at)
        for k in range(PERMUTATIONS):
            y = own * _A[k] + _B[k]
            values[full, 2 * k] = np.minimum.reduceat(y, at)
            values[full, 2 * k + 1] = np.maximum.reduceat(y, at)
    return one, two, values


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in common.pieces(batch.column(text), 1 << 22):
            for at in range(first, last, 256):
                yield batch.slice(at, min(256, last - at))


def _featured(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    bands = 2 * PERMUTATIONS // size
    for block in _blocks(batches, "text"):
        keys, begins = shingle_sets(block.column("text"))
        one, two, values = signatures(keys, begins)
        n = block.num_rows
        banded = np.zeros((n, bands), np.uint64)
        powers = common.powers(size + 1)
        for b in range(bands):
            banded[:, b] = common.mixed((common.mixed(values[:, b * size : (b + 1) * size]) * powers[1:]).sum(1, dtype=np.uint64) + np.uint64(b))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(banded.view(np.int64).ravel()))
        short = np.ascontiguousarray((values >> np.uint64(24)).astype(np.uint16))
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("row"), pa.array(np.diff(begins)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, pa.array([r.tobytes() for r in short], pa.binary())],
            ["doc_id", "row", "n", "one", "two", "bands", "signature"],
        )


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        near = (a == b).mean(1) >= least
        yield batch.select(["a", "b"]).filter(pa.array(near))


def similar(left: pa.Array, right: pa.Array, percent: int = PERCENT) -> np.ndarray:
    """Whether the full shingle sets of left[i] and right[i] are similar, for up to 256 rows."""
    (x, bx), (y, by) = shingle_sets(left), shingle_sets(right)
    common_keys = np.intersect1d(x, y, assume_unique=True)
    both = np.bincount((common_keys >> np.uint64(56)).astype(np.int64), minlength=len(bx) - 1)
    union = np.diff(bx) + np.diff(by) - both
    return (union > 0) & (100 * both >= percent * union)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            block = batch.slice(at, 256)
            yield block.select(["a", "b"]).filter(pa.array(similar(block.column("ta"), block.column("tb"), percent)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, "text"):
        keys, begins = shingle_sets(block.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array((keys & np.uint64((1 << 56) - 1)).view(np.int64)))
        yield pa.RecordBatch.from_arrays([block.column("node"), lists], ["node", "tokens"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of edges (a, b) reaches. Least labels spread and jump to their
    labels' labels; every round is written to the shared folder, so that no lineage grows."""
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = common.stored(spread.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        changed = not new.where("comp != old").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after more links: components are found among those that the links join, not anew."""
    sides = _labelled(links.select(F.col("a").alias("node"), "b"), labels).select(F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("b").alias("node"))
    sides = common.stored(_labelled(sides, labels).select("a", "ca", F.col("node").alias("b"), F.col("comp").alias("cb")).where("ca != cb"), "joins")
    if sides.isEmpty():
        return labels
    comps = components(sides.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    fresh = sides.select(F.col("a").alias("node"), F.col("ca").alias("comp")).union(sides.select(F.col("b").alias("node"), F.col("cb").alias("comp"))).where("node = comp").distinct()
    known = labels.union(fresh.join(labels.select("node"), "node", "left_anti"))
    return common.stored(known.join(comps, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")


def _joined(pairs: DataFrame, values: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    a = values.select(F.col("node").alias("a"), F.col(column).alias(names[0]))
    b = values.select(F.col("node").alias("b"), F.col(column).alias(names[1]))
    return pairs.join(a, "a").join(b, "b")


class _Nodes:
    """Classes of equal shingle sets, and what is known of them; percent is the least similarity of a link."""

    def __init__(self, documents: DataFrame, percent: int):
        self.percent = percent
        rows = documents.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
        kind = documents.schema["doc_id"].dataType.simpleString()
        self.features = common.stored(rows.select("doc_id", "text", "row").mapInArrow(partial(_featured, size=band_rows(percent)), f"doc_id {kind}, row long, n long, one long, two long, bands array<long>, signature binary"), "minmax")
        keys = ["one", "two", "n"]
        self.classes = common.stored(self.features.where("n > 0").groupBy(*keys).agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
        chosen = self.features.join(self.classes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "bands", "signature")
        self.signatures = common.stored(chosen, "signatures")
        self.rows, self.keys = rows, keys

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of nodes (distinct). A filter of fixed size tells most other rows before any text is shuffled."""
        wanted = common.stored(nodes, "wanted")
        may = _may_hold(wanted)
        found = self.rows.select(F.col("row").alias("node"), "text").where(may("node"))
        return common.stored(found.join(wanted, "node", "left_semi"), "texts")


def _places(numbers: np.ndarray, size: int) -> np.ndarray:
    """Two bits of a filter of `size` bits (a power of two) for each number."""
    spread = common.mixed(numbers.astype(np.int64).view(np.uint64) + np.uint64(0x51ED2701))
    return np.stack([spread, common.mixed(spread)], 1) & np.uint64(size - 1)


def _marked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _places(batch.column("node").to_numpy(zero_copy_only=False), size).ravel()
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])


def _may_hold(nodes: DataFrame):
    """A predicate that all of nodes fulfil and few other numbers: a Bloom filter with 16 bits for each, MOST_FILTER_BITS at
    most (8 MiB, which is broadcast). Beyond some 16 million nodes it lets more and more pass, and never loses any."""
    size = min(MOST_FILTER_BITS, 1 << max(13, (16 * nodes.count()).bit_length()))
    marks = nodes.select("node").mapInArrow(partial(_marked, size=size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(size // 64, np.uint64)
    words[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64).view(np.uint64)
    sent = nodes.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may(numbers: pd.Series) -> pd.Series:
        at = _places(numbers.to_numpy(), size)
        return pd.Series(((sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1))

    return may


def _confirm(nodes: _Nodes, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return common.stored(_joined(pairs, texts, "text", ("ta", "tb")).mapInArrow(partial(_confirmed, percent=nodes.percent), "a long, b long"), "links")


def _across(members: DataFrame, key: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs of members of a key that are in different components: of any such pair, one at least is outside the
    component that most of the key's members are in, so that no pairs within that one are ever made. Also the keys that
    would give more than `most` pairs, which are left out."""
    parts = members.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("k"))
    keys = parts.groupBy(key).agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("largest")).where("total > largest")
    work = (F.col("total") - F.col("largest")) * F.col("total")
    few = keys if most is None else keys.where(work <= most)
    many = keys.where(work > most) if most is not None else keys.limit(0)
    left = members.join(few.select(key, "main"), key).where("comp != main")
    right = members.select(key, *(F.col(c).alias(f"{c}_b") for c in members.columns if c != key))
    return left.join(right, key).where("comp != comp_b AND (node < node_b OR comp_b = main)"), many


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(nodes: _Nodes) -> DataFrame:
    """(node, comp) of all nodes that similar sets connect with others: the component's least node. Links within a component
    that others connect already are not looked for."""
    percent = nodes.percent
    members = nodes.signatures.select("node", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = common.stored(members.join(shared, "key"), "buckets")
    # each bucket's members are held against its most central one, which shares most buckets with others
    degrees = members.groupBy("node").agg(F.sum("k").alias("degree"))
    ranked = members.join(degrees, "node")
    centres = ranked.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre"))
    star = members.join(centres, "key").where("node != centre").select(*_ordered("node", "centre")).distinct()
    found = _near(nodes, star)
    texts = nodes.texts(found.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    first = _confirm(nodes, found, texts)
    labels = components(first)

    # then pairs across the components of a bucket
    pairs, dense = _across(_labelled(members.select("key", "node", "n"), labels), "key", MOST_PAIRS)
    rest = common.stored(pairs.where(f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)").select(*_ordered("node", "node_b")).distinct(), "pairs")
    crowd = common.stored(members.join(dense.select("key"), "key").select("node", "n").distinct(), "crowd")
    found = _near(nodes, rest)
    texts = nodes.texts(found.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct())
    second = _confirm(nodes, found, texts)
    labels = joined_labels(labels, second)
    if crowd.isEmpty():
        return labels
    # in crowded buckets: sets with that similarity share one of their rarest shingles, as many as may differ and one
    tokens = common.stored(texts.join(crowd, "node").select("node", "text").mapInArrow(_hashed, "node long, tokens array<long>"), "tokens")
    each = tokens.select("node", F.explode("tokens").alias("token"))
    total = tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0
    df = common.stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "shingles")
    hot = df.where(F.col("df") > max(total // HOT_PART, 1)).select("token")
    by_rarity = _by_key(each, df, "token", hot).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    length = F.size("ts") - F.ceil(F.size("ts") * percent / 100).cast("int") + 1
    prefix = by_rarity.select("node", F.size("ts").alias("n"), F.posexplode(F.slice("ts", F.lit(1), length)).alias("at", "t")).where("t.df > 1").select("node", "n", "at", F.col("t.token").alias("token"))
    prefix = common.stored(prefix, "prefix")
    room = f"1 + least(n - at - 1, n_b - at_b - 1) >= ceil({percent} / {100 + percent}D * (n + n_b) - 1e-9) AND 100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
    # again a star first: the member whose token stands earliest in its order has the fewest rare shingles
    middle = prefix.groupBy("token").agg(F.min_by("node", F.struct("at", "node")).alias("centre"))
    star = _by_key(_labelled(prefix, labels), middle, "token", hot).where("node != centre")
    star = star.join(labels.select(F.col("node").alias("centre"), F.col("comp").alias("centre_comp")), "centre", "left").where("comp != coalesce(centre_comp, centre)")
    third = _confirm(nodes, _near(nodes, star.select(*_ordered("node", "centre")).distinct()), texts)
    labels = joined_labels(labels, third)
    pairs, _ = _across(_labelled(prefix, labels), "token", None)
    fourth = _confirm(nodes, _near(nodes, pairs.where(room).select(*_ordered("node", "node_b")).distinct()), texts)
    return joined_labels(labels, fourth)


def _by_key(df: DataFrame, facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """df joined with facts (one row for each key), where rows of the hot keys, HOT_PART at most, stay where they are."""
    warm = df.join(F.broadcast(facts.join(F.broadcast(hot), key, "left_semi")), key)
    cool = df.join(F.broadcast(hot), key, "left_anti").join(facts, key)
    return warm.unionByName(cool)


def _near(nodes: _Nodes, pairs: DataFrame) -> DataFrame:
    return common.stored(_joined(pairs, nodes.signatures, "signature", ("sa", "sb")).mapInArrow(partial(_estimated, least=least_estimate(nodes.percent)), "a long, b long"), "near")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, and copies (documents with an equal set).

    Words are runs of anything but ASCII white space, with A-Z in lower case; a set has the distinct 5-word shingles, or
    the whole sequence where there are fewer words. Null, empty and blank texts have an empty set and stand alone. Equal
    sets are linked without being expanded into pairs, others where their Jaccard similarity is percent / 100 or more. A
    component's id is its least doc_id; a null doc_id has none below it only if all its component's ids are null. Rows
    that repeat a doc_id are judged each by its own text. An empty table gives an empty table; columns other than doc_id
    and text are ignored. documents must give the same rows in the same order when read again.
    """
    nodes = _Nodes(documents, percent)
    labels = linked(nodes)
    classes = _labelled(nodes.classes, labels)
    groups = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = classes.join(groups, "comp").select(*nodes.keys, "component_id")
    out = nodes.features.select("doc_id", *nodes.keys).join(named, nodes.keys, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents, with all their columns, with one row of each component: the one with the least doc_id, of equal ones
    the first; links need a Jaccard similarity of percent / 100. Texts without words all stay. documents must give the
    same rows in the same order when read again."""
    nodes = _Nodes(documents, percent)
    labels = linked(nodes)
    named = _labelled(nodes.classes, labels).select(*nodes.keys, "comp")
    rows = common.stored(nodes.features.select("doc_id", "row", *nodes.keys).join(named, nodes.keys).select("doc_id", "row", "comp"), "members")
    first = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    gone = rows.join(first, "comp").where("row != first.row").select("row")
    names = documents.columns
    kept = documents.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row")).join(gone, "row", "left_anti")
    return kept.select("doc.*")


def op9_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END) AS s FROM d),
one AS (SELECT rid, unnest(s) AS x, len(s) AS n FROM sh),
links AS (SELECT a.rid AS a, b.rid AS b FROM one a JOIN one b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT reach.a AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.rid GROUP BY reach.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sh JOIN comp USING (rid)
"""

QUERIES = {"op9_minmax_neardup": op9_minmax_neardup}
ORACLES = {"op9_minmax_neardup": OP9_SQL}
