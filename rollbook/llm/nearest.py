"""Approximate nearest neighbours: a hierarchical k-means tree over a sample, every row in its leaf, and for each query the
leaves in best-bin-first order, as many as a calibrated recall takes."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .whitening import matrix, sound, width_of

N_NEAREST = 5
QUERY_STEP = 50
#: The tree is fitted on so many vectors and bytes at most, and calibrated on so many queries.
FIT_ROWS, FIT_BYTES, CALIBRATION_QUERIES = 32_768, 32 << 20, 256
#: Rows of a leaf that are aimed at, sample rows that a leaf needs at least, children of a node, rounds of k-means.
LEAF_ROWS, LEAF_SAMPLE, FAN, ROUNDS = 512, 16, 8, 8
#: Share of the true neighbours of the calibration queries that the visited leaves must hold.
RECALL = 0.97
#: A task compares at most about so many vectors with so many queries at a time.
VECTORS, QUERIES_AT_ONCE = 4096, 1024
#: Products of a matrix multiplication that are closer than this are told apart by the exact measure.
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """centres (node by dimension, of unit vectors); children of node i: first[i] to first[i] + fan[i]; fan 0: leaf[i] is its number."""

    centres: np.ndarray
    first: np.ndarray
    fan: np.ndarray
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def placed(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree, always to the nearest child."""
        at = np.zeros(len(unit), np.int64)
        moving = np.flatnonzero(self.fan[at])
        while len(moving):
            for node in np.unique(at[moving]):
                rows, children = moving[at[moving] == node], slice(self.first[node], self.first[node] + self.fan[node])
                at[rows] = self.first[node] + _distances(unit[rows], self.centres[children]).argmin(axis=1)
            moving = moving[self.fan[at[moving]] > 0]
        return self.leaf[at]

    def best_bins(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The first `most` leaves of each row, best bin first: the nearest open node of a priority queue is opened next."""
        out = np.empty((len(unit), min(most, self.n_leaves)), np.int32)
        for begin in range(0, len(unit), 256):
            for row, distance in enumerate(_distances(unit[begin : begin + 256], self.centres), begin):
                queue, found = [(0.0, 0)], 0
                while found < out.shape[1]:
                    _, node = heapq.heappop(queue)
                    if not self.fan[node]:
                        out[row, found] = self.leaf[node]
                        found += 1
                    for child in range(self.first[node], self.first[node] + self.fan[node]):
                        heapq.heappush(queue, (distance[child], child))
        return out


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors to centres, less what is the same for all centres of a row."""
    return (centres * centres).sum(axis=1) - 2 * rows @ centres.T


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def grown(unit: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about so many leaves by k-means, level by level; nodes whose vectors are all equal stay leaves."""
    rng = np.random.default_rng(seed)
    small = max(1, -(-len(unit) // max(1, leaves)))
    centres, first, fan, members = [unit.mean(axis=0) if len(unit) else np.zeros(unit.shape[1])], [0], [0], [np.arange(len(unit))]
    for node in range(10**9):
        if node == len(centres):
            break
        rows = members[node]
        members[node] = None
        if len(rows) <= small:
            continue
        points, k = unit[rows], int(min(FAN, -(-len(rows) // small)))
        means = points[rng.choice(len(points), k, replace=False)]
        for _ in range(ROUNDS):
            near = _distances(points, means).argmin(axis=1)
            used = np.unique(near)
            means = np.stack([points[near == c].mean(axis=0) for c in used])
        near = _distances(points, means).argmin(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            continue
        first[node], fan[node] = len(centres), len(used)
        for c in used:
            centres.append(means[c])
            first.append(0)
            fan.append(0)
            members.append(rows[near == c])
    fan = np.array(fan)
    return Tree(np.stack(centres), np.array(first), fan, np.where(fan == 0, np.cumsum(fan == 0) - 1, -1))


def best(vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest vectors, and all that the kth ties with: query index, vector index, cosine. What is near
    is found by a matrix product and measured anew by one formula, which doesn't depend on what else is compared."""
    length, own = norms(vectors), norms(queries)
    product = (queries / own[:, None]) @ (vectors / length[:, None]).T
    k = min(k, len(vectors))
    least = np.partition(product, product.shape[1] - k, axis=1)[:, product.shape[1] - k] if k else np.zeros(len(queries))
    q, v = np.nonzero(product >= least[:, None] - SLACK)
    score = np.concatenate([(queries[q[i : i + 65536]] * vectors[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.zeros(0)]) / (own[q] * length[v])
    return q, v, score


def _top(q: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's first k by score, then tie."""
    order = np.lexsort([tie, -score, q])
    begins = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[place < k]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each q with the largest score, ties to the smaller least id."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _true(classes: DataFrame, queries: np.ndarray, k: int, width: int):
    """Brute force for few queries over all rows: q, score, least, leaf of the k nearest of each; one pass, few rows a task."""

    def of(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, VECTORS):
                part = batch.slice(begin, VECTORS)
                least, leaf = part.column("least").to_numpy(), part.column("leaf").to_numpy()
                q, v, score = best(matrix(part.column("vector"), width, np.float64), queries, k)
                keep = _top(q, score, least[v], k)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int64)), pa.array(score[keep]), pa.array(least[v[keep]]), pa.array(leaf[v[keep]])], ["q", "score", "least", "leaf"])

    return _ranked(classes.select("vector", "least", "leaf").mapInArrow(of, "q long, score double, least long, leaf int"), k).collect()


def visits_needed(tree: Tree, unit: np.ndarray, truth, k: int, recall: float) -> int:
    """Leaves to visit: widened until the calibration queries' true neighbours are among them with the given recall."""
    wanted = [[] for _ in unit]
    for row in truth:
        if row["score"] < 1 - SLACK:  # the query itself and what is equal to it are in the first leaf
            wanted[row["q"]].append(row["leaf"])
    order = tree.best_bins(unit, tree.n_leaves)
    place = np.empty_like(order)
    np.put_along_axis(place, order.astype(np.int64), np.arange(order.shape[1], dtype=order.dtype)[None, :].repeat(len(order), 0), axis=1)
    ranks = np.concatenate([place[i, w] for i, w in enumerate(wanted)]) if any(wanted) else np.zeros(0)
    visits = 1
    while visits < tree.n_leaves and len(ranks) and (ranks < visits).mean() < recall:
        visits += max(1, visits // 8)
    return min(visits, tree.n_leaves)


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their `keep` smallest ids (sorted) and the least one: of equal vectors no others can be among
    anyone's nearest. Ranks are cut within tasks before they are shuffled, so copies of one vector don't meet."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= keep)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("least"))


def nearest(df: DataFrame, queries: DataFrame, k: int = N_NEAREST, vector: str = "embedding", key: str = "vec_id", recall: float = RECALL) -> DataFrame:
    """(query_id, rank from 1, `key`, score): each query's k nearest rows of df by cosine in double precision, other than the
    rows of its own id, nearest first, ties to the smaller id; all of them, if fewer than k.

    Both tables have `key` (whole numbers) and `vector`. Rows without an id or with a vector that is null, zero, of another
    length than most of df's, or not finite in an entry or in its length take no part. Repeated rows of an id are one
    candidate; repeated query rows each get their answer. An empty table gives no rows; other columns don't matter.

    A tree of about a leaf for LEAF_ROWS distinct vectors is fitted on a sample of FIT_ROWS and FIT_BYTES at most, and every
    row goes to its leaf. CALIBRATION_QUERIES queries are answered by brute force, and as many leaves are visited as hold
    `recall` of their true neighbours. Leaf and visitors meet in cells of about VECTORS by QUERIES_AT_ONCE, however full a
    leaf is.
    """
    spark = df.sparkSession
    shape = sound(df.where(F.col(key).isNotNull()), vector)
    width = width_of(shape, vector)
    long = lambda t: sound(t.where(F.col(key).isNotNull()), vector).where(F.size(vector) == width).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    fine = lambda t: long(t).where((square > 0) & (square < float("inf")))
    empty = spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    if not width:
        return empty
    flat = common.stored(_classes(fine(df).distinct(), k + 1), "classes")
    asked = common.stored(fine(queries), "asked")
    wanted = common.stored(asked.select("vector").distinct(), "wanted").withColumn("q", F.monotonically_increasing_id())
    n, n_wanted = flat.count(), wanted.count()
    if not n or not n_wanted:
        return empty

    def sampled(t: DataFrame, rows: int, total: int) -> np.ndarray:
        x = matrix((t if total <= rows else t.sample(rows / total, seed=11)).select("vector").toArrow().column(0).combine_chunks(), width, np.float64)
        return x[: 2 * rows]

    fit = sampled(flat, min(FIT_ROWS, max(1, FIT_BYTES // (8 * width))), n)
    tree = grown(fit / norms(fit)[:, None], max(1, min(n // LEAF_ROWS, len(fit) // LEAF_SAMPLE)))
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def leaf_of(x: pa.Array) -> pa.Array:
        rows = matrix(x, width, np.float64)
        return pa.array(shared.value.placed(rows / norms(rows)[:, None]).astype(np.int32))

    classes = common.stored(flat.withColumn("leaf", leaf_of("vector")), "leaves")
    trial = sampled(wanted, CALIBRATION_QUERIES, n_wanted)
    visits = visits_needed(tree, trial / norms(trial)[:, None], _true(classes, trial, k + 1, width), k + 1, recall) if tree.n_leaves > 1 else 1

    @F.arrow_udf("array<int>")
    def leaves_of(x: pa.Array) -> pa.Array:
        rows = matrix(x, width, np.float64)
        bins = shared.value.best_bins(rows / norms(rows)[:, None], visits)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * bins.shape[1], pa.int32()), pa.array(bins.ravel()))

    visitors = common.stored(wanted.select("q", leaves_of("vector").alias("leaves")), "visitors")
    one_each = visitors.select("q", F.explode("leaves").alias("leaf"))
    # one row a leaf, of which a tree has FIT_ROWS / LEAF_SAMPLE at most
    cuts = classes.groupBy("leaf").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("parts")).join(one_each.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("turns")), "leaf")
    cuts = F.broadcast(common.stored(cuts, "cuts"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = classes.join(cuts, "leaf").select("leaf", F.pmod(F.xxhash64("least", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.explode(upto("turns")).alias("turn"), "vector", "ids", "least")
    right = one_each.join(wanted, "q").join(cuts, "leaf").select("leaf", F.explode(upto("parts")).alias("part"), F.pmod(F.xxhash64("q"), F.col("turns")).cast("int").alias("turn"), "q", "vector")

    def compared(vectors: pa.Table, visiting: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("least", pa.int64()), ("ids", pa.list_(pa.int64()))])
        if not vectors.num_rows or not visiting.num_rows:
            return schema.empty_table()
        rows, who = matrix(vectors.column("vector").combine_chunks(), width, np.float64), visiting.column("q").to_numpy()
        least, picked = vectors.column("least").to_numpy(), []
        for begin in range(0, visiting.num_rows, QUERIES_AT_ONCE):
            q, v, score = best(rows, matrix(visiting.column("vector").slice(begin, QUERIES_AT_ONCE).combine_chunks(), width, np.float64), k + 1)
            keep = _top(q, score, least[v], k + 1)
            picked.append((who[begin + q[keep]], score[keep], v[keep]))
        q, score, v = (np.concatenate(x) for x in zip(*picked))
        return pa.table([pa.array(q), pa.array(score), pa.array(least[v]), vectors.column("ids").combine_chunks().take(pa.array(v))], schema=schema)

    cell = ["leaf", "part", "turn"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compared, "q long, score double, least long, ids array<long>")
    tops = _ranked(found, k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "least", "ids"))).alias("found"))
    answers = asked.join(wanted, "vector").select(F.col("id").alias("query_id"), "q").join(tops, "q")
    each = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["minus"]).alias("score"), i.alias("id")))))
    # classes of one score are one list, in the order of ids
    each = F.array_sort(F.transform(each, lambda c: F.struct((-c["score"]).alias("minus"), c["id"].alias("id"))))
    others = F.slice(F.filter(each, lambda c: c["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("i", "c")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("c.id").alias(key), (-F.col("c.minus")).alias("score"))


def op12_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row whose id is divisible by 50, over all rows."""
    table = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(table, table.where(F.col("vec_id") % QUERY_STEP == 0))


#: Brute force: what the search finds where its visits hold all true neighbours, as on one leaf.
OP12_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {N_NEAREST}
"""

QUERIES = {"op12_kmeans_tree_search": op12_kmeans_tree_search}
ORACLES = {"op12_kmeans_tree_search": OP12_SQL}
