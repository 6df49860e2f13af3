"""Toxicity: character n-grams of a text have embeddings in hashed buckets, which are averaged over a window of words
into a linear softmax; embeddings and softmax are trained jointly, so that misspellings never seen share the vectors of
the n-grams they keep. A text's score is that of its most toxic window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS, DIMENSIONS, LENGTHS = 1 << 17, 8, (3, 4, 5, 6)
#: Words of a window, and n-grams that its mean is over at least: few words weigh as little as among others.
WINDOW, LEAST_NGRAMS = 8, 100
THRESHOLD = 0.7
#: Most labelled rows, and most bytes of their texts, that the classifier is fitted on: half of each label.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 6 << 20
#: Rounds on drawn windows (so many of each text), then on the most toxic ones.
WARM_UP, DRAWN, EPOCHS = 6, 16, 8
BATCH, RATE, DECAY = 512, 0.05, 1e-3
#: N-grams that a smaller share of the texts has (or fewer than 3) are left out.
LEAST_SHARE = 0.004


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts' words (with their edges), the window each belongs to, and the windows of each
    text (where they begin, with the end last). Every text has one window at least; A-Z are in lower case."""
    raw, starts = common.utf8(column)
    n = len(starts) - 1
    low = common.LOWER[raw]
    inside = common.IN_ALNUM[low]
    # a boundary byte stands before every text, so that none of its n-grams spans two texts
    at = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(starts)) + 1
    text = np.zeros(len(raw) + n + 2, np.uint8)
    text[at] = np.where(inside, low, 0)
    edge = text == 0
    begin = ~edge
    begin[1:] &= edge[:-1]
    word = np.cumsum(begin) - 1  # the word that a byte, or the boundary after it, belongs to
    word_of = np.searchsorted(np.flatnonzero(begin), starts[:-1] + np.arange(n) + 1)
    counts = np.diff(np.append(word_of, begin.sum()))
    windows = np.maximum(-(-counts // WINDOW), 1)
    first = np.concatenate([[0], np.cumsum(windows)])
    window_of_word = np.repeat(first[:-1], counts) + (np.arange(counts.sum()) - np.repeat(word_of, counts)) // WINDOW
    # a word counts once in a window: repetition adds nothing
    hashes = common.words(raw, starts, common.IN_ALNUM)[0]
    once = np.zeros(len(hashes) + 1, bool)
    if len(hashes):
        once[np.unique(common.mixed(hashes ^ common.mixed(window_of_word.astype(np.uint64))), return_index=True)[1]] = True
    buckets, owners = [], []
    size = len(text)
    for length in LENGTHS:
        m = size - length + 1
        if m <= 0:
            continue
        h = np.full(m, length, np.uint32)
        whole = np.ones(m, bool)
        for k in range(length):
            h = h * np.uint32(0x01000193) ^ text[k : k + m]
            if 0 < k < length - 1:
                whole &= ~edge[k : k + m]
        start = word[:m] + edge[:m]  # an n-gram that begins at a boundary belongs to the word after it
        pick = np.flatnonzero(whole & once[start])
        h = h[pick]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        buckets.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
        owners.append(window_of_word[start[pick]])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), first
    return np.concatenate(buckets), np.concatenate(owners), first


@dataclass
class Model:
    """gain: each bucket's embedding times the difference of the two softmax weights; all that scoring needs."""

    gain: np.ndarray
    bias: float

    def windows(self, buckets: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(owners, minlength=n), LEAST_NGRAMS)
        return np.bincount(owners, self.gain[buckets], n) / size + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        buckets, owners, first = ngrams(column)
        logit = np.maximum.reduceat(self.windows(buckets, owners, int(first[-1])), first[:-1])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class _Windows:
    """The training texts' windows: the buckets of their known n-grams, window after window, where each window's begin,
    the n-grams that its mean is over, and the windows of each text. Built a piece of text at a time."""

    def __init__(self, column: pa.Array):
        buckets, counts, windows = [], [], []
        frequency = np.zeros(BUCKETS, np.int64)
        for start, stop in common.pieces(column, 1 << 18):
            own, owners, first = ngrams(column.slice(start, stop - start))
            by = np.argsort(owners, kind="stable")
            own, owners = own[by], owners[by]
            text = np.repeat(np.arange(stop - start), np.diff(first))
            frequency += np.bincount(np.unique(own.astype(np.int64) * (stop - start) + text[owners]) // (stop - start), minlength=BUCKETS)
            buckets.append(own)
            counts.append(np.bincount(owners, minlength=int(first[-1])))
            windows.append(np.diff(first))
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(windows))])
        self.known = frequency >= max(3, LEAST_SHARE * len(column))
        self.size = np.maximum(np.concatenate(counts), LEAST_NGRAMS)
        left = [np.add.reduceat(np.append(self.known[b], False), np.minimum(np.cumsum(c) - c, len(b))) * (c > 0) for b, c in zip(buckets, counts, strict=True)]
        self.spans = np.concatenate([[0], np.cumsum(np.concatenate(left))])
        self.buckets = np.concatenate([b[self.known[b]] for b in buckets])

    def values(self, gain: np.ndarray) -> np.ndarray:
        """Each window's mean of gain."""
        sums = np.zeros(len(self.size))
        gain = gain.astype(np.float32)
        for a in range(0, len(sums), 50_000):
            spans = self.spans[a : a + 50_001]
            part = np.append(gain[self.buckets[spans[0] : spans[-1]]], np.float32(0))
            sums[a : a + 50_000] = np.add.reduceat(part, spans[:-1] - spans[0]) * (np.diff(spans) > 0)
        return sums / self.size


class _Joint:
    """Embeddings and softmax weights under Adam, trained together on windows with a label each."""

    def __init__(self, rng: np.random.Generator):
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.weights = rng.normal(0, 0.5, DIMENSIONS).astype(np.float32)  # of label 1 less those of label 0
        self.bias = 0.0
        self.moments = [np.zeros_like(self.embedding), np.zeros_like(self.embedding), np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)]
        self.step = 0

    def learn(self, data: _Windows, windows: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """One step of averaged cross-entropy on these windows."""
        lengths = data.spans[windows + 1] - data.spans[windows]
        grams = data.buckets[np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(data.spans[windows], lengths)]
        row = np.repeat(np.arange(len(windows)), lengths)
        gain = self.embedding @ self.weights
        logit = np.bincount(row, gain[grams], len(windows)) / data.size[windows] + self.bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(windows)
        slope = np.bincount(grams, (error / data.size[windows])[row], BUCKETS).astype(np.float32)
        used = np.flatnonzero(slope)
        g_weights = np.append(slope[used] @ self.embedding[used], error.sum())
        g_embedding = slope[used, None] * self.weights + DECAY * self.embedding[used] / len(windows)
        self.step += 1
        one, two = 1 - 0.9**self.step, 1 - 0.999**self.step
        m = self.moments
        m[0][used] = 0.9 * m[0][used] + 0.1 * g_embedding
        m[1][used] = 0.999 * m[1][used] + 0.001 * g_embedding**2
        m[2] = 0.9 * m[2] + 0.1 * g_weights
        m[3] = 0.999 * m[3] + 0.001 * g_weights**2
        self.embedding[used] -= rate * (m[0][used] / one) / (np.sqrt(m[1][used] / two) + 1e-8)
        change = rate * (m[2] / one) / (np.sqrt(m[3] / two) + 1e-8)
        self.weights -= change[:-1].astype(np.float32)
        self.bias -= float(change[-1])


def fit(column: pa.Array, labels: np.ndarray, seed: int = 5) -> Model:
    """Trains first on windows drawn from all texts, each with its text's label, then for some rounds on each text's most
    toxic window, and last fits scale and bias to the texts' labels. N-grams that few texts have are left out, as they
    would only learn single labels by heart."""
    rng = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
        return Model(np.zeros(BUCKETS), -5.0)
    data = _Windows(column)
    n, first = len(labels), data.first
    text = np.repeat(np.arange(n), np.diff(first))
    joint = _Joint(rng)
    window_label = labels[text]
    # labels weigh alike
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    any_window = lambda k: (first[:-1, None] + np.floor(rng.random((n, k)) * np.diff(first)[:, None]).astype(np.int64))
    rounds = WARM_UP + EPOCHS
    for epoch in range(rounds):
        if epoch < WARM_UP:
            drawn = any_window(DRAWN).ravel()
        else:
            top = np.lexsort((-data.values(joint.embedding @ joint.weights), text))[first[:-1]]
            drawn = np.concatenate([top, any_window(1)[labels == 0, 0]])
        repeated = np.repeat(drawn, rng.poisson(weight[text[drawn]]))
        rng.shuffle(repeated)
        for chosen in np.array_split(repeated, max(1, len(repeated) // BATCH)):
            if len(chosen):
                joint.learn(data, chosen, window_label[chosen], RATE * (1 - epoch / rounds))
    gain = (joint.embedding @ joint.weights).astype(np.float64) * data.known
    best = np.maximum.reduceat(data.values(gain), first[:-1])
    scale, bias = _calibrated(best, labels, weight)
    return Model(gain * scale, bias)


def _calibrated(best: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and bias of the most likely logistic curve through the texts' values (Newton's method, slightly damped)."""
    spread = best.std() or 1.0
    x = np.stack([(best - best.mean()) / spread, np.ones_like(best)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 1e-2 * np.array([at[0], 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        at -= np.clip(np.linalg.solve(curve, slope), -1, 1)
    scale = max(float(at[0]), 1e-3) / spread
    return scale, float(at[1]) - scale * float(best.mean())


def remainder(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 3


def training_sample(documents: DataFrame, labels: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Up to SAMPLE_ROWS labelled rows that aren't held out, half of each label, in the order of a hash of doc_id; from
    these, whole texts up to SAMPLE_BYTES. Documents with several labels take the greatest."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = documents.select("doc_id", F.octet_length("text").alias("size")).where((remainder() != 1) & (F.col("size") > 0))  # texts are not shuffled
    few = common.stored(sizes.join(known, "doc_id").withColumn("at", F.xxhash64("doc_id", F.lit(11))), "labelled")
    drawn: dict = {}
    counts = {r["toxic"]: r["count"] for r in few.groupBy("toxic").count().collect()}
    for toxic in (0, 1):
        room = SAMPLE_BYTES // 2
        # about twice as many as are wanted come from all tasks together, in the order of the hash
        chance = min(1.0, SAMPLE_ROWS / max(counts.get(toxic, 0), 1))
        for r in few.where((F.col("toxic") == toxic) & (F.pmod("at", F.lit(1 << 40)) <= int(chance * (1 << 40)))).orderBy("at", "doc_id", "size").limit(SAMPLE_ROWS // 2).collect():
            if r["doc_id"] not in drawn and r["size"] <= room:
                room -= r["size"]
                drawn[r["doc_id"]] = (r["at"], toxic)
    if not drawn:
        return pa.array([], pa.string()), np.zeros(0)
    ids = documents.sparkSession.createDataFrame([(i, at, toxic) for i, (at, toxic) in sorted(drawn.items())], T.StructType([documents.schema["doc_id"], T.StructField("at", T.LongType()), T.StructField("toxic", T.IntegerType())]))
    texts = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text <> ''")
    got = texts.groupBy("doc_id", "at", "toxic").agg(F.min("text").alias("text")).orderBy("at", "doc_id").select("text", "toxic").toArrow()
    return got.column("text").combine_chunks(), got.column("toxic").to_numpy().astype(np.float64)


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_sample(documents, labels))


def scored(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """documents, with all their columns, and their score in `column`, which is replaced if it is there. Null and empty
    texts have the bias alone: not toxic. Texts are read whole, of any length; repeated rows score alike."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c != column]
    rows = documents.select(F.struct(*names).alias("row"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in common.pieces(batch.column("text"), 1 << 20):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sent.value.scores(part.column("text")), pa.float64())], ["row", "score"])

    kind = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(score, kind).select("row.*", F.col("score").alias(column))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score and predicted (1 from THRESHOLD on).

    Learns from rows of which crc32(doc_id) mod 3 isn't 1 and from texts alone. Without labels of both kinds every score
    is near 0. A null doc_id isn't held out and has no label.
    """
    model = trained(documents, labels)
    out = scored(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op5_subword_toxicity": op5_subword_toxicity}
ORACLES: dict[str, str] = {}
