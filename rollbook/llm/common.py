"""Helpers that the training-data operators share: tables in the shared folder, and text as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What separates words, as a character class of Java's (and DuckDB's) regular expressions.
SPACE = r"[\x20\x09-\x0D]"
#: Lower-casing A-Z turns this class of separators into the one that has no capital letters among the words.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new one where it is unset and all run on
    one machine, as in tests. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="rollbook-"))
        path = context.getCheckpointDir()
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each begins (with the end last). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def pieces(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of a column that hold about `most` bytes each; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, starts = utf8(column)
    cuts, first = [], 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        cuts.append((first, last))
        first = last
    return cuts


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that belong to words, by the two definitions in use.
IN_ALNUM = np.zeros(256, bool)
IN_ALNUM[48:58] = IN_ALNUM[97:123] = IN_ALNUM[128:] = True
IN_SPACED = np.ones(256, bool)
IN_SPACED[[32, 9, 10, 11, 12, 13]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that stand one after the other: a 64-bit hash of each (A-Z lower-cased), its first byte, its end, and where each text's words begin (with the end last)."""
    low = LOWER[raw]
    mask = np.zeros(len(raw) + 2, bool)
    mask[1:-1] = inside[low]
    left = mask[1:-1] & ~mask[:-2]
    cut = starts[(starts > 0) & (starts < len(raw))]
    left[cut] |= mask[1:-1][cut]  # a word ends with its text
    first = np.flatnonzero(left)
    right = mask[1:-1] & ~mask[2:]
    right[cut - 1] |= mask[1:-1][cut - 1]
    end = np.flatnonzero(right) + 1
    begins = np.searchsorted(first, starts)
    if not len(first):
        return np.zeros(0, np.uint64), first, end, begins
    within = np.arange(len(raw)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(raw)]])))
    within[~mask[1:-1]] = 0
    weighed = np.where(mask[1:-1], (low.astype(np.uint64) + np.uint64(1)) * powers(int((end - first).max()))[np.minimum(within, int((end - first).max()) - 1)], np.uint64(0))
    return mixed(np.add.reduceat(weighed, first)), first, end, begins

