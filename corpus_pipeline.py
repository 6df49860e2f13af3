"""A corpus from documents: toxic texts go, one of each group of near duplicates stays, texts that hold benchmark passages
go, sources are mixed to their weights, and the mixed sequence is cut into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import common, decontaminate, mixing, neardup, sharding, toxicity

#: Near copies of which one stays: Jaccard similarity in percent, at least.
NEAR_PERCENT = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below toxicity.THRESHOLD; the classifier learns from those of docs that have labels.

    Each row is scored by its own whole text, null and empty ones like any other text; copies score alike, and a score of
    just the threshold is rejected. Without labels all stay. Other columns, whatever their names, are kept as they are.
    """
    model = toxicity.trained(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of NEAR_PERCENT connect: the least doc_id (null first), of equal ones the first
    row. Texts without words, null ones too, all stay; very long texts are compared whole."""
    return neardup.deduplicated(docs, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item (shorter items: all their words); a shared window is enough,
    copies go together, and null and empty texts stay. Items without an id count like others."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of docs, in the order in which their sources are mixed: file by file, and row by row in a file. Null sources are
    one source; ties and repeated rows all stay."""
    return mixing.mixed(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard and slot. Documents are keyed by where they stand in the files that the stage before wrote, so that
    each shard is one stretch of the mixed sequence and has its weights; shards are nearly equal in bytes. Files are in the
    order of their numbers. Columns named shard or slot are replaced; null texts count 16 bytes."""
    number = F.coalesce(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).try_cast("long"), F.lit(0)).alias("__number")
    placed = docs.select("*", number, F.input_file_name().alias("__file"), F.input_file_block_start().alias("__offset"), F.monotonically_increasing_id().alias("__row"), sharding.law_weight("bytes").alias("__bytes"))
    return sharding.shard(placed, sharding.N_SHARDS, ["__number", "__file", "__offset", "__row"], "__bytes").select(*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", in_mixed_order),
    ("sharding", in_shards),
]
#: Trained scores, hashed orders and connected components are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir through all stages; each stage's result is written and read again for the next. Empty tables
    and empty results of stages are passed on."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
