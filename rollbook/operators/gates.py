"""Gates that fail closed: each gives one row with what it measured and whether it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured(rows: DataFrame, gate: str, value: Column, ok: Column) -> DataFrame:
    """gate, value, ok from one aggregate; ok is computed from the column named value."""
    return rows.agg(value.cast("double").alias("value")).select(F.lit(gate).alias("gate"), "value", F.coalesce(ok, F.lit(False)).alias("ok"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR {key} IS NULL")
    return measured(repeated, f"unique {key}", F.count(F.lit(1)), F.col("value") == 0)


def count_within(rows: DataFrame, least: int, most: int) -> DataFrame:
    return measured(rows, "row count", F.count(F.lit(1)), F.col("value").between(least, most))


def unique_ratio(rows: DataFrame, key: str, least: float) -> DataFrame:
    return measured(rows, f"unique ratio {key}", F.round(F.countDistinct(key) / F.count(F.lit(1)), 6), F.col("value") >= least)


def survives(protected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return measured(protected.join(rows.select(key), key, "left_anti"), f"protected {key}", F.count(F.lit(1)), F.col("value") == 0)


def growth(before: DataFrame, after: DataFrame, factor: float, least: int) -> DataFrame:
    """Rows after, which may be at most factor times those before, or `least` more, and not fewer."""
    both = before.agg(F.count(F.lit(1)).alias("b")).withColumn("one", F.lit(1)).join(after.agg(F.count(F.lit(1)).alias("a")).withColumn("one", F.lit(1)), "one")
    return both.select(F.lit("growth").alias("gate"), F.col("a").cast("double").alias("value"), ((F.col("a") >= F.col("b")) & (F.col("a") <= F.greatest(F.col("b") * factor, F.col("b") + least))).alias("ok"))


def enforced(gate: DataFrame) -> DataFrame:
    """The gate's row, or an error that fails the job."""
    return gate.select("gate", "value", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("gate failed: "), "gate")).cast("boolean")).alias("ok"))


def circuit_breaker(batches: DataFrame, order: str, failed: str, total: str, least: int = 3, share: float = 0.75) -> DataFrame:
    """batches with stop (at least `least` failures, and `share` of all) and ran (no earlier batch stopped the rest). The
    first batch that stops is one aggregate, not a sort of the log."""
    out = batches.withColumn("stop", F.col(failed) >= F.greatest(F.lit(least), F.ceil(F.col(total) * share)))
    first = out.agg(F.min(F.when(F.col("stop"), F.col(order))).alias("__first"))
    return out.join(F.broadcast(first), F.lit(True)).withColumn("ran", F.col(order) <= F.coalesce("__first", order)).drop("__first")


def pruned(base: DataFrame, layers: list[DataFrame], protected: list[DataFrame], key: str, risky: Column) -> DataFrame:
    """All rows with state: kept, if any of the protected sets has the key; else rows of base are pruned, rows of other layers
    are orphaned if base had their key (their record goes), risky by the predicate, or else kept."""
    safe = reduce(DataFrame.union, (df.select(key) for df in protected)).distinct().withColumn("__safe", F.lit(True))
    gone = base.select(key).distinct().withColumn("__base", F.lit(True))
    rows = base.withColumn("__own", F.lit(True))
    for df in layers:
        rows = rows.unionByName(df.withColumn("__own", F.lit(False)))
    rows = rows.join(safe, key, "left").join(gone, key, "left")
    state = F.when(F.col("__safe"), "kept").when(F.col("__own"), "pruned").when(F.col("__base"), "orphaned").when(risky, "risky").otherwise("kept")
    return rows.withColumn("state", state).drop("__safe", "__base", "__own")
