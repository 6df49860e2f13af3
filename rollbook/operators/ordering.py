"""Ranks, stable orders, rotating slices and run logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def diverse_first(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with leads: whether the row is the first of its group by order (unique). Rows whose group is blank always
    lead. Firsts are an aggregate, so that no large group is sorted, and blanks take no part in it."""
    blank = F.lit(False)
    for c in by:
        blank = blank | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    firsts = rows.where(~blank).groupBy(*by).agg(F.min(order).alias(order)).select(order, F.lit(True).alias("__first"))
    return rows.join(firsts, order, "left").withColumn("leads", blank | F.coalesce("__first", F.lit(False))).drop("__first")


def places(rows: DataFrame, by: str, order: list[str], n_buckets: int = 64, oversample: int = 64) -> DataFrame:
    """rows with place (from 1) of each in its group by order (unique within the group). A group is cut into ranges at
    quantiles of a sample of all rows, which the driver gets (n_buckets * oversample rows at most), so that a group with
    most of the rows is sorted by many tasks; counts of ranges tell where each begins. rows must give the same each time."""
    n = rows.count()
    drawn = rows.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, n_buckets * oversample / 2 / max(n, 1)))))
    keys = [tuple(r) for r in drawn.orderBy(*order).limit(n_buckets * oversample).collect()]
    cuts = list(dict.fromkeys(keys[len(keys) * i // n_buckets] for i in range(1, n_buckets))) if keys else []
    # a row looks for its run of cuts first, and there for its range
    runs = [cuts[i : i + 8] for i in range(0, len(cuts), 8)]
    kind = T.ArrayType(T.StructType([rows.schema[c] for c in order]))
    table = rows.sparkSession.createDataFrame([([run[0] for run in runs], runs)], T.StructType([T.StructField("__heads", kind), T.StructField("__runs", T.ArrayType(kind))]))
    upto = lambda cs: F.size(F.filter(cs, lambda c: c <= F.struct(*order)))
    ranged = rows.join(F.broadcast(table), F.lit(True)).withColumn("__run", upto("__heads"))
    ranged = ranged.withColumn("__range", F.when(F.col("__run") > 0, (F.col("__run") - 1) * 8 + upto(F.col("__runs")[F.col("__run") - 1])).otherwise(0)).drop("__heads", "__runs", "__run")
    counts = ranged.groupBy(by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("__by"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = ranged.withColumn("__k", F.row_number().over(Window.partitionBy(by, "__range").orderBy(*order)))
    return inside.join(counts.hint("merge"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__r"))).withColumn("place", F.col("__before") + F.col("__k")).drop("__by", "__r", "__range", "__before", "__k")


def named(rows: DataFrame, by: str, reading: str, name: str, key: str, locale: str = "ja") -> DataFrame:
    """rows with place (from 1) of each in its group in the order of names: by reading, or by name where there is none, then by
    name, as a locale has it (kana together whatever their kind, a long vowel as its vowel, kanji after kana), then by key.
    Ranges are cut at quantiles in that order."""
    said = F.coalesce(F.nullif(F.col(reading), F.lit("")), F.col(name))
    keyed = rows.withColumns({"__reading": F.collate(F.coalesce(said, F.lit("")), locale), "__name": F.collate(F.coalesce(name, F.lit("")), locale)})
    return places(keyed, by, ["__reading", "__name", key]).drop("__reading", "__name")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in an order that a seed fixes, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def rotated(rows: DataFrame, order: str, start: int, size: int, total: int) -> DataFrame:
    """The slice of `size` rows from place `start` on, past the end from the beginning again. rows: with place (from 0)."""
    return rows.where(F.pmod(F.col(order) - F.lit(start), F.lit(total)) < size)


def streaks(log: DataFrame, order: str, grew: str) -> DataFrame:
    """log with streak: rows since the last one that grew. The log has one row for each run, so one window is enough."""
    w = Window.orderBy(order)
    groups = log.withColumn("__g", F.sum(F.col(grew).cast("int")).over(w))
    return groups.withColumn("streak", F.sum((~F.col(grew)).cast("int")).over(Window.partitionBy("__g").orderBy(order))).drop("__g")


@dataclass(frozen=True)
class Campaign:
    """Bounds of a collection campaign; a run whose status is one of `terminal` is over."""

    target: int
    budget: int
    patience: int
    terminal: tuple[str, ...] = ("cancelled",)


def stopping_reason(c: Campaign, enabled: Column, done: Column, status: Column, spent: Column, late: Column, streak: Column) -> Column:
    """Why a campaign stops, null if it goes on; of several reasons the first. A status that says that the budget is spent
    is believed only if it is."""
    over = F.when(status.isin(*(s for s in c.terminal if s != "query_budget_reached")), status)
    reason = F.when(~enabled, "disabled").when(done >= c.target, "target_reached").when(over.isNotNull(), over)
    return reason.when(spent >= c.budget, "query_budget_reached").when(late, "deadline_reached").when(streak >= c.patience, "paused_no_growth")


def catalogues(queries: DataFrame) -> DataFrame:
    """(name, catalogue, n): 16 hex digits of each catalogue's queries in their order. queries: name, place, query. A
    catalogue is one row here, as its id is one hash over all of it; catalogues are lists that a campaign runs through."""
    listed = queries.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("place", "query"))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["query"]), "\n")
    return listed.select("name", F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("catalogue"), F.size("all").cast("long").alias("n"))


def resumed(own: DataFrame, predecessors: DataFrame, cursors: DataFrame) -> DataFrame:
    """own (name, catalogue, n) with cursor, where to go on: of the catalogue itself, else of its predecessor (the
    catalogue's beginning, which migrated_from then names), else 0. cursors: catalogue, cursor."""
    old = predecessors.select("name", F.col("catalogue").alias("old"), F.col("n").alias("m")).join(cursors.select(F.col("catalogue").alias("old"), F.col("cursor").alias("there")), "old")
    rows = own.join(cursors.withColumnRenamed("cursor", "here"), "catalogue", "left").join(old, "name", "left")
    cursor = F.coalesce(F.col("here") % F.col("n"), F.col("there") % F.col("m"), F.lit(0))
    return rows.select("name", "catalogue", "n", cursor.cast("long").alias("cursor"), F.when(F.col("here").isNull(), F.col("old")).alias("migrated_from"))


def latest(rows: DataFrame, by: str, order: list[str], fields: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.max(F.struct(*order, *fields)).alias("x")).select(by, "x.*")
