"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records fall into ranges by their
key, overfull ranges are subdivided, and a running sum over each range deals its records to shards."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

N_SHARDS = 40


def _longs(values: list[int]) -> Column:
    """A constant array: one string that the optimizer folds, as thousands of literals would slow the planner."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, splitters: list[tuple], fields: list[T.StructField]) -> Column:
    """How many splitters stand at or below the key: a binary search, in about log2(splitters) steps a row."""
    if not splitters:
        return F.lit(0)
    kind = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    array = F.from_json(F.lit(json.dumps([dict(zip([f.name for f in fields], s, strict=True)) for s in splitters], default=str)), kind)
    steps = len(splitters).bit_length()

    def narrowed(at: Column, step: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        above = F.get(array, middle) <= key
        more = at["low"] < at["high"]
        return F.struct(F.when(more & above, middle + 1).otherwise(at["low"]).alias("low"), F.when(more & ~above, middle).otherwise(at["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, narrowed)["low"]


def _sort_key(values: tuple) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in values)


def _splitters(rows: DataFrame, order_by: list[str], weight: str, total: int, n_ranges: int, oversample: int, seed: int) -> list[tuple]:
    """Quantile boundaries from a sample to which each record is drawn with a chance in proportion to its weight. The draw
    is a hash of the key, so that a lost task draws the same sample again. n_ranges * oversample keys are expected, from
    all tasks together; records that weigh more than their share are always drawn."""
    u = F.pmod(F.xxhash64(F.lit(seed), *order_by), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(u < F.col(weight) * (n_ranges * oversample / max(total, 1))).select(*order_by)
    keys = sorted((tuple(r) for r in drawn.collect()), key=_sort_key)
    picked = [keys[len(keys) * i // n_ranges] for i in range(1, n_ranges)] if keys else []
    return list(dict.fromkeys(picked))


def fitted(groups: list[tuple[str, int]], n_shards: int, total: int) -> tuple[dict[str, int], list[int]]:
    """Shards of heavy groups (key, weight): the heaviest first, each into the emptiest shard if it fits into the share of
    the total that is left there; one that doesn't is left out. Also what is left of each share, times n_shards."""
    free, out = [total] * n_shards, {}
    for key, weight in sorted(groups, key=lambda g: (-g[1], g[0])):
        s = free.index(max(free))
        if weight * n_shards <= free[s]:
            out[key] = s
            free[s] -= weight * n_shards
    return out, free


def shard(df: DataFrame, n_shards: int, order_by: list[str], weight: str, *, whole: str | None = None, n_ranges: int | None = None, oversample: int = 16, seed: int = 17) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard).

    Records stand in the order of `order_by`; shard s holds those whose middle lies in the s-th part of the summed
    `weight`, so that any shard's sum differs from the mean by the heaviest record at most (with weight 1: counts
    differ by one at most).

    whole: the first column of order_by, a string; records that agree in it stay together in one shard if together they
    weigh no more than a shard's share. Light groups, up to the heaviest record or 1/64 of a share, are placed in the
    order by their common middle. Heavier ones, of which there are 64 * n_shards at most, are put into shards first, as
    far as they fit, and the rest is dealt to what is left of each share; those that don't fit, as any that weigh more
    than a share, are split among neighbouring shards like single records. Sums then differ from the mean by the heaviest
    record or 1/64 of a share at most. Nulls in `whole` are alone.

    Null weights count as 0; if all weights are 0, records are counted instead. An empty table
    gives an empty table, and null keys come first. Rows with equal keys share a range; end `order_by` in a column that
    tells rows apart, so that a key that a third of all rows share is subdivided like any other. df is read several
    times and must return the same rows each time. Columns of df that are named shard or slot are replaced.

    The driver gets the sample (about n_ranges * oversample keys), heavy groups and one row for each range, whatever the
    input's size.
    """
    n_ranges = n_ranges or min(16_384, max(320, 8 * n_shards))
    rows = df.drop("shard", "slot").withColumn("__weight", F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)))
    fields = [df.schema[c] for c in order_by]
    stats = rows.agg(F.sum("__weight").alias("total"), F.max("__weight").alias("heaviest"), F.count(F.lit(1)).alias("n")).first()
    if not stats["total"]:  # no weights: records are counted
        rows, stats = rows.withColumn("__weight", F.lit(1).cast("long")), {"total": stats["n"], "heaviest": 1}
    total = stats["total"]
    splitters = _splitters(rows, order_by, "__weight", total, n_ranges, oversample, seed)

    def ranged(by: list[tuple]) -> DataFrame:
        return rows.withColumn("__range", _range_of(F.struct(*order_by), by, fields))

    def totals(by: list[tuple]) -> dict[int, tuple[int, int]]:
        kept = ranged(by).groupBy("__range").agg(F.sum("__weight").alias("w"), F.count(F.lit(1)).alias("n"))
        return {r["__range"]: (r["w"], r["n"]) for r in kept.collect()}

    sums = totals(splitters)
    for level in range(3):  # overfull ranges get splitters of their own
        mean = total / n_ranges
        overfull = {r: w for r, (w, n) in sums.items() if n > 1 and w > 3 * mean}
        if not overfull:
            break
        inside = ranged(splitters).where(F.col("__range").isin(sorted(overfull)))
        more = _splitters(inside, order_by, "__weight", sum(overfull.values()), max(2, round(sum(overfull.values()) / max(mean, 1)) * 2), oversample, seed + level + 1)
        grown = sorted({*splitters, *more}, key=_sort_key)
        if len(grown) == len(splitters):
            break
        splitters = grown
        sums = totals(splitters)

    before, counts = [0], [0]
    for r in range(len(splitters) + 1):
        w, n = sums.get(r, (0, 0))
        before.append(before[-1] + w)
        counts.append(counts[-1] + n)
    part = Window.partitionBy("__range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("__weight")
    at = lambda values, i="__range": F.get(_longs(values), F.col(i))
    placed = ranged(splitters).withColumns({"__own": own, "__before": at(before) + F.sum(own).over(part) - own, "__index": at(counts) + F.row_number().over(part) - 1})

    heavy: list = []
    if whole:
        groups = rows.where(F.col(whole).isNotNull()).groupBy(whole).agg(F.sum("__weight").alias("w"), F.count(F.lit(1)).alias("n"))
        heavy = sorted(groups.where((F.col("n") > 1) & (F.col("w") > max(stats["heaviest"], total // (64 * n_shards)))).collect(), key=lambda r: r[whole])
    home, free = fitted([(r[whole], r["w"]) for r in heavy], n_shards, total)
    # where the rows of heavy groups are in the order, and how much weight and how many rows of those with a home come before
    names = [r[whole] for r in heavy]
    homes = [home.get(name, -1) for name in names]
    taken = [0, *accumulate(r["w"] if r[whole] in home else 0 for r in heavy)]
    skipped = [0, *accumulate(r["n"] if r[whole] in home else 0 for r in heavy)]
    if heavy:
        upto = _range_of(F.struct(whole), [(name,) for name in names], fields[:1])
        is_heavy = F.coalesce(F.get(F.split(F.lit(",".join(names)), ","), F.col("__upto") - 1) == F.col(whole), F.lit(False))
        placed = placed.withColumn("__upto", F.when(F.col(whole).isNull(), 0).otherwise(upto)).withColumn("__heavy", is_heavy)
        placed = placed.withColumn("__home", F.when(F.col("__heavy"), F.get(_longs(homes), F.col("__upto") - 1)).otherwise(-1))
        placed = placed.withColumns({"__before": F.col("__before") - at(taken, "__upto"), "__place": F.when(F.col("__home") < 0, F.col("__index") - at(skipped, "__upto")).otherwise(F.col("__index"))})
    else:
        placed = placed.withColumns({"__upto": F.lit(0), "__heavy": F.lit(False), "__home": F.lit(-1), "__place": F.col("__index")})
    middle = 2 * F.col("__before") + F.col("__own")  # twice the weight that stands before the record's middle
    if whole:
        light = placed.where(~F.col("__heavy"))
        groups = light.where(F.col(whole).isNotNull()).groupBy(whole).agg(F.sum("__own").alias("__sum"), F.min("__before").alias("__start"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
        placed = light.join(groups, whole, "left").unionByName(placed.where(F.col("__heavy")), allowMissingColumns=True)
        middle = F.coalesce(2 * F.col("__start") + F.col("__sum"), middle)
    # a record's middle falls into what is left of a shard's share; shares are whole numbers times n_shards
    ends = F.transform(F.split(F.lit(",".join(str(2 * e) for e in accumulate(free[:-1]))), ",") if n_shards > 1 else F.array().cast("array<string>"), lambda e: e.cast("decimal(38,0)"))
    share = F.size(F.filter(ends, lambda e: e <= F.col("__middle")))
    dealt = placed.withColumn("__middle", middle.cast("decimal(38,0)") * n_shards).withColumn("shard", F.when(F.col("__home") >= 0, F.col("__home")).otherwise(share).cast("int"))
    dealt = dealt.withColumn("__group", F.when(F.col("__home") >= 0, F.col("__upto")).otherwise(0))
    heads = {(r["shard"], r["__group"]): (r["first"], r["n"]) for r in dealt.groupBy("shard", "__group").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    rest, lead, fill = [], [0] * (len(heavy) + 1), {}
    for s in range(n_shards):
        first, n = heads.get((s, 0), (0, 0))
        rest.append(first)
        fill[s] = n
    for (s, group), (first, n) in sorted(heads.items()):
        if group:  # heavy groups follow the rest of their shard
            lead[group] = first - fill[s]
            fill[s] += n
    first = F.when(F.col("__group") > 0, at(lead, "__group")).otherwise(at(rest, "shard"))
    return dealt.withColumn("slot", F.col("__place") - first).drop("__weight", "__range", "__index", "__own", "__before", "__sum", "__start", "__upto", "__heavy", "__home", "__place", "__middle", "__group")


def law_weight(law: str) -> Column:
    """What each law balances: bytes (UTF-8 bytes of the text plus 16) or rows."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}: bytes or rows")
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16 if law == "bytes" else F.lit(1).cast("long")


def shard_documents(documents: DataFrame, n_shards: int = N_SHARDS, law: str = "bytes") -> DataFrame:
    """Digest of the sharding of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't
    `key`) and text_md5.

    Documents stand in the order of (md5 of the text, doc_id), so that equal texts stand together. By the law of bytes a
    group of copies stays in one shard if it fits into a shard's share (see shard()); a larger one must be split, and
    spans neighbouring shards. Null and empty texts count 16 bytes and share the md5 of the empty text. Very long texts
    count whole. Repeated rows all stay; a null doc_id stays null and comes first. No row is lost.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = common.stored(
        documents.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"), law_weight(law).alias("weight"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharding",
    )
    dealt = shard(narrow, n_shards, ["text_md5", "doc_id", "row"], "weight", whole="text_md5" if law == "bytes" else None)
    return dealt.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_md5")


def op1_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))


#: Bytes to crc32 is a fold over each byte's bits-table entry; the table comes from the polynomial of IEEE 802.3.
CRC32_SQL = """
WITH RECURSIVE crc_step AS (
  SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
"""

OP1_SQL = (
    CRC32_SQL
    + f"""
crcs AS (
  SELECT h, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: (('0x' || substr(h, 2 * i::INT + 1, 2))::UBIGINT))),
         lambda a, x: xor(a >> 8, t[(xor(a & 255, x))::INT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM (SELECT DISTINCT h FROM hexed), crc_table
), placed AS (
  SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, crc AS text_crc32, md5(text) AS text_md5,
         sum(octet_length(encode(text)) + 16) OVER (ORDER BY md5(text), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run,
         sum(octet_length(encode(text)) + 16) OVER () AS total,
         row_number() OVER (ORDER BY md5(text), doc_id NULLS FIRST) AS place
  FROM hexed JOIN crcs USING (h)
), heavy AS (SELECT text_md5, sum(size)::HUGEINT AS g, row_number() OVER (ORDER BY sum(size) DESC, text_md5) AS i, any_value(total)::HUGEINT AS total FROM placed
  GROUP BY text_md5 HAVING count(*) > 1 AND sum(size) > greatest((SELECT max(size) FROM placed), any_value(total) // (64 * {N_SHARDS}))
), fit AS (
  SELECT 0 AS i, NULL::VARCHAR AS text_md5, -1 AS home, list_transform(range({N_SHARDS}), lambda x: t) AS free FROM (SELECT max(total)::HUGEINT AS t FROM placed)
  UNION ALL
  SELECT heavy.i, heavy.text_md5, CASE WHEN g * {N_SHARDS} <= list_max(free) THEN list_position(free, list_max(free)) - 1 ELSE -1 END,
    CASE WHEN g * {N_SHARDS} <= list_max(free) THEN list_transform(range(1, {N_SHARDS} + 1), lambda s: free[s] - CASE WHEN s = list_position(free, list_max(free)) THEN g * {N_SHARDS} ELSE 0 END) ELSE free END
  FROM fit JOIN heavy ON heavy.i = fit.i + 1
), ends AS (SELECT list_transform(range(1, {N_SHARDS}), lambda s: list_sum(free[1:s])) AS e FROM (SELECT free FROM fit ORDER BY i DESC LIMIT 1)),
homes AS (SELECT text_md5, home FROM fit WHERE home >= 0),
rest AS (SELECT doc_id, size, text_crc32, text_md5, place, sum(size) OVER (ORDER BY place) AS run FROM placed WHERE text_md5 NOT IN (SELECT text_md5 FROM homes)),
grouped AS (SELECT *, sum(size) OVER (PARTITION BY text_md5) AS g, min(run - size) OVER (PARTITION BY text_md5) AS g_start, text_md5 IN (SELECT text_md5 FROM heavy) AS split FROM rest),
dealt AS (
  SELECT doc_id, size, text_crc32, text_md5, place, 0 AS last, len(list_filter(e, lambda x: 2 * x <= (CASE WHEN split THEN 2 * run - size ELSE 2 * g_start + g END) * {N_SHARDS}))::INT AS shard FROM grouped, ends
  UNION ALL SELECT doc_id, size, text_crc32, text_md5, place, 1, home FROM placed JOIN homes USING (text_md5))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY last, place) - 1 AS slot, NULL::INT AS grown_shard, text_md5 FROM dealt
"""
)

QUERIES = {"op1_sampled_sharding": op1_sampled_sharding}
ORACLES = {"op1_sampled_sharding": OP1_SQL}
