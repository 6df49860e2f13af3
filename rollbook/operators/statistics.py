"""Name statistics by record presence: a character, pair or n-gram counts once in each record that has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import written

#: Length buckets (label, least, most).
BUCKETS = (("1-4", 0, 4), ("5-8", 5, 8), ("9-12", 9, 12), ("13+", 13, None))
SCRIPTS = (("han", r"\p{IsHan}"), ("hiragana", r"\p{IsHiragana}"), ("katakana", r"\p{IsKatakana}"), ("latin", r"[A-Za-z]"))


def squeezed(name: str) -> Column:
    """The name without white space; lengths count its code points."""
    return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"(?U)\s", "")


def bucket(length: Column) -> Column:
    out = F.lit(BUCKETS[-1][0])
    for label, _, most in reversed(BUCKETS[:-1]):
        out = F.when(length <= most, label).otherwise(out)
    return out


def script(name: Column) -> Column:
    """The one script of a name, mixed for several, other for none."""
    has = F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(label)) for label, p in SCRIPTS)))
    return F.when(F.size(has) > 1, "mixed").otherwise(F.coalesce(F.get(has, F.lit(0)), F.lit("other")))


def ngrams(name: Column, width: int, kind: str) -> Column:
    """Distinct runs of `width` code points of a regular-expression class. One pass: a lookahead matches at every place."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(f"(?=({kind}{{{width}}}))"), 1))


def presence(rows: DataFrame, labels: Column, n: int | None = None) -> DataFrame:
    """(label, n): records that have each label; the top n by count, then label. Counts are summed before the shuffle, and
    the top is taken from each task's top."""
    counted = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counted if n is None else counted.orderBy(F.desc("n"), "label").limit(n)


def top_per(rows: DataFrame, by: str, label: str, n: int, locale: str | None = None) -> DataFrame:
    """Top n labels of each group, with rank: by count, then by label, in the order of a locale if one is given."""
    counted = rows.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    then = [F.collate(label, locale)] if locale else []
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), *then, label))
    return counted.withColumn("rank", place).where(F.col("rank") <= n)


def compared(rows: DataFrame, groups: str, name: str) -> DataFrame:
    """Count, average length and share of names with kana for each group; a row counts once in each of its groups."""
    text = squeezed(name)
    each = rows.select(F.explode(F.array_distinct(groups)).alias("label"), F.char_length(text).alias("size"), text.rlike("[ぁ-ゖァ-ヶ]").alias("kana"))
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_length"), F.round(F.sum("size") / F.count(F.lit(1)), 1).alias("average_length"), F.round(F.count_if("kana") * 100 / F.count(F.lit(1)), 1).alias("kana_percent"))


def id_prefix(c: Column) -> Column:
    """What an id begins with before its first colon; ids without one are uuid-like or other."""
    return F.when(F.contains(c, F.lit(":")), F.substring_index(c, ":", 1)).when(c.rlike(r"(?i)^[0-9a-f-]{32,36}$"), "uuid-like").otherwise("other")


def audited(ids: DataFrame, found: DataFrame, n_prefixes: int = 30, n_samples: int = 3) -> DataFrame:
    """(part, label, n, samples) of an audit of ids: `prefix` has the most common prefixes (of equally many the one that comes
    first), `family` the ids of each family with their first ones, `ids` the number of all, of those without a source, of
    those of any family (legacy), and of those that something else vouches for too (anchored).

    ids: id (each once), ord, sourced, anchored; found: id and family, repeats don't matter.
    """
    known = found.select("id", "family").distinct().join(ids, "id")
    none = F.lit(None).cast("string").alias("samples")
    prefixes = ids.groupBy(id_prefix(F.col("id")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(n_prefixes)
    counts = known.groupBy(F.col("family").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("ord"))
    first = known.withColumn("place", place).where(F.col("place") <= n_samples).groupBy(F.col("family").alias("label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("samples"))
    legacy = ids.join(known.select("id").distinct().withColumn("legacy", F.lit(True)), "id", "left")
    of = {"all": F.lit(True), "without source": ~F.coalesce("sourced", F.lit(False)), "legacy": F.col("legacy"), "legacy, anchored": F.col("legacy") & F.coalesce("anchored", F.lit(False))}
    totals = legacy.agg(*(F.count_if(v).alias(k) for k, v in of.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"`{k}`").alias("n")) for k in of))).alias("x"))
    parts = [prefixes.select(F.lit("prefix").alias("part"), "label", "n", none), counts.join(first, "label").select(F.lit("family").alias("part"), "label", "n", "samples"), totals.select(F.lit("ids").alias("part"), "x.label", "x.n", none)]
    return parts[0].union(parts[1]).union(parts[2])


def families(rows: DataFrame, text: str, markers: DataFrame) -> DataFrame:
    """rows with each family whose marker the text contains (a row each). markers: family, marker, rank - a small table
    of known size, which is broadcast."""
    return rows.join(F.broadcast(markers), F.col(text).contains(F.col("marker")))


#: Statistics that have only their top labels, and those that have only labels of several records (after the top is taken).
TOPS = {"length": 5, "character": 10, "pair": 10, "gram2": 20, "gram3": 20, "kana": 20, "prefix": 10, "suffix": 10, "duplicate": 20}
SEVERAL = ("prefix", "suffix", "duplicate")


def statistic_labels(name: Column, readable: Column, status: Column, reading: Column) -> Column:
    """All labels of a record under all statistics, each once, as (statistic, label). name without white space; status and
    reading of its reading."""
    size = F.char_length(name)

    def of(statistic: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: F.struct(F.lit(statistic).alias("statistic"), x.cast("string").alias("label")))

    one = lambda statistic, label, when=F.lit(True): of(statistic, F.filter(F.array(label.cast("string")), lambda x: when & x.isNotNull()))
    affix = lambda x: (size >= 2) & x.rlike(r"^[\p{L}\p{N}]{2}$")
    first, last = F.substring(name, 1, 2), F.substring(name, -2, 2)
    return F.concat(
        one("total", F.lit("")), one("readable", F.lit(""), F.coalesce(readable, F.lit(False))), one("size", size), one("length", size), one("bucket", bucket(size)), one("script", script(name)),
        of("character", F.array_distinct(F.filter(F.split(name, ""), lambda c: c.rlike(r"\p{L}")))), of("pair", ngrams(name, 2, r"\p{L}")), of("gram2", ngrams(name, 2, r"[\p{L}\p{N}]")), of("gram3", ngrams(name, 3, r"[\p{L}\p{N}]")),
        of("kana", F.array_distinct(F.filter(F.split(name, ""), lambda c: c.rlike("[ぁ-ゖァ-ヶ]")))), one("prefix", first, affix(first)), one("suffix", last, affix(last)), one("duplicate", F.lower(name)),
        one("reading", F.concat_ws(" ", status, bucket(F.char_length(reading)))),
    )


def sliced(rows: DataFrame, slices: Column, labels: Column, order: str, shown: str, locale: str | None = None, like: tuple[str, ...] | None = None) -> DataFrame:
    """(slice, statistic, label, n, value, shown, rank) of every slice under every statistic, in one pass: rows that are
    equal in the columns `like`, from which slices and labels are made, are one with their number, then rows are counted by slice, statistic and label within tasks before they are shuffled, and tops are cut within tasks before they are
    ranked, so that a slice of all rows is no task's.

    slices: the slices of a row (each counts once); labels: statistic_labels(). Of each label there is the `shown` text of
    its first row by `order`. Labels are ranked by n, then label, in the order of a locale if one is given; `length` by n,
    then as numbers. For `size`, which stands for all lengths, there is one row, with the sum as n and the median as value;
    `duplicate` has the top names of several records, and `duplicates` their totals: distinct names, and names (label
    groups) and records (label records) that are repeated.
    """
    first, many = F.col(order), F.lit(1).cast("long")
    if like:
        rows = rows.groupBy(*like).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.col(order).alias("ord"), F.col(shown).alias("shown"))).alias("__first"))
        first, many, shown = F.col("__first.ord"), F.col("__n"), "__first.shown"
    each = rows.select(F.array_distinct(slices).alias("s"), labels.alias("l"), first.alias("ord"), F.col(shown).alias("shown"), many.alias("many"))
    each = each.select(F.explode("s").alias("slice"), "l", "ord", "shown", "many").select("slice", "ord", "shown", "many", F.explode("l").alias("x"))
    counted = each.groupBy("slice", "x.statistic", "x.label").agg(F.sum("many").alias("n"), F.min_by("shown", "ord").alias("shown"))
    counted = written(counted, "counted")
    by = ["slice", "statistic"]
    label = F.collate("label", locale) if locale else F.col("label")
    best = Window.partitionBy(*by).orderBy(F.desc("n"), F.when(F.col("statistic") == "length", F.col("label").cast("int")), label)
    tops = counted.where(F.col("statistic").isin(*TOPS)).where("statistic != 'duplicate' OR n > 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(TOPS.values()))
    most = F.element_at(F.create_map(*(x for k, v in TOPS.items() for x in (F.lit(k), F.lit(v)))), F.col("statistic"))
    tops = tops.where((F.col("rank") <= most) & ((F.col("n") > 1) | ~F.col("statistic").isin(*SEVERAL)))
    none = F.lit(None)
    plain = counted.where(~F.col("statistic").isin(*TOPS, "size")).select(*by, "label", "n", none.cast("double").alias("value"), none.cast("string").alias("shown"), none.cast("int").alias("rank"))
    # lengths are few: a slice's histogram gives its sum and median
    sizes = counted.where("statistic = 'size'").withColumn("size", F.col("label").cast("int")).groupBy("slice").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.array_sort(F.collect_list(F.struct("size", "n"))).alias("h"), F.sum("n").alias("rows"))
    upto = F.transform("h", lambda x, i: F.struct(x["size"].alias("size"), F.aggregate(F.slice(F.col("h"), 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
    at = lambda k: F.element_at(F.filter(upto, lambda x: x["upto"] >= k), 1)["size"]
    median = (at(F.floor((F.col("rows") + 1) / 2)) + at(F.floor(F.col("rows") / 2) + 1)) / 2
    sizes = sizes.select("slice", F.lit("size").alias("statistic"), F.lit("").alias("label"), F.col("total").alias("n"), median.alias("value"), none.cast("string").alias("shown"), none.cast("int").alias("rank"))
    repeated = F.col("n") > 1
    totals = counted.where("statistic = 'duplicate'").groupBy("slice").agg(F.count(F.lit(1)).alias("names"), F.count_if(repeated).alias("groups"), F.sum(F.when(repeated, F.col("n")).otherwise(0)).alias("records"))
    totals = totals.select("slice", F.lit("duplicates").alias("statistic"), F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in ("names", "groups", "records")))).alias("x"))
    totals = totals.select(*by, "x.label", "x.n", none.cast("double").alias("value"), none.cast("string").alias("shown"), none.cast("int").alias("rank"))
    return tops.select(*by, "label", "n", none.cast("double").alias("value"), F.when(F.col("statistic") == "duplicate", F.col("shown")).alias("shown"), "rank").union(plain).union(sizes).union(totals)
