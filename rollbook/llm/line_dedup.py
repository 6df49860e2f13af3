"""Line dedup by the suffix array of line sequences: the suffixes that begin at each line are ranked by their first line, and
the ranks are doubled in rounds over the whole corpus (a suffix's rank by 2k lines comes from its rank by k lines and that
of the suffix k lines on) until no two suffixes are tied. Ties in a round are intervals with a common prefix of that many
lines; the ranks of all rounds tell how far a copy agrees with the first one, and later copies of a run are deleted.

Only tied suffixes go on to the next round and are kept: a suffix that is alone in its rank begins no longer repeated run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A repeated run is deleted from so many lines on, or from so many words on, however few lines they take.
MIN_LINES, MIN_WORDS = 3, 50
_WORDED = r"[^\x20\x09-\x0D]"


def lines(documents: DataFrame) -> DataFrame:
    """row, doc_id, at (from 0), words, g and h (96 bits of hashes) of each line that has a word."""
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORDED))
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), worded.alias("lines"))
    # an inner explode would have a filter on its array pushed below, and so the array built twice
    rows = rows.select("row", "doc_id", F.posexplode_outer("lines").alias("at", "line")).where("at IS NOT NULL")
    return rows.select("row", "doc_id", "at", F.regexp_count("line", F.lit(_WORDED + "+")).alias("words"), F.xxhash64("line").alias("g"), F.hash("line").alias("h"))


def _ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """suffixes whose keys others have, too, with rank (in the order of the keys, equal for equal keys), and first, the
    least (doc_id, row, at) of them. Counts are aggregated before they are shuffled; ranks of distinct keys come from a
    sort by ranges, so that no task gets a key's suffixes or a range of many more keys than others."""
    groups = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "at")).alias("first")).where("n > 1")
    ranks = common.stored(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "first", F.monotonically_increasing_id().alias("rank")), "ranks")
    return common.stored(suffixes.join(ranks, keys).drop(*keys, "n"), "suffixes")


def _followed(suffixes: DataFrame, k: int) -> DataFrame:
    """suffixes whose follower k lines on in the same text is there, too: `one` and `two` are their ranks, words the sum."""
    there = Window.partitionBy("row").orderBy("at").rangeBetween(k, k)
    out = suffixes.withColumns({"two": F.max("rank").over(there), "more": F.max("words").over(there)}).where("two IS NOT NULL")
    return out.select("row", "doc_id", "at", (F.col("words") + F.col("more")).alias("words"), F.col("rank").alias("one"), "two")


def doubled(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The suffix array of lines: for each k, the suffixes (row, doc_id, at, words, rank, first) that share their first 2^k
    lines with another, until there are none; and those that share their first three (two overlapping runs of two)."""
    levels = [_ranked(first, ["g", "h"])]
    levels.append(_ranked(_followed(levels[0], 1), ["one", "two"]))
    three = _ranked(_followed(levels[1], 1), ["one", "two"])
    while not levels[-1].isEmpty():
        levels.append(_ranked(_followed(levels[-1], 1 << (len(levels) - 1)), ["one", "two"]))
    return levels[:-1], three


def later_copies(levels: list[DataFrame], three: DataFrame) -> DataFrame:
    """row, doc_id, at, size, first: of each place, the longest run of one, two or three lines that is long enough and
    begins at an earlier place, too, and the first place of that run (doc_id, row, at)."""
    sizes = [df.where(f"words >= {MIN_WORDS}").withColumn("size", F.lit(k + 1)) for k, df in enumerate(levels[:2])] + [three.withColumn("size", F.lit(MIN_LINES))]
    runs = reduce(DataFrame.union, (df.select("row", "doc_id", "at", "size", "first") for df in sizes)).where("NOT (row = first.row AND at = first.at)")
    return runs.groupBy("row", "at").agg(F.max_by(F.struct("doc_id", "size", "first"), "size").alias("x")).select("row", "x.doc_id", "at", "x.size", "x.first")


def _agreeing(names: DataFrame, levels: list[DataFrame], copies: DataFrame) -> DataFrame:
    """copies (row, at, first_at, size: two places of one text) with n_lines, in how many lines both agree: from the greatest
    power of two down, by equal ranks. Rows of copies gather the ranks of their own lines, a text's at most."""
    rows = copies.select("row").distinct()
    ranks = [names.select("row", "at", F.lit(-1).alias("k"), F.lit(None).cast("long").alias("rank"))] + [df.select("row", "at", F.lit(k).alias("k"), "rank") for k, df in enumerate(levels)]
    each = reduce(DataFrame.union, ranks).join(rows, "row", "left_semi")
    each = each.groupBy("row", "at").agg(F.array(*(F.max(F.when(F.col("k") == k, F.col("rank"))) for k in range(len(levels)))).alias("ranks"))
    texts = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ranks"))).alias("suffixes"))
    pairs = copies.groupBy("row").agg(F.collect_list(F.struct("at", "first_at", "size")).alias("pairs"))  # as many as the text has lines
    rank = lambda i, k: F.get(F.get("suffixes", i)["ranks"], k)

    def agreed(x: Column) -> Column:
        powers = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(1 << k).alias("lines")) for k in reversed(range(len(levels)))))
        return F.aggregate(powers, F.lit(0), lambda n, p: n + F.when(rank(x["at"] + n, p["k"]) == rank(x["first_at"] + n, p["k"]), p["lines"]).otherwise(0))

    out = pairs.join(texts, "row").select("row", F.explode(F.transform("pairs", lambda x: F.struct(x["at"].alias("at"), x["first_at"].alias("first_at"), x["size"].alias("size"), agreed(x).alias("n_lines")))).alias("x"))
    return out.select("row", "x.*")


def deleted_lines(documents: DataFrame) -> DataFrame:
    """(row, gone): the numbers of the lines of each document, among those with a word, that go."""
    names = common.stored(lines(documents), "lines")
    levels, three = doubled(names)
    copies = common.stored(later_copies(levels, three).select("row", "at", "size", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")), "copies")
    apart = copies.where("first_row != row").select("row", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    own = copies.where("first_row = row").select("row", "at", "first_at", "size")
    spans = apart
    if not own.isEmpty():  # a copy that begins in the first copy loses only what goes beyond it
        of_run = Window.partitionBy("row", "first_at", "size")  # the places of a run in one text
        within = _agreeing(names, levels, own).withColumn("n_lines", F.min("n_lines").over(of_run))
        spans = apart.union(within.select("row", F.greatest("at", F.col("first_at") + F.col("n_lines")).alias("start"), (F.col("at") + F.col("n_lines")).alias("end")))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.where("start < end").withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).where("start < end")
    gone = fresh.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("line"))
    return gone.groupBy("row").agg(F.collect_list("line").alias("gone"))  # as many as one document has lines


def repeated_runs(documents: DataFrame) -> DataFrame:
    """doc_id, line, n_lines, first_doc_id, first_line: each maximal run of lines whose every place repeats an earlier one at
    the same distance, by numbers among the lines with a word, with the place of what it repeats."""
    copies = later_copies(*doubled(common.stored(lines(documents), "lines")))
    over = Window.partitionBy("row").orderBy("at")
    on = copies.withColumns({"to": F.struct("first.row", (F.col("first.at") - F.col("at")).alias("by"))})
    on = on.withColumn("new", F.coalesce((F.col("at") != F.lag("at").over(over) + 1) | (F.col("to") != F.lag("to").over(over)), F.lit(True)))
    on = on.withColumn("run", F.sum(F.col("new").cast("int")).over(over))
    runs = on.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("line"), F.max(F.col("at") + F.col("size")).alias("end"), F.min("first").alias("first"))
    return runs.select("doc_id", "line", (F.col("end") - F.col("line")).alias("n_lines"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_line"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """documents, with all their columns, with text without the lines of later copies, and n_lines and n_gone (lines with
    a word, and those of them deleted).

    A run of 3 lines, or of one or two with 50 words, is a later copy if it begins at an earlier place, too, line for line
    in the same text or another; places are in order of doc_id, row and line. Of a place's runs the longest of at most
    three lines that does so is taken, and its first place. If that is in another text, the run's lines are deleted (as
    its followers are judged in the same way, so are all lines in which both texts agree). If it is in the same text, all
    places of the run in that text agree with the first in n lines, and a later one loses those n lines but for lines that
    are among the n of the first, which stays whole: of any number of equal lines three stay, and `x y x y x y` loses its
    last two. Lines without a word are in no run and stay. Null texts stay null,
    empty ones empty; repeated rows are copies of each other; a null doc_id comes before all others. Columns named
    n_lines or n_gone are replaced. documents must give the same rows in the same order when read again, as files do.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_gone")]
    gone = deleted_lines(documents.select("doc_id", "text"))
    rows = documents.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row")).join(gone, "row", "left")
    rows = rows.withColumns({"gone": F.coalesce("gone", F.array().cast("array<int>")), "lines": F.split("doc.text", "\n")})
    # line numbers among those with a word, as the runs have them
    rows = rows.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_WORDED), i)), lambda i: i.isNotNull()))
    out_lines = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda k: F.get("worded", k)))
    kept = F.array_join(F.transform(out_lines, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.size("gone") == 0, F.col("doc.text")).otherwise(kept)
    n_lines = F.greatest(F.coalesce(F.size("worded"), F.lit(0)), F.lit(0)).cast("long")
    return rows.select(*(text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in names), n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_gone"))


def op10_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_gone", F.char_length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, doc_id, i, unnest_line AS line FROM (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS unnest_line FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL))),
w AS (SELECT rid, doc_id, i, line, len(regexp_extract_all(line, '[^ 	-
]+')) AS n, row_number() OVER (PARTITION BY rid ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^ 	-
]')),
texts AS (SELECT rid, list(line ORDER BY k) AS ls FROM w GROUP BY rid),
starts AS (SELECT rid, doc_id, k, size, array_to_string(ls[k:k + size - 1], chr(10)) AS name, ls[k:k + size - 1] AS run FROM w JOIN texts USING (rid), (VALUES (1), (2), (3)) s(size) WHERE k + size - 1 <= len(ls)),
runs AS (SELECT rid, doc_id, k, size, first_value(rid) OVER o AS q_rid, first_value(k) OVER o AS q FROM starts
  WHERE size = {MIN_LINES} OR list_sum(list_transform(run, lambda x: len(regexp_extract_all(x, '[^ 	-
]+')))) >= {MIN_WORDS} WINDOW o AS (PARTITION BY size, name ORDER BY doc_id NULLS FIRST, rid, k)),
later AS (SELECT rid, k, max(size) AS size, arg_max(q_rid, size) AS q_rid, arg_max(q, size) AS q FROM runs WHERE (rid, k) <> (q_rid, q) GROUP BY rid, k),
sides AS (SELECT later.*, a.ls AS a, b.ls AS b, least(len(a.ls) - k, len(b.ls) - q) + 1 AS most FROM later JOIN texts a USING (rid) JOIN texts b ON b.rid = q_rid),
pairs AS (SELECT rid, k, size, q_rid, q, coalesce(nullif(list_position(list_transform(range(0, most), lambda i: a[k + i] = b[q + i]), false), 0) - 1, most) AS n FROM sides),
agreed AS (SELECT rid, k, q_rid, q, CASE WHEN rid = q_rid THEN min(n) OVER (PARTITION BY rid, q_rid, q, size) ELSE n END AS n FROM pairs),
gone AS (SELECT DISTINCT rid, k FROM (SELECT rid, unnest(range(CASE WHEN rid = q_rid THEN greatest(k, q + n) ELSE k END, k + n)) AS k FROM agreed)),
dropped AS (SELECT w.rid, w.i FROM w JOIN gone USING (rid, k)),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN dropped USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_lines FROM w GROUP BY rid), g AS (SELECT rid, count(*) AS n_gone FROM gone GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_gone, 0)::BIGINT AS n_gone, length(t)::BIGINT AS n_chars_kept, md5(t) AS text_md5
FROM (SELECT d.*, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS t, n_lines, n_gone FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid) LEFT JOIN g USING (rid))
"""

QUERIES = {"op10_line_suffixes": op10_line_suffixes}
ORACLES = {"op10_line_suffixes": OP10_SQL}
