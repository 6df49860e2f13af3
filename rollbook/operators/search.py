"""Search in bulk: a table of queries against the keys of all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Match types: exact name, another exact key, part of a key.
EXACT, OTHER, PART = 0, 1, 2


def search_keys(records: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """(id, place, key): a row for each key of a record; the first is its name."""
    return records.select(F.col(id_column).alias("id"), F.posexplode(F.array(*keys)).alias("place", "key")).where("key <> ''")


def search(queries: DataFrame, keys: DataFrame, width: int = 3) -> DataFrame:
    """(q, id, type): the best match of each record with each query. queries: q (a normalised key, without repetition).

    Queries meet each distinct key once, and its records only when it is known which queries it answers. Exact matches are
    equi-joins. A part is found by one run of `width` characters of the query (all of it if it is shorter): the one that
    the fewest keys have, so that a run that most queries and keys share brings none together. Keys are cut into runs that
    some query looks for only; how many keys have a run is counted before they meet. Sizes of files say little of sizes of
    keys and runs, so none of these joins is left to them.
    """
    queries = queries.where("q <> ''").select("q").distinct()
    texts = keys.select("key").distinct()
    runs = lambda c, w: F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{w}}}))"), 1))
    own = F.when(F.char_length("q") < width, F.array("q")).otherwise(runs("q", width))
    wanted = queries.select("q", F.explode(own).alias("gram"))
    looked = wanted.select("gram").distinct()
    grams = texts.select("key", F.explode(F.concat(*(runs("key", w) for w in range(1, width + 1)))).alias("gram")).hint("merge").join(looked, "gram", "left_semi")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a run that no key has rules the query out
    rarest = wanted.hint("merge").join(counts, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("q", "x.gram")
    parts = rarest.hint("merge").join(grams, "gram").where(F.contains("key", "q") & (F.col("key") != F.col("q"))).select("q", "key")
    answers = queries.select("q", F.col("q").alias("key")).union(parts)
    kind = F.when(F.col("key") != F.col("q"), PART).when(F.col("place") == 0, EXACT).otherwise(OTHER)
    return answers.hint("merge").join(keys, "key").groupBy("q", "id").agg(F.min(kind).alias("type"))


def collisions(suggestions: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, n): records of which some key is the suggestion's. Each record counts once by itself, so that a common key's
    records are dealt by record before they are counted."""
    met = suggestions.select("q").distinct().hint("merge").join(keys.select("id", F.col("key").alias("q")), "q").select("q", "id").distinct()
    counts = met.groupBy("q").agg(F.count("id").alias("n"))
    return suggestions.select("q").distinct().hint("merge").join(counts, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))
