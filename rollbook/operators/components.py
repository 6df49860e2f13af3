"""Connected components in few rounds, and the new entities of a batch as components of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that can be reached.

    Every node points to a smaller one of its component. In a round it learns the least grandparent around it, its parent
    learns it too, and it skips to its own grandparent, so that distances halve: a chain of n nodes takes about log2(n)
    rounds. Each round is written; a lost executor costs a task. What is joined by a crowded node is one row for it, and
    least values are aggregated within tasks, so no neighbourhood is gathered. Null nodes and loops are left out.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = written(both.distinct(), "links")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), "parents")
    while True:
        above = now.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = written(now.join(above, "parent"), "grandparents")
        around = both.join(known.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("low"))
        least = F.least("low", "grand")
        told = known.join(around, "node").select(F.explode(F.array(F.struct("node", least.alias("parent"), F.col("parent").alias("was")), F.struct(F.col("parent").alias("node"), least.alias("parent"), F.lit(None).alias("was")))).alias("x")).select("x.*")
        # a node's own row has what it pointed to, a row from a child hasn't
        after = written(told.groupBy("node").agg(F.min("parent").alias("parent"), F.max("was").alias("was")), "parents")
        now = after.select("node", "parent")
        if after.where("parent != was").isEmpty():
            return now.withColumnRenamed("parent", "root")


def batch_links(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(a, b): each row's key and the least key that has the same `by`; as many links as rows, however crowded."""
    apart = rows.dropna(subset=by)
    least = apart.groupBy(*by).agg(F.min(key).alias("b"))
    return apart.join(least.hint("merge"), by).select(F.col(key).alias("a"), "b").where("a != b").distinct()


def batch_entities(incoming: DataFrame, resolution: DataFrame, by: tuple[str, ...] = ("account",)) -> DataFrame:
    """resolution with `entity`: the target of matched rows, and for new ones the least in_id of those that are the same new
    entity: rows that share an account (`by`, with a name key perhaps), directly or in a chain of new rows. Other rows
    have none. incoming: in_id and `by`, a row for each account; without an account a row is an entity of its own."""
    new = resolution.where("status = 'new'").select("in_id").distinct()
    roots = components(batch_links(incoming.join(new.hint("merge"), "in_id", "left_semi").select("in_id", *by), "in_id", list(by)))
    out = resolution.join(roots.withColumnRenamed("node", "in_id").hint("merge"), "in_id", "left")
    fresh = F.when(F.col("status") == "new", F.coalesce("root", "in_id"))
    return out.select(*resolution.columns, F.when(F.col("status") == "matched", F.col("target")).otherwise(fresh).alias("entity"))
