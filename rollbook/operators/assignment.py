"""Submissions to records, each record once: candidates by class of equal rows, names within names by their rarest run, and
an assignment in the order of submissions, or of whole lists at a time where very many hang together."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.files import written
from .components import batch_links, components
from .ordering import places

#: Characters of the runs by which a name finds the names that hold it; shorter names are one run.
RUN = 3


def _runs(name: Column, size: Column) -> Column:
    """All runs of so many characters of a name, each once."""
    last = F.char_length(name) - size + 1
    return F.when((size > 0) & (last > 0), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(name, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(account, part, whole) of every name of parts that is, or is in, a name of wholes on a common account. Both: account
    and name, repeats don't matter; nulls and '' are in nothing.

    A part asks for the one of its runs that the fewest names of the account have, and only names with that run are
    compared, so that an account with m names doesn't make m^2 pairs.
    """
    fine = lambda df: df.select("account", "name").where("account IS NOT NULL AND name != ''").distinct()
    size = F.least(F.char_length("name"), F.lit(RUN))
    p = fine(parts).withColumn("size", size).select("account", F.col("name").alias("part"), "size", F.explode(_runs(F.col("name"), F.col("size"))).alias("run"))
    sizes = p.groupBy("account").agg(F.collect_set("size").alias("sizes"))  # three at most
    w = fine(wholes).join(sizes.hint("merge"), "account").select("account", F.col("name").alias("whole"), F.explode("sizes").alias("size"))
    w = w.select("account", "whole", F.explode(_runs(F.col("whole"), F.col("size"))).alias("run"))
    counts = w.groupBy("account", "run").agg(F.count(F.lit(1)).alias("n"))
    # a run that no name has rules the part out
    rarest = p.join(counts.hint("merge"), ["account", "run"], "left").groupBy("account", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("x"))
    asked = rarest.where("x.n > 0").select("account", "part", F.col("x.run").alias("run"))
    return asked.join(w.hint("merge"), ["account", "run"]).where(F.contains("whole", "part")).select("account", "part", "whole")


def _classed(rows: DataFrame, key: str, by: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Classes of rows that are equal by `by` (named columns): members (key, class) and the classes with their size (n). A
    class is called by its least key."""
    marked = written(rows.select(key, *by), "marked")
    on = [c for c in marked.columns if c != key]
    classes = written(marked.groupBy(*on).agg(F.min(key).alias(name), F.count(F.lit(1)).alias("n")), "classes")
    same = reduce(lambda a, b: a & b, (F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in on))
    return marked.alias("m").join(classes.alias("c"), same).select(f"m.{key}", f"c.{name}"), classes


def candidates(submissions: DataFrame, registry: DataFrame, composites: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Which records may be each submission's, by the first of these that finds any: an override; a common name and account;
    for a name that one submission alone has, a record of the kind in question with that name and no account; a record of
    the kind with the name as part of its own (4 characters or more) on a common account. Two tables: (sub_id, list) and the
    lists, (list, id, other, renamed), of which equal submissions share one. other and renamed order a list: those of
    another kind and with another name come last.

    submissions: sub_id, name_key, keys (of the name and aliases), accounts; registry: id, name_key, keys, accounts, ours
    (whether it is of the kind in question). composites (id) are no candidates, but for overrides (sub_id, id, one each).
    Equal submissions and equal records are one class each, and classes meet, so that copies make no pairs.
    """
    spark = submissions.sparkSession
    ids = registry.schema["id"].dataType
    empty = spark.createDataFrame([], "sub_id long, id long").select(F.col("sub_id").cast(submissions.schema["sub_id"].dataType), F.col("id").cast(ids))
    over = (overrides if overrides is not None else empty).select("sub_id", F.col("id").alias("over"))
    joint = (composites if composites is not None else empty).select("id").distinct().withColumn("__joint", F.lit(True))
    lone = over.select(F.col("over").alias("id")).distinct().withColumn("__named", F.lit(True))
    plain = lambda c: F.array_sort(F.array_distinct(c)).alias(c)
    own = F.when(F.col("__named"), F.col("id")).alias("own")
    members_s, subs = _classed(submissions.join(over.hint("merge"), "sub_id", "left"), "sub_id", [F.col("name_key"), plain("keys"), plain("accounts"), F.col("over")], "s")
    members_r, reg = _classed(registry.join(joint.hint("merge"), "id", "left").join(lone.hint("merge"), "id", "left"), "id", [F.col("name_key"), plain("keys"), plain("accounts"), F.col("ours"), F.coalesce("__joint", F.lit(False)).alias("joint"), own], "r")

    on = lambda df, *cs: reduce(lambda d, c: d.withColumn(c[:-1], F.explode(c)), cs, df)
    free = reg.where("NOT joint")
    both = ["key", "account"]
    stages = [subs.join(reg.select(F.col("own").alias("over"), "r"), "over").select("s", "r", F.lit(0).alias("stage"))]
    stages.append(on(subs, "keys", "accounts").select("s", *both).join(on(free, "keys", "accounts").select("r", *both), both).select("s", "r", F.lit(1).alias("stage")))
    alone = subs.groupBy("name_key").agg(F.sum("n").alias("all")).where("all = 1").select("name_key")
    bare = on(free.where("ours AND size(accounts) = 0"), "keys").select("r", "key")
    stages.append(on(subs.join(alone, "name_key", "left_semi"), "keys").select("s", "key").join(bare, "key").select("s", "r", F.lit(2).alias("stage")))
    s_names = on(subs.where(F.char_length("name_key") >= 4), "accounts").select("s", "account", F.col("name_key").alias("name"))
    r_names = on(free.where("ours"), "accounts").select("r", "account", F.col("name_key").alias("name"))
    found = contained(s_names, r_names)
    held = found.join(s_names.withColumnRenamed("name", "part"), ["account", "part"]).join(r_names.withColumnRenamed("name", "whole"), ["account", "whole"])
    stages.append(held.select("s", "r", F.lit(3).alias("stage")))
    met = written(reduce(DataFrame.union, stages).distinct(), "met")
    first = met.groupBy("s").agg(F.min("stage").alias("stage"))
    rows = met.join(first, ["s", "stage"]).join(reg.select("r", (~F.col("ours")).alias("other"), F.col("name_key").alias("r_name")), "r").join(subs.select("s", F.col("name_key").alias("s_name")), "s")
    rows = written(rows.select("s", "r", "other", (F.col("r_name") != F.col("s_name")).alias("renamed")), "pairs")
    # equal lists are told by their length and two sums of hashes, in whatever order
    marks = [F.xxhash64(F.lit(i), "r", "other", "renamed") for i in (1, 2)]
    said = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(marks[0]).alias("x"), F.sum(marks[1].cast("decimal(38,0)")).alias("y"))
    lists = said.join(said.groupBy("n", "x", "y").agg(F.min("s").alias("list")), ["n", "x", "y"]).select("s", "list")
    content = rows.join(lists.where("s = list").select("s", "list"), "s").join(members_r.hint("merge"), "r").select("list", "id", "other", "renamed")
    return members_s.join(lists.hint("merge"), "s").select("sub_id", "list"), content


#: Rows (submissions and places on their lists) of lists that hang together up to which one task takes them in their order
#: (some 100 MB of memory).
AT_ONCE = 1 << 20


#: Of places on a list.
ORDER = ["other", "renamed", "id"]


def _taken(choosers: pd.DataFrame, order: pd.DataFrame) -> pd.DataFrame:
    """sub_id and id of choosers (sub_id, list), taken in their order; order: list, id, and pos or else other and renamed."""
    left, used, taken = {}, set(), []
    order = order.sort_values(["pos"] if "pos" in order else ORDER, na_position="first")
    for name, record in zip(order["list"], order["id"]):
        left.setdefault(name, []).append(record)
    # what a list has given, or others have taken from it, is never looked at again
    left = {name: iter(records) for name, records in left.items()}
    choosers = choosers.sort_values("sub_id")
    for sub, name in zip(choosers["sub_id"], choosers["list"]):
        record = next((r for r in left.get(name, ()) if r not in used), None)
        if record is not None:
            used.add(record)
            taken.append((sub, record))
    return pd.DataFrame(taken, columns=["sub_id", "id"])


def _taken_at_once(order: DataFrame, choosers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sub_id, id) of lists that hang together (sizes: root, n), each root's in one task. Small ones, of which there may be
    very many, share a task: an eighth of AT_ONCE rows or so."""
    small = F.col("n") * 64 <= AT_ONCE
    n_bins = 1 + 8 * (sizes.where(small).agg(F.sum("n")).first()[0] or 0) // AT_ONCE
    bins = lambda: sizes.select("root", F.when(~small, F.col("root")).alias("own"), F.when(small, F.pmod(F.xxhash64("root"), F.lit(n_bins))).alias("bin"))
    dealt = lambda df: df.join(bins().hint("merge"), "root").groupBy("own", "bin")
    kind = T.StructType([T.StructField("sub_id", choosers.schema["sub_id"].dataType), T.StructField("id", order.schema["id"].dataType)])
    return dealt(choosers).cogroup(dealt(order)).applyInPandas(_taken, kind)


def assigned(submissions: DataFrame, lists: DataFrame) -> DataFrame:
    """(sub_id, id): submissions choose in the order of sub_id, each the first record of its list that is still free.

    submissions: sub_id, list; lists: list, id, other, renamed, in the order of other, renamed and id. On a list that shares
    no record with another one the k-th submission gets the k-th record; ranks are taken in ranges. Lists that meet, directly
    or in a chain, hang together: up to AT_ONCE rows of these are one task's, which takes them in their order; larger ones,
    of which there are few, go in rounds without any of them in one task.
    """
    lists = written(lists.distinct(), "lists")
    subs = written(submissions.select("sub_id", "list").distinct(), "choosers")
    meeting = written(components(batch_links(lists.select("list", "id"), "list", ["id"])).withColumnRenamed("node", "list"), "meeting")
    apart = (written(df.join(meeting, "list", "left_anti"), "apart") for df in (subs, lists))
    straight = reduce(lambda a, b: a.join(b.hint("merge"), ["list", "place"]), (places(df, "list", by) for df, by in zip(apart, (["sub_id"], ORDER)))).select("sub_id", "id")
    order, choosers = (written(df.join(meeting, "list"), "meeting") for df in (lists, subs))
    sizes = written(order.select("root").union(choosers.select("root")).groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    final = straight.union(_taken_at_once(order, choosers, sizes.where(F.col("n") <= AT_ONCE)))
    crowded = written(sizes.where(F.col("n") > AT_ONCE).select("root"), "crowded")
    if not crowded.isEmpty():
        final = final.union(_taken_in_rounds(*(written(df.join(crowded, "root"), "meeting") for df in (order, choosers))))
    return written(final, "final")


def _numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("list").orderBy(by)))


def _firsts(order: DataFrame, choosers: DataFrame, guess: DataFrame) -> DataFrame:
    """choosers with best: the first place of their list whose record no smaller one holds, by the guess."""
    holders = guess.where("id IS NOT NULL").groupBy("id").agg(F.min("sub_id").alias("holder"))
    upto = Window.partitionBy("list").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # it is the first place up to which the greatest holder isn't smaller
    held = order.join(holders, "id", "left").withColumn("mark", F.struct(F.col("holder").isNull().alias("free"), F.col("holder").alias("by")))
    events = held.select("list", F.max("mark").over(upto).alias("mark"), F.lit(0).alias("kind"), "pos", F.lit(None).cast(choosers.schema["sub_id"].dataType).alias("sub_id"))
    events = events.union(choosers.select("list", F.struct(F.lit(False).alias("free"), F.col("sub_id").alias("by")), F.lit(1), F.lit(None).cast("long"), "sub_id"))
    above = Window.partitionBy("list").orderBy(F.desc("mark"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("best", F.min("pos").over(above)).where("kind = 1").select("list", "sub_id", "best")


def _next(order: DataFrame, choosers: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """choosers with place, their turn among those that are left of lists that hang together (it may skip numbers; ranks:
    sub_id and place as they all were), and (root, most, n): up to which turn, a power of two or the last one, one task can
    take them. They take that many places of a list at most, so that these and they are n rows, up to AT_ONCE."""
    turns = written(choosers.join(ranks, "sub_id"), "turns")
    spans = turns.groupBy("root").agg(F.min("place").alias("least"), F.max("place").alias("last"))
    turns = turns.join(spans.hint("merge"), "root").select("root", "list", "sub_id", (F.col("place") - F.col("least") + 1).alias("place"), (F.col("last") - F.col("least") + 1).alias("last"))
    spans = turns.groupBy("root", "list", "last").agg(F.min("place").alias("first")).join(order.groupBy("list").agg(F.count(F.lit(1)).alias("size")).hint("merge"), "list")
    powers = F.explode(F.array(*(F.lit(1 << k).cast("long") for k in range(AT_ONCE.bit_length()))))
    spans = spans.withColumn("most", powers).withColumn("most", F.least("most", "last")).distinct()
    rows = spans.where("first <= most").groupBy("root", "most").agg((F.col("most") + F.sum(F.least("size", "most"))).alias("n"))
    return turns, written(rows.where(F.col("n") <= AT_ONCE).groupBy("root").agg(F.max(F.struct("most", "n")).alias("x")).select("root", "x.*"), "next")


def _taken_in_rounds(order: DataFrame, choosers: DataFrame) -> DataFrame:
    """(sub_id, id) of lists that hang together (order: root, list, id, other, renamed; choosers: root, list, sub_id), of
    which none has to be in one task.

    In a round a task takes the next submissions of lists that hang together, as many as it can; where these are few long
    lists, few rounds are enough. Of many long lists a task can't take many, so there is a guess as well: that the k-th
    submission of a list gets its k-th record. A submission is content if it has the first record of its list that no
    smaller one holds, so of lists that hang together all before the least one that isn't have what they get, and it has
    its first. They leave with their records; lists of which the same is left are one list from then on, whose members get
    its records by rank anew, and in others those that aren't content move on together. Each such round is written; its
    lists are sorted by windows, which spill.
    """
    order = written(places(order, "list", ORDER).select("list", "root", F.col("place").alias("pos"), "id"), "ranked")
    ranks = written(places(choosers, "root", ["sub_id"]).select("sub_id", "place"), "ranks")
    ranked = _numbered(choosers, "sub_id", "pos").withColumn("pos", F.col("pos").cast("long"))
    guess = written(ranked.join(order.select("list", "pos", "id"), ["list", "pos"], "left").select("root", "list", "sub_id", F.when(F.col("id").isNotNull(), F.col("pos")).alias("pos"), "id"), "guess")
    final = choosers.select("sub_id", F.lit(None).cast(order.schema["id"].dataType).alias("id")).where("false")
    while not choosers.isEmpty():
        turns, most = _next(order, choosers, ranks)
        now = written(turns.join(most, "root").where("place <= most").select("root", "list", "sub_id"), "now")
        ahead = order.join(most, "root").where("pos <= most").join(now.select("list").distinct().hint("merge"), "list", "left_semi").select("root", "list", "pos", "id")
        took = written(_taken_at_once(ahead, now, most), "took")
        final = written(final.union(took), "final")
        order = written(order.join(took.select("id").hint("merge"), "id", "left_anti"), "meeting")
        choosers = written(turns.join(most, "root").where("place > most").join(order.select("list").distinct().hint("merge"), "list", "left_semi").select("list", "root", "sub_id"), "meeting")
        if choosers.isEmpty():
            break
        guess = written(guess.join(choosers.select("sub_id").hint("merge"), "sub_id").select(*guess.columns), "guess")
        told = written(guess.join(_firsts(order, choosers, guess), ["list", "sub_id"]).withColumn("content", F.col("pos").eqNullSafe(F.col("best"))), "told")
        least = told.where("NOT content").groupBy("root").agg(F.min("sub_id").alias("least"))
        known = told.join(least, "root", "left").withColumn("rest", F.coalesce(F.col("sub_id") > F.col("least"), F.lit(False)))
        leave = known.where("NOT rest").select("list", "sub_id", F.col("best").alias("pos")).join(order, ["list", "pos"]).select("sub_id", "id")
        final = written(final.union(leave), "final")
        # what is left of the lists, and which of them are the same now
        left = written(_numbered(order.join(final.select("id").hint("merge"), "id", "left_anti"), "pos", "now"), "left")
        marks = [F.xxhash64(F.lit(i), "now", "id") for i in (1, 2)]
        said = left.groupBy("root", "list").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(marks[0]).alias("x"), F.sum(marks[1].cast("decimal(38,0)")).alias("y"))
        one = said.groupBy("root", "n", "x", "y").agg(F.min("list").alias("to"), F.count(F.lit(1)).alias("lists"))
        to = written(said.join(one, ["root", "n", "x", "y"]).select("list", "to", (F.col("lists") > 1).alias("joined")), "joined")
        order = written(left.join(to.where("list = to").select("list"), "list").select("list", "root", F.col("now").cast("long").alias("pos"), "id"), "meeting")
        # a list of which nothing is left has nothing for its members
        kept = written(known.where("rest").select("root", "list", "sub_id", "id", "content").join(to, "list").withColumn("list", F.col("to")).drop("to"), "kept")
        choosers = kept.select("list", "root", "sub_id")
        places_now = order.select("list", "id", "pos")
        stay = kept.where("content AND NOT joined").join(places_now, ["list", "id"], "left").select("root", "list", "sub_id", "pos", F.when(F.col("pos").isNotNull(), F.col("id")).alias("id"))
        anew = _numbered(kept.where("joined"), "sub_id", "turn").join(places_now.withColumnRenamed("pos", "turn").withColumnRenamed("id", "at"), ["list", "turn"], "left")
        moving = kept.where("NOT content AND NOT joined")
        spans = moving.groupBy("list").agg(F.max("sub_id").alias("most"))
        settled = stay.where("id IS NOT NULL").groupBy("id").agg(F.min("sub_id").alias("by"))
        free = order.join(spans, "list").join(settled.hint("merge"), "id", "left").where("by IS NULL OR by > most").select("list", "pos", "id")
        moved = _numbered(moving.drop("id"), "sub_id", "turn").join(_numbered(free, "pos", "turn"), ["list", "turn"], "left")
        rows = [stay, anew.select("root", "list", "sub_id", F.when(F.col("at").isNotNull(), F.col("turn")).cast("long").alias("pos"), F.col("at").alias("id")), moved.select("root", "list", "sub_id", "pos", "id")]
        guess = written(reduce(DataFrame.union, rows), "guess")
    return final


def composites(submissions: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, children): records of the kind whose name joins several (with a slash, ampersand or the like; `joint`) and holds
    the names of two or more submissions on common accounts, none of them the whole name. Names meet, not rows."""
    subs = submissions.select("sub_id", F.col("name_key").alias("name"), F.explode("accounts").alias("account"))
    reg = registry.where("ours AND joint").select("id", F.col("name_key").alias("name"), F.explode("accounts").alias("account"))
    members_s, named = _classed(submissions, "sub_id", [F.col("name_key").alias("name"), F.array_sort(F.array_distinct("accounts")).alias("accounts")], "s")
    members_r, joint = _classed(registry.where("ours AND joint"), "id", [F.col("name_key").alias("name"), F.array_sort(F.array_distinct("accounts")).alias("accounts")], "r")
    apart = lambda df, *cs: df.select(*cs, "name", F.explode("accounts").alias("account"))
    held = contained(subs, reg).join(apart(named, "s", "n").withColumnRenamed("name", "part"), ["account", "part"]).join(apart(joint, "r").withColumnRenamed("name", "whole"), ["account", "whole"])
    each = held.select("r", "whole", "s", "n", "part").distinct().groupBy("r").agg(F.sum("n").alias("children"), F.bool_or(F.col("part") == F.col("whole")).alias("itself"))
    return members_r.join(each.where("children > 1 AND NOT itself").hint("merge"), "r").select("id", "children")


def without_sibling_names(aliases: DataFrame, submissions: DataFrame) -> DataFrame:
    """aliases (sub_id, alias, alias_key) that aren't, and with 3 characters or more don't hold, the name of another
    submission on a common account. Of each name on an account the least and greatest submission are enough to know
    whether it is another's."""
    subs = submissions.select("sub_id", F.col("name_key").alias("name"), F.explode("accounts").alias("account"))
    who = subs.where("name != ''").groupBy("account", F.col("name").alias("part")).agg(F.min("sub_id").alias("lo"), F.max("sub_id").alias("hi"))
    beside = aliases.join(subs.select("sub_id", "account").hint("merge"), "sub_id").select("sub_id", "alias_key", "account").distinct()
    keys = beside.select("account", F.col("alias_key").alias("name"))
    found = contained(who.where(F.char_length("part") >= 3).select("account", F.col("part").alias("name")), keys)
    same = who.select("account", "part", F.col("part").alias("whole"))
    met = found.union(same).distinct().join(who.hint("merge"), ["account", "part"]).groupBy("account", "whole").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hit = beside.join(met.withColumnRenamed("whole", "alias_key").hint("merge"), ["account", "alias_key"]).where("lo != sub_id OR hi != sub_id")
    return aliases.join(hit.select("sub_id", "alias_key").distinct().hint("merge"), ["sub_id", "alias_key"], "left_anti")
