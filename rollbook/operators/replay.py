"""A batch in its order: each row meets the registry as the rows before it left it.

What a row is depends on earlier rows, so that all rows are guessed at once, each guess says what every account held at any
time, and that gives the next guess. The first k rows are right after k rounds, so the guess that stays is the result row by
row; good first guesses make that a few rounds, unless decisions hang together in long chains. Accounts are aggregated to
their first two holders: no account's rows are in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .components import batch_links, components

#: Before any row of a batch.
_BEFORE = "CAST(-1 AS BIGINT)"


def _first_two(held: DataFrame, by: list[str]) -> DataFrame:
    """held: by, owner, at. Of each `by` the owner that had it first (one, at_one) and when a second had it (at_two)."""
    spans = held.groupBy(*by, "owner").agg(F.min("at").alias("at"))
    first = spans.groupBy(*by).agg(F.min(F.struct("at", "owner")).alias("x")).select(*by, F.col("x.owner").alias("one"), F.col("x.at").alias("at_one"))
    second = spans.join(first.hint("merge"), by).where("owner != one").groupBy(*by).agg(F.min("at").alias("at_two"))
    return first.join(second.hint("merge"), by, "left")


def _found(rows: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """rows: ord and by. ord, lo and hi (the least and greatest owner that was there before), several."""
    met = rows.join(known.hint("merge"), by).withColumn("one", F.when(F.col("at_one") < F.col("ord"), F.col("one")))
    out = met.groupBy("ord").agg(F.min("one").alias("lo"), F.max("one").alias("hi"), F.bool_or(F.coalesce(F.col("at_two") < F.col("ord"), F.lit(False))).alias("several"))
    return out.select("ord", "lo", "hi", (F.col("several") | F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("several"))


def _settled(guess: DataFrame, better) -> DataFrame:
    """better(guess), again and again, until it stays. guess: ord, target, status."""
    guess = written(guess, "guess")
    while True:
        after = written(better(guess), "guess")
        changed = after.join(guess.select("ord", F.col("target").alias("t"), F.col("status").alias("s")), "ord").where("NOT (target <=> t AND status <=> s)")
        if changed.isEmpty():
            return after
        guess = after


def replayed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(ord, in_id, target, status) of each row: own (a record has its id), matched (one record has one of its accounts),
    ambiguous (several have, and the row is left out) or new, against the registry with all rows before it written into
    it: their accounts are their targets' from then on.

    existing: id, account; incoming: ord (each row's place), in_id, account, with a row for each account (null: none).
    Ids may come several times in a batch.
    """
    rows = written(incoming.select("ord", "in_id").distinct(), "rows")
    accounts = written(incoming.select("ord", "account").where("account IS NOT NULL").distinct(), "accounts")
    known = written(existing.select("id").distinct(), "known")
    before = existing.where("account IS NOT NULL").select("account", F.col("id").alias("owner"), F.expr(_BEFORE).alias("at")).distinct()

    def better(guess: DataFrame) -> DataFrame:
        kept = guess.where("status != 'ambiguous'")
        held = before.union(accounts.join(kept, "ord").select("account", F.col("target").alias("owner"), F.col("ord").alias("at")))
        found = _found(accounts, _first_two(held, ["account"]), ["account"])
        ids = known.select(F.col("id").alias("in_id"), F.expr(_BEFORE).alias("since")).union(kept.where("status = 'new'").select(F.col("target").alias("in_id"), F.col("ord").alias("since")))
        ids = ids.groupBy("in_id").agg(F.min("since").alias("since"))
        out = rows.join(found, "ord", "left").join(ids.hint("merge"), "in_id", "left")
        own = F.coalesce(F.col("since") < F.col("ord"), F.lit(False))
        status = F.when(own, "own").when(F.coalesce("several", F.lit(False)), "ambiguous").when(F.col("lo").isNotNull(), "matched").otherwise("new")
        return out.select("ord", "in_id", status.alias("status"), F.when(status == "matched", F.col("lo")).when(status != "ambiguous", F.col("in_id")).alias("target"))

    # as if the whole batch came at once: a component's rows are the record that its first row is
    nobody = rows.select("ord", "in_id", F.lit("ambiguous").alias("status"), F.lit(None).cast(existing.schema["id"].dataType).alias("target"))
    alone = better(nobody)
    roots = components(batch_links(accounts, "ord", ["account"])).withColumnRenamed("node", "ord")
    first = alone.select(F.col("ord").alias("root"), F.col("target").alias("of_root"))
    spread = alone.join(roots.hint("merge"), "ord", "left").join(first.hint("merge"), "root", "left")
    later = (F.col("status") == "new") & (F.col("root") != F.col("ord")) & F.col("of_root").isNotNull()
    guess = spread.select("ord", "in_id", F.when(later, "matched").otherwise(F.col("status")).alias("status"), F.when(later, F.col("of_root")).otherwise(F.col("target")).alias("target"))
    return _settled(guess, better).select("ord", "in_id", "target", "status")


def replayed_by_name(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(ord, in_id, target, status, retired) for a directory whose rows need a common name beside the account, row by row:

    - compatible are records with the row's account and one of its names (their names grow with every row that they take),
      but never the directory's own stubs; records that list the row's id are its previous ones;
    - with exactly one compatible record, and no previous one but that and the row's own stub, it is the target (matched),
      and the stub is retired (`retired` is its id);
    - else the previous ones are (listed: a row for each of them);
    - else an inactive row is left out (inactive), and an active one is new: under its account's own id where no one has
      had the account before, else as a stub.

    existing: id, stub (whether it is one of the directory's), accounts, names and listed (directory ids), all lists;
    incoming: ord, in_id (each once), stub_id, account (may be null), account_id (the id of a new record of that account),
    names, active.
    """
    rows = written(incoming.select("ord", "in_id", "stub_id", "account", "account_id", "active"), "rows")
    keys = written(incoming.select("ord", F.explode(F.array_distinct("names")).alias("key")).where("key != ''"), "keys")
    asked = written(rows.where("account IS NOT NULL").select("ord", "account").join(keys, "ord"), "asked")
    had_account = written(existing.select(F.col("id").alias("owner"), "stub", F.explode("accounts").alias("account")).distinct(), "had_accounts")
    had_name = existing.where("NOT stub").select(F.col("id").alias("owner"), F.explode("names").alias("key"), F.expr(_BEFORE).alias("named")).distinct()
    listed = written(existing.select("id", "stub", F.explode("listed").alias("in_id")).distinct().join(rows.select("ord", "in_id", "stub_id"), "in_id").select("ord", "id", "stub_id"), "listed")

    def better(guess: DataFrame) -> DataFrame:
        told = guess.where("status NOT IN ('inactive', 'listed')").select("ord", F.col("target").alias("owner"), "status")
        new = rows.join(told.where("status = 'new'"), "ord").select("owner", (F.col("owner") == F.col("stub_id")).alias("stub"), "account", F.col("ord").alias("at")).where("account IS NOT NULL")
        holders = had_account.select("owner", "stub", "account", F.expr(_BEFORE).alias("at")).union(new)
        names = had_name.union(keys.join(told.select("ord", "owner").union(listed.join(guess.where("status = 'listed'"), "ord").select("ord", F.col("id").alias("owner"))), "ord").select("owner", "key", F.col("ord").alias("named")))
        pairs = holders.where("NOT stub").groupBy("owner", "account").agg(F.min("at").alias("at")).join(names.groupBy("owner", "key").agg(F.min("named").alias("named")).hint("merge"), "owner")
        found = _found(asked, _first_two(pairs.select("account", "key", "owner", F.greatest("at", "named").alias("at")), ["account", "key"]), ["account", "key"])
        seen = holders.groupBy("account").agg(F.min("at").alias("since"))
        # of the previous ones: another than the compatible record and the row's own stub
        other = listed.join(found, "ord", "left").where("id != stub_id AND NOT (id <=> lo)").select("ord").distinct().withColumn("other", F.lit(True))
        stubs = listed.groupBy("ord").agg(F.bool_or(F.col("id") == F.col("stub_id")).alias("has_stub"))
        out = rows.join(found, "ord", "left")
        for more, by in ((seen, "account"), (other, "ord"), (stubs, "ord")):
            out = out.join(more.hint("merge"), by, "left")
        one = F.col("lo").isNotNull() & ~F.col("several") & F.col("other").isNull()
        status = F.when(one, "matched").when(F.col("has_stub").isNotNull(), "listed").when(F.col("active"), "new").otherwise("inactive")
        unheld = F.col("account").isNotNull() & ~F.coalesce(F.col("since") < F.col("ord"), F.lit(False))
        target = F.when(one, F.col("lo")).when(status == "new", F.when(unheld, F.col("account_id")).otherwise(F.col("stub_id")))
        return out.select("ord", "in_id", status.alias("status"), target.alias("target"), F.when(one & F.col("has_stub"), F.col("stub_id")).alias("retired"))

    nobody = rows.select("ord", "in_id", F.lit("inactive").alias("status"), F.lit(None).cast(existing.schema["id"].dataType).alias("target"))
    out = _settled(nobody, better)
    several = listed.select("ord", F.col("id").alias("previous"))
    each = out.join(several, "ord", "left")
    target = F.when(F.col("status") == "listed", F.col("previous")).otherwise(F.col("target"))
    return each.select("ord", "in_id", target.alias("target"), "status", "retired").distinct()


def without_retired(registry: DataFrame, replay: DataFrame, key: str) -> DataFrame:
    """registry without the stubs that replayed_by_name() retired."""
    gone = replay.where("retired IS NOT NULL").select(F.col("retired").alias(key)).distinct()
    return registry.join(gone.hint("merge"), key, "left_anti")
