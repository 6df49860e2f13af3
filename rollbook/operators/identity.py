"""Identity resolution: rows meet records by exact account keys, never by name alone, under a stated policy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import written
from .overlay import latest_fields


@dataclass(frozen=True)
class Policy:
    """on_multi: what to do with an incoming row whose accounts belong to several records: skip (ambiguous), all, first or
    last. require_name: a match also needs a common name key. allow_new: unmatched rows become new records. own_id_first:
    a row whose id a record has already is that record, whatever its accounts. guard: a row that shares an account with
    records of other names only is left out (guarded) rather than new. named_need_name: only records that are `named` (a
    column of the registry) need a common name key."""

    on_multi: str = "skip"
    require_name: bool = False
    allow_new: bool = True
    own_id_first: bool = False
    guard: bool = False
    named_need_name: bool = False


def resolve(existing: DataFrame, incoming: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row for each incoming row and target: in_id, target, status (matched, ambiguous, guarded, new or unmatched).

    existing: id, account, name_key; incoming: in_id, account, name_key (a row for each account). Matches are made
    against the registry as it stood before the batch. The registry is aggregated to the least and greatest id of each
    account (and name) before it meets the batch, so that an account with many records and many rows makes no pairs; only
    the policy `all`, whose result they are, makes them: each once, as they come from the join (see _pairs).
    """
    names = ["account", "name_key"]
    ways = [(existing, names if policy.require_name else names[:1])]
    if policy.named_need_name and not policy.require_name:
        ways = [(existing.where("named"), names), (existing.where("NOT coalesce(named, false)"), names[:1])]
    met = [incoming.join(df.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).hint("merge"), keys).select("in_id", "lo", "hi") for df, keys in ways]
    found = reduce(DataFrame.union, met).groupBy("in_id").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    rows = incoming.select("in_id").distinct().join(found.hint("merge"), "in_id", "left")
    none = F.lit("new" if policy.allow_new else "unmatched")
    if policy.guard and (policy.require_name or policy.named_need_name):
        shared = incoming.join(existing.select("account").distinct().hint("merge"), "account", "left_semi").select("in_id").distinct()
        rows = rows.join(shared.withColumn("shared", F.lit(True)).hint("merge"), "in_id", "left")
        none = F.when(F.col("shared"), "guarded").otherwise(none)
    own = F.lit(None)
    if policy.own_id_first:
        rows = rows.join(existing.select(F.col("id").alias("in_id")).distinct().withColumn("own", F.lit(True)).hint("merge"), "in_id", "left")
        own = F.when(F.col("own"), F.col("in_id"))
    if policy.on_multi == "all":
        mark = lambda keys: F.concat(*(F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in map(F.col, keys)), F.lit(f"/{len(keys)}"))
        theirs = reduce(DataFrame.union, [df.select("id", mark(keys).alias("mark")) for df, keys in ways])
        asked = incoming.select("in_id", F.explode(F.array(*(mark(keys) for _, keys in ways))).alias("mark"))
        if policy.own_id_first:
            asked = asked.join(existing.select(F.col("id").alias("in_id")).distinct().hint("merge"), "in_id", "left_anti")
        pairs = _pairs(_gathered(theirs, "id"), _gathered(asked, "in_id")).select("in_id", F.col("id").alias("target"), F.lit("matched").alias("status"))
        # rows with an id that a record has, and those that meet none
        rest = rows.select("in_id", own.cast(existing.schema["id"].dataType).alias("target"), F.when(own.isNotNull(), "matched").otherwise(none).alias("status"), F.col("first").isNotNull().alias("met"))
        return pairs.union(rest.where("target IS NOT NULL OR NOT met").drop("met"))
    several = (F.col("first") != F.col("last")) & F.lit(policy.on_multi == "skip")
    target = F.coalesce(own, {"skip": F.when(~several, F.col("first")), "first": F.col("first"), "last": F.col("last")}[policy.on_multi])
    status = F.when(target.isNotNull(), "matched").when(several, "ambiguous").otherwise(none)
    return rows.select("in_id", target.alias("target"), status.alias("status"))


def applied(registry: DataFrame, rows: DataFrame, resolution: DataFrame, key: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """registry with the rows of a batch written into the records they were resolved to: a record's blank field is filled
    by the first row (by in_id) that has it, what it has stays, and `lists` become ordered unions; rows that are new are
    appended with their own ids. rows: in_id and fields of the registry. Written twice it is the same as once, if the
    second batch is resolved with own_id_first."""
    fields = [c for c in registry.columns if c != key and c in rows.columns]
    said = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    joined = rows.join(resolution.where("status IN ('matched', 'new')").hint("merge"), "in_id").withColumn("__to", F.coalesce("target", "in_id"))
    agg = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("in_id", F.col(c).alias("v")))), lambda x: x["v"]))).alias(f"__{c}") if c in lists else F.min_by(c, F.when(said(c).isNotNull(), F.col("in_id"))).alias(f"__{c}") for c in fields]
    patch = joined.groupBy(F.col("__to").alias(key)).agg(*agg)
    empty = {c: F.array().cast(registry.schema[c].dataType) for c in lists}
    out = {c: F.array_distinct(F.concat(F.coalesce(c, empty[c]), F.coalesce(f"__{c}", empty[c]))) if c in lists else F.coalesce(said(c), F.col(f"__{c}"), F.col(c)) for c in fields}
    return registry.join(patch, key, "full_outer").withColumns(out).select(*registry.columns)


def rechecked(registry: DataFrame, rows: DataFrame, resolution: DataFrame, key: str) -> DataFrame:
    """registry with what a check of its sources found in the records that rows were matched to: the last row's (by in_id)
    name and other fields, where they aren't blank. A reading that was of another name is cleared. Nothing is added.
    registry: key, name, reading and fields; rows: in_id, name and fields."""
    fields = [c for c in registry.columns if c in rows.columns and c != key]
    said = [F.max_by(c, F.when(F.col(c).cast("string") != "", F.col("in_id"))).alias(f"__{c}") for c in fields]
    patch = rows.join(resolution.where("status = 'matched'").select("in_id", "target").hint("merge"), "in_id").groupBy(F.col("target").alias(key)).agg(*said)
    stale = F.coalesce(F.col("__name") != F.col("name"), F.lit(False))
    out = {**{c: F.coalesce(f"__{c}", c) for c in fields}, "reading": F.when(~stale, F.col("reading"))}
    return registry.join(patch.hint("merge"), key, "left").withColumns(out).select(*registry.columns)


def consolidated(rows: DataFrame) -> DataFrame:
    """Duplicates by one channel and a common name key: id, kept_id and n_merged. rows: id, ord, channel, name_key,
    protected (never merged away). A row joins the earliest row of its channel and name key."""
    first = rows.where("channel IS NOT NULL").groupBy("channel", "name_key").agg(F.min_by("id", "ord").alias("kept_id"), F.count(F.lit(1)).alias("n_merged"))
    out = rows.join(first, ["channel", "name_key"], "left")
    own = F.col("protected") | F.col("kept_id").isNull()
    return out.select("id", F.when(own, F.col("id")).otherwise(F.col("kept_id")).alias("kept_id"), F.when(own, F.lit(1)).otherwise(F.col("n_merged")).alias("n_merged"))


#: Keys of a channel's rows up to which one task takes them in their order (some MB of memory).
AT_ONCE = 50_000


def _owners(channel: pd.DataFrame) -> pd.DataFrame:
    """id and owner of a channel's rows (id, ord, fixed, keys), taken in their order."""
    held, several, owners = {}, set(), []
    rows = channel.sort_values("ord")
    for own, fixed, keys in zip(rows["id"], rows["fixed"], rows["keys"]):
        met = {held[k] for k in keys if k in held}
        owner = met.pop() if len(met) == 1 and not fixed and several.isdisjoint(keys) else own
        several.update(k for k in keys if held.setdefault(k, owner) != owner)
        owners.append(owner)
    return pd.DataFrame({"id": rows["id"], "owner": owners})


def one_candidate(rows: DataFrame) -> DataFrame:
    """id and kept_id: in the order of `ord`, a row joins the record of its channel with which it has a name key in common,
    if there is exactly one; else it is a record of its own, as are fixed rows (of an immutable base), protected ones
    (characters, say, that share a channel) and those with no channel or several. A row's keys become its record's keys.

    rows: id, ord (each once), channels and keys (lists), fixed, protected. It is enough to know of each key the record
    that has it first, and whether a second one has it too. Channels don't meet, so that a task takes one with AT_ONCE keys
    or fewer row by row; larger ones, of which there are few, go in rounds without any group in one task.
    """
    able = rows.where("NOT protected").withColumn("channels", F.array_distinct(F.array_compact("channels"))).where("size(channels) = 1")
    keys = F.filter(F.array_distinct("keys"), lambda k: k != "").alias("keys")
    able = written(able.select("id", "ord", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.col("channels")[0].alias("channel"), keys).where("size(keys) > 0"), "keyed")
    sizes = able.groupBy("channel").agg(F.sum(F.size("keys")).alias("n"))
    crowded = written(sizes.where(F.col("n") > AT_ONCE).select("channel"), "crowded")
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("owner", rows.schema["id"].dataType)])
    owners = able.join(F.broadcast(crowded), "channel", "left_anti").groupBy("channel").applyInPandas(_owners, kind)
    if not crowded.isEmpty():
        owners = owners.union(_owners_in_rounds(able.join(F.broadcast(crowded), "channel", "left_semi")))
    owners = written(owners, "owners")
    return rows.select("id").join(owners, "id", "left").select("id", F.coalesce("owner", "id").alias("kept_id"))


def _owners_in_rounds(rows: DataFrame) -> DataFrame:
    """(id, owner) of rows (id, ord, fixed, channel, keys): the first record that has a key and when a second one has it too
    are taken from a guess of all records, which gives the next guess, until it stays as it is. That is the result row by
    row, as the first k rows are right after k rounds; a few rounds do unless rows hang together in long chains. Keys are
    aggregated, so that no group is in one task."""
    keyed = written(rows.select("id", "ord", "fixed", "channel", F.explode("keys").alias("key")), "keyed")
    by = ["channel", "key"]
    firsts = keyed.groupBy(*by).agg(F.min(F.struct("ord", "id")).alias("x"))
    guess = keyed.join(firsts, by).groupBy("id").agg(F.when(F.bool_or("fixed"), F.col("id")).otherwise(F.min("x")["id"]).alias("owner"))
    guess = written(guess, "owners")
    while True:
        spans = keyed.join(guess, "id").groupBy(*by, "owner").agg(F.min("ord").alias("at"))
        first = spans.groupBy(*by).agg(F.min_by("owner", "at").alias("one"), F.min("at").alias("at_one"))
        second = spans.join(first.hint("merge"), by).where("owner != one").groupBy(*by).agg(F.min("at").alias("at_two"))
        known = keyed.join(first, by).join(second.hint("merge"), by, "left").withColumn("one", F.when(F.col("ord") > F.col("at_one"), F.col("one")))
        told = known.groupBy("id").agg(F.min("one").alias("lo"), F.max("one").alias("hi"), F.bool_or(F.coalesce(F.col("ord") > F.col("at_two"), F.lit(False)) | F.col("fixed")).alias("apart"))
        owner = F.when(~F.col("apart") & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("id"))
        better = written(told.select("id", owner.alias("owner")), "owners")
        if better.join(guess.withColumnRenamed("owner", "before"), "id").where("owner != before").isEmpty():
            return better
        guess = better


def merged_duplicates(records: DataFrame, kept: DataFrame, key: str, name: str, aliases: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """records with those that have another kept_id (kept: id, kept_id) merged into it: its blank fields are filled, lists
    become ordered unions, and names of merged records are aliases, but never a record's own name."""
    gone = kept.where("id != kept_id").select(F.col("id").alias("in_id"), F.col("kept_id").alias("target"), F.lit("matched").alias("status"))
    registry = records.join(gone.select(F.col("in_id").alias(key)).hint("merge"), key, "left_anti")
    others = F.concat(F.coalesce(aliases, F.array().cast(records.schema[aliases].dataType)), F.array_compact(F.array(name)))
    out = applied(registry, records.withColumn(aliases, others).withColumnRenamed(key, "in_id"), gone, key, lists=(aliases, *lists))
    return out.withColumn(aliases, F.filter(aliases, lambda x: ~x.eqNullSafe(F.col(name))))


def with_submissions(layers: list[DataFrame], submissions: DataFrame) -> DataFrame:
    """One record for each id of the layers, under the submissions that mean it (see matched_submissions): in every layer
    that has the record, the last submission's reading, all their names and aliases, and their accounts, each once;
    submissions that mean no record are appended. Then later layers win by field, and accounts are those of all layers.

    layers: id, name, name_key, reading, aliases, accounts; submissions: the same and sub_id, by_id_only. Submissions meet
    the layers as they were before.
    """
    apart = lambda df, *cs: df.select(*cs, "name_key", F.explode_outer("accounts").alias("account"))
    records = reduce(DataFrame.union, (apart(df, "id") for df in layers)).distinct()
    hits = matched_submissions(records, apart(submissions.withColumnRenamed("id", "ref_id"), "sub_id", "ref_id", "by_id_only"))
    said = hits.join(submissions.drop("id", "name_key"), "sub_id")
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sub_id", c.alias("v")))), lambda x: x["v"]))
    patch = said.groupBy("id").agg(F.max_by("reading", "sub_id").alias("__reading"), in_order(F.concat(F.array("name"), "aliases")).alias("__aliases"), in_order(F.col("accounts")).alias("__accounts"))
    union = lambda c: F.when(F.col(f"__{c}").isNotNull(), F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), f"__{c}"))).otherwise(F.col(c))
    out = [df.join(patch, "id", "left").withColumns({"reading": F.coalesce("__reading", "reading"), "aliases": union("aliases"), "accounts": union("accounts")}).select(*df.columns) for df in layers]
    fresh = submissions.join(hits.select("sub_id").distinct(), "sub_id", "left_anti").select(*layers[-1].columns)
    return latest_fields([*out, fresh], "id", lists=("aliases",), joined=("accounts",))


def with_applications(records: DataFrame, apps: DataFrame) -> DataFrame:
    """records under applications, each applied to the first record (by id) with its id or one of its accounts, else to the
    one record that alone has its name; what means no record is appended, once for each id. Then all are applied again,
    now also to what was appended. The last application names a record; former names, and those of other applications,
    are aliases, and accounts are a union.

    records: id, name, name_key, aliases, accounts; apps: the same and app_id, their order. A pass meets the records as
    they were before it.
    """

    def targets(df: DataFrame) -> DataFrame:
        by_id = apps.select("app_id", "id").join(df.select("id"), "id").select("app_id", "id")
        by_account = apps.select("app_id", F.explode("accounts").alias("account")).join(df.select("id", F.explode("accounts").alias("account")).groupBy("account").agg(F.min("id").alias("id")), "account").select("app_id", "id")
        by_name = apps.select("app_id", "name_key").join(df.groupBy("name_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1"), "name_key").select("app_id", "id")
        ranked = by_id.union(by_account).withColumn("rank", F.lit(0)).union(by_name.withColumn("rank", F.lit(1)))
        return ranked.groupBy("app_id").agg(F.min(F.struct("rank", "id")).alias("x")).select("app_id", F.col("x.id").alias("id"))

    def applied_to(df: DataFrame, to: DataFrame) -> DataFrame:
        said = to.withColumnRenamed("id", "__to").join(apps, "app_id")
        in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("app_id", c.alias("v")))), lambda x: x["v"]))
        both = F.concat(F.coalesce("aliases", none), F.array("name"))
        patch = said.groupBy(F.col("__to").alias("id")).agg(F.max_by(F.struct("name", "name_key"), "app_id").alias("now"), in_order(both).alias("__aliases"), in_order(F.coalesce("accounts", none)).alias("__accounts"))
        names = F.array_distinct(F.concat(F.coalesce("aliases", none), F.array_compact(F.array("name")), "__aliases"))
        hit = F.col("now").isNotNull()
        out = {"aliases": F.when(hit, F.filter(names, lambda x: ~x.eqNullSafe(F.col("now.name")))).otherwise(F.col("aliases")), "accounts": F.when(hit, F.array_distinct(F.concat(F.coalesce("accounts", none), "__accounts"))).otherwise(F.col("accounts"))}
        now = {c: F.when(hit, F.col(f"now.{c}")).otherwise(F.col(c)) for c in ("name", "name_key")}
        return df.join(patch, "id", "left").withColumns({**out, **now}).select(*df.columns)

    none = F.array().cast("array<string>")
    first = targets(records)
    fresh = apps.join(first.select("app_id"), "app_id", "left_anti").groupBy("id").agg(F.min_by(F.struct(*(c for c in records.columns if c != "id")), "app_id").alias("x")).select("id", "x.*")
    once = written(applied_to(records, first).unionByName(fresh), "applied")
    return applied_to(once, targets(once))


def attached_metrics(accounts: DataFrame, metrics: DataFrame, rows: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """(id, metrics): of each record one metric for each account, in the order of platform and account: the last row for
    it, on every record that has exactly this account, else the one that it had. Rows of other platforms, with negative
    counts or without an https source don't count.

    accounts: id, platform, account_id; metrics: those, count and source; rows: the same without id, with ord.
    """
    account = ["platform", "account_id"]
    valid = rows.where(F.col("platform").isin(*platforms) & (F.col("count") >= 0) & F.col("source").startswith("https://"))
    latest = valid.groupBy(*account).agg(F.max_by(F.struct("count", "source"), "ord").alias("x"))
    new = accounts.select("id", *account).distinct().join(latest, account).select("id", *account, "x.*", F.lit(1).alias("layer"))
    each = new.unionByName(metrics.withColumn("layer", F.lit(0))).groupBy("id", *account).agg(F.max_by(F.struct("count", "source"), "layer").alias("x"))
    return each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*account, "x.count", "x.source"))).alias("metrics"))


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    """(key, marks): the marks of each key, each once, in one order; null ones are none."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("mark")).alias("marks"))


def _pairs(theirs: DataFrame, meant: DataFrame) -> DataFrame:
    """Pairs of rows of meant and theirs (a key and marks) with a mark in common. A pair is told by the first mark that both
    have and by no other, so that pairs come from one join and are neither kept, sorted nor shuffled to be distinct."""
    key, other = meant.columns[0], theirs.columns[0]
    said = meant.select(key, F.col("marks").alias("__all"), F.explode("marks").alias("__mark")).select(key, "__mark", F.filter("__all", lambda x: x < F.col("__mark")).alias("__before"))
    pairs = said.hint("merge").join(theirs.select(other, "marks", F.explode("marks").alias("__mark")), "__mark")
    return pairs.where((F.size("__before") == 0) | ~F.arrays_overlap("__before", "marks")).select(key, other)


def _marks(records: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, marks) and (sub_id, marks): by what records can be meant and what submissions mean, each once, in one order for
    all: accounts, names (not if by_id_only), ids."""
    own_id = F.col("ref_id").cast(records.schema["id"].dataType)
    of = lambda account, name, key: F.explode(F.array_compact(F.array(F.concat(F.lit("0"), account), F.concat(F.lit("1"), name), F.concat(F.lit("2"), key.cast("string")))))
    names = F.when(~F.col("by_id_only"), F.col("name_key"))
    return _gathered(records.select("id", of(F.col("account"), F.col("name_key"), F.col("id")).alias("mark")), "id"), _gathered(submissions.select("sub_id", of(F.col("account"), names, own_id).alias("mark")), "sub_id")


def matched_submissions(records: DataFrame, submissions: DataFrame) -> DataFrame:
    """(sub_id, id): records that a submission means by id, or by name unless by_id_only, or by account. Names and accounts
    that many records and submissions share make many pairs, which are the result (see _pairs)."""
    return _pairs(*_marks(records, submissions))


def greatest_said(records: DataFrame, submissions: DataFrame, value: str) -> DataFrame:
    """(id, value): the greatest value of the submissions that mean a record (see matched_submissions, whose pairs aren't
    made): that of each mark, then of a record's marks. Submissions have a row for each account with the value."""
    theirs, meant = _marks(records, submissions)
    values = submissions.groupBy("sub_id").agg(F.max(value).alias(value))
    by_mark = meant.hint("merge").join(values, "sub_id").select(F.explode("marks").alias("__mark"), value).groupBy("__mark").agg(F.max(value).alias(value))
    return theirs.select("id", F.explode("marks").alias("__mark")).hint("merge").join(by_mark, "__mark").groupBy("id").agg(F.max(value).alias(value))


def meaning_none(records: DataFrame, submissions: DataFrame) -> DataFrame:
    """(sub_id): submissions that mean no record."""
    theirs, meant = _marks(records, submissions)
    marks = theirs.select(F.explode("marks").alias("__mark")).distinct()
    hit = meant.select("sub_id", F.explode("marks").alias("__mark")).hint("merge").join(marks, "__mark", "left_semi").select("sub_id").distinct()
    return submissions.select("sub_id").distinct().hint("merge").join(hit, "sub_id", "left_anti")


def ranked_match(matches: DataFrame, by: str, target: str, rank: str) -> DataFrame:
    """The best-ranked target of each row, if it alone has that rank."""
    best = matches.groupBy(by, rank).agg(F.min(target).alias(target), F.countDistinct(target).alias("n"))
    top = best.groupBy(by).agg(F.min_by(F.struct(rank, target, "n"), rank).alias("x"))
    return top.where("x.n = 1").select(by, f"x.{rank}", f"x.{target}")
