"""Overlays and merges of record layers. A layer is a table with one row for each key; null means no opinion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import merging


def stacked(layers: list[DataFrame]) -> DataFrame:
    """All layers under each other with layer_rank (0 first); columns that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("layer_rank", F.lit(i)) for i, df in enumerate(layers)))


def latest_fields(layers: list[DataFrame], key: str, lists: tuple[str, ...] = (), joined: tuple[str, ...] = (), maps: tuple[str, ...] = (), present: str | None = None) -> DataFrame:
    """One row for each key: of every field the value of the last layer that has one; of `lists` the ordered distinct
    union over all layers, of `joined` all their items in order, of `maps` all entries, where later layers win. One
    shuffle on the key, with partial aggregation. present: a column with the names of the fields that a layer's row has;
    then a null or blank that is there wins over earlier values, and the result's column names what any layer has."""
    rows = stacked(layers)
    fields = [c for c in rows.columns if c not in (key, "layer_rank", present)]
    whole = (*lists, *joined, *maps)
    has = lambda c: F.array_contains(present, c) if present else F.col(c).isNotNull()
    last = [F.max_by(c, F.when(has(c), F.col("layer_rank"))).alias(c) for c in fields if c not in whole]
    last += [F.array_compact(F.array(*(F.when(F.bool_or(has(c)), F.lit(c)) for c in fields))).alias(present)] if present else []

    def gathered(c: str) -> Column:
        value = F.map_entries(c) if c in maps else F.col(c)
        items = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("layer_rank", value.alias("v"))))), lambda x: x["v"]))
        if c in maps:  # the last entry of each name, where the first stands
            names = F.array_distinct(F.transform(items, lambda e: e["key"]))
            return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(items, lambda e: e["key"] == k), -1)["value"]))
        return F.array_distinct(items) if c in lists else items

    return rows.groupBy(key).agg(*last, *(gathered(c).alias(c) for c in whole))


def patched(base: DataFrame, patch: DataFrame, key: str, keep_if_blank: tuple[str, ...] = ()) -> DataFrame:
    """base with the patch's values where it has the key and a value; a blank never erases the fields in keep_if_blank.
    Keys that only the patch has add nothing."""
    fields = [c for c in patch.columns if c != key]
    b = patch.select(key, *(F.col(c).alias(f"__{c}") for c in fields))
    new = {c: F.nullif(F.col(f"__{c}"), F.lit("")) if c in keep_if_blank else F.col(f"__{c}") for c in fields}
    out = base.join(b, key, "left").withColumns({c: F.coalesce(v, F.col(c)) if c in base.columns else v for c, v in new.items()})
    return out.drop(*(f"__{c}" for c in fields))


def three_way(base: DataFrame, collected: DataFrame, current: DataFrame, key: str, lists: tuple[str, ...] = (), present: str | None = None) -> DataFrame:
    """Merge of two edits of one base, row by row and field by field (see merging). A row or field that one side alone
    changed, added or removed is as that side has it; one that both changed has what `current` says, but structs and maps
    are merged by field and key, and `lists` are `current` with what `collected` added. So a row that one side removed and
    the other left alone is removed, and one that `collected` removed and `current` edited stays.

    present: a column with the names of the fields that a row has; a null or blank among them is a value, and the result
    has the column too. Without it, null is a field that isn't there.
    """
    fields = [c for c in base.columns if c not in (key, present)]
    kinds = {f: base.schema[f].dataType for f in fields}

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*fields, *([present] if present else [])).alias(name))

    rows = side(base, "b").join(side(collected, "n"), key, "full_outer").join(side(current, "c"), key, "full_outer")
    here = {x: F.col(x).isNotNull() for x in "bnc"}

    def value(x: str, f: str) -> merging.Value:
        has = F.coalesce(F.array_contains(F.col(f"{x}.{present}"), f), F.lit(False)) if present else F.col(f"{x}.`{f}`").isNotNull()
        return merging.Value(here[x] & has, F.col(f"{x}.`{f}`"))

    def equal(x: str, y: str) -> Column:
        return reduce(lambda a, b: a & b, (merging.same(value(x, f), value(y, f), kinds[f]) for f in fields), F.lit(True))

    gone = here["b"] & ~here["n"] & equal("c", "b")
    rows = rows.where((here["c"] & ~gone) | (~here["b"] & ~here["c"]))
    out = {f: merging.merged(value("b", f), value("n", f), value("c", f), kinds[f], f in lists) for f in fields}
    three = here["b"] & here["n"] & here["c"]
    pick = lambda f: F.when(three, F.when(out[f].there, out[f].value)).when(here["c"], F.col(f"c.`{f}`")).otherwise(F.col(f"n.`{f}`"))
    names = F.array_compact(F.array(*(F.when(out[f].there, F.lit(f)) for f in fields)))
    there = [F.when(three, names).when(here["c"], F.col(f"c.{present}")).otherwise(F.col(f"n.{present}")).alias(present)] if present else []
    return rows.select(key, *(pick(f).alias(f) for f in fields), *there)


def superseding(layers: DataFrame, records: DataFrame, superseded: DataFrame, key: str) -> DataFrame:
    """layers without superseded keys, with records laid over the rest; applying it twice is applying it once."""
    kept = layers.join(superseded.select(key), key, "left_anti")
    return latest_fields([kept, records.join(superseded.select(key), key, "left_anti")], key)


def appended_unseen(base: DataFrame, rows: DataFrame, key: str, other: str) -> DataFrame:
    """base and those rows of which neither the key nor the other column is there yet."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti").join(base.select(other).where(F.col(other).isNotNull()), other, "left_anti").select(*rows.columns), allowMissingColumns=True)


def renamed(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """records under the first override (by place) that means them, by a former name, the id or an account: it gives name
    and reading, and the former names become aliases. Three equi-joins stand for the OR.

    records: id, name, name_key, reading, inferred, aliases, accounts; overrides: place, id, name, reading, accounts,
    old_names and old_keys.
    """
    o = overrides.select("place", F.col("id"), "old_keys", "accounts")
    by_name = records.select("id", "name_key").join(o.select("place", F.explode("old_keys").alias("name_key")), "name_key").select("id", "place")
    by_id = records.select("id").join(o.select("id", "place"), "id")
    by_account = records.select("id", F.explode("accounts").alias("account")).join(o.select("place", F.explode("accounts").alias("account")), "account").select("id", "place")
    first = by_name.union(by_id).union(by_account).groupBy("id").agg(F.min("place").alias("place"))
    now = first.join(overrides.select("place", F.col("name").alias("__name"), F.col("reading").alias("__reading"), "old_names"), "place").drop("place")
    hit = F.col("__name").isNotNull()
    former = F.when(F.col("name") != F.col("__name"), F.array("name")).otherwise(F.array().cast("array<string>"))
    out = records.join(now, "id", "left").withColumn("aliases", F.when(hit, F.array_distinct(F.concat("aliases", former, "old_names"))).otherwise(F.col("aliases")))
    return out.withColumns({"name": F.coalesce("__name", "name"), "reading": F.when(hit, F.col("__reading")).otherwise(F.col("reading")), "inferred": ~hit & F.col("inferred")}).select(*records.columns)


def restored(base: DataFrame, present: DataFrame, family: DataFrame, key: str, licence: tuple[str, ...], expected: int) -> DataFrame:
    """base with the records of a family that aren't present (a table of keys): fields that base has win, licence columns
    are the family's. With `expected` of them present nothing changes; a family of fewer is an error."""
    if present.select(key).distinct().count() >= expected:
        return base
    if (n := family.count()) < expected:
        raise ValueError(f"the family has {n} records, {expected} are expected")
    lost = family.join(present.select(key), key, "left_anti").select(key, *(F.col(c).alias(f"__{c}") for c in family.columns if c != key))
    fields = [c for c in base.columns if c != key]
    value = lambda c: F.coalesce(f"__{c}", c) if c in licence else F.coalesce(c, f"__{c}")
    return base.join(lost, key, "full_outer").select(key, *(value(c).alias(c) if c in family.columns else F.col(c) for c in fields))


def first_wins(queue: DataFrame, key: str, order: str, fill: str) -> DataFrame:
    """One row for each key, the earliest; a later one may only fill a missing `fill`."""
    rest = [c for c in queue.columns if c not in (key, fill)]
    out = queue.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("first"), F.min_by(fill, F.when(F.col(fill).isNotNull(), F.col(order))).alias(fill))
    return out.select(key, "first.*", fill)
