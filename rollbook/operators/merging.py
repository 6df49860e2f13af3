"""Merge of a value that two sides edited from one base, as columns: scalars, lists, structs, maps with free keys, and JSON.

A value is there or absent, which is not the same as null or blank: a key that a map or a JSON object doesn't have is absent,
one that it has with null is null. What one side alone changed (added and removed is changed too) is as that side has it;
what both changed is as `current` has it, but maps, structs and objects are merged key by key, and lists are `current` with
what `collected` added."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    """A value that may be absent."""

    there: Column
    value: Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def comparable(value: Column, kind: T.DataType) -> Column:
    """The value in a form that `<=>` takes: maps are entries in the order of their keys."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(value, lambda v: comparable(v, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(value.isNotNull(), F.struct(*(comparable(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def same(a: Value, b: Value, kind: T.DataType) -> Column:
    return a.there.eqNullSafe(b.there) & (~a.there | comparable(a.value, kind).eqNullSafe(comparable(b.value, kind)))


def _with_added(b: Column, n: Column, c: Column, form: Callable[[Column], Column]) -> Column:
    """c and those items of n that neither b nor c has; null items count."""
    has = lambda items, v: F.exists(items, lambda x: form(x).eqNullSafe(form(v)))
    return F.concat(c, F.filter(n, lambda v: ~has(b, v) & ~has(c, v)))


def merged(b: Value, n: Value, c: Value, kind: T.DataType, lists: bool = True) -> Value:
    """The merge of base, collected and current. lists: arrays are merged as lists, else they are values like others; arrays
    in maps and structs are always lists. In a struct a null field is absent."""
    whole = b.there & n.there & c.there & b.value.isNotNull() & n.value.isNotNull() & c.value.isNotNull()
    if isinstance(kind, T.MapType):
        keys = F.array_union(F.map_keys(c.value), F.map_keys(n.value))

        def entry(k: Column) -> Column:
            parts = (Value(F.map_contains_key(x.value, k), F.try_element_at(x.value, k)) for x in (b, n, c))
            out = merged(*parts, kind.valueType)
            return F.struct(k.alias("key"), out.value.alias("value"), out.there.alias("there"))

        kept = F.filter(F.transform(keys, entry), lambda e: e["there"])
        both = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))
    elif isinstance(kind, T.ArrayType) and lists:
        both = _with_added(b.value, n.value, c.value, lambda v: comparable(v, kind.elementType))
    elif isinstance(kind, T.StructType):
        part = lambda x, f: Value(x.value[f.name].isNotNull(), x.value[f.name])
        fields = [(f.name, merged(*(part(x, f) for x in (b, n, c)), f.dataType)) for f in kind]
        both = F.struct(*(F.when(v.there, v.value).alias(name) for name, v in fields))
    else:
        both = c.value
    as_current, as_collected = same(n, b, kind) | same(n, c, kind), same(c, b, kind)
    value = F.when(as_current, c.value).when(as_collected, n.value).when(whole, both).otherwise(c.value)
    return Value(F.when(~as_current & as_collected, n.there).otherwise(c.there), value)


def merged_json(base: Column, collected: Column, current: Column, depth: int = 4) -> Column:
    """The merge of three JSON texts; null is absent, and so is a text that isn't JSON. Objects are merged key by key down to
    `depth` of them in one another, deeper ones as values. The result has its keys in order and no blanks."""
    plain = [F.to_json(F.try_parse_json(x)) for x in (base, collected, current)]
    return let(F.struct(*(x.alias(k) for x, k in zip(plain, "bnc"))), lambda v: _merged_texts(v["b"], v["n"], v["c"], depth))


def _merged_texts(b: Column, n: Column, c: Column, depth: int) -> Column:
    """Of texts in the one form that parsing and writing gives, so that equal values are equal texts."""

    def read(kind: str, x: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(x), "$", kind)

    def objects(v: Column) -> Column:
        keys = F.array_sort(F.array_union(F.map_keys(v["c"]), F.map_keys(v["n"])))
        texts = lambda k: (F.to_json(F.try_element_at(v[x], k)) for x in "bnc")
        named = lambda k: F.substring(F.to_json(F.array(k)), 2, F.length(F.to_json(F.array(k))) - 2)
        each = F.transform(keys, lambda k: F.concat(named(k), F.lit(":"), let(F.struct(*(x.alias(s) for x, s in zip(texts(k), "bnc"))), lambda t: _merged_texts(t["b"], t["n"], t["c"], depth - 1))))
        return F.concat(F.lit("{"), F.array_join(F.array_compact(each), ","), F.lit("}"))

    def lists(v: Column) -> Column:
        b, n, c = (F.transform(v[x], lambda i: F.to_json(i)) for x in "bnc")
        return F.concat(F.lit("["), F.array_join(_with_added(b, n, c, lambda x: x), ","), F.lit("]"))

    begin = lambda mark: b.startswith(mark) & n.startswith(mark) & c.startswith(mark)
    parsed = lambda kind: F.struct(*(read(kind, x).alias(k) for x, k in zip((b, n, c), "bnc")))
    out = F.when(n.eqNullSafe(b) | n.eqNullSafe(c), c).when(c.eqNullSafe(b), n)
    if depth > 0:
        out = out.when(F.coalesce(begin("{"), F.lit(False)), let(parsed("map<string,variant>"), objects))
    return out.when(F.coalesce(begin("["), F.lit(False)), let(parsed("array<variant>"), lists)).otherwise(c)
