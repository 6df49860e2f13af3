"""Merges of three sides against plain Python: maps, structs, lists and JSON, with absent, null and blank told apart."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import merging, overlay

GONE = object()


def _merge(b, n, c):
    """Of plain values; an absent one is GONE."""
    if n == b or n == c:
        return c
    if c == b:
        return n
    sides = (b, n, c)
    if all(isinstance(x, dict) for x in sides):
        keys = dict.fromkeys([*c, *n])
        out = {k: _merge(*(x.get(k, GONE) for x in sides)) for k in keys}
        return {k: v for k, v in out.items() if v is not GONE}
    if all(isinstance(x, list) for x in sides):
        return c + [v for v in n if v not in b and v not in c]
    return c


def _json(spark, triples, depth=4):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "i int, b string, n string, c string")
    got = {r["i"]: r["m"] for r in df.select("i", merging.merged_json(F.col("b"), F.col("n"), F.col("c"), depth).alias("m")).collect()}
    return [got[i] for i in range(len(triples))]


def _value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return {k: _value(rng, depth - 1) for k in rng.sample(["a", "b", "é\"q", ""], rng.randrange(4))}
    if kind == 6:
        return [_value(rng, 0) for _ in range(rng.randrange(3))]
    return [None, "", "x", 7, True][kind]


def test_json_is_merged_as_plain_values(spark):
    rng = random.Random(5)
    text = lambda v: None if v is GONE else json.dumps(v)
    some = lambda: GONE if rng.random() < 0.1 else {k: _value(rng, 2) for k in rng.sample("stuvw", rng.randrange(6))}

    def edited(v):
        if v is GONE or rng.random() < 0.1:
            return some()
        out = {k: (edited(x) if isinstance(x, dict) else x) for k, x in v.items() if rng.random() < 0.85}
        out = {k: x for k, x in out.items() if x is not GONE}
        if rng.random() < 0.6:
            out[rng.choice("stuvw")] = _value(rng, 2)
        return out

    triples = []
    for _ in range(300):
        base = some()
        triples.append((base, edited(base), edited(base)))
    got = _json(spark, [tuple(map(text, t)) for t in triples])
    for t, g in zip(triples, got):
        want = _merge(*t)
        assert (GONE if g is None else json.loads(g)) == want


def test_json_that_is_none(spark):
    assert _json(spark, [(None, None, None), ("bad", '{"a":1}', None), ("[1]", "[1, 2]", "[3, 1]"), ('{"a": 1.0}', '{"a":1}', "null")]) == [None, '{"a":1}', "[3,1,2]", "null"]
    # below the depth objects are values: both sides changed it
    assert _json(spark, [('{"a":{"b":1}}', '{"a":{"b":2}}', '{"a":{"b":1,"c":3}}')], depth=1) == ['{"a":{"b":1,"c":3}}']


def test_long_json(spark):
    base = {f"k{i}": i for i in range(2000)}
    n, c = {**base, "k7": "n", "new": 1}, {**base, "k9": "c"}
    c.pop("k11")
    assert json.loads(_json(spark, [tuple(map(json.dumps, (base, n, c)))])[0]) == _merge(base, n, c)


KIND = "id string, name string, aliases array<string>, facts map<string,string>, present array<string>"


def _records(spark, rows):
    return spark.createDataFrame([(r["id"], r.get("name"), r.get("aliases"), r.get("facts"), [k for k in r if k != "id"]) for r in rows], KIND)


def _merged(spark, *sides):
    out = overlay.three_way(*(_records(spark, s) for s in sides), "id", lists=("aliases",), present="present").collect()
    return {r["id"]: {k: r[k] for k in r["present"]} for r in out}


def test_corrections_and_removals_survive_a_collection(spark):
    base = [{"id": "a", "name": "Old", "aliases": ["removed"]}, {"id": "removed", "name": "Removed"}]
    collected = [{"id": "a", "name": "Scraped", "aliases": ["removed", "new"], "facts": {"activity": "https://example.com/a"}}, *base[1:], {"id": "b", "name": "Found"}]
    current = [{"id": "a", "name": "Corrected", "aliases": []}, {"id": "c", "name": "Submitted"}]
    assert _merged(spark, base, collected, current) == {"a": {"name": "Corrected", "aliases": ["new"], "facts": {"activity": "https://example.com/a"}}, "b": {"name": "Found"}, "c": {"name": "Submitted"}}


@pytest.mark.parametrize("seed", range(3))
def test_records_are_merged_as_plain_values(spark, seed):
    rng = random.Random(seed)

    def record(i):
        all_ = {"name": rng.choice([None, "", "x", "y"]), "aliases": rng.choice([None, [], ["p"], ["p", "q", None]]), "facts": rng.choice([None, {}, {"k": None}, {"k": ""}, {"k": "1", "l": "2"}])}
        return {"id": i, **{k: v for k, v in all_.items() if rng.random() < 0.8}}

    def edit(rows):
        out = [rng.choice([r, {**r, **record(r["id"])}, {k: v for k, v in r.items() if k == "id" or rng.random() < 0.7}]) for r in rows if rng.random() < 0.85]
        return out + [record(f"new{i}") for i in range(6) if rng.random() < 0.5]

    base = [record(f"r{i}") for i in range(40)]
    sides = (base, edit(base), edit(base))
    want = _merge(*({r["id"]: {k: v for k, v in r.items() if k != "id"} for r in s} for s in sides))
    assert _merged(spark, *sides) == want


def test_maps_of_structs_and_maps(spark):
    kind = "id string, m map<string,struct<a:string,b:map<string,int>>>, l array<map<string,string>>"
    base = [("1", {"k": ("x", {"i": 1}), "gone": ("y", {})}, [{"q": "1"}])]
    collected = [("1", {"k": ("n", {"i": 1, "j": 2}), "gone": ("y", {}), "new": ("z", None)}, [{"q": "1"}, {"q": "2"}])]
    current = [("1", {"k": ("x", {"i": 5})}, [{"q": "3"}])]
    r = overlay.three_way(*(spark.createDataFrame(s, kind) for s in (base, collected, current)), "id", lists=("l",)).first().asDict(True)
    assert r["m"] == {"k": {"a": "n", "b": {"i": 5, "j": 2}}, "new": {"a": "z", "b": None}} and r["l"] == [{"q": "3"}, {"q": "2"}]


def test_a_removed_row_that_was_edited_stays(spark):
    kind = "id string, name string"
    side = lambda *rows: spark.createDataFrame(rows, kind)
    out = overlay.three_way(side(("1", "x"), ("2", "x"), ("3", "x")), side(("3", "y")), side(("1", "mine"), ("2", "x")), "id")
    assert [tuple(r) for r in out.collect()] == [("1", "mine")]
    assert overlay.three_way(side().limit(0), side().limit(0), side().limit(0), "id").count() == 0


def test_a_null_that_is_there_lies_over_a_value(spark):
    kind = "id string, name string, note string, present array<string>"
    layers = [spark.createDataFrame([("1", "a", "n", ["name", "note"]), ("2", "b", None, ["name"])], kind), spark.createDataFrame([("1", None, None, ["name"]), ("2", None, None, [])], kind)]
    out = {r["id"]: tuple(r)[1:] for r in overlay.latest_fields(layers, "id", present="present").collect()}
    assert out == {"1": (None, "n", ["name", "note"]), "2": ("b", None, ["name"])}
