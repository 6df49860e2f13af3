"""Submissions to records against plain Python: names within names, lists that meet, and their rounds."""

from __future__ import annotations

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rollbook.operators import assignment
from rollbook.plans import joins


@pytest.mark.parametrize("seed", range(2))
def test_names_within_names_of_an_account(spark, seed):
    rng = random.Random(seed)
    name = lambda most: "".join(rng.choice("abé") for _ in range(rng.randrange(most)))
    parts = [(rng.choice("xyz"), name(6)) for _ in range(60)] + [(None, "a"), ("x", None), ("x", "")]
    wholes = [(rng.choice("xyz"), name(9)) for _ in range(60)] + [(None, "a"), ("x", None), ("q", "a")]
    got = assignment.contained(spark.createDataFrame(parts, "account string, name string"), spark.createDataFrame(wholes, "account string, name string"))
    want = {(a, p, w) for a, p in parts for b, w in wholes if a and a == b and p and w and p in w}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_crowded_account_makes_few_pairs(spark):
    names = [("hot", f"{i:05}name") for i in range(3000)]
    wholes = [(a, n + "long") for a, n in names]
    got = assignment.contained(spark.createDataFrame(names, "account string, name string"), spark.createDataFrame(wholes, "account string, name string"))
    plan = got.where("true")
    assert plan.count() == 3000
    # the rarest runs are what the comparison gets, of which a name shares few
    runs = {n: min((sum(n[k : k + 3] in w for _, w in wholes[:1000]), n[k : k + 3]) for k in range(len(n) - 2)) for _, n in names[:1000]}
    assert sum(n for n, _ in runs.values()) < 20 * 1000


def _in_order(subs, lists):
    used, out = set(), []
    for sub, name in sorted(subs):
        for i in sorted((o, r, i) for n, i, o, r in lists if n == name):
            if i[2] not in used:
                used.add(i[2])
                out.append((sub, i[2]))
                break
    return out


def _assigned(spark, subs, lists):
    out = assignment.assigned(spark.createDataFrame(subs, "sub_id long, list string"), spark.createDataFrame(lists, "list string, id string, other boolean, renamed boolean"))
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_lists_that_meet(spark, seed):
    rng = random.Random(seed)
    subs = [(i, f"l{rng.randrange(6)}") for i in rng.sample(range(1000), 24)]
    lists = [(f"l{n}", f"r{i:03}", rng.random() < 0.3, rng.random() < 0.5) for n in range(7) for i in range(20) if rng.random() < 0.4]
    assert _assigned(spark, subs, lists) == _in_order(subs, lists)


@pytest.mark.parametrize(("n", "meet"), [(8, False), (200, False), (200, True)])
def test_contention_takes_few_rounds(spark, monkeypatch, n, meet):
    """Two classes with copies, each preferring its own half: what is left over goes to the other's."""
    subs = [(i, "a" if i % 3 else "b") for i in range(2 * n)]
    lists = [(c, f"{c}{i:04}", False, False) for c in "ab" for i in range(n)]
    if meet:
        lists += [("a", f"b{i:04}", False, True) for i in range(n)] + [("b", f"a{i:04}", False, True) for i in range(n)]
    rounds = []
    monkeypatch.setattr(assignment, "written", lambda df, name, f=assignment.written: rounds.append(name) or f(df, name))
    assert _assigned(spark, subs, lists) == _in_order(subs, lists)
    assert rounds.count("told") <= 10


@pytest.mark.parametrize("n", [20, 300])
def test_copies_on_lists_that_meet_take_no_more_steps(spark, monkeypatch, n):
    """Two lists of the same records, each with others first: what one has had enough of both take from, in turns."""
    rng = random.Random(n)
    kinds = [(f"{i:05}", i % 4 // 2 > 0, i % 2 > 0) for i in range(n)]
    lists = [(c, i, other, renamed != (c == "a")) for c in "ab" for i, other, renamed in kinds]
    subs = [(i, rng.choice("aab")) for i in rng.sample(range(9 * n), n + n // 9)]
    steps = []
    monkeypatch.setattr(assignment, "written", lambda df, name, f=assignment.written: steps.append(name) or f(df, name))
    assert _assigned(spark, subs, lists) == _in_order(subs, lists)
    assert len(steps) <= 12


@pytest.mark.parametrize("at_once", [1 << 20, 700, 60, 12])
def test_lists_that_hang_together_are_one_tasks_or_go_in_rounds(spark, monkeypatch, at_once):
    """Groups of lists of several sizes, some of one list, some of lists that share no record with the next but one; names
    that are neither there nor not there come first."""
    rng = random.Random(at_once)
    monkeypatch.setattr(assignment, "AT_ONCE", at_once, raising=False)
    lists, subs = [], []
    for g, (n_lists, n_records) in enumerate([(1, 5), (2, 4), (3, 12), (2, 30), (5, 20), (1, 1)]):
        for n in range(n_lists):
            lists += [(f"{g}-{n}", f"{g}-{i:02}", rng.random() < 0.3, rng.choice([None, False, True])) for i in range(n_records) if rng.random() < 0.5 or i == n or i == n + 1 < n_records]
        subs += [(sub, f"{g}-{rng.randrange(n_lists + 1)}") for sub in range(g, n_records * 9, 7)]
    said = lambda x: (x is not None, x)
    want = _in_order(subs, [(name, i, o, said(r)) for name, i, o, r in lists])
    assert _assigned(spark, subs, lists) == want


def test_lists_too_long_for_a_task_take_few_rounds(spark, monkeypatch):
    """Two lists of the same records, of which the first ones differ: a round settles 128 submissions or more."""
    rng = random.Random(3)
    lists = [(c, f"{i:05}", i % 4 // 2 > 0, (i % 2 > 0) != (c == "a")) for c in "ab" for i in range(300)]
    subs = [(i, rng.choice("aab")) for i in rng.sample(range(2700), 333)]
    monkeypatch.setattr(assignment, "AT_ONCE", 600, raising=False)
    steps = []
    monkeypatch.setattr(assignment, "written", lambda df, name, f=assignment.written: steps.append(name) or f(df, name))
    assert _assigned(spark, subs, lists) == _in_order(subs, lists)
    assert 1 <= steps.count("told") <= 3


def test_ten_copies_of_parts_take_few_rounds_and_pairs(spark, monkeypatch, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    n = part.count() + part.count() % 2
    copies = part.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * n).drop("copy")
    copies.write.parquet(f"{tmp_path}/part.parquet")
    subs, reg = joins._entities(spark, str(tmp_path))
    made = []
    monkeypatch.setattr(assignment, "written", lambda df, name, f=assignment.written: made.append((name, out := f(df, name))) or out)
    whom, lists = assignment.candidates(subs, reg, assignment.composites(subs, reg))
    got = assignment.assigned(whom, lists)
    assert sum(name == "told" for name, _ in made) <= 10
    assert lists.count() + sum(df.count() for name, df in made if name in ("met", "pairs")) < 20 * got.count()
    pairs = {(r["list"], r["id"], r["other"], r["renamed"]) for r in lists.collect()}
    assert sorted(map(tuple, got.collect())) == _in_order([tuple(r) for r in whom.select("sub_id", "list").collect()], pairs)
