"""Components and replays against plain Python, on random batches and on chains."""

from __future__ import annotations

import random

import pytest

from rollbook.operators import components, identity, replay

ACCOUNTS = "id string, account string"
ROWS = "ord long, in_id string, account string"


def _roots(links):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_plain_search(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    got = components.components(spark.createDataFrame([*links, (None, 1), (5, 5), *links[:9]], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == _roots([x for x in links if x[0] != x[1]])


def test_components_of_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch, shuffled):
    names = list(range(10_000))
    if shuffled:
        random.Random(3).shuffle(names)
    tables = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: tables.append(name) or f(df, name))
    got = components.components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert [tuple(r) for r in got.groupBy("root").count().collect()] == [(0, 10_000)]
    assert tables.count("grandparents") <= 20


def test_three_rows_of_one_account_are_one_entity(spark):
    existing = spark.createDataFrame([("r", "held")], ACCOUNTS)
    rows = [("n1", "x"), ("n2", "x"), ("n2", "y"), ("n3", "y"), ("n4", "z"), ("n5", None), ("n6", "held"), ("n7", "held")]
    incoming = spark.createDataFrame(rows, "in_id string, account string")
    out = components.batch_entities(incoming, identity.resolve(existing, incoming))
    assert {r["in_id"]: (r["status"], r["entity"]) for r in out.collect()} == {"n1": ("new", "n1"), "n2": ("new", "n1"), "n3": ("new", "n1"), "n4": ("new", "n4"), "n5": ("new", "n5"), "n6": ("matched", "r"), "n7": ("matched", "r")}


def test_entities_by_name_keep_shared_accounts_apart(spark):
    incoming = spark.createDataFrame([("n1", "x", "ann"), ("n2", "x", "bob"), ("n3", "x", "ann")], "in_id string, account string, name_key string")
    existing = spark.createDataFrame([], "id string, account string, name_key string")
    out = components.batch_entities(incoming, identity.resolve(existing, incoming, identity.Policy(require_name=True)), by=("account", "name_key"))
    assert {r["in_id"]: r["entity"] for r in out.collect()} == {"n1": "n1", "n2": "n2", "n3": "n1"}


def _in_order(existing, rows):
    """rows: (ord, in_id, accounts), each met with what is there."""
    held, ids, out = {}, {i for i, _ in existing}, {}
    for i, a in existing:
        held.setdefault(a, set()).add(i)
    for place, in_id, accounts in sorted(rows):
        found = set().union(*(held.get(a, set()) for a in accounts))
        if in_id in ids:
            out[place] = (in_id, "own")
        elif len(found) > 1:
            out[place] = (None, "ambiguous")
            continue
        else:
            out[place] = (found.pop(), "matched") if found else (in_id, "new")
        ids.add(out[place][0])
        for a in accounts:
            held.setdefault(a, set()).add(out[place][0])
    return out


def _replay(spark, existing, rows):
    flat = [(o, i, a) for o, i, accounts in rows for a in (accounts or [None])]
    out = replay.replayed(spark.createDataFrame(existing, ACCOUNTS), spark.createDataFrame(flat, ROWS))
    return {r["ord"]: (r["target"], r["status"]) for r in out.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_a_batch_in_its_order(spark, seed):
    rng = random.Random(seed)
    n, accounts = (60, 40) if seed < 2 else (120, 200)
    existing = [(f"r{rng.randrange(15)}", f"a{rng.randrange(accounts)}") for _ in range(20)]
    rows = [(k, rng.choice([f"n{k}", f"n{k}", f"n{max(0, k - 3)}", f"r{rng.randrange(20)}"]), [f"a{rng.randrange(accounts)}" for _ in range(rng.randrange(4))]) for k in range(n)]
    assert _replay(spark, existing, rows) == _in_order(existing, rows)


def test_a_long_chain_and_a_crowded_account(spark):
    rows = [(k, f"n{k:03}", [f"c{k}", f"c{k + 1}"]) for k in range(200)] + [(200 + k, f"m{k:03}", ["hot"]) for k in range(200)]
    assert _replay(spark, [("r", "c0")], rows) == _in_order([("r", "c0")], rows)


def test_a_batch_without_rows(spark):
    assert _replay(spark, [("r", "a")], []) == {}


def _by_name(existing, rows):
    """existing: id, stub, accounts, names, listed; rows: ord, in_id, account, names, active. Stubs are called stub:in_id."""
    merged = {e[0]: set(e[3]) for e in existing}
    channels = {}
    for i, _, accounts, _, _ in existing:
        for a in accounts:
            channels.setdefault(a, set()).add(i)
    out, retired = set(), {}
    for place, in_id, account, names, active in sorted(rows):
        stub = f"stub:{in_id}"
        before = {e[0] for e in existing if in_id in e[4] and e[0] in merged}
        fits = {i for i in channels.get(account, set()) if not i.startswith("stub:") and merged[i] & set(names)} if account else set()
        targets, status = before, "listed"
        if len(fits) == 1 and before <= fits | {stub}:
            targets, status = fits, "matched"
            for i in before - fits:
                merged.pop(i)
                retired[place] = i
        if not targets:
            if not active:
                out.add((place, None, "inactive", None))
                continue
            new = f"c:{account}" if account and not channels.get(account) else stub
            targets, status = {new}, "new"
            merged[new] = set()
            if account:
                channels.setdefault(account, set()).add(new)
        for i in targets:
            merged[i] |= set(names)
            out.add((place, i, status, retired.get(place)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_directory_in_its_order(spark, seed):
    rng = random.Random(10 + seed)
    some = lambda kind, n, most: sorted({f"{kind}{rng.randrange(n)}" for _ in range(rng.randrange(most))})
    existing = [(f"r{k}", False, some("a", 12, 3), some("k", 6, 4), [f"d{rng.randrange(40)}"] if k % 4 == 0 else []) for k in range(14)]
    existing += [(f"stub:d{k}", True, some("a", 12, 2), some("k", 6, 3), [f"d{k}"]) for k in range(0, 40, 7)]
    rows = [(k, f"d{k}", f"a{rng.randrange(12)}" if k % 6 else None, some("k", 6, 3), rng.random() < 0.8) for k in range(40)]
    e = spark.createDataFrame(existing, "id string, stub boolean, accounts array<string>, names array<string>, listed array<string>")
    r = spark.createDataFrame([(o, i, f"stub:{i}", a, a and f"c:{a}", n, act) for o, i, a, n, act in rows], "ord long, in_id string, stub_id string, account string, account_id string, names array<string>, active boolean")
    out = replay.replayed_by_name(e, r)
    want = _by_name(existing, rows)
    assert {(x["ord"], x["target"], x["status"], x["retired"]) for x in out.collect()} == want
    gone = {x[3] for x in want if x[3]}
    assert {x["id"] for x in replay.without_retired(e, out, "id").collect()} == {x[0] for x in existing} - gone
