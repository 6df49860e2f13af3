"""Steps whose inputs grow: nothing that grows with them goes through the driver, and copies cost no more than their rows."""

from __future__ import annotations

import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from rollbook.functions import urls
from rollbook.operators import assignment, identity, replay, search, statistics
from rollbook.plans import records as record_plans
from rollbook.streaming import cooldown


def rows(df):
    return sorted(map(tuple, df.collect()))


def kept(df, tmp_path, name):
    """df in a file: small, as copies are, whatever its rows come to."""
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def broadcasts(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_search_sends_no_keys_to_the_driver(spark, tmp_path):
    keys = kept(spark.range(2000).selectExpr("id", "0 AS place", "element_at(array('abcd', 'xabcy', 'zz', 'abc'), int(id % 4) + 1) AS key"), tmp_path, "keys")
    queries = kept(spark.createDataFrame([("abc",), ("z",), ("nope",)], "q string"), tmp_path, "queries")
    hits = search.search(queries, keys)
    assert broadcasts(hits) == 0
    assert rows(hits.groupBy("q", "type").count()) == [("abc", 0, 500), ("abc", 2, 1000), ("z", 2, 500)]


def test_collisions_send_no_keys_to_the_driver(spark, tmp_path):
    keys = kept(spark.range(2000).selectExpr("id % 1500 AS id", "0 AS place", "element_at(array('a', 'b'), int(id % 2) + 1) AS key"), tmp_path, "keys")
    met = search.collisions(kept(spark.createDataFrame([("a",), ("c",), (None,), ("a",)], "q string"), tmp_path, "queries"), keys)
    assert broadcasts(met) == 0
    assert sorted(map(tuple, met.collect()), key=str) == [("a", 750), ("c", 0), (None, 0)]


def _submissions(spark, tmp_path, seed=5):
    """Records and submissions with several accounts and names, of which some are null and many are shared."""
    r = random.Random(seed)
    some = lambda kind, n: r.choice([None, *(f"{kind}{i}" for i in range(n))])
    records = [(r.randrange(40), some("n", 9), some("a", 9)) for _ in range(90)]
    submissions = [(i, r.choice([None, r.randrange(60)]), some("n", 12), some("a", 12), i % 4 == 1, i * 7 % 11) for i in (r.randrange(50) for _ in range(80))]
    means = lambda s, t: s[1] == t[0] or (s[2] is not None and s[2] == t[1] and not s[4]) or (s[3] is not None and s[3] == t[2])
    pairs = {(s[0], t[0]) for s in submissions for t in records if means(s, t)}
    a = kept(spark.createDataFrame(records, "id long, name_key string, account string"), tmp_path, "records")
    b = kept(spark.createDataFrame(submissions, "sub_id int, ref_id int, name_key string, account string, by_id_only boolean, size int"), tmp_path, "submissions")
    return a, b, submissions, pairs


def test_submissions_meet_once_and_not_through_the_driver(spark, tmp_path):
    records, submissions, _, pairs = _submissions(spark, tmp_path)
    met = identity.matched_submissions(records, submissions)
    assert broadcasts(met) == 0 and rows(met) == sorted(pairs)


def test_greatest_said_makes_no_pairs(spark, tmp_path):
    records, submissions, said, pairs = _submissions(spark, tmp_path)
    size = {s[0]: s[5] for s in said}
    want = {}
    for s, t in pairs:
        want[t] = max(want.get(t, 0), size[s])
    greatest = identity.greatest_said(records, submissions, "size")
    assert broadcasts(greatest) == 0 and dict(rows(greatest)) == want
    none = identity.meaning_none(records, submissions)
    assert broadcasts(none) == 0 and {s for (s,) in rows(none)} == set(size) - {s for s, _ in pairs}


def test_equal_rows_of_slices_are_one(spark, tmp_path):
    df = spark.range(400).selectExpr("id", "element_at(array('ab cd', 'Ab cd', 'xyz'), int(id % 3) + 1) AS own", "replace(element_at(array('ab cd', 'Ab cd', 'xyz'), int(id % 3) + 1), ' ', '') AS name", "id % 5 AS size", "concat('b', id % 2) AS brand")
    labels = statistics.statistic_labels(F.col("name"), F.col("size") != 2, F.lit("none"), F.col("brand"))
    counted = lambda like: statistics.sliced(kept(df, tmp_path, f"rows{like is None}"), F.array(F.lit("all"), F.col("brand")), labels, "id", "own", like=like)
    key = lambda df: sorted(map(str, df.collect()))
    once = counted(("name", "size", "brand"))
    assert key(once) == key(counted(None)) and once.where("statistic = 'total' AND slice = 'all'").first()["n"] == 400


def test_accounts_of_records_are_found_once(spark, tmp_path):
    shape = "id long, platform_accounts array<string>, twitter_url string, twitch_url string, source_url string, broadcast_url string, youtube_url string, twitch_login string, youtube_handle string, youtube_channel_id string"
    records = kept(spark.createDataFrame([(1, ["https://x.com/a", "https://twitter.com/A"], *[None] * 8), (None, ["https://x.com/b"], *[None] * 8)], shape), tmp_path, "records")
    found = urls.record_accounts(records, "id", urls.rule_table(spark))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert rows(found.select("id", "platform", "account_id", "paired")) == [(1, "x", "a", False)]


def unsent(monkeypatch, module):
    """Lets a module's steps be written, and gives the names of those whose plan broadcasts a side of a join."""
    sent, write = [], module.written

    def look(df, name):
        if "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString():
            sent.append(name)
        return write(df, name)

    monkeypatch.setattr(module, "written", look)
    return sent


def test_rounds_of_a_replay_send_nothing_to_the_driver(spark, tmp_path, monkeypatch):
    sent = unsent(monkeypatch, replay)
    shape = "ord long, in_id string, stub_id string, account string, account_id string, names array<string>, active boolean"
    existing = kept(spark.createDataFrame([("r1", False, ["a"], ["n"], ["4"]), ("stub:2", True, ["a"], ["n"], ["2"])], "id string, stub boolean, accounts array<string>, names array<string>, listed array<string>"), tmp_path, "existing")
    incoming = kept(spark.createDataFrame([(2, "2", "stub:2", "a", "c:a", ["n"], True), (3, "3", "stub:3", "b", "c:b", ["m"], True), (4, "4", "stub:4", "b", "c:b", ["k"], True), (5, "5", "stub:5", "b", "c:b", ["m"], False)], shape), tmp_path, "incoming")
    out = replay.replayed_by_name(existing, incoming)
    assert sent == [] and broadcasts(out) == 0
    assert rows(out.drop("retired")) == [(2, "2", "r1", "matched"), (3, "3", "c:b", "new"), (4, "4", "r1", "listed"), (5, "5", "c:b", "matched")]
    left = replay.without_retired(existing.select("id", "stub"), out, "id")
    assert broadcasts(left) == 0 and rows(left) == [("r1", False)]


class _State:
    """State of one host, as a processor sees it; counts how often it is asked or told."""

    def __init__(self):
        self.rows, self.calls, self.timers = {}, 0, set()

    def of(self, name):
        def said(act):
            def run(*args):
                self.calls += 1
                return act(*args)

            return run

        put = lambda v: self.rows.__setitem__(name, [v])
        add = lambda vs: self.rows.setdefault(name, []).extend(vs)
        one = lambda: self.rows[name][0]
        get = one if name == "until" else lambda: iter(self.rows.get(name, []))
        acts = {"exists": lambda: name in self.rows, "get": get, "update": put, "appendValue": lambda v: add([v]), "appendList": add, "clear": lambda: self.rows.pop(name, None)}
        return SimpleNamespace(**{k: said(f) for k, f in acts.items()})

    def handle(self):
        return SimpleNamespace(getValueState=lambda n, _: self.of(n), getListState=lambda n, _: self.of(n), listTimers=lambda: list(self.timers), deleteTimer=self.timers.discard, registerTimer=self.timers.add)


@pytest.mark.parametrize("start", [0, -10_000_000])
def test_state_of_a_host_is_asked_for_batches_and_not_for_rows(start):
    r = random.Random(3)
    state, host = _State(), cooldown._Host()
    host.init(state.handle())
    got, end, waiting, want = [], None, [], []
    for batch in range(6):
        rows = [(start + batch * 5_000_000 + r.randrange(5_000_000), batch * 300 + i, r.random() < 0.05) for i in range(300)]
        rows = [{"at": at, "lead": lead, "until": at + r.randrange(1, 900_000) if refused else None} for at, lead, refused in rows]
        before = state.calls
        got += map(tuple, host.handleInputRows(("h",), iter(rows), None))
        assert state.calls - before < 20
        for x in sorted(rows, key=lambda x: (x["at"], x["until"] is None, x["lead"])):
            if end is not None and x["at"] >= end:
                want += [(lead, "h", "released", end) for lead in waiting]
                end, waiting = None, []
            if x["until"] is not None:
                end = max(x["until"], x["until"] if end is None else end)
            elif end is not None:
                waiting.append(x["lead"])
                want.append((x["lead"], "h", "deferred", x["at"]))
            else:
                want.append((x["lead"], "h", "passed", x["at"]))
        assert state.timers == (set() if end is None else {-(-end // 1000)})
    assert got == want and {state for _, _, state, _ in got} == {"passed", "deferred", "released"}
    assert [lead for (lead,) in state.rows.get("waiting", [])] == waiting


@pytest.mark.parametrize("policy", [identity.Policy("all"), identity.Policy("all", require_name=True, guard=True), identity.Policy("all", named_need_name=True, own_id_first=True, allow_new=False)])
def test_pairs_of_the_policy_all_are_not_made_distinct(spark, tmp_path, policy):
    r = random.Random(9)
    some = lambda kind: r.choice([None, *(f"{kind}{i}" for i in range(6))])
    records = [(r.randrange(0, 60, 2), some("a"), some("n")) for _ in range(60)]
    batch = [(r.randrange(60), some("a"), some("n")) for _ in range(60)]
    named = lambda i: policy.require_name or (policy.named_need_name and i % 4 == 0)
    same = lambda s, t: s[1] is not None and s[1] == t[1] and (not named(t[0]) or (s[2] is not None and s[2] == t[2]))
    want, ids = set(), {t[0] for t in records}
    for i in {s[0] for s in batch}:
        mine = [s for s in batch if s[0] == i]
        met = {i} if policy.own_id_first and i in ids else {t[0] for s in mine for t in records if same(s, t)}
        shared = policy.guard and any(s[1] is not None and s[1] == t[1] for s in mine for t in records)
        want |= {(i, t, "matched") for t in met} or {(i, None, "guarded" if shared else "new" if policy.allow_new else "unmatched")}
    existing = kept(spark.createDataFrame(records, "id long, account string, name_key string").withColumn("named", F.col("id") % 4 == 0), tmp_path, "existing")
    out = identity.resolve(existing, kept(spark.createDataFrame(batch, "in_id long, account string, name_key string"), tmp_path, "incoming"), policy)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert broadcasts(out) == 0
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # nothing is done with pairs


def test_channels_are_taken_in_their_order_at_once(spark, tmp_path, monkeypatch):
    r = random.Random(7)
    data = [(i + 1000, i, [f"c{r.randrange(3)}"] if r.random() < 0.9 else ["c0", "c1"], [r.choice(["", None, *(f"k{n}" for n in range(i // 4, i // 4 + 6))]) for _ in range(2)], r.random() < 0.1, r.random() < 0.1) for i in range(160)]
    held, want = {}, []
    for i, _, channels, keys, fixed, protected in data:
        mine = [] if protected or len(channels) > 1 else [held.setdefault((channels[0], k), set()) for k in keys if k]
        met = set().union(*mine)
        want.append((i, met.pop() if len(met) == 1 and not fixed else i))
        for owners in mine:
            owners.add(want[-1][1])
    df = kept(spark.createDataFrame(data, "id long, ord long, channels array<string>, keys array<string>, fixed boolean, protected boolean").repartition(3), tmp_path, "rows")
    names, write = [], identity.written
    monkeypatch.setattr(identity, "written", lambda df, name: names.append(name) or write(df, name))
    assert rows(identity.one_candidate(df)) == want
    assert names.count("owners") == 1
    monkeypatch.setattr(identity, "AT_ONCE", 60, raising=False)  # some in rounds
    sent = unsent(monkeypatch, identity)
    assert rows(identity.one_candidate(df)) == want
    assert len(sent) <= 2  # by the names of crowded channels only


def test_merged_records_send_nothing_to_the_driver(spark, tmp_path):
    records = kept(spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"]), (3, "a", [])], "id long, name string, aliases array<string>"), tmp_path, "records")
    found = kept(spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, kept_id long"), tmp_path, "found")
    out = identity.merged_duplicates(records, found, "id", "name", "aliases")
    assert broadcasts(out) == 0
    assert rows(out) == [(1, "a", ["x", "y", "b"]), (3, "a", [])]


@pytest.mark.parametrize("at_once", [50_000, 60])
def test_merged_parts_send_only_names_of_crowded_channels_to_the_driver(spark, tmp_path, monkeypatch, at_once):
    names = "element_at(array('Red bolt', 'red-bolt', 'blue ring', 'old nut', 'new nut', ''), int(id * 7 % 13 % 6) + 1)"
    types = "element_at(array('SMALL', 'large', 'Large', 'blue ring'), int(id * 5 % 17 % 4) + 1)"
    kept(spark.range(300).selectExpr("id AS p_partkey", f"{names} AS p_name", "concat('B', if(id % 9 = 0, id % 2, 2)) AS p_brand", f"{types} AS p_type", "int(id % 2) AS p_size"), tmp_path, "part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    monkeypatch.setattr(identity, "AT_ONCE", at_once, raising=False)
    sent = unsent(monkeypatch, identity)
    out = record_plans.d9_merged_records(spark, str(tmp_path))
    assert len(sent) <= 2  # rows of one kind and of the other, by the names of crowded channels
    assert broadcasts(out) == 0
    assert rows(out) == sorted(duck.execute(record_plans.ORACLES["d9_merged_records"]).fetchall())


def test_candidates_send_nothing_to_the_driver(spark, tmp_path, monkeypatch):
    sent = unsent(monkeypatch, assignment)
    subs = kept(spark.createDataFrame([(1, "abcd", ["abcd"], ["x"]), (3, "abcd", ["abcd"], ["x"]), (5, "wxyz", ["wxyz"], ["y"])], "sub_id long, name_key string, keys array<string>, accounts array<string>"), tmp_path, "subs")
    reg = kept(spark.createDataFrame([(2, "abcd", ["abcd"], ["x"], True), (4, "theabcd", ["theabcd"], ["x"], True), (6, "wxyzq", ["wxyzq"], ["y"], True)], "id long, name_key string, keys array<string>, accounts array<string>, ours boolean"), tmp_path, "reg")
    lists, content = assignment.candidates(subs, reg)
    assert sent == [] and broadcasts(lists) == broadcasts(content) == 0
    assert rows(lists) == [(1, 1), (3, 1), (5, 5)] and rows(content.select("list", "id")) == [(1, 2), (5, 6)]
