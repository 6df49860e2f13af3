"""Operators on small tables whose results are known."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollbook.functions import text as t
from rollbook.functions import urls as u
from rollbook.operators import assignment, gates, identity, ordering, overlay, replies, screening, search, statistics
from rollbook.sources import files


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column("x")).first()[0]


@pytest.mark.parametrize(
    ("value", "key"), [("Ａｂ カナ!", "abかな"), ("Straße 9", "straße9"), (None, ""), ("", ""), ("星 月", "星月"), ("𠮷野", "𠮷野")]
)
def test_search_key(spark, value, key):
    assert one(spark, value, t.search_key) == key


def test_match_key_keeps_kana_apart(spark):
    assert one(spark, "カナかな", t.match_key) == "カナかな"


def test_casefold_and_space_key(spark):
    assert one(spark, "STRASSE", t.casefold) == one(spark, "straße", t.casefold)
    assert one(spark, " A　b\t", t.space_key) == "ab"


@pytest.mark.parametrize(("value", "reading"), [("ネコ・カフェ", "ねこかふぇ"), ("ねこ", "ねこ"), ("猫", ""), ("abc", ""), (None, ""), ("", "")])
def test_kana_reading(spark, value, reading):
    assert one(spark, value, t.kana_reading) == reading


@pytest.mark.parametrize(("value", "is_so"), [("VTuber準備中", True), ("デビュー準備中", True), ("再デビュー準備中", False), ("配信の機材準備中", False), ("pre-debut", True), (None, False)])
def test_preparing(spark, value, is_so):
    assert one(spark, value, t.preparing) is is_so


@pytest.mark.parametrize(("value", "date"), [("2024-02-30", None), ("2024-02-29", "2024-02-29"), ("March 5, 2023", "2023-03-05"), ("2023年3月5日", "2023-03-05"), ("soon", None), (None, None)])
def test_iso_date(spark, value, date):
    assert one(spark, value, lambda c: t.iso_date(c).cast("string")) == date


def test_numbers_and_slugs(spark):
    assert one(spark, "1,234", t.number) == 1234 and one(spark, "n/a", t.number) is None
    assert one(spark, " A b--c! ", t.slug) == "a-b-c"


@pytest.mark.parametrize(
    ("url", "account"),
    [
        ("https://www.youtube.com/@Some.Name?x=1", ("youtube", "@some.name")), ("https://twitter.com/Name", ("x", "name")), ("https://x.com/search", (None, None)), ("https://user@x.com/a", (None, None)),
        ("https://twitch.tv/directory", (None, None)), ("https://x.com.evil.example/a", (None, None)), (None, (None, None)), ("http://space.bilibili.com/12/", ("bilibili", "12")),
    ],
)
def test_accounts(spark, url, account):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(u.with_account(df, "url", u.rule_table(spark)).select("platform", "account_id").first()) == account


def test_overlay_and_patch(spark):
    a = spark.createDataFrame([("1", "a", None), ("2", "b", "x")], "id string, name string, extra string")
    b = spark.createDataFrame([("1", "A"), ("3", "c")], "id string, name string")
    assert rows(overlay.latest_fields([a, b], "id")) == [("1", "A", None), ("2", "b", "x"), ("3", "c", None)]
    p = spark.createDataFrame([("2", ""), ("9", "z")], "id string, name string")
    assert rows(overlay.patched(a, p, "id", keep_if_blank=("name",)).select("id", "name")) == [("1", "a"), ("2", "b")]
    assert overlay.latest_fields([a.limit(0), b.limit(0)], "id").count() == 0


def test_superseding_twice_is_once(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    new = spark.createDataFrame([("2", "B"), ("3", "c")], "id string, name string")
    gone = spark.createDataFrame([("1",)], "id string")
    once = overlay.superseding(base, new, gone, "id")
    twice = overlay.superseding(once, new, gone, "id")
    assert rows(once) == rows(twice) == [("2", "B"), ("3", "c")]


def test_three_way_merge(spark):
    kind = "id string, name string, tags array<string>"
    base = spark.createDataFrame([("a", "Old", ["t"]), ("gone", "x", [])], kind)
    collected = spark.createDataFrame([("a", "Old", ["t", "new"]), ("b", "B", []), ("gone", "y", [])], kind)
    current = spark.createDataFrame([("a", "Corrected", ["t"]), ("c", "C", [])], kind)
    assert rows(overlay.three_way(base, collected, current, "id", ("tags",)), "id") == [("a", "Corrected", ["t", "new"]), ("b", "B", []), ("c", "C", [])]


def test_resolution_policies(spark):
    existing = spark.createDataFrame([("r1", "x:a", "ann"), ("r2", "x:a", "bob"), ("r3", "x:c", "cat")], "id string, account string, name_key string")
    incoming = spark.createDataFrame([(1, "x:a", "ann"), (2, "x:c", "dog"), (3, "x:z", "new"), (4, None, "cat")], "in_id int, account string, name_key string")
    p = identity.Policy
    assert rows(identity.resolve(existing, incoming, p())) == [(1, None, "ambiguous"), (2, "r3", "matched"), (3, None, "new"), (4, None, "new")]
    assert rows(identity.resolve(existing, incoming, p("skip", require_name=True, allow_new=False))) == [(1, "r1", "matched"), (2, None, "unmatched"), (3, None, "unmatched"), (4, None, "unmatched")]
    assert [r[1] for r in rows(identity.resolve(existing, incoming, p("all"))) if r[0] == 1] == ["r1", "r2"]


def test_consolidation(spark):
    df = spark.createDataFrame([("b", 2, "ch", "k", False), ("a", 1, "ch", "k", False), ("c", 3, "ch", "other", False), ("d", 4, "ch", "k", True), ("e", 5, None, "k", False)], "id string, ord int, channel string, name_key string, protected boolean")
    assert rows(identity.consolidated(df).select("id", "kept_id")) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e")]


def test_search_types(spark):
    keys = spark.createDataFrame([("1", 0, "abcd"), ("1", 1, "zz"), ("2", 0, "xabcy"), ("3", 1, "abc")], "id string, place int, key string")
    queries = spark.createDataFrame([("abc",), ("abcd",), ("z",), ("",), ("nope",)], "q string")
    assert rows(search.search(queries, keys)) == [("abc", "1", 2), ("abc", "2", 2), ("abc", "3", 1), ("abcd", "1", 0), ("z", "1", 2)]


def test_statistics(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["星星星", "星月", "Ａ Ｂ", "𠮷野", "ねこカフェ", "123"])], "id int, name string").withColumn("n", statistics.squeezed("name"))
    got = dict(rows(statistics.presence(names, statistics.ngrams(F.col("n"), 1, r"\p{IsHan}"))))
    assert got["星"] == 2 and got["𠮷"] == 1
    assert dict(rows(statistics.presence(names, statistics.ngrams(F.col("n"), 2, r"\p{IsHan}"))))["星星"] == 1
    assert [r[0] for r in names.select(statistics.script(F.col("n"))).collect()] == ["han", "han", "other", "han", "mixed", "other"]
    assert names.agg(F.round(F.sum(F.char_length("n")) / F.count("*"), 1)).first()[0] == 2.8


def test_contract_and_cascade(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "x int, y string")
    assert rows(screening.split_by_contract(df, {"x": F.col("x") > 0, "y": F.col("y") == "a"}).select("ok"), "ok") == [(False,), (True,)]
    assert [r[0] for r in df.select(screening.cascade([("big", F.col("x") > 5), ("a", F.col("y") == "a")], "none")).collect()] == ["a", "none"]


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert gates.unique(df, "x").first()["ok"] is False
    assert gates.unique(df.distinct(), "x").first()["ok"] is True
    with pytest.raises(Exception, match="gate failed"):
        gates.enforced(gates.unique(df, "x")).collect()
    with pytest.raises(ValueError, match="repeated"):
        files.load_layer(df, "x")


def test_streaks_and_rotation(spark):
    log = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, False)], "run int, grew boolean")
    assert [r["streak"] for r in ordering.streaks(log, "run", "grew").orderBy("run").collect()] == [0, 1, 2, 0, 1]
    places = spark.range(5).withColumnRenamed("id", "place")
    assert [r[0] for r in rows(ordering.rotated(places, "place", 4, 3, 5))] == [0, 1, 4]


def test_cut_off_arrays(spark):
    cases = {
        '{"names": ["a", {"b": 1}, "c': ['"a"', '{"b": 1}'], '{"names": [1, 23': ["1"], None: [], "prose": [], 'see [1] {"names": ["a", "b", "c': ['"a"', '"b"'], '{"other": ["x"], "suggestions" : [ "q\\"," , [1, "]"], tru': ['"q\\","', '[1, "]"]'],
        '{"candidates": [bad, "a", {"x": }, "b"], "names": ["z"]}': ['"a"', '"b"'], '{"names": []': [], '{"names": [1, 2]}': ["1"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert [list(r[0]) for r in df.select(replies.closed_items("x")).collect()] == list(cases.values())


def test_stopping_reasons_in_order(spark):
    c = ordering.Campaign(target=100, budget=50, patience=3, terminal=("cancelled", "query_budget_reached"))
    cases = [((False, 200, "x", 99, True, 9), "disabled"), ((True, 100, "cancelled", 99, True, 9), "target_reached"), ((True, 1, "cancelled", 99, True, 9), "cancelled"), ((True, 1, "query_budget_reached", 50, True, 9), "query_budget_reached"), ((True, 1, "query_budget_reached", 1, True, 9), "deadline_reached"), ((True, 1, "x", 1, False, 3), "paused_no_growth"), ((True, 1, None, 1, None, 2), None)]
    df = spark.createDataFrame([v for v, _ in cases], "enabled boolean, done int, status string, spent int, late boolean, streak int").coalesce(1)
    got = df.select(ordering.stopping_reason(c, *(F.col(x) for x in df.columns)).alias("r")).collect()
    assert [r["r"] for r in got] == [why for _, why in cases]


def test_places_of_a_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.hash("id").alias("k"), "id")
    got = rows(ordering.places(df, "g", ["k", "id"], n_buckets=8).select("g", "id", "place"))
    want = {}
    for g, k, i in sorted(map(tuple, df.collect())):
        want.setdefault(g, []).append(i)
    assert got == sorted((g, i, n + 1) for g, ids in want.items() for n, i in enumerate(ids))
    assert ordering.places(df.limit(0), "g", ["k", "id"]).count() == 0


def test_catalogues_see_order_and_resume(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x"), ("c", 1, "x")], "name string, place int, query string")
    ids = {r["name"]: r["catalogue"] for r in ordering.catalogues(df).collect()}
    assert len(set(ids.values())) == 3
    own = ordering.catalogues(df.where("name = 'a'"))
    old = ordering.catalogues(df.where("name = 'c'").withColumn("name", F.lit("a")))
    cursors = spark.createDataFrame([(ids["c"], 5)], "catalogue string, cursor long")
    assert rows(ordering.resumed(own, old, cursors).select("cursor", "migrated_from")) == [(0, ids["c"])]
    assert rows(ordering.resumed(own, old, cursors.limit(0)).select("cursor", "migrated_from")) == [(0, None)]


def test_circuit_breaker_stops_later_batches(spark):
    df = spark.createDataFrame([(1, 2, 2), (2, 3, 4), (3, 0, 9)], "batch int, failed int, n int")
    assert rows(gates.circuit_breaker(df, "batch", "failed", "n").select("batch", "stop", "ran")) == [(1, False, True), (2, True, True), (3, False, False)]


def test_overwrite_only_if_changed(spark):
    path = files.scratch(spark, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert files.overwrite_if_changed(df, path) and not files.overwrite_if_changed(df.orderBy(F.desc("x")), path)
    assert files.overwrite_if_changed(df.limit(1), path) and spark.read.parquet(path).count() == 1


UUID = "729e55d8-4775-4560-b549-ffa3d9dbd881"
CHANNEL = "UC" + "a1B-_" * 4 + "xy"


@pytest.mark.parametrize(
    ("url", "account", "link"),
    [
        ("https://www.mirrativ.com/user/151711048", ("mirrativ", "151711048"), "https://mirrativ.com/user/151711048"), ("https://mirrativ.page.link/?link=https%3A%2F%2Fwww.mirrativ.com%2Fuser%2F151711048", ("mirrativ", "151711048"), "https://mirrativ.com/user/151711048"),
        ("https://mirrativ.page.link/?link=https://evil.example/user/151711048", (None, None), None), (f"https://web.colorsing.com/share/user?user_id={UUID}&utm_source=test", ("colorsing", UUID), f"https://web.colorsing.com/share/user?user_id={UUID}"),
        ("https://whowatch.tv/profile/w%3Abokukun2323", ("whowatch", "w:bokukun2323"), "https://whowatch.tv/profile/w:bokukun2323"), ("https://app.palmu.jp/users/a7413a8b12624c308fa8", ("palmu", "a7413a8b12624c308fa8"), "https://app.palmu.jp/users/a7413a8b12624c308fa8"),
        ("https://sp.nicovideo.jp/user/77/", ("niconico", "77"), "https://www.nicovideo.jp/user/77"), ("https://web.iriam.app/s/user/ABCdef?uuid=123", ("iriam", "ABCdef"), "https://web.iriam.app/s/user/ABCdef"), ("https://web.iriam.app/s/user?a=b&amp;id=Q-1", ("iriam", "Q-1"), "https://web.iriam.app/s/user?id=Q-1"),
        (f"iriam://p?applicationModel=profile&uid={UUID.upper()}", ("iriam", UUID), f"iriam://p?applicationModel=profile&uid={UUID}"), (f"iriam://p?applicationModel=other&uid={UUID}", (None, None), None), ("https://twitter.com/Example?x=1", ("x", "example"), "https://x.com/example"),
        ("https://x.com/i/user/123/", ("x", "uid:123"), "https://x.com/i/user/123"), ("https://www.tiktok.com/@EXample/live", ("tiktok", "@example"), "https://www.tiktok.com/@example"), ("https://www.spooncast.net/jp/channel/315874262/tab/home", ("spoon", "315874262"), "https://spooncast.net/jp/channel/315874262/tab/home"),
        ("javascript:alert(1)", (None, None), None), ("https://tiktok.com.evil.test/@example", (None, None), None), ("https://u:p@www.tiktok.com/@example", (None, None), None), ("https://twitch.tv:8080/name", (None, None), None), ("https://www.youtube.com/watch?v=123", (None, None), None),
        (f"https://www.youtube.com/channel/{CHANNEL}", ("youtube", f"channel/{CHANNEL}"), f"https://youtube.com/channel/{CHANNEL}"), ("https://www.youtube.com/@%E3%81%82", ("youtube", "@あ"), "https://youtube.com/@%E3%81%82"), ("", (None, None), None), ("https://x.com/%zz", (None, None), None),
    ],
)
def test_account_rules(spark, url, account, link):
    df = spark.createDataFrame([(url,)], "url string")
    assert tuple(u.with_account(df, "url", u.rule_table(spark)).select("platform", "account_id", "account_url").first()) == (*account, link)


def test_candidate_urls(spark):
    video = "dQw4w9WgXcQ"
    watch = f"https://www.youtube.com/watch?v={video}"
    cases = {f"https://youtu.be/{video}?t=1": watch, f"https://m.youtube.com/watch?a=b&v={video}": watch, f"https://www.youtube.com/live/{video}/": watch, f"https://www.youtube.com/shorts/{video}": f"https://www.youtube.com/shorts/{video}", "https://youtu.be/short": None, "https://www.youtube.com/watch?v=x": None, "http://youtu.be/" + video: None, "https://twitch.tv/Some": "https://twitch.tv/Some", "https://x.com/a": None, "https://www.instagram.com/a": None}
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "url string")
    assert {r["url"]: r["candidate"] for r in u.with_candidate(df, "url", u.rule_table(spark)).collect()} == cases | {None: None}


def test_record_accounts_and_pairs(spark):
    kind = "id string, platform_accounts array<string>, twitter_url string, twitch_login string, youtube_handle string, youtube_channel_id string"
    other = "UC" + "z" * 22
    df = spark.createDataFrame([("a", ["https://x.com/A", None], "https://twitter.com/a", "tw", "@Han.dle", CHANNEL), (f"youtube:{CHANNEL}", None, None, "not valid", "@h", None), ("c", [f"https://youtube.com/channel/{other}"], None, None, "@h", CHANNEL), ("d", None, None, None, None, None)], kind)
    out = u.record_accounts(df, "id", u.rule_table(spark), fields=("twitter_url",))
    got = {(r["id"], r["platform"], r["account_id"]): r["paired"] for r in out.collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", "x", "a"): False, ("a", "twitch", "tw"): False, ("a", "youtube", "@han.dle"): True, ("a", "youtube", f"channel/{CHANNEL}"): False}
    assert got[f"youtube:{CHANNEL}", "youtube", "@h"] is True and got["c", "youtube", "@h"] is False
    assert not any(k[0] == "d" for k in got)


@pytest.mark.parametrize(
    ("row", "reading"),
    [
        (("癒色えも", "いしきえも", "https://example.com", "manual", None, None), ("いしきえも", False)), (("ミライ アカリ", "誤り", "", "", None, None), ("みらいあかり", True)), (("山田はな", "やまだはな", "", "", None, None), ("やまだはな", True)), (("音紡いま", "音ぼういま", "", "", None, None), ("", False)),
        (("Natsumi Moe", "なつみほうめぐみ", "", "", None, None), ("", False)), (("未知名", None, None, None, None, None), ("", False)), (("花野彩晴", "はなのいろは", "https://a.example", "manual", "はなのさいせい", "花野彩晴"), ("はなのいろは", False)), (("Alice", None, None, None, "ありす", "Alice"), ("ありす", True)),
        (("Bob", None, None, None, "ありす", "Alice"), ("", False)), (("灰島リウ", None, None, None, "はいしまりゅう", "灰島リウ"), ("", False)), (("灰島リウ", "x", "https://a.example", "guess", "はいしまりう", "灰島リウ"), ("はいしまりう", True)),
    ],
)
def test_resolved_reading(spark, row, reading):
    df = spark.createDataFrame([row], "name string, reading string, source string, kind string, guess string, made_for string")
    c = F.col
    assert tuple(df.select(t.resolved_reading(c("reading"), c("source"), c("kind"), c("name"), c("guess"), c("made_for"), F.lit(True)).alias("x")).select("x.*").first()) == reading


@pytest.mark.parametrize(("value", "second"), [("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01 00:00:00", 1704067200), ("2024-01-01T09:00:00+09:00", 1704067200), ("2024-01-01T09:00+0900", 1704067200), ("2024-01-01", None), ("2024-13-01T00:00:00Z", None), ("soon", None), (None, None)])
def test_iso_timestamps(spark, value, second):
    assert one(spark, value, lambda c: F.unix_seconds(t.iso_timestamp(c))) == second


def test_epoch_milliseconds(spark):
    assert one(spark, "1704067200000", lambda c: F.unix_seconds(t.epoch_ms(c))) == 1704067200 and one(spark, "x", t.epoch_ms) is None


def test_overlay_of_lists_and_maps(spark):
    kind = "id string, accounts array<string>, sources map<string,string>"
    a = spark.createDataFrame([("1", ["a", "b"], {"x": "1", "y": "2"}), ("2", None, None)], kind)
    b = spark.createDataFrame([("1", ["b"], {"x": "9", "z": "3"})], kind)
    got = {r["id"]: (r["accounts"], r["sources"]) for r in overlay.latest_fields([a, b], "id", joined=("accounts",), maps=("sources",)).collect()}
    assert got == {"1": (["a", "b", "b"], {"x": "9", "y": "2", "z": "3"}), "2": ([], {})}


def test_three_way_merge_of_structs_and_lists(spark):
    kind = "id string, facts struct<a:string,b:string,deep:struct<c:string>>, tags array<string>"
    base = spark.createDataFrame([("1", ("x", "x", ("x",)), ["t", "u"]), ("2", ("x", "x", ("x",)), ["t"])], kind)
    collected = spark.createDataFrame([("1", ("new", "x", ("new",)), ["t", "v"]), ("2", ("x", "x", ("x",)), []), ("3", ("n", None, None), ["n"])], kind)
    current = spark.createDataFrame([("1", ("x", "mine", ("mine",)), ["u", "w"]), ("2", ("x", "x", ("x",)), ["t"]), ("3", ("c", None, None), ["c"])], kind)
    got = {r["id"]: (r["facts"].asDict(True), r["tags"]) for r in overlay.three_way(base, collected, current, "id", ("tags",)).collect()}
    assert got["1"] == ({"a": "new", "b": "mine", "deep": {"c": "mine"}}, ["u", "w", "v"])
    assert got["2"][1] == [] and got["3"] == ({"a": "c", "b": None, "deep": None}, ["c"])


def test_own_ids_and_guards(spark):
    existing = spark.createDataFrame([(1, "x:a", "ann"), (2, "x:c", "cat")], "id int, account string, name_key string")
    incoming = spark.createDataFrame([(2, "x:a", "ann"), (5, "x:a", "other"), (6, "x:q", "q"), (7, "x:c", "cat")], "in_id int, account string, name_key string")
    p = identity.Policy(require_name=True, own_id_first=True, guard=True)
    assert rows(identity.resolve(existing, incoming, p)) == [(2, 2, "matched"), (5, None, "guarded"), (6, None, "new"), (7, 2, "matched")]


def test_batches_are_written_once(spark):
    kind = "id int, site string, names array<string>"
    registry = spark.createDataFrame([(1, "", ["a"]), (2, "s", None)], kind)
    batch = spark.createDataFrame([(10, "first", ["b", "a"]), (11, "second", ["c"]), (12, "n", ["d"]), (13, "lost", ["e"])], "in_id int, site string, names array<string>")
    resolution = spark.createDataFrame([(10, 1, "matched"), (11, 1, "matched"), (12, None, "new"), (13, None, "ambiguous")], "in_id int, target int, status string")
    once = identity.applied(registry, batch, resolution, "id", lists=("names",))
    assert rows(once, "id") == [(1, "first", ["a", "b", "c"]), (2, "s", []), (12, "n", ["d"])]
    again = identity.applied(once, batch, resolution.withColumn("target", F.when(F.col("in_id") == 12, 12).otherwise(F.col("target"))), "id", lists=("names",))
    assert rows(again, "id") == rows(once, "id")


def _assignment(spark):
    subs = [(1, "kirin", ["kirin"], ["y:a"]), (2, "kirin", ["kirin"], ["y:b"]), (3, "solo", ["solo"], ["y:c"]), (4, "part", ["part"], ["y:d"]), (5, "abc", ["abc"], ["y:d"]), (6, "luna", ["luna", "moon"], ["y:e"]), (7, "none", ["none"], []), (8, "hana", ["hana"], ["y:f"]), (9, "leite", ["leite"], ["y:f"]), (10, "over", ["over"], [])]
    reg = [("r1", "kirin", ["kirin"], ["y:a"], True, False), ("r2", "kirin", ["kirin"], ["y:a", "y:b"], True, False), ("r3", "solo", ["solo"], [], True, False), ("r4", "thepartone", ["thepartone"], ["y:d"], True, False), ("r5", "xabcx", ["xabcx"], ["y:d"], True, False), ("r6", "moon", ["moon"], ["y:e"], False, False), ("r7", "none", ["none"], ["y:z"], True, False), ("r8", "hanaleite", ["hanaleite"], ["y:f"], True, True), ("r9", "q", ["q"], [], True, False)]
    s = spark.createDataFrame(subs, "sub_id int, name_key string, keys array<string>, accounts array<string>")
    return s, spark.createDataFrame(reg, "id string, name_key string, keys array<string>, accounts array<string>, ours boolean, joint boolean")


def test_assignment_in_stages(spark):
    subs, reg = _assignment(spark)
    joint = assignment.composites(subs, reg)
    assert rows(joint) == [("r8", 2)]
    overrides = spark.createDataFrame([(10, "r9")], "sub_id int, id string")
    # 1 takes r1, so that 2 has r2; 5 is too short to be found as a part; 7 has no account in common; 8 and 9 make up r8
    assert rows(assignment.assigned(*assignment.candidates(subs, reg, joint, overrides))) == [(1, "r1"), (2, "r2"), (3, "r3"), (4, "r4"), (6, "r6"), (10, "r9")]


def test_each_record_is_assigned_once_in_order(spark):
    subs = spark.createDataFrame([(s, 1) for s in (1, 2, 3, 4)], "sub_id int, list int")
    lists = spark.createDataFrame([(1, i, False, False) for i in "abc"], "list int, id string, other boolean, renamed boolean")
    assert rows(assignment.assigned(subs, lists)) == [(1, "a"), (2, "b"), (3, "c")]
    assert assignment.assigned(subs.limit(0), lists.limit(0)).count() == 0


def test_aliases_without_siblings(spark):
    subs, _ = _assignment(spark)
    aliases = spark.createDataFrame([(8, "Leite", "leite"), (8, "Leite 2", "leite2"), (8, "Hana", "hana"), (4, "ab", "ab"), (7, "x", "x")], "sub_id int, alias string, alias_key string")
    assert rows(assignment.without_sibling_names(aliases, subs).select("sub_id", "alias")) == [(4, "ab"), (7, "x"), (8, "Hana")]


def test_rare_runs_find_parts(spark):
    keys = spark.createDataFrame([(str(i), 0, f"common{i}x") for i in range(60)] + [("z", 1, "commonrare"), ("q", 0, "co")], "id string, place int, key string")
    got = rows(search.search(spark.createDataFrame([("common",), ("monrare",), ("n5x",), ("co",), ("zzz",)], "q string"), keys))
    assert sum(q == "common" for q, *_ in got) == 61 and [g for g in got if g[0] in ("monrare", "n5x")] == [("monrare", "z", 2), ("n5x", "5", 2)] and ("co", "q", 0) in got


@pytest.mark.parametrize("step", ["latest_fields", "patched", "consolidated", "first_wins"])
def test_steps_twice_are_once(spark, step):
    a = spark.createDataFrame([("1", "a", "x", 1), ("2", "b", None, 2), ("3", "a", "x", 3)], "id string, name string, author string, ord int")
    b = spark.createDataFrame([("2", "B", "y", 5)], "id string, name string, author string, ord int")

    def run(df):
        if step == "latest_fields":
            return overlay.latest_fields([df, b], "id")
        if step == "patched":
            return overlay.patched(df, b, "id", keep_if_blank=("name",))
        if step == "first_wins":
            return overlay.first_wins(df.unionByName(b), "id", "ord", "author").select(*a.columns)
        kept = identity.consolidated(df.select("id", "ord", F.lit("ch").alias("channel"), F.col("name").alias("name_key"), F.lit(False).alias("protected"))).where("id = kept_id")
        return df.join(kept.select("id"), "id", "left_semi")

    once = run(a).select(*a.columns)
    assert rows(run(once).select(*a.columns)) == rows(once) != rows(a)


@pytest.mark.parametrize(
    ("title", "platform", "name"),
    [("Nora - YouTube", "youtube", "Nora"), ("Nora YouTube", "youtube", "Nora"), ("Nora | Twitch", "youtube", "Nora | Twitch"), ("Nora (@no.ra) | TikTok", "tiktok", "Nora"), ("【VTuber】 <b>Nora</b>", None, "Nora"), ("ノラ - ニコニコ生放送", "niconico", "ノラ"), ("x" * 121, None, ""), (None, "kick", ""), ("- Kick", "kick", "")],
)
def test_clean_title(spark, title, platform, name):
    df = spark.createDataFrame([(title, platform)], "title string, platform string")
    assert df.select(t.clean_title("title", F.col("platform"))).first()[0] == name


def test_batches_of_readings(spark):
    names = spark.createDataFrame([("a", 0, "灰島リウ"), ("a", 1, "未知名"), ("b", 0, "ねこ山"), ("c", 0, "x"), ("d", 0, "y"), ("e", 0, "z")], "batch string, idx int, name string")
    items = spark.createDataFrame([("a", 0, "はいしま・りう"), ("a", 1, " みちな "), ("b", 0, "やまねこ"), ("c", 0, "あ"), ("c", 1, "い"), ("d", 0, "う"), ("d", 0, "う"), ("f", 0, "え")], "batch string, idx int, reading string")
    assert rows(replies.accepted_readings(names, items)) == [("a", 0, "はいしま・りう"), ("a", 1, "みちな")]


def test_person_scoped_and_risky_records(spark):
    df = spark.createDataFrame([("agency-a", "official roster", ["https://q.example/"]), ("agency-b", "none", None), ("x:1", None, ["https://www.x.com/a"]), ("x:2", None, ["https://x.com/a", "https://bad.example/"]), ("y:1", "Found On A LIST", []), (None, None, None)], "id string, evidence string, urls array<string>")
    none = F.array().cast("array<string>")
    own = screening.person_scoped(F.col("id"), F.col("evidence"), none, F.col("urls"), ("x",), ("x.com",), ("bad.example",))
    risky = screening.risky_record(F.lit(False), F.col("id"), F.col("evidence"), F.col("urls"), ("agency-b",), ("a list",), ("bad.example",))
    assert [tuple(r) for r in df.coalesce(1).select(own, risky).collect()] == [(True, False), (False, True), (True, False), (False, True), (False, True), (False, False)]


def test_links_of_a_section(spark):
    text = ["[no](u0)", "## start", "[early](u1)", "### A", "[x](u2) [y](u3)", "### B", "### C", "[z](u4)", "## end", "[late](u5)"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)] + [("open", 0, "## start"), ("open", 1, "### A")], "doc string, at int, line string")
    assert rows(screening.scoped_links(df, "doc", "at", "line", "^## start", "^## end", "^### ", r"\]\((\w+)\)")) == [("d", 3, 2), ("d", 5, 0), ("d", 6, 1)]


def test_pruned_layers(spark):
    base = spark.createDataFrame([(1, "a"), (2, "a")], "id int, kind string")
    extra = spark.createDataFrame([(2, "a"), (3, "risk"), (4, "a"), (1, "risk")], "id int, kind string")
    safe = [spark.createDataFrame([(1,)], "id int")]
    assert rows(gates.pruned(base, [extra], safe, "id", F.col("kind") == "risk")) == [(1, "a", "kept"), (1, "risk", "kept"), (2, "a", "orphaned"), (2, "a", "pruned"), (3, "risk", "risky"), (4, "a", "kept")]


def _plain_candidates(given):
    """Row by row: (id, channels, keys, fixed, protected), in order."""
    kept, owners = {}, {}
    for i, channels, keys, fixed, protected in given:
        kept[i] = i
        if protected or len(set(channels)) != 1:
            continue
        known = owners.setdefault(channels[0], {})
        found = {o for k in keys for o in known.get(k, ())}
        if len(found) == 1 and not fixed:
            kept[i] = found.pop()
        for k in keys:
            known.setdefault(k, set()).add(kept[i])
    return sorted(kept.items())


def test_one_candidate_row_by_row(spark):
    import random

    kind = "id int, ord int, channels array<string>, keys array<string>, fixed boolean, protected boolean"
    for seed in range(3):
        r = random.Random(seed)
        given = [(i, r.choices("ab", k=r.choice((1, 1, 1, 1, 2, 0))), r.choices("pqrstuvw", k=r.choice((0, 1, 2, 2, 3))), r.random() < 0.15, r.random() < 0.1) for i in range(80)]
        df = spark.createDataFrame([(i, i, c, k, f, p) for i, c, k, f, p in given], kind)
        assert rows(identity.one_candidate(df)) == _plain_candidates(given)
    assert identity.one_candidate(df.limit(0)).count() == 0


def test_merged_duplicates_keep_names_and_sources(spark):
    kind = "id string, name string, site string, aliases array<string>, profiles array<string>"
    records = spark.createDataFrame([("a", "ima", None, ["x"], ["p1"]), ("b", "ima ai", "s", ["ima", "y"], ["p2", "p1"]), ("c", "other", "t", None, None)], kind)
    kept = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, kept_id string")
    once = identity.merged_duplicates(records, kept, "id", "name", "aliases", ("profiles",))
    assert rows(once, "id") == [("a", "ima", "s", ["x", "y", "ima ai"], ["p1", "p2"]), ("c", "other", "t", [], [])]
    again = identity.merged_duplicates(once, kept.where("id = kept_id"), "id", "name", "aliases", ("profiles",))
    assert rows(again, "id") == rows(once, "id")


def test_renamed_by_name_id_or_account(spark):
    kind = "id string, name string, name_key string, reading string, inferred boolean, aliases array<string>, accounts array<string>"
    records = spark.createDataFrame([("1", "Old", "old", "", True, ["o"], []), ("2", "x", "x", "", True, [], ["x:a"]), ("3", "y", "y", "r", True, [], None), ("9", "z", "z", "", True, [], [])], kind)
    overrides = spark.createDataFrame([(1, "9", "New", "new", ["x:a"], ["Old"], ["old"]), (2, "2", "Second", "second", [], [], [])], "place int, id string, name string, reading string, accounts array<string>, old_names array<string>, old_keys array<string>")
    got = {r["id"]: (r["name"], r["reading"], r["inferred"], r["aliases"]) for r in overlay.renamed(records, overrides).collect()}
    assert got == {"1": ("New", "new", False, ["o", "Old"]), "2": ("New", "new", False, ["x", "Old"]), "3": ("y", "r", True, []), "9": ("New", "new", False, ["z", "Old"])}


def test_restored_family(spark):
    kind = "id int, name string, licence string"
    base = spark.createDataFrame([(1, "a", None), (2, None, "old")], kind)
    family = spark.createDataFrame([(1, "f1", "CC0"), (2, "f2", "CC0"), (3, "f3", "CC0")], kind)
    present = base.where("id = 1")
    assert rows(overlay.restored(base, present, family, "id", ("licence",), 3), "id") == [(1, "a", None), (2, "f2", "CC0"), (3, "f3", "CC0")]
    assert overlay.restored(base, present, family, "id", ("licence",), 1) is base
    with pytest.raises(ValueError):
        overlay.restored(base, present, family, "id", ("licence",), 4)


def test_bindings_and_submission_files(spark, tmp_path):
    df = spark.createDataFrame([('{"a": {"value": " x "}, "b": {}}',), ("no json",), (None,)], "row string")
    assert rows(files.bindings(df, "row", ["a", "b"]).select("a", "b")) == [("", ""), ("", ""), ("x", "")]
    (tmp_path / "s.tsv").write_text('A／B\ta／b\tx:me  https://h/q\n\nC／"D\tc\tx:\n', encoding="utf-8")
    got = rows(files.read_submissions(spark, f"file://{tmp_path}/s.tsv", {"x:": "https://x.com/"}))
    assert got == [("A", "a", ["https://x.com/me", "https://h/q"]), ("B", "b", ["https://x.com/me", "https://h/q"]), ('C／"D', "c", ["https://x.com/"])]


def test_sources_left_in_lists(spark):
    df = spark.createDataFrame([(["https://bad.example/a", "https://good.example/b", None],), (["https://bad.example/a"],), (["https://bad.example/FREE"],), (None,)], "s array<string>")
    got = [r[0] for r in screening.sanitised_lists(df, ["s"], ("bad.example",), ("free",)).collect()]
    assert sorted(map(str, got)) == ["None", "None", "['https://bad.example/FREE']", "['https://good.example/b']"]


def test_applications_by_rank_and_again(spark):
    kind = "id string, name string, name_key string, aliases array<string>, accounts array<string>"
    records = spark.createDataFrame([("1", "a", "a", None, ["x:1"]), ("2", "b", "b", ["bb"], ["x:2"]), ("3", "same", "same", [], None), ("4", "same", "same", [], []), ("5", "alone", "alone", [], [])], kind)
    apps = spark.createDataFrame([(1, "n1", "A", "a", [], ["x:1", "y"]), (2, "2", "B", "b", ["q"], []), (3, "n3", "same", "same", [], ["z"]), (4, "n4", "Alone", "alone", [], []), (5, "n3", "Same two", "sametwo", [], ["w"])], f"app_id int, {kind}")
    got = {r["id"]: (r["name"], sorted(r["aliases"]), r["accounts"]) for r in identity.with_applications(records, apps).collect()}
    assert got == {"1": ("A", ["a"], ["x:1", "y"]), "2": ("B", ["b", "bb", "q"], ["x:2"]), "3": ("same", [], None), "4": ("same", [], []), "5": ("Alone", ["alone"], []), "n3": ("Same two", ["same"], ["z", "w"])}


@pytest.mark.parametrize(
    ("reply", "readable", "said"),
    [
        ('{"decision": "approve", "reason": "ok"}', True, ("approve", "ok")), ('{"reason": "unclear", "decision": "needs_review"}', True, ("needs_review", "unclear")), ('{"decision": "approve", "reason": "ok"}', False, ("needs_review", "insufficient_evidence")),
        ('{"decision": "approve", "reason": "unclear"}', True, None), ('{"decision": "needs_review", "reason": "ok"}', True, None), ('{"decision": "approve", "reason": "ok", "x": 1}', False, None), ('{"decision": "approve"}', True, None), ("[1]", True, None), ("no", True, None), (None, True, None),
    ],
)
def test_decisions_keep_to_their_contract(spark, reply, readable, said):
    got = one(spark, reply, lambda c: screening.decision(F.col(c), ("ok", "unclear", "insufficient_evidence"), F.lit(readable)))
    assert (got and tuple(got)) == said


def test_visible_text_and_blocks(spark):
    html = """<meta name="description" content="It's me"><meta name="robots" content="no"><style>a</script>b</style>x<script id='d' type="j">{"n": 3}</script> y <b>z"""
    assert one(spark, html, t.visible_text) == "It's me x y z" and one(spark, None, t.visible_text) == ""
    assert one(spark, html, lambda c: t.embedded_json(c, "d", "n int")["n"]) == 3 and one(spark, html, lambda c: t.embedded_json(c, "e", "n int")) is None


def test_fans_by_title_or_description(spark):
    df = spark.createDataFrame([("Best clips", "x"), ("Me", "clips allowed"), ("Me", "a fan channel"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(screening.fan_operated(F.col("a"), F.col("b"), r"\bclips\b", r"\bfan channel\b")).collect()] == [True, False, True, False]


def test_platforms_need_source_and_evidence(spark):
    kind = "id int, platforms array<string>, platform_sources map<string,string>, primary_platforms array<string>, primary_source string, primary_evidence string"
    records = spark.createDataFrame([(1, ["a", "b"], {"a": "https://s/", "b": "http://s/"}, ["c"], "https://p/", "e"), (2, None, None, ["c"], "https://p/", ""), (3, ["a"], None, None, None, None)], kind)
    accounts = spark.createDataFrame([(1, "d"), (2, "a"), (2, "other")], "id int, platform string")
    assert rows(u.platform_details(records, accounts, "id", ("a", "b", "c", "d"))) == [(1, ["a", "c", "d"], ["c"]), (2, ["a"], []), (3, [], [])]


def test_owned_items(spark):
    links = spark.createDataFrame([("r", 1), ("r", 1), ("r", 2), ("r", 3), ("r", 4), ("r", 5), (None, 1)], "record string, item int")
    items = spark.createDataFrame([(1, "c", 1, 5, False), (2, "other", 1, 5, False), (3, "c", 9, 5, False), (4, "c", 1, 0, False), (5, "c", 1, 5, None)], "item int, channel string, published int, views int, upcoming boolean")
    identities = spark.createDataFrame([("r", "c"), ("q", "other")], "record string, channel string")
    assert rows(screening.owned_items(links, items, identities, F.lit(5))) == [("r", 1)]


def test_profiles(spark):
    pages = spark.createDataFrame([(1, '<h2>A &amp; b</h2><i>2030-01-01</i><main><a href="https://x.com/Me">m</a></main>'), (2, '<h2> </h2><main><a href="https://x.com/Me">m</a></main>'), (3, "<h2>C</h2><main></main>"), (4, None)], "id int, html string")
    patterns = {"name": "<h2>(.*?)</h2>", "scope": "<main>(.*?)</main>", "debut": "<i>(.*?)</i>", "badge": "<b>(.*?)</b>"}
    assert rows(screening.profiles(pages, "id", "html", patterns, u.rule_table(spark), F.lit("2025-01-01").cast("date"))) == [(1, "A & b", "", None, ["x:me"])]


def test_named_records_and_rechecks(spark):
    existing = spark.createDataFrame([(1, "x:a", "ann", True), (2, "x:c", "cat", False), (3, "x:d", "dog", None)], "id int, account string, name_key string, named boolean")
    incoming = spark.createDataFrame([(11, "x:a", "ann"), (12, "x:a", "bob"), (13, "x:c", "bob"), (14, "x:d", "bob"), (15, "x:z", "z"), (16, None, "ann")], "in_id int, account string, name_key string")
    got = identity.resolve(existing, incoming, identity.Policy(guard=True, named_need_name=True))
    assert rows(got) == [(11, 1, "matched"), (12, None, "guarded"), (13, 2, "matched"), (14, 3, "matched"), (15, None, "new"), (16, None, "new")]
    assert [r[1] for r in rows(identity.resolve(existing, incoming, identity.Policy("all", named_need_name=True)))] == [1, None, 2, 3, None, None]
    registry = spark.createDataFrame([(1, "Ann", "an", ""), (2, "Cat", "kat", "old"), (3, "Dog", "dog", None)], "id int, name string, reading string, seen string")
    found = spark.createDataFrame([(11, "Ann", "s11"), (13, "Kitty", ""), (15, "Z", "s")], "in_id int, name string, seen string")
    assert rows(identity.rechecked(registry, found, got, "id")) == [(1, "Ann", "an", "s11"), (2, "Kitty", None, "old"), (3, "Dog", "dog", None)]
