"""Japanese order, and all statistics for every slice."""

from __future__ import annotations

import statistics as plain
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollbook.functions import text as t
from rollbook.operators import ordering, replies
from rollbook.operators import statistics as s

ORDER = ["_", "1", "ab", "Ab", "AB", "あい", "アイ", "カー", "カイ", "き", "キ", "ぎ", "きや", "ハ", "バ", "パ", "ん", "亜", "唖", "山", "星街", "星野"]


@pytest.mark.parametrize("buckets", [2, 64])
def test_names_in_japanese_order(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordering.places, "__defaults__", (buckets, 64))
    rows = [(f"{i:02}", "g" if i % 2 else None, w, w if i % 3 else None) for i, w in enumerate(ORDER)]
    got = ordering.named(spark.createDataFrame(list(reversed(rows)), "id string, g string, name string, reading string"), "g", "reading", "name", "id")
    for group in ("g", None):
        assert [r["name"] for r in got.where(F.col("g").eqNullSafe(F.lit(group))).orderBy("place").collect()] == [r[2] for r in rows if r[1] == group]


def test_kana_of_either_kind_are_one_and_readings_come_first(spark):
    rows = [("3", "g", "カア", ""), ("2", "g", "かあ", None), ("1", "g", "星", "かい"), ("0", "g", "い", None), ("4", "g", None, None)]
    got = ordering.named(spark.createDataFrame(rows, "id string, g string, name string, reading string"), "g", "reading", "name", "id").orderBy("place").collect()
    assert [r["id"] for r in got] == ["4", "0", "2", "3", "1"]


def test_tops_are_ranked_in_an_order(spark):
    rows = spark.createDataFrame([("g", w) for w in ("山", "ア", "い", "B", "a")], "g string, w string")
    assert [r["w"] for r in s.top_per(rows, "g", "w", 4, "ja").orderBy("rank").collect()] == ["a", "B", "ア", "い"]


NAMES = ["星街 すいせい", "星野そら", "ソラ", "ときのそら", "Ab", "ab", "さくら みこ", "さくらみこ", "a", "", None, "𠮷野家", "星街すいせい"]


def test_all_statistics_of_every_slice_are_those_of_its_rows(spark):
    rows = [(i, n, "xy"[i % 2], i % 3 > 0, "none" if i % 4 else "verified") for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "i int, name string, tag string, ok boolean, status string").withColumn("short", s.squeezed("name"))
    labels = s.statistic_labels(F.col("short"), F.col("ok"), F.col("status"), F.lit("よみ"))
    got = s.sliced(df, F.array(F.lit("all"), F.col("tag"), F.col("tag")), labels, "i", "name").collect()
    assert {r["slice"] for r in got} == {"all", "x", "y"}
    for part in ("all", "x", "y"):
        mine = [r for r in rows if part in ("all", r[2])]
        of = lambda st: {r["label"]: r["n"] for r in got if r["slice"] == part and r["statistic"] == st}  # noqa: B023,E731
        short = ["".join((r[1] or "").split()) for r in mine]
        assert of("total") == {"": len(mine)} and of("readable") == {"": sum(r[3] for r in mine)}
        size = next(r for r in got if r["slice"] == part and r["statistic"] == "size")
        assert (size["n"], size["value"]) == (sum(map(len, short)), plain.median(map(len, short)))
        lengths = sorted(Counter(map(len, short)).items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(int(r["label"]), r["n"]) for r in sorted((r for r in got if r["slice"] == part and r["statistic"] == "length"), key=lambda r: r["rank"])] == lengths
        twice = Counter(x.lower() for x in short)
        assert of("duplicates") == {"names": len(twice), "groups": sum(n > 1 for n in twice.values()), "records": sum(n for n in twice.values() if n > 1)}
        firsts = {r["label"]: r["shown"] for r in got if r["slice"] == part and r["statistic"] == "duplicate"}
        assert firsts == {k: next(r[1] for r, x in zip(mine, short) if x.lower() == k) for k, n in twice.items() if n > 1}
        one = df.where(F.lit(part == "all") | (F.col("tag") == part))
        for st, rule, most in (("character", F.array_distinct(F.filter(F.split("short", ""), lambda c: c.rlike(r"\p{L}"))), 10), ("pair", s.ngrams(F.col("short"), 2, r"\p{L}"), 10), ("gram3", s.ngrams(F.col("short"), 3, r"[\p{L}\p{N}]"), 20), ("kana", F.array_distinct(F.filter(F.split("short", ""), lambda c: c.rlike("[ぁ-ゖァ-ヶ]"))), 20)):
            assert of(st) == {r["label"]: r["n"] for r in s.presence(one, rule, most).collect()}
        assert of("script") == {r["x"]: r["n"] for r in one.groupBy(s.script(F.col("short")).alias("x")).agg(F.count("*").alias("n")).collect()}


def test_no_rows_have_no_slices(spark):
    df = spark.createDataFrame([], "i int, name string, tag string")
    labels = s.statistic_labels(F.col("name"), F.lit(True), F.lit("none"), F.lit(""))
    assert s.sliced(df, F.array("tag"), labels, "i", "name").count() == 0


@pytest.mark.parametrize(
    ("text", "follows", "wants"),
    [("名前の候補を考えて", False, True), ("名前の分析だけお願い", False, False), ("候補は不要です", True, False), ("suggest a few\nNames", False, True), ("no suggestions, but a name idea", False, False), ("why?", True, False), ("もう少し", True, True), ("もう少し", False, False), (None, True, True), (None, None, False), ("이름 추천", False, True)],
)
def test_messages_that_ask_for_names(spark, text, follows, wants):
    row = spark.createDataFrame([(text, follows)], "t string, f boolean")
    assert row.select(replies.wants_names(F.col("t"), F.col("f"))).first()[0] is wants


@pytest.mark.parametrize(("value", "prefix"), [("youtube:UC1", "youtube"), (":x", ""), ("a:b:c", "a"), ("0123456789abcdef0123456789ABCDEF", "uuid-like"), ("01234567-89ab-cdef-0123-456789abcdef", "uuid-like"), ("0123", "other"), ("", "other")])
def test_prefixes_of_ids(spark, value, prefix):
    assert spark.createDataFrame([(value,)], "x string").select(s.id_prefix(F.col("x"))).first()[0] == prefix


def test_texts_beyond_ascii_only_go_to_python(spark):
    rows = spark.createDataFrame([("Ａ&amp;ｂ ß!",), ("A&lt;b",), ("plain",), ("",), (None,)], "x string")
    got = rows.select("x", t.nfkc(F.col("x")).alias("n"), t.casefold("x").alias("c"), t.unescape(F.col("x")).alias("u")).collect()
    assert [tuple(r)[1:] for r in got] == [("A&amp;b ß!", "aampbss", "Ａ&ｂ ß!"), ("A&lt;b", "altb", "A<b"), ("plain",) * 3, ("",) * 3, (None,) * 3]
