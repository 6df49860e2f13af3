"""Extraction by rules: paths of broken pages, ranks, sections, entries and many hosts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollbook.functions import urls as u
from rollbook.operators import extraction
from rollbook.plans import extraction as plans

PAGES = "id string, url string, html string"


def _rules(spark, *rules):
    """host, field, kind, scope, attr, named, pattern, rank"""
    return spark.createDataFrame(rules, extraction.RULE)


def _found(spark, rules, *pages):
    df = spark.createDataFrame([(str(i), url, html) for i, (url, html) in enumerate(pages)], PAGES)
    return extraction.found(df, "id", "html", u.host_key("url"), rules)


def _values(df):
    return sorted((r["id"], r["field"], r["value"]) for r in df.collect())


@pytest.mark.parametrize(
    ("html", "paths"),
    [
        ("<p>a<p>b<b>c<p>d", ["/p", "/p", "/p/b", "/p"]), ("<ul><li>a<li>b</ul>c", ["/ul/li", "/ul/li", ""]), ("<div><p>a<div>b</div>c</div>", ["/div/p", "/div/p/div", "/div/p"]),
        ("</b>a</div>", [""]), ("<br>a<img>b", ["", ""]), ("<i/>a", [""]), ("<!-- <p>x --><p id='k' class=' a  b'>y", ["/p#k.a.b"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["/table/tr/td"] * 3),
        ("<script>if (a < b) '<p>'</script>z", ["/script", ""]), ("<a id='x/y'>t", ["/a#x_y"]), ("a < b & c", [""]), ("<a href='", [""]), (None, []), ("", []),
    ],
)
def test_paths_of_texts(html, paths):
    assert [path for _, element, path, *_ in extraction._tokens(html) if not element] == paths


def test_a_first_attribute_counts_and_references_are_decoded():
    assert extraction._tokens("<a href='1&amp;2' href=3 b>&lt;x&gt;</a>") == [(0, True, "/a", [0], {"href": "1&2", "b": ""}, None), (1, False, "/a", [0], None, "<x>")]


def test_values_come_by_rank_whatever_the_order_of_attributes(spark):
    rules = plans.rules(spark).where("field IN ('title', 'description')")
    head = "<title>T <b>x</b></title>"
    found = _found(
        spark, rules, ("https://a.example/", head + "<meta content='tw' name='twitter:title'><meta itemprop=description content=it>"),
        ("https://a.example/", head + "<meta property=OG:TITLE content=' '><meta name='description' content='d'><meta content='og' property='og:description'>"), ("https://b.example/", "no title"), ("https://b.example/", None),
    )
    rows = {r["id"]: (r["title"], r["description"]) for r in extraction.fields(found, "id", ("title", "description")).collect()}
    assert rows == {"0": ("tw", "it"), "1": ("T x", "og")}


def test_rules_are_for_their_hosts(spark):
    rules = _rules(spark, ("a.example", "name", "one", "/h1", None, None, None, 0), ("b.example", "name", "one", "/h2", None, None, None, 0), ("", "any", "many", "/h[12]", None, None, "([a-z]+)", 0))
    html = "<h1>One 1</h1><h2>Two <i>and</i> 2</h2>"
    got = _values(_found(spark, rules, ("https://www.a.example/x", html), ("http://b.example", html), ("https://c.example/", html), ("", html)))
    assert [x for x in got if x[1] == "name"] == [("0", "name", "One 1"), ("1", "name", "Two and 2")]
    assert [x[2] for x in got if x[1] == "any"] == ["ne", "wo"] * 4


def test_a_text_belongs_to_all_elements_above_it(spark):
    rules = _rules(spark, ("", "out", "many", "/div", None, None, None, 0), ("", "in", "many", r"/p\.k", None, None, None, 0))
    got = _values(_found(spark, rules, ("", "<div>a<p class=k>b <b>c</b></p><p class=kk>d</p></div><div>e</div>")))
    assert got == [("0", "in", "b c"), ("0", "out", "a b c d"), ("0", "out", "e")]


ROSTER = (("", "person", "entry", "/h3", None, None, None, 0), ("", "link", "part", "/a", "href", None, "^(https?:.*)", 0), ("", "bound", "begin", "/hr#first", None, None, None, 0), ("", "bound", "end", "/hr#last", None, None, None, 0))


def test_links_belong_to_the_entry_before_them(spark):
    html = "<a href=https:0>x</a><h3>P</h3><a href=https:1>x</a><i><a href=/own>x</a><a href=https:2>x</a></i><h3>Q</h3><h3>R</h3><a href=https:3>"
    bounded = f"<h3>out</h3><a href=https:9></a><hr id=first>{html}<hr id=last><h3>S</h3><a href=https:8>"
    found = _found(spark, _rules(spark, *ROSTER), ("", html), ("", bounded), ("", bounded.replace("first", "fst")), ("", bounded.replace("last", "lst")))
    got = lambda *bound: sorted((r["id"], r["entry"], [p["value"] for p in r["parts"]]) for r in extraction.entries(found, "id", "person", ("link",), *bound).collect())
    inner = [("P", ["https:1", "https:2"]), ("Q", []), ("R", ["https:3"])]
    assert got("bound") == [("1", *x) for x in inner]
    assert [x[1:] for x in got() if x[0] == "0"] == inner and len(got()) == 3 + 3 * 5


def test_many_rules_are_joined_by_host(spark, monkeypatch):
    monkeypatch.setattr(extraction, "MOST_BROADCAST", 3)
    rules = _rules(spark, *((f"h{i}.example", "f", "one", "/h1", None, None, None, 0) for i in range(9)))
    got = _values(_found(spark, rules, *((f"https://h{i}.example/", f"<h1>{i}</h1>") for i in range(12))))
    assert [x[2] for x in got] == [str(i) for i in range(9)]


def test_a_page_of_a_million_characters(spark):
    assert extraction._tokens("<i>" * 300 + "t")[-1][2:4] == ("/i" * extraction.DEPTH, list(range(300 - extraction.DEPTH, 300)))
    html = "<div>" * 2000 + "".join(f"<p>w{i}<a href='/{i}'>x" for i in range(20_000))
    found = _found(spark, _rules(spark, ("", "link", "many", "/a", "href", None, None, 0)), ("", html))
    assert found.agg(F.count("*"), F.countDistinct("value")).first() == (20_000, 20_000)


def test_texts_that_were_cut_amid_a_reference_stay(spark):
    html = "<title>a &amp;&lt;&#39; b&amp c&am &#65 & d &copy=1&AMP</title>"
    df = spark.createDataFrame([("0", "", html), ("1", "", None)], PAGES).withColumn("html", extraction.ended_references(F.col("html")))
    assert _values(extraction.found(df, "id", "html", u.host_key("url"), plans.rules(spark).where("field = 'title'"))) == [("0", "title", "a &<' b&amp c&am &#65 & d &copy=1&AMP")]


def test_titles_of_pages_that_end_in_a_cut_reference_equal_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(5, "https://a.example/", "<html><title>x &amp;&amp; ver&amp</title></html>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in plans.e1_descriptions(spark, str(tmp_path)).collect()] == duckdb.sql(plans.ORACLES["e1_descriptions"]).fetchall() == [(5, "x && ver&amp", "og 5")]


def test_a_worker_holds_few_elements_at_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["<b a=1>x<i>y</i></b>"] * 2999 + [None])], names=["id", "html"])
    pieces = list(extraction._in_pieces(iter([batch])))
    assert max(p.num_rows for p in pieces) < 2 * extraction.MOST_HELD and sum(p.num_rows for p in pieces) == 4 * 2999 and len(pieces) > 1
    assert pieces[-1].to_pylist()[-4] == {"id": 2998, "place": 0, "element": True, "path": "/b", "ids": [0], "attrs": [("a", "1")], "text": None}
