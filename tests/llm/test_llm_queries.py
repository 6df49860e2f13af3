"""The registered queries of the training-data operators: against their SQL, or against plain Python."""

from __future__ import annotations

import re
from html import unescape

import pytest
from conftest import DATA

from rollbook.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, canonical, name):
    assert canonical(queries.QUERIES[name](spark, DATA).toPandas()) == canonical(duck.sql(queries.ORACLES[name]).df())


def test_all_there():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


def test_pages_lose_nothing_but_what_stands_apart(spark, duck):
    html = dict(duck.sql("SELECT page_id, html FROM pages").df().itertuples(index=False, name=None))
    for r in queries.QUERIES["op6_line_block_text"](spark, DATA).collect():
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))).split())


def test_toxicity_of_held_out_rows(spark, duck):
    labels = dict(duck.sql("SELECT doc_id, toxic FROM labels").df().itertuples(index=False, name=None))
    rows = [r for r in queries.QUERIES["op5_subword_toxicity"](spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    clean = [r for r in rows if not labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in clean) <= 0.1 * len(clean)


def test_mixing_covers_all(spark, duck):
    rows = queries.QUERIES["op2_pfair_mixing"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for (i,) in duck.sql("SELECT doc_id FROM documents").df().itertuples(index=False, name=None))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
