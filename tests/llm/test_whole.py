"""The whole job, where less once passed: each test fails on the cut that was there."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import duckdb
import pytest
from conftest import DATA

from rollbook.llm import decontaminate, licences, neardup


def _least_linked(rows, percent):
    """{doc_id: least doc_id of its component}, by brute force."""
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    return group


def _copies(lasts):
    """Texts of 100 words, each with copies whose last words differ: 11 of them give a similarity of 0.79, 10 of 0.81, 9 of
    0.83 and 7 of 0.86."""
    rng = random.Random(5)
    rows = []
    for g in range(40):
        words = [f"g{g}w{k}" for k in range(100)]
        rows.append((len(rows), " ".join(words)))
        for last in rng.sample(lasts, 2):
            rows.append((len(rows), " ".join(words[:-last] + [f"c{len(rows)}n{k}" for k in range(last)])))
    return rows


@pytest.mark.parametrize("most_pairs", [48, 0])
def test_near_duplicate_stage_links_from_80_percent(spark, monkeypatch, most_pairs):
    monkeypatch.setattr(neardup, "MOST_PAIRS", most_pairs)
    rows = _copies([7, 9, 10, 11, 12])
    group = _least_linked(rows, 80)
    assert group != _least_linked(rows, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, DATA).collect()}
    assert kept == {i for i in group if group[i] == i}


def test_verbatim_notices_of_one_file_are_all_found(spark):
    """15 distinct licence words and more: the commoner ones vote, too. Filler rows make the common words of both notices
    common in the table."""
    notices = {label: notice for label, notice, _ in licences.TEMPLATES}  # of mit, the permission text
    both = f"{notices['mit']} and {notices['apache-2.0']}"
    every = " then ".join(notice for _, notice, _ in licences.TEMPLATES)
    filler = [(100 + i, "license licensed version") for i in range(50)]
    docs = spark.createDataFrame([(1, both), (2, every), *filler], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.licence_scan(docs).collect() if r["doc_id"] < 100}
    assert got[1] == ("apache-2.0,mit", 1.0)
    assert set(got[2][0].split(",")) == {label for label, _, _ in licences.TEMPLATES} | set(licences.BASE_PHRASES.values()) - {"reserved"}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(1, both), (2, every), *filler])
    told = {i: (labels, score) for i, labels, score in db.sql(f"SELECT doc_id, labels, score FROM ({licences.ORACLES['op7_rare_token_index']}) WHERE doc_id < 100").fetchall()}
    assert told == got


def test_rare_postings_miss_no_place():
    """Each set of a template's words with enough votes holds one that is looked up, whatever the words' frequencies."""
    for idf in ({}, {w: i * 7919 % 101 for i, (w, _, _) in enumerate(licences.postings())}):
        rare = licences.rare_postings(idf)
        for t in range(len(licences.TEMPLATES)):
            own = [p for p in licences.postings() if p[1] == t]
            looked = [p for p in rare if p[1] == t]
            assert looked and len(own) - len(looked) < licences.LEAST_SHARE * len(own)


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("block_bytes", [None, 150])
def test_longest_matches_of_documents_by_brute_force(spark, monkeypatch, block_bytes):
    if block_bytes:  # several passes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(8)
    some = lambda n: [rng.choice("ab") + str(rng.randrange(3)) for _ in range(n)]
    items = [some(rng.choice([2, 4, 9, 10, 14, 25])) for _ in range(12)]
    docs = [some(rng.randrange(30)) for _ in range(15)]
    for _ in range(45):
        it = rng.choice(items)
        a = rng.randrange(len(it))
        docs.append(some(rng.randrange(6)) + it[a : a + rng.randrange(5, 26)] + some(rng.randrange(6)) + it[:12])
    table = spark.createDataFrame([(i, ", ".join(d).title() if i % 2 else " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, "")], "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame([(f"i{k}", " ".join(it)) for k, it in enumerate(items)] + [("none", None)], "item_id string, text string")
    want = {900: (0, None), 901: (0, None)}
    for i, d in enumerate(docs):
        best = (0, None)
        for it in items:
            least = min(len(it), decontaminate.WINDOW)
            for k in range(len(d)):
                for j in range(len(it)):
                    n = 0
                    while k + n < len(d) and j + n < len(it) and d[k + n] == it[j + n]:
                        n += 1
                    if n >= least and (n > best[0] or (n == best[0] and k < best[1])):
                        best = (n, k)
        want[i] = best
    got = {r["doc_id"]: (r["longest_match"], r["match_word"]) for r in decontaminate.contamination(table, bench).collect()}
    assert got == want and sum(n > decontaminate.WINDOW for n, _ in got.values()) > 9
