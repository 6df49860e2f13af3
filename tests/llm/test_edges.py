"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import difflib
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from html import unescape

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollbook.llm import decontaminate, html_text, licences, line_dedup, mixing, neardup, quality, sharding, toxicity, url_lists

KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, row string, lists string, n_gone string"
WORDS = [f"w{i}x" for i in range(300)]
LONG = " ".join(f"long{i % 997}" for i in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def _docs(spark):
    base = " ".join(WORDS[:120])
    near = base.replace("w60x", "other")
    texts = {
        1: base, 2: base, 3: near, 4: " ".join(reversed(WORDS)), 5: "", 6: None, 7: "   \n\t ", 8: LONG, 9: "tiny", 10: "tiny", 11: "two words", 12: f"intro {PASSAGE} outro",
        13: "line one is here\nline two is here\nline three is here\nlast a", 14: "head\nline one is here\nline two is here\nline three is here", 15: "All Rights RESERVED. Licensed under the Apache License, Version 2.0.", 16: "ÀÉ " * 30,
    }
    rows = [(i, t, "en" if i % 2 else None, "hot" if i < 12 else None, len(t or ""), "s", "c", "r", "l", "g") for i, t in texts.items()]
    rows += [rows[0], (None, base, "xx", "", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND).coalesce(2)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark).cache()


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_sharding(spark, docs):
    out = sharding.shard_documents(docs, 5).collect()
    assert len(out) == docs.count()
    total = sum(r["size"] for r in out)
    by = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(5)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    heaviest = max(r["size"] for r in out)
    assert all(abs(sum(r["size"] for r in out if r["shard"] == s) - total / 5) <= heaviest for s in range(5))
    for r in out:
        assert r["grown_shard"] is None
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL").collect()}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 for r in out if r["doc_id"] is not None)
    assert sharding.shard_documents(docs.limit(0), 5).count() == 0


def test_groups_stay_whole_up_to_a_share(spark, canonical):
    """100 equal texts in a shard of 8,410 bytes, groups that fit together or not at all, and one larger than a share."""
    texts = [f"text {i} " + "y" * (i % 190) for i in range(1500)]
    copies = {"a" * 200: 25, "b" * 120: 40, "c" * 60: 60, "d": 300, "e" * 180: 22, "g" * 100: 700, "h" * 30: 90}
    texts += [t for t, n in copies.items() for _ in range(n)]
    rows = [(i * 7919 % 100_003, t) for i, t in enumerate(texts)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)).toPandas()
    where = out.groupby("text_md5")["shard"].nunique()
    share = sum(len(t) + 16 for t in texts) / 40
    for t, n in copies.items():
        assert (where[hashlib.md5(t.encode()).hexdigest()] == 1) == (n * (len(t) + 16) <= share), t
    assert (where > 1).sum() == sum(n * (len(t) + 16) > share for t, n in copies.items()) > 0
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and (abs(sizes - share) <= 216).all()
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in out.groupby("shard"))
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert canonical(out) == canonical(db.sql(sharding.OP1_SQL).df())


def test_sharding_counts_and_hot_keys(spark):
    df = spark.range(1000).select(F.lit("same").alias("k"), F.monotonically_increasing_id().alias("row"), F.lit(1).alias("w"), F.lit("x").alias("shard"))
    out = sharding.shard(df, 7, ["k", "row"], "w", n_ranges=20)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    nothing = sharding.shard(df.withColumn("w", F.lit(None).cast("int")), 7, ["k", "row"], "w", n_ranges=20)
    sizes = [r["count"] for r in nothing.groupBy("shard").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 1


def test_quality(spark, docs):
    out = {r["doc_id"]: r for r in quality.quality_rules(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    for i, r in out.items():
        words = texts[i].split()
        assert r["n_words"] == len(words) and r["n_repeat_words"] == quality.repeated_words(words), i
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
    assert not out[6]["kept"] and out[8]["n_words"] == 60_000
    assert quality.quality_rules(docs).count() == docs.count()
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_js_distance():
    assert quality.js_distance([1, 0], [0, 5]) == pytest.approx(1) and quality.js_distance([1, 2], [2, 4]) == 0 and quality.js_distance([0], [1]) == 0


def test_contamination(spark, docs):
    items = spark.createDataFrame([("b", PASSAGE.upper()), ("a", "tiny"), ("e", ""), ("n", None), ("z", "never there at all in any of these documents ok"), (None, "words beyond")], "item_id string, text string")
    odd = [(20, "some words beyond that"), (21, f"words beyond and {PASSAGE}")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    out = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect() if r["doc_id"] is not None}
    # an item without an id has the id ''
    assert (out[20]["n_hit"], out[20]["n_items"], out[20]["items"]) == (2, 1, [""]) and out[21]["items"] == ["", "b"]
    assert out[21]["items_sha256"] == hashlib.sha256(b",b").hexdigest()
    assert out[12]["n_hit"] == 12 and out[12]["items"] == ["b"] and out[9]["items"] == ["a"] and out[9]["n_hit"] == 1
    assert {i for i, r in out.items() if r["contaminated"]} == {9, 10, 12, 20, 21}
    assert out[6]["n_words"] == 0 and out[8]["n_words"] == 60_000
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 5
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    best = decontaminate.longest_matches(docs, items).collect()
    assert ("b", 0, 12, 12, 1) in [tuple(r) for r in best]


def test_contamination_in_blocks(spark, docs, monkeypatch):
    long = " ".join(f"long{i % 997}" for i in range(100, 160))
    items = spark.createDataFrame([("b", PASSAGE), ("a", "tiny"), ("long", long), (None, "never there"), ("c", "five six seven eight nine ten eleven twelve outro")], "item_id string, text string")
    whole = sorted(pairs(decontaminate.contamination(docs, items), "doc_id", "n_hit", "items_sha256"), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 250)
    assert sorted(pairs(decontaminate.contamination(docs, items), "doc_id", "n_hit", "items_sha256"), key=str) == whole
    assert any(h > 3000 for _, h, _ in whole)
    assert decontaminate.decontaminated(docs, items).count() == docs.count() - 4


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 4, 200).astype(np.int32)
    got = decontaminate.suffix_array(tokens, 300).tolist()

    def suffix(i):
        end = next((k for k in range(i, len(tokens)) if not tokens[k]), len(tokens))
        return tokens[i:end].tolist()

    assert [suffix(i) for i in got] == sorted(suffix(i) for i in range(len(tokens)) if tokens[i])


def test_toxicity(spark, docs):
    rude = ["you are a stupid idiot really", "what a moron that clown is", "such worthless trash and scum"]
    fine = ["the river runs to the sea", "bread is baked in the morning", "trees grow in the quiet wood"]
    rows = [(1000 + i, f"{(rude if i % 2 else fine)[i % 3]} number {i}", "en", "s") for i in range(240)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(240)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(more, labels).collect()}
    assert len(out) == 240
    held = [i for i, r in out.items() if r["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
    assert sum(out[i]["predicted"] == i % 2 for i in held) >= 0.95 * len(held)
    scores = toxicity.scored(docs, toxicity.trained(more, labels))
    assert scores.count() == docs.count() and scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert set(scores.columns) == set(docs.columns)
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_misspellings_share_ngrams():
    rude, fine = ["what a stupid thing", "so stupid of them", "stupid again"], ["the river runs", "bread is baked", "trees grow here"]
    model = toxicity.fit(pa.array(rude * 20 + fine * 20), __import__("numpy").array([1.0] * 60 + [0.0] * 60))
    bad, good, none = model.scores(pa.array(["how stupiid", "how river", None]))
    assert bad > 0.7 > good and none < 0.7


PAGES = {
    "a": ("<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>First &amp; <b>se</b>cond&nbsp;part.</p><div class='ad'>Buy now</div><p>Of.</p></article><footer>foot</footer></body></html>", "Head First & second part. Of."),
    "b": ("<body><div id=menu><a>x</a> y</div><main><p>" + "word " * 30 + "</p><div class='comments'><p>reader</p></div></main><aside>side</aside>", ("word " * 30).strip()),
    "c": ("<div class='cookie-notice'>accept</div><header>Site</header><p>" + "alpha " * 20 + "<form><p>name</p><input></form><p>omega</p>", ("alpha " * 20).strip() + " omega"),
    "d": ("", ""), "e": (None, ""), "f": ("plain < text & more", "plain < text & more"), "g": ("<nav>only a menu</nav>", ""), "h": ("<article><p>open <p>never closed", "open never closed"),
}


def test_main_text(spark):
    df = spark.createDataFrame([(i, k, h, "x") for i, (k, (h, _)) in enumerate(PAGES.items())] * 2, "page_id long, url string, html string, text string")
    out = html_text.main_text(df).collect()
    assert len(out) == 2 * len(PAGES)
    for r in out:
        assert r["text"] == PAGES[r["url"]][1], r["url"]
        assert r["n_chars"] == len(r["text"])
    assert html_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", '<a href="x ', "<a '", "<", "<!", "<!--", "</", "<p>x<", '<a ">" ', "<script>", "<b class=", "&amp", "<div><p>t ", '<i x="'])
def test_long_broken_pages(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.extract(page)
    html_text.extract(page + '">' + page + "'")
    assert time.process_time() - began < 15


def test_broken_markup_is_text():
    assert html_text.extract("a < b and <c d") == "a < b and <c d"
    assert html_text.extract('<p title="a>b">one</p><p class=\'x">two</p> <!-- never closed <p>three') == "one two"
    assert html_text.extract("x<!-- a --><!doctype y>z <SCRIPT>no</script >w") == "xz w"


def _neutral(html):
    """The page without what its names tell: article, nav and so on as div, no classes or ids."""
    html = re.sub(r"<(/?)(?:article|nav|footer|header|aside|main|section)\b", r"<\1div", html)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]*)""", "", html)


def test_density_decides_without_names(duck):
    """Pages whose elements and classes tell nothing: menus go by their links, adverts and footers by their places."""
    pages = duck.sql("SELECT html FROM pages").fetchall()
    assert len(pages) >= 50
    both = Counter()
    for (html,) in pages:
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        want = Counter(" ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))).split()).split())
        got = Counter(html_text.extract(_neutral(html)).split())
        both.update(hit=sum((want & got).values()), want=sum(want.values()), got=sum(got.values()))
    assert both["hit"] >= 0.95 * both["want"] and both["hit"] >= 0.97 * both["got"]


WORDS_60 = " ".join(f"word{i}" for i in range(60))


def test_a_small_card_is_not_the_article():
    page = f"<body><div><p>{WORDS_60}</p><p>{WORDS_60} end</p></div><article><p>Other story, read on now</p></article></body>"
    assert html_text.extract(page).startswith(f"{WORDS_60} {WORDS_60} end")
    # while one with a share of the page's text is
    assert html_text.extract(f"<body><div><p>{WORDS_60}</p></div><article><p>{WORDS_60} it</p></article></body>") == f"{WORDS_60} it"


@pytest.mark.parametrize(("name", "stays"), [("share-price", True), ("search-algorithms", True), ("ad-hoc", True), ("cookie-recipes", True), ("no-ads", True), ("share-buttons", False), ("comment-list", False), ("site-footer x", False), ("cookie-notice", False), ("ad ad-top", False), ("post-42-comments", False)])
def test_names_count_as_a_whole(name, stays):
    for attribute in ("class", "id"):
        text = html_text.extract(f"<body><article><p>{WORDS_60}</p><div {attribute}='{name}'><p>{WORDS_60} more</p></div></article></body>")
        assert text == (f"{WORDS_60} {WORDS_60} more" if stays else WORDS_60)


def test_runs_are_those_of_windows_one_by_one():
    """Surges and dives against a search of every window."""
    rng = random.Random(4)
    for _ in range(300):
        size = [rng.choice([0, 0, 0, 5, 90]) for _ in range(rng.randrange(1, 14))]
        sums = [sum(size[i : i + html_text.WINDOW]) for i in range(len(size))]
        want, i = [], 0
        while i < len(size):
            if not sums[i]:
                i += 1
                continue
            first = i
            while i < len(size) and sums[i]:
                i += 1
            want.append((first, min(i + html_text.WINDOW - 1, len(size)), max(sums[first:i])))
        assert html_text.runs(np.array(size)) == want


def test_of_runs_without_surge_the_first_with_most_text_stays():
    menu = "<p><a href=x>m</a></p>" * 4
    assert html_text.extract(f"<body><p>four four</p>{menu}<p>nine nine</p>{menu}<p>two</p></body>") == "four four"


def test_licences(spark, docs):
    out = {r["doc_id"]: r for r in licences.licence_scan(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert out[15]["base_labels"] == "reserved" and out[15]["labels"] == "apache-2.0,reserved" and out[15]["n_base"] == 1 and out[15]["first_word"] == 0
    assert out[6]["labels"] == "" and out[6]["score"] == 0 and out[6]["first_word"] is None
    assert licences.licence_scan(docs).count() == docs.count() and licences.licence_scan(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "CC BY cc by-CC  by Kcc by"), (2, "general public\nlicense general public"), (3, "the license of MIT, released")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.licence_scan(odd).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (3, 0, 4) and got[2]["n_base"] == 1
    assert got[3]["labels"] == ""  # its words aren't where the notice has them


def _url_rows(spark):
    caps = [(1, "https://a.b.example.com/x/y?q", "2024-01-02 00:00:00", "l"), (2, "https://a.b.example.com/x/y?q", "2024-01-05 00:00:00", "l"), (3, "http://example.com", "2024-01-09 00:00:00", "l"), (4, None, "2024-01-02 00:00:00", "l"), (5, "nonsense", "2024-01-02 00:00:00", "l"), (6, "https://c.org/", None, "l"), (3, "http://example.com", "2024-01-09 00:00:00", "l")]
    log = [("ads", "example.com", "2024-01-01", True), ("ads", "example.com", "2024-01-04", False), ("ads", "example.com", "2024-01-08", True), ("ads", "example.com", "2024-01-08", True), ("bad", "a.b.example.com/x", "2024-01-01", True), ("allow", "b.example.com", "2024-01-03", True), ("ads", None, "2024-01-01", True), (None, "example.com", "2024-01-01", True), ("t", "example.com", "2024-01-09", True), ("t", "example.com", "2024-01-09", False)]
    c = spark.createDataFrame(caps, "id int, url string, at string, lists string").select("id", "url", F.col("at").cast("timestamp").alias("fetched_at"), "lists")
    e = spark.createDataFrame(log, "list string, key string, at string, added boolean").withColumn("at", F.col("at").cast("timestamp"))
    return c, e


def test_url_lists(spark):
    c, e = _url_rows(spark)
    out = sorted(pairs(url_lists.listed(c, e), "id", "lists", "blocked"))
    assert out == [(1, "ads,bad", True), (2, "allow,bad", False), (3, "ads", True), (3, "ads", True), (4, "", False), (5, "", False), (6, "", False)]
    assert url_lists.listed(c, e.limit(0)).where("n_lists > 0").count() == 0 and url_lists.listed(c.limit(0), e).count() == 0


def _brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return Counter((d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, docs):
    rows = pairs(docs, "doc_id", "text")
    got = Counter(pairs(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id"))
    assert got == _brute(rows)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    wordless = sum(not (t or "").split() for _, t in rows)
    assert kept.count() == len({c for d, n, c in got if n}) + wordless
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_near_copies(spark, monkeypatch):
    """A large group of copies with one to six words changed: star, pairs and prefix join together miss no link."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(160):
        words = list(base)
        for k in rng.sample(range(140), rng.choice([0, 1, 1, 2, 3, 4, 6])):
            words[k] = f"c{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(neardup, "MOST_PAIRS", 4)
    got = Counter(pairs(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id"))
    assert got == _brute(rows)


def test_mixing(spark, docs):
    plan = mixing.planned(docs.select("doc_id", "text", "source"), block_bytes=1000).collect()
    assert len(plan) == docs.count() and all(r["release"] <= r["slot"] < r["deadline"] for r in plan)
    out = mixing.mixed(docs, {"hot": 3, "": 1}, 1000)
    assert out.columns == docs.columns and Counter(map(str, out.collect())) == Counter(map(str, docs.collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="over 0"):
        mixing.mixed(docs, {"hot": 0})


def _ideal(blocks, weights, slots):
    """What each source has been served after each slot at its ideal rate, in fractions."""
    served = [Fraction(0)] * len(blocks)
    out = [list(served)]
    for _ in range(slots):
        left = Fraction(1)
        while left:
            active = [s for s, n in enumerate(blocks) if served[s] < n]
            if not active:
                break
            total = sum(weights[s] for s in active)
            step = min([left, *((blocks[s] - served[s]) * total / weights[s] for s in active)])
            for s in active:
                served[s] += step * weights[s] / total
            left -= step
        out.append(list(served))
    return out


@pytest.mark.parametrize("case", [([6], [1]), ([5, 5], [1, 1]), ([7, 20, 3], [7, 2, 1]), ([40, 9, 9, 2, 1], [5996, 4000, 4, 1, 1]), ([3, 30, 17, 12], [13, 3, 5, 11])])
def test_pfair_lag(case):
    """No source is a block ahead of or behind its ideal service at any time, also after others have run out."""
    blocks, weights = case
    plan = mixing.schedule(blocks, weights)
    assert [slot for *_, slot in plan] == list(range(sum(blocks))) and len({(s, j) for s, j, *_ in plan}) == sum(blocks)
    ideal, done = _ideal(blocks, weights, len(plan)), [0] * len(blocks)
    for s, j, release, deadline, slot in plan:
        assert release <= slot < deadline and done[s] == j
        done[s] += 1
        assert all(abs(d - x) < 1 for d, x in zip(done, ideal[slot + 1], strict=True))


@pytest.mark.parametrize("weights", [None, {"hot": 0.5996, "s0": 0.4, "t7": 0.0004, "nowhere": 2}])
def test_mixing_of_many_sources(spark, weights):
    """300 sources, one of them with a third of all rows: each row keeps its source, small sources share one stream, and the
    schedule is what plain Python makes of the streams."""
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 84) AS text", "if(id % 3 = 0, 'hot', if(id % 3 = 1, concat('s', id % 5), concat('t', id % 293))) AS source")
    rows = mixing.planned(df.coalesce(2), weights, 2000).collect()
    assert Counter(r["source"] for r in rows) == Counter(r["source"] for r in df.collect())
    size = Counter(r["source"] for r in rows)
    size = {s: 100 * n for s, n in size.items()}
    if weights is None:
        weight = {s: b**0.7 for s, b in size.items()}
    else:
        weight = {s: weights.get(s, b / 300_000 * sum(weights.values())) for s, b in size.items()}
    large = sorted((s for s in size if size[s] > 2000), key=lambda s: (-weight[s], s))
    streams = {s: (size[s], weight[s]) for s in large} | {None: (sum(b for s, b in size.items() if s not in large), sum(w for s, w in weight.items() if s not in large))}
    total = sum(w for _, w in streams.values())
    plan = mixing.schedule([-(-b // 2000) for b, _ in streams.values()], [round(w / total * 10**12) for _, w in streams.values()])
    where = {(list(streams)[s], j): (slot, release, deadline) for s, j, release, deadline, slot in plan}
    for r in rows:
        stream = r["source"] if r["source"] in large else None
        slot, release, deadline = where[stream, r["block"]]
        assert r["block"] == r["order"] * 100 // 2000 and abs(r["slot"] - slot) <= 1 and r["release"] <= r["slot"] < r["deadline"]
    for stream in streams:
        order = sorted((r["slot"], r["order"]) for r in rows if (r["source"] if r["source"] in large else None) == stream)
        assert [k for _, k in order] == list(range(len(order)))


def _lines_brute(rows):
    """Numbers of deleted lines by row, from the definition."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    texts = {i: [x for x in (rows[i][1] or "").split("\n") if x.split()] for i in order}
    first, found, gone = {}, [], {i: set() for i in order}
    for i in order:
        ls = texts[i]
        for p in range(len(ls)):
            runs = [tuple(ls[p : p + size]) for size in (1, 2, 3) if p + size <= len(ls)]
            runs = [r for r in runs if len(r) == 3 or sum(len(x.split()) for x in r) >= 50]
            earlier = [(*first[r], len(r)) for r in runs if first.setdefault(r, (i, p)) != (i, p)]
            if earlier:
                j, q, size = earlier[-1]
                n = next(n for n in range(len(ls) + 1) if ls[p + n : p + n + 1] != texts[j][q + n : q + n + 1] or p + n == len(ls))
                found.append((i, p, j, q, size, n))
    for i, p, j, q, size, n in found:
        n = min(m for *run, m in found if run[0] == i and run[2:] == [j, q, size]) if i == j else n
        gone[i] |= set(range(p, p + n)) - (set(range(q, q + n)) if i == j else set())
    return gone, texts


def _counts(rows):
    gone, texts = _lines_brute(rows)
    return Counter((rows[i][0], len(texts[i]), len(gone[i])) for i in gone)


def test_line_dedup(spark, docs):
    rows = pairs(docs, "doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    assert Counter(pairs(out, "doc_id", "n_lines", "n_gone")) == _counts(rows)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[14] == "head" and text[13] == "line one is here\nline two is here\nline three is here\nlast a"
    assert text[6] is None and text[5] == "" and text[8] == LONG
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_random(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d d", "x " * 30]) for _ in range(rng.randrange(12)))) for i in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert Counter(pairs(out, "doc_id", "n_lines", "n_gone")) == _counts(rows)


def test_first_copies_stay_whole(spark):
    cases = {"a a a a a": "a a a", "x y x y x y": "x y x y", "1 2 3 4 5 " * 3: "1 2 3 4 5", "l m n l m n o l m n": "l m n o", "p q p q": "p q p q"}
    rows = [(2 * i + k, "\n".join(text.split())) for i, text in enumerate(cases) for k in (0, 1)]
    out = {r["doc_id"]: r["text"].split() for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [" ".join(out[2 * i]) for i in range(len(cases))] == list(cases.values())
    assert not any(out[2 * i + 1] for i in range(len(cases)))


def test_many_repeated_lines_and_runs(spark):
    """A text of thousands of equal lines takes no time that grows with their square; maximal runs are told."""
    docs = spark.createDataFrame([(1, "same\n" * 5_000), (2, "p\nq\nr\ns\nt"), (3, "o\np\nq\nr\ns\nu")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].split() == ["same"] * 3 and got[2] == "p\nq\nr\ns\nt" and got[3] == "o\nu"
    assert (3, 1, 4, 2, 0) in pairs(line_dedup.repeated_runs(docs.where("doc_id > 1")), "doc_id", "line", "n_lines", "first_doc_id", "first_line")
