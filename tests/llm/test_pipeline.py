"""Each stage of the pipeline against plain Python, on the documents that the stage before it kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F

from rollbook.llm import common, toxicity


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _windows(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set(), w


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns, kept = docs.columns, {}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), name)
        frames.append(docs)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns + (["shard", "slot"] if name == "sharding" else [])
    before = {r["doc_id"]: r["text"] for r in frames[0].collect()}
    model = toxicity.trained(frames[0], common.table(spark, DATA, "labels"))
    rejected = {r["doc_id"] for r in toxicity.scored(frames[0], model).where(F.col("score") >= toxicity.THRESHOLD).collect()}
    assert set(kept["toxicity"]) == set(before) - rejected

    ids = sorted(kept["toxicity"])
    sets = {i: _shingles(before[i]) for i in ids}
    group = {i: i for i in ids}
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR_PERCENT * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    assert set(kept["near_duplicates"]) == {i for i in ids if group[i] == i}

    items = [_windows(r["text"])[0] for r in common.table(spark, DATA, "benchmark").collect()]
    wanted = set().union(*items)
    sizes = {len(w) for w in wanted}

    def hit(text):
        w = _windows(text)[1]
        return any(tuple(w[i : i + n]) in wanted for n in sizes for i in range(len(w) - n + 1))

    assert set(kept["decontamination"]) == {i for i in kept["near_duplicates"] if not hit(before[i])}
    assert set(kept["mixing"]) == set(kept["decontamination"]) == set(kept["sharding"])

    rows = kept["sharding"].values()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 16
    heaviest = max(len((r["text"] or "").encode()) + 16 for r in rows)
    assert all(abs(sizes[s] - sum(sizes.values()) / 40) <= heaviest for s in range(40))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in sizes)
    # a shard is a stretch of the mixed sequence: by file and row
    sequence = [r["doc_id"] for r in frames[4].select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k")).orderBy("f", "k").collect()]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == sequence


def test_empty_and_null_rows(spark):
    docs = common.table(spark, DATA, "documents")
    odd = docs.limit(60).unionByName(spark.createDataFrame([(None, None, None, None, None), (9_999_999, "", "en", None, 0)], docs.schema)).coalesce(1)
    for _, stage in corpus_pipeline.STAGES:
        odd = common.stored(stage(spark, odd, DATA), "odd")
    assert odd.where("doc_id IS NULL").count() == 1 and odd.where("doc_id = 9999999").count() == 1
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = common.stored(stage(spark, none, DATA), "none")
    assert none.count() == 0
