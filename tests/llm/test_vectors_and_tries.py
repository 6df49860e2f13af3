"""Whitening, nearest neighbours and the prefix trie against plain Python, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rollbook.llm import nearest, prefix_trie, queries, whitening

VECTORS = "vec_id long, embedding array<float>, whitened string, deviation string, score string, rank string, leaf string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "w", "d", "s", "r", "l") for i, v in rows], VECTORS).repartition(3)


def _whole(v):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]


BAD = [(900, None), (901, [1.0, None, 0.5]), (902, [1.0, float("nan"), 0.5]), (903, [1.0, float("inf"), 0.5]), (904, []), (905, [1.0, 2.0])]


def _plain_whitening(vectors):
    """Exact covariances of distinct vectors by fractions."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
    return n, sums, np.array(cov, dtype=float)


@pytest.mark.parametrize("scale", [1, 40_000_000_000])
def test_whitening_is_that_of_exact_covariances(spark, scale):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(5, 5))
    rows = [(i, [float(scale * c) for c in rng.normal(size=5) @ mix]) for i in range(80)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[5], (None, rows[6][1])]
    df = _vectors(spark, rows + BAD)
    model = whitening.fitted(df, n_components=4)
    vectors = [_whole(v) for _, v in rows]
    n, sums, cov = _plain_whitening(vectors)
    assert (model.n, model.sums) == (n, sums)
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    assert np.allclose(model.explained, value / np.trace(cov), rtol=1e-9)
    assert model.identity_error < 1e-9
    out = whitening.whitened(df, model).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    by_id = {i: _whole(v) for i, v in rows}
    for r in out:
        x = by_id[r["vec_id"]]
        want = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ vector / np.sqrt(value)
        assert np.allclose(np.abs(r["whitened"]), np.abs(want), rtol=1e-6, atol=1e-9)
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r["deviation"] == (exact if exact < 10**38 else None)
        assert r["score"] == "s"


def test_whitening_without_variance_or_rows(spark):
    assert whitening.fitted(_vectors(spark, [])) is None
    assert whitening.fitted(_vectors(spark, BAD[:5])) is None
    df = _vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    model = whitening.fitted(df)
    assert model.n == 1 and model.explained == []
    assert [(r["whitened"], r["deviation"]) for r in whitening.whitened(df, model).collect()] == [([], 0), ([], 0)]
    flat = whitening.fitted(_vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]))  # of rank one
    assert len(flat.explained) == 1 and flat.identity_error < 1e-9


def test_polarisation_gives_every_covariance():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, size=(50, 6))
    sums = x.sum(axis=0)
    centre = (2 * sums + 50) // 100
    squares = whitening._squares(centre)(x)
    got = whitening.covariance(50, [int(s - 50 * c) for s, c in zip(sums, centre)], [int(q) for q in squares])
    assert np.allclose(got, np.cov(x.T, bias=True), rtol=1e-12)


def test_whitening_of_the_given_table(spark, duck):
    rows = queries.QUERIES["op11_polarisation_whitening"](spark, DATA).toPandas()
    table = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    vectors = {i: _whole(v) for i, v in table}
    n, sums, cov = _plain_whitening(vectors.values())
    value, vector = np.linalg.eigh(cov)
    assert len(rows) == 16 * len(vectors) and set(rows["n"]) == {n} and rows["identity_error"].max() < 1e-4
    for c, group in rows.groupby("component"):
        e, v = value[-c], vector[:, -c]
        want = np.array([(np.array(vectors[i]) - np.array(sums) / n) @ v / np.sqrt(e) for i in group["vec_id"]])
        got = group["whitened"].to_numpy()
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert np.allclose(group["explained"], e / np.trace(cov), rtol=1e-9)
    assert all(r.deviation == sum((n * a - s) ** 2 for a, s in zip(vectors[r.vec_id], sums)) for r in rows[rows["component"] == 1].itertuples())


def _plain_nearest(rows, queries_, k):
    x = {i: np.array([np.float32(c) for c in v], float) for i, v in rows}
    out = set()
    for q in queries_:
        scored = sorted((-round(float(x[q] @ v / np.sqrt(x[q] @ x[q]) / np.sqrt(v @ v)), 12), i) for i, v in x.items() if i != q)
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def _searched(df, queries_, **more):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in nearest.nearest(df, queries_, **more).collect()}


def test_search_of_few_rows_is_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(40)] + [(150, [2 * c for c in rows[8][1]])]
    odd = BAD[:5] + [(906, [0.0, 0.0, 0.0, 0.0]), (None, rows[0][1]), rows[3]]
    df = _vectors(spark, rows + odd)
    asked = [i for i, _ in rows if i % 10 == 0]
    assert _searched(df, df.where("vec_id % 10 = 0 OR vec_id IS NULL")) == _plain_nearest(rows, asked, 5)


def test_search_returns_all_where_there_are_few(spark):
    df = _vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert nearest.nearest(df.limit(0), df).count() == 0 and nearest.nearest(df, df.limit(0)).count() == 0
    assert nearest.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_search_through_the_tree_finds_nearly_all(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 40), ("VECTORS", 25), ("QUERIES_AT_ONCE", 7)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 10))
    rows = [(i, [float(c) for c in centres[i % 12] + 0.4 * rng.normal(size=10)]) for i in range(1500)]
    rows += [(5000 + i, rows[50][1]) for i in range(700)]  # a third are copies of one
    df = _vectors(spark, rows)
    asked = [i for i, _ in rows if i % 50 == 0]
    want, got = _plain_nearest(rows, asked, 5), _searched(df, df.where("vec_id % 50 = 0"))
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    copies = {q for q in asked if q >= 5000} | {50}
    assert {r for r in got if r[0] in copies} == {r for r in want if r[0] in copies}


def test_tree_visits_every_leaf_once_best_bin_first():
    unit = np.random.default_rng(3).normal(size=(600, 8))
    unit /= nearest.norms(unit)[:, None]
    tree = nearest.grown(unit, 30)
    order = tree.best_bins(unit[:20], tree.n_leaves)
    assert tree.n_leaves > 10 and all(sorted(row) == list(range(tree.n_leaves)) for row in order)
    assert np.bincount(tree.placed(unit), minlength=tree.n_leaves).min() > 0
    truth = [{"q": i, "score": 0.5, "leaf": int(tree.placed(unit[i : i + 1])[0])} for i in range(20)]
    assert nearest.visits_needed(tree, unit[:20], truth, 1, 0.9) <= 8
    same = nearest.grown(np.ones((50, 3)) / np.sqrt(3), 10)
    assert same.n_leaves == 1


TALK = "conv_id long, turn long, role string, text string, depth string, n_convs string, k1 string"


def _plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0))] for c, ts in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    saved, leaves, children = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in kids)
        leaves[node] = sum(leaves[k] for k in kids) or 1
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = set()
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(rebuilt[c]) == len(node))
        out.add((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TALK).repartition(3)
    out = prefix_trie.trie(df, **more).collect()
    assert len(out) == len({tuple(r) for r in out})
    return {tuple(r) for r in out}


def _talks(seed, n, words, most=12):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("us"), f"{'é' * rng.randrange(2)}{rng.randrange(words)}") for c in range(n) for t in range(rng.randrange(1, most))]
    copies = [(n + k, *r[1:]) for k in range(n // 2) for r in rows if r[0] == 5]  # a third are copies of one
    return rows + copies


@pytest.mark.parametrize(("seed", "more"), [(0, {}), (1, {"least_heavy": 8}), (2, {"least_heavy": 2}), (3, {"least_heavy": 2, "most_heavy": 6})])
def test_trie_is_that_of_plain_python(spark, monkeypatch, seed, more):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 40)
    rows = _talks(seed, 60, 2)
    assert _trie(spark, rows, **more) == _plain_trie(rows)


def test_trie_with_nulls_and_odd_conversations(spark):
    rows = [(1, None, "u", "first"), (1, -3, None, None), (1, 700, "u", "x" * 50_000), (1, 2, "u", "ü"), (None, 0, "u", "lost"), (7, 0, "u", None), (7, 1, None, ""), (8, 0, "u", "only"), (-5, 0, "u", "minus")]
    rows += [(40, t, "u", f"turn {t}") for t in range(900)] + [(41, t, "u", f"turn {t}") for t in range(900)]
    assert _trie(spark, rows) == _plain_trie(rows)


def test_trie_of_repeated_rows_and_of_none(spark):
    rows = [(3, 0, "u", "same")] * 3 + [(5, 0, "u", "same")]
    assert _trie(spark, rows) == _plain_trie(rows)
    assert prefix_trie.trie(spark.createDataFrame([], TALK)).count() == 0


def test_slots_are_a_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, size=(5000, 3))
    slots = prefix_trie.Slots(keys)
    found = slots.find(keys)
    assert sorted(found) == list(range(5000)) and (slots.keys[found] == keys).all()
    assert (slots.find(keys + 1) == -1).all()
    assert (prefix_trie.Slots(keys[:0]).find(keys[:4]) == -1).all()


def test_slots_of_keys_with_one_code(monkeypatch):
    monkeypatch.setattr(prefix_trie, "_codes", lambda keys: keys[:, 0].astype(np.uint64) % np.uint64(3))
    keys = np.stack([np.arange(20), np.arange(20), np.arange(20)], axis=1)
    slots = prefix_trie.Slots(keys)
    assert sorted(slots.find(keys)) == list(range(20)) and (slots.find(keys + 100) == -1).all()


def test_digests_that_clash_are_an_error(spark, monkeypatch):
    real = prefix_trie.prefixes
    monkeypatch.setattr(prefix_trie, "prefixes", lambda df: real(df).withColumn("bytes", F.when(F.col("depth") == 1, F.col("c")).otherwise(F.col("bytes"))))
    with pytest.raises(Exception, match="share a digest"):
        _trie(spark, [(10, 0, "u", "a"), (20, 0, "u", "a")] + [(c, t, "u", "a") for c in (30, 35) for t in range(9)])
