"""The Jaccard join against all pairs, with cells crowded at any size and regions divided early."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, WORD, _docs
from walkspark.llm import jaccard, neardup
from walkspark.llm.neardup import shingle_sets


def _plain(rows, words, threshold):
    """{id: (sizes of its sets, smallest id reachable)}, by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and top(i) != top(j) and 100 * common >= threshold * (len(a) + len(b) - common):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets)


def _texts(seed=51):
    """Families around the threshold, passages that many share, documents of little else, copies and long texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(40)] for _ in range(3)]
    texts = [None, "", " \t", "one", "One", "a b c d", "a B c d", "a b c d e", "x " * 3000]
    for _ in range(14):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            w = [x if rng.random() > rng.choice([0.0, 0.01, 0.02, 0.05]) else word() for x in base]
            texts.append(" ".join(w[rng.randrange(3) :]))
    for _ in range(40):
        texts.append(" ".join(rng.choice(passages) + [word() for _ in range(rng.choice([0, 2, 8, 30, 100]))]))
    for _ in range(6):
        texts.append(" ".join(sum(rng.sample(passages, 2), [])))
    family = [word() for _ in range(60)]
    for k in range(40):  # a chain: each is near the next
        family[k] = word()
        texts.append(" ".join(family))
    texts += [texts[20]] * 5 + [" ".join(word() for _ in range(4000))] * 2
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("crowd, leaf, words, threshold", [(64, 1024, 5, 80), (2, 4, 5, 80), (1, 4, 3, 85), (4, 1000, 5, 80), (2, 8, 2, 50)])
def test_join_equals_all_pairs(spark, monkeypatch, crowd, leaf, words, threshold):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    texts = _texts()
    df = _docs(spark, texts).withColumns({c: F.lit("x") for c in ("id", "key", "n", "component", "c", "h", "set_key", "region")})
    got = jaccard.jaccard_join(df, words=words, threshold=threshold)
    assert got.columns == ["doc_id", "n_shingles", "set_id", "component_id"]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == _plain(list(enumerate(texts)), words, threshold)


def test_repeated_ids_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 1)
    texts = _texts(52)
    rows = [(i % 60, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows] + [(None, texts[5], None), (None, "lone words", None)], DOC)
    plain = _plain([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    parent = {i: i for i in range(60)}  # rows of one id are one document

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, _, c in plain:
        x, y = sorted((top(rows[k][0]), top(rows[c][0])))
        parent[y] = x
    want = sorted((rows[k][0], n, top(rows[k][0])) for k, n, _ in plain)
    got = jaccard.jaccard_join(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


def test_join_of_nothing(spark):
    df = _docs(spark, ["a b c d e f"])
    assert jaccard.jaccard_join(df.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_join(df).collect()] == [(0, 2, 0, 0)]


def test_linked_sets_share_a_key():
    for n in range(1, 400):
        for threshold in (50, 80, 85, 100):
            need = -(-threshold * n // 100)
            assert jaccard.prefix_length(n, threshold) + need == n + 1


def test_components_are_not_worked_out_again_without_new_links(spark, monkeypatch):
    calls = []
    real = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: calls.append(1) or real(edges))
    rng = random.Random(52)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join([*base[:30], "other", *base[30:]])]
    df = _docs(spark, texts)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect())
    assert got == _plain(list(enumerate(texts)), 5, 80) and len(calls) <= 3


def test_long_shingles_come_first():
    texts = pa.array(["of the in a to " * 3 + "considerable manufacturing possibilities notwithstanding circumstances " + "and so it is on " * 3, "one two", "one", "", None])
    found = list(jaccard._ordered_sets(texts, 5))
    assert [len(x) for x in found] == [len(x) for x in shingle_sets(texts, 5)] and all((x[1:] > x[:-1]).all() for x in found)
    long = next(jaccard._ordered_sets(pa.array(["considerable manufacturing possibilities notwithstanding circumstances"]), 5))
    assert found[0][0] == long[0]


def _cluster_sizes(spark, monkeypatch, texts):
    """Documents in the clusters of crowded cells, and whether the join equals all pairs."""
    seen = []
    real = jaccard.regions
    monkeypatch.setattr(jaccard, "regions", lambda clusters, *rest: seen.append(clusters.count()) or real(clusters, *rest))
    got = jaccard.jaccard_join(_docs(spark, texts))
    return seen[0], sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == _plain(list(enumerate(texts)), 5, 80)


def test_holders_of_a_passage_are_not_all_compared(spark, monkeypatch):
    """A crowded cell holds documents of all sizes; only those near the size of one that has nothing else are gone through."""
    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "TURNS", 1)
    rng = random.Random(53)
    passage = [f"w{rng.randrange(3000)}" for _ in range(40)]
    texts = [" ".join(passage[k:]) for k in range(8)]
    texts += [" ".join(passage + [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 250))]) for _ in range(60)]
    size, equal = _cluster_sizes(spark, monkeypatch, texts)
    assert equal and 8 <= size < 40


def test_pairs_of_blocks_go_in_rounds(spark, monkeypatch):
    """However many blocks a cluster has, a round's shuffle holds no more than the cluster's sets, or ROUND."""
    labels, real = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, label, *a: labels.append(label) or real(df, label, *a))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "ROUND", 100, raising=False)
    rng = random.Random(54)
    base = [f"w{rng.randrange(3000)}" for _ in range(60)]
    texts = [" ".join(x if rng.random() > 0.02 else f"w{rng.randrange(3000)}" for x in base) for _ in range(60)]
    df = _docs(spark, texts).selectExpr("doc_id as id", "text")
    clusters = df.selectExpr("id", "0L as component")
    links = neardup._crowded_links(clusters, clusters.limit(0), df.selectExpr("id", "56L as n"), df, 5, 80)
    got = {r["id"]: r["component"] for r in neardup.components(links).collect()}
    assert [(i, got.get(i, i)) for i in range(60)] == [(i, c) for i, _, c in _plain(list(enumerate(texts)), 5, 80)]
    assert labels.count("neardup-round") > 1


def test_components_of_few_and_many_edges_agree(spark, monkeypatch):
    rng = random.Random(55)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(400, 450)]
    edges = spark.createDataFrame(rows, "a long, b long")
    few = sorted(tuple(r) for r in neardup.components(edges).collect())
    monkeypatch.setattr(neardup, "FEW", -1, raising=False)
    assert few and few == sorted(tuple(r) for r in neardup.components(edges).collect())
