"""The pipeline's near-dedup stage against all pairs: no pair of texts at the similarity or above stays apart."""

import random

import numpy as np
import pytest

pytest.importorskip("tallgrass.llm")

from tallgrass.llm import simhash  # noqa: E402


def plain_roots(texts, n_words=5, least=0.8):
    sets = {}
    for i, text in texts.items():
        own = text.lower().split()
        sets[i] = {tuple(own[j : j + n_words]) for j in range(max(1, len(own) - n_words + 1))}
    root = {i: i for i in texts}
    for b in sorted(sets):
        for a in (i for i in sorted(sets) if i < b):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def roots(spark, texts, **more):
    given = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.root for r in simhash.similar_copies(given, **more).collect()}


def test_pair_apart_from_its_hub(spark):
    hub = [f"w{i}" for i in range(300)]
    one = hub[::-1]
    other = one[:150] + one[151:153] + one[150:151] + one[153:]
    texts = {1: " ".join(hub), 2: " ".join(one), 3: " ".join(other)}
    assert roots(spark, texts) == plain_roots(texts) == {1: 1, 2: 2, 3: 2}


def test_every_pair_at_the_similarity(spark):
    rng = random.Random(5)
    texts = {}
    for n, changes in [(50, 1)] * 40 + [(250, 5)] * 40:
        i = len(texts)
        own = [f"t{i}w{j}" for j in range(n)]
        texts[i] = " ".join(own)
        for at in rng.sample(range(4, n - 4, 9), changes):
            own[at] = f"x{i}w{at}"
        texts[i + 1] = " ".join(own)
    want = plain_roots(texts)
    assert sum(i != r for i, r in want.items()) == 80
    assert roots(spark, texts) == want


def test_long_runs_of_one_shingle(spark):
    common = " ".join(f"c{j}" for j in range(6))
    texts = {i: f"{common} {'' if i % 3 else f'e{i}'}" for i in range(9)} | {10 + i: f"y{i} z {common} z y{i}" for i in range(9)} | {30: "", 31: " \n"}
    assert roots(spark, texts, most=2) == plain_roots(texts)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Candidates stay in proportion to a group's members, and none of them stays apart."""
    rng = random.Random(9)
    base = [f"b{j}" for j in range(120)]
    texts = {}
    for i in range(300):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"  # any two are similar
        texts[i] = " ".join(own)
    compared = []
    exact = simhash.exact_candidates

    def counted(*args):
        compared.append(exact(*args))
        return compared[-1]

    monkeypatch.setattr(simhash, "exact_candidates", counted)
    monkeypatch.setattr(simhash, "MAX_RUN", 16)  # runs in parts
    assert roots(spark, texts, most=16) == plain_roots(texts)
    assert compared[0].count() < 300


def test_large_group_below_the_similarity(spark, monkeypatch):
    """Texts that share most of a text, but are not similar, are told apart before they are pairs."""
    rng = random.Random(3)
    texts = {}
    for i in range(200):
        own = [f"b{j}" for j in range(120)]
        for n, at in enumerate(rng.sample(range(5, 115, 10), 2)):
            own[at] = f"x{i}y{n}"
        texts[i] = " ".join(own)
    near, rest = [], []
    monkeypatch.setattr(simhash, "_near_pairs", lambda *args, plain=simhash._near_pairs: near.append(plain(*args)) or near[-1])
    monkeypatch.setattr(simhash, "exact_candidates", lambda *args, plain=simhash.exact_candidates: rest.append(plain(*args)) or rest[-1])
    assert roots(spark, texts) == plain_roots(texts)
    assert near[0].count() < 800 and rest[0].count() < 800


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    pool = rng.integers(-(2**63), 2**63 - 1, 4000)
    for n in (0, 1, 30, 1000):
        a, b = (np.unique(rng.choice(pool, n)) for _ in range(2))
        bits = np.bitwise_count((simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b)) and simhash.sketch(a).shape == (len(simhash.SKETCH),)


def test_different_texts_of_one_id_stay(spark):
    one, other = (" ".join(f"{c}{j}" for j in range(30)) for c in "ab")
    rows = [(1, one), (1, other), (1, other), (2, one), (3, other)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_similar_copies(given).collect())) == [(1, one), (1, other)]
