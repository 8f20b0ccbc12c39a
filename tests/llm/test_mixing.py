"""Context mixing: the base figures against brute force, and what makes a score a probability."""

import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tallgrass.llm")

from tallgrass.llm import mixing  # noqa: E402


def plain(rows, held):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in rows]
    counts = Counter(w for i, own in texts if not held(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in texts:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        yield i, held(i), len(own), sum(counts[w] > 0 for w in own), n, base


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_query(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 10_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {w[0]: w for w in plain(rows, held)}
    got = mixing.op6_context_mixing(spark, small).collect()
    assert len(got) == len(rows)
    sizes = {i: len((t or "").encode()) for i, t in rows}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:5]
        assert abs(r.base_score - want[r.doc_id][5]) < 1e-6 * max(1, abs(r.base_score))
        assert r.score < 0
        assert r.bits_per_byte == (pytest.approx(-r.score / math.log10(2) / sizes[r.doc_id]) if sizes[r.doc_id] else None)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "É a ß A " * 300, 1), (3, "É a ß A " * 300, 1), (None, "no id", 1), (6, "\x00 \x1c ü", 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = mixing.score_texts(given, F.lit(True)).collect()
    want = sorted(plain([r[:2] for r in rows], lambda i: False), key=str)
    assert [(r.doc_id, r.n_tokens, r.n_known) for r in sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens))] == sorted(((w[0], w[2], w[3]) for w in want), key=lambda w: (str(w[0]), w[1]))
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert all(np.isfinite(r.score) for r in mixing.score_texts(given, F.lit(False)).collect())
    assert mixing.score_texts(given.limit(0), F.lit(True)).count() == 0


def test_unseen_words_of_any_length_have_finite_scores(spark):
    rows = [(i, "some words that come again and again") for i in range(20)] + [(21, "q" * 10_000), (22, ("x" * 400 + " ") * 3000), (23, "words " * 5000 + "z" * 300)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in mixing.score_texts(given, F.col("doc_id") < 20).collect()}
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.bits_per_byte) for r in got.values())
    assert got[21].score < got[23].score / 5001


def test_scores_do_not_depend_on_partitions(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1 << 12)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id at all"), (None, "no id at all"), (5, None), (7, "word " * 40_000)], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionByName(odd)
    scored = [sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in mixing.score_texts(df, F.coalesce(F.col("doc_id") % 3, F.lit(0)) != 1).collect())) for df in (given.coalesce(1), given.repartition(8), given.orderBy(F.desc("doc_id")))]
    for other in scored[1:]:
        np.testing.assert_allclose(np.array(scored[0]), np.array(other), rtol=1e-9, atol=0)


def mixings(texts, train, blocks=3, per_chunk=1000):
    """Every chunk's tokens with their statistics, without Spark."""
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(train), pa.array(texts), pa.array([i // per_chunk for i in range(len(texts))])], names=["i", "train", "t", "chunk"])
    chunks = list(mixing._coded(given.slice(i, 8) for i in range(0, len(texts), 8)))
    groups = defaultdict(list)
    for out in mixing._keyed(blocks)(iter(chunks)):
        for r in out.to_pylist():
            groups[r["kind"], r["block"]].append(r)
    stats = []
    for (kind, block), rows in groups.items():
        own = pa.Table.from_pylist(rows, schema=mixing.KEYED_SCHEMA)
        stats += mixing.block_stats((pa.scalar(kind), pa.scalar(block)), own).to_pylist()
    counts = np.zeros(mixing.TABLE_SIZE, np.int64).reshape(-1, mixing.TABLE_BLOCK)
    for r in stats:
        if r["kind"] == mixing.TABLE:
            counts[r["block"]] = mixing.unpacked(r["total"], "<i8")
    once = [w for r in stats if r["kind"] == mixing.ONCE for w in mixing.expanded(r["total"]).split(b"\n") if w]
    for chunk in chunks:
        row = chunk.to_pylist()[0]
        yield mixing.Mixing(row, [s for s in stats if s["chunk"] == row["chunk"]], mixing.Dense(counts.ravel())), once


def rounded(n, steps):
    return max(int(s) for s in steps if s <= n)


def brute(texts, train, weights):
    """The mixed probability of every token by counting prefixes in dictionaries."""
    tokens = [[*t.lower().split(), ""] for t in texts]
    code = lambda w: format(xxhash.xxh3_64_intdigest(w.encode()) >> 44, "020b")

    def gate(words):
        for w in reversed(words):
            for c in reversed(w):
                if (raw := c.encode())[0] >= 0xC0:
                    return int(mixing.FAMILIES[raw[0] & 63, raw[1] & 63])
        return 0

    def contexts(words, i):
        before = [code(w) for w in reversed(words[:i])]
        return [("none",), ("gate", gate(words[:i])), ("one", before[0][:10] if before else "0" * 10), ("two", *before[:2])]

    seen, exact = Counter(), Counter()
    for words, learns in zip(tokens, train, strict=True):
        for i, w in enumerate(words) if learns else ():
            exact[w] += 1
            for c in contexts(words, i):
                for k in range(21):
                    seen[c, code(w)[:k]] += 1
    for words, learns in zip(tokens, train, strict=True):
        for i, w in enumerate(words):
            if exact[w] <= learns:
                yield -math.inf
                continue
            own, total = code(w), math.log(exact[w] / seen[("none",), code(w)])
            for k in range(20):
                flipped = own[:k] + "10"[int(own[k])]
                if not seen[("none",), flipped]:
                    continue
                z, kinds = [], []
                for j, c in enumerate(contexts(words, i)):
                    steps = mixing.COARSE if j == 3 else mixing.STEPS
                    same, other = max(0, rounded(seen[c, own[: k + 1]], steps) - learns), rounded(seen[c, flipped], steps)
                    used = j in (0, 3) or (j == 1 and k < 16) or (j == 2 and k < 11)
                    z.append(min(8, max(-8, math.log((same + 0.3) / (other + 0.3)))) * used)
                    n = same + other
                    kinds.append((0 if n == 0 else 4 if min(same, other) else 1 if n == 1 else 2 if n < 4 else 3) * used)
                z = float(np.dot(weights[k, kinds[3] * 5 + kinds[2]].astype(float), z))
                total -= math.log1p(math.exp(-min(20, max(-20, z))))
            yield total


def test_mixed_probabilities_against_counting(monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 1500)
    rng = np.random.default_rng(3)
    vocabulary = [*"abcdefgh", "éa", "ñu", "žx", *(f"w{i}" for i in range(60))]
    texts = [" ".join(vocabulary[min(len(vocabulary) - 1, int(rng.exponential(12)))] for _ in range(int(rng.integers(0, 60)))) for _ in range(40)]
    texts += [texts[5], texts[6] + " new", ""]
    train = [i % 5 != 1 for i in range(len(texts))]
    weights = mixing.first_weights() + rng.normal(0, 0.1, mixing.first_weights().shape).astype(np.float32)
    parts = list(mixings(texts, train, per_chunk=24))
    assert len(parts) == 2
    got = np.concatenate([m.known(weights, learning=False) for m, _ in parts])
    assert np.allclose(got, list(brute(texts, train, weights)), rtol=1e-4, atol=1e-4)
    tokens = Counter(w for t, learns in zip(texts, train, strict=True) if learns for w in t.split())
    assert sorted(w[1:].decode() for w in parts[0][1]) == sorted(w for w, n in tokens.items() if n == 1)


def test_mixed_probabilities_add_up_to_one():
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(300)]
    learnt = [" ".join(vocabulary[min(299, int(rng.exponential(40)))] for _ in range(50)) for _ in range(30)]
    known = sorted({w for t in learnt for w in t.split()})
    texts = [*learnt, *(f"v1 v2 {w}" for w in known), "v1 v2"]
    ((own, _),) = mixings(texts, [True] * 30 + [False] * (len(known) + 1))
    logs = own.known(mixing.first_weights(), learning=False)
    last = own.seq.begins + 2  # the word after "v1 v2", or the end
    assert abs(np.exp(logs[last[30:]]).sum() - 1) < 1e-3


def test_learning_helps():
    texts = ["one two three four five six"] * 8 + ["six one five two four three"] * 8
    first, weights = mixing.first_weights(), mixing.first_weights()
    ((own, _),) = mixings(texts, [True] * 16)
    for _ in range(20):
        ((again, _),) = mixings(texts, [True] * 16)
        again.known(weights)
    ((again, _),) = mixings(texts, [True] * 16)
    assert again.known(weights, learning=False).sum() > own.known(first, learning=False).sum()
    assert not np.array_equal(weights, mixing.first_weights())


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (mixing.CONTEXTS, 1 << mixing.SLOTS_LOG2, 2)).astype(np.int32)
    weights = rng.normal(0.3, 0.2, (mixing.SETS, mixing.CONTEXTS + 1)).astype(np.float32)
    predictors = mixing.Predictors(counts, False)
    others = [bytes([b]) for b in range(256) if b != 0x20]
    short = 10 ** mixing.spelled(predictors, weights, [b"", *others], np.zeros(256, np.int64))
    # What begins with a byte and goes on with any, against that byte alone: all two-byte words and the one-byte word.
    pairs = [a + b for a, b in itertools.product(others[:3], others)]
    both = 10 ** mixing.spelled(predictors, weights, pairs, np.zeros(len(pairs), np.int64))
    assert short.sum() + both.sum() < 1
    learned = weights.copy()
    words = [b"abab", b"abba", b"baab"] * 200
    apart = mixing.Predictors(counts, True)
    for _ in range(20):
        mixing.learn(apart, learned, words, np.zeros(len(words), np.int64), 1.0)
    at = lambda w: mixing.spelled(predictors, w, words[:3], np.zeros(3, np.int64)).sum()
    assert at(learned) > at(weights)


def test_blend_uses_only_earlier_tokens():
    rng = np.random.default_rng(2)
    parts = np.log(rng.random((500, 3)) / 3)
    sizes = np.array([200, 0, 300])
    whole = mixing.blended(parts, sizes, (0.3, 0.5, 0.2))
    parts2 = parts.copy()
    parts2[199] = math.log(0.001)
    again = mixing.blended(parts2, sizes, (0.3, 0.5, 0.2))
    assert whole[1] == 0 and whole[2] == again[2] and whole[0] != again[0]
    assert abs(mixing.blended(parts[:32], np.array([32]), (0.3, 0.5, 0.2))[0] - np.log10(np.exp(parts[:32]) @ [0.3, 0.5, 0.2]).sum()) < 1e-9


def test_every_chunk_learns(spark, monkeypatch):
    """Weights come from all training tokens, not from those of some chunks."""
    sums = []
    monkeypatch.setattr(mixing, "_averaged", lambda given, first, plain=mixing._averaged: sums.append(given) or plain(given, first))
    monkeypatch.setattr(mixing, "CHUNK_BYTES", 2000)
    rows = [(i, " ".join(f"w{(7 * i + j) % 50}" for j in range(60)), i % 4 > 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    found = mixing.score_texts(docs, F.col("learn")).collect()
    assert len(found) == 80
    assert sums[-1].filter("at = 0").agg(F.sum("n")).first()[0] == found[0].train_tokens == 60 * 61


def test_weights_without_scoring():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(rng.exponential(9))}" for _ in range(50)) for _ in range(300)]
    one, other = mixing.first_weights(), mixing.first_weights()
    train = [i % 3 > 0 for i in range(300)]
    for weights, scoring in ((one, True), (other, False)):
        for own, _ in mixings(texts, train):
            own.known(weights, scoring=scoring)
    assert np.array_equal(one, other) and not np.array_equal(one, mixing.first_weights())


def test_tokens_alike_are_scored_once(monkeypatch):
    texts = ["a b c a b d"] * 200 + ["a b c x"] * 10
    sizes = []
    plain = mixing.Mixing._score_bit
    monkeypatch.setattr(mixing.Mixing, "_score_bit", lambda self, level, weights, given, *rest: sizes.append(len(given[0])) or plain(self, level, weights, given, *rest))
    [(own, _)] = mixings(texts, [i % 5 > 0 for i in range(len(texts))])
    own.known(mixing.first_weights(), learning=False)
    assert max(sizes) <= 2 * 9  # different tokens after different ones, in training or not


def test_shuffle_files_go_with_the_query(spark):
    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(f.getName().startswith("shuffle_") for f in map(manager.getAllFiles().apply, range(manager.getAllFiles().size())))

    rows = spark.range(1000).repartition(3, "id")
    before = files()
    folder = mixing.stored(rows, "test")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and folder.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
