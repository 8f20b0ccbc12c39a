"""The classifier's arithmetic against plain loops, its gradient against differences, and the query against held-out labels."""

import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallgrass.llm")

from tallgrass.llm import toxicity, words  # noqa: E402
from tallgrass.llm.words import ALNUM, Words  # noqa: E402


def plain_logit(model, text):
    """One text, one filter, one window at a time."""
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    vectors = []
    for token in tokens:
        own = Words([token], ALNUM)
        parts = [token, *(token[:p] for p in toxicity.PREFIXES)]
        hashes = [own.span_hashes(np.array([0]), np.array([len(x)]))[0] for x in parts]
        vectors.append(sum(model.embedding[int(h >> np.uint64(64 - toxicity.BUCKETS_LOG2))] for h in hashes))
    out, at = model.intercept, 0
    for width, weights, bias in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True):
        answers = [[float(bias[f] + sum(vectors[i + o] @ weights[o][:, f] for o in range(width))) for i in range(len(tokens) - width + 1)] for f in range(toxicity.FILTERS)]
        for k in range(toxicity.POOL):
            for f in range(toxicity.FILTERS):
                best = sorted(answers[f], reverse=True)
                out += float(model.output[at]) * (max(0.0, best[k]) if k < len(best) else 0.0)
                at += 1
    return out


def test_query_against_a_plain_convolution(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, small).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for r in rows[::3]:
        want = 1 / (1 + math.exp(-plain_logit(model, r.text)))
        assert got[r.doc_id].score == pytest.approx(want, abs=2e-4)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].flagged == (got[r.doc_id].score >= model.thresholds.get(r.lang or "", 0.5))


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.score, known[r.doc_id]) for r in toxicity.op7_toxicity(spark, folder).filter("held_out").collect() if r.doc_id in known]
    toxic, clean = (np.array([s for s, y in held if y == c]) for c in (1, 0))
    assert len(toxic) and (toxic[:, None] > clean).mean() > 0.85 and (clean >= 0.5).mean() < 0.05


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    size = 1 << toxicity.BUCKETS_LOG2
    model = toxicity.Model(rng.normal(0, 0.5, (size, toxicity.DIM)).astype(np.float64), [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], [rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(0, 0.5, len(toxicity.WIDTHS) * toxicity.POOL * toxicity.FILTERS), 0.1)
    words = Words([b"a bad wordy text of some wordy words", b"x", b"", b"one more text with bad endings"], ALNUM)
    ids, labels = toxicity.word_ids(words), np.array([1, 0, 0, 1])

    def loss():
        z = model.answers(ids, words.doc, 4)[0].astype(np.float64) @ model.output + model.intercept
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    output, shift, filters, biases, buckets, rows = toxicity.gradients(model, ids, words.doc, labels)
    checks = [(model.output, output, (5,)), (model.output, output, (40,)), (model.filters[1], filters[1], (1, 3, 2)), (model.filters[2], filters[2], (0, 7, 5)), (model.biases[0], biases[0], (2,))]
    for i in (0, len(buckets) // 2, len(buckets) - 1):
        checks += [(model.embedding, {(int(buckets[i]), d): rows[i, d] for d in range(toxicity.DIM)}, (int(buckets[i]), d)) for d in (0, 9)]
    for values, gradient, at in checks:
        before, step = values[at], 1e-2
        values[at] = before + step
        more = loss()
        values[at] = before - step
        less = loss()
        values[at] = before
        assert gradient[at] == pytest.approx((more - less) / (2 * step), abs=2e-3), at
    before = model.intercept
    model.intercept = before + 1e-2
    more = loss()
    model.intercept = before - 1e-2
    assert shift == pytest.approx((more - loss()) / 2e-2, abs=2e-3)


def test_odd_rows(spark):
    rows = [(i, "clean words here", "en", 1) for i in range(40)] + [(100 + i, "awful nasty words", "en", 1) for i in range(40)] + [(200, None, None, 1), (201, "", "en", 1), (202, "nasty " * 200_000, "en", 1), (200, "awful", "en", 1), (3, "clean words here", "en", 1), (None, "awful nasty", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(100 <= i < 200)) for i in [*range(40), *range(100, 140), 3]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted", "flagged"] and got.count() == len(rows)
    by = {(r.doc_id, (r.text or "")[:5]): r.score for r in got.collect()}
    assert by[202, "nasty"] > 0.5 > by[3, "clean"] and by[200, ""] == by[201, ""]
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs.filter(F.col("doc_id") < 5), empty).collect())


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Far more rows than a chunk holds: a word of few texts anywhere is counted, and chunks add up to one model."""
    monkeypatch.setattr(toxicity, "CHUNK_ROWS", 500)
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    toxic = F.col("doc_id") % 2 == 0
    docs = ids.select("doc_id", F.concat(F.lit("some plain words w"), F.col("doc_id").cast("string"), F.when(toxic, " nasty").otherwise(" kind")).alias("text"), F.lit("en").alias("lang"))
    labels = ids.select("doc_id", toxic.cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels)
    assert rows.count() == labels.filter(toxicity.id_mod("doc_id", 5) != 0).count() > 2 * 2000
    model = toxicity.fit(docs, labels)
    assert np.array_equal(model.embedding, toxicity.fit(docs.repartition(7), labels.repartition(3)).embedding)
    wrong = toxicity.score(docs, model).filter((F.col("predicted") == 1) != toxic)
    assert wrong.count() == 0


def test_memory_of_a_chunk():
    """Splitting a whole chunk's texts at once took over 40 bytes for each of theirs, and tables as long as the chunk stayed."""
    texts = [b"some words of text number %d " % i * 100 for i in range(2000)]
    n = len(texts)
    row = [[0], [0], [texts], [[0, 1] * (n // 2)], [["en"] * n], [[i % 10 == 0 for i in range(n)]]]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_())]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "part", "texts", "labels", "langs", "kept"])
    want = [toxicity.word_ids(Words([texts[i].lower()], ALNUM)) for i in range(0, n, 10)]
    words._POWERS.clear()
    tracemalloc.start()
    _, ids, labels, at = next(toxicity._texts_of(iter([batch]), False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == len(labels) == len(at) == n - n // 10 and peak < 10 * sum(map(len, texts))
    _, ids, _, at = next(toxicity._texts_of(iter([batch]), True))
    assert at.tolist() == list(range(0, n, 10)) and all(np.array_equal(a, b) for a, b in zip(ids, want, strict=True))


def test_cut_of_equal_logits():
    z, y, n = np.array([-1.0, 0.0, 0.0, 2.0]), np.array([0, 0, 1, 1]), np.array([50, 3, 4, 9])
    assert toxicity.best_cut(z, y, (1.0, 1.0), n) == -0.5
    assert toxicity.best_cut(np.repeat(z, n), np.repeat(y, n), (1.0, 1.0)) == -0.5
