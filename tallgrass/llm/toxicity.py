"""Toxicity by a convolutional text classifier, trained here in NumPy.

A word's vector is the sum of the hashed embeddings of the word and of its first
4 to 7 bytes. Filters of widths 1, 2 and 3 run over all words of a text, and each
filter's three largest answers (k-max pooling) go to a logistic output. The
gradient reaches only the pooled positions, so training is cheap.

Training takes every labelled row. Rows are dealt into chunks by a hash of their id. Embeddings begin with the smoothed
log-odds of their bucket over all rows. In each of ``ROUNDS`` rounds every chunk goes on from the same model, and what
they change is averaged on the cluster: a bucket's embedding over the batches that moved it, the rest over rows. A tenth
of the rows is kept apart: it shifts the output so that 0.5 is the best threshold over all, and gives a threshold for
each language with enough rows, from counts of logits to 1/64. Language, source and id are no inputs of the score; the
language only chooses the threshold of ``flagged``. The driver holds one model, whatever the input.

Null or empty texts have no words; they get the score of a text without any
answer. Texts of any length are scored whole. Repeated rows are scored each and
count once in training, where an id has one text. An empty table gives no rows, and
without labelled rows every score is that of an untrained output, near 0. Rows are
scored where they lie, without a shuffle.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import id_mod, release, table, text_slices, written
from tallgrass.llm.simhash import likely
from tallgrass.llm.words import ALNUM, Words

BUCKETS_LOG2 = 15
DIM, FILTERS, WIDTHS, POOL = 16, 8, (1, 2, 3), 3
PREFIXES = (4, 5, 6, 7)
#: Labelled rows in a chunk, about; one with more bytes of text is cut.
CHUNK_ROWS, CHUNK_BYTES = 4096, 16 << 20
#: Bytes of text that are split into words at once.
SLICE_BYTES = 1 << 19
ROUNDS, EPOCHS, BATCH, RATE = 2, 2, 64, 0.02
#: Batches in a round at least: few rows are gone over more often.
MIN_BATCHES = 16
#: Buckets in a block of the embeddings, where models are added up.
BLOCK = 512
#: Logits are counted to a step of this, up to so many steps from 0.
LOGIT_STEP, LOGIT_STEPS = 1 / 64, 1 << 12
MIN_FOR_LANGUAGE = 40
#: Rows kept apart without which the output stays as it was learned: a few texts say little about where to cut.
MIN_FOR_CUT = 20


def word_ids(words: Words) -> np.ndarray:
    """Buckets of each word and of its prefixes; one row a word."""
    ends = [words.ends, *(np.minimum(words.starts + p, words.ends) for p in PREFIXES)]
    return np.stack([(words.span_hashes(words.starts, e) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32) for e in ends], 1)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    intercept: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def answers(self, ids: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Pooled answers, a row for each text; the positions they come from (-1: none); the word vectors."""
        vectors = self.embedding[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            vectors = vectors + self.embedding[ids[:, j]]
        pooled, positions = [], []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            n = max(0, len(ids) - width + 1)
            whole = doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)
            at = np.flatnonzero(whole)
            out = np.zeros((n_docs, POOL, FILTERS), np.float32)
            where = np.full((n_docs, POOL, FILTERS), -1, np.int64)
            if len(at):
                h = bias + sum((vectors[o : o + n] @ weights[o] for o in range(width)), np.zeros((1, FILTERS), np.float32))
                h = h[at] if len(at) < n else h
                own = doc[at]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                docs, sizes = own[first], np.diff(first, append=len(own))
                for k in range(POOL):
                    top = np.maximum.reduceat(h, first, axis=0)
                    rows, cols = np.nonzero(h == np.repeat(top, sizes, axis=0))
                    place = np.full(top.shape, -1, np.int64)
                    group = np.repeat(np.arange(len(first)), sizes)[rows]
                    place[group[::-1], cols[::-1]] = rows[::-1]
                    good = np.isfinite(top) & (top > 0)
                    out[docs, k] = np.where(good, top, 0)
                    where[docs, k] = np.where(good, at[place], -1)
                    h[place[place >= 0], np.nonzero(place >= 0)[1]] = -np.inf
            pooled.append(out.reshape(n_docs, -1))
            positions.append(where)
        return np.concatenate(pooled, 1), positions, vectors

    def logits(self, ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        pooled, _, _ = self.answers(ids, doc, n_docs)
        return pooled @ self.output + self.intercept

    def scores(self, texts: list[bytes]) -> np.ndarray:
        words = Words([t.lower() for t in texts], ALNUM)
        return 1 / (1 + np.exp(-np.clip(self.logits(word_ids(words), words.doc, len(texts)).astype(np.float64), -30, 30)))


def gradients(model: Model, ids: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the mean logistic loss of some texts: by output, intercept, filters, biases, and the buckets used with their embeddings' rows."""
    pooled, positions, vectors = model.answers(ids, doc, len(labels))
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.output + model.intercept, -30, 30)))
    error = ((p - labels) / len(labels)).astype(np.float32)
    back = (error[:, None] * model.output).reshape(len(labels), len(WIDTHS), POOL, FILTERS)
    of_filters, of_biases, touched, moves = [], [], [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
    for w, width in enumerate(WIDTHS):
        d, k, f = np.nonzero(positions[w] >= 0)
        at, g = positions[w][d, k, f], back[d, w, k, f]
        gradient = np.zeros_like(model.filters[w])
        of_filter = np.zeros((len(at), FILTERS), np.float32)
        of_filter[np.arange(len(at)), f] = g
        for o in range(width):
            gradient[o] = vectors[at + o].T @ of_filter
            moves.append(g[:, None] * model.filters[w][o].T[f])
            touched.append(at + o)
        of_filters.append(gradient)
        of_biases.append(np.bincount(f, g, minlength=FILTERS).astype(np.float32))
    at, move = np.concatenate(touched), np.concatenate(moves)
    buckets, inverse = np.unique(ids[at], return_inverse=True)
    cells = (inverse.reshape(len(at), -1).T[:, :, None] * DIM + np.arange(DIM)).reshape(ids.shape[1], -1)
    total = sum((np.bincount(c, move.ravel(), minlength=len(buckets) * DIM) for c in cells), np.zeros(len(buckets) * DIM))
    return pooled.T @ error, float(error.sum()), of_filters, of_biases, buckets, total.reshape(-1, DIM).astype(np.float32)


class _Adam:
    def __init__(self, values: np.ndarray):
        self.values, self.m, self.v, self.t = values, np.zeros_like(values), np.zeros_like(values), 0

    def step(self, gradient: np.ndarray, rows: np.ndarray | slice = slice(None), rate: float = RATE) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = 0.999 * self.v[rows] + 0.001 * gradient**2
        self.values[rows] -= rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.999**self.t)) + 1e-8)


def first_model(held: np.ndarray, totals: np.ndarray, seed: int = 7, odds_start: float = 0.3) -> Model:
    """The model that training begins with. With one class only, it gives that class's label everywhere.

    ``held``: in how many texts of either class a bucket occurs; ``totals``: the texts of each. ``odds_start``: how much
    of its log-odds a bucket's embedding begins with.
    """
    rng = np.random.default_rng(seed)
    ratio = np.log((held[1] + 0.5) / (max(1, totals[1]) + 1)) - np.log((held[0] + 0.5) / (max(1, totals[0]) + 1))
    embedding = rng.normal(0, 0.05, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
    embedding[:, 0] += np.where(held.sum(0) < 3, 0, odds_start * ratio)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0])
    model = Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.05, len(WIDTHS) * POOL * FILTERS).astype(np.float32), 0.0)
    if not totals.all():
        model.output[:] = 0
        model.intercept = 20.0 if totals[1] else -20.0
    return model


def learn(model: Model, ids: list[np.ndarray], labels: np.ndarray, rates: list[float], seed: int) -> np.ndarray:
    """Goes over the texts once for each of ``rates``, and changes ``model`` in place. How many batches moved each bucket."""
    rng, moved = np.random.default_rng(seed), np.zeros(1 << BUCKETS_LOG2, np.int64)
    adam = {name: [_Adam(v) for v in values] for name, values in (("f", model.filters), ("b", model.biases), ("o", [model.output]), ("e", [model.embedding]))}
    intercept = _Adam(np.array([model.intercept], np.float32))
    for rate in rates:
        shuffled = rng.permutation(len(ids))
        for batch in (shuffled[i : i + BATCH] for i in range(0, len(shuffled), BATCH)):
            own = np.concatenate([ids[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(ids[i]) for i in batch])
            model.intercept = float(intercept.values[0])
            output, shift, of_filters, of_biases, buckets, rows = gradients(model, own, doc, labels[batch])
            adam["o"][0].step(output + 1e-4 * model.output, rate=rate)
            intercept.step(np.array([shift], np.float32), rate=rate)
            for w in range(len(WIDTHS)):
                adam["f"][w].step(of_filters[w], rate=rate)
                adam["b"][w].step(of_biases[w], rate=rate)
            if len(buckets):
                adam["e"][0].step(rows, buckets, rate=rate / 4)
                moved[buckets] += 1
    model.intercept = float(intercept.values[0])
    return moved


def _small(model: Model) -> np.ndarray:
    """All that is no embedding, in one array."""
    return np.concatenate([*(f.ravel() for f in model.filters), *model.biases, model.output, [model.intercept]]).astype(np.float64)


def _with_small(model: Model, values: np.ndarray) -> None:
    """Puts what ``_small`` gave back into ``model``."""
    parts = np.split(values, np.cumsum([f.size for f in (*model.filters, *model.biases, model.output)]))
    for of, part in zip((*model.filters, *model.biases, model.output), parts, strict=False):
        of[...] = part.reshape(of.shape)
    model.intercept = float(parts[-1][0])


def best_cut(logits: np.ndarray, labels: np.ndarray, costs: tuple[float, float], n: np.ndarray | None = None) -> float:
    """The middle of the widest range of logits with the least cost of (clean flagged, toxic missed). ``n``: texts of each entry, else one."""
    n = np.ones(len(logits)) if n is None else n
    z, which = np.unique(logits, return_inverse=True)
    missed = np.concatenate([[0], np.cumsum(np.bincount(which, n * labels))])
    clean = np.bincount(which, n * (1 - labels))
    flagged = clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    cost = costs[0] * flagged + costs[1] * missed
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


COSTS = (2.0, 1.0)  # a clean text that is flagged weighs more


def language_cut(logits: np.ndarray, labels: np.ndarray, n: np.ndarray) -> float | None:
    """A language's own cut, where it has rows enough of both classes and errs less by it than at 0."""
    if n.sum() < MIN_FOR_LANGUAGE or not 0 < (n * labels).sum() < n.sum():
        return None
    cut = best_cut(logits, labels, COSTS, n)
    wrong = [(n * ((logits > at) != labels)).sum() for at in (0, cut)]
    return cut if abs(cut) > 1e-9 and wrong[0] > wrong[1] else None


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", language_col: str | None = "lang", held_out: int | None = 0) -> DataFrame:
    """``i text label lang`` of all labelled rows, one for each id.

    Ids whose crc32 modulo 5 is ``held_out`` take no part. Of several labels of an id the highest counts.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    language = F.col(language_col) if language_col and language_col in docs.columns else F.lit(None)
    rows = docs
    if held_out is not None:
        known, rows = (x.filter(id_mod(id_col, 5) != held_out) for x in (known, rows))
    known = known.groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), language.cast("string").alias("lang"))
    own_hash = F.unhex(F.md5(F.col("i").cast("string"))).alias("h")
    rows = likely(rows.select("*", own_hash), known.select(own_hash)).drop("h")  # most texts without a label stay out of the shuffle
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label", "lang")).alias("one")  # of an id's texts the same one each time
    return rows.join(known, "i").groupBy("i").agg(one).select("i", "one.text", "one.label", "one.lang")


CHUNK_DDL = "chunk long, part int, texts array<binary>, labels array<int>, langs array<string>, kept array<boolean>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of rows that come sorted by chunk; one with too much text goes into several."""
    number, part, held, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.int32()), *(pa.array([list(x)], pa.list_(kind)) for x, kind in zip(zip(*held, strict=True), (pa.binary(), pa.int32(), pa.string(), pa.bool_()), strict=True))], names=["chunk", "part", "texts", "labels", "langs", "kept"])

    for batch, texts in text_slices(batches, "text"):
        for chunk, *own in zip(batch.column("chunk").to_pylist(), texts, *(batch.column(c).to_pylist() for c in ("label", "lang", "kept")), strict=True):
            if held and (chunk != number or size > CHUNK_BYTES):
                yield row()
                part, held, size = part + 1 if chunk == number else 0, [], 0
            number = chunk
            held.append(tuple(own))
            size += len(own[0])
    if held:
        yield row()


def _texts_of(batches: Iterator[pa.RecordBatch], kept: bool) -> Iterator[tuple[dict, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Each chunk with its texts' buckets, their labels and their places; those kept apart, or the others.

    Texts are split into words a slice at a time, and 10 bytes a word stay of them.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("chunk", "part", "labels", "langs", "kept")}
            at = np.flatnonzero(np.array(row["kept"], bool) == kept)
            if len(at):
                own, ids = pa.record_batch({"text": batch.column("texts")[i].values.take(pa.array(at))}), []
                for _, texts in text_slices(iter([own]), "text", SLICE_BYTES):
                    words = Words([t.lower() for t in texts], ALNUM)
                    ids += np.split(word_ids(words).astype(np.uint16), np.searchsorted(words.doc, np.arange(1, len(texts))))
                yield row, ids, np.array(row["labels"], np.int64)[at], at


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class a bucket occurs; bucket -1 stands for all texts."""
    held, totals = np.zeros((2, 1 << BUCKETS_LOG2), np.int64), np.zeros(2, np.int64)
    for _, ids, labels, _ in _texts_of(batches, False):
        for own, label in zip(ids, labels.tolist(), strict=True):
            held[label, np.unique(own)] += 1
            totals[label] += 1
    for label in (0, 1):
        some = np.flatnonzero(held[label])
        buckets, n = np.append(some, -1), np.append(held[label, some], totals[label])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), label, np.int32)), pa.array(buckets.astype(np.int32)), pa.array(n)], names=["label", "bucket", "n"])


def _changes(before: Model, after: Model, moved: np.ndarray, n_texts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """By block what changed, times its weight, and the weights. Block -1 is all but the embeddings."""
    yield -1, ((_small(after) - _small(before)) * n_texts).astype(np.float32).tobytes(), np.full(1, n_texts, np.float32).tobytes()
    change = ((after.embedding - before.embedding) * moved[:, None]).astype(np.float32)
    for block in range(len(moved) // BLOCK):
        own = slice(block * BLOCK, (block + 1) * BLOCK)
        if moved[own].any():
            yield block, change[own].tobytes(), moved[own].astype(np.float32).tobytes()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come sorted by block, one block in memory at a time."""
    block, sums = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=["block", "change", "weight"])

    for batch in batches:
        for own, *given in zip(*(batch.column(c).to_pylist() for c in ("block", "change", "weight")), strict=True):
            values = [np.frombuffer(x, np.float32).astype(np.float64) for x in given]
            if own != block and block is not None:
                yield row()
            sums = [a + b for a, b in zip(sums, values, strict=True)] if own == block else values
            block = own
    if block is not None:
        yield row()


def _round(model: Model, chunks: DataFrame, rates: list[float]) -> Model:
    """``model`` after every chunk has gone on from it, with their changes averaged."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, labels, _ in _texts_of(batches, False):
            own = copy.deepcopy(shared.value)
            moved = learn(own, ids, labels, rates, row["chunk"] * 1000 + row["part"])
            for block, change, weight in _changes(shared.value, own, moved, len(labels)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([row["part"]], pa.int32()), pa.array([change], pa.binary()), pa.array([weight], pa.binary())], names=["block", "chunk", "part", "change", "weight"])

    changes = chunks.mapInArrow(run, "block int, chunk long, part int, change binary, weight binary")
    added = changes.repartition("block").sortWithinPartitions("block", "chunk", "part").mapInArrow(_added, "block int, change binary, weight binary")
    out = copy.deepcopy(model)
    for r in added.collect():  # one model in all
        change, weight = np.frombuffer(r.change, np.float64), np.frombuffer(r.weight, np.float64)
        if r.block < 0:
            _with_small(out, _small(model) + change / weight)
        else:
            out.embedding[r.block * BLOCK : (r.block + 1) * BLOCK] += (change.reshape(BLOCK, DIM) / np.maximum(weight, 1)[:, None]).astype(np.float32)
    return out


def _calibrated(model: Model, chunks: DataFrame) -> Model:
    """``model`` with its output shifted, and languages' thresholds, as the texts kept apart ask for."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, labels, at in _texts_of(batches, True):
            logits = np.array([shared.value.logits(own, np.zeros(len(own), np.int64), 1)[0] for own in ids])
            steps = np.clip(np.round(logits / LOGIT_STEP), -LOGIT_STEPS, LOGIT_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row["langs"][i] or "" for i in at.tolist()], pa.string()), pa.array(labels.astype(np.int32)), pa.array(steps)], names=["lang", "label", "step"])

    counted = written(chunks.mapInArrow(run, "lang string, label int, step int").groupBy("lang", "label", "step").agg(F.count("*").alias("n")), "logits")
    rows = counted.groupBy("label", "step").agg(F.sum("n").alias("n")).orderBy("step", "label").collect()  # two for a step, at most
    step, label, n = (np.array([r[c] for r in rows], np.int64) for c in ("step", "label", "n"))
    if len(set(label.tolist())) < 2 or n.sum() < MIN_FOR_CUT:
        return model
    shift = best_cut(step * LOGIT_STEP, label, COSTS, n)

    def cut_of(key: tuple, given: pa.Table) -> pa.Table:
        step, label, n = (given[c].to_numpy() for c in ("step", "label", "n"))
        cut = language_cut(step * LOGIT_STEP - shift, label, n)
        return pa.table({"lang": [key[0].as_py()], "cut": pa.array([cut], pa.float64())})

    out = copy.deepcopy(model)
    out.intercept -= shift
    for r in counted.groupBy("lang").applyInArrow(cut_of, "lang string, cut double").filter("cut is not null").collect():
        out.thresholds[r.lang] = float(1 / (1 + np.exp(-r.cut)))
    return out


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7, odds_start: float = 0.3, **options) -> Model:  # noqa: ANN003
    """A model that has learned from every labelled row."""
    known = training_rows(docs, labels, **options)
    n_chunks = max(1, -(-labels.count() // CHUNK_ROWS))
    dealt = known.withColumn("chunk", F.pmod(F.xxhash64("i"), F.lit(n_chunks))).withColumn("kept", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(10)) == 0)
    packed = dealt.repartition("chunk").sortWithinPartitions("chunk", "i").select("chunk", "text", "label", "lang", "kept")
    chunks = written(packed.mapInArrow(_chunks, CHUNK_DDL), "labelled")
    release(docs.sparkSession)
    held, totals = np.zeros((2, 1 << BUCKETS_LOG2)), np.zeros(2)
    for r in chunks.mapInArrow(_held, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # two a bucket, at most
        if r["bucket"] < 0:
            totals[r["label"]] = r["n"]
        else:
            held[r["label"], r["bucket"]] = r["n"]
    model = first_model(held, totals, seed, odds_start)
    if not totals.all():
        return model
    epochs = max(EPOCHS, -(-MIN_BATCHES // -(-int(totals.sum()) // (n_chunks * BATCH))))
    rates = RATE * (1 - np.arange(ROUNDS * epochs) / (ROUNDS * epochs))
    for own in rates.reshape(ROUNDS, epochs).tolist():
        model = _round(model, chunks, own)
        release(docs.sparkSession)
    return _calibrated(model, chunks)


def score(docs: DataFrame, model: Model, text_col: str = "text", language_col: str | None = "lang", prefix: str = "") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (score >= 0.5) and ``flagged`` (score >= its language's threshold).

    ``prefix`` is put before the three names. Columns of ``docs`` with these names give way.
    """
    names = [f"{prefix}{n}" for n in ("score", "predicted", "flagged")]
    out = docs.drop(*names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in text_slices(batches, text_col, SLICE_BYTES):
            scores = model.scores(texts)
            spoken = batch.column(language_col).to_pylist() if language_col in batch.schema.names else [None] * len(texts)
            cuts = np.array([model.thresholds.get(x or "", 0.5) for x in spoken])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(scores >= cuts)], names=[*batch.schema.names, *names])

    return out.mapInArrow(run, f"{ddl}, `{names[0]}` double, `{names[1]}` int, `{names[2]}` boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "flagged")
