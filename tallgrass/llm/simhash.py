"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is a ring of ``m`` segments. If two fingerprints differ in at most
``t`` bits, then from some segment on, every chain of the next l segments differs
in at most l*t/m bits. With m = 4 and t = 3 that is: a first segment without a
difference, two segments with one at most, three with two at most. So

1. every distinct fingerprint is listed under keys that hold the chain of two:
   the first segment as it is, the second with up to one flipped bit;
2. rows are dealt out by key and sorted, and each task reads its runs of equal
   keys; inside a run, pairs must pass every longer chain's budget, the last of
   which is the full Hamming check;
3. a run gives not all pairs but a tree for each of its components, so its output
   grows with its members and not with their square;
4. a run of more than ``MAX_RUN`` members is passed on under finer keys: of eight
   parts of the bits that its key leaves open, five at least must be equal. Such a
   key holds all but 12 bits, which bounds its run.

Trees are joined to components by ``connected_components``. Copies share one
fingerprint and count once all the way; they come back in the last join.

Null texts have no words and fingerprint zero, which links like any other.
Rows with a null id keep their row; they never name a component.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import checkpointed, release, table, text_slices, written
from tallgrass.llm.components import connected_components
from tallgrass.llm.words import mixed

BITS = 64
SEGMENTS = 4
SEED = 42
MAX_RUN = 4096
#: So many rows before it each row of a run is paired with, at most, before all pairs are.
PLACES = 64
FINER_PARTS = 8
#: Shingles that come so often in a chunk of rows are common; and at most so many are.
COMMON_LEAST, COMMON_MOST = 4, 1 << 17
BLOOM_BITS = 1 << 26
#: Tasks that fill the filter, at most: ids only go through them, and the driver takes the filters one by one.
FILTER_TASKS = 24
#: A set's sketch, in bits (a power of two) and in columns of 64.
SKETCH_BITS = 512
SKETCH = tuple(f"sketch{i}" for i in range(SKETCH_BITS // 64))


def shingle_hashes(words: list[bytes], n_words: int) -> list[int]:
    h = xxhash.xxh64_intdigest
    if len(words) < n_words:
        return [h(b" ".join(words), SEED)] if words else []
    return [h(b" ".join(shingle), SEED) for shingle in zip(*(words[i:] for i in range(n_words)), strict=False)]


def fingerprint(text: bytes, n_words: int = 3) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes."""
    hashes = np.array(shingle_hashes(text.lower().split(), n_words), "<u8")
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([fingerprint(t, n_words) for t in texts], pa.int64())], names=[id_col, "fp"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def chain_keys(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (start, first segment, second segment with its flips) and the index of each one's fingerprint."""
    width = BITS // SEGMENTS
    flips = np.array([sum(1 << b for b in bits) for n in range(2 * max_bits // SEGMENTS + 1) for bits in itertools.combinations(range(width), n)], np.uint64)
    keys = []
    for start in range(SEGMENTS):
        head = _turned(fps, start) >> np.uint64(BITS - 2 * width)
        keys.append((np.uint64(start) << np.uint64(2 * width)) | (head[:, None] ^ flips[None, :]))
    out = np.stack(keys, 1).reshape(len(fps), -1)
    return out.ravel(), np.repeat(np.arange(len(fps)), out.shape[1])


def _turned(fps: np.ndarray, start: int) -> np.ndarray:
    """The ring turned so that segment ``start`` is in the highest bits."""
    by = np.uint64(start * BITS // SEGMENTS)
    return (fps << by) | (fps >> (np.uint64(BITS) - by)) if start else fps


def _close(one: np.uint64, others: np.ndarray, start: int | None, max_bits: int) -> np.ndarray:
    """Which of ``others`` pass every chain budget from ``start`` on, ending with the full Hamming check."""
    differ = _turned(one ^ others, start or 0)
    passed = np.ones(len(others), bool)
    if start is not None:
        for length in range(3, SEGMENTS):
            passed &= np.bitwise_count(differ >> np.uint64(BITS - length * BITS // SEGMENTS)) <= length * max_bits // SEGMENTS
    passed[passed] = np.bitwise_count(differ[passed]) <= max_bits
    return passed


def run_trees(members: np.ndarray, start: int | None, max_bits: int) -> Iterator[tuple[int, int]]:
    """(member, parent) for every member but one of each component: close pairs that join it, no more than members."""
    left = np.unique(members)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            parent = queue.pop()
            near = _close(parent, left, start, max_bits)
            found, left = left[near], left[~near]
            queue.extend(found)
            yield from ((x, parent) for x in found)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Sorted rows as (key, members, whole): runs of two members or more; one that is too long comes in parts, not whole."""
    key, parts, size, over = None, [], 0, False
    for batch in batches:
        keys = batch.column("key").to_numpy()
        fps = batch.column("fp").to_numpy().view(np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        inner_sizes = np.diff(edges)
        for j in sorted({0, len(edges) - 2, *np.flatnonzero(inner_sizes > 1).tolist()}) if len(keys) else []:
            if int(keys[edges[j]]) != key:
                if size > 1 or over:
                    yield key, np.concatenate(parts) if parts else np.zeros(0, np.uint64), not over
                key, parts, size, over = int(keys[edges[j]]), [], 0, False
            parts.append(fps[edges[j] : edges[j + 1]])
            size += len(parts[-1])
            if size > most:
                yield key, np.concatenate(parts), False
                parts, size, over = [], 0, True
    if size > 1 or (over and size):
        yield key, np.concatenate(parts), not over


def finer_keys(fps: np.ndarray, keys: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that also hold all but ``max_bits`` of the parts of the bits that a chain key leaves open."""
    width = BITS // 2 // FINER_PARTS
    starts = keys >> np.uint64(BITS // 2)
    turned = np.select([starts == s for s in range(SEGMENTS)], [_turned(fps, s) for s in range(SEGMENTS)])
    out = []
    for parts in itertools.combinations(range(FINER_PARTS), FINER_PARTS - max_bits):
        mask = np.uint64(sum(((1 << width) - 1) << (p * width) for p in parts))
        out.append(mixed(mixed((turned & mask) ^ (mask << np.uint64(32))) ^ keys))
    return np.stack(out, 1).ravel(), np.repeat(np.arange(len(fps)), len(out))


def _tree_edges(keyed: DataFrame, chained: bool, max_bits: int) -> DataFrame:
    """``kind`` 0: a close pair a-b. ``kind`` 1: a member ``a`` of a run that was too long, under its key ``b``."""

    def batch_of(kind: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for key, members, whole in _runs(batches, MAX_RUN if chained else 1 << 62):
            if whole:
                edges += run_trees(members, key >> BITS // 2 & SEGMENTS - 1 if chained else None, max_bits)
            else:
                yield batch_of(1, [(m, key) for m in members.tolist()])
            if len(edges) > 50_000:
                yield batch_of(0, edges)
                edges = []
        yield batch_of(0, edges)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kind int, a long, b long")


def close_pairs(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``a b`` of fingerprints (``fp``, each once) within ``max_bits``: enough of them to join all that are within reach."""
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"the ring of {SEGMENTS} segments serves up to {SEGMENTS - 1} differing bits")

    def keys_of(make, columns: tuple[str, ...]):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                    given = [part.column(c).to_numpy().view(np.uint64) for c in columns]
                    keys, which = make(*given, max_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(given[0][which].view(np.int64))], names=["key", "fp"])

        return run

    found = checkpointed(_tree_edges(fps.select("fp").mapInArrow(keys_of(chain_keys, ("fp",)), "key long, fp long"), True, max_bits))
    long_runs = found.filter("kind = 1").select("a", "b")
    finer = _tree_edges(long_runs.mapInArrow(keys_of(finer_keys, ("a", "b")), "key long, fp long"), False, max_bits)
    return found.filter("kind = 0").unionByName(finer).select("a", "b")


def linked(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``node`` and ``root`` for every fingerprint (``fp``, each once) within reach of another one."""
    return connected_components(close_pairs(fps, max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, max_bits: int = 3) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the smallest id of its component) of every row of ``docs``."""
    own = checkpointed(fingerprints(docs, id_col, text_col, n_words))
    distinct = checkpointed(own.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = linked(distinct, max_bits).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return own.join(named.select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The row with the smallest id of each component; of rows with that same id, any one. Rows without id stay."""
    classes = near_duplicates(docs, id_col, text_col, n_words, max_bits)
    keepers = classes.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(keepers, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def word_sketches(text: bytes, seeds: int) -> list[int]:
    """Fingerprints of a text's set of words, one for each seed, as signed longs; 0 without words."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in sorted(set(text.lower().split()))), np.uint64)
    out = []
    for seed in range(seeds):
        own = mixed(hashes ^ mixed(np.full(1, seed + 1, np.uint64)))
        ones = np.zeros(BITS, np.int64)
        for part in np.array_split(own, len(own) // 65536 + 1):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(own), bitorder="little").tobytes(), "little", signed=True))
    return out


def _shingle_set(text: bytes, n_words: int) -> np.ndarray:
    """Different shingles of a text, sorted, as signed longs."""
    return np.unique(np.array(shingle_hashes(text.lower().split(), n_words), np.uint64)).view(np.int64)


def _common_shingles(rows: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their counts, of bounded size; counts leave out what is rare in a chunk of rows.

    They only order the shingles: any fixed order gives the same pairs, a good one gives few candidates.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            kept = np.flatnonzero(counts >= COMMON_LEAST)
            kept = kept[np.argsort(-counts[kept], kind="stable")[:COMMON_MOST]]
            return pa.RecordBatch.from_arrays([pa.array(values[kept]), pa.array(counts[kept])], names=["s", "n"])

        parts, size = [], 0
        for _, texts in text_slices(batches, "t"):
            parts += [_shingle_set(t, n_words) for t in texts]
            size += sum(map(len, parts[-len(texts) :]))
            if size > 1 << 21:
                yield frequent(parts)
                parts, size = [], 0
        if parts:
            yield frequent(parts)

    found = rows.select("t").mapInArrow(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(COMMON_MOST).toPandas()
    found = found.sort_values("s")
    return found["s"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles, rare ones first: two sets that are similar enough share one of them. Zero stands for no shingle."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64)
    values, counts = common
    rank = np.zeros(n, np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        rank = np.where(values[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))][: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits of a set, as signed longs: each shingle turns one. So two sets differ in as many shingles as their bits, or more."""
    turned = np.bincount(shingles.view(np.uint64) >> np.uint64(65 - SKETCH_BITS.bit_length()), minlength=SKETCH_BITS) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


#: ``size`` holds the size in its high and the place in its low 32 bits.
MEMBER = ("key", "node", "class", "size")


def _may_be_similar(first: np.ndarray, second: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of rows (by place) may be similar, as far as their sketches tell; none that is similar is refused."""
    differ = np.zeros(len(first), np.int64)
    for column in sketches:
        differ += np.bitwise_count((column[first] ^ column[second]).view(np.uint64))
    both = size[first] + size[second]
    return (both - differ) * (1 + similarity) >= 2 * similarity * both - 1e-6


def _run_pairs(run: list[np.ndarray], similarity: float) -> np.ndarray:
    """Node pairs of rows (columns ``MEMBER``, ``SKETCH`` and in cells ``side``, sorted by key, size and node) with one key that can be similar, of different classes and sides.

    Whole runs leave out the pairs of rows up to ``PLACES`` apart, which ``_near_pairs`` has given; cells don't, as rows are nearer there.
    """
    (key, node, own, both), sketches, sides = run[: len(MEMBER)], run[len(MEMBER) :][: len(SKETCH)], run[len(MEMBER) + len(SKETCH) :]
    size, at = both >> 32, both & 0xFFFFFFFF
    out = []
    first, step = np.arange(len(key)), 0
    while len(first):
        step += 1
        first = first[first + step < len(key)]
        second = first + step
        going = (key[first] == key[second]) & (similarity * size[second] <= size[first] + 1e-9)
        first, second = first[going], second[going]
        if not sides and step <= PLACES:
            continue
        shared = np.minimum(size[first] - at[first], size[second] - at[second])
        good = own[first] != own[second]
        for side in sides:
            good &= (side[first] != side[second]) | (side[first] < 0)
        good &= shared * (1 + similarity) >= similarity * (size[first] + size[second]) - 1e-6
        one, other = first[good], second[good]
        good = _may_be_similar(one, other, size, sketches, similarity)
        out.append(np.stack([node[one[good]], node[other[good]]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def _prefix_pairs(members: DataFrame, similarity: float, most: int) -> DataFrame:
    """``kind`` 0: a candidate pair, in the first two columns. ``kind`` 1: a member of a run of more than ``most`` rows."""

    names = members.columns
    kept = (*MEMBER, *SKETCH)

    def batch_of(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(columns[0])
        columns = [*columns[: len(kept)], *[np.zeros(n, np.int64)] * (len(kept) - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, columns)], names=["kind", *kept])

    def closed(rows: list[np.ndarray], over: int | None) -> Iterator[pa.RecordBatch]:
        """Output for whole runs; the run of key ``over`` has begun before and is long already."""
        begins = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        sizes = np.diff(np.r_[begins, len(rows[0])])
        mixed_run = np.minimum.reduceat(rows[2], begins) < np.maximum.reduceat(rows[2], begins)
        long = (sizes > most) | (rows[0][begins] == over if over is not None else False)
        passed = np.repeat(long, sizes)
        yield batch_of(1, [c[passed] for c in rows])
        compared = np.repeat(~long & mixed_run, sizes)
        pairs = _run_pairs([c[compared] for c in rows], similarity)
        yield batch_of(0, [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, over = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [batch.column(c).to_numpy() for c in names]
            rows = given if rows is None else [np.concatenate(c) for c in zip(rows, given, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from closed([c[:cut] for c in rows], over)
                rows, over = [c[cut:] for c in rows], over if over == rows[0][-1] else None
            if len(rows[0]) > most:
                over = int(rows[0][-1])
                yield batch_of(1, rows)
                rows = [c[:0] for c in rows]
        if rows is not None and len(rows[0]):
            yield from closed(rows, over)

    return members.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(run, "kind int, " + ", ".join(f"`{c}` long" for c in kept))


def _mixed_runs(members: DataFrame) -> DataFrame:
    """The members of every run of more than one class, or of one too long to know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, over = None, None

        def passed(given: list[np.ndarray]) -> pa.RecordBatch:
            begins = np.flatnonzero(np.r_[True, given[0][1:] != given[0][:-1]])
            mixed_run = np.minimum.reduceat(given[2], begins) < np.maximum.reduceat(given[2], begins)
            if over is not None:
                mixed_run |= given[0][begins] == over
            kept = np.repeat(mixed_run, np.diff(np.r_[begins, len(given[0])]))
            return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in given], names=MEMBER)

        for batch in batches:
            if not batch.num_rows:
                continue
            given = [batch.column(c).to_numpy() for c in MEMBER]
            rows = given if rows is None else [np.concatenate(c) for c in zip(rows, given, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield passed([c[:cut] for c in rows])
                rows, over = [c[cut:] for c in rows], over if over == rows[0][-1] else None
            if len(rows[0]) > MAX_RUN:
                over = int(rows[0][-1])
                yield passed(rows)
                rows = [c[:0] for c in rows]
        if rows is not None and len(rows[0]):
            yield passed(rows)

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"`{c}` long" for c in MEMBER))


def _near_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a b`` that can be similar, of different classes: at most ``PLACES`` pairs a member, of every run of one key.

    Rows (``MEMBER`` and ``SKETCH``) come by size, and each is paired with those just before it, so pairs stay in proportion to
    rows; where a tenth of a large group's pairs are similar, these are enough to tie most of it together.
    """
    names = (*MEMBER, *SKETCH)

    def pairs_of(rows: list[np.ndarray], done: int) -> pa.RecordBatch:
        """Pairs of the rows from ``done`` on with those before them."""
        (key, node, own, both), sketches = rows[: len(MEMBER)], rows[len(MEMBER) :]
        size, at = both >> 32, both & 0xFFFFFFFF
        second, found = np.arange(done, len(key)), []
        for place in range(1, PLACES + 1):
            second = second[second >= place]
            second = second[(key[second - place] == key[second]) & (similarity * size[second] <= size[second - place] + 1e-9)]
            first = second - place
            shared = np.minimum(size[first] - at[first], size[second] - at[second])
            good = (own[first] != own[second]) & (shared * (1 + similarity) >= similarity * (size[first] + size[second]) - 1e-6)
            one, other = first[good], second[good]
            good = _may_be_similar(one, other, size, sketches, similarity)
            found.append(np.stack([node[one[good]], node[other[good]]], 1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            rows = [np.concatenate([before, batch.column(c).to_numpy()]) for before, c in zip(tail, names, strict=True)]
            yield pairs_of(rows, len(tail[0]))
            tail = [c[-PLACES:] for c in rows]

    return members.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(run, "a long, b long").distinct()


def prefix_sets(rows: DataFrame, texts: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """Every text's ``node``, ``class``, ``size``, ``first`` shingles, of which two similar texts share one, and ``SKETCH``.

    ``rows`` holds the texts ``t`` and their hashes ``h``, ``texts`` each hash's ``node`` and ``class``. Two sets of shingles
    with that Jaccard similarity share one of their first shingles in any common order, as many as ``_prefix`` gives.
    """
    common = rows.sparkSession.sparkContext.broadcast(_common_shingles(rows, n_words))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, given in text_slices(batches, "t"):
            sets = [_shingle_set(t, n_words) for t in given]
            first = [_prefix(s, common.value, similarity) for s in sets]
            sketches = np.stack([sketch(s) for s in sets], 1)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())), *map(pa.array, sketches)], names=["h", "size", "first", *SKETCH])

    prefixes = rows.select("h", "t").mapInArrow(prefixed, "h binary, size long, first array<long>, " + ", ".join(f"{c} long" for c in SKETCH)).dropDuplicates(["h"])
    return prefixes.join(texts.select("h", "node", "class"), "h").drop("h")


def prefix_members(sets: DataFrame) -> DataFrame:
    """Rows ``MEMBER``: every text's node and class under each of its first shingles."""
    return sets.select(F.posexplode("first").alias("at", "key"), "node", "class", "size").select("key", "node", "class", (F.shiftleft("size", 32) + F.col("at")).alias("size"))


def exact_candidates(members: DataFrame, similarity: float, most: int = MAX_RUN) -> DataFrame:
    """Pairs ``a b`` of nodes of different classes; no pair of ``similarity`` or more is left out.

    ``members`` are rows ``MEMBER`` and ``SKETCH``. Runs of more than ``most`` members with one first shingle are dealt into cells, two parts of the run each, so that no
    task compares more than two parts.
    """
    found = checkpointed(_prefix_pairs(members, similarity, most))
    long_runs = found.filter("kind = 1").select(*MEMBER, *SKETCH)
    parts = long_runs.groupBy("key").agg(F.ceil(F.count("*") / F.lit(most)).cast("long").alias("parts"))
    dealt = long_runs.join(parts, "key").withColumn("side", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "node", "class", "size", *SKETCH, F.when(F.col("side") == F.col("other"), -1 - F.col("side")).otherwise(F.col("side")).alias("side"))
    finer = _prefix_pairs(cells, similarity, 1 << 62).filter("kind = 0")
    return found.filter("kind = 0").unionByName(finer).select(F.col("key").alias("a"), F.col("node").alias("b")).distinct()


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose hash ``h`` may be among those of ``wanted``, by a Bloom filter of fixed size.

    It keeps texts that nobody asks for out of the shuffle. A full filter lets all rows pass; none that is wanted is lost.
    """

    def places(hashes: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(h[:16] for h in hashes), "<u8").reshape(-1, 2) & np.uint64(BLOOM_BITS - 1)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            at = places(batch.column("h").to_pylist()).ravel()
            np.bitwise_or.at(out, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["bits"])

    filled = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in wanted.select("h").coalesce(FILTER_TASKS).mapInArrow(bits, "bits binary").toLocalIterator():  # a job a task
        filled |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def may_be(hashes: pd.Series) -> pd.Series:
        at = places(hashes.tolist())
        return pd.Series((shared.value[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(1))

    return rows.filter(may_be("h"))


def _copy_classes(docs: DataFrame, id_col: str, text_col: str, n_words: int, similarity: float, seeds: int, max_bits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``i h`` (id and text hash) of every row with an id, and ``h root keeper``: the smallest id of a text's class, and the hash of the text kept of it."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.unhex(F.sha2("t", 256)))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), pa.array([word_sketches(t, seeds) for t in texts], pa.list_(pa.int64()))], names=["i", "h", "fps"])

    own = checkpointed(rows.select("i", "h", "t").mapInArrow(sketched, "i long, h binary, fps array<long>"))
    texts = checkpointed(own.groupBy("h").agg(F.min("i").alias("least"), F.min("fps").alias("fps")).withColumn("node", F.monotonically_increasing_id()))
    nodes = texts.select("node", F.posexplode("fps").alias("seed", "fp"))
    first = checkpointed(nodes.groupBy("seed", "fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, ["seed", "fp"]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    candidates = same
    for seed in range(seeds):
        mine = first.filter(F.col("seed") == seed).select("fp", "first")
        pairs = close_pairs(mine, max_bits)
        ends = pairs.join(mine.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(mine.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        candidates = candidates.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    candidates = checkpointed(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    del nodes, first, same, mine, pairs, ends
    release(docs.sparkSession)

    def shingled(whole: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, given in text_slices(batches, "t"):
                sets = [_shingle_set(t, n_words) for t in given]
                parts = sets if whole else [s[s & 3 == 0] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["node", "n", "s"])

        return run

    def compared(pairs: DataFrame, whole: bool) -> DataFrame:
        """The pairs that are similar enough, or may be by a fourth of their shingles, if the rest were shared as far as it goes."""
        wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(texts.select("h", "node", "least"), "node"))
        one_each = likely(rows, wanted).join(wanted.select("h", "node", F.col("least").alias("i")), ["h", "i"]).dropDuplicates(["h", "i"]).select("node", "t")
        sets = checkpointed(one_each.mapInArrow(shingled(whole), "node long, n int, s array<long>"))
        release(docs.sparkSession)
        both = pairs.join(sets.select(F.col("node").alias("a"), "n", "s"), "a").join(sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("s").alias("o")), "b")
        shared = F.size(F.array_intersect("s", "o"))
        most = shared + F.least(F.col("n") - F.size("s"), F.col("m") - F.size("o"))
        return checkpointed(both.filter(most * (1 + similarity) >= similarity * (F.col("n") + F.col("m")) - 1e-9).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        likely = compared(pairs, False)
        release(docs.sparkSession)
        return compared(likely, True)

    def forest_first(pairs: DataFrame) -> DataFrame:
        """The similar pairs among the given ones, but for those whose ends others join already.

        A pair carries its shingles through a shuffle, so in large groups one pair a node is compared first, and then
        the pairs that are still between two components.
        """
        forest = compared(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), True)
        roots = connected_components(forest)
        release(docs.sparkSession)
        ends = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
        apart = checkpointed(ends.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"))
        return forest.unionByName(verified(apart))

    links = verified(candidates)
    classed = texts.select("h", "node").join(connected_components(links), "node", "left").select("h", "node", F.coalesce("root", "node").alias("class"))
    release(docs.sparkSession)
    sets = written(prefix_sets(rows, classed, n_words, similarity), "sets")
    release(docs.sparkSession)
    runs = written(_mixed_runs(prefix_members(sets)), "runs")
    release(docs.sparkSession)
    sketches = sets.select("node", *SKETCH)
    pairs = checkpointed(_near_pairs(runs.join(sketches, "node"), similarity))  # large groups are tied together before any two members are compared
    release(docs.sparkSession)
    links = checkpointed(links.unionByName(forest_first(pairs)))
    roots = connected_components(links)
    members = runs.select("key", "node", "size").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("class"), "size").join(sketches, "node").select(*MEMBER, *SKETCH)
    release(docs.sparkSession)
    rest = checkpointed(exact_candidates(members, similarity, most))
    release(docs.sparkSession)
    roots = connected_components(links.unionByName(verified(rest)))
    named = texts.select("h", "node", "least").join(roots, "node", "left").select("h", "least", F.coalesce("root", "node").alias("class"))
    least = named.groupBy("class").agg(F.min(F.struct("least", "h")).alias("k"))
    return own.select("i", "h"), named.join(least, "class").select("h", F.col("k.least").alias("root"), F.col("k.h").alias("keeper"))


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, similarity: float = 0.8, seeds: int = 1, max_bits: int = 3, most: int = MAX_RUN) -> DataFrame:
    """``id_col`` and ``root`` of every row with an id: the smallest id of its text's class.

    Classes are joined by equal texts and by pairs whose shingles of ``n_words`` words have a Jaccard similarity of
    ``similarity`` or more. The pigeonring over fingerprints of the texts' word sets, under one seed or several, joins most
    of them by a tree of verified pairs; then every other pair that is similar enough is found by ``exact_candidates``,
    which leaves out only pairs of texts in one class already. Every candidate pair is verified on its shingles.
    Texts without words are equal to each other. Ids must be longs.
    """
    own, classes = _copy_classes(docs, id_col, text_col, n_words, similarity, seeds, max_bits, most)
    return own.join(classes, "h").select(F.col("i").alias(id_col), "root")


def drop_similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, similarity: float = 0.8, seeds: int = 1) -> DataFrame:
    """The row with the smallest id of each class of ``similar_copies``; of equal rows with one id, any one. Rows without id stay.

    Different texts that share an id are told apart by their hash: one goes only if its own class keeps another text.
    """
    _, classes = _copy_classes(docs, id_col, text_col, n_words, similarity, seeds, 3, MAX_RUN)
    own_hash = f"_hash_of_{text_col}_{id_col}"
    hashed = docs.withColumn(own_hash, F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)))
    keepers = classes.filter(F.col("h") == F.col("keeper")).select(F.col("root").alias(id_col), F.col("h").alias(own_hash))
    kept = hashed.join(keepers, [id_col, own_hash], "left_semi").dropDuplicates([id_col, own_hash]).select(docs.columns)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
