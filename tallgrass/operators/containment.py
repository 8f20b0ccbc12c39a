"""Which needles occur in which texts, without looking at every pair.

A needle that occurs in a text's key also occurs, without spaces, in the text's solid form; so it brings all of its
12-character grams along (or, if it is shorter, itself). One gram a needle is its seed: the one that is rarest, so needles
that begin alike are not all met by whatever holds that beginning. Texts are scanned once, as arrays of rolling hashes of
their windows; a window becomes a row only if it may be a seed.

* Needles of a bounded number and size are broadcast whole with their seeds (rarest among the needles). A text's windows
  are looked up and each needle is verified on the spot: nothing is shuffled.
* More needles are told by a Bloom filter of their seeds, of fixed size. Seeds are the grams that are rarest in the texts, by
  counts in a sketch of fixed size. Only ids of windows that pass are shuffled and joined by seed, and pairs are verified in a
  join. A full filter or a coarse sketch costs rows, never pairs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import text as T

GRAM = 12
#: Needles, and characters of them, that are broadcast.
MAX_NEEDLES, MAX_LETTERS = 200_000, 16_000_000
BLOOM_LOG2, SKETCH_LOG2 = 27, 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            values = np.full(2 * n, base, np.uint64)
            values[0] = 1
            _powers[i] = np.cumprod(values, dtype=np.uint64)
    return _powers[0], _powers[1]


def window_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` characters."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(letters) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(len(letters) + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(letters * up[: len(letters)], dtype=np.uint64)]
    x = (sums[size:] - sums[:n]) * down[:n] + np.uint64(size)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hit_length(page_key: Column, page_solid: Column, key: Column, solid: Column) -> Column:
    """Characters of the needle found: by key, else by its solid form if that is long enough, else 0."""
    return F.when((key != "") & page_key.contains(key), F.length(key)).when(T.solid_usable(solid) & page_solid.contains(solid), F.length(solid)).otherwise(0)


class Seeds:
    """Needles by their seeds, for scans."""

    def __init__(self, keys: list[str], solids: list[str], usable: list[bool]):
        self.keys, self.solids, self.usable = keys, solids, usable
        grams = [window_hashes(s, min(GRAM, len(s))) for s in solids]
        known, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(g) for g in grams]]), return_counts=True)
        self.needles: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (solid, own) in enumerate(zip(solids, grams, strict=True)):
            self.needles[min(GRAM, len(solid))][int(own[np.argmin(number[np.searchsorted(known, own)])])].append(i)
        self.sorted = {size: np.sort(np.fromiter(of, np.uint64, len(of))) for size, of in self.needles.items()}
        self.needles = {size: dict(of) for size, of in self.needles.items()}

    def found(self, key: str, solid: str) -> list[tuple[int, int]]:
        """(needle, characters found) of every needle in a text."""
        out = []
        for size, seeds in self.sorted.items():
            windows = window_hashes(solid, size)
            at = np.minimum(np.searchsorted(seeds, windows), len(seeds) - 1)
            for seed in np.unique(windows[seeds[at] == windows]).tolist():
                for i in self.needles[size][seed]:
                    if self.keys[i] in key:
                        out.append((i, len(self.keys[i])))
                    elif self.usable[i] and self.solids[i] in solid:
                        out.append((i, len(self.solids[i])))
        return out


def containment_pairs(pages: DataFrame, needles: DataFrame, max_needles: int | None = None) -> DataFrame:
    """``page_id needle_id score`` of every needle (id, key, solid) that occurs in a page (id, key, solid).

    Needles with a blank key are left out. Repeated rows give their pairs each.
    """
    most = MAX_NEEDLES if max_needles is None else max_needles
    own = needles.filter(F.col("key") != "").select(F.col("id").alias("needle_id"), F.col("key").alias("n_key"), F.col("solid").alias("n_solid"))
    texts = pages.select(F.col("id").alias("page_id"), F.col("key").alias("p_key"), F.col("solid").alias("p_solid"))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("n_key") + F.length("n_solid")), F.lit(0)).alias("letters")).first()
    return _scanned(texts, own) if size.n <= most and size.letters <= MAX_LETTERS else _joined(texts, own)


def _scanned(texts: DataFrame, own: DataFrame) -> DataFrame:
    given = own.withColumn("usable", T.solid_usable(F.col("n_solid"))).toArrow()
    ids = given.column("needle_id").combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast((ids, Seeds(*(given.column(c).to_pylist() for c in ("n_key", "n_solid", "usable")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needle_ids, seeds = shared.value
        for batch in batches:
            rows = [(i, n, s) for i, (key, solid) in enumerate(zip(batch.column("p_key").to_pylist(), batch.column("p_solid").to_pylist(), strict=True)) if solid for n, s in seeds.found(key, solid)]
            if rows:
                page, needle, score = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("page_id").take(page), needle_ids.take(needle), score], names=["page_id", "needle_id", "score"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("page_id", texts), ("needle_id", own)))
    return texts.mapInArrow(run, f"{kinds}, score long")


def _added(partial: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Rows (place, squeezed array) that come to the driver one at a time, of a fixed size each."""
    for row in partial.toLocalIterator():
        yield row.place, np.frombuffer(zlib.decompress(row.data), np.uint8)


def _joined(texts: DataFrame, own: DataFrame) -> DataFrame:
    context = texts.sparkSession.sparkContext

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_LOG2, np.int64)
        for batch in batches:
            for solid in batch.column("p_solid").to_pylist():
                if solid:
                    counts += np.bincount((window_hashes(solid, GRAM) >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zlib.compress(counts.tobytes(), 1)])], names=["place", "data"])

    sketch = np.zeros(1 << SKETCH_LOG2, np.int64)
    for _, data in _added(texts.select("p_solid").mapInArrow(counted, "place long, data binary")):
        sketch += data.view(np.int64)
    rare = context.broadcast(sketch)

    @F.pandas_udf("long")
    def seed_of(solids: pd.Series) -> pd.Series:
        def one(solid: str) -> int:
            own_grams = window_hashes(solid, min(GRAM, len(solid)))
            return int(own_grams.view(np.int64)[np.argmin(rare.value[(own_grams >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)])])

        return solids.map(one)

    seeded = own.select("needle_id", F.least(F.length("n_solid"), F.lit(GRAM)).alias("size"), seed_of("n_solid").alias("seed"))
    sizes = sorted(r["size"] for r in seeded.select("size").distinct().collect())  # at most GRAM rows

    def places(hashes: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << BLOOM_LOG2) - 1)
        return np.stack([hashes & low, hashes >> np.uint64(64 - BLOOM_LOG2)])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_LOG2, bool)
        for batch in batches:
            bits[places(batch.column("seed").to_numpy().view(np.uint64)).ravel()] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], names=["place", "data"])

    bloom = np.zeros(1 << BLOOM_LOG2 - 3, np.uint8)
    for _, data in _added(seeded.select("seed").mapInArrow(filtered, "place long, data binary")):
        bloom |= data
    known = context.broadcast(bloom)

    @F.pandas_udf("array<long>")
    def windows(solids: pd.Series) -> pd.Series:
        def one(solid: str) -> np.ndarray:
            found = np.unique(np.concatenate([window_hashes(solid, n) for n in sizes]))
            at = places(found)
            return found[(known.value[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)].view(np.int64)

        return solids.map(one)

    met = texts.filter("p_solid <> ''").select("page_id", F.explode(windows("p_solid")).alias("seed")).join(seeded.select("needle_id", "seed"), "seed").select("page_id", "needle_id").distinct()
    score = hit_length(F.col("p_key"), F.col("p_solid"), F.col("n_key"), F.col("n_solid"))
    return met.join(texts, "page_id").join(own, "needle_id").select("page_id", "needle_id", score.cast("long").alias("score")).filter("score > 0")
