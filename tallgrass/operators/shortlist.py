"""The needles of most word overlap for each text, by an inverted index in order of rarity.

A join on words meets every text with every needle over words like "the". Here a block of needles, of bounded size, is
broadcast as an index, and each text reads its own words' lists, rare ones first. Every list that is read raises the
overlap of some needles, and so the least score that the last place asks for; what a needle can still gain from the lists
not yet read is bounded by their number and by its own size. As soon as no needle outside can reach the last place, the
long lists of common words stay unread, and the few needles that still can are counted out by their own words.

No rows are shuffled while all needles fit into one block. With more blocks, each gives its best for a text, and these few
are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T

#: Words of needles in a block, about: eight bytes each, twice, are broadcast.
BLOCK_WORDS = 2_000_000


class RareFirst:
    """An inverted index of needles, by their place. Words are numbered from the rarest on."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """``words``: 64-bit words of all needles one after another, each once in a needle; ``ends`` of the needles."""
        self.sizes = np.diff(np.r_[0, ends]).astype(np.int64)
        self.starts = np.r_[0, ends].astype(np.int64)
        known, number, held = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(held, kind="stable")
        rarity = np.empty(len(known), np.int64)
        rarity[order] = np.arange(len(known))
        self.known, self.rarity = known, rarity
        self.forward = rarity[number]
        self.lists = np.repeat(np.arange(len(self.sizes)), self.sizes)[np.argsort(self.forward, kind="stable")]
        self.list_ends = np.cumsum(held[order])
        self.list_starts = self.list_ends - held[order]
        self.least = int(self.sizes[self.sizes > 0].min(initial=1))
        self.read = 0  # entries of lists that were read

    def best(self, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and Dice overlaps of the ``most`` best needles of a text with these different words; equal ones by place."""
        n = len(self.sizes)
        counts = np.zeros(n, np.int64)
        at = np.minimum(np.searchsorted(self.known, words), max(0, len(self.known) - 1))
        own = np.sort(self.rarity[at[self.known[at] == words]]) if len(self.known) else np.zeros(0, np.int64)
        whole = len(words) + self.sizes
        done, step, left = 0, 64, None
        while done < len(own):
            upto = done + max(1, int(np.searchsorted(np.cumsum(self.list_ends[own[done:]] - self.list_starts[own[done:]]), step)))
            for w in own[done:upto].tolist():
                counts[self.lists[self.list_starts[w] : self.list_ends[w]]] += 1
                self.read += int(self.list_ends[w] - self.list_starts[w])
            done, step = upto, 2 * step
            rest = len(own) - done
            score = 2.0 * counts / np.maximum(whole, 1)
            if n <= most or not rest:
                continue
            asked = np.partition(score, n - most)[n - most]
            if 2.0 * rest / (len(words) + max(rest, self.least)) < asked:
                left = np.flatnonzero(2.0 * (counts + np.minimum(rest, self.sizes - counts)) / np.maximum(whole, 1) >= asked)
                unread = np.zeros(len(self.known) + 1, bool)
                unread[own[done:]] = True
                for i in left.tolist():
                    counts[i] += np.count_nonzero(unread[self.forward[self.starts[i] : self.starts[i + 1]]])
                break
        places = np.arange(n) if left is None else left
        score = 2.0 * counts[places] / np.maximum(whole[places], 1)
        order = np.lexsort((places, -score))[:most]
        return places[order], score[order]


def _different_words(key: Column) -> Column:
    return F.transform(F.array_distinct(T.words_of(key)), lambda w: F.xxhash64(w))


def dice_shortlist(pages: DataFrame, needles: DataFrame, size: int = 5) -> DataFrame:
    """``page_id needle_id dice rank``: the ``size`` needles (id, key) of most word overlap for each page (id, key).

    Equal ones by id. Needles without a common word count too, at 0, so a page has fewer rows only where there are fewer
    needles; needles with a blank key are left out. Overlap is that of the sets of words (Dice).
    """
    spark = pages.sparkSession
    own = needles.filter(F.col("key") != "").select(F.col("id").alias("needle_id"), _different_words(F.col("key")).alias("words"))
    n_words = own.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_words // BLOCK_WORDS))
    texts = pages.select(F.col("id").alias("page_id"), _different_words(F.col("key")).alias("words"))
    kind = ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("page_id", texts), ("needle_id", own))) + ", dice double, `rank` long"

    def ranked(block: int) -> DataFrame:
        part = own.filter(F.pmod(F.xxhash64("needle_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else own
        given = part.orderBy("needle_id").toArrow()
        ids, words = given.column("needle_id").combine_chunks(), given.column("words").combine_chunks()
        index = RareFirst(words.flatten().to_numpy().astype(np.int64), (words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]) if len(words) else np.zeros(0, np.int64))
        shared = spark.sparkContext.broadcast((ids, index))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            needle_ids, known = shared.value
            for batch in batches:
                column = batch.column("words")
                values, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
                ends = ends - ends[0]
                found = [known.best(values[a:b], size) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                if not found:
                    continue
                places = np.concatenate([p for p, _ in found])
                sizes = [len(p) for p, _ in found]
                which = np.repeat(np.arange(len(found)), sizes)
                ranks = np.concatenate([np.arange(1, n + 1) for n in sizes])
                yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(which)), needle_ids.take(pa.array(places)), pa.array(np.concatenate([s for _, s in found])), pa.array(ranks, pa.int64())], names=["page_id", "needle_id", "dice", "rank"])

        return texts.mapInArrow(run, kind)

    found = [ranked(b) for b in range(n_blocks)]
    if n_blocks == 1:
        return found[0]
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("dice"), "needle_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", nth.cast("long")).filter(F.col("rank") <= size)
