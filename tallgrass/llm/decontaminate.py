"""Benchmark decontamination with a broadcast set of n-gram hashes.

Benchmark texts are normalised to words, and the hashes of their 10-word windows
form a sorted array that every task gets. Training texts are scanned in slices:
window hashes come from prefix sums, a 64k-bit table drops nearly all windows, a
binary search finds the rest, and every hit is verified against the window's own
bytes. A hit covers all its words.

The set that is broadcast is bounded: benchmark rows are dealt into blocks of at
most ``max_block_bytes`` of text, and the documents are scanned once for each
block, with the findings of earlier blocks carried along. One block is the usual
case. An item longer than a block makes a block of its own.

Null and empty texts have no words; an empty table gives no rows, an empty benchmark no hits. A text of any length is
scanned whole: memory is bounded by an Arrow batch, the block and the longest text. A benchmark row without an id takes part; it is listed
as "null". Repeated rows and items count as often as they occur, ids once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import checkpointed, table, text_slices
from tallgrass.llm.words import ALNUM, Words

N_WORDS = 10
MAX_BLOCK_BYTES = 32 << 20
NAMES = ("n_words", "hit_words", "hit_items")
_KINDS = ("long", "array<struct<first:long,n:long>>", "array<string>")


def _pieces(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about ``most`` bytes, each with the number of its first."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


class WindowSet:
    """The windows of a block of benchmark items, as arrays.

    The items' words stand in one buffer, a space apart. For every window length there are the sorted hashes of its
    windows and the first word of each, so that what a window says and whose it is are read from the buffer. That takes
    about five bytes for each byte of text.
    """

    def __init__(self, items: list[tuple[str, bytes]], n_words: int):
        self.names = [name for name, _ in items]
        buffers, starts, item = [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        done = size = 0
        for begin, texts in _pieces([text for _, text in items]):
            words = Words([text.lower() for text in texts], ALNUM)
            buffers.append(b"".join(words.word(i) + b" " for i in range(len(words))))
            sizes = words.ends - words.starts + 1
            starts.append((size + np.cumsum(sizes) - sizes).astype(np.uint32))
            item.append((begin + words.doc).astype(np.uint32))
            counts, hashes = words.counts(), words.hashes()
            for k in np.unique(np.minimum(counts[counts > 0], n_words)).tolist():
                first, own = words.windows(hashes, k)
                if k < n_words:  # an item of fewer words is one window
                    whole = counts[words.doc[first]] == k
                    first, own = first[whole], own[whole]
                found[k].append((own, (done + first).astype(np.uint32)))
            done, size = done + len(words), size + len(buffers[-1])
        self.buffer = b"".join(buffers)
        del buffers
        self.starts = np.concatenate([*starts, np.array([size], np.uint32)])
        self.item = np.concatenate([*item, np.zeros(0, np.uint32)])
        self.sorted: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.table: dict[int, np.ndarray] = {}
        for k, parts in found.items():
            hashes, first = (np.concatenate([p[n] for p in parts]) for n in range(2))
            order = np.argsort(hashes)
            self.sorted[k], self.first[k] = hashes[order], first[order]
            self.table[k] = np.zeros(1 << 16, bool)
            self.table[k][(hashes >> np.uint64(48)).astype(np.int64)] = True
        self._known: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def _texts(self, k: int, at: int) -> dict[bytes, set[str]]:
        """What the windows with the hash at place ``at`` say, and the items that say it."""
        if (k, at) not in self._known:
            wanted, texts = self.sorted[k], defaultdict(set)
            for i in range(at, int(np.searchsorted(wanted, wanted[at], "right"))):
                first = int(self.first[k][i])
                texts[self.buffer[self.starts[first] : self.starts[first + k] - 1]].add(self.names[self.item[first]])
            self._known[k, at] = dict(texts)
        return self._known[k, at]

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, length, items) of every occurrence in any of the texts."""
        own = words.hashes() if self.sorted else None
        for k, wanted in self.sorted.items():
            first, hashes = words.windows(own, k)
            maybe = np.flatnonzero(self.table[k][(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(wanted, hashes[maybe])
            same = wanted[np.minimum(at, len(wanted) - 1)] == hashes[maybe]
            for j, place in zip(maybe[same].tolist(), at[same].tolist(), strict=True):
                text = b" ".join(words.word(i) for i in range(first[j], first[j] + k))
                if items := self._texts(k, place).get(text):
                    yield int(first[j]), k, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark rows in blocks; the driver holds one block at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartition(max(1, _n_blocks(benchmark, text_col, max_block_bytes)))
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in items.toLocalIterator():
        text = row.t.encode()
        if block and size + len(text) > max_block_bytes:
            yield block
            block, size = [], 0
        block.append((row.i, text))
        size += len(text)
    yield block


def _n_blocks(benchmark: DataFrame, text_col: str, max_block_bytes: int) -> int:
    return 1 + int(benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]) // max_block_bytes


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n_words: int = N_WORDS, max_block_bytes: int = MAX_BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (disjoint runs of word numbers) and ``hit_items`` (sorted ids).

    ``prefix`` is put before the three names. Columns of ``docs`` with these names give way.
    """
    names = [f"{prefix}{n}" for n in NAMES]
    out = docs.drop(*names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    scanned = False
    for block in _blocks(benchmark, item_col, item_text_col, max_block_bytes):
        if scanned:
            out = checkpointed(out)
        windows = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n_words))
        out = out.mapInArrow(_scanner(windows, text_col, names, scanned), f"{ddl}, {', '.join(f'`{n}` {k}' for n, k in zip(names, _KINDS, strict=True))}")
        scanned = True
    return out


def _scanner(windows, text_col: str, names: list[str], again: bool):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text_col):
            words = Words([t.lower() for t in texts], ALNUM)
            counts = words.counts()
            steps = np.zeros(len(words) + 1, np.int64)
            items: list[set[str]] = [set() for _ in texts]
            begins = np.cumsum(counts) - counts
            if again:
                batch, before = batch.select([n for n in batch.schema.names if n not in names]), batch
                for d, (spans, ids) in enumerate(zip(before.column(names[1]).to_pylist(), before.column(names[2]).to_pylist(), strict=True)):
                    items[d] |= set(ids)
                    for s in spans:
                        steps[begins[d] + s["first"]] += 1
                        steps[begins[d] + s["first"] + s["n"]] -= 1
            for first, k, found in windows.value.hits(words):
                steps[first] += 1
                steps[first + k] -= 1
                items[words.doc[first]] |= found
            hit = np.cumsum(steps[:-1]) > 0
            doc = words.doc
            fresh = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & (np.append(-1, doc[:-1]) == doc)))
            ends = np.flatnonzero(hit & ~(np.append(hit[1:], False) & (np.append(doc[1:], -1) == doc))) + 1
            spans: list[list[dict[str, int]]] = [[] for _ in texts]
            for a, b in zip(fresh.tolist(), ends.tolist(), strict=True):
                spans[doc[a]].append({"first": a - int(begins[doc[a]]), "n": b - a})
            kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array([sorted(s) for s in items], pa.list_(pa.string()))], names=[*batch.schema.names, *names])

    return run


def remove_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", mode: str = "documents", n_words: int = N_WORDS) -> DataFrame:
    """``docs`` without what occurs in the benchmark.

    ``mode`` "documents" drops every document with a hit. "spans" takes the hit runs of words out of the
    texts and leaves a line break in each place; words around the place may form a window anew, so scan again
    where that matters.
    """
    columns = docs.columns
    found = find_hits(docs, benchmark, text_col, item_col, item_text_col, n_words, prefix="_found_")
    if mode == "documents":
        return found.filter(F.size("_found_hit_words") == 0).select(columns)
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: documents or spans")

    @F.pandas_udf("string")
    def cut(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in rows:
            yield texts.combine(spans, lambda t, s: cut_words(t, s) if t and len(s) else t)

    return found.withColumn(text_col, cut(F.col(text_col), F.col("_found_hit_words"))).select(columns)


def cut_words(text: str, runs) -> str:  # noqa: ANN001
    raw = text.encode()
    words = Words([raw.lower()], ALNUM)
    out, done = [], 0
    for run in runs:
        first, last = int(run["first"]), int(run["first"]) + int(run["n"]) - 1
        out.append(raw[done : words.starts[first]])
        done = int(words.ends[last])
    return b"\n".join([*out, raw[done:]]).decode()


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda total, run: total + run["n"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS words FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SQL_WORDS} AS words FROM benchmark),
b_at AS (SELECT item, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0),
b_windows AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM b_at),
d_at AS (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM b_windows) ON len(words) >= k),
hits AS (SELECT rid, i, k, item FROM (SELECT rid, i, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM d_at) JOIN b_windows USING (k, w)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""
