"""Ranked lexical search for many items at once, over sums that the items share.

Items are dealt into blocks. A task of each block mines its items for shared sets
of terms: terms that lie in the same items are one set, and pairs of sets that two
items or more hold together are joined, the most frequent first, until no pair is
left. Every set becomes one partial sum, and sets built on sets form a graph in
which an item is the sum of a few nodes.

For each block, documents are read twice. The first pass turns a text into its
length and its counts of the block's terms; the corpus counts are sums over these.
The second pass weighs the counts, works out each node of the graph once for a
batch of documents, adds nodes up to scores, and keeps the best documents of each
item. Every task sends on at most ``top`` rows an item, which are ranked within
salted parts of an item and then as a whole.

Rows of one item id are one item with all their terms. Null texts have no terms and
count in nothing; texts and items without terms have no rows. Ids are longs; null
ids stay, and come last among equal scores. Repeated rows are documents of their
own. An empty table gives no rows, and other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import checkpointed, table, text_slices
from tallgrass.llm.words import ALNUM, Words

TOP = 50
#: Items and bytes of item texts in a block, about: the bound of what is broadcast.
BLOCK_ITEMS, BLOCK_BYTES = 512, 4 << 20
#: Sets whose pairs are counted at a time; it changes how much is shared, never a score.
MOST_SETS = 4096
#: Numbers in a batch's table of sums.
CELLS = 4 << 20
PARTS = 16

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def shared_sums(items: list[list[int]], n_terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """Nodes and items as lists of slots: a slot is a term, or ``n_terms`` plus the number of an earlier node.

    Each node is used by two items or nodes at least, and the slots of an item add up to all its terms, each once.
    """
    holders: dict[int, list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    sets: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, own in sorted(holders.items()):
        sets[tuple(own)].append(t)
    nodes: list[list[int]] = []
    rest: list[list[int]] = [[] for _ in items]
    slots: list[int] = []
    columns: list[np.ndarray] = []

    def node(children: list[int]) -> int:
        nodes.append(children)
        return n_terms + len(nodes) - 1

    shared = sorted((s for s in sets if len(s) > 1), key=lambda s: (-len(s), s))
    for own in [s for s in sets if len(s) == 1] + shared[MOST_SETS:]:
        slot = sets[own] if len(own) == 1 or len(sets[own]) == 1 else [node(sets[own])]
        for i in own:
            rest[i] += slot
    for own in shared[:MOST_SETS]:
        slots.append(sets[own][0] if len(sets[own]) == 1 else node(sets[own]))
        columns.append(np.isin(np.arange(len(items)), own))
    held = np.array(columns, np.float32).reshape(-1, len(items))
    while True:
        open_sets = np.flatnonzero(held.sum(1) > 1)
        together = np.triu(held[open_sets] @ held[open_sets].T, 1)
        most = together.max(initial=0)
        if most < 2:
            break
        a, b = np.nonzero(together >= max(2, most / 2))
        used: set[int] = set()
        joined = []
        for k in np.argsort(-together[a, b], kind="stable").tolist():
            x, y = int(open_sets[a[k]]), int(open_sets[b[k]])
            if x not in used and y not in used:
                used |= {x, y}
                both = held[x] * held[y]
                held[x] -= both
                held[y] -= both
                joined.append(both)
                slots.append(node([slots[x], slots[y]]))
        held = np.concatenate([held, joined])
    for k, i in np.argwhere(held > 0).tolist():
        rest[i].append(slots[k])
    return nodes, rest


def _plans(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row for each block: its items, its terms by hash, and the graph of sums."""
    size = items.select(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.bytes // BLOCK_BYTES))

    def mined(rows: pa.Table) -> pa.Table:
        own: dict[int | None, set[bytes]] = defaultdict(set)
        for i, text in zip(rows.column("item").to_pylist(), rows.column("t").cast(pa.binary()).to_pylist(), strict=True):
            own[i] |= set(_TERM.findall((text or b"").lower()))
        terms = sorted(set().union(*own.values()))
        hashes = Words(terms, ALNUM).hashes()
        order = np.argsort(hashes)
        at = {terms[t]: k for k, t in enumerate(order.tolist())}
        nodes, sums = shared_sums([sorted(at[t] for t in ts) for ts in own.values()], len(terms))
        return pa.table(
            {
                "block": pa.array([rows.column("block")[0].as_py()], pa.int64()),
                "items": pa.array([list(own)], pa.list_(pa.int64())),
                "hashes": pa.array([hashes[order].view(np.int64).tolist()], pa.list_(pa.int64())),
                "sizes": pa.array([[len(terms[t]) for t in order]], pa.list_(pa.int32())),
                "nodes": pa.array([nodes], pa.list_(pa.list_(pa.int32()))),
                "sums": pa.array([sums], pa.list_(pa.list_(pa.int32()))),
            }
        )

    dealt = items.select(F.pmod(F.xxhash64(item_col), F.lit(blocks)).alias("block"), F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("t"))
    kinds = "block long, items array<long>, hashes array<long>, sizes array<int>, nodes array<array<int>>, sums array<array<int>>"
    return checkpointed(dealt.groupBy("block").applyInArrow(mined, kinds))


def _counted(docs: DataFrame, id_col: str, text_col: str, hashes: list[int], sizes: list[int]) -> DataFrame:
    """``doc_id n terms counts`` of every document with a term: its length, and how often it holds terms of the block."""
    context = docs.sparkSession.sparkContext
    wanted = context.broadcast((np.array([*hashes, 2**63 - 1], np.int64).view(np.uint64), np.array([*sizes, -1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = wanted.value
        for batch, texts in text_slices(batches, "t"):
            words = Words([t.lower() for t in texts], ALNUM)
            own = words.hashes()
            at = np.searchsorted(known[:-1], own)
            hit = np.flatnonzero((known[at] == own) & (lengths[at] == words.ends - words.starts))
            pairs, counts = np.unique(words.doc[hit] * len(known) + at[hit], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % len(known), counts)]
            out = pa.RecordBatch.from_arrays([batch.column("i"), pa.array(words.counts().astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(words.counts() > 0))

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class _Best:
    """The best documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[:, None]
        for i in np.flatnonzero(good.any(1)).tolist():
            new = np.flatnonzero(good[i])
            rows = [np.concatenate(x) for x in zip(self.rows[i], (scores[i, new], no_id[new], ids[new]), strict=True)]
            order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.top]
            self.rows[i] = tuple(r[order] for r in rows)
            if len(order) == self.top:
                self.least[i] = self.rows[i][0][-1]


def _best(counted: DataFrame, plan, weights: np.ndarray, n_docs: int, n_words: int, top: int) -> DataFrame:  # noqa: ANN001
    """``item_id doc_id score``: of every task the best ``top`` documents of each item of the block."""
    shared = counted.sparkSession.sparkContext.broadcast((plan.items, plan.nodes, plan.sums, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, nodes, sums, w = shared.value
        slots = len(w) + len(nodes)
        size = max(1, min(1024, CELLS // max(1, slots + len(items))))
        best = _Best(len(items), top)
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                n = part.column("n").to_numpy()
                terms, counts = (part.column(c).flatten().to_numpy() for c in ("terms", "counts"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(part.column("terms").offsets.to_numpy()))
                m = 100 - 50 + (50 * n * n_docs) // n_words
                tf = counts.astype(np.int64)
                acc = np.zeros((slots, part.num_rows), np.int64)
                acc[terms, doc] = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                for k, children in enumerate(nodes):
                    acc[len(w) + k] = acc[children].sum(0)
                scores = np.stack([acc[own].sum(0) if own else np.zeros(part.num_rows, np.int64) for own in sums])
                no_id = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                best.add(scores, no_id, part.column("doc_id").fill_null(0).to_numpy())
        for i, (scores, no_id, ids) in zip(items, best.rows, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(scores), pa.int64()), pa.array(ids, pa.int64(), mask=no_id), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return counted.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item_id rank doc_id score``: the ``top`` documents of highest score above 0 of each item, equal ones by id."""
    plans = _plans(items, item_col, item_text_col)
    found = []
    for block in [r.block for r in plans.select("block").collect()]:
        plan = plans.filter(F.col("block") == block).first()
        counted = checkpointed(_counted(docs, id_col, text_col, plan.hashes, plan.sizes))
        whole = counted.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
        holders = {r.term: r.n for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toLocalIterator()}  # no more than the block's terms
        weights = np.array([math.floor(1000 * math.log((2 * whole.n + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(plan.hashes))], np.int64)
        found.append(_best(counted, plan, weights, whole.n, whole.words or 1, top))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for keys in (["item_id", "part"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return rows.select("item_id", "rank", "doc_id", "score")


def op13_shared_sum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT rid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item_terms AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
weighted AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
scored AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM item_terms JOIN weighted USING (term) JOIN tf USING (term) JOIN sized USING (rid), whole GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored JOIN sized USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
