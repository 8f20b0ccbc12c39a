"""Prefix trie of conversations, with a count-min sketch that keeps unshared tails out of the shuffle.

A node is a distinct sequence of first turns. Every conversation lies in one node
of each depth up to its own length, so rows (conversation, depth) with a digest of
the turns so far are grouped by digest. Most digests occur once. A count-min
sketch of all digests tells which: an estimate of one is exact, and from there on
the conversation is alone, so these rows become nodes where they are. Only rows
before that, whose digests may be shared, are shuffled and grouped exactly.

Sums over subtrees need no walk. The smallest conversation of a node owns it, and
one that owns a node owns all nodes further down its path. So a subtree's bytes
are a sum over its members: bytes from the node's depth on, less the part that
the member owns; its childless nodes are the members that own their last node
where nobody goes on; its children are the members that own the next node.

Digests are 128 bits: for each turn, its MD5 marked with its place, joined by
exclusive or along the conversation.

Rows without ``conv_id`` belong to no conversation. Turns are ordered with null
first; equal turns by role and digest, so repeated rows count as turns of their
own. An empty table has no nodes, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import checkpointed, table

#: Rows of the sketch, counters a row for each prefix, and counters at most.
DEPTH, WIDTH, MOST_WIDTH = 3, 8, 1 << 27
CHUNK = 1 << 13
#: A row of ends holds the members of so many consecutive ids.
IDS = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv pos digest bytes`` of every turn; ``pos`` counts from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return turns.select("conv", F.row_number().over(order).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv``, and their rows ``conv depth digest bytes``: the first ``head`` turns of conversation ``base``, then the own ones after as many.

    ``head`` and ``base`` are functions of ``conv``; ``head`` is small, and few conversations have one base.
    """
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("size"))
    convs = sizes.select("conv", base.alias("base"), head.alias("head"))
    taken = convs.join(sizes.select(F.col("conv").alias("base"), "size"), "base", "left").select("conv", "base", "head", F.least("head", F.coalesce("size", F.lit(0))).alias("taken"))
    own = turns.join(taken, "conv").filter("pos > head").select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("depth"), "digest", "bytes")
    most = turns.withColumnRenamed("conv", "base").join(taken.select("conv", "base", "taken"), "base").filter("pos <= taken")
    return convs.select("conv"), own.unionByName(most.select("conv", F.col("pos").alias("depth"), "digest", "bytes"))


def _cells(width: int) -> list[Column]:
    return [F.pmod(F.xxhash64("x", "y", F.lit(i)), F.lit(width)) + i * width for i in range(DEPTH)]


def _maybe_shared(rows: DataFrame) -> Column:
    """Whether the count-min estimate of a row's digest is over one. The sketch is summed up by cell; a bit a cell is broadcast."""
    width = min(MOST_WIDTH, 1 << max(10, (WIDTH * rows.count()).bit_length()))
    cells = rows.select(F.explode(F.array(*_cells(width))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = cells.groupBy(F.floor(F.col("cell") / CHUNK).alias("chunk")).agg(F.collect_set(F.col("cell") % CHUNK).alias("inside"))  # no more than CHUNK a row
    bits = np.zeros((DEPTH * width // CHUNK + 1) * CHUNK // 8, np.uint8)
    for row in chunks.toLocalIterator():
        own = np.zeros(CHUNK, bool)
        own[row.inside] = True
        bits[row.chunk * CHUNK // 8 :][: CHUNK // 8] = np.packbits(own)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def estimate_over_one(*cells: pd.Series) -> pd.Series:
        at = np.stack([c.to_numpy() for c in cells])
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0))

    return estimate_over_one(*_cells(width))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``x y depth ends``: the hash of the ids that end in a node. Ids come in short strings by range, which are hashed one after another."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("x", "y", "depth", F.floor(F.col("conv") / IDS).alias("part")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            x, y, d, h = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(d, pa.int32()), pa.array(h, pa.string())], names=["x", "y", "depth", "ends"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "depth", "ids")), strict=True):
                if key != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if out:
                yield flushed()
                out = []
        if sha:
            out.append((*node, sha.hexdigest()))
            yield flushed()

    return parts.repartition("x", "y").sortWithinPartitions("x", "y", "depth", "part").mapInArrow(run, "x long, y long, depth int, ends string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv, depth from 1, digest, bytes); ``convs`` (conv) lists all conversations, turnless ones too.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless
    nodes of the subtree), ``saved_tokens`` (bytes that members after the first share, over the subtree), ``ends_sha256``.
    """
    of_conv = Window.partitionBy("conv")
    upto = of_conv.orderBy("depth")
    tops = convs.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    mark = lambda *c: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*c))
    paths = checkpointed(
        turns.unionByName(tops).select(
            "conv",
            F.col("depth").cast("int").alias("depth"),
            "bytes",
            F.bit_xor(mark("digest", "depth")).over(upto).alias("x"),
            F.bit_xor(mark("depth", "digest")).over(upto).alias("y"),
            F.max("depth").over(of_conv).cast("int").alias("size"),
            (F.sum("bytes").over(of_conv) - F.sum("bytes").over(upto) + F.col("bytes")).alias("onward"),
        )
    )
    root = paths.agg(F.min("conv")).first()[0]
    seen = paths.withColumn("alone", F.when((F.col("depth") > 0) & ~_maybe_shared(paths), F.col("depth")))
    seen = checkpointed(seen.withColumn("alone", F.min("alone").over(of_conv)))
    tails, some = seen.filter("depth >= alone"), seen.filter("alone IS NULL OR depth < alone")

    firsts = some.filter("depth > 0").groupBy("x", "y", "depth").agg(F.min("conv").alias("first"), F.max("size").alias("longest"))
    named = some.filter("depth > 0").join(firsts, ["x", "y", "depth"])
    longest = F.lit(None).cast("int").alias("longest")
    named = named.unionByName(some.filter("depth = 0").select("*", F.lit(root).cast("long").alias("first"), longest))
    mine = F.col("first") == F.col("conv")
    named = checkpointed(
        named.select(
            *("conv", "depth", "x", "y", "size", "onward", "first"),
            F.lag("first").over(upto).alias("parent"),
            F.coalesce(F.min(F.when(mine, F.col("depth"))).over(of_conv), F.col("alone"), F.col("size") + 1).alias("owned_from"),
            F.coalesce(F.max(F.when(mine, F.col("onward"))).over(of_conv), F.min(F.col("onward") - F.col("bytes")).over(of_conv)).alias("owned"),
            (F.col("alone").isNotNull() | F.coalesce(F.max(mine & (F.col("depth") == F.col("size")) & (F.col("longest") == F.col("size"))).over(of_conv), F.lit(False))).alias("leaf"),
            F.coalesce("alone", F.lit(0)).alias("alone"),
        )
    )
    ends = _end_hashes(named.filter("depth = size").select("x", "y", "depth", "conv"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    shared = named.groupBy("x", "y", "depth").agg(
        F.min("first").alias("conv_id"),
        F.min("parent").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        count((F.col("size") > F.col("depth")) & (F.col("owned_from") <= F.col("depth") + 1)).alias("n_children"),
        count(F.col("leaf")).alias("n_leaves"),
        F.sum(F.when(F.col("owned_from") > F.col("depth"), F.col("onward") - F.col("owned")).otherwise(0)).alias("saved_tokens"),
    )
    shared = shared.join(ends, ["x", "y", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends", none))
    shared = shared.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))

    def alone(rows: DataFrame, parent: Column) -> DataFrame:
        last = F.col("depth") == F.col("size")
        one = F.lit(1).cast("long")
        return rows.select("depth", F.col("conv").alias("conv_id"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"))

    before = named.filter("depth = alone - 1").select("conv", "first")
    heads = alone(tails.filter("depth = alone").join(before, "conv"), F.col("first"))
    every = alone(tails.filter("depth > alone"), F.col("conv")).unionByName(heads).unionByName(shared.select(heads.columns))
    return every.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = checkpointed(ordered_turns(table(spark, sf_dir, "conversations")))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    return prefix_trie(*rebuilt(turns, head, F.col("conv") - F.col("conv") % 5))


_SQL_CRC = """CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS BIGINT)"""
OP11_SQL = f"""
WITH turns AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS b, coalesce(role, '') AS r, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(g := g, b := b) ORDER BY turn NULLS FIRST, r, g) AS ts FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, ts, conv_id - conv_id % 5 AS base, {_SQL_CRC} % 9 AS h FROM own),
whole AS (SELECT heads.conv_id, coalesce(own.ts[1:h], []) || heads.ts[h + 1:] AS ts FROM heads LEFT JOIN own ON own.conv_id = base),
paths AS (SELECT conv_id, len(ts) AS size, d, array_to_string(list_transform(ts[1:d], lambda t: t.g), '') AS k, CASE WHEN d > 0 THEN ts[d].b ELSE 0 END AS b
  FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM whole)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b, max(size) > d AS inner_node, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM paths GROUP BY k, d),
below AS (SELECT x.k, x.d, sum(CASE WHEN y.inner_node THEN 0 ELSE 1 END) AS leaves, sum((y.n - 1) * y.b) AS saved, sum(CASE WHEN y.d = x.d + 1 THEN 1 ELSE 0 END) AS children
  FROM nodes x JOIN nodes y ON y.d >= x.d AND starts_with(y.k, x.k) GROUP BY x.k, x.d)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below USING (k, d) LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.k = left(nodes.k, CAST(32 * (nodes.d - 1) AS BIGINT)) AND nodes.d > 0
"""
