"""Sequence packing by Karmarkar-Karp multiway differencing.

Every text becomes token ids plus one end id. Pieces of a whole window are cut off
first; what is left of each document is shorter than a window. Rests of one block
of documents are dealt to k windows by the differencing method: each rest begins
as a partial partition (k-1 empty parts), and the two partial partitions with the
widest gap between parts are merged over and over, largest part onto smallest, so
that opposing imbalances cancel. If any window comes out over capacity, k rises
and the block is packed again. A rest is a whole piece and is never cut.

Blocks are consecutive documents of a task, so nothing is shuffled and memory is
bounded by a block and the longest text. A sequence never leaves its task: a task
that is run again after a loss replaces all of its sequences. Rows with null or
empty text give one piece, the end id.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import table, text_slices

WINDOW = 1024
END_ID = 0
BLOCK_DOCS = 2048

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Tokenizer:
    """Ids of a byte-level BPE vocabulary, as its ``tokenizers`` file gives them.

    The same merges from the vocabulary's tiktoken file run several times faster, and give the same ids for
    all text but the special token's string, where the text is split as ``tokenizers`` does.
    """

    def __init__(self, ranks_path: str, special: str = "<|endoftext|>", special_id: int = 50256):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special, self.special_id = special, special_id

    def ids(self, text: str) -> list[int]:
        if self.special not in text:
            return self.encoding.encode_ordinary(text)
        first, *rest = text.split(self.special)
        out = self.encoding.encode_ordinary(first)
        for part in rest:
            out.append(self.special_id)
            out += self.encoding.encode_ordinary(part)
        return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` parts with near-equal sums.

    A partial partition is the list of its parts that aren't empty, as (sum, order, members) from the smallest up;
    its gap is its largest sum less its smallest, which is 0 while a part is empty.
    """
    heap = [(-size, i, [(size, i, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        if len(one) < len(other):
            one, other = other, one
        # The other's parts, largest first, go onto empty parts, then onto this one's smallest.
        free = k - len(one)
        onto, one = one[: max(0, len(other) - free)], one[max(0, len(other) - free) :]
        for j, part in enumerate(reversed(other)):
            if j >= free:
                small = onto[j - free]
                part = (small[0] + part[0], order, (small[2], part[2]))
                order += 1
            insort(one, part)
        heapq.heappush(heap, (one[0][0] * (len(one) == k) - one[-1][0], order, one))
        order += 1
    return [_flat(members) for _, _, members in heap[0][2]]


def _flat(members: int | tuple) -> list[int]:
    out, todo = [], [members]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            out.append(x)
        else:
            todo.extend(x)
    return sorted(out)


def pack_rests(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` in windows of at most ``capacity``; the count of windows rises until all fit."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [p for p in differencing(sizes, min(k, len(sizes))) if p]
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        k += max(1, k // 100)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, ranks_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row per piece: ``doc_id start length ids_crc32 doc_tokens sequence_id offset`` and, if wanted, its ``ids``.

    ``sequence_id`` holds the task's number in its high bits. ``id_col`` must be a long.
    """
    fields = [f for f in PIECES if with_ids or f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        tokenizer = Tokenizer(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        rows: list[list] = []
        rests: list[list] = []

        def packed() -> pa.RecordBatch:
            nonlocal sequence, rows, rests
            for part in pack_rests([r[2] for r in rests], window):
                offset = 0
                for i in part:
                    rests[i][5:7] = [sequence, offset]
                    offset += rests[i][2]
                sequence += 1
            rows, done = [], rows + rests
            rests = []
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in done], f.type) for j, f in enumerate(fields)], schema=pa.schema(fields))

        for batch, texts in text_slices(batches, "t"):
            for doc_id, text in zip(batch.column("i").to_pylist(), texts, strict=True):
                ids = np.array([*tokenizer.ids(text.decode()), end_id], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    row = [doc_id, start, len(piece), zlib.crc32(piece), len(ids), None, 0, *([piece.view(np.int32)] if with_ids else [])]
                    if len(piece) == window:
                        row[5] = sequence
                        sequence += 1
                        rows.append(row)
                    else:
                        rests.append(row)
                if len(rests) >= BLOCK_DOCS or len(rows) >= 4 * BLOCK_DOCS:
                    yield packed()
        yield packed()

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, kind)


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
