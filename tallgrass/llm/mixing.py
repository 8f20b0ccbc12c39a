"""Scoring by online logistic context mixing over running text.

Texts are tokens: words and one end. The model gives a probability to every token
after the tokens before it, so log10 of a text's probability is a sum over its tokens.

* Bits. A known token is written in ``CODE_BITS`` bits of its hash. Each bit is predicted from hashed contexts of the
  running text: none, the gate below, the token before, and the two tokens before, always with the bits of the token so
  far. A context's predictor holds how many training tokens went either way. A bit is given where no training token
  lies on its other side. Tokens with one code share its probability by their counts.
* Mixing. The stretched predictions are added under weights, whose set is chosen by the bit's place and by how much the
  two contexts of tokens have seen. Weights are learned online, as a chunk's text goes by: a mini-batch of tokens is
  scored, and then the weights are refined by its training tokens. The first ``WARM`` batches are gone through once more
  before. Only training tokens move weights. Every chunk learns; their weights are averaged, and all texts
  are scored with the same ones.
* Gate. The family of the last character beyond ASCII before the token: its accent, or its block of the code table; 0
  before any. It tells languages apart as a text goes on, and is known before the token.
* A training document's tokens are scored by what the other training tokens tell: one occurrence of each is taken out of
  the counts, and a word that occurs once is unknown there. A training text that repeats itself still knows its own later
  words, so its score is higher than that of the same text held out.
* Unknown tokens are spelled in bytes with a closing space, by the same kind of mixing: contexts are the last bytes, the
  token so far and the gate, and what they learn from are the words that occur once in training.
* Refinement. A token's probability is a blend of the mixed one, of the text's own tokens so far, and of its spelling.
  Blend weights start the same in every text and are refined after each block of tokens by how well each part did, so
  they depend on earlier tokens only. All sums are in logarithms: a word of any length has a finite score.

Scale. Texts are read in chunks of about ``CHUNK_BYTES``; a chunk is a row. It is summed up to its distinct words and
its distinct (two tokens, code) keys, which go out sorted and packed, a part to each block of the key space; a block adds
up its chunks and sends back to each what its keys have seen, in the same order and so without the keys. Counts cover all
training documents and grow with them; what is broadcast (counts of the first bits without context, by gate and by the
token before, and the spelling's slots) has a fixed size. A key is a chunk's at most once, so a frequent context costs
its distinct followers by chunk. Documents are dealt into chunks by a hash of id and text and sorted there, so scores are
a function of the rows, however the table is partitioned. Contexts are hashed (``CONTEXT_BITS``), words are told apart by all 64 bits of theirs.

Null texts are a single end token; an empty table gives no rows; without training rows every word is spelled. Repeated
rows, ids and null ids are scored and counted row by row, and other columns are not read.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import byte_slices, id_mod, release, shared_folder, shuffles_removed, table
from tallgrass.llm.words import mixed

CHUNK_BYTES = 4 << 20
#: Numbers for the parts of a chunk that is much too long.
CUTS = 1 << 24
#: Spellings are learned in groups of so many blocks.
SPELL_BLOCKS = 16
#: Tokens for each block of the key space.
BLOCK_TOKENS = 1 << 20
GATES = 8
CODE_BITS, GATE_LEVELS, CONTEXT_BITS = 20, 16, 32
#: The token before is a context by so many bits of its code, for so many bits.
ONE_BITS, ONE_LEVELS = 10, 11
#: Predictors: no context, gate, one token, two tokens. Classes of what a context of tokens has seen.
INPUTS, CLASSES = 4, 5
SLICE, WARM = 1 << 13, 3
#: Sums that are kept side by side.
LANES = 8
SLOTS_LOG2 = 18
CONTEXTS = 6
LONGEST = 3
SETS = 8 * 4
TABLE_BLOCK = 1 << 16
TABLES = (1 << CODE_BITS, GATES << GATE_LEVELS, 1 << ONE_BITS + ONE_LEVELS)
TABLE_SIZE = sum(TABLES)
#: Shares of the mixed probability and of the text's own tokens at first, before the share of unseen words is taken off (Good-Turing).
KNOWN = (0.95, 0.05)
BLOCK, RATE, MIXING_RATE, LEAST_SHARE = 32, 1.0, 0.05, 1e-4
END = b""
_SALTS = np.random.default_rng(77).integers(1, 2**63, CONTEXTS, dtype=np.uint64)
_U = np.uint64


def _families() -> np.ndarray:
    """The gate of each two-byte character, by its lead byte less 0xC0 and its second byte less 0x80."""
    accents = {"̈": 1, "́": 2, "̀": 3, "̂": 3, "̧": 3, "̃": 4}
    out = np.zeros((64, 64), np.int64)
    for lead in range(64):
        for second in range(64):
            parts = unicodedata.decomposition(chr(lead % 32 << 6 | second)).split() if lead < 32 else []
            mark = chr(int(parts[1], 16)) if len(parts) == 2 and parts[0][0] != "<" else ""
            out[lead, second] = accents.get(mark, 1 if lead == 3 else 5 + lead % (GATES - 5))
    return out


FAMILIES = _families()


def families(words: list[bytes]) -> np.ndarray:
    """The gate that each word leaves behind; -1 for words in ASCII, which leave it as it is."""
    buffer = b"\n".join([*words, b"", b""])
    raw = np.frombuffer(buffer, np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    leads = np.flatnonzero(raw >= 0xC0)
    at = np.searchsorted(leads, begins + sizes) - 1
    have = (at >= 0) & (leads[at] >= begins) if len(leads) else np.zeros(len(words), bool)
    last = leads[at] if len(leads) else np.zeros(len(words), np.int64)
    return np.where(have, FAMILIES[raw[last] & 63, raw[last + 1] & 63], -1)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers by bytes of equal weight, compressed: small numbers leave planes of zeros."""
    return squeezed(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(expanded(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


# Chunks.

CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("bytes", pa.binary()), ("ids", pa.binary()), ("words", pa.binary())])
CHUNK_DDL = "chunk long, tokens long, doc_id array<long>, train array<boolean>, sizes binary, bytes binary, ids binary, words binary"


class _Chunk:
    """Documents gathered until their text fills a chunk; tokens are numbered by how often the chunk holds them."""

    def __init__(self) -> None:
        self.size = 0
        self.parts: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)
        self.size += batch.num_rows + (pc.sum(pc.binary_length(batch.column("t"))).as_py() or 0)

    def row(self, chunk: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        given = pa.Table.from_batches(self.parts).combine_chunks()
        text = pc.fill_null(given["t"].combine_chunks(), "").cast(pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_lower(text))  # at space and \x09-\x0D alone; empty at either end
        flat = split.flatten()
        some = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False))
        doc = np.searchsorted(split.offsets.to_numpy(), some, "right") - 1
        coded = flat.take(pa.array(some)).dictionary_encode()
        words = [*coded.dictionary.cast(pa.large_binary()).to_pylist(), END]
        tokens = np.full(len(some) + len(text), len(words) - 1)
        tokens[np.arange(len(some)) + doc] = coded.indices.to_numpy()  # every text's end follows its words
        sizes = np.bincount(doc, minlength=len(text)) + 1
        by_use = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        rank = np.empty(len(by_use), np.uint32)
        rank[by_use] = np.arange(len(by_use), dtype=np.uint32)
        joined = b"\n".join(words[i] for i in by_use.tolist())
        values = [[chunk], [len(tokens)], [given["i"].to_pylist()], [given["train"].to_pylist()], [packed(sizes)], [packed(pc.binary_length(text).to_numpy())], [packed(rank[tokens])], [squeezed(joined)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, CHUNK_SCHEMA, strict=True)], schema=CHUNK_SCHEMA)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by chunk; a chunk that is much too long (many copies of one row) is cut after a row."""
    number, part, chunk = None, 0, _Chunk()
    for batch in byte_slices(batches, "t", CHUNK_BYTES // 4):
        given = batch.column("chunk").to_numpy()
        at = 0
        while at < len(given):
            if given[at] != number:
                if chunk.parts:
                    yield from chunk.row(number * CUTS + part)
                number, part, chunk = int(given[at]), 0, _Chunk()
            rest = batch.slice(at, int(np.searchsorted(given[at:], number, "right")))
            upto = np.cumsum(pc.fill_null(pc.binary_length(rest.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            rows = min(len(upto), int(np.searchsorted(upto, 2 * CHUNK_BYTES - chunk.size)) + 1)
            chunk.add(rest.slice(0, rows))
            at += rows
            if chunk.size >= 2 * CHUNK_BYTES:
                yield from chunk.row(number * CUTS + part)
                part, chunk = part + 1, _Chunk()
    if chunk.parts:
        yield from chunk.row(number * CUTS + part)


class Sequence:
    """The tokens of a chunk in order: word numbers, gates, training marks, and the keys of their contexts."""

    def __init__(self, row: dict):
        self.words = expanded(row["words"]).split(b"\n")
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), _U, len(self.words))
        self.code = self.hash >> _U(64 - CODE_BITS)
        self.sizes = unpacked(row["sizes"], "<i8")
        self.ids = unpacked(row["ids"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.doc_id, self.doc_train = row["doc_id"], np.array(row["train"], bool)
        self.train = np.repeat(self.doc_train, self.sizes)

    def gates(self) -> np.ndarray:
        """Each token's gate: what the last word before it with a character beyond ASCII left."""
        left = families(self.words)[self.ids]
        at = np.where(left >= 0, np.arange(len(left)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], at[:-1]]))
        return np.where(last >= self.begins[self.doc], left[last], 0)

    def before(self) -> np.ndarray:
        """The code of the token before each one; 0 at the start of a text."""
        code = self.code[self.ids]
        code[1:] = code[:-1].copy()
        code[self.begins] = 0
        return code

    def keys(self) -> np.ndarray:
        """The hash of the two tokens before, and the code, of every token."""
        one = self.before()
        two = np.concatenate([np.zeros(1, _U), one[:-1]])
        two[self.begins] = 1
        return mixed(one << _U(32) ^ two ^ _SALTS[0]) >> _U(64 - CONTEXT_BITS) << _U(CODE_BITS) | self.code[self.ids]

    def cells(self) -> list[np.ndarray]:
        """Every token's cell in the tables without context, by gate and by the token before."""
        code = self.code[self.ids].astype(np.int64)
        one = (self.before() >> _U(CODE_BITS - ONE_BITS)).astype(np.int64)
        return [code, self.gates() << GATE_LEVELS | code >> CODE_BITS - GATE_LEVELS, one << ONE_LEVELS | code >> CODE_BITS - ONE_LEVELS]


#: By kind: 0 words by their whole hash, 1 contexts of two tokens. Bits of a key, and of the part that a block never cuts.
KEY_BITS = (64, CONTEXT_BITS + CODE_BITS)
HEAD_BITS = (CODE_BITS, CONTEXT_BITS)
#: Kinds of other rows: counts of a table, words that occur once.
TABLE, ONCE = 2, 3


def distinct_keys(seq: Sequence, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's keys of a kind, sorted, and each one's count in training."""
    if kind == 0:
        order = np.argsort(seq.hash)
        return seq.hash[order], np.bincount(seq.ids[seq.train], minlength=len(order)).astype(np.uint32)[order]
    own = seq.keys()
    keys = np.sort(own)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    learnt = np.sort(own[seq.train])
    first = np.flatnonzero(np.concatenate([[True], learnt[1:] != learnt[:-1]])) if len(learnt) else np.zeros(0, np.int64)
    counts = np.zeros(len(keys), np.uint32)
    counts[np.searchsorted(keys, learnt[first])] = np.diff(np.append(first, len(learnt)))
    return keys, counts


def block_edges(kind: int, blocks: int, keys: np.ndarray) -> np.ndarray:
    """Where each block of the key space begins among sorted keys; a block never cuts a context."""
    head = keys >> _U(KEY_BITS[kind] - HEAD_BITS[kind])
    firsts = (np.arange(blocks, dtype=object) << HEAD_BITS[kind]) // blocks
    return np.append(np.searchsorted(head, firsts.astype(_U)), len(keys))


KEYED_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])
KEYED_DDL = "kind int, block int, chunk long, keys binary, counts binary, words binary"


def _keyed(blocks: int):  # noqa: ANN202
    """Rows for the blocks: each chunk's keys and counts, the words that a chunk has once; and the task's part of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros(TABLE_SIZE, np.int64)
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                seq = Sequence(row)
                cells = [c[seq.train] for c in seq.cells()]
                for cell, size, end in zip(cells, TABLES, np.cumsum(TABLES).tolist(), strict=True):
                    tables[end - size : end] += np.bincount(cell, minlength=size)
                gate_of = np.zeros(len(seq.words), np.int64)
                gate_of[seq.ids[seq.train]] = cells[1] >> GATE_LEVELS
                by_hash = np.argsort(seq.hash)
                for kind in range(2):
                    keys, counts = distinct_keys(seq, kind)
                    edges = block_edges(kind, blocks, keys)
                    rows = []
                    for block in np.flatnonzero(np.diff(edges)).tolist():
                        own = slice(edges[block], edges[block + 1])
                        words = None
                        if kind == 0:
                            once = by_hash[own][counts[own] == 1].tolist()
                            words = squeezed(gate_of[once].astype(np.uint8).tobytes() + b"\n".join([seq.words[i] for i in once]))
                        rows.append({"kind": kind, "block": block, "chunk": row["chunk"], "keys": packed(np.diff(keys[own], prepend=_U(0))), "counts": packed(counts[own]), "words": words})
                    yield pa.RecordBatch.from_pylist(rows, schema=KEYED_SCHEMA)
        yield pa.RecordBatch.from_pylist([{"kind": TABLE, "block": b, "chunk": -1, "counts": packed(own)} for b, own in enumerate(tables.reshape(-1, TABLE_BLOCK)) if own.any()], schema=KEYED_SCHEMA)

    return run


# What blocks of the key space have seen.

#: Counts come in steps: exact up to 12, then by about 8 %; those of two tokens, of which there are many, by half a byte.
STEPS = np.unique(np.concatenate([np.arange(13), np.round(12 * 1.08 ** np.arange(1, 244))]).astype(np.int64))[:256]
COARSE = np.array([0, 1, 2, 3, 4, 6, 9, 14, 22, 36, 64, 128, 320, 1000, 5000, 50000])


def quantized(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(STEPS, counts, "right") - 1).astype(np.uint16)


def coarse(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(COARSE, counts, "right") - 1).astype(np.uint8)


def levels(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For sorted distinct keys of contexts: from which level on each is alone in its context, and for each level the
    states (quantized counts of its own side and of the other, in one number) of those that are not.
    """
    alone = np.full(len(keys), CODE_BITS, np.uint8)
    active = np.arange(len(keys))
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def sums(level: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of keys that share ``level`` bits after the context with each active key."""
        own = keys[active] >> _U(CODE_BITS - level)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(own)))
        ends = active[first + size - 1] + 1 if len(first) else first
        return np.repeat(upto[ends] - upto[active[first]], size), np.repeat(ends - active[first], size)

    parent, members = sums(0, active)
    out = []
    for level in range(CODE_BITS):
        more = members > 1
        alone[active[~more]] = level
        active, parent = active[more], parent[more]
        same, members = sums(level + 1, active)
        out.append(coarse(same) << np.uint8(4) | coarse(parent - same))
        parent = same
    return alone, out


STATS_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("block", pa.int32()), ("total", pa.binary()), ("alone", pa.binary()), ("levels", pa.list_(pa.binary())), ("tokens", pa.int64()), ("distinct", pa.int64()), ("once", pa.int64()), ("of_chunk", pa.int64())])
STATS_DDL = "chunk long, kind int, block int, total binary, alone binary, levels array<binary>, tokens long, distinct long, once long, of_chunk long"


def block_stats(of_block: tuple, given: pa.Table) -> pa.Table:
    """What a block's keys have seen, a row for each chunk; for words also rows of the block's totals and of the words
    that occur once in all; or a block of the tables.
    """
    kind, block = (x.as_py() for x in of_block)
    counts = [unpacked(x.as_py(), "<i8" if kind == TABLE else "<u4") for x in given["counts"]]
    if kind == TABLE:
        return pa.Table.from_pylist([{"chunk": -1, "kind": TABLE, "block": block, "total": packed(np.sum(counts, 0))}], schema=STATS_SCHEMA)
    parts = [np.cumsum(unpacked(x.as_py(), "<u8"), dtype=_U) for x in given["keys"]]
    every = np.concatenate(parts)
    order = np.argsort(every)
    every = every[order]
    fresh = np.concatenate([[True], every[1:] != every[:-1]])
    keys = every[fresh]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    total = np.bincount(which, np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    full = []
    if kind:
        alone, columns = levels(keys, total)
        short = coarse(total)
        for level, column in enumerate(columns):
            full.append(np.zeros(len(keys), np.uint8))
            full[-1][alone > level] = column
    rows = []
    done = 0
    for i, (chunk, part) in enumerate(zip(given["chunk"].to_pylist(), parts, strict=True)):
        own = which[done : done + len(part)]
        done += len(part)
        if kind:
            depth = alone[own]
            deep = [packed(column[own[depth > level]]) for level, column in enumerate(full)]
            rows.append({"chunk": chunk, "kind": kind, "block": block, "total": packed(short[own]), "alone": packed(depth), "levels": deep})
        else:
            rows.append({"chunk": chunk, "kind": kind, "block": block, "total": packed(total[own]), "levels": []})
            mine = np.flatnonzero(counts[i] == 1)  # the words that the chunk has once: their gates, then the words
            gates_and_words = expanded(given["words"][i].as_py())
            words = gates_and_words[len(mine) :].split(b"\n")
            kept = [b"%d%s" % (gates_and_words[j], words[j]) for j in np.flatnonzero(total[own[mine]] == 1).tolist()]
            rows.append({"chunk": -1, "kind": ONCE, "block": block, "total": squeezed(b"\n".join(kept)), "once": len(kept), "of_chunk": chunk})
    if kind == 0:
        rows.append({"chunk": -1, "kind": 0, "block": block, "tokens": int(total.sum()), "distinct": int((total > 0).sum())})
    return pa.Table.from_pylist(rows, schema=STATS_SCHEMA)


class Seen:
    """What a chunk's keys of two tokens have seen, one level after the other."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.total = np.concatenate([unpacked(r["total"], "u1") for r in rows])
        self.alone = np.concatenate([unpacked(r["alone"], "u1") for r in rows])
        self.state = self.total << np.uint8(4)

    def at(self, level: int) -> np.ndarray:
        """States at a level; levels are asked for in order. Keys that are alone have nothing on the other side."""
        fresh = self.alone == level
        self.state[fresh] = self.total[fresh] << np.uint8(4)
        active = self.alone > level
        if active.any():
            self.state[active] = np.concatenate([unpacked(r["levels"][level], "u1") for r in self.rows])
        return self.state


# The mixer of code bits.


@lru_cache(4)
def _tables(apart: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """By state, less ``apart`` on the own side: the stretched prediction for the own side, and the class of what the
    context has seen (alike for both sides). ``short``: states of half a byte a side.
    """
    counts = COARSE.astype(np.float64) if short else np.pad(STEPS.astype(np.float64), (0, 256 - len(STEPS)))
    same, other = np.maximum(counts[:, None] - apart, 0), counts[None, :]
    total, less = same + other, np.minimum(same, other)
    kind = np.select([total == 0, less > 0, total == 1, total < 4], [0, 4, 1, 2], 3)
    return np.clip(np.log((same + 0.3) / (other + 0.3)), -8, 8).astype(np.float32).ravel(), kind.astype(np.int8).ravel()


def dense_states(counts: np.ndarray, n_levels: int) -> list[np.ndarray]:
    """For each of the first bits the states (a row for each context) of all that a token's bits can be by then."""
    out = []
    for level in range(n_levels):
        own = counts.reshape(len(counts), 2 << level, -1).sum(2)
        other = own.reshape(len(counts), -1, 2)[:, :, ::-1].reshape(own.shape)
        out.append((quantized(own) << np.uint16(8) | quantized(other)).astype(np.uint16))
    return out


class Dense:
    """States of the bits without context, by gate and by the token before; and the counts of all codes."""

    def __init__(self, counts: np.ndarray):
        self.of_code, gates, one = np.split(counts, np.cumsum(TABLES)[:-1])
        self.none = dense_states(self.of_code[None], CODE_BITS)
        self.by_gate = dense_states(gates.reshape(GATES, -1), GATE_LEVELS)
        self.by_one = dense_states(one.reshape(1 << ONE_BITS, -1), ONE_LEVELS)


def first_weights() -> np.ndarray:
    weights = np.zeros((CODE_BITS, CLASSES * CLASSES, INPUTS), np.float32)
    weights[:] = (0.3, 0.4, 0.3, 0.4)
    weights[ONE_LEVELS:] = (0.3, 0.4, 0.0, 0.7)
    weights[GATE_LEVELS:] = (0.6, 0.0, 0.0, 0.7)
    return weights


class Mixing:
    """The bits of a chunk's tokens, with what every context has seen."""

    def __init__(self, row: dict, stats: list[dict], dense: Dense):
        self.seq = seq = Sequence(row)
        self.dense, self.gate = dense, seq.gates()
        of_kind = [sorted((r for r in stats if r["kind"] == kind), key=lambda r: r["block"]) for kind in range(2)]
        self.seen = Seen(of_kind[1])
        of_word = np.empty(len(seq.hash), np.int64)
        of_word[np.argsort(seq.hash)] = np.arange(len(of_word))
        keys = seq.keys()
        order = np.argsort(keys)
        fresh = np.concatenate([[False], np.diff(keys[order]) != 0])
        self.two = np.empty(len(order), np.int64)
        self.two[order] = np.cumsum(fresh)
        self.code = seq.code[seq.ids].astype(np.int64)
        self.one = (seq.before() >> _U(CODE_BITS - ONE_BITS)).astype(np.int64)
        self.count = np.concatenate([unpacked(r["total"], "<i8") for r in of_kind[0]])[of_word][seq.ids]
        self.is_known = self.count > seq.train

    def known(self, weights: np.ndarray, learning: bool = True, scoring: bool = True) -> np.ndarray:
        """The natural logarithm of every token's mixed probability; -inf for unknown ones.

        Changes the weights in place by the training tokens, of whose counts their own occurrence is taken out. Without
        ``scoring`` the weights are the same, but other tokens, which don't move them, are passed over, and nothing is scored.
        """
        at = np.flatnonzero(self.is_known)
        out = np.full(len(self.code), -np.inf)
        out[at] = np.log(self.count[at] / self.dense.of_code[self.code[at]])
        every, which, learnt = at, slice(None), self.seq.train[at]
        if learning:
            batch = np.arange(len(at)) // SLICE
            order = np.argsort(2 * batch + ~learnt, kind="stable")  # batch by batch, training tokens first
            at, batch, learnt = at[order], batch[order], learnt[order]
            if not scoring:
                at, batch, learnt = at[learnt], batch[learnt], learnt[learnt]
            every = at
        else:  # weights stay, so tokens alike in all that their bits are predicted from are scored once
            alike = ((~learnt).astype(np.int64) << 62) | (self.two[at] << ONE_BITS | self.one[at]) * GATES + self.gate[at]
            _, first, which = np.unique(alike, return_index=True, return_inverse=True)
            at, learnt = at[first], learnt[first]
            n_learnt = int(learnt.sum())
            batch = (np.arange(len(at)) - n_learnt * ~learnt) // SLICE
        edges = np.flatnonzero(np.diff(2 * batch + ~learnt, prepend=-1, append=-1))
        parts = [(slice(a, b), int(learnt[a])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        warm = [p for p in parts if p[1] and batch[p[0].start] < WARM] if learning else []
        given = [x[at] for x in (self.code, self.gate, self.one, self.two)]
        total = np.zeros(len(at), np.float32)
        for level in range(CODE_BITS):
            self._score_bit(level, weights, given, parts, warm, learning, total if scoring else None)
        out[every] += total[which]
        return out

    def _score_bit(self, level: int, weights: np.ndarray, given: list[np.ndarray], parts: list[tuple[slice, int]], warm: list[tuple[slice, int]], learning: bool, total: np.ndarray | None) -> None:
        """Adds the logarithms of one bit's probabilities to ``total``, and refines the bit's weights, both in place."""
        code, gate, one, two = given
        states = self.seen.at(level)
        none = self.dense.none[level][0]
        by_gate = self.dense.by_gate[level].ravel() if level < GATE_LEVELS else None
        by_one = self.dense.by_one[level].ravel() if level < ONE_LEVELS else None
        tables, of_two = ([_tables(apart, short) for apart in range(2)] for short in (False, True))
        shut = none & np.uint16(255) == 0  # all training words are on one side there
        some_shut = bool(shut.any())
        used = [0, *([1] if by_gate is not None else []), *([2] if by_one is not None else []), 3]
        lanes = np.arange(SLICE) % LANES
        w, squares = np.ascontiguousarray(weights[level].T), np.full(weights.shape[:0:-1], 1e-4, np.float32)

        def mixed_bits(part: slice, apart: int) -> tuple:
            """Which tokens have an open bit (None: all), inputs, sets of weights, odds against the own side."""
            node = code[part] >> CODE_BITS - 1 - level
            of = [x[part] for x in (gate, one, two)]
            open_ = None
            if some_shut:
                open_ = np.flatnonzero(~shut.take(node))
                node, *of = (x.take(open_) for x in (node, *of))
            stretch, kind = tables[apart]
            s = states.take(of[2])
            sets = of_two[apart][1].take(s) * np.int8(CLASSES)
            x = {0: stretch.take(none.take(node)), 3: of_two[apart][0].take(s)}
            if by_gate is not None:
                x[1] = stretch.take(by_gate.take(of[0] * (2 << level) + node))
            if by_one is not None:
                t = by_one.take(of[1] * (2 << level) + node)
                x[2] = stretch.take(t)
                sets += kind.take(t)
            sets = sets.astype(np.int64)
            z = x[0] * w[0].take(sets, mode="clip")  # all are inside; this way they aren't looked through for it
            for k in used[1:]:
                z += x[k] * w[k].take(sets, mode="clip")
            return open_, x, sets, np.exp(np.clip(-z, -20, 20))

        def refine(x: dict[int, np.ndarray], sets: np.ndarray, odds: np.ndarray) -> None:
            error = odds / (1 + odds)
            spread = sets * LANES + lanes[: len(sets)]  # sums of a set that most tokens have would wait for each other
            added = lambda v=None: np.bincount(spread, v, minlength=w.shape[1] * LANES).reshape(-1, LANES).sum(1)
            n = np.maximum(added(), 50)
            for k in used:
                step = added(error * x[k]) / n
                squares[k] += step**2
                w[k] += MIXING_RATE * step / np.sqrt(squares[k])

        for part, apart in warm:
            refine(*mixed_bits(part, apart)[1:])
        for part, apart in parts:
            open_, x, sets, odds = mixed_bits(part, apart)
            if total is not None and open_ is None:
                total[part] -= np.log(1 + odds)
            elif total is not None:
                total[part][open_] -= np.log(1 + odds)
            if apart and learning:
                refine(x, sets, odds)
        weights[level] = w.T

    def repeated(self) -> np.ndarray:
        """The natural logarithm of each token's share of its text's tokens so far."""
        seq = self.seq
        order = np.argsort(seq.doc * len(seq.words) + seq.ids, kind="stable")
        fresh = np.concatenate([[True], (np.diff(seq.ids[order]) != 0) | (np.diff(seq.doc[order]) != 0)])
        first = np.flatnonzero(fresh)
        before = np.empty(len(order), np.int64)
        before[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        with np.errstate(divide="ignore"):
            return np.log(before) - np.log(np.maximum(1, np.arange(len(order)) - seq.begins[seq.doc]))


# Spelling of unknown words.


class Spelling:
    """Bits of many (word, gate) pairs at once: their slots in the context tables, their mixing sets, their values."""

    def __init__(self, words: list[bytes], gate: np.ndarray):
        self.n = len(words)
        buffer = np.frombuffer(b" ".join([b"", *words, b""]), np.uint8)[1:] if words else np.zeros(0, np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, self.n) + 1
        begins = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(self.n), sizes)
        self.byte = buffer
        inside = np.arange(len(buffer)) - begins[self.word]
        last = [np.where(inside >= k, np.append(np.zeros(k, np.uint8), buffer)[: len(buffer)], 0).astype(np.uint64) for k in range(1, 7)]
        orders = [np.zeros(len(buffer), np.uint64)]
        for k, byte in enumerate(last):
            orders.append(orders[-1] | byte << np.uint64(8 * k))
        values = mixed(buffer.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) + inside.astype(np.uint64) * np.uint64(2))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values), dtype=np.uint64)])
        prefix = sums[:-1] - sums[begins[self.word]]
        z = (gate.astype(np.uint64) + np.uint64(1))[self.word] << np.uint64(56)
        chosen = (orders[1], orders[2], orders[3] | z, orders[4], orders[5] | z, prefix)
        self.contexts = [mixed(mixed(c) + s) for c, s in zip(chosen, _SALTS, strict=True)]

    def bits(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """For each of a byte's bits: its place, the slots it has in every table, its value."""
        byte = self.byte.astype(np.uint64)
        for j in range(8):
            node = np.uint64(1 << j) | byte >> np.uint64(8 - j)
            node *= np.uint64(0xD6E8FEB86659FD93)
            slots = [((c ^ node) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64) for c in self.contexts]
            yield j, slots, (self.byte >> np.uint8(7 - j)) & np.uint8(1)


class Predictors:
    """Stretched predictions of every slot, and the confidence class (0 to 3) of the longest context's slots.

    ``apart``: predictions for a word that the counts hold, without that word; they depend on its own bit.
    """

    def __init__(self, counts: np.ndarray, apart: bool):
        zeros, ones = counts[..., 0].astype(np.float32), counts[..., 1].astype(np.float32)
        stretch = lambda zeros, ones: np.log((ones + 0.3) / (zeros + 0.3))
        self.apart = apart
        self.sure = np.minimum(3, np.log2(np.maximum(zeros[LONGEST] + ones[LONGEST] - apart, 0) + 1)).astype(np.int8)
        if apart:
            self.table = np.stack([stretch(np.maximum(zeros - 1, 0), ones), stretch(zeros, np.maximum(ones - 1, 0))], -1).reshape(CONTEXTS, -1)
        else:
            self.table = stretch(zeros, ones)

    def read(self, slots: list[np.ndarray], bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.ones((CONTEXTS + 1, len(bit)), np.float32)
        for k, at in enumerate(slots):
            np.take(self.table[k], 2 * at + bit if self.apart else at, out=x[k])
        return x, self.sure[slots[LONGEST]].astype(np.int64)


def _first_spelling() -> np.ndarray:
    weights = np.full((SETS, CONTEXTS + 1), 0.3, np.float32)
    weights[:, -1] = 0
    return weights


def learn(predictors: Predictors, weights: np.ndarray, words: list[bytes], gate: np.ndarray, rate: float) -> None:
    """One online step over a mini-batch of training words, in place."""
    for j, slots, bit in Spelling(words, gate).bits():
        x, sure = predictors.read(slots, bit)
        sets = slice(4 * j, 4 * j + 4)
        z = np.take_along_axis(weights[sets] @ x, sure[None, :], 0)[0]
        error = bit - 1 / (1 + np.exp(-np.clip(z, -20, 20)))
        of_set = (sure == np.arange(4)[:, None]).astype(np.float32)
        weights[sets] += rate * ((of_set * error) @ x.T) / np.maximum(of_set.sum(1), 50)[:, None]


def spelled(predictors: Predictors, weights: np.ndarray, words: list[bytes], gate: np.ndarray) -> np.ndarray:
    """log10 of each word's spelling probability under its gate."""
    spelling = Spelling(words, gate)
    total = np.zeros(len(spelling.byte), np.float64)
    for j, slots, bit in spelling.bits():
        x, sure = predictors.read(slots, bit)
        z = np.clip(np.take_along_axis(weights[4 * j : 4 * j + 4] @ x, sure[None, :], 0)[0], -20, 20)
        total -= np.log1p(np.exp(np.where(bit == 1, -z, z)))
    return np.bincount(spelling.word, total, minlength=spelling.n) / np.log(10)


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block, own in enumerate(counts.reshape(-1, TABLE_BLOCK)):
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed(own)], pa.binary())], names=["block", "counts"])


def _once(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words that occur once, each with the gate that it has there, ``least`` at a time."""

    def part(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        return [w[1:] for w in words], np.fromiter((w[0] - 48 for w in words), np.int64, len(words))

    words: list[bytes] = []
    for batch in batches:
        for given in batch.column("total"):
            words += [w for w in expanded(given.as_py()).split(b"\n") if w]
            while len(words) >= least:
                yield part(words[:least])
                words = words[least:]
    if words:
        yield part(words)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((CONTEXTS, 2 << SLOTS_LOG2), np.int64)
    for words, gate in _once(batches, 25_000):
        for _, slots, bit in Spelling(words, gate).bits():
            for k, at in enumerate(slots):
                tables[k] += np.bincount(2 * at + bit, minlength=2 << SLOTS_LOG2)
    yield from _blocks(tables.ravel())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come sorted by block, one block in memory at a time."""

    def row(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed(total)], pa.binary())], names=["block", "counts"])

    block, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for own, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            if own != block:
                if block is not None:
                    yield row(block, total)
                block, total = own, np.zeros(TABLE_BLOCK, np.int64)
            total += unpacked(counts.as_py(), "<i8")
    if block is not None:
        yield row(block, total)


def _table_of(partial: DataFrame, size: int) -> np.ndarray:
    """A table of fixed size, added up from ``partial``'s blocks on the cluster."""
    out = np.zeros(size, np.int64).reshape(-1, TABLE_BLOCK)
    for r in partial.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, counts binary").toLocalIterator():
        out[r.block] = unpacked(bytes(r.counts), "<i8")
    return out


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        groups = batch.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        yield from ((int(groups[i]), batch.slice(i, j - i)) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i)


def _spelling_learned(shared):  # noqa: ANN001, ANN202
    """Weights that each group of blocks learns from the start on; rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictors = Predictors(shared.value, True)
        for _, own in groupby(_by_group(batches), lambda x: x[0]):
            weights, done = _first_spelling(), 0
            for words, gate in _once((batch for _, batch in own), 2000):
                learn(predictors, weights, words, gate, RATE * max(0.1, 1 / (1 + done / 50)))
                done += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(weights.size)), pa.array(weights.ravel().astype(float) * done), pa.array(np.full(weights.size, float(done)))], names=["at", "w", "n"])

    return run


def _averaged(sums: DataFrame, first: np.ndarray) -> np.ndarray:
    """``first`` with the averages of ``w`` over ``n`` where there are any: as many rows as there are weights.

    They are rounded, so that the order of the sums can't be seen in them.
    """
    weights = first.ravel()
    with shuffles_removed(sums.sparkSession):
        rows = sums.groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).filter("n > 0").collect()
    for r in rows:
        weights[r["at"]] = round(r.w / r.n, 5)
    return weights.reshape(first.shape)


def blended(parts: np.ndarray, sizes: np.ndarray, prior: tuple[float, ...]) -> np.ndarray:
    """log10 probability of every text from the logarithms of its tokens' probabilities by each part (a column each).

    All texts go through their next block of tokens together; longest texts come first inside.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = np.cumsum(sizes) - sizes
    blocks = -(-sizes[order] // BLOCK)
    columns = np.ascontiguousarray(parts.T)
    weights = np.tile(np.array(prior)[:, None], (1, len(sizes)))
    out = np.zeros(len(sizes))
    for b in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(-blocks, -b, "left"))
        docs = order[:n]
        left = np.minimum(BLOCK, sizes[docs] - b * BLOCK)
        which = np.repeat(np.arange(n), left)
        at = (begins[docs] + b * BLOCK)[which] + np.arange(len(which)) - np.repeat(np.cumsum(left) - left, left)
        logs = columns.take(at, 1) + np.log(weights[:, :n]).take(which, 1)
        most = logs.max(0)
        share = np.exp(logs - most)
        p = share.sum(0)
        out[docs] += np.bincount(which, most + np.log(p), minlength=n)
        share /= p
        good = np.stack([np.bincount(which, s, minlength=n) for s in share])
        fresh = np.maximum((good + 32 * weights[:, :n]) / (good.sum(0) + 32), LEAST_SHARE)
        weights[:, :n] = fresh / fresh.sum(0)
    return out / np.log(10)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/mixing-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``train``, ``n_tokens n_known train_tokens base_score score bits_per_byte``.

    ``train``: which rows the model learns from. ``base_score`` is the smoothed frequency model's log10 probability,
    ``score`` this model's, ``bits_per_byte`` its bits for each byte of the text (null for an empty one). Ids must be longs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("t"))
    n_bytes = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 1)).first()[0] or 0
    of_text = F.xxhash64("t", "train")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("i", of_text), F.lit(max(1, -(-n_bytes // CHUNK_BYTES))))).repartition("chunk").sortWithinPartitions("chunk", "i", of_text)
    coded = stored(dealt.mapInArrow(_coded, CHUNK_DDL), "chunks")
    release(spark)
    blocks = 1 + (coded.agg(F.sum("tokens")).first()[0] or 0) // BLOCK_TOKENS
    stats = stored(coded.mapInArrow(_keyed(blocks), KEYED_DDL).groupBy("kind", "block").applyInArrow(block_stats, STATS_DDL), "stats")
    release(spark)
    totals = stats.filter("chunk < 0")
    n, v, once = (x or 0 for x in totals.agg(F.sum("tokens"), F.sum("distinct"), F.sum("once")).first())
    counts = np.zeros(TABLE_SIZE, np.int64).reshape(-1, TABLE_BLOCK)
    for r in totals.filter(F.col("kind") == TABLE).select("block", "total").toLocalIterator():
        counts[r.block] = unpacked(bytes(r.total), "<i8")
    dense = spark.sparkContext.broadcast(Dense(counts.ravel()))
    group = F.floor(F.col("block") / SPELL_BLOCKS).alias("group")
    new_words = totals.filter((F.col("kind") == ONCE) & (F.col("once") > 0)).select(group, "block", "of_chunk", "total").repartition("group").sortWithinPartitions("group", "block", "of_chunk")
    slots = _table_of(new_words.mapInArrow(_count_slots, "block int, counts binary"), CONTEXTS << SLOTS_LOG2 + 1).reshape(CONTEXTS, 1 << SLOTS_LOG2, 2)
    shared = spark.sparkContext.broadcast(np.minimum(slots, 2**31 - 1).astype(np.int32))
    spelling = _averaged(new_words.mapInArrow(_spelling_learned(shared), "at long, w double, n double"), _first_spelling())
    unseen = min(0.5, max(0.001, once / max(1, n)))
    prior = (*((1 - unseen) * share for share in KNOWN), unseen)

    def learned(row: pa.Table, own: pa.Table) -> pa.Table:
        mixing, weights = Mixing(row.to_pylist()[0], own.to_pylist(), dense.value), first_weights()
        mixing.known(weights, scoring=False)
        n_learnt = float(mixing.seq.train.sum())
        return pa.table({"at": np.arange(weights.size), "w": weights.ravel().astype(float) * n_learnt, "n": np.full(weights.size, n_learnt)})

    def of_chunks(run, kind: str) -> DataFrame:  # noqa: ANN001
        own = stats.filter("chunk >= 0").select("chunk", "kind", "block", "total", "alone", "levels")
        return coded.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, kind)

    weights = _averaged(of_chunks(learned, "at long, w double, n double"), first_weights())
    release(spark)

    def scored(row: pa.Table, own: pa.Table) -> pa.Table:
        given = row.to_pylist()[0]
        mixing = Mixing(given, own.to_pylist(), dense.value)
        seq, size = mixing.seq, len(mixing.seq.sizes)
        unknown = np.flatnonzero(~mixing.is_known)
        pairs, which = np.unique(seq.ids[unknown] * GATES + mixing.gate[unknown], return_inverse=True)
        spelled_log = np.full(len(seq.ids), -np.inf)
        if len(unknown):
            predictors = Predictors(shared.value, False)
            parts = [pairs[i : i + 20_000] for i in range(0, len(pairs), 20_000)]
            spelled_log[unknown] = np.concatenate([spelled(predictors, spelling, [seq.words[i] for i in (p // GATES).tolist()], p % GATES) for p in parts])[which] * np.log(10)
        score = blended(np.stack([mixing.known(weights, learning=False), mixing.repeated(), spelled_log], 1), seq.sizes, prior)
        base = np.bincount(seq.doc, np.log10((mixing.count + 0.5) / (n + 0.5 * (v + 1))), minlength=size)
        lengths = unpacked(given["bytes"], "<i8")
        per_byte = pa.array(-score / np.log10(2) / np.maximum(lengths, 1), mask=lengths == 0)
        known = np.bincount(seq.doc, mixing.count > 0, minlength=size).astype(np.int64)
        return pa.table({"doc_id": pa.array(seq.doc_id, pa.int64()), "train": seq.doc_train, "n_tokens": seq.sizes, "n_known": known, "train_tokens": np.full(size, n), "base_score": base, "score": score, "bits_per_byte": per_byte})

    return of_chunks(scored, SCORES).withColumnRenamed("doc_id", id_col)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), id_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
