"""Removal of long repeated byte strings, by a run-length index.

Every byte goes that lies in a string of ``size`` bytes which also starts anywhere
else. Strings that are equal must meet in one task without a row for each place:

1. A window's key is the smallest hash of its grams of some length, so equal windows
   have equal keys. Neighbouring windows mostly share their key; a run of them is a
   region, and each window of a text lies in one region.
2. Equal texts, then equal regions are counted before anything else and go on as
   one, with their number. Regions whose key's gram comes once are alone and go no further.
3. The other regions are dealt out by key. A task joins regions of whole keys to a
   block and builds its Burrows-Wheeler transform, compressed to runs, with the
   suffixes at both ends of each run sampled and their common lengths with the
   neighbour across the border. Within a run the neighbour moves along with the
   suffix and the common length falls by one a step, so the samples give the
   matching statistics of the whole block in one pass over it. Windows whose match
   is long enough, or whose region occurs more than once, are repeated.
4. The regions of a key can be too many for a block: a passage that very many texts
   hold, each with other surroundings. They are cut again under longer grams, so that
   only what they share meets. The longest grams are the windows themselves, and
   then a key has one region.

Runs of repeated windows go back to the regions' places and join to spans.

Null texts are empty. Texts shorter than ``size`` have no repeats. Repeated rows
repeat each other, so long ones are removed whole, all of them. Matches may overlap
and lie in one text; they never cross texts. Ids are only carried. Other columns
stay, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import release, table, text_slices, written
from tallgrass.llm.words import Words

SIZE = 400
#: Grams' lengths, as shares of a window; the last are whole windows.
GRAMS = (0.12, 0.56, 0.78, 0.89, 0.945, 0.975, 1.0)
#: Bytes of regions that one index holds, about, and of a key's regions before it is cut again.
BLOCK_BYTES, KEY_BYTES = 1 << 20, 4 << 20
#: Windows in a region at most; longer runs of one key are several regions.
REGION = 1 << 14
#: Bytes of text in work at a time. Parts overlap, so no window is lost.
PART = 1 << 20
NO_BYTE = 0xFF


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by minima from block borders to both sides."""
    n = len(values)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(text: bytes, size: int, gram: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first window, number of windows, key, whether the key's gram lies in it more than once) of each region of a text.

    A window is called by its first byte.
    """
    windows = len(text) - size + 1
    for begin in range(0, max(windows, 0), PART):
        part = text[begin : min(begin + PART, windows) + size - 1]
        starts = np.arange(len(part) - gram + 1)
        grams = Words([part], _ANY).span_hashes(starts, starts + gram)
        keys = _sliding_minimum(grams, size - gram + 1)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = np.r_[0, cuts, len(keys)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            twice = b - a > size - gram + 1 or np.count_nonzero(grams[a : b + size - gram] == keys[a]) > 1
            for i in range(a, b, REGION):
                yield begin + i, min(REGION, b - i), int(keys[a]) - (1 << 63), twice


_ANY = np.ones(256, bool)


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of ``text``, with samples at both ends of each run.

    ``firsts`` and ``lasts`` hold, by place in the text, the sampled suffixes and how much they share with the suffix
    sorted just before a run's first, or just after a run's last.
    """

    def __init__(self, text: np.ndarray):
        order = _suffix_order(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # nothing; a run of its own
        starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        ends = np.r_[starts[1:], len(text)] - 1
        self.size = len(text)
        self.heads = before[starts]
        self.lengths = ends - starts + 1
        across = _common(text, order[starts[1:]], order[ends[:-1]])
        self.firsts = self._by_place(order[starts], np.r_[0, across])
        self.lasts = self._by_place(order[ends], np.r_[across, 0])

    @staticmethod
    def _by_place(places: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        along = np.argsort(places)
        return places[along], shared[along]

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of the longest string from there that also starts elsewhere, read off the samples in the text's order."""
        out = np.zeros(self.size, np.int64)
        for places, shared in (self.firsts, self.lasts):
            steps = np.diff(np.r_[places, self.size])
            at = np.repeat(np.arange(len(places)), steps)
            own = shared[at] - (np.arange(places[0], self.size) - places[at])
            np.maximum(out[places[0] :], own, out=out[places[0] :])
        return out


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order. Ranks by 7 bytes are doubled; what stands alone is left out of further rounds."""
    n = len(text)
    padded = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)]
    keys = np.zeros(n, np.uint64)
    for i in range(7):
        keys = keys << np.uint64(9) | padded[i : i + n]
    order = np.argsort(keys)
    ranked = keys[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.zeros(2 * n + 8, np.int64)  # 0: beyond the end
    rank[order] = first + 1
    step = 7
    open_at = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(open_at):
        suffixes = order[open_at]
        ahead = np.minimum(suffixes + step, n)
        keys = first[open_at].astype(np.uint64) << np.uint64(32) | rank[ahead].astype(np.uint64)
        along = np.argsort(keys)
        order[open_at] = suffixes[along]
        ranked = keys[along]
        head = np.r_[True, ranked[1:] != ranked[:-1]]
        begins = np.maximum.accumulate(np.where(head, np.arange(len(open_at)), 0))
        first[open_at] = open_at[begins]
        rank[order[open_at]] = first[open_at] + 1
        open_at = open_at[~(head & np.r_[head[1:], True])]
        step *= 2
    return order


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes from ``a`` and ``b`` have in common, pair by pair."""
    n = len(text)
    padded = np.r_[text, np.zeros(16, np.uint8)]
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 8]).view("<u8").ravel()
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        x, y = a[left] + out[left], b[left] + out[left]
        inside = np.maximum(x, y) + 8 <= n
        differ = np.where(inside, eight[np.minimum(x, n)] ^ eight[np.minimum(y, n)], np.uint64(1))
        equal = inside & (differ == 0)
        low = differ & (~differ + np.uint64(1))  # its lowest set bit
        out[left] += np.where(equal, 8, np.where(inside, np.bitwise_count(low - np.uint64(1)) // 8, 0))
        for i in left[~inside].tolist():  # the text's last bytes
            while max(a[i], b[i]) + out[i] < n and text[a[i] + out[i]] == text[b[i] + out[i]]:
                out[i] += 1
        left = left[equal]
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_in(texts: list[bytes], counts: list[int], size: int) -> list[list[tuple[int, int]]]:
    """For each of some different regions the runs (from, to) of windows that occur again, in it or another one."""
    text = np.frombuffer(b"".join(t + bytes([NO_BYTE]) for t in texts), np.uint8)
    lengths = RunLengthIndex(text).matching_statistics()
    out, at = [], 0
    for t, n in zip(texts, counts, strict=True):
        windows = len(t) - size + 1
        out.append([(0, windows)] if n > 1 else _runs(lengths[at : at + windows] >= size))
        at += len(t) + 1
    return out


SPANS = "array<struct<a:int,b:int>>"


def _spans(runs: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([r for own in runs for r in own], np.int32).reshape(-1, 2)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(own) for own in runs])].astype(np.int32)), rows)


def _repeated(texts: DataFrame, size: int, level: int = 0) -> DataFrame:
    """``i runs`` of different texts (i, t binary, n: how often), those with a repeated window: runs of first bytes (a, b)."""
    spark = texts.sparkSession
    gram = max(1, min(size, round(GRAMS[level] * size)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, given in text_slices(batches, "t"):
            rows = [(i, a, n, k, twice, xxhash.xxh3_128_digest(t[a : a + n + size - 1])) for i, t in enumerate(given) for a, n, k, twice in regions(t, size, gram)]
            which, first, windows, key, twice, own = zip(*rows, strict=True) if rows else [()] * 6
            of = batch.select(["i", "n"]).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array(first, pa.int32()), pa.array(windows, pa.int32()), pa.array(key, pa.int64()), pa.array(twice, pa.bool_()), pa.array(own, pa.binary())], names=["i", "n", "first", "windows", "key", "twice", "r"])

    kind = texts.schema["i"].dataType.simpleString()
    every = written(texts.filter(F.octet_length("t") >= size).select("i", "n", "t").mapInArrow(cut, f"i {kind}, n long, first int, windows int, key long, twice boolean, r binary"), "regions")
    keys = every.groupBy("key").agg(F.sum("n").alias("all"), F.bool_or("twice").alias("inside")).filter("all > 1 OR inside").select("key")
    places = written(every.join(keys, "key"), "places")
    release(spark)
    kinds = places.groupBy("key", "r").agg(F.sum("n").alias("n"), F.min(F.struct("i", "first", "windows")).alias("at"))
    kinds = written(kinds.select("key", "r", "n", "at.*"), "kinds")
    large = kinds.groupBy("key").agg(F.sum(F.col("windows").cast("long") + (size - 1)).alias("bytes")).filter(F.col("bytes") > KEY_BYTES).select("key", F.lit(level + 1 < len(GRAMS)).alias("again"))
    wanted = kinds.join(large, "key", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    listed = wanted.groupBy("i").agg(F.collect_list(F.struct("key", "r", "n", "first", "windows", "again")).alias("w"))  # regions of one text
    found = texts.select("i", "t").join(listed, "i").select("t", F.explode("w").alias("w"))
    cuts = found.select("w.key", "w.r", "w.n", "w.again", F.substring("t", F.col("w.first") + 1, F.col("w.windows") + (size - 1)).alias("t"))
    cuts = written(cuts, "cuts")
    release(spark)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, counts, given, held = [], [], [], [], 0

        def closed(upto: int) -> pa.RecordBatch:
            nonlocal held
            runs = repeated_in(given[:upto], counts[:upto], size)
            some = [i for i, own in enumerate(runs) if own]
            out = pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.binary()), _spans([runs[i] for i in some])], names=["r", "runs"])
            for rows in (keys, names, counts, given):
                del rows[:upto]
            held = sum(map(len, given))
            return out

        for batch in batches:
            for key, name, n, text in zip(*(batch.column(c).to_pylist() for c in ("key", "r", "n", "t")), strict=True):
                if held >= BLOCK_BYTES and key != keys[-1]:
                    yield closed(len(keys))
                keys.append(key)
                names.append(name)
                counts.append(n)
                given.append(text)
                held += len(text)
        if given:
            yield closed(len(given))

    blocks = cuts.filter("NOT again").select("key", "r", "n", "t").repartition("key").sortWithinPartitions("key")
    marks = blocks.mapInArrow(indexed, f"r binary, runs {SPANS}")
    if cuts.filter("again").limit(1).count():
        marks = marks.unionByName(_repeated(cuts.filter("again").select(F.col("r").alias("i"), "t", "n"), size, level + 1).withColumnRenamed("i", "r"))
    marks = written(marks, "marks")
    moved = F.transform("runs", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    of_text = places.select("i", "first", "r").join(marks, "r").groupBy("i").agg(F.flatten(F.collect_list(moved)).alias("runs"))  # runs of one text
    return of_text


def _spans_of(runs: list[dict], size: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows of some runs, as spans in order and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] + size - 1) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cleaned_texts(docs: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``h spans kept`` of every different text with repeats: its SHA-256, the spans of bytes to remove, and what is left."""
    if size < 1:
        raise ValueError("a repeated string has one byte at least")
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).withColumn("h", F.unhex(F.sha2("t", 256)))
    once = own.groupBy("h").agg(F.first("t").alias("t"), F.count("*").alias("n"))
    texts = written(once.select(F.monotonically_increasing_id().alias("i"), "h", "t", "n"), "texts")
    release(spark)
    runs = _repeated(texts, size)
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, given in text_slices(batches, "t"):
            spans = [_spans_of(r, size) for r in batch.column("runs").to_pylist()]
            kept = [b"".join(t[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(t)], strict=True)) for t, own in zip(given, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["h", "spans", "kept"])

    return texts.select("i", "h", "t").join(runs, "i").mapInArrow(cut, "h binary, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``repeat_spans`` (array of start, end in bytes) and ``kept_bytes`` (what is left of the text).

    Columns of these names are replaced. What is left is bytes, as a span may end inside a character.
    """
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = f"_hash_of_{text_col}"
    cleaned = cleaned_texts(docs, text_col, size).select(F.col("h").alias(own), F.col("spans").alias(f"{own}_spans"), F.col("kept").alias(f"{own}_kept"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = docs.withColumn(own, F.unhex(F.sha2(whole, 256))).join(cleaned, own, "left")
    found = found.withColumns({"repeat_spans": F.coalesce(f"{own}_spans", none), "kept_bytes": F.coalesce(f"{own}_kept", whole)})
    return found.drop(own, f"{own}_spans", f"{own}_kept")


def op12_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.coalesce("text", F.lit("")).cast("binary")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cleaned = cleaned_texts(docs).select("h", removed.alias("removed"), F.size("spans").cast("long").alias("spans"), F.sha2("kept", 256).alias("kept_hash"))
    own = docs.select("doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.unhex(F.sha2(whole, 256)).alias("h")).join(cleaned, "h", "left")
    none = F.lit(0).cast("long")
    return own.select("doc_id", "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("kept_hash", F.lower(F.hex("h"))).alias("kept_sha256"))
