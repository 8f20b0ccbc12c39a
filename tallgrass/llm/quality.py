"""Quality rules: word counts, repetition, and how well a public tokenizer fits a text.

Base rules need at least 20 words, and at most 30 % of the words in 8-word
windows that the text repeats. Tokenizer fertility then reads three figures
from the public 32k-piece vocabulary over the whole text, white space and line
breaks included: characters per token, the share of byte-fallback tokens (those
of line breaks and tabs, which the vocabulary has no pieces for, left out) and the
entropy of the text's tokens. Each script has a band for every figure, and a text
outside a band is rejected, whatever its length. The bands are wide: they are
there for encoded, garbled or one-symbol text, and prose of any language that the
script is used for lies inside them.

Null and empty texts have no words and no tokens and fail the base rules; an empty
table gives no rows. Rows are independent: no shuffle, repeated rows are measured
each, and memory is bounded by an Arrow batch and the longest text's tokens.
Repeated windows are found by 64-bit hashes of words and of eight words together;
windows of different words with one hash would count as equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.common import table, text_slices
from tallgrass.llm.words import NOT_SPACE, Words

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_FIRST_BYTES = np.ones(256, np.int64)
_FIRST_BYTES[0x80:0xC0] = 0
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: By script: least and most characters per token, most byte-fallback share, least token entropy in bits.
#: Scripts that the vocabulary covers poorly fall back to bytes in clean text too, hence their wide bands.
BANDS = {
    "LATIN": (1.15, 9.0, 0.25, 2.0),
    "CYRILLIC": (0.9, 9.0, 0.5, 2.0),
    "GREEK": (0.6, 9.0, 0.8, 2.0),
    "other": (0.2, 12.0, 1.01, 1.0),
}
#: Byte pieces of white space say nothing of how well a vocabulary covers a text.
SPACE_BYTES = b"\t\n\x0b\x0c\r "

FIELDS = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()), ("kept", pa.bool_())]
)
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, kept boolean"


@lru_cache(100_000)
def _script(char: str) -> str:
    return unicodedata.name(char, "other").split(" ")[0] if char.isalpha() else ""


def main_script(text: str) -> str:
    """The script of most letters among every character of the text; ties go by name; "other" without letters."""
    counts: dict[str, int] = {}
    ascii_letters = 0
    for char, n in zip(*np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True), strict=True):
        if char < 128:
            ascii_letters += int(n) if chr(char).isalpha() else 0
        elif name := _script(chr(char)):
            counts[name] = counts.get(name, 0) + int(n)
    counts["LATIN"] = counts.get("LATIN", 0) + ascii_letters
    best = min(counts, key=lambda s: (-counts[s], s))
    return best if counts[best] else "other"


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """For each text, its words inside windows that occur twice or more in it."""
    first, found = words.windows(hashes, WINDOW)
    own = found + words.doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, first[twice], 1)
    np.add.at(steps, first[twice] + WINDOW, -1)
    return words.per_text(np.cumsum(steps[:-1]) > 0)


class Fertility:
    """Figures of texts by a public SentencePiece vocabulary, which encodes each text as a whole."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        pieces = range(self.model.get_piece_size())
        spaces = {f"<0x{b:02X}>" for b in SPACE_BYTES}
        self.bytes = np.array([self.model.is_byte(i) and self.model.id_to_piece(i) not in spaces for i in pieces])

    def figures(self, texts: list[str]) -> dict[str, np.ndarray]:
        n = len(texts)
        pieces = self.model.encode(texts, num_threads=1)
        total = np.fromiter(map(len, pieces), np.int64, n)
        tokens = np.fromiter(chain.from_iterable(pieces), np.int64, int(total.sum()))
        doc = np.repeat(np.arange(n), total)
        of_bytes = np.bincount(doc, self.bytes[tokens], minlength=n)
        pairs = np.sort(doc * len(self.bytes) + tokens)
        edge = np.flatnonzero(np.diff(pairs, prepend=-1))
        counts = np.diff(edge, append=len(pairs)).astype(float)
        inner = np.bincount(pairs[edge] // len(self.bytes), counts * np.log2(np.maximum(counts, 1)), minlength=n)
        some = np.maximum(total, 1)
        chars = np.fromiter(map(len, texts), np.int64, n)
        return {"n_tokens": total, "chars_per_token": chars / some, "byte_share": of_bytes / some, "token_entropy": np.where(total > 0, np.log2(some) - inner / some, 0.0)}


def measure(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, bands: dict[str, tuple[float, float, float, float]] = BANDS) -> DataFrame:
    """``docs`` with the columns of ``DDL``; a column of ``docs`` with such a name gives way."""
    names = [f.name for f in FIELDS]
    kept = docs.drop(*[n for n in names if n in docs.columns and n != text_col])
    if text_col in names:
        raise ValueError(f"the text column can't be called {text_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        fertility = Fertility(vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
        for batch, texts in text_slices(batches, text_col, 1 << 20):
            words = Words(texts, NOT_SPACE)
            hashes = words.hashes()
            n = len(texts)
            ends = np.append(words.text_starts[1:] - 1, len(words.raw))
            upto = np.concatenate([[0], np.cumsum(_FIRST_BYTES[words.raw])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[words.raw])])
            chars = words.per_text(upto[words.ends] - upto[words.starts])
            counts = words.counts()
            repeat = repeated_words(words, hashes)
            out = {"n_words": counts, "word_chars": chars, "n_symbols": symbols[ends] - symbols[words.text_starts], "n_dup_lines": [repeated_lines(t) for t in texts], "n_repeat_words": repeat}
            out["base_failed"] = (counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * counts)
            decoded = [t.decode("utf-8", "replace") for t in texts]
            out |= fertility.figures(decoded)
            out["script"] = list(map(main_script, decoded))
            low, high, most_bytes, least = np.array([bands.get(s, bands["other"]) for s in out["script"]]).reshape(n, 4).T
            outside = (out["chars_per_token"] < low) | (out["chars_per_token"] > high) | (out["byte_share"] > most_bytes) | (out["token_entropy"] < least)
            out["kept"] = ~out["base_failed"] & ~outside
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pc.cast(pa.array(out[f.name]), f.type) for f in FIELDS)], names=[*batch.schema.names, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{ddl}, {DDL}")


def op10_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = measure(docs)
    return measured.select("doc_id", *[f.name for f in FIELDS])
