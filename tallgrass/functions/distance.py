"""Edit distance of a needle to its best place in a text, with places that begin and end at word borders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


class _Letters:
    """A text whose places of each letter are the bits of a number."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.size = len(self.codes)
        self.places: dict[int, int] = {}

    def where(self, letter: int) -> int:
        if letter not in self.places:
            self.places[letter] = int.from_bytes(np.packbits(self.codes == letter, bitorder="little").tobytes(), "little")
        return self.places[letter]

    def least(self, up: int, down: int, base: int) -> int:
        """The least value of a row that begins with ``base`` and rises and falls by one at these bits."""
        bits = [np.unpackbits(np.frombuffer(x.to_bytes((self.size + 7) // 8, "little"), np.uint8), bitorder="little")[: self.size].view(np.int8) for x in (up, down)]
        return base + min(0, int(np.cumsum(bits[0] - bits[1], dtype=np.int32).min(initial=0)))


#: A page's candidates come one after another.
_letters = lru_cache(2)(_Letters)


def surely_beyond(needle: np.ndarray, text: _Letters, budget: int) -> bool:
    """Whether every run of letters, at whatever places it begins and ends, needs more edits than ``budget``.

    All columns of a row of the table are worked out at once, as bits of differences along it (Myers, Hyyrö).
    """
    full = (1 << text.size) - 1
    up = down = 0
    for i, letter in enumerate(needle.tolist(), 1):
        equal = text.where(letter)
        turned = ((((equal & up) + up) ^ up) | equal) & full
        rise = ((down | (full ^ (turned | up))) << 1 | 1) & full
        fall = ((up & turned) << 1) & full
        other = equal | down
        up, down = fall | (full ^ (other | rise)), rise & other
        if i > budget and (i % 24 == 0 or i == len(needle)) and text.least(up, down, i) > budget:
            return True
    return False


def substring_distance(needle: str, text: str, budget: int) -> int:
    """Least edits from ``needle`` to a run of whole words of ``text``.

    A run's first letter stands against a letter of the needle, it is not inserted. Only comparisons with ``budget`` are meaningful: a distance beyond it may come out as any larger number.
    Most pairs are told to be beyond by ``surely_beyond``. For the rest one row of the table at a time is computed. A row is kept less its column, so an insertion costs nothing there, insertions
    along a row are a running minimum, and a match is -1: those of each letter are looked up once.
    """
    n, m = len(needle), len(text)
    if not n or not m or m < n - budget:
        return n if n else 0
    whole = _letters(text)
    letters, asked = whole.codes, np.frombuffer(needle.encode("utf-32-le"), np.uint32)
    if surely_beyond(asked, whole, budget):
        return budget + 1
    starts = np.concatenate([[True], letters == 32])
    small = np.int16 if 2 * m + n + budget < 32_000 else np.int32
    along = np.arange(m + 1, dtype=small)
    row = np.where(starts, 0, budget + 1).astype(small) - along
    matches = {letter: -(letters == letter).astype(small) for letter in np.unique(asked).tolist()}
    best, diagonal, one = np.empty_like(row), np.empty(m, small), small(1)
    for i, letter in enumerate(asked.tolist(), 1):
        np.add(row, one, out=best)
        np.add(row[:-1], matches[letter], out=diagonal)
        np.minimum(best[1:], diagonal, out=best[1:])
        np.minimum.accumulate(best, out=row)
        if i % 8 == 0 and (row + along).min() > budget:
            return budget + 1
    ends = np.append(letters == 32, True)
    return int(min(budget + 1, (row + along)[ends].min()))


@F.pandas_udf(IntegerType())
def _distances(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for needles, texts, budgets in batches:
        yield pd.Series([None if a is None or b is None else substring_distance(a, b, int(k)) for a, b, k in zip(needles, texts, budgets, strict=True)], dtype="Int32")


def distance(needle: Column, text: Column, budget: Column) -> Column:
    return _distances(needle, text, budget)


def similarity(edits: Column, needle: Column) -> Column:
    return 1 - edits / F.greatest(F.length(needle), F.lit(1))
