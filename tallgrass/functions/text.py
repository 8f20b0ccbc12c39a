"""Text functions as columns: comparison keys, shortening, classification.

Keys pass an Arrow UDF, so a text's key is worked out once however often a plan names it. As a native expression it was
repeated for each filter, branch and join on it, and one pass of its regular expressions cost more than the UDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallgrass.functions import rules

_SPACES = rf"(?U)[\s\x1C-\x1F{rules.BLANK_GLYPHS}]+"
ELLIPSIS = "…"


def _by_rule(rule):  # noqa: ANN001, ANN202
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(rule, na_action="ignore")

    return run.asNondeterministic()  # keeps the optimizer from working a key out again for each filter on it


_fold, _norm, _key, _solid = (_by_rule(f) for f in (rules.fold, rules.norm, rules.key, rules.solid))


def _c(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def key_of_norm(norm_text: Column) -> Column:
    """The key of a text that ``norm`` has gone through."""
    return F.trim(F.regexp_replace(norm_text, r"[^\p{L}\p{N}_]+", " "))


def solid_of_key(key_text: Column) -> Column:
    return F.replace(key_text, F.lit(" "), F.lit(""))


def fold(text: Column | str) -> Column:
    return _fold(_c(text))


def norm(text: Column | str) -> Column:
    """One kind of quotes, dashes and spaces, formulas in plain signs, lower case."""
    return _norm(_c(text))


def key(text: Column | str) -> Column:
    """``norm`` without punctuation; words stay apart."""
    return _key(_c(text))


def solid(text: Column | str) -> Column:
    """``key`` without spaces."""
    return solid_of_key(key(text))


def solid_usable(solid_text: Column) -> Column:
    return F.length(solid_text) >= rules.SOLID_MIN


def text_forms(text: Column | str) -> Column:
    own = key(text)
    return F.struct(own.alias("key"), F.replace(own, F.lit(" "), F.lit("")).alias("solid"))


def clean_text(text: Column | str) -> Column:
    """White space and empty-field glyphs collapsed; case and punctuation stay."""
    return F.trim(F.regexp_replace(_c(text), _SPACES, " "))


def brief(text: Column | str, limit: int = 80) -> Column:
    one = clean_text(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.left(one, F.lit(limit - 1)), F.lit(ELLIPSIS)))


def words_of(key_text: Column) -> Column:
    return F.filter(F.split(key_text, " "), lambda w: w != "")


def question_parts(text: Column | str) -> Column:
    """Normalised parts of a question joined by ``...``, without blank ones; null if it has no ``...``."""
    own = norm(text)
    parts = F.filter(F.transform(F.split(own, r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(own.contains("..."), parts)


def max_distance(length: Column, least: int = 4) -> Column:
    return F.greatest(F.lit(least), F.floor(length * 0.1 + 0.5)).cast("int")


def dice(one: Column, other: Column) -> Column:
    """Overlap of two arrays as sets: 0 if either is empty."""
    a, b = F.array_distinct(one), F.array_distinct(other)
    both = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.lit(0.0))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian agreement of a noun with a number."""
    tail, last = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tail.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def unquote(text: Column | str) -> Column:
    """Without one pair of equal quotes around, and without outer spaces."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"""(?s)^".*"$|^'.*'$""") & (F.length(t) > 1), F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def crossword_word(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), _SPACES, ""))


def item_number(text: Column | str) -> Column:
    """The number at the end of an id, or 0."""
    return F.coalesce(F.regexp_extract(_c(text), r"(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))


def trim_ellipsis(text: Column | str) -> Column:
    """Without one closing ellipsis, outer spaces, and the commas before it."""
    t = _c(text)
    bare = F.trim(F.rtrim(F.trim(F.left(t, F.length(t) - 1)), F.lit(",")))
    return F.when(t.endswith(ELLIPSIS), bare).otherwise(t)


def scenario_fragment(text: Column | str, limit: int = 60) -> Column:
    """The beginning of a text, less its last word where there is more than one, without ``...`` and outer punctuation."""
    one = F.trim(F.regexp_replace(F.replace(_c(text), F.lit("..."), F.lit(" ")), r"(?U)\s+", " "))
    cut = F.regexp_replace(F.left(one, F.lit(limit)), r" [^ ]*$", "")
    return F.trim(F.btrim(cut, F.lit(" .,;:—-–")))


def status_of(text: Column | str, wrong: str, partial: str, correct: str) -> Column:
    """The first class whose pattern occurs: wrong, partial, correct, else unknown. The order matters where patterns overlap."""
    t = F.lower(_c(text))
    return F.when(t.rlike(wrong), "wrong").when(t.rlike(partial), "partial").when(t.rlike(correct), "correct").otherwise("unknown")


def decode_fallback(raw: Column) -> Column:
    """Bytes in the first of UTF-8, cp866 and cp1251 that reads them, else UTF-8 with marks."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data: bytes) -> str:
            for name in ("utf-8", "cp866", "cp1251"):
                try:
                    return bytes(data).decode(name)
                except UnicodeDecodeError:
                    continue
            return bytes(data).decode("utf-8", "replace")

        for batch in batches:
            yield batch.map(one, na_action="ignore")

    return run(raw)


def register(spark: SparkSession) -> None:
    """``text_fold``, ``text_norm``, ``text_key`` and ``text_solid`` for SQL."""
    for name, udf in (("text_fold", _fold), ("text_norm", _norm), ("text_key", _key), ("text_solid", _solid)):
        spark.udf.register(name, udf)


