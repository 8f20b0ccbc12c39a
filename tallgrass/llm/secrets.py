"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

``find_secrets`` adds to each row the spans of its text that look like secrets.
Three base patterns give spans of their own. The entropy scan then reads every
candidate string (a long run of key-like characters), keeps counts of the
characters in a sliding window, and takes the string when some window's Shannon
entropy passes the threshold of the string's character class. Assignments and
access keys are cut out of a candidate and each rest is scored by itself; what lies
wholly inside a base span, or whose value is on the allow list, gives no entropy span.

Null or empty texts have no spans, an empty table gives no rows, and repeated rows
are scanned each. A text is read in time in proportion to its length, however many
spans it holds. Long runs of digits alone pass for secrets: of random numbers of 20
digits 99 % are reported, so order and serial numbers of that length are too. Rows
are independent of each other, so there is no shuffle, and a lost task only repeats
its own rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import table

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")


@dataclass(frozen=True)
class EntropyRule:
    """A character class, the window over it, and the bits per character a whole window needs."""

    name: str
    pattern: str
    window: int
    bits: float

    def needed(self, length: int) -> float:
        """The bits that a string of ``length`` characters needs: less in proportion, if it is shorter than a window."""
        return self.bits * math.log2(max(2, min(length, self.window))) / math.log2(self.window)


#: The first class whose pattern the whole candidate matches is used. Bits are what random strings of the class reach:
#: digits have 3.32 bits at most, and 24 random letters of one case, of which some repeat, 3.86 in the median, while long
#: words of prose come near 3.9.
RULES = (
    EntropyRule("digits", r"[0-9]+", 20, 2.5),
    EntropyRule("hex", r"[0-9A-F]+|[0-9a-f]+", 32, 3.2),
    EntropyRule("one case", r"[a-z_=/+-]+|[A-Z_=/+-]+", 24, 3.9),
    EntropyRule("one case and digits", r"[a-z0-9]+|[A-Z0-9]+", 20, 3.55),
    EntropyRule("mixed", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+", 20, 3.7),
    EntropyRule("letters", r"[A-Za-z+/_=-]+", 24, 4.0),
    EntropyRule("other", r".+", 20, 3.9),
)
#: Strings that look random and are public by nature: UUIDs, paths, placeholders.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(example|sample|placeholder|dummy|changeme|xxxx).*",
    r"[A-Za-z_-]*(/[A-Za-z_-]*)+",
)


def entropy_peak(text: str, window: int) -> float:
    """Greatest Shannon entropy, in bits a character, of any window; counts change by one character a step."""
    n = min(window, len(text))
    if not n:
        return 0.0
    term = [0.0, *(c * math.log2(c) for c in range(1, n + 1))]
    counts: dict[str, int] = {}
    total, least = 0.0, math.inf
    for i, new in enumerate(text):
        if i >= n:
            c = counts[text[i - n]]
            total += term[c - 1] - term[c]
            counts[text[i - n]] = c - 1
        c = counts.get(new, 0)
        total += term[c + 1] - term[c]
        counts[new] = c + 1
        if i >= n - 1:
            least = min(least, total)
    return math.log2(n) - least / n


class Scanner:
    def __init__(self, rules: tuple[EntropyRule, ...] = RULES, allow: tuple[str, ...] = ALLOW):
        self.rules = [(re.compile(r.pattern), r) for r in rules]
        self.allow = [re.compile(a) for a in allow]

    def _passes(self, s: str) -> bool:
        for pattern, rule in self.rules:
            if pattern.fullmatch(s):
                return entropy_peak(s, rule.window) >= rule.needed(len(s))
        return False

    def random_looking(self, s: str) -> bool:
        value = re.split(r"=(?=[^=])", s)[-1]
        if any(a.fullmatch(value) for a in self.allow):
            return False
        return self._passes(s) or (value != s and len(value) >= LEAST and self._passes(value))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        cuts: list[tuple[int, int]] = []  # apart and in order
        for a, b, _ in sorted(found):
            if cuts and a <= cuts[-1][1]:
                cuts[-1] = (cuts[-1][0], max(b, cuts[-1][1]))
            else:
                cuts.append((a, b))
        found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
        base = sorted(found)
        cut = begun = covered = 0  # cuts that end before, base spans that begin before, and how far these reach
        for m in _CANDIDATE.finditer(text):
            at, rests = m.start(), []
            while cut < len(cuts) and cuts[cut][1] <= at:
                cut += 1
            k = cut
            while k < len(cuts) and cuts[k][0] < m.end():
                rests.append((at, cuts[k][0]))
                at = cuts[k][1]
                k += 1
            for start, end in [*rests, (at, m.end())]:
                while begun < len(base) and base[begun][0] <= start:
                    covered = max(covered, base[begun][1])
                    begun += 1
                # a run of hex digits may be the middle of a longer key: only what lies wholly inside it is covered
                if end - start >= LEAST and covered < end and self.random_looking(text[start:end]):
                    found.append((start, end, "entropy"))
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans", rules: tuple[EntropyRule, ...] = RULES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``out_col``: array of (kind, start, end) in code points, by start, then kind.

    Replaces a column that is already called ``out_col``.
    """
    kind = "array<struct<kind:string,start:long,end:long>>"

    @F.pandas_udf(kind)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules, allow)
        for batch in texts:
            yield batch.map(lambda t: [{"kind": k, "start": a, "end": b} for a, b, k in scanner.spans(t)] if t else [])

    return docs.withColumn(out_col, scan(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask``; overlapping spans become one."""

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()

        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, done = [], 0
            for start, end, _ in scanner.spans(text):
                if start >= done:
                    out += [text[done:start], mask]
                done = max(done, end)
            return "".join([*out, text[done:]]) if out else text

        for batch in texts:
            yield batch.map(one)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, out_col="found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
