"""Records harvested from filled-in pages: what a page asks and what stands in its controls.

A page becomes nodes, one for each element and each piece of text, numbered in reading order (``pre``) with the number of
its last descendant (``end``) and its parent. A descendant's number lies in (pre, end], so "inside" is a range of numbers and
the text inside an element is one slice of the page's text. A page's records follow from the page alone: they are read in
the task that holds it, without a join, a shuffle or a stored frame.

Pages are read by a tolerant parser; elements that are never closed end with their parent. Null pages have no records.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallgrass.functions import rules
from tallgrass.functions.records import value_or_list
from tallgrass.operators import extract

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())
_SILENT = frozenset("script style template".split())
#: An element that ends when another of the same set begins beside it.
_SIBLINGS = ({"li"}, {"p"}, {"option"}, {"tr"}, {"td", "th"}, {"dt", "dd"})


#: Plain tags and texts, which most pages consist of; whatever else comes is left to the tolerant parser.
_TOKEN = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\r\n\f]++[a-zA-Z][a-zA-Z0-9_-]*+(?:=(?:"[^"&]*+"|'[^'&]*+'|[^\s"'`=<>/&]++))?+)*+)[ \t\r\n\f]*+>|</([a-zA-Z][a-zA-Z0-9]*+)[ \t\r\n\f]*+>|([^<]++)""")
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*+)(?:=(?:"([^"]*+)"|'([^']*+)'|([^\s]++)))?+""")
#: Elements whose inside is read by rules of its own.
_RAW = frozenset("iframe math noembed noframes noscript plaintext script style svg textarea title xmp".split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self._add("#page", None, {})
        self.open.append(0)

    def _add(self, tag: str | None, text: str | None, attrs: dict[str, str]) -> int:
        self.nodes.append({"pre": len(self.nodes), "end": len(self.nodes), "parent": self.open[-1] if self.open else -1, "tag": tag, "text": text, "attrs": attrs})
        return len(self.nodes) - 1

    def read_plain(self, page: str) -> int:
        """Reads plain tags and texts, as ``feed`` would; where the first of anything else begins."""
        at = 0
        while token := _TOKEN.match(page, at):
            tag, attrs, closed, text = token.groups()
            if text is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            elif closed is not None:
                self.handle_endtag(closed.lower())
            elif (tag := tag.lower()) in _RAW:
                break
            else:
                self.handle_starttag(tag, [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(attrs)] if attrs else [])
            at = token.end()
        return at

    def _close_from(self, place: int) -> None:
        for at in reversed(self.open[place:]):
            if self.nodes[at]["tag"] in _BLOCK:
                self._add(None, "\n", {})
            self.nodes[at]["end"] = len(self.nodes) - 1
            self.open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for family in _SIBLINGS:
            if tag in family and self.nodes[self.open[-1]]["tag"] in family:
                self._close_from(len(self.open) - 1)
        at = self._add(tag, None, {k: v or "" for k, v in reversed(attrs)})
        if tag in _VOID:
            if tag in _BLOCK:
                self._add(None, "\n", {})
            return
        self.open.append(at)
        if tag in _BLOCK:
            self._add(None, "\n", {})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for place in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[place]]["tag"] == tag:
                self._close_from(place)
                return

    def handle_data(self, data: str) -> None:
        if self.nodes[self.open[-1]]["tag"] not in _SILENT:
            self._add(None, data, {})


def _tree(page: str | None) -> list[dict] | None:
    if page is None:
        return None
    tree = _Tree()
    if (at := tree.read_plain(page)) < len(page):
        tree.feed(page[at:])
        tree.close()
    tree._close_from(0)
    return tree.nodes


#: Pages that become Python strings at a time.
SLICE = 512
_ASCII_SPACES, _ENTRY = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"entry-([0-9]+)")
_LAST_NUMBER = re.compile(r"([0-9]+)(?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
#: What an integer's text may be padded with.
_PADDING = "".join(map(chr, range(33))) + "\x7f"
_WORDS = ArrayType(StructType([StructField("entry", StringType()), StructField("word", StringType())]))
_FOUND = [("pos", LongType(), pa.int64()), ("type", StringType(), pa.string()), ("question", StringType(), pa.string()), ("answers", ArrayType(StringType()), pa.list_(pa.string())), ("words", _WORDS, pa.list_(pa.struct([("entry", pa.string()), ("word", pa.string())]))), ("state", StringType(), pa.string()), ("problem_id", StringType(), pa.string())]


def _clean(text: str) -> str:
    """``text.clean_text`` of one string."""
    return rules._SPACE.sub(" ", text).strip(" ")


def _int(text: str | None) -> int | None:
    """A 32-bit number, as a cast of text reads it; None for anything else."""
    bare = (text or "").strip(_PADDING)
    n = int(bare) if re.fullmatch("[+-]?[0-9]{1,99}", bare) else None
    return n if n is not None and -(2**31) <= n < 2**31 else None


def _item_number(text: str) -> int:
    """``text.item_number`` of one string."""
    found = _LAST_NUMBER.search(text)
    digits = found[1].lstrip("0") if found else ""
    n = int(digits) if 0 < len(digits) < 20 else 0
    return n if n < 2**63 else 0


def _ends(texts: list[str]) -> str:
    """The first and last of texts that say something."""
    told = [t for t in texts if t]
    return f"{told[0]} ... {told[-1]}" if len(told) > 1 else "".join(told)


class _Page:
    """A page's nodes by what is asked for: tags, classes, controls, and the text inside an element."""

    def __init__(self, nodes: list[dict]) -> None:
        self.nodes = nodes
        self.starts = list(accumulate((len(n["text"] or "") for n in nodes), initial=0))
        self.text = "".join(n["text"] for n in nodes if n["text"])
        self.tagged: dict[str, list[int]] = defaultdict(list)
        self.classed: dict[str, list[int]] = defaultdict(list)
        self.problem_id: str | None = None
        for n in nodes:
            if n["tag"] is not None:
                self.tagged[n["tag"]].append(n["pre"])
                if "class" in n["attrs"]:
                    for name in set(_ASCII_SPACES.split(n["attrs"]["class"])):
                        self.classed[name].append(n["pre"])
                if self.problem_id is None:
                    self.problem_id = n["attrs"].get("data-problem-id")
        self.body = next(iter(self.divs("problem")), 0)
        self.takers = sorted(i for tag in ("input", "select", "textarea") for i in self.tagged.get(tag, ()))
        self.named: dict[str, int] = {}
        for i in self.tagged.get("label", ()):
            self.named.setdefault(self.attr(i, "for"), i)
        self._children: dict[int, list[int]] | None = None

    def attr(self, i: int, name: str) -> str:
        return self.nodes[i]["attrs"].get(name, "")

    def divs(self, name: str) -> list[int]:
        return [i for i in self.classed.get(name, ()) if self.nodes[i]["tag"] == "div"]

    def within(self, i: int, numbers: list[int]) -> list[int]:
        """Those of ascending numbers that lie inside element i."""
        return numbers[bisect_right(numbers, i) : bisect_right(numbers, self.nodes[i]["end"])]

    def holds_control(self, i: int) -> bool:
        place = bisect_right(self.takers, i)
        return place < len(self.takers) and self.takers[place] <= self.nodes[i]["end"]

    def inner_text(self, i: int) -> str:
        return self.text[self.starts[i + 1] : self.starts[self.nodes[i]["end"] + 1]]

    def children(self, i: int) -> list[int]:
        """The elements right inside element i."""
        if self._children is None:
            self._children = defaultdict(list)
            for n in self.nodes:
                if n["tag"] is not None:
                    self._children[n["parent"]].append(n["pre"])
        return self._children[i]

    def controls(self) -> dict[tuple[str, str], list[int]]:
        """Controls of the body that take an answer, by kind and group: a select is its own, text fields are one, others go by name."""
        groups: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i in self.within(self.body, self.takers):
            tag, kind = self.nodes[i]["tag"], self.attr(i, "type").lower()
            if tag == "select":
                groups["select", self.attr(i, "id") or str(i)].append(i)
            elif tag == "input" and kind in ("text", "radio", "checkbox"):
                groups[kind, "" if kind == "text" else self.attr(i, "name") or f"anon{i}"].append(i)
        return groups

    def label(self, control: int) -> str:
        """The text of the label that names a control's id, or else of the nearest one around it."""
        own = self.attr(control, "id")
        at = self.named.get(own) if own else None
        if at is None:
            at = self.nodes[control]["parent"]
            while at >= 0 and self.nodes[at]["tag"] != "label":
                at = self.nodes[at]["parent"]
        return _clean(self.inner_text(at)) if at >= 0 else ""

    def value(self, kind: str, control: int) -> str:
        """The chosen option, what is typed in, the label of what is ticked; empty if there is none."""
        if kind == "text":
            return self.attr(control, "value").strip(" ")
        if kind == "select":
            options = self.within(control, self.tagged.get("option", []))
            chosen = [i for i in options if "selected" in self.nodes[i]["attrs"]]
            return _clean(self.inner_text(chosen[-1] if chosen else options[0])) if options else ""
        return self.label(control) if "checked" in self.nodes[control]["attrs"] else ""

    def stem(self, control: int) -> str:
        """The text of the elements before a control, on each level around it back to one that holds another control."""
        told, at = [], control
        while at > self.body:
            parent = self.nodes[at]["parent"]
            beside = self.children(parent)
            for place in range(bisect_left(beside, at) - 1, -1, -1):
                if self.holds_control(beside[place]):
                    break
                told.append(self.inner_text(beside[place]))
            at = parent
        return _clean(" ".join(reversed(told)))

    def above(self) -> str:
        """The page's normalised text up to the first label, list or table of its answers."""
        whole = rules.norm(self.inner_text(self.body))
        options = {*self.tagged.get("label", ()), *self.tagged.get("select", ()), *self.classed.get("matching_table", ())}
        found = [whole.find(told) for told in {rules.norm(self.inner_text(i)) for i in options} if told]
        return whole[: min((at for at in found if at > 0), default=len(whole))].strip(" ")

    def plain_records(self) -> Iterator[tuple]:
        above = None
        for (kind, _), members in self.controls().items():
            answers = [v for v in (self.value(kind, i) for i in members) if v]
            if not answers:
                continue
            question = (self.label(members[0]) if kind in ("select", "text") else "") or self.stem(members[0])
            if not question:
                above = self.above() if above is None else above
                question = above
            if question:
                yield members[0], None, question, answers, None, None, self.problem_id

    def words(self) -> list[tuple[int, str | None]]:
        """Words of a crossword by number, in order: None where a cell has no letter. A cell that two words share is in both."""
        cells: dict[int, list] = defaultdict(list)
        for i in self.divs("cell"):
            inputs = self.within(i, self.tagged.get("input", [])) if "data-coords" in self.nodes[i]["attrs"] else []
            if inputs:
                letter = self.attr(inputs[0], "value").strip(" ")
                x, y = (*self.attr(i, "data-coords").split(","), None)[:2]
                for number in _ENTRY.findall(self.attr(i, "class")):
                    cells[int(number)].append((_int(x), _int(y), letter.lower() if len(letter) == 1 else ""))
        out = []
        for number, of_word in sorted(cells.items()):
            axis = 0 if len({c[1] for c in of_word} - {None}) == 1 else 1
            letters = [c[2] for c in sorted(of_word, key=lambda c: (c[axis] is not None, c[axis] or 0, c[2]))]
            out.append((number, "".join(letters) if all(letters) else None))
        return out

    def clues(self) -> list[str]:
        """Texts of clues, without their numbers."""
        silent = bytearray(len(self.nodes))
        for i in self.classed.get("clue-number", ()):
            silent[i + 1 : self.nodes[i]["end"] + 1] = b"\1" * (self.nodes[i]["end"] - i)
        return [_clean("".join(n["text"] for n in self.nodes[i + 1 : self.nodes[i]["end"] + 1] if n["text"] and not silent[n["pre"]])) for i in self.divs("clue")]

    def grid_record(self) -> Iterator[tuple]:
        """A crossword all of whose words are filled in."""
        words = self.words()
        if words and all(w is not None for _, w in words):
            yield 0, None, _ends(self.clues()), None, [{"entry": str(n), "word": w} for n, w in words], None, self.problem_id

    def table_record(self) -> Iterator[tuple]:
        """A matching table, with the text of its own field; whether a card is in some place, the JSON tells."""
        fields = [i for i in self.tagged.get("input", ()) if self.attr(i, "type").lower() == "text"]
        first = min((i for h, n in enumerate(self.nodes) if n["attrs"].get("id") == "matching_table_input" for i in self.within(h, fields)[:1]), default=None)
        if first is not None:
            cards = sorted({*self.classed.get("conf-item", ())} & {*self.classed.get("conf-draggable", ())}, key=lambda i: (_item_number(self.attr(i, "id")), i))
            yield 0, "matching", _ends([_clean(self.inner_text(i)) for i in cards]), None, None, self.attr(first, "value"), self.problem_id

    def records(self) -> Iterator[tuple]:
        if self.divs("matching_table"):
            return self.table_record()
        if any("data-coords" in self.nodes[i]["attrs"] for i in self.divs("cell")):
            return self.grid_record()
        return self.plain_records()


def _harvested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            part = batch.slice(begin, SLICE)
            rows = [(i, *r) for i, page in enumerate(part.column(1).to_pylist()) if page is not None for r in _Page(_tree(page)).records()]
            places, *columns = zip(*rows, strict=True) if rows else [()] * (1 + len(_FOUND))
            own = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, _FOUND, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places, pa.int32())), *own], names=["page", *(name for name, _, _ in _FOUND)])


def harvest_records(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Records of filled-in pages: ``page pos type question answer problem_id`` (answer as JSON; ``type`` null for plain records).

    A matching table or a crossword is one record for its page. Elsewhere every group of controls that holds something is
    one: its question is the label of its first control (of a list or text field), else the text before it, else the
    page's text up to its answers; one value is a string, several are an array in the controls' order.
    """
    given = pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html"))
    found = given.mapInArrow(_harvested, StructType([given.schema["page"], *(StructField(name, kind) for name, kind, _ in _FOUND)]))
    state = F.get_json_object("state", "$.answer")
    kept = found.filter(F.col("state").isNull() | (F.size(extract.filled_places(state)) > 0))
    answer = F.coalesce(value_or_list(F.col("answers")), F.to_json(F.map_from_entries("words")), state)
    return kept.select("page", "pos", "type", "question", answer.alias("answer"), "problem_id")
