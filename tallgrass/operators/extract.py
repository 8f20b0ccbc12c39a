"""Records out of ordered text: marker lists, preceding context, disambiguation, hyphen hints, page controls, grids."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallgrass.functions import text as T
from tallgrass.functions.records import value_or_list

# The marks of question and answer lines, lengths and limits.
QUESTION_MARK, ANSWER_MARK = "•", "+"
SCENARIO_LENGTH, CONTEXT_BUDGET = 60, 3000
HYPHENATED = "([а-яёa-z]{2,}-[а-яёa-z]{2,})"


def marker_records(lines: DataFrame, doc_col: str, order_col: str, text_col: str) -> DataFrame:
    """``doc, pos, question, answers``: a line that begins with • opens a question, lines with + are its answers.

    Lines without a mark are no part of either. Records lacking a question or answers are dropped.
    """
    line = F.trim(F.coalesce(text_col, F.lit("")))
    rows = lines.select(F.col(doc_col).alias("doc"), F.col(order_col).alias("pos"), F.left(line, F.lit(1)).alias("mark"), F.trim(F.substr(line, F.lit(2))).alias("body"))
    w = Window.partitionBy("doc").orderBy("pos")
    rows = rows.filter(F.col("mark").isin(QUESTION_MARK, ANSWER_MARK)).withColumn("record", F.count_if(F.col("mark") == QUESTION_MARK).over(w)).filter("record > 0")
    return grouped_answers(rows.withColumn("opens", F.col("mark") == QUESTION_MARK), ["doc", "record"], "pos", "body").drop("record")


def grouped_answers(rows: DataFrame, keys: list[str], order_col: str, text_col: str) -> DataFrame:
    """Per group: the text of its opening row and the others' texts in order, as ``question`` and ``answers``."""
    answer = F.when(~F.col("opens") & (F.col(text_col) != ""), F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t")))
    out = rows.groupBy(*keys).agg(F.min(F.when(F.col("opens"), F.col(order_col))).alias("pos"), F.max(F.when(F.col("opens"), F.col(text_col))).alias("question"), F.transform(F.array_sort(F.collect_list(answer)), lambda a: a["t"]).alias("answers"))
    return out.filter((F.col("question") != "") & (F.size("answers") > 0))


def preceding_context(rows: DataFrame, group_col: str, order_col: str, text_col: str, eligible: Column, name: str = "context") -> DataFrame:
    """``rows`` with the text of the nearest earlier eligible row of the group (null: none)."""
    w = Window.partitionBy(group_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(eligible, F.col(text_col)), ignorenulls=True).over(w))


def gathered_context(rows: DataFrame, group_col: str, order_col: str, text_col: str, boundary: Column, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """``rows`` with ``context``: the texts before each row since the last boundary row, the latest ``budget`` characters.

    Texts are placed by the characters before them, so a row gathers only what lies within reach of it: at most
    three budgets of text, however long its group is.
    """
    w = Window.partitionBy(group_col).orderBy(order_col)
    own = rows.withColumn("_span", F.count_if(boundary).over(w)).withColumn("_tail", F.right(F.col(text_col), F.lit(budget)))
    before = Window.partitionBy(group_col, "_span").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("_tail") + 1, F.lit(0)).cast("long")
    placed = own.withColumn("_begin", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    near = Window.partitionBy(group_col, "_span").orderBy("_begin").rangeBetween(-(2 * budget + 1), -1)
    joined = F.array_join(F.collect_list("_tail").over(near), "\n")
    return placed.withColumn("context", F.right(joined, F.lit(budget))).drop("_span", "_tail", "_begin")


def disambiguate(records: DataFrame, ambiguous: DataFrame, key_col: str, question_col: str, context_col: str) -> DataFrame:
    """Ambiguous questions (keys in ``ambiguous``) get a fragment of their context and ``...`` in front, unless they hold it already.

    ``fixed``: true where that was done, false where it was not, null where the question was clear.
    """
    marks = ambiguous.select(F.col("key").alias(key_col), F.lit(True).alias("unclear")).distinct()
    fragment = T.scenario_fragment(F.col(context_col))
    question = F.col(question_col)
    given = F.col(context_col).isNotNull() & (fragment != "") & ~T.norm(question).contains(T.norm(fragment))
    joined = records.join(marks, key_col, "left")
    fresh = F.concat(fragment, F.lit("..."), question)
    return joined.withColumn("fixed", F.when(F.col("unclear"), given)).withColumn(question_col, F.when(F.col("fixed"), fresh).otherwise(question)).drop("unclear")


def hyphen_candidates(docs: DataFrame, text_col: str, order_col: str | None = None) -> DataFrame:
    """Hyphenated words whose joined form also stands alone: ``joined hyphenated n_plain n_hyphen``, most frequent first.

    Text is lower-cased and read in runs of word characters and hyphens. A run equal to the joined form is a plain
    word; ``n_hyphen`` counts runs that end with the hyphenated form, which is the first one by ``order_col`` and place in
    the text (without an order: the first in alphabetic order).
    """
    text = F.lower(F.coalesce(text_col, F.lit("")))
    order = F.col(order_col) if order_col else F.lit(0)
    cut = docs.select(order.alias("o"), F.posexplode(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))).alias("at", "w"))
    place = F.struct("o", "at") if order_col else F.lit(0)
    runs = cut.groupBy("w").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    hyphened = runs.filter(F.col("w").contains("-")).select("w", "n", "place", F.posexplode(F.regexp_extract_all("w", F.lit(HYPHENATED), F.lit(1))).alias("nth", "form"))
    first_of = F.struct("place", "nth") if order_col else F.col("form")
    forms = hyphened.groupBy("form").agg(F.sum(F.when(F.col("w").endswith(F.col("form")), F.col("n")).otherwise(0)).alias("n_hyphen"), F.min(first_of).alias("first"))
    first = forms.groupBy(F.replace("form", F.lit("-"), F.lit("")).alias("joined")).agg(F.min_by("form", "first").alias("hyphenated"), F.min_by("n_hyphen", "first").alias("n_hyphen"))
    found = first.join(runs.select(F.col("w").alias("joined"), F.col("n").alias("n_plain")), "joined")
    return found.select("joined", "hyphenated", "n_plain", "n_hyphen").orderBy(F.desc("n_plain"), "joined")


def join_hyphens(text: Column, joins: dict[str, str]) -> Column:
    """A text with known broken words joined, and its white space collapsed."""
    for broken, whole in joins.items():
        text = F.replace(text, F.lit(broken), F.lit(whole))
    return T.clean_text(text)


_CONTROL = re.compile(r"<(input|select|textarea|option|label)\b([^>]*)>", re.IGNORECASE)
_ATTR = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def _controls(page: str | None) -> list[dict[str, object]]:
    out = []
    for i, m in enumerate(_CONTROL.finditer(page or "")):
        given = {a.lower(): html.unescape(d or s or b) for a, d, s, b in _ATTR.findall(m[2])}
        kind = m[1].lower() if m[1].lower() != "input" else given.get("type", "text").lower()
        end = page.find("<", m.end())
        text = " ".join(html.unescape(page[m.end() : end if end >= 0 else len(page)]).split())
        value = given.get("value", text if kind in ("option", "label") else "")
        out.append({"pos": i, "kind": kind, "name": given.get("name", given.get("for", "")), "value": value, "label": text if kind in ("option", "label") else ""})
    return out


@F.pandas_udf(ArrayType(StructType([StructField("pos", IntegerType()), *(StructField(c, StringType()) for c in ("kind", "name", "value", "label"))])))
def _page_controls(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(_controls)


def page_controls(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Form controls of pages in order: ``id pos kind name value label``."""
    return pages.select(id_col, F.explode(_page_controls(F.col(html_col))).alias("c")).select(id_col, "c.*")


def control_groups(controls: DataFrame, id_col: str) -> DataFrame:
    """Controls grouped by kind and name, in the order in which groups are first seen."""
    return controls.groupBy(id_col, "kind", "name").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.count_if(F.col("value") != "").alias("filled"))


def link_count(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Links and list items of each page, by native patterns."""
    count = lambda p: F.regexp_count(F.coalesce(html_col, F.lit("")), F.lit(p)).cast("long")
    return pages.select(id_col, count(r"<a ").alias("n_links"), count(r"<li>").alias("n_items"), count(r"<p>").alias("n_paragraphs"))


def filled_places(state: Column) -> Column:
    """The places of a JSON object that hold cards, as a map; null if it is no such object."""
    return F.map_filter(F.from_json(state, "map<string,array<string>>"), lambda _, v: F.size(v) > 0)


def matching_state(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Places and their cards out of a JSON object; empty places are left out."""
    return rows.select(id_col, F.explode(filled_places(F.col(json_col))).alias("place", "cards"))


def grid_words(cells: DataFrame) -> DataFrame:
    """Words of a grid from cells (grid, entry, x, y, letter): ``axis``, ``word`` if every cell has a letter, ``n_cells``."""
    cell = F.struct("x", "y", F.coalesce("letter", F.lit("")).alias("letter"))
    words = cells.groupBy("grid", "entry").agg(F.when(F.count_distinct("y") == 1, "across").otherwise("down").alias("axis"), F.collect_list(cell).alias("cells"))
    ordered = F.array_sort(F.transform("cells", lambda c: F.struct(F.when(F.col("axis") == "across", c["x"]).otherwise(c["y"]).alias("o"), c["letter"].alias("letter"))))
    whole = F.forall("cells", lambda c: c["letter"] != "")
    return words.select("grid", "entry", "axis", F.when(whole, F.array_join(F.transform(ordered, lambda c: c["letter"]), "")).alias("word"), F.size("cells").cast("long").alias("n_cells"))


def grid_conflicts(placed: DataFrame) -> DataFrame:
    """Cells that two words fill with different letters: from words (grid, ord, x, y, axis, word)."""
    letters = placed.select("grid", "ord", "x", "y", "axis", F.posexplode(F.split(T.crossword_word("word"), "")).alias("i", "letter")).filter("letter <> ''")
    at = letters.select("grid", "ord", (F.col("x") + F.when(F.col("axis") == "across", F.col("i")).otherwise(0)).alias("x"), (F.col("y") + F.when(F.col("axis") == "down", F.col("i")).otherwise(0)).alias("y"), "letter")
    first = at.groupBy("grid", "x", "y").agg(F.min_by("letter", "ord").alias("kept"))
    return at.join(first, ["grid", "x", "y"]).filter("letter <> kept").select("grid", "ord", "x", "y", "kept", "letter")


def signature(rows: DataFrame, group_col: str, order_col: str, text_col: str) -> DataFrame:
    """First and last text of each group, joined by `` ... ``."""
    ends = rows.groupBy(group_col).agg(F.min_by(text_col, order_col).alias("a"), F.max_by(text_col, order_col).alias("b"))
    return ends.select(group_col, F.concat_ws(" ... ", "a", "b").alias("signature"))


def assembled(crops: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Answers of images from crops (i, k, question) and transcriptions (name, text): ``i question answers``.

    A crop's transcription is named ``i_k``; that of crop 0 may be under ``i`` alone.
    """
    named = crops.withColumn("name", F.concat_ws("_", "i", "k"))
    whole = transcribed.select(F.col("name").alias("i_name"), F.col("text").alias("i_text"))
    joined = named.join(transcribed, "name", "left").join(whole, (F.col("k") == "0") & (F.col("i").cast("string") == F.col("i_name")), "left")
    text = F.coalesce("text", "i_text")
    part = F.when(text.isNotNull() & (text != ""), F.struct(F.coalesce(F.col("k").try_cast("int"), F.lit(-1)).alias("k"), text.alias("t")))
    return joined.groupBy("i").agg(F.min("question").alias("question"), F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]).alias("answers"))


def built_records(crops: DataFrame, told: DataFrame, skipped: Sequence[int] = ()) -> DataFrame:
    """Records of transcribed pictures: ``place question answer``, in order of ``place``, the answer as JSON.

    ``crops``: i, k, question. ``told``: name, text, pairs (see ``read_transcriptions``). The crops of a picture are one record,
    whose answer is a text or, of several, a list by ``k``; a whole picture (``full``) gives a record for each of its pairs, and
    pairs without a question take the picture's. Pictures in ``skipped`` and crops without a text are left out; an ellipsis at
    a question's end is cut.
    """
    own = crops.filter(~F.col("i").isin(list(skipped))) if skipped else crops
    given = own.join(told.select("name", "pairs"), F.concat_ws("_", "i", "k") == F.col("name")).filter("k = 'full'")
    asked = F.coalesce(F.nullif(T.clean_text(F.col("p.question")), F.lit("")), F.col("question"))
    pairs = given.select("i", "question", F.posexplode("pairs").alias("j", "p")).select(F.struct(F.lit(0).alias("phase"), F.col("i").cast("long").alias("i"), "j").alias("place"), asked.alias("question"), F.to_json(F.array(T.clean_text(F.col("p.answer")))).alias("listed"))
    pairs = pairs.select("place", "question", F.substring("listed", 2, F.length("listed") - 2).alias("answer"))
    clean = told.select("name", T.clean_text("text").alias("text"))
    whole = assembled(own.filter("k <> 'full'"), clean).filter(F.size("answers") > 0)
    images = whole.select(F.struct(F.lit(1).alias("phase"), F.col("i").cast("long").alias("i"), F.lit(0).alias("j")).alias("place"), "question", value_or_list(F.col("answers")).alias("answer"))
    return pairs.unionByName(images).withColumn("question", T.trim_ellipsis("question"))
