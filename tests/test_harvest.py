"""Records from filled-in pages, canonical files in parts, containment among needles that begin alike, own scope, reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import records, rules
from tallgrass.operators import containment, harvest, lookup
from tallgrass.sources import files, sinks


def cell(numbers, x, y, letter):
    return f'<div class="cell {" ".join(f"entry-{n}" for n in numbers)}" data-coords="{x},{y}"><input maxlength=1 value="{letter}"></div>'


PAGES = [
    (1, '<div data-problem-id="b1"><h2>Unit</h2><div class="problem"><p>Intro text</p><p>Which one?</p><label><input type=radio name=a value=1> Red</label><label><input type=radio name=a checked> Blue <b>sky</b></label><label for=s>Pick a city</label><select id=s><option>none<option selected>Paris</select><table><tr><td>Row one</td><td><input type="text" value=" x "></td></tr><tr><td>Row two</td><td><input type=text value="y"></td></tr></table></div></div>'),
    (2, '<div class="problem">Choose what holds: <label><input type=checkbox name=q checked>Alpha</label><label><input type=checkbox name=q checked>Beta &amp; co</label><label><input type=checkbox name=q>Gamma</label></div>'),
    (3, '<div class="problem" data-problem-id=cw><div class="clue"><span class="clue-number">1</span> First  clue</div><div class="clue"><span class="clue-number">2</span>Last clue</div>' + cell([1, 2], 1, 1, "C") + cell([1], 2, 1, "a") + cell([1], 3, 1, "t") + cell([2], 1, 2, "o") + "</div>"),
    (4, '<div class="problem">' + cell([1], 1, 1, "C") + cell([1], 2, 1, "") + "</div>"),
    (5, '<div class="problem"><div class="matching_table"><div id=a1></div><div class="conf-item conf-draggable" id=b10>ten</div><div class="conf-item conf-draggable" id=b2>two</div><div id=matching_table_input><input type=text value=\'{"answer":{"a1":["b10"],"a2":[]}}\'></div></div></div>'),
    (6, '<div class="problem"><div class="matching_table"><div id=matching_table_input><input type=text value="not json"></div></div></div>'),
    (7, '<div><p>Name the capital</p><p>of <i>France</i></p><input type=text id=n value=""><p>Later</p><input type=text value="Paris"></div>'),
    (8, None),
    (9, ""),
    (10, "<p>nothing is asked here</p>"),
    (11, "<select><option>first<option>second</select>"),
]


def test_harvested_records(spark):
    given = spark.createDataFrame([(*p, "clash") for p in PAGES], "id long, html string, question string")
    got = {(r.page, r.type, r.question, r.answer, r.problem_id) for r in harvest.harvest_records(given, "id", "html").collect()}
    assert got == {
        (1, None, "Intro text Which one?", '"Blue sky"', "b1"),
        (1, None, "Pick a city", '"Paris"', "b1"),
        (1, None, "Pick a city none Paris Row one", '["x","y"]', "b1"),
        (2, None, "choose what holds:", '["Alpha","Beta & co"]', None),
        (3, None, "First clue ... Last clue", '{"1":"cat","2":"co"}', "cw"),
        (5, "matching", "two ... ten", '{"a1":["b10"],"a2":[]}', None),
        (7, None, "Name the capital of France", '"Paris"', None),
        (11, None, "first second", '"first"', None),
    }


def test_tree_numbers():
    nodes = harvest._tree("<div><p>a<p>b<img>c</div>d<ul><li>e<li>f</ul></b>")
    for n in nodes:
        inside = [m for m in nodes if n["pre"] < m["pre"] <= n["end"]]
        assert all(m["parent"] >= n["pre"] for m in inside) and not any(n["pre"] <= m["parent"] <= n["end"] for m in nodes if m["pre"] > n["end"])
    assert [n["text"] for n in nodes if n["tag"] is None and n["text"].strip()] == list("abcdef")
    assert [n["tag"] for n in nodes if n["tag"]] == ["#page", "div", "p", "p", "img", "ul", "li", "li"]


def test_canonical_file_in_parts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"q{rng.random()} «ü»\r\n", rng.choice([None, "x", '"'])) for i in rng.sample(range(1000), 400)]
    given = spark.createDataFrame(rows, "ord long, question string, type string").repartition(7)
    path = str(tmp_path / "base.json")
    assert sinks.write_canonical(spark, given, "ord", path) is None
    want = [{"question": q, **({"type": t} if t is not None else {})} for _, q, t in sorted(rows)]
    assert (tmp_path / "base.json").read_bytes() == sinks.render(want).encode()
    assert sinks.write_canonical(spark, given.limit(0), "ord", path) == f"{path}.bak"
    assert (tmp_path / "base.json").read_bytes() == b"[]" and json.loads((tmp_path / "base.json.bak").read_bytes()) == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["base.json", "base.json.bak"]
    before = (tmp_path / "base.json.bak").read_bytes()
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_canonical(spark, given.withColumn("question", F.raise_error(F.lit("lost"))), "ord", path)
    assert (tmp_path / "base.json").read_bytes() == b"[]" and (tmp_path / "base.json.bak").read_bytes() == before
    assert sorted(p.name for p in tmp_path.iterdir()) == ["base.json", "base.json.bak"]


def test_needles_that_begin_alike():
    needles = [f"one common beginning of all needles {i:03d} and their end" for i in range(200)]
    solids = [n.replace(" ", "") for n in needles]
    seeds = containment.Seeds(needles, solids, [True] * 200)
    assert max(len(own) for of in seeds.needles.values() for own in of.values()) < 20  # no seed is all needles'
    text = f"before {needles[7]} after one common beginning of all needles"
    assert seeds.found(text, text.replace(" ", "")) == [(7, len(needles[7]))]


def test_own_scope(spark):
    long = "what is the second letter of the alphabet that we have learnt to write today"
    needles = [(1, "first question of them all"), (2, long), (3, "first question"), (4, "something else")]
    pages = [(10, "first question of them all here"), (11, long.replace("learnt", "learned")), (12, "first question of them all here"), (13, "no match at all")]
    p, n = (lookup.forms(spark.createDataFrame(x, "i long, t string"), "i", "t") for x in (pages, needles))
    own = spark.createDataFrame([(10, 3), (10, 4), (11, 2), (11, 4), (13, 4), (13, 1), (99, 1)], "page_id long, needle_id long")
    got = {(r.page_id, r.needle_id, r.quality) for r in lookup.own_lookup(p, n, own).collect()}
    assert got == {(10, 3, "exact"), (11, 2, "approx")}
    whole = {(r.page_id, r.needle_id, r.quality, r.weak) for r in lookup.lookup_cascade(p, n, own=own).collect()}
    assert whole == {(10, 3, "exact", False), (11, 2, "approx", False), (12, 1, "exact", False)}


def test_rendered_answers(spark, tmp_path):
    given = ['"one"', '["a","b"]', '{"x":"1","y":["2","3"]}', "5", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", F.try_parse_json("t").alias("a"))
    assert [r.s for r in rows.orderBy("i").select(records.answer_text(F.col("a")).alias("s")).collect()] == ["one", "a + b", "x: 1; y: 2 + 3", "5", ""]
    values = spark.createDataFrame([(["a"],), (["a", '"'],), ([],)], "v array<string>")
    assert [r.j for r in values.select(records.value_or_list(F.col("v")).alias("j")).collect()] == ['"a"', '["a","\\""]', None]
    service = spark.createDataFrame([({"_at": "1", "kept": "2"}, 1, 2)], "extra map<string,string>, _source int, question int")
    assert records.strip_service(service, "extra").collect() == [({"kept": "2"}, 2)]
    path = tmp_path / "told.json"
    path.write_text(json.dumps({"1_0": "text", "2_full": [{"question": "q", "answer": "a"}, {"question": "r", "answer": "b"}]}))
    told = {r.name: (r.text, r.pairs and [tuple(p) for p in r.pairs]) for r in files.read_transcriptions(spark, str(path)).collect()}
    assert told == {"1_0": ("text", None), "2_full": (None, [("q", "a"), ("r", "b")])}
    assert rules.key("A-b") == "ab"


def test_the_plan_stays_small(spark):
    """Shared parts are stored once: planned again in every branch they were 181 joins, and the driver ran out of memory."""
    pages = spark.createDataFrame([(1, "<div class=problem><p>Q</p><input type=text value=a></div>")], "id long, html string")
    found = harvest.harvest_records(pages, "id", "html")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 20
    assert [(r.question, r.answer) for r in found.collect()] == [("Q", '"a"')]
