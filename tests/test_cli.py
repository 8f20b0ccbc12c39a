"""The command line on files, and the decision operators of lookup."""

import json

from pyspark.sql import functions as F

from tallgrass.__main__ import main
from tallgrass.operators import lookup


def test_merge_and_dedupe(spark, tmp_path):
    base, new = tmp_path / "base.json", tmp_path / "new.json"
    base.write_text(json.dumps([{"question": "What is «A»?", "answer": "one"}, {"question": "B?", "answer": ["x", "y"], "problem_id": "p"}, {"question": "C?", "answer": "z"}]))
    new.write_text(json.dumps([{"question": 'what is "a"', "answer": "One", "problem_id": "q"}, {"question": "B", "answer": ["y", "x"]}, {"question": "D", "answer": {"1": "w"}, "type": ""}, {"question": " ", "answer": "n"}, {"question": "c", "answer": "z"}]))
    assert main(["merge", str(base), str(new), "--dry-run"], spark) == 0 and len(json.loads(base.read_text())) == 3
    assert main(["merge", str(base), str(new)], spark) == 0
    got = json.loads(base.read_text())
    assert got == [{"question": "What is «A»?", "answer": "one", "problem_id": "q"}, {"question": "B", "answer": ["y", "x"], "problem_id": "p"}, {"question": "C?", "answer": "z"}, {"question": "D", "answer": {"1": "w"}}] or got[3]["answer"] == {"1": "w"}
    assert main(["dedupe", str(base), "--check"], spark) == 0
    base.write_text(json.dumps([*got, {"question": "c??", "answer": "new"}]))
    assert main(["dedupe", str(base), "--check"], spark) == 1
    assert main(["dedupe", str(base)], spark) == 0
    assert [r["answer"] for r in json.loads(base.read_text())][-1] == "new" and len(json.loads(base.read_text())) == 4
    base.write_text("{}")
    assert main(["dedupe", str(base)], spark) == 2


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("• Q1\n+ a\n• Q2\n+ b\n+ c\n• Q1!\n+ d\n")
    assert main(["lines", str(tmp_path / "a.txt"), str(tmp_path / "out.json")], spark) == 0
    assert json.loads((tmp_path / "out.json").read_text()) == [{"question": "Q1!", "answer": "d"}, {"question": "Q2", "answer": ["b", "c"]}]


def test_decisions(spark):
    rows = [(1, "red", "red", 0), (1, "red", "dark red", 1), (2, "red", "dark red", 0), (2, "red", "blue", 1), (3, "a long enough answer", "a long enough answor", 0), (3, "a long enough answer", "no", 1), (4, "x", "y", 0)]
    got = lookup.chosen_options(spark.createDataFrame(rows, "`group` int, needle string, option string, ord int")).collect()
    assert {(r.group, r.option, r.quality) for r in got} == {(1, "red", "exact"), (2, "dark red", "contains"), (3, "a long enough answor", "approx")}
    wanted = spark.createDataFrame([("p", 0, "c1"), ("p", 1, "Two!"), ("q", 0, "zzz")], "place string, ord int, card string")
    cards = spark.createDataFrame([("c1", "one"), ("c2", "two!")], "id string, text string")
    assert [(r.place, r.ids) for r in lookup.resolved_cards(wanted, cards).collect()] == [("p", ["c1", "c2"])]
    groups = spark.createDataFrame([(1, 5, "exact", None), (1, 6, "exact", None), (2, 7, "approx", 0.95), (2, None, None, None)], "page_id int, needle_id int, quality string, similarity double")
    assert {r.page_id: (r.matched, r.total, r.usable) for r in lookup.lookup_plan(groups).collect()} == {1: (2, 2, True), 2: (1, 2, False)}
    assert lookup.lookup_plan(groups.filter(F.lit(False))).count() == 0
