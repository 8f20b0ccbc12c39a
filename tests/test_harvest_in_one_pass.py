"""Pages are harvested in the task that holds them: no join, no shuffle, no stored frame, and plain markup by one pattern."""

import random

from pyspark.sql import functions as F

from tallgrass.operators import harvest
from tallgrass.plans.catalogue import QUERIES


def test_records_follow_from_a_page_alone(spark):
    spark.sparkContext.setJobGroup("harvest", "planned only")
    pages = spark.range(200).select("id", F.format_string("<div class=problem data-problem-id=p%s><p>Question %s</p><input type=text value=\"%s\"></div>", *[F.col("id").cast("string")] * 3).alias("html"))
    found = harvest.harvest_records(pages, "id", "html")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("harvest")  # nothing is computed and stored on the way
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
    assert {(r.page, r.question, r.answer, r.problem_id) for r in found.collect()} == {(i, f"Question {i}", f'"{i}"', f"p{i}") for i in range(200)}


def test_forms_are_dealt_over_all_tasks(spark, small):
    found = QUERIES["harvested_forms"](spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    want = {x for k, r in parts.items() for x in ((k, f"p{k}", f"About {r.p_name}", f'"{r.p_brand}"'), (k, f"p{k}", f"Kind of {r.p_name}", f'"{r.p_type}"'), (k, f"p{k}", f"Kind of {r.p_name} none {r.p_type} Sizes", f'"{r.p_size}"'))}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_plain_markup_reads_as_the_parser_does():
    rng = random.Random(4)
    bits = ["<div>", "</div>", '<P class="a b">', "<option selected>", "<li>", "<br>", "<br/>", "<a href=x/y>", "<a b = c>", '<input value="&amp;x" Value=z>', "<script>", "</script>", "<textarea>", "<!-- x -->", "<!--", "<", ">", "&amp;", "&lt", "text", " a < b ", "\n", "\xa0", "<div\xa0a=b>", "<div a='q\"' b>", '<i a="">', "</p >", "</ p>", "<svg>", "<div"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        parser = harvest._Tree()
        parser.feed(page)
        parser.close()
        parser._close_from(0)
        assert harvest._tree(page) == parser.nodes, page


def test_odd_grids_and_tables(spark):
    cells = lambda *given: "".join(f'<div class="cell entry-{n}" data-coords="{at}"><input value="{letter}"></div>' for n, at, letter in given)
    table = lambda state: f"<div class='matching_table'><div class='conf-item conf-draggable' id=b2>two</div><div id=matching_table_input><input type=text value='{state}'></div></div>"
    pages = [
        (1, cells((10, "2,1", "t"), (10, "1,1", "A"), (2, "3", "x"))),  # one coordinate only: no place, still a letter
        (2, cells((1, "1,1", "ab"))),
        (3, table('{"answer":{"a1":[]}}')),
        (4, table('{"answer":{"a1":["b2"]}}') + cells((1, "1,1", "a"))),
        (None, "<p>Q</p><input type=text value=a>"),
    ]
    found = harvest.harvest_records(spark.createDataFrame(pages, "id long, html string"), "id", "html").collect()
    assert {(r.page, r.type, r.question, r.answer) for r in found} == {(1, None, "", '{"2":"x","10":"at"}'), (4, "matching", "two", '{"a1":["b2"]}'), (None, None, "Q", '"a"')}
