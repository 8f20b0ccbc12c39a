"""Records, dedupe and merge against sequential models; lookup against naive joins; files, sinks and streams."""

import io
import json
import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import records, rules
from tallgrass.functions.distance import substring_distance
from tallgrass.operators import dedupe, extract, lookup, merge, rollup, scan, shortlist
from tallgrass.plans import catalogue
from tallgrass.sources import files, images, sinks
from tallgrass.streaming import capture


def test_answers(spark):
    given = ['"Yes!"', '"yes"', '["A","b"]', '["b","A"]', '{"x":"A","y":["B"]}', '{"y":["b"],"x":"a"}', "5", '""', "[]", '["",""]', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").withColumn("a", F.try_parse_json("t"))
    got = rows.orderBy("i").select(records.answer_form(F.col("a")).alias("f"), records.capture_form(F.col("a")).alias("c"), records.answer_kind(F.col("a")).alias("k"), records.answer_blank(F.col("a")).alias("b"), records.record_kind(F.lit(""), F.col("a")).alias("r"), records.answer_brief(F.col("a")).alias("s")).collect()
    assert got[0].f != got[1].f and got[0].c == got[1].c and got[2].f != got[3].f and got[4].f == got[5].f
    assert [g.k for g in got] == ["string", "string", "array", "array", "object", "object", "other", "string", "array", "array", None]
    assert [g.b for g in got] == [False] * 7 + [True] * 4
    assert got[4].r == "crossword" and got[0].r == "plain" and got[2].s == "A + b" and got[4].s == "2 fields" and got[0].s == "Yes!"


def model_merge(base, changes):
    """base, changes: (key, ord, answer, link). A plain fold."""
    state, at, out = [dict(zip("koal", r, strict=True), new=False, pos=r[1], up=0, same=0) for r in base], {}, None
    for i, r in enumerate(state):
        at[r["k"]] = i
    for k, o, a, link in changes:
        if k not in at:
            at[k] = len(state)
            state.append({"k": k, "o": o, "a": a, "l": link, "new": True, "pos": o, "up": 0, "same": 0})
            continue
        r = state[at[k]]
        if r["a"] == a:
            if link and not r["l"]:
                r["l"], r["up"] = link, r["up"] + 1
            else:
                r["same"] += 1
        else:
            r.update(a=a, o=o, l=link or r["l"], up=r["up"] + 1)
    out = sorted((r["k"], r["o"], r["a"], r["l"] or None, r["new"], r["pos"], r["up"], r["same"]) for r in (state[i] for i in at.values()))
    return out


def test_merge(spark):
    rng = random.Random(3)
    one = lambda n, at: [(rng.choice("abcdef"), at + i, rng.choice("xy"), rng.choice([None, "", "p", "q"])) for i in range(n)]
    schema = "key string, ord long, answer string, link string"
    for _ in range(4):
        base, changes = one(8, 0), one(60, 100)
        got = merge.ordered_merge(spark.createDataFrame(base, schema), spark.createDataFrame(changes, schema), "key", "ord", "answer", ["link"])
        rows = sorted((r.key, r.ord, r.answer, r.link or None, r.is_new, r.pos, r.n_updates, r.n_same) for r in got.collect())
        assert rows == model_merge(base, changes)
        hidden = merge.superseded(spark.createDataFrame(base, schema), "key", "ord").count()
        assert hidden == len(base) - len({b[0] for b in base})
    report = merge.merge_report(got).first()
    assert report.added + report.updated + report.same == len(changes) and report.total == len(rows)


def test_dedupe(spark):
    rows = [("a", 1, None, "x"), ("b", 2, "q", "x"), ("a", 3, "p", "y"), ("", 4, None, "z"), ("a", 5, "", "y"), ("", 6, None, "z"), (None, 7, None, "n")]
    given = spark.createDataFrame(rows, "key string, ord long, link string, answer string")
    assert sorted((r.key, r.ord, r.pos) for r in dedupe.dedupe_last(given, "key", "ord").collect()) == [("a", 5, 1), ("b", 2, 2)]
    assert sorted((r.ord, r.link) for r in dedupe.dedupe_in_place(given, "key", "ord", ["link"]).collect()) == [(2, "q"), (5, "p"), (7, None)]
    assert sorted((r.key, r.dropped, r.kept) for r in dedupe.replaced_pairs(given, "key", "ord").collect()) == [("a", 1, 3), ("a", 3, 5)]
    assert [(r.dropped, r.kept) for r in dedupe.clashes(given, "key", "ord", "answer").collect()] == [(1, 3)]
    assert dedupe.ambiguous_keys(given, "key", "answer").collect()[0].answers == 2
    assert {tuple(r.places) for r in dedupe.duplicate_groups(given, "key", "ord").collect()} == {(1, 3, 5), (4, 6)}
    assert dedupe.double_keys(given, "key").count() == 3 and dedupe.key_audit(given, "key").first().empty == 3
    assert dedupe.dedupe_last(given.limit(0), "key", "ord").count() == 0 and dedupe.surplus(given.limit(0), "key").first().removed == 0


def test_lookup(spark, monkeypatch):
    rng = random.Random(6)
    words = ["alpha", "be", "gamma", "d", "eps", "zeta"]
    pages = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    needles = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    p, n = (lookup.forms(spark.createDataFrame(x, "i long, t string"), "i", "t") for x in (pages, needles))

    def score(page, needle):
        a, b, c = rules.key(page), rules.key(needle), rules.solid(needle)
        return (len(b) if b in a else len(c) if len(c) >= 12 and c in rules.solid(page) else 0) if b else 0

    want = {(i, j, score(t, s)) for i, t in pages for j, s in needles if score(t, s)}
    for most in (lookup.MAX_SEEDS, 1):
        monkeypatch.setattr(lookup, "MAX_SEEDS", most)
        assert {(r.page_id, r.needle_id, r.score) for r in lookup.containment_pairs(p, n).collect()} == want
    best = {i: min((-s, j) for k, j, s in want if k == i) for i, _, _ in want}
    assert {(r.page_id, r.needle_id, -r.score) for r in lookup.contains_lookup(p, n).collect()} == {(i, j, s) for i, (s, j) in best.items()}

    def dice(a, b):
        a, b = set(rules.key(a).split()), set(rules.key(b).split())
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0

    def approx(page):
        short = sorted(((-dice(s, page), j) for j, s in needles if rules.key(s)))[:5]
        judged = []
        for d, j in short:
            key = rules.key(needles[j][1])
            most = max(4, int(0.1 * len(key) + 0.5))
            edits = substring_distance(key, rules.key(page), 2 * most + 4)
            if edits <= 2 * most + 4:
                judged.append((-(1 - edits / len(key)), d, j, edits, most))
        judged.sort(key=lambda x: x[0])
        if not judged:
            return None
        s, _, j, edits, most = judged[0]
        return j, edits, -s >= 0.9 and edits <= most and (len(judged) < 2 or judged[1][0] - s >= 0.03 - 1e-12), [x[2] for x in judged[:3]]

    want = {i: approx(t) for i, t in pages if rules.key(t)}
    got = {r.page_id: (r.needle_id, r.edits, r.accepted, r.near) for r in lookup.approx_lookup(p, n).collect()}
    assert got == {i: w for i, w in want.items() if w}
    cascade = {r.page_id: r.quality for r in lookup.lookup_cascade(p, n).collect()}
    assert {i for i, q in cascade.items() if q == "exact"} == set(best)


def test_shortlist(spark, monkeypatch):
    rng = random.Random(8)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(300)]
    text = lambda most: " ".join([*rng.sample(common, rng.randint(0, 4)), *rng.choices(rare, k=rng.randint(0, most))])
    pages, needles = [(i, text(60)) for i in range(120)], [(i, text(12)) for i in range(90)]
    p, n = (spark.createDataFrame(x, "id long, key string") for x in (pages, needles))

    def best(page):
        own = set(page.split())
        return sorted((-2.0 * len(own & set(k.split())) / (len(own) + len(set(k.split()))), i) for i, k in needles if k)[:5]

    want = {(i, j, -d, r) for i, page in pages for r, (d, j) in enumerate(best(page), 1)}
    for block in (shortlist.BLOCK_WORDS, 150):
        monkeypatch.setattr(shortlist, "BLOCK_WORDS", block)
        got = shortlist.dice_shortlist(p, n)
        assert {(r.page_id, r.needle_id, r.dice, r["rank"]) for r in got.collect()} == want
    assert shortlist.dice_shortlist(p, n.limit(0)).count() == 0 and shortlist.dice_shortlist(p.limit(0), n).count() == 0
    assert shortlist.dice_shortlist(p, n.filter("id < 3")).count() == len(pages) * n.filter("id < 3 AND key <> ''").count()

    words = {w: i for i, w in enumerate(common + rare)}
    long = [" ".join(common + rng.choices(rare, k=8)) for _ in range(2000)]
    coded = [np.unique([words[w] for w in k.split()]) for k in long]
    index = shortlist.RareFirst(np.concatenate(coded), np.cumsum([len(c) for c in coded]))
    places, _ = index.best(coded[7], 1)
    assert places[0] == 7 and index.read < 2000  # four lists of 2000 needles each stay unread


def test_choices(spark):
    rows = [(1, "the red fox", "the red fix", 0), (1, "the red fox", "a dog", 1), (2, "one", "two", 0), (3, "same text", "same text", 0), (3, "same text", "same text", 1)]
    given = spark.createDataFrame(rows, "`group` int, needle string, option string, ord int")
    assert [(r.group, r.option) for r in lookup.closest_choice(given).collect()] == []
    assert [r.option for r in lookup.closest_choice(given.withColumn("option", F.when(F.col("ord") == 0, F.col("needle")).otherwise("zzz")).filter("`group` = 3")).collect()] == ["same text"]
    fits = spark.sql("SELECT array('abc') AS v, array('xabcx') AS c, array('ab') AS w, array('xabx') AS d, array() AS e").select(lookup.answer_fits(F.col("v"), F.col("c")), lookup.answer_fits(F.col("w"), F.col("d")), lookup.answer_fits(F.col("v"), F.col("e").cast("array<string>"))).first()
    assert tuple(fits) == (True, False, True)


def test_extraction(spark):
    lines = [(1, i, t) for i, t in enumerate(["+ early", "• Q one", "note", "+ a1", "+", "+ a2", "• empty", "• Q two", "+ b"])]
    got = extract.marker_records(spark.createDataFrame(lines, "d int, i int, t string"), "d", "i", "t").orderBy("pos").collect()
    assert [(r.question, r.answers) for r in got] == [("Q one", ["a1", "a2"]), ("Q two", ["b"])]
    docs = spark.createDataFrame([("a commu-nity and the community, community-led",), ("Commu-nity",), (None,)], "t string")
    assert [tuple(r) for r in extract.hyphen_candidates(docs, "t").collect()] == [("community", "commu-nity", 1, 2)]
    recs = spark.createDataFrame([("k1", "What now?", "A long story of ships and their crews that goes on"), ("k2", "Clear?", "x"), ("k1", "And?", None)], "key string, q string, c string")
    fixed = {r.q: r.fixed for r in extract.disambiguate(recs, spark.createDataFrame([("k1",)], "key string"), "key", "q", "c").collect()}
    assert fixed == {"A long story of ships and their crews that goes...What now?": True, "Clear?": None, "And?": False}
    page = spark.createDataFrame([(1, "<label for=a>Red</label><input type=radio name=a value=x><INPUT name='b'><select name=s><option>One &amp; two</select>")], "id int, h string")
    controls = extract.page_controls(page, "id", "h").collect()
    assert [(c.kind, c.name, c.value) for c in controls] == [("label", "a", "Red"), ("radio", "a", "x"), ("text", "b", ""), ("select", "s", ""), ("option", "", "One & two")]
    cells = [(1, 1, 2, 0, "b"), (1, 1, 1, 0, "a"), (1, 2, 1, 0, "a"), (1, 2, 1, 1, None)]
    words = {r.entry: (r.axis, r.word) for r in extract.grid_words(spark.createDataFrame(cells, "grid int, entry int, x int, y int, letter string")).collect()}
    assert words == {1: ("across", "ab"), 2: ("down", None)}
    placed = [(1, 0, 0, 0, "across", "ab"), (1, 1, 1, 0, "down", "xc")]
    assert [(r.x, r.y, r.kept, r.letter) for r in extract.grid_conflicts(spark.createDataFrame(placed, "grid int, ord int, x int, y int, axis string, word string")).collect()] == [(1, 0, "b", "x")]
    crops = spark.createDataFrame([(1, "0", "q"), (2, "0", "r"), (2, "1", "r"), (3, "full", "s")], "i int, k string, question string")
    texts = spark.createDataFrame([("1", "legacy"), ("2_1", "second"), ("2_0", "first")], "name string, text string")
    assert {r.i: r.answers for r in extract.assembled(crops, texts).collect()} == {1: ["legacy"], 2: ["first", "second"], 3: []}
    state = spark.createDataFrame([(1, '{"a":["x"],"b":[]}')], "id int, j string")
    assert [(r.place, r.cards) for r in extract.matching_state(state, "id", "j").collect()] == [("a", ["x"])]
    flags = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "g int, f boolean").groupBy("g").agg(rollup.overall_state(F.col("f")).alias("s")).collect()
    assert {r.g: r.s for r in flags} == {1: "mixed", 2: "all", 3: "none"}


def test_gathered_context(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([None, "", "a" * rng.randint(1, 40), "b c", "dd"]), rng.random() < 0.1) for g in range(4) for i in range(80)]
    want = {}
    for g, i, _, _ in rows:
        before = [r for r in rows if r[0] == g and r[1] <= i]
        since = max((r[1] for r in before if r[3]), default=-1)
        want[g, i] = "\n".join(r[2] for r in before if r[1] >= since and r[1] < i and r[2] is not None)[-12:]
    given = spark.createDataFrame(rows, "g int, i int, t string, edge boolean")
    got = extract.gathered_context(given, "g", "i", "t", F.col("edge"), 12)
    assert got.columns == ["g", "i", "t", "edge", "context"] and {(r.g, r.i): r.context for r in got.collect()} == want
    assert extract.gathered_context(given.limit(0), "g", "i", "t", F.col("edge")).count() == 0


def test_page_plans(spark):
    pages = [(1, "crossword", None, 0, None), (2, "matching", 2, 2, 9), (3, "plain", 2, 2, 9), (4, "plain", 3, 2, 9), (5, "plain", None, 1, 9), (6, "plain", None, 0, 9), (7, "plain", 2, 2, None), (8, "plain", None, 2, None)]
    given = spark.createDataFrame([(*p, "exact", 1.0) for p in pages], "page_id int, kind string, answer_size int, n_controls int, needle_id int, quality string, similarity double")
    groups = spark.createDataFrame([(p, n, "exact", None) for p, n in [(1, 5), (1, None), (4, 5), (4, 6), (3, 5), (3, 6), (7, 5), (7, None)]], "page_id int, needle_id int, quality string, similarity double")
    got = {r.page_id: (r["mode"], r.matched, r.total, r.usable) for r in lookup.page_plans(given, groups).collect()}
    assert got == {1: ("crossword", 1, 2, False), 2: ("matching", 0, 0, False), 3: ("positional", 1, 1, True), 4: ("groups", 2, 2, True), 5: ("single", 1, 1, True), 6: ("single", 0, 1, False), 7: ("groups", 1, 2, False), 8: ("single", 0, 1, False)}
    assert lookup.page_plans(given.limit(0), groups).count() == 0


def test_files(spark, tmp_path):
    path = str(tmp_path / "base.json")
    data = [{"question": "Q«1»", "answer": "a"}, {"question": "Q2", "answer": ["x", "y"], "type": "matching"}, {"question": "Q3", "answer": {"1": "w"}, "problem_id": "p"}]
    (tmp_path / "base.json").write_text(json.dumps(data, ensure_ascii=False))
    got = files.read_records(spark, path)
    assert [r.question for r in got.orderBy("ord").collect()] == ["Q«1»", "Q2", "Q3"]
    backup = sinks.write_canonical(spark, got.drop("path"), "ord", path)
    raw = (tmp_path / "base.json").read_bytes().decode()
    assert raw == sinks.render(data) and backup == f"{path}.bak" and json.loads((tmp_path / "base.json.bak").read_text()) == data
    assert sinks.verify(files.read_records(spark, path).drop("path"), got.drop("path"))
    assert not sinks.verify(got.drop("path"), sinks.without(got, "ord", [1]).drop("path"))
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="list of records"):
        files.read_records(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "names.json").write_text('[" One ", 5, "", "Two"]')
    assert [r.name for r in files.read_names(spark, str(tmp_path / "names.json")).orderBy("ord").collect()] == ["One", None, None, "Two"]
    (tmp_path / "map.json").write_text('{"1_0": "a", "2": "b"}')
    assert {(r.name, r.text) for r in files.read_transcriptions(spark, str(tmp_path / "map.json")).collect()} == {("1_0", "a"), ("2", "b")}
    assert files.newest_file(spark, [str(tmp_path)]).count() == 1
    (tmp_path / "old.txt").write_bytes("строка\nещё".encode("cp866"))
    assert [r.text for r in files.read_lines(spark, str(tmp_path / "old.txt")).collect()] == ["строка", "ещё"]
    sinks.export(got.withColumn("_at", F.lit("now")), str(tmp_path / "out"))
    assert "_at" not in spark.read.json(str(tmp_path / "out")).columns
    names = spark.createDataFrame([("Lecture 1.docx",), ("Notes.docx",)], "n string")
    assert files.resolve_name(names, "n", "lecture1.docx").first().name == "Lecture 1.docx"
    assert [r.name for r in files.close_names(names, "n", "note.docx").collect()][0] == "Notes.docx"


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    run = lambda t, h="": f"<w:r>{h}<w:t>{t}</w:t></w:r>"
    mark = '<w:rPr><w:highlight w:val="yellow"/></w:rPr>'
    body = f"<w:p>{run('Pick one: ')}{run('this', mark)}{run(' or that')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl><w:p><w:r><x r:embed='rId5'/></w:r></w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId5" Type="x/image" Target="media/a.png"/></Relationships>')
        z.writestr("word/media/a.png", b"png")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    blocks = files.read_docx(spark, str(tmp_path / "a.docx"))
    assert [(r.kind, r.text, r.pictures) for r in blocks.orderBy("idx").collect()] == [("paragraph", "Pick one: this or that", []), ("table", "cell", []), ("paragraph", "", ["rId5"])]
    assert [(r.question, r.answer) for r in files.highlighted_records(blocks).collect()] == [("Pick one: this or that", "this")]
    assert [(r.id, bytes(r.data)) for r in files.read_docx_pictures(spark, str(tmp_path / "a.docx")).collect()] == [("rId5", b"png")]


def test_images(spark):
    def picture(*boxes, fill=False):
        p = np.full((200, 100, 3), 255, np.uint8)
        for top, bottom, colour in boxes:
            p[top:bottom, 5:95] = colour
            if not fill:
                p[top + 2 : bottom - 2, 7:93] = 255
        return p

    green, red = images.GREEN[0], images.RED[0]
    want = {"NO_MARK": picture(), "GREEN_NOCHECK": picture((10, 40, green)), "RED_WRONG": picture((10, 40, red)), "MULTI_ANSWER": picture((10, 40, green), (60, 90, green)), "CROSSWORD": picture((10, 60, green), (80, 130, green), fill=True), "GREEN_TICK_ONLY": picture((10, 20, green), fill=True)}
    rows = [(k, p.tobytes(), 200, 100) for k, p in want.items()] + [(None, b"xx", 2, 2), (None, None, None, None)]
    got = images.classify_rasters(spark.createDataFrame(rows, "want string, data binary, height int, width int")).collect()
    assert all(r.cls == r.want for r in got)


def test_spread_scan(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None, ""]), i, rng.choice(["x", "y", None]), rng.choice([None, None, None, i])) for i in rng.sample(range(10_000), 600)]
    given = spark.createDataFrame(rows, "key string, ord long, state string, link long").repartition(5)
    steps = {"nth": scan.Number(), "n": scan.Count(), "before": scan.Before("state"), "after": scan.After("link"), "so_far": scan.Latest("link"), "starts": scan.Starts("state")}
    want = sorted(map(repr, scan.scanned(given, ["key"], "ord", **steps).collect()))
    for partitions in (1, 7, 40):
        assert sorted(map(repr, scan.spread_scan(given, ["key"], "ord", partitions=partitions, **steps).collect())) == want
    one = given.withColumn("key", F.lit("all"))
    parts = {r.p for r in one.repartitionByRange(8, "key", "ord").select(F.spark_partition_id().alias("p")).collect()}
    assert len(parts) == 8  # one key, all tasks
    assert scan.spread_scan(given.limit(0), ["key"], "ord", **steps).count() == 0
    for f, columns in ((dedupe.ordinals, ()), (dedupe.clashes, ("state",)), (dedupe.replaced_pairs, ())):
        plain, spread = (sorted(map(repr, f(given, "key", "ord", *columns, spread=s).collect())) for s in (False, True))
        assert plain == spread
    plain, spread = (sorted(map(repr, capture.changed_only(given, "key", "ord", "state", spread=s).collect())) for s in (False, True))
    assert plain == spread


def test_capture_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, rng.choice("xy")) for i in range(60)]
    merged = lambda n: {k: (o, a, p) for k, o, a, _, _, p, _, _ in model_merge([], [(*r, None) for r in rows[:n]])}
    arrive = lambda k: spark.createDataFrame(rows[20 * k : 20 * k + 20], "key string, ord long, answer string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    held = lambda s: {r.key: (r.ord, r.answer, r.pos) for r in s.read().collect()}

    def take(captured):
        stream = spark.readStream.schema("key string, ord long, answer string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        captured.start(stream).awaitTermination()

    first = capture.CaptureSet(spark, str(tmp_path / "state"), "string")
    base = spark.createDataFrame([("a", -1, "z"), ("q", -2, "z")], "key string, ord long, answer string")
    live = capture.LiveBase(base, first)
    assert first.version() == -1 and held(first) == {} and first.changes().count() == 0
    assert {r.key: r.answer for r in live.records().collect()} == {"a": "z", "q": "z"}
    arrive(0)
    arrive(1)
    take(first)
    assert first.version() == 1 and held(first) == merged(40)
    assert {r.key: r.answer for r in live.records().collect()} == {"q": "z"} | {k: a for k, (_, a, _) in merged(40).items()} and live.version == 2
    live.records()
    assert live.version == 2  # nothing came since

    again = capture.CaptureSet(spark, str(tmp_path / "state"), "string")  # another process after a restart
    assert held(again) == merged(40)
    arrive(2)
    take(again)
    assert again.version() == 2 and held(again) == merged(60) == held(first)
    late = {r.key: r.answer for r in again.changes(1).collect()}
    assert late == {k: merged(60)[k][1] for k in late} and set(late) == {k for k in merged(60) if merged(60)[k] != merged(40).get(k)}
    assert sum(r.added for r in again.report().collect()) == len(merged(60))
    assert live.records() is live.records() and live.version == 3


def test_capture_stream_removals(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x", False), ("b", 2, "x", False), (None, 3, None, False)], "key string, ord long, answer string, gone boolean").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    captured = capture.CaptureSet(spark, str(tmp_path / "state"), "string")
    stream = spark.readStream.schema("key string, ord long, answer string, gone boolean").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    captured.start(stream).awaitTermination()
    assert {r.key for r in captured.read().collect()} == {"a", "b", None}
    spark.createDataFrame([("a", 4, None, True), ("b", 5, None, True), ("b", 6, "y", None)], "key string, ord long, answer string, gone boolean").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    captured.start(stream).awaitTermination()
    assert {(r.key, r.answer, r.pos) for r in captured.read().collect()} == {("b", "y", 6), (None, None, 3)}
    assert {r.change for r in captured.changes(0).collect()} == {"gone", "updated"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, small, name):
    frame = catalogue.QUERIES[name](spark, small)
    rows = frame.select(sorted(frame.columns)).collect()
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in "part orders events documents pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        rel = con.sql(catalogue.ORACLES[name])
        assert sorted(rel.columns) == sorted(frame.columns)
        other = rel.select(*[duckdb.ColumnExpression(c) for c in sorted(rel.columns)]).fetchall()
        shown = lambda rs: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rs)
        assert shown(rows) == shown(other)
