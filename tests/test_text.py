"""Keys: relations that must hold, and the native columns against the one-string rules."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import distance as distance_module
from tallgrass.functions import rules
from tallgrass.functions import text as T
from tallgrass.functions.distance import distance, substring_distance
from tallgrass.operators import dedupe

EQUAL = [
    ("the «best» way", 'the "best" way'), ("well – known fact", "well - known fact"), ("wait…", "wait..."), (r"\frac{a}{b} of it", "(a)/(b) of it"),
    ("x_2 + y^3", "x2 + y3"), (r"\mathrm{H}_2O", "H2O"), ("{a} b", "a b"), ("x²", "x2"), ("№ 5", "No 5"), ("𝐹 = 𝑚", "F = m"), ("a b", "a b"),
    ("commu-nity", "community"), (r"a \leq b", r"a \le b"), (r"\alpha", "α"), (r"\(x\)", "x"), ("$x$", "x"), (r"\hspace{1cm}x", "x"), (r"\left( x \right)", "( x )"),
]
DIFFERENT = [("open order", "reopen order"), ("in 1917", "in 1918"), ("fill __ in", "fill ___ in"), ("it is so", "it is not so"), ("a b", "ab")]


def test_relations():
    for a, b in EQUAL:
        assert rules.key(a) == rules.key(b), (a, b)
    for a, b in DIFFERENT:
        assert rules.key(a) != rules.key(b), (a, b)
    assert rules.norm("up to $63 a barrel") == "up to $63 a barrel" and "___" in rules.key("a ___ b")
    assert rules.key(None) == rules.key("?!") == "" and rules.norm("⬜ A ⚫B") == "a b"


def test_columns_equal_rules(spark):
    rng = random.Random(4)
    pieces = ["a", "B", "é", "й", "–", "—", "-", "‑", "«", "»", "“", "'", "`", "$", "$$", "{", "}", "_", "^", " ", "\n", "\t", " ", "…", "...", "1", "\\frac{a}{b}", "\\alpha", "\\foo", "²", "⬜", "\x1c", "́", ",", "ﬁ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [x for pair in EQUAL + DIFFERENT for x in pair] + [None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fold("t").alias("fold"), T.norm("t").alias("norm"), T.key("t").alias("key"), T.solid("t").alias("solid"), T.text_forms("t").alias("forms")).collect()
    for r in rows:
        t = texts[r.i]
        assert (r.fold, r.norm, r.key, r.solid) == (rules.fold(t), rules.norm(t), rules.key(t), rules.solid(t)), repr(t)
        assert r.forms.solid == r.solid


def test_sql_functions(spark):
    T.register(spark)
    assert spark.sql("SELECT text_key('«A»—b') AS k").first().k == "a b"


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda c: T.brief(c, 5), ["abcd…", "", "a b"]),
        (T.clean_text, ["abcdef", "", "a b"]),
        (lambda c: T.question_parts(F.concat(F.coalesce(c, F.lit("")), F.lit("... X "))), [["abcdef", "x"], ["x"], ["a b", "x"]]),
        (T.crossword_word, ["abcdef", "", "ab"]),
        (lambda c: T.item_number(F.concat(F.coalesce(c, F.lit("")), F.lit("b10"))), [10, 10, 10]),
        (lambda c: T.trim_ellipsis(F.concat(F.coalesce(c, F.lit("")), F.lit(" ,, …"))), ["abcdef", "", "a  b"]),
        (lambda c: T.unquote(F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))), ["abcdef", "", "a  b"]),
        (lambda c: T.scenario_fragment(F.concat(F.coalesce(c, F.lit("")), F.lit(" one... two, three"))), ["abcdef one two", "one two", "a b one two"]),
        (lambda c: T.status_of(c, "cd", "ab", "a"), ["wrong", "unknown", "correct"]),
    ],
)
def test_small_functions(spark, column, want):
    frame = spark.createDataFrame([(0, "abcdef"), (1, None), (2, " a  b ")], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(column(F.col("t"))).collect()] == want


def test_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 4, 5, 11, 21, 22, 25, 101, 112)], "n int").select(T.plural(F.col("n"), "one", "few", "many").alias("p"), T.max_distance(F.col("n")).alias("d")).collect()
    assert [r.p for r in rows] == ["many", "one", "few", "few", "many", "many", "one", "few", "many", "one", "many"]
    assert [r.d for r in rows] == [4, 4, 4, 4, 4, 4, 4, 4, 4, 10, 11]
    raw = spark.createDataFrame([(x.encode(n),) for x, n in (("вода é", "utf-8"), ("вода", "cp866"))], "b binary")
    assert [r.t for r in raw.select(T.decode_fallback(F.col("b")).alias("t")).collect()] == ["вода é", "вода"]


def plain_distance(needle, text):
    """Least edits to any run of whole words (or to nothing at a border), by the full table of every run.

    A run may not begin with an insertion: its first letter stands against a letter of the needle.
    """

    def edits(a, b):
        row = [0] + [99] * len(b)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    starts = [j for j in range(len(text) + 1) if j == 0 or text[j - 1] == " "]
    ends = [j for j in range(len(text) + 1) if j == len(text) or text[j] == " "]
    return min(edits(needle, text[a:b]) for a in starts for b in ends if a <= b)


def test_distance(spark):
    rng = random.Random(8)
    for _ in range(400):
        needle = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 8))).strip() or "a"
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
        assert substring_distance(needle, text, 20) == plain_distance(needle, text), (needle, text)
        budget = rng.randint(0, 4)
        assert (substring_distance(needle, text, budget) <= budget) == (plain_distance(needle, text) <= budget)
    rows = spark.createDataFrame([("cat sat", "the cat sat down", 4), ("", "x", 1), (None, "x", 1)], "a string, b string, k int")
    assert [r.d for r in rows.select(distance(F.col("a"), F.col("b"), F.col("k")).alias("d")).collect()] == [0, 0, None]


def test_a_key_is_worked_out_once(spark):
    """However often a plan names a key: in filters, branches and groups."""
    docs = spark.createDataFrame([(1, "A-b, c"), (2, "ab C"), (3, "`x` Σ’Σ")], "id long, text string").withColumn("key", T.key("text"))
    found = dedupe.dedupe_last(docs.filter(F.length("key") > 1), "key", "id").select("id", "pos", F.upper("key").alias("k"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_replace") == 0 and plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [(2, 1, "AB C"), (3, 3, "X Σ Σ")]


def test_far_pairs_are_told_without_the_table():
    text = distance_module._Letters("one two three four five six seven eight nine ten " * 30)
    codes = lambda s: distance_module.np.frombuffer(s.encode("utf-32-le"), "uint32")
    assert distance_module.surely_beyond(codes("kwzq jxvb " * 12), text, 28)
    for needle, budget in (("two three four", 0), ("wo thre fourr", 2), ("e two t", 0)):
        assert not distance_module.surely_beyond(codes(needle), text, budget)
    rnd = random.Random(3)
    for _ in range(300):
        page = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 60)))
        needle = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 20)))
        for budget in range(6):
            if distance_module.surely_beyond(codes(needle), distance_module._Letters(page), budget):
                assert plain_distance(needle, page) > budget, (needle, page, budget)
