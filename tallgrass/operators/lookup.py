"""Looking records up inside texts: containment first, then an approximate match.

Containment is a theta join that ``operators.containment`` turns into lookups of seeds; up to ``MAX_SEEDS`` needles are
verified where the texts are, more are joined by seed. The approximate match is of ``operators.shortlist`` and
``functions.distance``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.functions.distance import distance, similarity
from tallgrass.operators import containment
from tallgrass.operators.shortlist import dice_shortlist

MAX_SEEDS = 200_000
MIN_SIMILARITY, MIN_MARGIN, SHORTLIST = 0.90, 0.03, 5
#: Records of these kinds are looked up by their parts, never approximately.
EXACT_KINDS = ("crossword", "matching", "composite")
CHOICE_SIMILARITY, CHOICE_MARGIN = 0.92, 0.10


def forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id key solid`` of each row."""
    return df.select(F.col(id_col).alias("id"), T.key(text_col).alias("key")).withColumn("solid", F.replace("key", F.lit(" "), F.lit("")))


def containment_pairs(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """``page_id needle_id score`` of every needle (id, key, solid) that occurs in a page (id, key, solid)."""
    return containment.containment_pairs(pages, needles, MAX_SEEDS)


def contains_lookup(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """The best needle of each page that has one: the longest found, then the one with the smallest id."""
    pairs = containment_pairs(pages, needles)
    return pairs.groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("needle_id").alias("needle_id"))).alias("best")).select("page_id", "best.needle_id", (-F.col("best.s")).alias("score"))


def composite_pairs(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """``page_id needle_id score`` of needles all of whose parts (id, part, key, solid) occur; scores add up."""
    unique = parts.withColumn("pid", F.struct("id", "part"))
    hits = containment_pairs(pages, unique.select(F.col("pid").alias("id"), "key", "solid"))
    wanted = parts.groupBy(F.col("id").alias("needle_id")).agg(F.count("*").alias("wanted"))
    got = hits.select("page_id", F.col("needle_id.id").alias("needle_id"), "score").groupBy("page_id", "needle_id").agg(F.count("*").alias("got"), F.sum("score").alias("score"))
    return got.join(wanted, "needle_id").filter("got = wanted").select("page_id", "needle_id", "score")


def approx_lookup(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """A row per page with a candidate: ``page_id needle_id similarity edits accepted near``.

    Accepted: similarity and edits in bounds, apart from the second candidate, and not against the page's choices. ``near``:
    up to three candidates. Needles may have a ``kind`` (those of ``EXACT_KINDS`` take no part) and their answers' ``values``,
    pages their ``choices``: arrays of normalised texts. Pages of any length are compared.
    """
    # Few bytes a page but much work, so tasks are not left to the size of the shuffle; the window below needs no other.
    n_tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = pages.filter(F.col("key") != "").select("id", "key", *[c for c in pages.columns if c == "choices"]).repartition(n_tasks, "id")
    own = needles.filter(~F.coalesce(F.col("kind"), F.lit("")).isin(*EXACT_KINDS)) if "kind" in needles.columns else needles
    none = F.lit(None).cast("array<string>")
    texts = short.select(F.col("id").alias("page_id"), F.col("key").alias("p_key"), (F.col("choices") if "choices" in pages.columns else none).alias("choices"))
    answers = own.select(F.col("id").alias("needle_id"), F.col("key").alias("n_key"), (F.col("values") if "values" in own.columns else none).alias("values"))
    return _judged(dice_shortlist(short, own, SHORTLIST).join(answers, "needle_id").join(texts, "page_id"))


def _judged(pairs: DataFrame) -> DataFrame:
    """The best of each page's candidates (page_id, needle_id, rank, p_key, n_key, choices, values), and whether it is accepted."""
    judged = pairs.withColumn("most", T.max_distance(F.length("n_key")))
    judged = judged.withColumn("edits", distance(F.col("n_key"), F.col("p_key"), 2 * F.col("most") + 4)).filter(F.col("edits") <= 2 * F.col("most") + 4)
    judged = judged.withColumn("similarity", similarity(F.col("edits"), F.col("n_key")))
    w = Window.partitionBy("page_id").orderBy(F.desc("similarity"), "rank")
    ranked = judged.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("similarity").over(w)).withColumn("near", F.collect_list("needle_id").over(w.rowsBetween(0, 2)))
    fits = (F.col("similarity") >= MIN_SIMILARITY) & (F.col("edits") <= F.col("most")) & (F.col("second").isNull() | (F.col("similarity") - F.col("second") >= MIN_MARGIN)) & answer_fits(F.col("values"), F.col("choices"))
    return ranked.filter("k = 1").select("page_id", "needle_id", "similarity", "edits", fits.alias("accepted"), "near")


def own_lookup(pages: DataFrame, needles: DataFrame, own: DataFrame, approximate: bool = True) -> DataFrame:
    """``page_id needle_id quality``: pages looked up among their own needles (``own``: page_id, needle_id) only.

    The longest that a page contains, then the smallest id; for pages without one the approximate match, with a shortlist
    of own needles. A page has few own needles, so pairs are those of ``own``.
    """
    none = F.lit(None).cast("array<string>")
    texts = pages.select(F.col("id").alias("page_id"), F.col("key").alias("p_key"), F.col("solid").alias("p_solid"), (F.col("choices") if "choices" in pages.columns else none).alias("choices"))
    kinds = F.coalesce(F.col("kind"), F.lit("")) if "kind" in needles.columns else F.lit("")
    asked = needles.filter("key <> ''").select(F.col("id").alias("needle_id"), F.col("key").alias("n_key"), F.col("solid").alias("n_solid"), kinds.alias("kind"), (F.col("values") if "values" in needles.columns else none).alias("values"))
    pairs = own.select("page_id", "needle_id").distinct().join(asked, "needle_id").join(texts, "page_id")
    score = containment.hit_length(F.col("p_key"), F.col("p_solid"), F.col("n_key"), F.col("n_solid"))
    hits = pairs.withColumn("score", score).filter("score > 0").groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("needle_id"))).alias("best"))
    exact = hits.select("page_id", F.col("best.needle_id").alias("needle_id"), F.lit("exact").alias("quality"))
    if not approximate:
        return exact
    rest = pairs.filter((F.col("p_key") != "") & ~F.col("kind").isin(*EXACT_KINDS)).join(exact.select("page_id"), "page_id", "left_anti")
    dice = T.dice(T.words_of(F.col("n_key")), T.words_of(F.col("p_key")))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(dice), "needle_id"))).filter(F.col("rank") <= SHORTLIST)
    return exact.unionByName(_judged(ranked).filter("accepted").select("page_id", "needle_id", F.lit("approx").alias("quality")))


def lookup_cascade(pages: DataFrame, needles: DataFrame, links: DataFrame | None = None, context: DataFrame | None = None, approximate: bool = True, own: DataFrame | None = None) -> DataFrame:
    """``page_id needle_id quality weak``: the first stage that finds something for a page; pages without are left out.

    Stages: needles linked to the page by id (``links``: page_id, needle_id; the smallest), the page's own needles
    (``own``: page_id, needle_id) by ``own_lookup``, then all: exact containment, the approximate match, and exact
    containment in the text before the page (``context``: id, key, solid), which is weak.
    """
    kinds = {"page_id": pages.schema["id"].dataType, "needle_id": needles.schema["id"].dataType}
    found: list[DataFrame] = []
    left = pages

    def stage(hits: DataFrame, quality: str | None = None) -> None:
        nonlocal left
        named = F.col("quality") if quality is None else F.lit(quality).alias("quality")
        hits = hits.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], named)
        found.append(hits.select("page_id", "needle_id", "quality", F.lit(quality == "context").alias("weak")))
        left = left.join(hits.select(F.col("page_id").alias("id")), "id", "left_anti")

    if links is not None:
        known = links.join(needles.select(F.col("id").alias("needle_id")), "needle_id").groupBy("page_id").agg(F.min("needle_id").alias("needle_id"))
        stage(pages.select(F.col("id").alias("page_id")).join(known, "page_id"), "id")
    if own is not None:
        stage(own_lookup(left, needles, own, approximate))
    stage(contains_lookup(left, needles), "exact")
    if approximate:
        stage(approx_lookup(left, needles).filter("accepted"), "approx")
    if context is not None:
        stage(contains_lookup(context.join(left.select("id"), "id", "left_semi"), needles), "context")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def by_id_lookup(pages: DataFrame, records: DataFrame, link_col: str = "problem_id") -> DataFrame:
    """Records that are linked to a page by its id, 1:n."""
    return pages.select(F.col("id").alias("page_id"), link_col).join(records, link_col)


def best_of_groups(candidates: DataFrame) -> DataFrame:
    """Of candidates (page_id, group, needle_id, rank, score) the best for each group: rank, then score, then id."""
    w = Window.partitionBy("page_id", "group").orderBy(F.desc("rank"), F.desc("score"), "needle_id")
    return candidates.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def answer_fits(values: Column, choices: Column) -> Column:
    """Veto by choices: passes without choices or values, or if a value equals a choice or, from 3 characters on, lies in one."""
    some = F.exists(values, lambda v: F.exists(choices, lambda c: (c == v) | ((F.length(v) >= 3) & c.contains(v))))
    return (F.coalesce(F.size(choices), F.lit(0)) == 0) | (F.coalesce(F.size(values), F.lit(0)) == 0) | some


def closest_choice(options: DataFrame) -> DataFrame:
    """Of options (group, needle, option, ord) the one chosen for each group, if it is close and clearly ahead."""
    budget = T.max_distance(F.length("needle"), 3)
    scored = options.withColumn("similarity", similarity(distance(F.col("needle"), F.col("option"), budget), F.col("needle")))
    w = Window.partitionBy("group").orderBy(F.desc("similarity"), "ord")
    ranked = scored.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("similarity").over(w))
    ahead = F.col("second").isNull() | (F.col("similarity") - F.col("second") >= CHOICE_MARGIN)
    return ranked.filter((F.col("k") == 1) & (F.col("similarity") >= CHOICE_SIMILARITY) & ahead).select("group", "option", "similarity")


def complete(matched: Column, total: Column, approx: Column, conflicts: Column) -> Column:
    """Whether a plan may be used as it is: something matched, all of it, exactly, without conflicts."""
    return (matched > 0) & (matched == total) & ~approx & (F.coalesce(F.size(conflicts), F.lit(0)) == 0)


def chosen_options(options: DataFrame) -> DataFrame:
    """Options (group, needle, option, ord; texts normalised) that a needle chooses: ``group option quality``.

    Equal options first; where a group has none, options that contain the needle; then a single close one.
    """
    exact = options.filter(F.col("option") == F.col("needle"))
    rest = options.join(exact.select("group").distinct(), "group", "left_anti")
    inside = rest.filter((F.length("needle") >= 3) & F.col("option").contains(F.col("needle")))
    left = rest.join(inside.select("group").distinct(), "group", "left_anti")
    named = lambda df, quality: df.select("group", "option", F.lit(quality).alias("quality"))
    return named(exact, "exact").unionByName(named(inside, "contains")).unionByName(named(closest_choice(left), "approx"))


def resolved_cards(wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards for places: wanted (place, ord, card) by id or else by normalised text in cards (id, text).

    ``place ids``: only places all of whose cards are found.
    """
    by_id = cards.select(F.col("id").alias("card"), F.col("id").alias("id_hit"))
    by_text = cards.groupBy(T.norm("text").alias("card_norm")).agg(F.min("id").alias("text_hit"))
    found = wanted.join(by_id, "card", "left").withColumn("card_norm", T.norm("card")).join(by_text, "card_norm", "left").withColumn("hit", F.coalesce("id_hit", "text_hit"))
    places = found.groupBy("place").agg(F.bool_and(F.col("hit").isNotNull()).alias("whole"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "hit"))), lambda c: c["hit"]).alias("ids"))
    return places.filter("whole").select("place", "ids")


def lookup_plan(groups: DataFrame) -> DataFrame:
    """A row per page from its groups (page_id, needle_id or null, quality, similarity): what matched, how, how surely."""
    hit = F.col("needle_id").isNotNull()
    plan = groups.groupBy("page_id").agg(F.count_if(hit).alias("matched"), F.count("*").alias("total"), F.coalesce(F.bool_or(F.col("quality") == "approx"), F.lit(False)).alias("approx"), F.array_sort(F.collect_set("quality")).alias("quality"), F.min("similarity").alias("similarity"))
    return plan.withColumn("usable", complete(F.col("matched"), F.col("total"), F.col("approx"), F.array()))


def plan_mode(kind: Column, answer_size: Column, n_controls: Column, n_groups: Column) -> Column:
    """How a page takes its answer: by its own kind; a list in order of the controls, if it is as long; else whole or by group.

    ``answer_size`` is the length of the matched answer if that is a list, else null.
    """
    in_order = (n_controls > 0) & (answer_size == n_controls)
    return F.when(kind.isin("crossword", "matching"), kind).when(in_order, "positional").when(F.coalesce(n_groups, F.lit(0)) <= 1, "single").otherwise("groups")


def page_plans(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """``page_id mode matched total approx similarity usable`` of every page.

    ``pages``: page_id, kind, answer_size, n_controls, and the page's own match (needle_id or null, quality, similarity).
    ``groups`` as in ``lookup_plan``, whose counts stand for pages taken by group, and for the words or places of special
    kinds. Other pages are one question: matched if they have a match and a control or group to take it.
    """
    counted = lookup_plan(groups).select("page_id", *[F.col(c).alias(f"g_{c}") for c in ("matched", "total", "approx", "similarity")])
    n_groups = F.coalesce("g_total", F.lit(0))
    planned = pages.join(counted, "page_id", "left").withColumn("mode", plan_mode(F.col("kind"), F.when(F.col("needle_id").isNotNull(), F.col("answer_size")), F.col("n_controls"), n_groups))
    by_group = F.col("mode").isin("crossword", "matching", "groups")
    hit = F.col("needle_id").isNotNull() & ((n_groups > 0) | (F.col("n_controls") > 0))
    approx = hit & F.coalesce(F.col("quality") == "approx", F.lit(False))
    of = lambda grouped, own: F.when(by_group, grouped).otherwise(own)
    plan = planned.select(
        "page_id",
        "mode",
        of(F.coalesce("g_matched", F.lit(0)), F.coalesce(hit.cast("long"), F.lit(0))).alias("matched"),
        of(n_groups, F.lit(1)).alias("total"),
        of(F.coalesce("g_approx", F.lit(False)), F.coalesce(approx, F.lit(False))).alias("approx"),
        of(F.col("g_similarity"), F.when(approx, F.col("similarity"))).alias("similarity"),
    )
    return plan.withColumn("usable", complete(F.col("matched"), F.col("total"), F.col("approx"), F.array()))
