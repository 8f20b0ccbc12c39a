"""The registered queries of the library, with the same question in SQL where SQL has the means.

Tables stand in for records: a document is a record whose question is its text and whose answer is its source,
benchmark items are needles, events are a change log, conversations are ordered lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import records, rules
from tallgrass.functions import text as T
from tallgrass.operators import dedupe, extract, harvest, lookup, merge, rollup, scan
from tallgrass.streaming.capture import capture_events, changed_only

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return read(spark, sf_dir, name).withColumn("key", T.key("text"))


# The key of a text in SQL. Its regular expressions have no look-behind, so pair rules run twice; NFKC and formula
# commands are left out, as SQL has no means for them, and the tables hold no text that they change.
_DASH = r"[\-‐‑‒–—―−]"
_QUOTES = (rules.DOUBLE_QUOTES + rules.SINGLE_QUOTES).replace("'", "''")
_UNIFIED = ('"' * len(rules.DOUBLE_QUOTES) + "'" * len(rules.SINGLE_QUOTES)).replace("'", "''")
_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}" + rules.BLANK_GLYPHS + "]"


def _sql_norm(text: str) -> str:
    out = f"coalesce({text}, '')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '(\p{{L}}){_DASH}(\p{{L}})', '\1\2', 'g')"
    out = f"translate(translate({out}, '{rules.DASHES}', '{'-' * len(rules.DASHES)}'), '{_QUOTES}', '{_UNIFIED}')"
    out = rf"regexp_replace({out}, '\$\$([^$\n]{{1,400}})\$\$|\$([^$\n]{{1,120}})\$', ' \1\2 ', 'g')"
    out = f"replace(replace({out}, '{{', ''), '}}', '')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '([\p{{L}}\p{{N}}]){_SP}*[_^]{_SP}*([\p{{L}}\p{{N}}])', '\1\2', 'g')"
    return f"lower(trim(regexp_replace({out}, '{_SP}+', ' ', 'g')))"


def _sql_key(text: str) -> str:
    return rf"trim(regexp_replace({_sql_norm(text)}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


_KEYED = f"keyed AS (SELECT *, {_sql_key('text')} AS key FROM documents)"
_NEEDLES = f"needles AS (SELECT item_id, key, replace(key, ' ', '') AS solid FROM (SELECT item_id, {_sql_key('text')} AS key FROM benchmark))"
_PAGES = f"pages_ AS (SELECT doc_id, key, replace(key, ' ', '') AS solid FROM (SELECT doc_id, {_sql_key('text')} AS key FROM documents))"


@query(f"SELECT doc_id, md5({_sql_norm('text')}) AS norm_md5, md5({_sql_key('text')}) AS key_md5, length(replace({_sql_key('text')}, ' ', '')) >= 12 AS usable FROM documents")
def norm_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", T.norm("text").alias("norm")).withColumn("key", T.key_of_norm(F.col("norm")))
    return docs.select("doc_id", F.md5("norm").alias("norm_md5"), F.md5("key").alias("key_md5"), T.solid_usable(T.solid_of_key(F.col("key"))).alias("usable"))


@query(f"WITH {_KEYED} SELECT max(doc_id) AS doc_id, min(doc_id) AS pos, md5(key) AS key_md5 FROM keyed WHERE key <> '' GROUP BY key")
def key_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_last(keyed(spark, sf_dir).select("doc_id", "key"), "key", "doc_id").select("doc_id", "pos", F.md5("key").alias("key_md5"))


@query(f"WITH {_KEYED}, w AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY key ORDER BY doc_id) AS kept FROM keyed WHERE key <> '') SELECT doc_id AS dropped, kept FROM w WHERE kept IS NOT NULL")
def key_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.replaced_pairs(keyed(spark, sf_dir).select("doc_id", "key"), "key", "doc_id").select("dropped", "kept")


@query(
    f"""WITH {_KEYED}, j AS (SELECT k.doc_id, k.key, k.source, l.quality FROM keyed k LEFT JOIN labels l USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) AS n,
      first_value(quality IGNORE NULLS) OVER (PARTITION BY key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS other FROM j)
    SELECT doc_id, source, coalesce(quality, other) AS quality FROM r WHERE n = 1"""
)
def dedupe_with_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select("doc_id", "key", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return dedupe.dedupe_in_place(rows, "key", "doc_id", ["quality"]).select("doc_id", "source", "quality")


@query(f"WITH {_KEYED} SELECT md5(key) AS key_md5, array_to_string(list(doc_id ORDER BY doc_id), ',') AS places, count(*) AS n FROM keyed GROUP BY key HAVING count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedupe.duplicate_groups(keyed(spark, sf_dir), "key", "doc_id")
    return groups.select(F.md5("key").alias("key_md5"), F.array_join(F.col("places").cast("array<string>"), ",").alias("places"), "n")


@query(f"WITH {_KEYED}, c AS (SELECT count(*) AS n FROM keyed GROUP BY key) SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS removed, count(*) AS stay FROM c")
def surplus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.surplus(keyed(spark, sf_dir), "key")


@query(f"WITH {_KEYED} SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY key) AS n, doc_id = max(doc_id) OVER (PARTITION BY key) AS keep FROM keyed")
def dup_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.ordinals(keyed(spark, sf_dir).select("doc_id", "key"), "key", "doc_id").select("doc_id", "k", "n", "keep")


@query(f"WITH {_KEYED} SELECT doc_id FROM keyed WHERE key IN (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(*) > 1)")
def double_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.double_keys(keyed(spark, sf_dir).select("doc_id", "key"), "key").select("doc_id")


@query(f"WITH {_KEYED} SELECT md5(key) AS key_md5, count(DISTINCT source) AS answers FROM keyed GROUP BY key HAVING count(DISTINCT source) > 1")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.ambiguous_keys(keyed(spark, sf_dir), "key", "source").select(F.md5("key").alias("key_md5"), "answers")


@query(f"WITH {_KEYED}, w AS (SELECT doc_id AS dropped, lead(doc_id) OVER w AS kept, source AS old, lead(source) OVER w AS new FROM keyed WHERE key <> '' WINDOW w AS (PARTITION BY key ORDER BY doc_id)) SELECT dropped, kept, old, new FROM w WHERE kept IS NOT NULL AND old IS DISTINCT FROM new")
def clash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.clashes(keyed(spark, sf_dir), "key", "doc_id", "source").drop("key")


@query(f"WITH {_KEYED} SELECT count(*) AS records, count(DISTINCT key) FILTER (WHERE key <> '') AS keys, count(*) FILTER (WHERE key = '') AS empty FROM keyed")
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.key_audit(keyed(spark, sf_dir), "key")


@query(
    """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS link FROM events)
    SELECT event_id, row_number() OVER w AS nth, count(*) OVER () AS n, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after,
      last_value(link IGNORE NULLS) OVER w AS link_so_far, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS starts
    FROM e WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def one_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one key, scanned by all tasks."""
    link = F.when(F.col("event_id") % 4 == 0, F.get_json_object("props", "$.k"))
    events = read(spark, sf_dir, "events").select(F.lit(1).alias("key"), "event_id", "event_type", link.alias("link"))
    steps = {"nth": scan.Number(), "n": scan.Count(), "before": scan.Before("event_type"), "after": scan.After("event_type"), "link_so_far": scan.Latest("link"), "starts": scan.Starts("event_type")}
    return scan.spread_scan(events, ["key"], "event_id", **steps).drop("key", "event_type", "link")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of a user are answers in order; the first third of all is the base, and a page in ``props`` is the link."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("answer"), F.when(F.col("event_id") % 4 == 0, F.get_json_object("props", "$.k")).alias("link"))
    return events.filter("ord % 3 = 0"), events.filter("ord % 3 <> 0")


_MARKED = """rows_ AS (SELECT user_id AS key, event_id AS ord, event_type AS answer, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS link,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS src FROM events),
  taking AS (SELECT * FROM (SELECT *, max(CASE WHEN src = 0 THEN ord END) OVER (PARTITION BY key) AS last_base FROM rows_) WHERE src = 1 OR ord = last_base),
  marked AS (SELECT *, row_number() OVER w AS nth, (row_number() OVER w = 1) OR answer IS DISTINCT FROM lag(answer) OVER w AS start,
    coalesce(link, '') <> '' AND count(CASE WHEN coalesce(link, '') <> '' THEN 1 END) OVER (PARTITION BY key ORDER BY src, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS first_link
    FROM taking WINDOW w AS (PARTITION BY key ORDER BY src, ord)),
  merged AS (SELECT key, arg_max(answer, nth) FILTER (WHERE start) AS answer, arg_max(ord, nth) FILTER (WHERE start) AS ord,
    coalesce(arg_max(link, nth) FILTER (WHERE start AND coalesce(link, '') <> ''), arg_min(link, nth) FILTER (WHERE coalesce(link, '') <> '')) AS link,
    min(src) = 1 AS is_new, arg_min(ord, nth) AS pos,
    count(*) FILTER (WHERE nth > 1 AND (start OR first_link)) AS n_updates, count(*) FILTER (WHERE nth > 1 AND NOT start AND NOT first_link) AS n_same
    FROM marked GROUP BY key)"""


@query(f"WITH {_MARKED} SELECT * FROM merged")
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.ordered_merge(*_changes(spark, sf_dir), "key", "ord", "answer", ["link"])


@query(f"WITH {_MARKED} SELECT count(*) FILTER (WHERE is_new) AS added, CAST(sum(n_updates) AS BIGINT) AS updated, CAST(sum(n_same) AS BIGINT) AS same, count(*) AS total FROM merged")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_report(merge.ordered_merge(*_changes(spark, sf_dir), "key", "ord", "answer", ["link"]))


@query(
    """WITH e AS (SELECT user_id AS key, event_id AS ord, CASE WHEN event_id % 10 = 1 THEN '' ELSE event_type END AS answer FROM events),
  b AS (SELECT * FROM e WHERE ord % 3 = 0), c AS (SELECT * FROM e WHERE ord % 3 <> 0 AND answer <> ''),
  t AS (SELECT *, 0 AS src FROM b QUALIFY ord = max(ord) OVER (PARTITION BY key) UNION ALL SELECT *, 1 FROM c),
  m AS (SELECT *, row_number() OVER w AS nth, row_number() OVER w = 1 OR answer IS DISTINCT FROM lag(answer) OVER w AS start FROM t WINDOW w AS (PARTITION BY key ORDER BY src, ord)),
  k AS (SELECT min(src) = 1 AS is_new, count(*) FILTER (WHERE nth > 1 AND start) AS u, count(*) FILTER (WHERE nth > 1 AND NOT start) AS s FROM m GROUP BY key)
  SELECT count(*) FILTER (WHERE is_new) AS added, CAST(sum(u) AS BIGINT) AS updated, CAST(sum(s) AS BIGINT) AS same,
    (SELECT count(*) FROM e WHERE ord % 3 <> 0 AND answer = '') AS empty, (SELECT count(*) FROM b) AS before, (SELECT count(*) FROM b) + count(*) FILTER (WHERE is_new) AS after FROM k"""
)
def merge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a merge whose change set has blank records."""
    answer = F.when(F.col("event_id") % 10 == 1, "").otherwise(F.col("event_type"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), answer.alias("answer"))
    base, changes = events.filter("ord % 3 = 0"), events.filter("ord % 3 <> 0")
    merged = merge.ordered_merge(base, changes.filter("answer <> ''"), "key", "ord", "answer")
    return merge.merge_totals(merged, base, changes.filter("answer = ''"))


@query("""WITH c AS (SELECT event_id // 3 AS i, event_id % 3 AS k, event_type AS t FROM events WHERE event_id % 4 <> 1)
  SELECT i, CASE WHEN count(*) = 1 THEN to_json(min(t)) ELSE to_json(list(t ORDER BY k)) END AS answer FROM c GROUP BY i""")
def assembled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part is a value, several are a list; the transcription of part 0 goes by the picture's number alone."""
    parts = read(spark, sf_dir, "events").filter("event_id % 4 <> 1").selectExpr("event_id div 3 AS i", "CAST(event_id % 3 AS STRING) AS k", "event_type AS text")
    told = parts.select(F.when(F.col("k") == "0", F.col("i").cast("string")).otherwise(F.concat_ws("_", "i", "k")).alias("name"), "text")
    found = extract.assembled(parts.select("i", "k", F.lit("q").alias("question")), told)
    return found.select("i", records.value_or_list(F.col("answers")).alias("answer"))


@query("SELECT event_id AS ord FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events WHERE event_id % 3 = 0) WHERE event_id < last")
def merge_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.superseded(_changes(spark, sf_dir)[0], "key", "ord").select("ord")


def _last_by_user(events: DataFrame) -> DataFrame:
    return events.groupBy("key").agg(F.max("ord").alias("ord"), F.max_by("answer", "ord").alias("answer"))


@query("WITH b AS (SELECT user_id AS key, max(event_id) AS ord FROM events WHERE event_id % 7 = 0 GROUP BY 1), i AS (SELECT user_id AS key, max(event_id) AS ord FROM events WHERE event_id % 7 <> 0 GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM i WHERE key NOT IN (SELECT key FROM b WHERE key IS NOT NULL)")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("answer"))
    return merge.append_new(_last_by_user(events.filter("ord % 7 = 0")), _last_by_user(events.filter("ord % 7 <> 0")), "key").select("key", "ord")


@query("WITH b AS (SELECT user_id AS key, max(event_id) AS ord FROM events WHERE event_id % 7 = 0 GROUP BY 1), i AS (SELECT user_id AS key, max(event_id) AS ord FROM events WHERE event_id % 7 <> 0 GROUP BY 1) SELECT coalesce(i.key, b.key) AS key, coalesce(i.ord, b.ord) AS ord FROM b FULL JOIN i ON b.key = i.key")
def refresh_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("answer"))
    return merge.refresh(_last_by_user(events.filter("ord % 7 = 0")), _last_by_user(events.filter("ord % 7 <> 0")), "key").select("key", "ord")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return lookup.forms(read(spark, sf_dir, "documents"), "doc_id", "text"), lookup.forms(read(spark, sf_dir, "benchmark"), "item_id", "text")


_HITS = f"""{_PAGES}, {_NEEDLES}, hits AS (SELECT doc_id AS page_id, item_id AS needle_id, CAST(CASE WHEN contains(p.key, n.key) THEN length(n.key) ELSE length(n.solid) END AS BIGINT) AS score
  FROM pages_ p JOIN needles n ON n.key <> '' AND (contains(p.key, n.key) OR (length(n.solid) >= 12 AND contains(p.solid, n.solid))))"""


@query(f"WITH {_HITS} SELECT page_id, arg_min(needle_id, (-score, needle_id)) AS needle_id, max(score) AS score FROM hits GROUP BY page_id")
def contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.contains_lookup(*_sides(spark, sf_dir))


@query(f"WITH {_HITS} SELECT * FROM hits")
def contains_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.containment_pairs(*_sides(spark, sf_dir))


_OWN = f"""{_HITS}, own AS (SELECT doc_id AS page_id, item_id AS needle_id FROM documents JOIN benchmark ON item_id % 20 = doc_id % 20 OR item_id = doc_id),
  of_own AS (SELECT page_id, arg_min(needle_id, (-score, needle_id)) AS needle_id FROM hits JOIN own USING (page_id, needle_id) GROUP BY page_id),
  of_all AS (SELECT page_id, arg_min(needle_id, (-score, needle_id)) AS needle_id FROM hits WHERE page_id NOT IN (SELECT page_id FROM of_own) GROUP BY page_id)"""


@query(f"WITH {_OWN} SELECT page_id, needle_id, true AS own FROM of_own UNION ALL SELECT page_id, needle_id, false FROM of_all")
def own_scope_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own needles before all others, exact matches only; ``own``: whether one of its own was taken."""
    pages, needles = _sides(spark, sf_dir)
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"))
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    own = ids.join(items, F.col("needle_id") % 20 == F.col("page_id") % 20).unionByName(ids.join(items, F.col("needle_id") == F.col("page_id"))).distinct()
    found = lookup.lookup_cascade(pages, needles, own=own, approximate=False)
    return found.join(own.withColumn("own", F.lit(True)), ["page_id", "needle_id"], "left").select("page_id", "needle_id", F.coalesce("own", F.lit(False)).alias("own"))


_PART_ROWS = rf"parts AS (SELECT item_id, part, key, replace(key, ' ', '') AS solid FROM (SELECT item_id, part, {_sql_key('text')} AS key FROM (SELECT item_id, unnest(string_split(text, '.')) AS text, generate_subscripts(string_split(text, '.'), 1) AS part FROM benchmark)) WHERE key <> '')"


@query(
    f"""WITH {_PAGES}, {_PART_ROWS}, hits AS (SELECT doc_id, item_id, CASE WHEN contains(p.key, n.key) THEN length(n.key) ELSE length(n.solid) END AS score FROM pages_ p JOIN parts n
      ON contains(p.key, n.key) OR (length(n.solid) >= 12 AND contains(p.solid, n.solid))),
    wanted AS (SELECT item_id, count(*) AS n FROM parts GROUP BY item_id)
    SELECT h.doc_id AS page_id, h.item_id AS needle_id, CAST(sum(score) AS BIGINT) AS score FROM hits h JOIN wanted w USING (item_id) GROUP BY h.doc_id, h.item_id, w.n HAVING count(*) = w.n"""
)
def composite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("part", "text"))
    needles = lookup.forms(parts.withColumn("id", F.struct("item_id", "part")), "id", "text").filter("key <> ''").select("id.item_id", "id.part", "key", "solid").withColumnRenamed("item_id", "id")
    return lookup.composite_pairs(_sides(spark, sf_dir)[0], needles)


_DICE = f"""{_PAGES}, {_NEEDLES}, pw AS (SELECT doc_id, list_distinct(list_filter(string_split(key, ' '), lambda w: w <> '')) AS words FROM pages_),
  nw AS (SELECT item_id, list_distinct(list_filter(string_split(key, ' '), lambda w: w <> '')) AS words FROM needles WHERE key <> ''),
  pe AS (SELECT doc_id, len(words) AS n, unnest(words) AS w FROM pw), ne AS (SELECT item_id, len(words) AS n, unnest(words) AS w FROM nw),
  shared AS (SELECT doc_id, item_id, 2.0::DOUBLE * count(*) / (first(pe.n) + first(ne.n)) AS dice FROM pe JOIN ne USING (w) GROUP BY doc_id, item_id),
  every AS (SELECT d.doc_id, i.item_id, coalesce(s.dice, 0) AS dice FROM pw d CROSS JOIN nw i LEFT JOIN shared s ON s.doc_id = d.doc_id AND s.item_id = i.item_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, item_id) AS rank FROM every)"""


@query(f"WITH {_DICE} SELECT doc_id AS page_id, item_id AS needle_id, dice, rank FROM ranked WHERE rank <= 5")
def dice_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dice_shortlist(*_sides(spark, sf_dir))


@query()
def approx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.approx_lookup(*_sides(spark, sf_dir)).drop("near")


@query()
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_cascade(*_sides(spark, sf_dir))


@query("""WITH g AS (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS record FROM conversations WHERE role IN ('user', 'assistant'))
  SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS pos, md5(max(text) FILTER (WHERE role = 'user')) AS question_md5, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant')) AS answers_md5
  FROM g WHERE record > 0 GROUP BY conv_id, record HAVING count(*) FILTER (WHERE role = 'assistant' AND text <> '') > 0 AND max(text) FILTER (WHERE role = 'user') <> ''""")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    rows = turns.withColumn("opens", F.col("role") == "user").withColumn("record", F.count_if("opens").over(w)).filter("record > 0")
    pairs = extract.grouped_answers(rows, ["conv_id", "record"], "turn", "text")
    return pairs.select("conv_id", "pos", F.md5("question").alias("question_md5"), F.md5(F.array_join("answers", "\n")).alias("answers_md5"))


@query("SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' AND length(text) >= 60 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS context_md5 FROM conversations")
def preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = extract.preceding_context(rows, "conv_id", "turn", "text", (F.col("role") == "user") & (F.length("text") >= extract.SCENARIO_LENGTH))
    return found.select("conv_id", "turn", F.md5("context").alias("context_md5"))


@query(r"""WITH t AS MATERIALIZED (SELECT doc_id, unnest(r) AS w, generate_subscripts(r, 1) AS spot FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'tion', 'ti-on') ELSE text END, '')), '[\p{L}\p{N}_-]+') AS r FROM documents)),
  c AS MATERIALIZED (SELECT w, count(*) AS n, min((doc_id, spot)) AS place FROM t GROUP BY w),
  f AS MATERIALIZED (SELECT w, n, place, unnest(forms) AS form, generate_subscripts(forms, 1) AS nth FROM (SELECT w, n, place, regexp_extract_all(w, '[а-яёa-z]{2,}-[а-яёa-z]{2,}') AS forms FROM c WHERE contains(w, '-'))),
  o AS (SELECT replace(form, '-', '') AS joined, arg_min(form, (place, nth)) AS hyphenated FROM f GROUP BY 1),
  h AS (SELECT form, CAST(sum(CASE WHEN ends_with(w, form) THEN n ELSE 0 END) AS BIGINT) AS n_hyphen FROM f GROUP BY form)
  SELECT joined, hyphenated, c.n AS n_plain, n_hyphen FROM o JOIN c ON c.w = o.joined JOIN h ON h.form = o.hyphenated""")
def hyphen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second text has hyphens where a line might have been broken."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("tion"), F.lit("ti-on"))).otherwise(F.col("text")).alias("text"))
    return extract.hyphen_candidates(docs, "text", "doc_id")


@query(f"SELECT p_partkey, p_name FROM part WHERE contains({_sql_norm('p_name')}, {_sql_norm(chr(39) + 'RED' + chr(39))})")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").filter(T.norm("p_name").contains(T.norm(F.lit("RED")))).select("p_partkey", "p_name")


@query(rf"WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SP}+', ' ', 'g')) AS one FROM documents) SELECT doc_id, CASE WHEN length(one) <= 80 THEN one ELSE substr(one, 1, 79) || '…' END AS brief FROM t")
def brief_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.brief("text").alias("brief"))


@query("SELECT event_id, CASE WHEN contains(event_type, 'purchase') OR contains(event_type, 'error') THEN 'wrong' WHEN contains(event_type, 'view') THEN 'partial' WHEN contains(event_type, 'click') THEN 'correct' ELSE 'unknown' END AS status FROM events")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", T.status_of("event_type", "purchase|error", "view", "click").alias("status"))


@query("SELECT event_id, CASE WHEN coalesce(json_extract_string(props, '$.type'), '') <> '' THEN json_extract_string(props, '$.type') WHEN json_type(props) = 'OBJECT' THEN 'crossword' ELSE 'plain' END AS kind FROM events")
def record_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallgrass.functions import records

    events = read(spark, sf_dir, "events").withColumn("answer", F.try_parse_json("props"))
    return events.select("event_id", records.record_kind(F.get_json_object("props", "$.type"), F.col("answer")).alias("kind"))


@query('SELECT event_type AS "class", count(*) AS n FROM events GROUP BY 1')
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.class_histogram(read(spark, sf_dir, "events"), "event_type")


@query("""WITH f AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
  SELECT event_type AS verdict, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY k) FILTER (WHERE k <= 3) AS labels, greatest(count(*) - 3, 0) AS more FROM f GROUP BY 1""")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.verdict_rollup(read(spark, sf_dir, "events"), "event_type", "event_id", "event_id")


@query("SELECT user_id, CASE WHEN bool_and(value > 50) THEN 'all' WHEN bool_and(NOT value > 50) THEN 'none' ELSE 'mixed' END AS state FROM events GROUP BY user_id")
def all_none_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(rollup.overall_state(F.col("value") > 50).alias("state"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_link_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select("event_id", link.alias("k")).filter("k IS NOT NULL")


@query("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<li>')) AS n_items, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.link_count(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.control_groups(extract.page_controls(read(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS start FROM events)
  SELECT user_id AS key, arg_max(event_type, event_id) FILTER (WHERE start) AS answer, max(event_id) FILTER (WHERE start) AS ord, min(event_id) AS pos FROM r GROUP BY user_id""")
def capture_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_events(spark, sf_dir)


@query(f"""WITH {_HITS}, exact AS (SELECT page_id, arg_min(needle_id, (-score, needle_id)) AS needle_id FROM hits GROUP BY page_id),
  linked AS (SELECT doc_id AS page_id, item_id AS needle_id FROM documents JOIN benchmark ON item_id = doc_id // 10 WHERE doc_id % 10 = 0)
  SELECT page_id, needle_id, 'id' AS quality, false AS weak FROM linked
  UNION ALL SELECT page_id, needle_id, 'exact', false FROM exact WHERE page_id NOT IN (SELECT page_id FROM linked)
  UNION ALL SELECT page_id + 1, needle_id, 'context', true FROM exact WHERE page_id + 1 IN (SELECT doc_id FROM documents)
    AND page_id + 1 NOT IN (SELECT page_id FROM linked) AND page_id + 1 NOT IN (SELECT page_id FROM exact)""")
def cascade_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, exact, and by the document before as context; the approximate stage is in ``lookup_cascade``."""
    pages, needles = _sides(spark, sf_dir)
    links = read(spark, sf_dir, "documents").filter("doc_id % 10 = 0").selectExpr("doc_id AS page_id", "doc_id div 10 AS needle_id")
    return lookup.lookup_cascade(pages, needles, links, pages.withColumn("id", F.col("id") + 1), approximate=False)


@query("SELECT page_id, coalesce(try_cast(regexp_extract(url, '(\\d+)$', 1) AS BIGINT), 0) AS n FROM pages")
def item_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.item_number("url").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 100 BETWEEN 11 AND 14 THEN 'many' WHEN event_id % 10 = 1 THEN 'one' WHEN event_id % 10 BETWEEN 2 AND 4 THEN 'few' ELSE 'many' END AS form FROM events")
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", T.plural(F.col("event_id"), "one", "few", "many").alias("form"))


@query(f"SELECT item_id, md5(lower(regexp_replace(coalesce(text, ''), '{_SP}+', '', 'g'))) AS word_md5 FROM benchmark")
def crossword_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(T.crossword_word("text")).alias("word_md5"))


@query("SELECT p_partkey, trim(rtrim(p_name, ',')) AS bare, p_name AS unquoted FROM part")
def bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a closing ellipsis and commas, and in quotes, taken back."""
    parts = read(spark, sf_dir, "part")
    return parts.select("p_partkey", T.trim_ellipsis(F.concat("p_name", F.lit(",, …"))).alias("bare"), T.unquote(F.concat(F.lit(' "'), "p_name", F.lit('" '))).alias("unquoted"))


@query("""SELECT p_partkey, trim(trim(regexp_replace(left(t, 20), ' [^ ]*$', ''), ' .,;:—-–')) AS fragment
  FROM (SELECT p_partkey, trim(regexp_replace(replace(p_name || '... ' || p_type, '...', ' '), '\\s+', ' ', 'g')) AS t FROM part)""")
def scenario_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    return parts.select("p_partkey", T.scenario_fragment(F.concat_ws("... ", "p_name", "p_type"), 20).alias("fragment"))


@query(f"""SELECT conv_id, turn, CASE WHEN contains(n, '...') THEN len(p) END AS n_parts, CASE WHEN contains(n, '...') THEN md5(array_to_string(p, '|')) END AS parts_md5
  FROM (SELECT conv_id, turn, n, list_filter(list_transform(string_split(n, '...'), lambda x: trim(x)), lambda x: x <> '') AS p
    FROM (SELECT conv_id, turn, {_sql_norm("replace(text, '. ', '... ')")} AS n FROM conversations))""")
def parts_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.question_parts(F.replace("text", F.lit(". "), F.lit("... "))).alias("p"))
    return rows.select("conv_id", "turn", F.when(F.col("p").isNotNull(), F.size("p").cast("long")).alias("n_parts"), F.md5(F.array_join("p", "|")).alias("parts_md5"))


@query("SELECT item_id, CAST(greatest(4, floor(length(text) * 0.1 + 0.5)) AS INTEGER) AS edits FROM benchmark")
def edit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", T.max_distance(F.length("text")).alias("edits"))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  WHERE n = 1 OR event_type IS DISTINCT FROM before""")
def changed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_only(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


@query("SELECT d.doc_id AS page_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("problem_id"))
    return lookup.by_id_lookup(pages, read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "problem_id")).select("page_id", "quality", "toxic")


@query("""SELECT user_id AS page_id, event_type AS "group", event_id AS needle_id FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 DESC, value DESC NULLS LAST, event_id) AS n FROM events) WHERE n = 1""")
def group_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("user_id AS page_id", "event_type AS `group`", "event_id AS needle_id", "event_id % 3 AS rank", "value AS score")
    return lookup.best_of_groups(rows).select("page_id", "group", "needle_id")


@query("""WITH w AS (SELECT user_id AS place, event_id AS ord, CAST(event_id // 3 AS VARCHAR) AS card FROM events), c AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders)
  SELECT place, string_agg(id, ',' ORDER BY ord) AS ids FROM w LEFT JOIN c ON c.id = w.card GROUP BY place HAVING count(*) = count(id)""")
def card_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "events").selectExpr("user_id AS place", "event_id AS ord", "CAST(event_id div 3 AS STRING) AS card")
    cards = read(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "concat('order ', o_orderkey) AS text")
    return lookup.resolved_cards(wanted, cards).select("place", F.array_join("ids", ",").alias("ids"))


@query("""SELECT p_partkey % 50 AS grid, p_partkey AS entry, 'across' AS axis, w AS word, CAST(length(w) AS BIGINT) AS n_cells
  FROM (SELECT p_partkey, regexp_extract(p_name, '[a-z]+') AS w FROM part) WHERE w <> ''""")
def grid_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.regexp_extract("p_name", "[a-z]+", 0), "")).alias("x", "letter")).filter("letter <> ''")
    return extract.grid_words(names.selectExpr("p_partkey % 50 AS grid", "p_partkey AS entry", "x", "p_partkey AS y", "letter"))


@query("""WITH words AS (SELECT p_partkey AS ord, p_partkey % 50 AS grid, regexp_extract(p_name, '[a-z]+') AS w FROM part),
  cells AS (SELECT grid, ord, unnest(range(length(w))) AS x, unnest(string_split(w, '')) AS letter FROM words WHERE w <> ''),
  first AS (SELECT grid, x, arg_min(letter, ord) AS kept FROM cells GROUP BY grid, x)
  SELECT grid, ord, x, kept, letter FROM cells JOIN first USING (grid, x) WHERE letter <> kept""")
def grid_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("grid"), F.col("p_partkey").alias("ord"), F.lit(0).cast("long").alias("x"), F.lit(0).alias("y"), F.lit("across").alias("axis"), F.regexp_extract("p_name", "[a-z]+", 0).alias("word"))
    return extract.grid_conflicts(placed).select("grid", "ord", "x", "kept", "letter")


@query("SELECT conv_id, md5(arg_min(text, turn) || ' ... ' || arg_max(text, turn)) AS signature_md5 FROM conversations GROUP BY conv_id")
def end_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.signature(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("signature").alias("signature_md5"))


@query("SELECT user_id AS i, min(event_type) AS question, md5(string_agg(props, '|' ORDER BY event_id)) AS answers_md5 FROM events GROUP BY user_id")
def assembled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    crops = events.select(F.col("user_id").alias("i"), F.col("event_id").cast("string").alias("k"), F.col("event_type").alias("question"))
    told = events.select(F.concat_ws("_", "user_id", "event_id").alias("name"), F.col("props").alias("text"))
    return extract.assembled(crops, told).select("i", "question", F.md5(F.array_join("answers", "|")).alias("answers_md5"))


@query("SELECT CAST(sum(event_id % 3) AS BIGINT) AS added, CAST(sum(event_id % 5) AS BIGINT) AS updated, arg_max(user_id, event_id) AS total FROM events")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals(read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 3 AS added", "event_id % 5 AS updated", "user_id AS total"), "event_id")


@query("SELECT event_type, min(value) AS similarity FROM events GROUP BY event_type")
def weakest_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.weakest(read(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT conv_id, bool_and(coalesce(text, '') <> '') AS filled FROM conversations GROUP BY conv_id")
def filled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(rollup.all_filled(F.col("text")).alias("filled"))


@query("""WITH s AS (SELECT *, count(*) FILTER (WHERE role = 'user' AND length(text) >= 200) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM conversations)
  SELECT conv_id, turn, md5(right(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id, span ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 300)) AS context_md5 FROM s""")
def gathered_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.gathered_context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", (F.col("role") == "user") & (F.length("text") >= 200), 300)
    return found.select("conv_id", "turn", F.md5("context").alias("context_md5"))


@query("""WITH g AS (SELECT user_id AS page_id, count(*) AS total, count(*) FILTER (WHERE event_id % 3 <> 0) AS matched, bool_or(event_id % 3 <> 0 AND event_id % 4 = 0) AS approx,
    min(value) FILTER (WHERE event_id % 3 <> 0 AND event_id % 4 = 0) AS similarity FROM events GROUP BY 1),
  p AS (SELECT p_partkey AS page_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS hit, p_size % 3 AS n, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN p_size % 4 END AS size,
    CASE p_partkey % 5 WHEN 0 THEN 'crossword' WHEN 1 THEN 'matching' ELSE 'plain' END AS kind, p_partkey % 3 = 0 AS near, CAST(p_size AS DOUBLE) AS own FROM part),
  m AS (SELECT p.*, coalesce(total, 0) AS g_total, coalesce(matched, 0) AS g_matched, coalesce(approx, false) AS g_approx, similarity AS g_similarity,
    CASE WHEN kind <> 'plain' THEN kind WHEN n > 0 AND size = n THEN 'positional' WHEN coalesce(total, 0) <= 1 THEN 'single' ELSE 'groups' END AS mode FROM p LEFT JOIN g USING (page_id)),
  r AS (SELECT page_id, mode, mode IN ('positional', 'single') AS one, hit IS NOT NULL AND (g_total > 0 OR n > 0) AS got, * EXCLUDE (page_id, mode) FROM m),
  f AS (SELECT page_id, mode, CASE WHEN one THEN CAST(got AS BIGINT) ELSE g_matched END AS matched, CASE WHEN one THEN 1 ELSE g_total END AS total,
    CASE WHEN one THEN got AND near ELSE g_approx END AS approx, CASE WHEN NOT one THEN g_similarity WHEN got AND near THEN own END AS similarity FROM r)
  SELECT *, matched > 0 AND matched = total AND NOT approx AS usable FROM f""")
def page_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages; the events of the user with a part's number as its groups."""
    groups = read(spark, sf_dir, "events").selectExpr("user_id AS page_id", "event_id", "value", "event_id % 3 <> 0 AS hit", "event_id % 3 <> 0 AND event_id % 4 = 0 AS near")
    groups = groups.selectExpr("page_id", "CASE WHEN hit THEN event_id END AS needle_id", "CASE WHEN near THEN 'approx' WHEN hit THEN 'exact' END AS quality", "CASE WHEN near THEN value END AS similarity")
    pages = read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS page_id",
        "CASE p_partkey % 5 WHEN 0 THEN 'crossword' WHEN 1 THEN 'matching' ELSE 'plain' END AS kind",
        "CASE WHEN p_partkey % 2 = 0 THEN p_size % 4 END AS answer_size",
        "p_size % 3 AS n_controls",
        "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS needle_id",
        "CASE WHEN p_partkey % 3 = 0 THEN 'approx' ELSE 'exact' END AS quality",
        "CAST(p_size AS DOUBLE) AS similarity",
    )
    return lookup.page_plans(pages, groups)


@query("""SELECT p_partkey, kind, name, first_pos, CAST(n AS BIGINT) AS n, CAST(filled AS BIGINT) AS filled FROM part, (VALUES ('label', 'brand', 0, 1, 1), ('radio', 'brand', 1, 2, 1), ('select', 'kind', 3, 1, 0), ('option', '', 4, 2, 1)) AS c(kind, name, first_pos, n, filled)""")
def form_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of a form made for each part: ``page_controls`` on pages that have some."""
    form = F.format_string("<form><label for=\"brand\">%s</label><input type=radio name=brand value=\"%s\"><INPUT type='radio' name='brand'><select name=kind><option value=''>none</option><option>%s</option></select></form>", "p_name", F.col("p_size").cast("string"), "p_type")
    pages = read(spark, sf_dir, "part").select("p_partkey", form.alias("html"))
    return extract.control_groups(extract.page_controls(pages, "p_partkey", "html"), "p_partkey")


@query("""SELECT p_partkey, 'p' || p_partkey AS problem_id, q.* FROM part, LATERAL (VALUES
    ('About ' || p_name, to_json(p_brand)), ('Kind of ' || p_name, to_json(p_type)), ('Kind of ' || p_name || ' none ' || p_type || ' Sizes', to_json(CAST(p_size AS VARCHAR)))) AS q(question, answer)""")
def harvested_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records harvested from a filled-in form made for each part: ticked, chosen from a list, typed in."""
    form = F.format_string(
        """<div data-problem-id="p%s"><h2>Part</h2><div class="problem"><p>About  %s</p><label><input type=radio name=brand>other</label><label><input type="radio" name=brand checked> <b>%s</b></label>
        <label for="k">Kind of %s</label><select id="k"><option>none<option selected>%s</select><p>Sizes</p><input type=text value=" %s"><input type=text value=""></div></div>""",
        *[F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_brand", "p_name", "p_type", "p_size")],
    )
    # Few bytes a part but a page of work, so tasks are not left to the size of the file: parts are dealt out before their forms are made.
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = harvest.harvest_records(parts.select("p_partkey", form.alias("html")), "p_partkey", "html")
    return found.select(F.col("page").alias("p_partkey"), "problem_id", "question", "answer")


@query("WITH i AS (SELECT DISTINCT user_id FROM events WHERE event_id % 7 <> 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_id % 7 = 0) SELECT count(*) AS replaced FROM b WHERE user_id IN (SELECT user_id FROM i WHERE user_id IS NOT NULL)")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("answer"))
    return merge.replaced_count(_last_by_user(events.filter("ord % 7 = 0")), _last_by_user(events.filter("ord % 7 <> 0")), "key")


@query('SELECT p_brand AS "class", count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10')
def leading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first rows: the limit is its purpose."""
    return rollup.leading(rollup.class_histogram(read(spark, sf_dir, "part"), "p_brand"), "n", "class", 10)


@query("SELECT event_id, len(json_keys(props)) || ' fields' AS brief FROM events")
def answers_in_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", records.answer_brief(F.try_parse_json("props")).alias("brief"))
