"""Keyed dedupe of ordered records: of equal keys the last record wins.

Every operator shuffles once, by key, and keeps order in an explicit column. A key of very many records is summed up
before the shuffle wherever only one record of it is kept (``max_by``), so it is no single task's work there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.scan import After, Count, Number, scan


def _all_of(df: DataFrame, alias: str = "rec") -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias)


def dedupe_last(records: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """The last record of each key, with ``pos``: the order of the key's first record. Blank keys are dropped."""
    keyed = records.filter((F.col(key_col) != "") & F.col(key_col).isNotNull())
    best = keyed.groupBy(key_col).agg(F.max_by(_all_of(records), order_col).alias("rec"), F.min(order_col).alias("pos"))
    return best.select("rec.*", "pos")


def replaced_pairs(records: DataFrame, key_col: str, order_col: str, spread: bool = False) -> DataFrame:
    """Each record that a later one of its key replaces, as (``key``, ``dropped``, ``kept``): the orders of both.

    ``spread``, here and below: a key's records are read by several tasks (``operators.scan``).
    """
    keyed = records.filter((F.col(key_col) != "") & F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(order_col).alias("dropped"))
    return scan(keyed, ["key"], "dropped", spread, kept=After("dropped")).filter("kept IS NOT NULL")


def clashes(records: DataFrame, key_col: str, order_col: str, form_col: str, spread: bool = False) -> DataFrame:
    """The replaced pairs whose answers differ."""
    keyed = records.filter((F.col(key_col) != "") & F.col(key_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(order_col).alias("dropped"), F.col(form_col).alias("old"))
    pairs = scan(keyed, ["key"], "dropped", spread, kept=After("dropped"), new=After("old")).select("key", "dropped", "kept", "old", "new")
    return pairs.filter("kept IS NOT NULL AND NOT (old <=> new)")


def dedupe_in_place(records: DataFrame, key_col: str, order_col: str, carried: Sequence[str] = ()) -> DataFrame:
    """The last record of each key, at its own place; blank ``carried`` fields come from the key's first record that has them.

    Records with an empty key count as one key.
    """
    filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order_col))).alias(f"carry_{c}") for c in carried]
    best = records.groupBy(F.coalesce(key_col, F.lit("")).alias("group_key")).agg(F.max_by(_all_of(records), order_col).alias("rec"), *filled)
    fields = [F.when(F.col(f"rec.{c}").isNull() | (F.col(f"rec.{c}").cast("string") == ""), F.col(f"carry_{c}")).otherwise(F.col(f"rec.{c}")).alias(c) if c in carried else F.col(f"rec.{c}") for c in records.columns]
    return best.select(*fields)


def duplicate_groups(records: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """``key``, ``places`` (orders, ascending) and ``n`` of the keys that occur more than once: an array a key.

    Where a key may have very many records, ``ordinals`` has the same as rows.
    """
    groups = records.groupBy(F.col(key_col).alias("key")).agg(F.array_sort(F.collect_list(order_col)).alias("places"))
    return groups.withColumn("n", F.size("places").cast("long")).filter("n > 1")


def surplus(records: DataFrame, key_col: str) -> DataFrame:
    """One row: groups of equal keys, records beyond the first of each, and records that would stay."""
    counts = records.groupBy(key_col).agg(F.count("*").alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"), F.count("*").alias("stay"))


def ordinals(records: DataFrame, key_col: str, order_col: str, spread: bool = False) -> DataFrame:
    """``records`` with ``k`` of ``n`` within the key, and ``keep``: whether it is the last."""
    return scan(records, [key_col], order_col, spread, k=Number(), n=Count()).withColumn("keep", F.col("k") == F.col("n"))


def double_keys(records: DataFrame, key_col: str) -> DataFrame:
    """The records whose key, not blank, occurs more than once."""
    often = records.filter(F.col(key_col) != "").groupBy(key_col).agg(F.count("*").alias("n")).filter("n > 1").select(key_col)
    return records.join(often, key_col, "left_semi")


def ambiguous_keys(records: DataFrame, key_col: str, form_col: str) -> DataFrame:
    """Keys with more than one different answer, and how many."""
    return records.groupBy(F.col(key_col).alias("key")).agg(F.count_distinct(form_col).alias("answers")).filter("answers > 1")


def key_audit(records: DataFrame, key_col: str) -> DataFrame:
    """One row: records, different keys, records with an empty key."""
    keys = records.groupBy(key_col).agg(F.count("*").alias("n"))
    blank = F.col(key_col).isNull() | (F.col(key_col) == "")
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(~blank).alias("keys"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("empty"))
