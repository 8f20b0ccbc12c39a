"""Ordered upsert of a change set into a base, without a sequential fold.

Rows of a key are taken base first, then changes in order. A run is a stretch of equal answers. The state at the end is
the row that begins the last run; a link field is its last value at the beginning of a run, or else the first value
of all. Counts follow from the same runs. One shuffle, by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _marked(base: DataFrame, changes: DataFrame, key_col: str, order_col: str, answer_col: str, links: Sequence[str]) -> DataFrame:
    """All rows that take part, with ``start`` (begins a run), ``fills`` (gives a link field its first value) and ``nth``."""
    rows = base.withColumn("src", F.lit(0)).unionByName(changes.withColumn("src", F.lit(1)))
    w = Window.partitionBy(key_col).orderBy("src", order_col)
    last_base = F.max(F.when(F.col("src") == 0, F.col(order_col))).over(Window.partitionBy(key_col))
    taking = rows.withColumn("last_base", last_base).filter((F.col("src") == 1) | (F.col(order_col) == F.col("last_base")))
    out = taking.withColumn("nth", F.row_number().over(w)).withColumn("start", (F.col("nth") == 1) | ~F.col(answer_col).eqNullSafe(F.lag(answer_col).over(w)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fills = F.lit(False)
    for c in links:
        has = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        had = F.coalesce(F.max(has).over(before), F.lit(False))
        fills = fills | (has & ~had)
    return out.withColumn("fills", fills & ~F.col("start"))


def ordered_merge(base: DataFrame, changes: DataFrame, key_col: str, order_col: str, answer_col: str, links: Sequence[str] = ()) -> DataFrame:
    """The base after all changes: a row per key, with its columns and ``is_new``, ``pos``, ``n_updates``, ``n_same``.

    ``pos``: order of the base row, or of the key's first change. Base rows that an equal key follows in the base pass
    through unchanged and are not in this result; ``superseded`` has them.
    """
    rows = _marked(base, changes, key_col, order_col, answer_col, links)
    place = F.struct("src", order_col)
    at_start = F.when(F.col("start"), place)
    fields = [F.max_by(c, at_start).alias(c) for c in base.columns if c not in (key_col, *links)]
    for c in links:
        has = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        fields.append(F.coalesce(F.max_by(c, F.when(has & F.col("start"), place)), F.min_by(c, F.when(has, place))).alias(c))
    later = F.col("nth") > 1
    updates = F.count_if(later & (F.col("start") | F.col("fills"))).alias("n_updates")
    same = F.count_if(later & ~F.col("start") & ~F.col("fills")).alias("n_same")
    return rows.groupBy(key_col).agg(*fields, (F.min("src") == 1).alias("is_new"), F.min_by(order_col, place).alias("pos"), updates, same)


def superseded(base: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """Base rows that a later row of the base with the same key hides from merging."""
    w = Window.partitionBy(key_col)
    return base.withColumn("last", F.max(order_col).over(w)).filter(F.col(order_col) < F.col("last")).drop("last")


def merge_report(merged: DataFrame) -> DataFrame:
    """One row: keys added, updates and repeats of the change set, records at the end."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return merged.agg(F.count_if("is_new").alias("added"), total("n_updates").alias("updated"), total("n_same").alias("same"), F.count("*").alias("total"))


def merge_totals(merged: DataFrame, base: DataFrame, dropped: DataFrame) -> DataFrame:
    """The report of a whole merge: as ``merge_report``, with ``empty`` (rows of the change set that were ``dropped`` as blank), ``before`` and ``after``.

    ``before`` counts all rows of the base, hidden ones too; only added keys make it longer.
    """
    counts = merge_report(merged).drop("total")
    whole = base.agg(F.count("*").alias("before")).crossJoin(dropped.agg(F.count("*").alias("empty")))  # a row each
    return counts.crossJoin(whole).select("added", "updated", "same", "empty", "before", (F.col("before") + F.col("added")).alias("after"))


def append_new(base: DataFrame, incoming: DataFrame, key_col: str) -> DataFrame:
    """The base, and the incoming rows whose key it lacks."""
    return base.unionByName(incoming.join(base.select(key_col), key_col, "left_anti").select(base.columns))


def replaced_count(base: DataFrame, incoming: DataFrame, key_col: str) -> DataFrame:
    """One row, ``replaced``: rows of the base that ``refresh`` gives a new content."""
    return base.join(incoming.select(key_col), key_col, "left_semi").agg(F.count("*").alias("replaced"))


def refresh(base:DataFrame, incoming: DataFrame, key_col: str) -> DataFrame:
    """The base with matching rows replaced whole by incoming ones (keys of ``incoming`` are unique), and the new rows."""
    fresh = incoming.select(key_col, F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("fresh"))
    rows = base.select(key_col, F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("old"))
    return rows.join(fresh, key_col, "full").select(F.coalesce("fresh", "old").alias("row")).select("row.*")
