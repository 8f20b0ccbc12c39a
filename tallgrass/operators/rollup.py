"""Counts and rollups for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORT_ROWS = 40


def class_histogram(rows: DataFrame, class_col: str) -> DataFrame:
    """``class`` and ``n``, most frequent first."""
    return rows.groupBy(F.col(class_col).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def verdict_rollup(rows: DataFrame, verdict_col: str, label_col: str, order_col: str, shown: int = 3, verdicts: Sequence[str] = ()) -> DataFrame:
    """Per verdict: how many, the labels of its first rows, and how many more there are.

    Verdicts come in the order of ``verdicts``; others follow by name.
    """
    counts = rows.groupBy(F.col(verdict_col).alias("verdict")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("verdict").orderBy("o")
    first = rows.select(F.col(verdict_col).alias("verdict"), F.col(order_col).alias("o"), F.col(label_col).cast("string").alias("label")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= shown)
    labels = first.groupBy("verdict").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda r: r["label"]), ", ").alias("labels"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, verdicts)).cast("array<string>"), F.col("verdict").cast("string")), F.lit(0)), F.lit(len(verdicts) + 1))
    return counts.join(labels, "verdict").orderBy(place, "verdict").select("verdict", "n", "labels", F.greatest(F.col("n") - shown, F.lit(0)).alias("more"))


def overall_state(flags: Column) -> Column:
    """``all``, ``none`` or ``mixed`` of a boolean over a group; null for no rows."""
    return F.when(F.bool_and(flags), "all").when(F.bool_and(~flags), "none").when(F.count(flags) > 0, "mixed")


def totals(reports: DataFrame, order_col: str) -> DataFrame:
    """Sums of ``added`` and ``updated``, and the last ``total``."""
    return reports.agg(F.sum("added").alias("added"), F.sum("updated").alias("updated"), F.max_by("total", order_col).alias("total"))


def weakest(rows: DataFrame, group_col: str, similarity_col: str) -> DataFrame:
    return rows.groupBy(group_col).agg(F.min(similarity_col).alias("similarity"))


def all_filled(values: Column) -> Column:
    """Whether a group of values has at least one, and none is blank."""
    return F.coalesce(F.bool_and(F.coalesce(values, F.lit("")) != ""), F.lit(False))


def leading(rows: DataFrame, count_col: str, tie_col: str, most: int = REPORT_ROWS) -> DataFrame:
    """The first rows of a report: largest counts first, ties by ``tie_col``."""
    return rows.orderBy(F.desc(count_col), tie_col).limit(most)
