"""Ordered scans of keys that may be very large.

A window over a key reads all of it in one task. Here rows are dealt by range of key and order, so a large key lies in
several neighbouring partitions. Each part of a key is scanned by itself, and is summed up in one row: how many rows, the
first and last values. A second scan over these few rows gives what every part has to carry on from the parts before and
after it. Only keys that cross a border between partitions have something to carry, at most two parts a border, so the
carried rows are fewer than twice the partitions and are broadcast.

It costs a second shuffle, so it is for keys that one task can't read. Null keys are one key, as in a window. Rows with
equal keys and orders lie in one partition and come in any order there, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.sources.shared import checkpointed


@dataclass(frozen=True)
class Number:
    """The row's number within its key, from 1."""


@dataclass(frozen=True)
class Count:
    """How many rows the key has."""


@dataclass(frozen=True)
class Before:
    """The column's value in the row before; null in the first."""

    column: str


@dataclass(frozen=True)
class After:
    """The column's value in the row after; null in the last."""

    column: str


@dataclass(frozen=True)
class Latest:
    """The column's last value that is not null, up to this row."""

    column: str


@dataclass(frozen=True)
class Starts:
    """Whether the row begins a run: it is the first, or the column's value is another than before."""

    column: str


Step = Number | Count | Before | After | Latest | Starts


def scanned(rows: DataFrame, keys: Sequence[str], order: str, **steps: Step) -> DataFrame:
    """``rows`` with a column for each of ``steps``, by one window over each key."""
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(order)
    out = {}
    for name, step in steps.items():
        match step:
            case Number():
                out[name] = F.row_number().over(ordered).cast("long")
            case Count():
                out[name] = F.count("*").over(w)
            case Before(c):
                out[name] = F.lag(c).over(ordered)
            case After(c):
                out[name] = F.lead(c).over(ordered)
            case Latest(c):
                out[name] = F.last(c, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
            case Starts(c):
                out[name] = (F.row_number().over(ordered) == 1) | ~F.col(c).eqNullSafe(F.lag(c).over(ordered))
    return rows.select("*", *[c.alias(n) for n, c in out.items()])


def spread_scan(rows: DataFrame, keys: Sequence[str], order: str, partitions: int | None = None, **steps: Step) -> DataFrame:
    """The columns of ``scanned``, with every key spread over as many tasks as it fills partitions."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = sorted({s.column for s in steps.values() if hasattr(s, "column")})
    dealt = checkpointed(rows.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()))
    row = F.struct(*[F.col(c) for c in used], F.lit(True).alias("_there"))
    parts = dealt.groupBy(*keys, "_part").agg(
        F.count("*").alias("_n"),
        F.min_by(row, F.struct(order)).alias("_first"),
        F.max_by(row, F.struct(order)).alias("_last"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order))).alias(f"_latest_{c}") for c in used],
    )
    of_key = Window.partitionBy(*keys)
    by_part = of_key.orderBy("_part")
    upto = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *keys,
        "_part",
        F.count("*").over(of_key).alias("_parts"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_rows_before"),
        F.sum("_n").over(of_key).alias("_rows"),
        F.lag("_last").over(by_part).alias("_before"),
        F.lead("_first").over(by_part).alias("_after"),
        *[F.last(f"_latest_{c}", ignorenulls=True).over(upto).alias(f"_latest_{c}") for c in used],
    )
    carried = F.broadcast(carried.filter("_parts > 1"))  # fewer than two rows a partition
    same = F.lit(True)
    for c in (*keys, "_part"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rest = [c for c in carried.columns if c not in (*keys, "_part")]
    joined = dealt.alias("l").join(carried.alias("r"), same, "left").select("l.*", *[F.col(f"r.{c}").alias(c) for c in rest])

    w = Window.partitionBy(*keys, "_part")
    ordered = w.orderBy(order)
    nth, size = F.row_number().over(ordered), F.count("*").over(w)
    whole = joined.withColumns({"_nth": nth, "_size": size})

    def before(c: str) -> Column:
        return F.when(F.col("_nth") == 1, F.col(f"_before.{c}")).otherwise(F.lag(c).over(ordered))

    out = {}
    number = F.col("_nth") + F.coalesce("_rows_before", F.lit(0))
    for name, step in steps.items():
        match step:
            case Number():
                out[name] = number.cast("long")
            case Count():
                out[name] = F.coalesce("_rows", "_size").cast("long")
            case Before(c):
                out[name] = before(c)
            case After(c):
                out[name] = F.when(F.col("_nth") == F.col("_size"), F.col(f"_after.{c}")).otherwise(F.lead(c).over(ordered))
            case Latest(c):
                out[name] = F.coalesce(F.last(c, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_latest_{c}"))
            case Starts(c):
                out[name] = (number == 1) | ~F.col(c).eqNullSafe(before(c))
    return whole.select(*[F.col(f"`{c}`") for c in rows.columns], *[c.alias(n) for n, c in out.items()])


def scan(rows: DataFrame, keys: Sequence[str], order: str, spread: bool = False, **steps: Step) -> DataFrame:
    """``spread_scan`` or ``scanned``."""
    return (spread_scan if spread else scanned)(rows, keys, order, **steps)
