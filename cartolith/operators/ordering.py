"""Ranks over whole tables without pulling them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartolith.session import materialise

_POSITION_BITS = 33


def with_global_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number rows 1..n in an order: range-partition, sort each part, add the sizes before it.

    Only one row per partition is ever brought together. The sorted parts are written once,
    so that numbers and offsets come from the same partitioning.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(parts.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(F.col("_at"), _POSITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (placed.withColumn("_part", part).join(offsets, "_part")
            .withColumn(out, F.col("_before") + position + 1).select(*df.columns, out))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in an order; partial minima before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, out: str = "position") -> DataFrame:
    """The first ``limit`` rows of each key, numbered."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= limit)
