"""Positions in a total order without a window that gathers a group: rows are sorted by ranges, each range counts its own rows, and
only one figure a range is summed in order. A hot group is spread over as many ranges as it needs.

Nulls come where the order puts them; equal rows get positions next to each other; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their position in the order, from 0."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of this id count the rows of a partition; the rows are kept, so the figures can't change
    numbered = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_r")))
    per = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = per.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_r")).drop("_part", "_r", "_before")


def ranks(rows: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their rank within each group, from 1."""
    placed = positions(rows, [F.col(by), *order], "_p")
    first = placed.groupBy(by).agg(F.min("_p").alias("_first"))
    return placed.join(first, by).withColumn(name, (F.col("_p") - F.col("_first") + 1).cast("int")).drop("_p", "_first")
