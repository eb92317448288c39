"""Gapless numbers in the order of a key, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, out: str, bins: int = 256) -> DataFrame:
    """Adds ``out``: 1, 2, ... by ``order``, a column of numbers without nulls or repeats.

    Values fall into ranges cut at approximate quantiles; rows are numbered inside their range and moved on by the rows of all
    earlier ranges, a table of at most ``bins`` rows.
    """
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(order, [i / bins for i in range(1, bins)], 10_000))).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return inside.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + F.col("_i")).drop("_part", "_p", "_before", "_i")
