"""Exact medians without a buffer of all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks are first known to one part in so many; of the values, about six such parts around the middle are looked at one by one.
ACCURACY = 10_000


def medians(df: DataFrame, value: Column, by: dict[str, Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(*by, n, median) of the values that aren't null: the middle one, or the mean of the two in the middle.

    A first pass finds, in bounded memory, a band that holds the middle ranks: its ends are off by less than ``accuracy`` tells.
    A second pass counts what lies below the band, and each distinct value in it; ranks then pick the value. Null groups
    are groups; a group without values gives no row."""
    by = by or {}
    names = [f"k{i}" for i in range(len(by))]
    v = df.select(*(c.alias(n) for c, n in zip(by.values(), names)), value.cast("double").alias("v")).filter("v IS NOT NULL")
    around = 3 / accuracy
    ends = F.percentile_approx("v", [max(0.0, 0.5 - around), min(1.0, 0.5 + around)], accuracy)
    bands = v.groupBy(*names).agg(F.count("*").alias("n"), ends.alias("ends")).toDF(*(f"b{i}" for i in range(len(by))), "n", "ends")
    same = F.lit(True)
    for i in range(len(by)):
        same = same & F.col(f"k{i}").eqNullSafe(F.col(f"b{i}"))
    met = v.join(bands if by else F.broadcast(bands), same).filter(F.col("v") <= F.col("ends")[1])
    counts = met.groupBy(*names, "n", F.when(F.col("v") >= F.col("ends")[0], F.col("v")).alias("v")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*names).orderBy(F.asc_nulls_first("v")))
    ranked = counts.withColumn("upto", upto)
    holds = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank), F.col("v")))
    found = ranked.groupBy(*names, "n").agg((holds(F.expr("(n - 1) div 2 + 1")) * 0.5 + holds(F.expr("n div 2 + 1")) * 0.5).alias("median"))
    return found.toDF(*by, "n", "median")
