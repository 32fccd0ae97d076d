"""Whether two runs may be compared, how a rerun lines up with its record, and bounds on plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settings_apart(base: DataFrame, other: DataFrame, name: str, value: str, default: str) -> DataFrame:
    """(name, base, other): settings in which two runs differ; one that a run lacks has its default there."""
    a, b = (df.select(name, F.col(value).alias(side)) for df, side in ((base, "base"), (other, "other")))
    both = a.join(b, name, "full_outer").na.fill(default, ["base", "other"])
    return both.filter(~F.col("base").eqNullSafe(F.col("other")))


def axes_apart(differing: DataFrame, name: str, known: Sequence[str]) -> DataFrame:
    """Differing settings with ``known``: whether a device is registered for them. An unknown one forbids comparing."""
    return differing.withColumn("known", F.col(name).isin(*known))


def uneven_trials(base: DataFrame, other: DataFrame, task: str) -> DataFrame:
    """(task, base, other): tasks that two runs didn't try equally often; 0 where a run has none. No rows: they pair."""
    a, b = (df.groupBy(task).agg(F.count("*").alias(side)) for df, side in ((base, "base"), (other, "other")))
    return a.join(b, task, "full_outer").na.fill(0, ["base", "other"]).filter("base <> other")


def aligned(rerun: DataFrame, record: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows of a rerun with ``recorded`` (the record has the key) and ``same`` (all fields agree, nulls too)."""
    there = record.select(*key, *(F.col(f).alias(f"_was_{f}") for f in fields), F.lit(True).alias("recorded"))
    both = rerun.join(there, list(key), "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_was_{f}"))
    kept = both.withColumn("recorded", F.coalesce("recorded", F.lit(False)))
    return kept.withColumn("same", F.col("recorded") & same).drop(*(f"_was_{f}" for f in fields))


def gate(df: DataFrame, bounds: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(check, value, passed): aggregates and whether each lies within its bounds, in one pass; null fails."""
    found = df.agg(*(v.cast("double").alias(f"_{k}") for k, (v, _, _) in bounds.items()))
    rows = [
        F.struct(F.lit(k).alias("check"), F.col(f"_{k}").alias("value"), F.coalesce(F.col(f"_{k}").between(low, high), F.lit(False)).alias("passed"))
        for k, (_, low, high) in bounds.items()
    ]
    return found.select(F.inline(F.array(*rows)))
