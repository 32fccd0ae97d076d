"""Joins into nested documents, alternatives within a product, and invariants of keys and amounts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.unicode import nfd


def nest(df: DataFrame, key: str, fields: Sequence[str], out: str) -> DataFrame:
    """(key, out): the rows of each key as an array of structs, ordered by the fields in turn.

    Gather each 1:n side like this before joining it; joining first would multiply the rows of the other sides.
    """
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def and_more(first: Column, n: Column) -> Column:
    """Name of the first line, and how many more there are."""
    return F.concat(first, F.when(n > 1, F.concat(F.lit(" 외 "), (n - 1).cast("string"), F.lit("건"))).otherwise(""))


def alternatives(df: DataFrame, product: Sequence[str], key: str, available: Column) -> DataFrame:
    """(key, choices, first): for each row with any, how many other available rows its product has, and the least.

    The two least available keys of a product are enough to name the least other one.
    """
    some = df.filter(available)
    low = some.groupBy(*product).agg(F.count("*").alias("_n"), F.min(key).alias("_low"))
    second = some.join(low, list(product)).filter(F.col(key) > F.col("_low")).groupBy(*product).agg(F.min(key).alias("_next"))
    counted = df.select(*product, key, available.alias("_own")).join(low, list(product)).join(second, list(product), "left")
    choices = F.col("_n") - F.col("_own").cast("long")
    first = F.when(F.col(key) == F.col("_low"), F.col("_next")).otherwise(F.col("_low"))
    return counted.select(key, choices.alias("choices"), first.alias("first")).filter("choices > 0")


def dangling(df: DataFrame, key: str, of: DataFrame, primary: str) -> DataFrame:
    """Rows whose foreign key leads nowhere; a null key leads to nothing and is none of them."""
    return df.filter(F.col(key).isNotNull()).join(of.select(F.col(primary).alias("_of")), F.col(key) == F.col("_of"), "left_anti")


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).count().filter("count > 1").select(*key)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, keys) of named tables of one column, zero counts included."""
    parts = [rows.agg(F.count("*").alias("violations"), F.count_distinct(rows.columns[0]).alias("keys")).select(F.lit(name).alias("check"), "violations", "keys") for name, rows in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def _shorter(words: Column) -> Column:
    """All words of an array with one letter left out."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), cut))


def near_names(people: DataFrame, key: str, group: str, name: str, most: int = 2) -> DataFrame:
    """(key, other, distance): ordered pairs of one group whose names, spaces aside, differ by ``most`` edits of letters at
    most. Syllables count as their letters.

    Names that near share what is left of both when up to ``most`` letters are taken out of each, so candidates come from
    an equality join on such rests, not from all pairs of a group; a name has about length ** most / 2 of them. Equal names of a
    group meet as one, and only names that are near are given back their rows, so what a task holds grows with the names, not
    with the pairs of rows.
    """
    slim = people.select(key, group, nfd(F.regexp_replace(name, r"\s+", "")).alias("letters")).filter("letters IS NOT NULL").distinct()
    rests, last = F.array("letters"), F.array("letters")
    for _ in range(most):
        last = F.array_distinct(_shorter(last))
        rests = F.concat(rests, last)
    # as a row of its own, so that the rests are worked out once
    each = slim.select(group, "letters").distinct().select(group, "letters", F.explode(F.array_distinct(rests)).alias("rest"))
    one, two = (each.select(F.col(group), F.col("letters").alias(side), "rest") for side in ("_one", "_two"))
    pairs = one.join(two, [group, "rest"]).select(group, "_one", "_two").distinct()
    near = pairs.withColumn("distance", F.levenshtein("_one", "_two", most)).filter("distance >= 0")
    left, right = (slim.select(F.col(key).alias(k), F.col(group), F.col("letters").alias(side)) for k, side in (("_key", "_one"), ("_other", "_two")))
    met = left.join(near, [group, "_one"]).join(right, [group, "_two"]).filter("_key <> _other")
    return met.select(F.col("_key").alias(key), F.col("_other").alias("other"), "distance")
