"""State of tables as data: plain dumps, set and bag differences, equality, fingerprints, stitching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def plain(name: str, kind: T.DataType) -> Column:
    """A column as comparable plain value: times as ISO seconds in UTC, dates as ISO dates, the rest unchanged. Floating
    numbers have no plain value that compares as it should, and are refused."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError(f"{name}: a floating number is no plain value")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(name)
    if isinstance(kind, T.DateType):
        return F.date_format(name, "yyyy-MM-dd").alias(name)
    return F.col(name)


def dump(df: DataFrame, key: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """All columns but the ignored ones, as plain values, in key order (binary, so by code point)."""
    return df.select(*(plain(f.name, f.dataType) for f in df.schema if f.name not in ignored)).orderBy(*key)


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(side, *columns): distinct rows that only one side has. Nulls equal nulls. One shuffle of both."""
    columns = expected.columns
    marked = expected.select("*", F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(actual.select("*", F.lit(0).alias("_e"), F.lit(1).alias("_a")))
    sides = marked.groupBy(*columns).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a")).filter("_e <> _a")
    return sides.select(F.when(F.col("_e") == 1, "only_expected").otherwise("only_actual").alias("side"), *columns)


def equality(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (name, equal): whether both hold the same rows, each as often."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    uneven = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return uneven.agg((F.count("*") == 0).alias("equal")).select(F.lit(name).alias("name"), "equal")


def surplus(done: DataFrame, gold: DataFrame) -> DataFrame:
    """(*columns, surplus): rows of ``done`` that occur more often than in ``gold``, and how much more.

    Counts are aggregated before anything is shuffled, so a call made a million times moves as one row.
    """
    columns = done.columns
    both = done.select(*columns, F.lit(1).alias("_n")).unionByName(gold.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus > 0")


def in_all(df: DataFrame, run: str, key: Sequence[str], runs: int) -> DataFrame:
    """Keys that occur in all ``runs`` runs."""
    return df.groupBy(*key).agg(F.count_distinct(run).alias("_n")).filter(F.col("_n") == runs).select(*key)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the stated order: a minimum over structs, partially aggregated, no sort."""
    rest = [c for c in df.columns if c not in key and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*key).agg(least).select(*key, "_row.*")


def stitch(original: DataFrame, rerun: DataFrame, key: Sequence[str]) -> DataFrame:
    """``original`` with the rows of ``rerun`` in place of those that have the same key."""
    return original.join(rerun.select(*key), list(key), "left_anti").select(*original.columns).unionByName(rerun)


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def row_bits(*columns: Column) -> Column:
    """First 60 bits of the SHA-256 of a row, as a number that can be summed. Values are told apart by their lengths, null
    from empty."""
    piece = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    row = F.concat(*map(piece, columns))
    return F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (name, n, hash): sum of the first 60 bits of every row's SHA-256, as text. A row counts as often as it
    occurs; no order, no sort, no list."""
    total = F.coalesce(F.sum(row_bits(*(F.col(c) for c in columns))), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("n"), total.alias("hash")).select(F.lit(name).alias("name"), "n", "hash")


def sample(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """(*columns, place): the k rows first in the order of a seeded hash of the key."""
    order = (F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key))
    top = df.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def free_number(used: DataFrame, owner: str, number: str, start: int = 1) -> DataFrame:
    """(owner, free): the smallest number >= start that an owner hasn't used; start if it has used none from there.

    The used numbers of an owner, sorted, first leave the sequence start, start + 1, ... at the answer.
    """
    some = used.filter(F.col(number) >= start).groupBy(owner).agg(F.sort_array(F.collect_set(number)).alias("_used"))
    wanted = F.transform("_used", lambda x, i: F.when(x != i + start, i + start))
    first = F.element_at(F.filter(F.concat(wanted, F.array(F.size("_used") + start)), lambda x: x.isNotNull()), 1)
    return used.select(owner).distinct().join(some, owner, "left").select(owner, F.coalesce(first, F.lit(start)).cast("long").alias("free"))
