"""Documents of many tables: parents with all their children nested, in one shuffle for all tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, Sequence[str]]], single: Sequence[str] = ()) -> DataFrame:
    """``parent`` with an array of structs for each of ``children`` {name: (rows with ``key``, fields)}, sorted by its fields in their
    order and empty where there are none; for those in ``single`` the least struct instead, null where there is none.

    All tables are brought to one shape, a column for each of them of which a row fills one, and are put together in one union: one
    aggregation nests them all, where a join for each would shuffle the parents as often. Children without a parent and rows
    without a key are left out; parents of one key are one document each, with the same children."""
    names = ["parent", *children]
    fields = {"parent": [c for c in parent.columns if c != key]} | {n: list(f) for n, (_, f) in children.items()}
    rows = {"parent": parent} | {n: df for n, (df, _) in children.items()}
    kinds = {n: rows[n].select(F.struct(*fields[n]).alias("s")).schema["s"].dataType for n in names}
    union = None
    for n in names:
        own = [F.struct(*fields[n]).cast(kinds[n]).alias(n) if n == m else F.lit(None).cast(kinds[m]).alias(m) for m in names]
        part = rows[n].filter(F.col(key).isNotNull()).select(key, *own)
        union = part if union is None else union.union(part)
    listed = {n: F.sort_array(F.collect_list(n)) for n in names}
    by = union.groupBy(key).agg(*(F.get(listed[n], F.lit(0)).alias(n) if n in single else listed[n].alias(n) for n in names))
    return by.select(key, F.explode("parent").alias("parent"), *children).select(key, "parent.*", *children)
