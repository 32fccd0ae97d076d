"""Transactional writes as data: (requests, state) -> accepted, refused with a code, and the new state.

A DataFrame is never updated. Requests that don't depend on each other are decided row by row; those that do
(stock, limits) are folded in order within their key, by ``aggregate`` over the key's sorted requests, in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.rules import first_failure


def decide(requests: DataFrame, state: DataFrame, key: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Requests joined to the state they address, with ``code``: null if accepted. A key that leads nowhere is refused first."""
    joined = requests.join(state.withColumn("_there", F.lit(True)), key, "left")
    return joined.withColumn("code", first_failure([("not_found", F.col("_there").isNull()), *checks])).drop("_there")


def apply(state: DataFrame, accepted: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """The new state: ``changes`` hold in the rows whose key was accepted, the rest is as before."""
    hit = accepted.select(key).distinct().withColumn("_hit", F.lit(True))
    changed = state.join(hit, key, "left")
    return changed.select(*(F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in state.columns))


def dry_run(state: DataFrame, accepted: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """(key, field, was, would_be) of what ``apply`` would change, a row for each field, as text; the state is not touched."""
    hit = state.join(accepted.select(key).distinct(), key, "left_semi")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("was"), v.cast("string").alias("would_be")) for c, v in changes.items()))
    return hit.select(key, F.inline(fields)).filter("NOT was <=> would_be")


def take_stock(requests: DataFrame, stock: DataFrame, key: str, order: str, quantity: str, left: str) -> DataFrame:
    """(key, order, quantity, accepted, left): requests in order, each taken if there is still stock for all of it.

    A refused request takes nothing, so a later smaller one may still fit; a running sum would not see that.
    """
    listed = requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, quantity))).alias("_asked"))
    joined = listed.join(stock.select(key, F.col(left).cast("long").alias("_left")), key)
    folded = F.expr(
        f"aggregate(_asked, struct(_left AS l, cast(array() AS array<struct<ok:boolean,l:bigint>>) AS d), (a, x) -> struct(if(x.{quantity} <= a.l, a.l - x.{quantity}, a.l) AS l, "
        f"concat(a.d, array(struct(x.{quantity} <= a.l AS ok, if(x.{quantity} <= a.l, a.l - x.{quantity}, a.l) AS l))) AS d), a -> a.d)"
    )
    each = joined.select(key, F.explode(F.arrays_zip("_asked", folded.alias("done"))).alias("_x"))
    return each.select(key, f"_x._asked.{order}", f"_x._asked.{quantity}", F.col("_x.done.ok").alias("accepted"), F.col("_x.done.l").alias("left"))


def limit_trailing(requests: DataFrame, key: str, order: str, day: str, most: int, days: int) -> DataFrame:
    """(key, order, day, accepted): at most ``most`` accepted ones of a key within any ``days`` days, in order of day.

    Only accepted requests count, and of these only the last ``most`` are remembered.
    """
    listed = requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(day, order))).alias("_asked"))
    fits = f"(size(a.t) < {most} OR x.{day} - a.t[0] >= {days})"
    folded = F.expr(
        f"aggregate(_asked, struct(cast(array() AS array<bigint>) AS t, cast(array() AS array<boolean>) AS d), (a, x) -> struct("
        f"if({fits}, slice(concat(a.t, array(cast(x.{day} AS bigint))), greatest(-{most}, -size(a.t) - 1), {most}), a.t) AS t, concat(a.d, array({fits})) AS d), a -> a.d)"
    )
    each = listed.select(key, F.explode(F.arrays_zip("_asked", folded.alias("ok"))).alias("_x"))
    return each.select(key, f"_x._asked.{order}", f"_x._asked.{day}", F.col("_x.ok").alias("accepted"))


def confirm_gate(calls: DataFrame, conv: str, turn: str, target: str, consent: str) -> DataFrame:
    """Calls with ``runs``: the same target was previewed the turn before, and this turn's message consents."""
    from pyspark.sql.window import Window

    before = F.lag(turn).over(Window.partitionBy(conv, target).orderBy(turn))
    return calls.withColumn("runs", F.coalesce(before == F.col(turn) - 1, F.lit(False)) & F.col(consent))
