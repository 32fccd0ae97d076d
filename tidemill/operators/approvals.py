"""Writes that a person must approve: queued, asked for again, decided once, and run again on the state of then.

Logs (changes of an order's status, requests, decisions) are dealt by order and sorted by time; a task then goes through its
entries once and holds what decides about a request of the order it is at: its status, lines that are taken, and what was paid
back already, so that a refund can't be split below the threshold. Logs of different orders are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.calls import CANCELLABLE

#: Fixed value: the refund from which on a person decides.
THRESHOLD = 100_000

#: What an entry says, in the order in which entries of one time follow one another.
_ENTRY = ("kind", "session", "target", "tool", "lines", "refund", "approve", "status")
_KEPT = ("order_id", "at", "kind", "session", "target")


class _Order:
    """Where an order stands. What is unknown (a null) is compared as in SQL: it is neither equal nor unequal."""

    __slots__ = ("made", "paid", "pending", "status", "taken", "unsure")

    def __init__(self) -> None:
        self.status: str | None = None
        #: Open approvals as (session, refund, number), by target.
        self.pending: dict[str, list[tuple[str | None, int | None, int]]] = {}
        #: Known lines that are taken, and whether an unknown one is.
        self.taken: set[int] = set()
        self.unsure = False
        self.paid: int | None = 0
        self.made = 0

    def free(self, cancels: bool, lines: Sequence[int | None]) -> bool | None:
        """Whether a request could be carried out now."""
        if cancels:
            return None if self.status is None else self.status in CANCELLABLE
        if self.status != "delivered" and self.status is not None or not self.taken.isdisjoint(lines):
            return False
        unsure = (self.taken or self.unsure) and lines and (self.unsure or None in lines)
        return None if unsure or self.status is None else True

    def meet(self, kind: str, session: str | None, target: str, tool: str | None, lines: Sequence[int | None], refund: int | None, approve: bool | None, status: str | None, threshold: int) -> tuple[str, int | None, int | None]:
        """(outcome, number, total) of an entry, after which the order stands as that leaves it."""
        waiting, own, number, total = self.pending.get(target), None, None, None
        if waiting and session is not None:
            for p in waiting:
                if p[0] == session:
                    own, number = p, p[2]
                    break
        if kind == "status":
            self.status = status
            return "changed", number, None
        cancels = tool == "cancel_order"
        if kind == "ask":
            before = 0 if cancels else self.paid
            total = None if refund is None or before is None else refund + before
            if self.free(cancels, lines) is False:
                return "refused", number, total
            if total is None or total >= threshold:
                if own:
                    return "reused", number, total
                self.made += 1
                self.pending[target] = [*(waiting or ()), (session, refund, self.made)]
                return "queued", self.made, total
            outcome, number = "executed", None
        else:
            if kind == "decide" and waiting:
                self.pending[target] = [p for p in waiting if p[0] is not None and session is not None and p[0] != session]
            if not own:
                return "conflict", None, None
            if approve is False:
                return "rejected", number, None
            if not self.free(cancels, lines):
                return "failed", number, None
            outcome = "approved"
            if kind == "decide":
                refund = own[1]
        if cancels:
            self.status = "cancelled"
        elif tool is not None:
            self.taken.update(n for n in lines if n is not None)
            self.unsure |= None in lines
            self.paid = None if refund is None or self.paid is None else self.paid + refund
        return outcome, number, total


def _values(c: pa.Array) -> list[Any]:
    return (c.to_pandas(integer_object_nulls=True) if pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False)).tolist()


def _lists(c: pa.ListArray) -> list[Sequence[Any]]:
    values, edges = _values(c.values), c.offsets.to_numpy().tolist()
    return [values[i:j] if i < j else () for i, j in zip(edges, edges[1:])]


def _fold(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through entries that are sorted by order and time. An order's log may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, last = _Order(), None
        for batch in filter(len, batches):
            ids = batch.column("order_id")
            codes = ids.dictionary_encode("encode").indices.to_numpy()
            starts = [last is None or last[0] != ids[0].as_py(), *(codes[1:] != codes[:-1]).tolist()]
            last = (ids[-1].as_py(),)
            entries = [_lists(batch.column(c)) if c == "lines" else _values(batch.column(c)) for c in _ENTRY]
            outcomes, numbers, totals = [], [], []
            for start, kind, session, target, tool, lines, refund, approve, status in zip(starts, *entries):
                if start:
                    order = _Order()
                outcome, number, total = order.meet(kind, session, target, tool, lines, refund, approve, status, threshold)
                outcomes.append(outcome)
                numbers.append(number)
                totals.append(total)
            done = [pa.array(outcomes, pa.string()), pa.array(numbers, pa.int32()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), *done], [*_KEPT, "outcome", "number", "total"])

    return run


def decide(log: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(order_id, at, kind, session, target, outcome, number, total) of every entry of ``log``, in order.

    The log has (order_id, at, kind, session, tool, lines, refund, approve, status). Kind ``status``: the order is in that status
    from then on. Kind ``ask``: a session's request to cancel, or to return lines; it is executed, refused (the order is
    not in a status for it, or a line is taken), or, if its refund with what returns of the order paid back already reaches
    the threshold, queued under a new number of the order; one that waits already is reused. Kind ``decide``: rejected, or
    approved and run again on the state of then, which may fail; a second decision on one approval is a conflict. Requests
    that differ in anything but session, tool and lines are the same."""
    target = F.concat_ws(" ", "tool", F.array_join(F.sort_array("lines"), ","))
    lines, refund = F.coalesce("lines", F.array().cast("array<int>")), F.col("refund").cast("long")
    entries = log.select("order_id", "at", "kind", "session", target.alias("target"), "tool", lines.alias("lines"), refund.alias("refund"), "approve", "status")
    dealt = entries.repartition("order_id").sortWithinPartitions("order_id", "at", *_ENTRY)
    kinds = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in _KEPT)
    return dealt.mapInArrow(_fold(threshold), f"{kinds}, outcome string, number int, total long")


def approvals(done: DataFrame) -> DataFrame:
    """(order_id, number, session, target, asked_at, decided_at, status, times): each approval as its last version says; ``times`` is
    how often it was asked for."""
    own = done.filter("number IS NOT NULL AND outcome <> 'conflict'")
    ends = F.col("kind") == "decide"
    return own.groupBy("order_id", "number").agg(
        F.min("session").alias("session"),
        F.min("target").alias("target"),
        F.min("at").alias("asked_at"),
        F.max(F.when(ends, F.col("at"))).alias("decided_at"),
        F.coalesce(F.max(F.when(ends, F.col("outcome"))), F.lit("pending")).alias("status"),
        F.count_if(~ends).alias("times"),
    )
