"""Turns of chat sessions: limits on calls and turns, over a table and over a stream.

Over a table, counts are windows. Over a stream, a session's counts are typed state: values for its turn and how many
calls it made, a map of calls by tool, and a timer that forgets a session which was silent for so long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Calls that a session may make in one turn, and customer turns after which it is closed.
CALLS, TURNS = 8, 40
SCHEMA = "conv_id long, turn long, role string, turns long, calls long, tool_calls long, outcome string"


def _outcome(turns: Column, calls: Column, role: Column, most_calls: int, most_turns: int) -> Column:
    return F.when(turns > most_turns, "closed").when((role == "tool") & (calls > most_calls), "limited").when(role == "tool", "called").when(role == "user", "asked").otherwise("replied")


def turns(messages: DataFrame, most_calls: int = CALLS, most_turns: int = TURNS) -> DataFrame:
    """(conv_id, turn, role, turns, calls, tool_calls, outcome) of each message (conv_id, turn, role, tool) of a table.

    ``turns`` counts the customer's messages, ``calls`` the calls in this turn and ``tool_calls`` those of the message's tool
    in the session, all up to here. Beyond the limits a call is ``limited`` and a session ``closed``."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("turns", F.count_if(F.col("role") == "user").over(order))
    called = F.when(F.col("role") == "tool", 1)
    m = m.withColumn("calls", F.count(called).over(Window.partitionBy("conv_id", "turns").orderBy("turn")))
    m = m.withColumn("tool_calls", F.when(F.col("role") == "tool", F.count(called).over(Window.partitionBy("conv_id", "tool").orderBy("turn"))).otherwise(0))
    return m.select("conv_id", "turn", "role", "turns", "calls", "tool_calls", _outcome(F.col("turns"), F.col("calls"), F.col("role"), most_calls, most_turns).alias("outcome"))


class Turns(StatefulProcessor):
    """The same of a stream, for messages that arrive in order or within one batch."""

    def __init__(self, most_calls: int = CALLS, most_turns: int = TURNS, idle_ms: int = 0):
        self.most_calls, self.most_turns, self.idle_ms = most_calls, most_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "turns long, calls long")
        self.by_tool = handle.getMapState("by_tool", "tool string", "calls long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        turns, calls = self.counts.get() if self.counts.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: r.turn):
            own = 0
            if r.role == "user":
                turns, calls = turns + 1, 0
            elif r.role == "tool":
                calls += 1
                tool = (r.tool or "",)
                own = (self.by_tool.getValue(tool)[0] if self.by_tool.containsKey(tool) else 0) + 1
                self.by_tool.updateValue(tool, (own,))
            said = {"tool": "called", "user": "asked"}.get(r.role, "replied")
            outcome = "closed" if turns > self.most_turns else "limited" if r.role == "tool" and calls > self.most_calls else said
            yield Row(conv_id=key[0], turn=r.turn, role=r.role, turns=turns, calls=calls, tool_calls=own, outcome=outcome)
        self.counts.update((turns, calls))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.counts.clear()
        self.by_tool.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed(messages: DataFrame, most_calls: int = CALLS, most_turns: int = TURNS, idle_ms: int = 0) -> DataFrame:
    """``turns`` of a stream of messages. Its state needs the provider of RocksDB; ``idle_ms`` forgets silent sessions."""
    processor = Turns(most_calls, most_turns, idle_ms)
    return messages.groupBy("conv_id").transformWithState(processor, SCHEMA, "append", "ProcessingTime" if idle_ms else "None")
