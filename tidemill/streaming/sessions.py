"""The conversation fold over a stream: one state a conversation, messages in order of arrival."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.conversation import OUTCOME, events, new_state, outcome, step


def sessions(messages: DataFrame, idle_ms: int = 0) -> DataFrame:
    """(conv_id, *OUTCOME) after each batch, for the conversations it touched.

    Run with output mode update. A conversation's messages of one batch are taken in order of ``turn``; its state
    is small whatever its length. With ``idle_ms`` a state is dropped after so long without a message.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else new_state()
        for frame in frames:
            for role, kind, said in frame.sort_values("turn")[["role", "kind", "said"]].itertuples(index=False):
                step(held, role, kind, int(said))
        state.update((json.dumps(held),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([{"conv_id": key[0], **outcome(held)}])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events(messages).groupBy("conv_id").applyInPandasWithState(run, f"conv_id long, {OUTCOME}", "held string", "update", timeout)
