"""The alert queue as keyed state: one small queue per person.

State holds undelivered alerts only.  A cancellation empties it and writes nothing, so no record of
who withdrew is left anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "pid string, seq bigint, delivered_seq bigint"
STATE = "waiting array<bigint>"


def _advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting = list(state.get[0]) if state.exists else []
    events = pd.concat(list(frames)).sort_values("seq")
    served = []
    for seq, kind in zip(events["seq"], events["kind"]):
        if kind == "enqueue":
            waiting.append(int(seq))
        elif kind == "cancel":
            waiting.clear()
        elif kind == "deliver" and waiting:
            served.append((key[0], waiting.pop(0), int(seq)))
    if waiting:
        state.update((waiting,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(served, columns=["pid", "seq", "delivered_seq"])


def deliveries(log: DataFrame) -> DataFrame:
    """A stream of (pid, seq, kind) -> the alerts that reached somebody, as they do."""
    return log.groupBy("pid").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
