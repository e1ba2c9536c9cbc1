"""The whole journal as a stream: every kind of event, applied per person in event-time order.

Events may arrive in any order over the micro-batches.  They wait in the person's list state until the
watermark has passed them; then a timer applies what is due, in the order of ``seq``, to the person's
fold and hands the fold on.  ``sources.journal.replayed`` is the same over a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from vigilframe.sources.journal import SELF_REPORT, VOICE

EMPTY = {"events": 0, "skipped": 0, "scope": [], "welfare_contact": False, "assessments": 0, "total": None,
         "above_cutoff": False, "acute": False, "sittings": 0, "voice": None, "seen": []}
RESULT = ("pid STRING, events BIGINT, skipped BIGINT, scope ARRAY<STRING>, welfare_contact BOOLEAN, "
          "assessments BIGINT, total BIGINT, above_cutoff BOOLEAN, acute BOOLEAN, sittings BIGINT, "
          "voice MAP<STRING,DOUBLE>")
COLUMNS = [part.split()[0] for part in RESULT.split(", ")]


def apply(fold: dict, kind: str, payload: str) -> None:
    """One event over the fold; one that cannot be used is counted and changes nothing else."""
    fold["events"] += 1
    try:
        told = json.loads(payload)
        if kind == "consent.granted":
            fold["scope"] = [str(x) for x in told["scope"]]
            fold["welfare_contact"] = bool(told.get("welfare_contact") or False)
        elif kind == "consent.withdrawn":
            fold["scope"] = []
        elif kind == "assessment.submitted":
            total = int(told["total"])
            if SELF_REPORT in fold["scope"]:
                fold["assessments"] += 1
                fold["total"] = total if fold["total"] is None else max(fold["total"], total)
                cutoff = told.get("cutoff")
                fold["above_cutoff"] |= cutoff is not None and total >= int(cutoff)
                fold["acute"] = bool(told.get("acute") or False)
        elif kind == "voice.sitting":
            kept = {str(k): float(v) for k, v in told["kept"].items()}
            if not kept:
                raise ValueError("nothing was kept")
            if VOICE in fold["scope"]:
                fold["sittings"] += 1
                fold["voice"] = kept
        else:
            raise ValueError(kind)
    except (ValueError, KeyError, TypeError, AttributeError):
        fold["skipped"] += 1


class Replay(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq BIGINT, at BIGINT, kind STRING, payload STRING")
        self.fold = handle.getValueState("fold", "fold STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            millis = [int(t.timestamp() * 1000) for t in frame["at"]]
            self.waiting.appendList([(int(s), m, k, p) for s, m, k, p in zip(
                frame["seq"], millis, frame["kind"], frame["payload"])])
            for at in set(millis):
                self.handle.registerTimer(at + 1)
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted({row for row in held if row[1] <= border})
        if not due:
            yield pd.DataFrame(columns=COLUMNS)
            return
        left = [row for row in held if row[1] > border]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        fold = json.loads(self.fold.get()[0]) if self.fold.exists() else {**EMPTY}
        before = set(fold["seen"])
        for seq, _, kind, payload in due:
            if seq not in before:  # handed over twice
                before.add(seq)
                apply(fold, kind, payload)
        fold["seen"] = sorted(before)
        self.fold.update((json.dumps(fold),))
        yield pd.DataFrame([{"pid": key[0], **{c: fold[c] for c in COLUMNS[1:]}}], columns=COLUMNS)

    def close(self) -> None:
        pass


def replay(events: DataFrame, late_by: str = "1 day") -> DataFrame:
    """Opened events (pid, seq, at, kind, payload) -> the person's fold, each time more of it is due."""
    return events.select("pid", "seq", "at", "kind", "payload").withWatermark("at", late_by).groupBy(
        "pid").transformWithStateInPandas(Replay(), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")
