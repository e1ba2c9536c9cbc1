"""Questionnaires as they are submitted: record first, then route, then decide again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilframe.config import Config
from vigilframe.operators import alerts, intraday

UNRECORDED = (
    "this disclosure could not be recorded. It has NOT been routed automatically. Contact the "
    "designated mental-health authority directly.")


def ledger_rows(scored: DataFrame) -> DataFrame:
    """Totals and flags only: an answer never reaches the ledger."""
    return scored.filter(F.col("refused_because").isNull()).select(
        F.lit("assessment.submitted").alias("action"), F.col("pid").alias("subject_pid"),
        "response_id", "instrument", "total", "cutoff", (F.size("acute") > 0).alias("acute"),
        F.col("taken_at").alias("at"))


def write_batch(table: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns one folder and replaces it, so a retried batch is not written twice."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")
    return write


def handler(cases: DataFrame, fractions: DataFrame, cfg: Config, *,
            ledger: Callable[[DataFrame, int], None], routes: Callable[[DataFrame, int], None],
            verdicts: Callable[[DataFrame, int], None],
            queue: Callable[[DataFrame, int], None] | None = None,
            unrecorded: Callable[[DataFrame, int], None] | None = None,
            earlier: Callable[[int], DataFrame] | None = None, frozen: Column | bool = False,
            now: datetime | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body.

    Nothing is routed without a record: if the ledger cannot be written, the acute submissions go
    to ``unrecorded`` with a message for a human, the batch routes and decides nothing, and it
    fails, so that the query hands over the same submissions again.  ``earlier`` gives the
    submissions of the batches before (since the night), which count on: a report may only raise.
    ``frozen`` is the freeze of the run the cases come from.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = intraday.score_responses(batch, cfg).persist()
        try:
            urgent = intraday.acute_routes(scored, cfg)
            try:
                ledger(ledger_rows(scored), batch_id)
            except Exception:
                if unrecorded is not None:
                    unrecorded(urgent.select(
                        "response_id", "pid", F.lit(UNRECORDED).alias("message")), batch_id)
                raise
            routes(urgent, batch_id)
            told = scored
            if earlier is not None:  # everything those people have reported today
                before = intraday.score_responses(earlier(batch_id), cfg)
                told = scored.unionByName(before.join(scored.select("pid").distinct(), "pid", "left_semi"))
            decided = intraday.redecide(cases, told, fractions, cfg, frozen)
            verdicts(decided.select("pid", "unit_id", "decision", "reason", "composite"), batch_id)
            if queue is not None:
                queue(alerts.enqueue(decided, now or datetime.now(timezone.utc)), batch_id)
        finally:
            scored.unpersist()
    return handle


def follow(responses: DataFrame, body: Callable[[DataFrame, int], None],
           checkpoint: str) -> StreamingQuery:
    return (responses.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
