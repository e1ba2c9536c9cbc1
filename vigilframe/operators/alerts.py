"""Alerts between a verdict and a person: queueing, delivery, withdrawal."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.ordered import WIDTH
from vigilframe.session import materialised

CONSOLE_OPENS = time(7, 0)


def enqueue(verdicts: DataFrame, queued_at: datetime | Column) -> DataFrame:
    """One alert per named verdict; it carries a pid and never a name."""
    acute = F.col("decision") == "IMMEDIATE_ESCALATE"
    queued = queued_at if isinstance(queued_at, Column) else F.lit(queued_at)
    return verdicts.filter("named").select(
        "pid", "unit_id", F.when(acute, "same_day").otherwise("routine").alias("priority"),
        "reason", F.round("composite", 4).alias("composite"),
        F.coalesce(F.try_element_at("recommended", F.lit(1)), F.lit("")).alias("intervention"),
        F.when(acute, "mental_health_authority").otherwise("welfare_officer").alias("route_to"),
        queued.alias("queued_at"), deliver_after(queued).alias("deliver_after"),
        F.lit(None).cast("timestamp").alias("delivered_at"))


def deliver_after(queued: Column) -> Column:
    """Nothing is pushed overnight: held until the console opens."""
    opens = F.date_trunc("day", queued) + F.expr(f"INTERVAL {CONSOLE_OPENS.hour} HOURS")
    return F.greatest(queued, opens)


def shadow_log(verdicts: DataFrame) -> DataFrame:
    """A shadow run issues nothing, acute or not; it only records what it would have done."""
    return verdicts.filter("named").select(
        "pid", "unit_id", F.lit("verdict.recorded").alias("action"),
        F.col("decision").alias("would_have_alerted"),
        F.lit("shadow run — gates executed, no alert issued").alias("note"))


def pending(alerts: DataFrame, unit_id: str = "") -> DataFrame:
    out = alerts.filter(F.col("delivered_at").isNull())
    return out.filter(F.col("unit_id") == unit_id) if unit_id else out


def replay(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Final alerts of a (pid, seq, kind) log of enqueue, deliver and cancel, in order.

    A delivery takes the oldest undelivered alert and does nothing on an empty queue; a cancellation
    removes what is undelivered and leaves no trace.  Between two cancellations this is a queue, so
    running counts say which deliveries found something (those that set no new record of deliveries
    over alerts) and which alert each of them took.

    One pass: a person's log is cut into stretches of ``width`` sequence numbers, every running count is
    taken inside a stretch, and one summary row per stretch carries what is open over its end.  A person
    with most of the rows is spread over as many tasks as they have stretches.
    """
    rows = materialised(_counted(log, width), "alert-counts")
    alerts = rows.filter("kind = 'enqueue'").select("pid", "epoch", "alert_no", "seq")
    # a delivery that sets a new record of deliveries over alerts found nothing
    served = rows.filter((F.col("kind") == "deliver") & (F.col("tries") - F.col("alert_no") <= F.col("wasted"))).select(
        "pid", "epoch", (F.col("tries") - F.col("wasted")).alias("alert_no"), F.col("seq").alias("delivered_seq"))
    last = rows.groupBy("pid").agg(F.max("epoch").alias("last_epoch"))
    out = alerts.join(served, ["pid", "epoch", "alert_no"], "left").join(last, "pid")
    # a later cancellation removed everything still waiting
    kept = F.col("delivered_seq").isNotNull() | (F.col("epoch") == F.col("last_epoch"))
    return out.filter(kept).select("pid", "seq", "delivered_seq")


def _counted(log: DataFrame, width: int) -> DataFrame:
    """pid, seq, kind; epoch (cancellations up to the row), and since the last of them the alerts and the
    deliveries up to the row and the deliveries before it that found nothing (``wasted``)."""
    def is_(kind: str) -> Column:
        return (F.col("kind") == kind).cast("bigint")

    inside = Window.partitionBy("pid", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("pid", "_stretch", "_epoch").orderBy("seq")
    upto, before = since.rowsBetween(Window.unboundedPreceding, 0), since.rowsBetween(Window.unboundedPreceding, -1)
    near = log.select("pid", "seq", "kind").withColumn("_stretch", F.floor(F.col("seq") / width))
    near = near.withColumn("_epoch", F.sum(is_("cancel")).over(inside))
    near = near.withColumns({"_e": F.sum(is_("enqueue")).over(upto), "_d": F.sum(is_("deliver")).over(upto)})
    over = F.col("_d") - F.col("_e")
    near = near.withColumns({"_x": F.max(over).over(upto), "_xb": F.max(over).over(before)})

    # what a stretch leaves open; a cancellation in it forgets what came before
    ends = near.groupBy("pid", "_stretch").agg(F.max_by(F.struct("_epoch", "_e", "_d", "_x"), "seq").alias("t"))
    ends = ends.select("pid", "_stretch", "t.*")
    order = Window.partitionBy("pid").orderBy("_stretch")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_c": F.coalesce(F.sum("_epoch").over(past), F.lit(0)),
                             "_run": F.sum((F.col("_epoch") > 0).cast("int")).over(
                                 order.rowsBetween(Window.unboundedPreceding, 0))})
    run = Window.partitionBy("pid", "_run").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({"_te": F.sum("_e").over(run), "_td": F.sum("_d").over(run)})
    # the record of a run of stretches: each one's own, on top of what the run had before it
    own = F.col("_x") + (F.col("_td") - F.col("_d")) - (F.col("_te") - F.col("_e"))
    ends = ends.withColumn("_tx", F.max(own).over(run))
    carried = ends.select("pid", "_stretch", "_c", *[
        F.lag(c).over(order).alias(f"{c}0") for c in ("_te", "_td", "_tx")])

    out = near.join(carried, ["pid", "_stretch"])
    open_ = F.col("_epoch") == 0  # the epoch that came over the border
    e0, d0 = (F.when(open_, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("_te0", "_td0"))
    record = F.greatest(F.col("_xb") + d0 - e0, F.when(open_, F.col("_tx0")), F.lit(0))
    return out.select("pid", "seq", "kind", (F.col("_epoch") + F.col("_c")).alias("epoch"),
                      (F.col("_e") + e0).alias("alert_no"), (F.col("_d") + d0).alias("tries"), record.alias("wasted"))
