"""One wide row per person: the deviations array plus every fact the decision reads.

A person has at most one deviation per configured domain, so the array is bounded by the config
and the whole decision layer runs inside the row, with no further shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import Config
from vigilframe.functions.scalar import strings

DEVIATION_FIELDS = (
    "domain", "z_self", "z_unit", "direction", "windows_breached", "tier", "weight",
    "breach_0", "breach_1", "breach_2", "missing", "unit_fraction",
    "planned_leave", "training", "seasonal",
)
ENROLLED = ("ACTIVE", "PARTIAL")


def with_unit_context(devs: DataFrame, fractions: DataFrame,
                      calendar: DataFrame | None = None) -> DataFrame:
    """Attach the unit share per domain and the person's calendar flags.

    ``calendar``: (pid, domain, planned_leave, training, seasonal), at most one row per key.
    """
    out = devs.join(fractions, ["unit_id", "domain"], "left").withColumn(
        "unit_fraction", F.coalesce("unit_fraction", F.lit(0.0)))
    flags = ("planned_leave", "training", "seasonal")
    if calendar is None:
        return out.select("*", *[F.lit(False).alias(f) for f in flags])
    out = out.join(calendar, ["pid", "domain"], "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})


def calendar_flags(devs: DataFrame, entries: DataFrame, as_of: date) -> DataFrame:
    """Interval join of deviations to calendar entries (pid, domain, kind, starts_on, ends_on).

    The equality on (pid, domain) keeps it a hash or merge join; the interval is a residual filter.
    """
    live = entries.filter((F.col("starts_on") <= F.lit(as_of)) & (F.col("ends_on") >= F.lit(as_of)))
    hit = devs.select("pid", "domain").join(live, ["pid", "domain"])
    return hit.groupBy("pid", "domain").agg(
        F.bool_or(F.col("kind") == "leave").alias("planned_leave"),
        F.bool_or(F.col("kind") == "training").alias("training"),
        F.bool_or(F.col("kind") == "seasonal").alias("seasonal"))


def seasonal_entries(devs: DataFrame, earlier: DataFrame, as_of: date) -> DataFrame:
    """Calendar entries for deviations that the prior year's same window already showed."""
    again = devs.select("pid", "domain", "direction").join(
        earlier.select("pid", "domain", "direction"), ["pid", "domain", "direction"])
    return again.select("pid", "domain", F.lit("seasonal").alias("kind"),
                        F.lit(as_of).alias("starts_on"), F.lit(as_of).alias("ends_on"))


def build_cases(devs: DataFrame, consent: DataFrame, *, capacity: DataFrame | None = None,
                risk: DataFrame | None = None, active: DataFrame | None = None,
                suppressed: DataFrame | None = None) -> DataFrame:
    """Deviations with context -> one case row per person who has a consent state.

    consent: (pid, status, scope, welfare_contact); capacity: (unit_id, capacity);
    risk: (pid, risk_status, risk_score, drivers); active: (pid, active_codes);
    suppressed: (pid, suppressed_drivers).
    """
    # a person has one unit in a run, so grouping by pid alone lets every later join on pid reuse
    # this exchange
    packed = devs.groupBy("pid").agg(
        F.max("unit_id").alias("unit_id"),
        F.array_sort(F.collect_list(F.struct(*DEVIATION_FIELDS))).alias("deviations"),
        F.max("cohort_size").alias("cohort_size"))
    out = packed.join(consent.select("pid", "status", "scope", "welfare_contact"), "pid")
    out = (out.join(capacity, "unit_id", "left") if capacity is not None
           else out.withColumn("capacity", F.lit(True)))
    out = out.withColumn("capacity", F.coalesce("capacity", F.lit(True)))
    for table, columns in ((risk, ("risk_status", "risk_score", "drivers")),
                           (active, ("active_codes",)), (suppressed, ("suppressed_drivers",))):
        if table is not None:
            out = out.join(table.select("pid", *columns), "pid", "left")
    return with_defaults(out)


def with_defaults(cases: DataFrame) -> DataFrame:
    """Fill the optional facts a caller did not supply."""
    defaults: dict[str, Column] = {
        "capacity": F.lit(True),
        "risk_status": F.lit("unavailable"),
        "risk_score": F.lit(None).cast("double"),
        "drivers": F.array().cast("array<struct<feature:string,contribution:double>>"),
        "active_codes": strings(()),
        "suppressed_drivers": strings(()),
        "acute_items": strings(()),
        "clinician_concern": F.lit(False),
    }
    have = set(cases.columns)
    return cases.withColumns({
        name: (F.coalesce(F.col(name), value) if name in have else value)
        for name, value in defaults.items()
    })


def enrolled() -> Column:
    return F.col("status").isin(*ENROLLED)


def consented(devs: str = "deviations") -> Column:
    """The deviations the person's consent covers."""
    return F.when(
        enrolled(),
        F.filter(F.col(devs), lambda d: F.array_contains(F.col("scope"), d["domain"])),
    ).otherwise(F.filter(F.col(devs), lambda d: F.lit(False)))


def explode_consented(cases: DataFrame, *keep: str) -> DataFrame:
    return cases.select(*keep, F.inline(consented()))


def known_domains(cfg: Config) -> Column:
    return strings(cfg.domains)
