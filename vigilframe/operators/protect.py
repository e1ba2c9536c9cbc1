"""The privacy boundary at ingest: validation, pseudonyms, consent, sealing and erasure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import PSEUDONYM_ANCHOR, Config
from vigilframe.functions.scalar import hmac_sha256, lookup

PID_LENGTH = 32


# --------------------------------------------------------------- raw row checking ---
def resolve_time(stamp: Column, day: Column) -> Column:
    """A parseable timestamp wins over the date; both are read as UTC."""
    return F.coalesce(F.try_to_timestamp(stamp), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


def validate(raw: DataFrame, cfg: Config, as_of: date, days: int) -> DataFrame:
    """Type raw text rows and name the reason a row is refused; nothing is coerced.

    Expects service_no, unit, date, value, timestamp (all text) and domain.  A refused row keeps
    ``reject_reason``; a good row outside the period keeps ``in_window = false``.
    """
    for domain in cfg.domain_tier:
        if domain in cfg.domain_scale:
            cfg.scale_of(domain)
    text = {c: F.trim(F.coalesce(F.col(c), F.lit("")))
            for c in ("service_no", "unit", "date", "value", "timestamp")}
    number = F.col("number")
    out = raw.select("domain", *[c.alias(n) for n, c in text.items()]).withColumns({
        "number": F.col("value").try_cast("double"),
        "observed_at": resolve_time(F.col("timestamp"), F.col("date")),
    })
    reason = (
        F.when(F.col("service_no") == "", "blank_id")
        .when(F.col("unit") == "", "blank_unit")
        .when(F.col("value") == "", "blank_value")
        .when(F.col("observed_at").isNull(), "bad_date")
        .when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), "bad_number")
        .when(number < 0, "negative"))
    age = F.datediff(F.lit(as_of), F.to_date("observed_at"))
    scale = lookup({d: float(s) for d, s in cfg.domain_scale.items()}, F.col("domain"))
    return out.withColumn("reject_reason", reason).withColumns({
        "in_window": F.col("reject_reason").isNull() & (age >= 0) & (age < days),
        "scaled": F.when(F.col("reject_reason").isNull(),
                         F.least(F.lit(1.0), number / scale)),
    })


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("in_window").select(
        F.col("service_no").alias("service_number"), F.col("unit").alias("unit_id"), "domain",
        "observed_at", F.col("scaled").alias("value"))


def source_status(validated: DataFrame, expected: DataFrame) -> DataFrame:
    """Per domain: rows, expectation, shortfall and status.

    ``expected``: (domain, expected_rows, available) from the roster, one row per source; counts
    are joined to it, so a source that returned nothing still has a row.
    """
    counts = validated.groupBy("domain").agg(
        F.count_if("in_window").alias("rows"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("reject_reason").isNull() & ~F.col("in_window")).alias("out_of_window"))
    out = expected.join(counts, "domain", "left").na.fill(
        0, ["rows", "rejected", "out_of_window"])
    short = F.when(F.col("expected_rows") <= 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("rows") / F.col("expected_rows")))
    return out.withColumns({
        "missing_fraction": short,
        "status": F.when(~F.col("available"), "unavailable")
        .when(F.col("rejected") > 0, "partial").otherwise("ok"),
    })


def roster_expectation(roster_size: Column, days: int, rate: Column) -> Column:
    """Rows a source should have returned, from the roster and never from the file."""
    return F.rint(roster_size * days * rate).cast("bigint")


# --------------------------------------------------------------------- pseudonyms ---
def epoch_index(day: Column, cfg: Config) -> Column:
    return F.floor(F.datediff(day, F.lit(PSEUDONYM_ANCHOR)) / cfg.salt_days)


def epoch_label(index: Column) -> Column:
    return F.format_string("E%04d", index)


def epochs(days: DataFrame, cfg: Config, day: str = "day") -> DataFrame:
    """Add the salt epoch of a day: index, label, first and last day."""
    out = days.withColumn("epoch", epoch_index(F.col(day), cfg))
    start = F.date_add(F.lit(PSEUDONYM_ANCHOR), (F.col("epoch") * cfg.salt_days).cast("int"))
    return out.withColumns({
        "epoch_label": epoch_label(F.col("epoch")), "epoch_start": start,
        "epoch_end": F.date_add(start, cfg.salt_days - 1)})


def pseudonym(service_number: Column, secret: str, on: date, cfg: Config) -> Column:
    """First 32 hex digits of HMAC-SHA256(secret, "<epoch>:<number>").

    The key pads are literals of the plan: set ``spark.sql.redaction.string.regex`` where plans
    are logged.
    """
    if not secret:
        raise ValueError("the pseudonym secret is empty")
    index = (on - PSEUDONYM_ANCHOR).days // cfg.salt_days
    message = F.concat(F.lit(f"E{index:04d}:"), service_number)
    return F.substring(hmac_sha256(secret, message), 1, PID_LENGTH)


def pseudonymise(rows: DataFrame, secret: str, on: date, cfg: Config) -> DataFrame:
    """Replace the service number by its pid; the identifier ends here."""
    return rows.withColumn("pid", pseudonym(F.col("service_number"), secret, on, cfg)).drop(
        "service_number")


# ------------------------------------------------------------------------ consent ---
def consent_outcome(signals: DataFrame, consent: DataFrame) -> DataFrame:
    """Add ``drop_reason`` (NULL = kept).

    A plain equi-join: adaptive execution broadcasts consent when it is small and splits a hot
    pid's side when it is not.
    """
    joined = signals.join(consent.select("pid", "status", "scope"), "pid", "left")
    absent = F.coalesce(F.col("status"), F.lit("NOT_ENROLLED")).isin("NOT_ENROLLED", "REVOKED")
    return joined.withColumn(
        "drop_reason",
        F.when(absent, "not_enrolled")
        .when(~F.array_contains("scope", F.col("domain")), "no_consent"))


def consent_filter(signals: DataFrame, consent: DataFrame) -> DataFrame:
    return consent_outcome(signals, consent).filter(F.col("drop_reason").isNull()).drop(
        "status", "scope", "drop_reason")


def normalise_report(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("domain").agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("drop_reason").isNull()).alias("rows_out"),
        F.count_if(F.col("drop_reason") == "not_enrolled").alias("not_enrolled"),
        F.count_if(F.col("drop_reason") == "no_consent").alias("no_consent"))


def assert_range(signals: DataFrame) -> DataFrame:
    """Fail the job on a value outside [0, 1] rather than screen it."""
    ok = F.col("value").between(0.0, 1.0)
    return signals.withColumn("value", F.when(ok, F.col("value")).otherwise(
        F.raise_error(F.lit("signal value outside [0, 1]")).cast("double")))


def record_domains_only(signals: DataFrame, session_domains: tuple[str, ...]) -> DataFrame:
    """A records source may never deliver a session domain."""
    return signals.filter(~F.col("domain").isin(*session_domains))


# -------------------------------------------------------------- sealing and erasure ---
def seal(payload: Column, key: Column, bound_to: Column) -> Column:
    """AES-GCM with a fresh nonce; the pid is authenticated data, so a moved blob will not open."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), bound_to)


def unseal(blob: Column, key: Column, bound_to: Column) -> Column:
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to).cast("string")


def erase(table: DataFrame, pids: DataFrame) -> DataFrame:
    return table.join(pids.select("pid").distinct(), "pid", "left_anti")


def purge(table: DataFrame, current_epoch: str, cutoff: date) -> DataFrame:
    """Rows of the current salt epoch that are not older than the cut-off."""
    return table.filter((F.col("epoch_label") == current_epoch)
                        & (F.col("created_on") >= F.lit(cutoff)))


def resolve_identities(requests: DataFrame, identities: DataFrame, current: str) -> DataFrame:
    live = identities.filter(F.col("epoch_label") == current)
    return requests.join(live, "pid", "left")


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Last write wins per key, by a window that keeps one row of each group.

    Spark limits each group before the shuffle (window group limit, 3.5+), so a hot key ships one
    row per task.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
