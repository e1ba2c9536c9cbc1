"""Consent as an event log folded to its latest state, receipts and re-consent.

A person's scope is decided per domain by the last event that touched the domain, so the fold is an
ordinary aggregate with map-side combining, not a sequential pass over a person's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANTING = ("source", "reviewed")


def fold(events: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """events: (pid, seq, kind, domains ARRAY<STRING>, contact BOOLEAN) -> latest consent state.

    kind: enrol, narrow, widen, set_contact, revoke, complete.
    """
    kind = F.col("kind")
    resets = kind.isin("enrol", "revoke", "complete")

    def last(condition: Column, value: Column) -> Column:
        return F.max_by(F.when(condition, value), F.when(condition, F.col("seq")))

    aggs = []
    for domain in domains:
        named = F.array_contains("domains", domain)
        touches = resets | (kind.isin("narrow", "widen") & named)
        granted = (kind.isin("enrol", "widen")) & named
        aggs.append(last(touches, granted).alias(f"d_{domain}"))
    sets_contact = resets | (kind == "set_contact")
    contact = (kind.isin("enrol", "set_contact")) & F.coalesce("contact", F.lit(False))
    state = events.groupBy("pid").agg(
        *aggs, last(sets_contact, contact).alias("welfare_contact"),
        F.max_by(kind == "revoke", "seq").alias("withdrawn"), F.max("seq").alias("seq"))
    scope = F.filter(F.array(*[F.when(F.col(f"d_{d}"), F.lit(d)) for d in domains]),
                     lambda d: d.isNotNull())
    size = F.size("scope")
    status = (F.when(F.col("withdrawn"), "REVOKED")
              .when(size == 0, "NOT_ENROLLED").when(size == len(domains), "ACTIVE")
              .otherwise("PARTIAL"))
    return state.withColumn("scope", scope).select(
        "pid", status.alias("status"), "scope",
        F.coalesce("welfare_contact", F.lit(False)).alias("welfare_contact"), "seq")


def enrolled(states: DataFrame) -> DataFrame:
    return states.filter(F.col("status").isin("ACTIVE", "PARTIAL"))


def revocations_for_auditor(events: DataFrame) -> DataFrame:
    """Rows only; no count or rate is offered."""
    return events.filter(F.col("kind") == "revoke").select("pid", "seq")


def forget(tables: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """Drop receipts, undelivered alerts and journal rows from before a person's last withdrawal.

    A withdrawal erases when it happens: completing afterwards brings nothing back, and what
    follows a new enrolment is kept.  ``events`` and the tables are ordered by ``seq``.
    """
    gone = events.filter(F.col("kind") == "revoke").groupBy("pid").agg(
        F.max("seq").alias("_erased"))
    out = {}
    for name, table in tables.items():
        erased = F.coalesce(F.col("seq") < F.col("_erased"), F.lit(False))
        if name == "alerts":
            erased = erased & F.col("delivered_at").isNull()
        out[name] = table.join(gone, "pid", "left").filter(~erased).drop("_erased")
    return out


# --------------------------------------------------------------------------- receipts ---
def consent_locales(locales: DataFrame) -> DataFrame:
    return locales.filter(F.col("review_status").isin(*GRANTING))


def receipts(requests: DataFrame, locales: DataFrame, pilot: bool = False) -> DataFrame:
    """requests: (pid, locale, ...) -> receipt rows, or the reason none can be given."""
    out = requests.join(locales, "locale", "left")
    unknown = F.col("review_status").isNull()
    draft = ~F.col("review_status").isin(*GRANTING) & F.lit(not pilot)
    refusal = (
        F.when(unknown, F.concat(
            F.lit("no consent text for locale '"), "locale", F.lit(
                "'. It is not offered, and the system will not substitute another language.")))
        .when(draft, F.concat(
            F.lit("the "), "english_name", F.lit(" translation is marked '"), "review_status",
            F.lit("' and has not been checked by a native speaker. Consent cannot be recorded "
                  "against it. Offer a reviewed language instead."))))
    return out.withColumn("refused_because", refusal)


def reconsent(receipt_rows: DataFrame, locales: DataFrame, states: DataFrame) -> DataFrame:
    """Who has to be asked again because the text moved under them."""
    current = locales.select("locale", F.col("text_version").alias("now_version"),
                             F.col("content_hash").alias("now_hash"), "english_name")
    held = receipt_rows.select("pid", "locale", "text_version", "content_hash").join(
        current, "locale", "left")
    out = states.select("pid", "status").join(held, "pid", "left")
    none = F.col("text_version").isNull()
    off = ~F.col("status").isin("ACTIVE", "PARTIAL")
    same = ((F.col("text_version") == F.col("now_version"))
            & (F.col("content_hash") == F.col("now_hash")))
    return out.select(
        "pid",
        F.when(none, ~off).otherwise(~F.coalesce(same, F.lit(False))).alias("ask_again"),
        F.when(none & off, "not enrolled")
        .when(none, "no receipt was recorded for this consent")
        .when(same, "consent matches the current text")
        .otherwise(F.concat(
            F.lit("the "), "english_name",
            F.lit(" consent text has changed since this person agreed (they read "), "text_version",
            F.lit(", current is "), "now_version",
            F.lit("); they must be asked again rather than carried over"))).alias("why"))
