"""Who may see what: grants, unit scope and the disclosure decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import FORBIDDEN_PURPOSES, GRANTS, UNIT_SCOPED_ROLES
from vigilframe.functions.scalar import lookup
from vigilframe.session import materialised
from vigilframe.sources import commit_log

NOT_RECORDED = "the grant is not in the ledger; nothing is disclosed without a record"
NO_RESOLUTION = "pid could not be resolved (expired salt epoch, or unknown pid)"


def actor() -> Column:
    return F.concat("role", F.lit(":"), "operator")


def authorise(requests: DataFrame) -> DataFrame:
    """requests: (role, operator, purpose, unit_id, unit_scope ARRAY<STRING>).

    Adds ``access`` (identify, aggregate, denied) and ``denied_because``.  The grant table is a
    dozen constants and becomes a CASE.
    """
    pair = F.concat("role", F.lit("|"), "purpose")
    grant = lookup({f"{r}|{p}": ("identify" if may else "aggregate")
                    for (r, p), may in GRANTS.items()}, pair)
    scope = F.coalesce("unit_scope", F.array().cast("array<string>"))
    shown = F.concat(F.lit("["), F.array_join(F.transform(
        F.array_sort(scope), lambda u: F.concat(F.lit("'"), u, F.lit("'"))), ", "), F.lit("]"))
    refusal = (
        F.when(F.col("purpose").isin(*FORBIDDEN_PURPOSES), F.concat(
            F.lit("purpose '"), "purpose", F.lit(
                "' is barred for every role. Outputs of this system are not available to ACR, "
                "promotion, posting or disciplinary processes.")))
        .when(grant.isNull(), F.concat(
            F.lit("role '"), "role", F.lit("' has no grant for purpose '"), "purpose", F.lit("'")))
        .when(F.col("role").isin(*UNIT_SCOPED_ROLES) & (F.size(scope) == 0), F.concat(
            actor(), F.lit(" has no unit scope. A "), "role", F.lit(
                " acts for named units; an empty scope is no authority, not universal authority.")))
        .when((F.col("unit_id") != "") & (F.size(scope) > 0)
              & ~F.array_contains(scope, F.col("unit_id")), F.concat(
                  actor(), F.lit(" is not responsible for "), "unit_id", F.lit("; scope is "), shown)))
    return requests.withColumn("denied_because", refusal).withColumn(
        "access", F.when(F.col("denied_because").isNotNull(), "denied").otherwise(grant))


def decide(requests: DataFrame, consent: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every reason not to release a name, in order; the first one that holds is the answer.

    The lookups are equi-joins on pid.  No identity is read here: what comes out is what the ledger
    records, before the directory is asked.
    """
    asked = authorise(requests)
    facts = (
        asked.join(consent.select("pid", "status", "welfare_contact"), "pid", "left")
        .join(verdicts.select("pid", "decision", "composite"), "pid", "left"))
    decision = F.coalesce("decision", F.lit("CLEARED"))
    status = F.coalesce("status", F.lit("NOT_ENROLLED"))
    logged = (
        F.when(F.col("access") == "denied", F.lit(None).cast("string"))
        .when(F.col("access") == "aggregate", "aggregate-only grant")
        .when(status.isin("NOT_ENROLLED", "REVOKED"), "no consent basis")
        .when((F.col("purpose") != "welfare:acute") & ~F.col("welfare_contact"),
              "welfare contact not consented")
        .when(~decision.isin("ESCALATE", "IMMEDIATE_ESCALATE"),
              F.concat(F.lit("verdict is "), decision)))
    told = (
        F.when(F.col("access") == "denied", F.col("denied_because"))
        .when(F.col("log_reason") == "aggregate-only grant", F.concat(
            actor(), F.lit(" may act for '"), "purpose", F.lit("' but only on aggregate data")))
        .when(F.col("log_reason") == "no consent basis", "no consent basis for this pid")
        .when(F.col("log_reason") == "welfare contact not consented",
              "consent does not extend to welfare contact")
        .when(F.col("log_reason").isNotNull(), F.concat(
            F.lit("a "), decision, F.lit(" verdict does not disclose an identity"))))
    out = facts.withColumn("log_reason", logged).withColumn("refused_because", told)
    allowed = (F.col("access") != "denied") & F.col("log_reason").isNull()
    # a granted attempt is logged before the directory is asked, even if nothing resolves
    return out.withColumn("action", F.when(allowed, "disclosure.granted").when(
        F.col("access") != "denied", "disclosure.denied"))


def resolve(decided: DataFrame, committed: DataFrame, directory: DataFrame) -> DataFrame:
    """The directory, joined to granted requests whose ledger row is committed, and to nothing else.

    committed: (seq) of the ledger rows that were read back from the ledger.
    """
    recorded = committed.select("seq", F.lit(True).alias("recorded")).distinct()
    rows = decided.join(recorded, "seq", "left")
    granted = F.col("action") == "disclosure.granted"
    asked = rows.where(granted & F.col("recorded")).select("seq", "pid").join(directory, "pid").select("seq", "identity")
    out = rows.join(asked, "seq", "left")
    return out.withColumns({
        "granted": granted & F.col("identity").isNotNull(),
        "refused_because": F.when(granted & F.col("recorded").isNull(), NOT_RECORDED)
        .when(granted & F.col("identity").isNull(), NO_RESOLUTION).otherwise(F.col("refused_because")),
    }).drop("recorded")


def disclose(requests: DataFrame, consent: DataFrame, verdicts: DataFrame, directory: DataFrame,
             ledger: str, batch: int = 0) -> DataFrame:
    """Decide, record, and only then look anybody up.

    The decisions are written once; their ledger rows go to the commit log at ``ledger``, and the
    directory meets the grants that are read back from there.  A ledger that cannot be written raises
    before the directory is read; one that was written in part is not committed and releases nobody.
    """
    decided = materialised(decide(requests, consent, verdicts), "decided")
    commit_log.append(ledger_rows(decided, "seq"), ledger, batch)
    committed = commit_log.committed(requests.sparkSession, ledger).where(
        (F.col("batch") == batch) & (F.col("action") == "disclosure.granted"))
    return resolve(decided, committed, directory)


def ledger_rows(decided: DataFrame, *keys: str) -> DataFrame:
    """What a batch of disclosure requests appends to the ledger: grants and logged refusals."""
    return decided.filter(F.col("action").isNotNull()).select(
        *keys, actor().alias("actor"), "action", F.col("pid").alias("subject_pid"), "unit_id", "purpose",
        F.coalesce("log_reason", F.lit("")).alias("reason"))
