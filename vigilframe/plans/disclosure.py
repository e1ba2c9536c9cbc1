"""Queries about who may see what, what leaves the system, and the record of it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilframe.config import DOMAINS, FORBIDDEN_PURPOSES
from vigilframe.functions.scalar import laplace, lookup, strings
from vigilframe.operators import access, accumulator, consent, deviation, ledger, release
from vigilframe.plans.registry import Registry, r9
from vigilframe.plans.screening import night_of
from vigilframe.session import materialised, written_folder
from vigilframe.sources import tables as T

QUERIES = Registry()
CFG, AS_OF = T.EVENTS_CONFIG, T.EVENTS_AS_OF
SECRET = "release key"
ROLES = {"1-URGENT": "welfare_officer", "2-HIGH": "mental_health_authority",
         "3-MEDIUM": "commander", "4-NOT SPECIFIED": "personnel", "5-LOW": "auditor"}
PURPOSES = ("welfare:screening", "welfare:contact", "welfare:acute", "welfare:self",
            "command:aggregate", "governance:audit", *FORBIDDEN_PURPOSES[:3])


def requests(spark, folder):
    """orders -> disclosure requests: priority is the role, price band the purpose."""
    purpose = F.element_at(strings(PURPOSES), (F.least(
        F.lit(8), F.floor(F.col("o_totalprice") / 60000)) + 1).cast("int"))
    unit = F.concat(F.lit("U"), (F.col("o_custkey") % 10).cast("string"))
    other = F.concat(F.lit("U"), (F.col("o_orderkey") % 10).cast("string"))
    scope = (F.when(F.col("o_orderstatus") == "F", F.array(other, F.lit("U1")))
             .when(F.col("o_orderstatus") == "P", F.array(unit)).otherwise(strings(())))
    return T.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("pid"),
        lookup(ROLES, F.col("o_orderpriority")).alias("role"),
        F.concat(F.lit("op"), F.floor(F.col("o_totalprice") / 100000).cast("string"))
        .alias("operator"), purpose.alias("purpose"), unit.alias("unit_id"),
        scope.alias("unit_scope"))


@QUERIES.query
def access_decisions(spark, folder):
    return access.authorise(requests(spark, folder)).select(
        "seq", "role", "purpose", "access", F.coalesce("denied_because", F.lit("")).alias("because"))


def decided(spark, folder):
    directory = T.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), F.col("c_name").alias("identity"))
    return access.disclose(requests(spark, folder), T.consent_states(spark, folder),
                           night_of(spark, folder).verdicts, directory,
                           f"{written_folder(spark)}/disclosures-{uuid.uuid4().hex}")


@QUERIES.query
def disclosure_decisions(spark, folder):
    return decided(spark, folder).select(
        "seq", "pid", "granted", F.coalesce("identity", F.lit("")).alias("identity"),
        F.coalesce("refused_because", F.lit("")).alias("because"))


@QUERIES.query
def disclosure_log(spark, folder):
    """Grants and refusals as the ledger keeps them."""
    rows = access.ledger_rows(decided(spark, folder))
    return rows.groupBy("actor", "action", "purpose", "reason").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------ release ---
def gated_cases(spark, folder):
    """Every case with its gate values; cleared people have none."""
    night = night_of(spark, folder)
    quiet = deviation.cleared(night.profile, night.deviations).withColumn(
        "composite", F.lit(0.0))
    keep = ("pid", "unit_id", "decision", "composite", "evidence", "consistency", "persistence",
            "actionability", "consented")
    return night.verdicts.select(*keep).unionByName(quiet, allowMissingColumns=True)


@QUERIES.query
def unit_view(spark, folder):
    """k-anonymous unit aggregates, noise switched off."""
    values = release.unit_series(gated_cases(spark, folder))
    out = release.redacted(release.exact(release.cells(values, ["unit_id", "label"], CFG)))
    return out.select("unit_id", "label", F.coalesce("n", F.lit(0)).alias("n"),
                      r9("value"), "suppressed", "reason")


@QUERIES.query
def unit_view_private(spark, folder):
    """The same view with keyed noise, within each unit's budget."""
    values = release.unit_series(gated_cases(spark, folder))
    checked = release.cells(values, ["unit_id", "label"], CFG)
    kept = release.within_budget(checked, ["unit_id"], "label", CFG.but(epsilon_total=5.0))
    out = release.redacted(release.noised(kept, ["unit_id", "label"], AS_OF, SECRET, CFG))
    return out.select("unit_id", "label", "n", "value", "suppressed", "spent")


@QUERIES.query
def budget_carried(spark, folder):
    """The same cells asked for again in the same period: the second release starts where the first stopped."""
    checked = materialised(release.cells(release.unit_series(gated_cases(spark, folder)), ["unit_id", "label"], CFG), "cells")
    first = release.within_budget(checked, ["unit_id"], "label", CFG.but(epsilon_total=5.0))
    second = release.within_budget(checked, ["unit_id"], "label", CFG.but(epsilon_total=7.0),
                                   release.charged(first, ["unit_id"]))
    return second.select("unit_id", "label", "suppressed", r9("spent"))


@QUERIES.query
def heat_map(spark, folder):
    sub_unit = release.company(F.col("pid").cast("bigint") % 4)
    values = release.heat_series(gated_cases(spark, folder), sub_unit, CFG)
    out = release.redacted(release.exact(
        release.cells(values, ["unit_id", "sub_unit", "domain"], CFG.but(k_min=2))))
    return out.select("unit_id", "sub_unit", "domain", F.coalesce("n", F.lit(0)).alias("n"),
                      r9("value"), "suppressed",
                      release.band(F.col("value"), F.col("suppressed")).alias("band"))


@QUERIES.query
def release_log(spark, folder):
    values = release.unit_series(gated_cases(spark, folder))
    out = release.exact(release.cells(values, ["unit_id", "label"], CFG.but(k_min=12)))
    return release.release_log(out, "unit_id", CFG).select(
        "unit_id", "cells", "suppressed", r9("epsilon"), "action")


@QUERIES.query
def laplace_noise(spark, folder):
    """Inverse-CDF noise at every event's own quantile."""
    u = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("value") / 500))
    return T.read(spark, folder, "events").groupBy("event_type").agg(
        F.sum(laplace(F.lit(2.0), u)).alias("s"), F.max(laplace(F.lit(2.0), u)).alias("top")
    ).select("event_type", F.round("s", 6).alias("s"), F.round("top", 6).alias("top"))


def questions(spark, folder):
    return T.read(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("seq"),
        F.concat("o_orderpriority", F.lit("|"), F.floor(F.col("o_totalprice") / 50000)).alias(
            "label"), F.col("o_orderstatus").alias("status"))


@QUERIES.query
def budget_use(spark, folder):
    return release.budget_report(questions(spark, folder), "period", CFG).select(
        "period", "asked", "admitted", "refused", r9("spent"), r9("remaining"))


@QUERIES.query
def budget_admissions(spark, folder):
    """The questions each period still answered, in order of arrival."""
    return release.admitted(questions(spark, folder), "period", "seq", CFG).select(
        "period", "seq", F.col("rank").cast("bigint").alias("position"))


@QUERIES.query
def release_cache(spark, folder):
    asked = questions(spark, folder)
    released = asked.filter("status = 'P'").select("period", "label").distinct()
    return release.cache_use(asked.filter("status <> 'P'"), released, ["period", "label"])


@QUERIES.query
def new_questions(spark, folder):
    asked = questions(spark, folder)
    return release.new_questions(asked.filter("status = 'O'"), asked.filter("status = 'F'"),
                                 ["period", "label"])


# ------------------------------------------------------------------------------- ledger ---
def entries(spark, folder):
    return T.read(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.lit("system:gate_engine").alias("actor"), F.col("event_type").alias("action"),
        F.col("user_id").cast("string").alias("subject_pid"),
        F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("unit_id"),
        F.lit("welfare:screening").alias("purpose"),
        F.create_map(F.lit("cents"), F.round(F.col("value") * 100).cast("bigint").cast("string"))
        .alias("detail"))


@QUERIES.query
def ledger_chain(spark, folder):
    """Every entry sealed into its segment's chain."""
    return ledger.seal(entries(spark, folder)).select("segment", "seq", "prev_hash", "entry_hash")


@QUERIES.query
def ledger_heads(spark, folder):
    return ledger.heads(ledger.seal(entries(spark, folder)))


def sealed_log(spark, folder):
    """The sealed entries, their heads, the number of segments and the nodes over them."""
    sealed = ledger.seal(entries(spark, folder))
    heads = materialised(ledger.heads(sealed), "heads")
    size = heads.count()
    return sealed, heads, size, materialised(accumulator.accumulate(heads, size), "nodes")


@QUERIES.query
def ledger_tree(spark, folder):
    """Every complete node over the segments."""
    return sealed_log(spark, folder)[3].select("level", "idx", "hash")


def all_seals(spark, folder):
    _, heads, size, nodes = sealed_log(spark, folder)
    return heads, size, nodes, materialised(
        accumulator.seals(heads, nodes, spark.range(1, size + 1).withColumnRenamed("id", "size")), "seals")


@QUERIES.query
def ledger_seals(spark, folder):
    """The root after every segment."""
    return all_seals(spark, folder)[3].select("size", "root")


@QUERIES.query
def ledger_consistency(spark, folder):
    """Whether later roots only appended to earlier ones; every third earlier root is that of another log."""
    heads, size, nodes, seals = all_seals(spark, folder)
    pairs = spark.range(1, size).select(F.col("id").alias("before"), F.least(
        F.col("id") + 1 + F.col("id") % 7, F.lit(size)).cast("bigint").alias("size"))
    told = pairs.withColumn("of", F.when(F.col("before") % 3 == 0, F.col("before") + 1).otherwise(F.col("before")))
    claims = told.join(seals.select(F.col("size").alias("of"), F.col("root").alias("root_before")), "of").join(
        seals.select("size", "root"), "size").select("before", "size", "root_before", "root")
    return accumulator.consistent(accumulator.proofs(heads, nodes, pairs), claims)


@QUERIES.query
def ledger_verification(spark, folder):
    """Breaks found after entries were rewritten and removed, one whole segment was removed with its
    head and another replaced by a forgery that is sealed anew; only the last root is trusted."""
    sealed, heads, size, nodes = sealed_log(spark, folder)
    last = accumulator.seals(heads, nodes, spark.createDataFrame([(size,)], "size bigint")).first()
    segment = F.col("segment")
    price = F.element_at("detail", "cents").cast("bigint")
    tampered = sealed.withColumn("detail", F.when(
        price > 48000, F.create_map(F.lit("cents"), F.lit("0"))).otherwise(F.col("detail")))
    forged = ledger.seal(entries(spark, folder).withColumn(
        "detail", F.create_map(F.lit("cents"), F.lit("1")))).filter(segment == 1)
    left = tampered.filter((price != 1234) & ~segment.isin(1, 2)).unionByName(forged)
    return ledger.audit(left, nodes, size, last.peaks, last.root)


@QUERIES.query
def ledger_reads(spark, folder):
    """Entries per person and action."""
    log = entries(spark, folder)
    return ledger.for_action(log, "error").groupBy("subject_pid").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@QUERIES.query
def ledger_latest(spark, folder):
    """The audit screen: the last 200 entries."""
    return ledger.latest(entries(spark, folder), 200).select("seq", "at", "action", "subject_pid")


# ------------------------------------------------------------------------------ consent ---
def consent_events(spark, folder):
    band = F.least(F.lit(8), F.floor(F.col("o_totalprice") / 60000)).cast("int")
    picked = F.element_at(strings(DOMAINS), band + 1)
    others = F.array_except(strings(DOMAINS), F.array(picked))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = (F.when(p == "1-URGENT", "enrol").when(p == "2-HIGH", "narrow")
            .when(p == "3-MEDIUM", "widen").when(p == "4-NOT SPECIFIED", "set_contact")
            .when(s == "F", "revoke").when(s == "P", "complete").otherwise("enrol"))
    named = (F.when(p == "1-URGENT", others).when(p == "5-LOW", strings(DOMAINS))
             .otherwise(F.array(picked)))
    return T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"),
        kind.alias("kind"), named.alias("domains"), (s != "O").alias("contact"))


@QUERIES.query
def consent_latest(spark, folder):
    return consent.fold(consent_events(spark, folder), DOMAINS).select(
        "pid", "status", F.array_join(F.array_sort("scope"), ",").alias("scope"),
        "welfare_contact")


@QUERIES.query
def consent_enrolled(spark, folder):
    return consent.enrolled(consent.fold(consent_events(spark, folder), DOMAINS)).select(
        "pid", "status")


@QUERIES.query
def consent_revocations(spark, folder):
    return consent.revocations_for_auditor(consent_events(spark, folder))


@QUERIES.query
def forgotten_rows(spark, folder):
    """What remains of receipts, journal and alerts once withdrawn people are forgotten."""
    events = consent_events(spark, folder)
    journal = T.read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("pid"), F.lit("journal").alias("kind"),
        F.col("event_id").alias("seq"))
    orders = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("delivered_at"))
    receipts = events.filter("kind = 'enrol'").select("pid", F.lit("receipts").alias("kind"), "seq")
    left = consent.forget({"journal": journal, "receipts": receipts, "alerts": orders.withColumn(
        "kind", F.lit("alerts"))}, events)
    rows = left["journal"].unionByName(left["receipts"]).unionByName(
        left["alerts"].drop("delivered_at"))
    return rows.groupBy("kind", "pid").agg(F.count("*").alias("n"))


def catalogue(spark, folder):
    """documents -> one consent text per language, all its documents in any order.

    The content hash is over sums of the documents' hashes, cut into numbers: they merge map-side.
    """
    status = {"en": "source", "fr": "reviewed", "de": "draft", "es": "reviewed"}
    name = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
    parts = [F.sum(F.conv(F.substring(F.sha2("text", 256), 1 + 15 * k, 15), 16, 10)
                   .cast("decimal(20,0)")).cast("string") for k in range(4)]
    texts = T.read(spark, folder, "documents").filter("lang IS NOT NULL").groupBy("lang").agg(
        F.concat(F.lit("v"), F.count_distinct("source").cast("string")).alias("text_version"),
        F.sha2(F.concat_ws(".", *parts), 256).alias("content_hash"))
    return texts.select(F.col("lang").alias("locale"), "text_version", "content_hash",
                        lookup(status, F.col("lang")).alias("review_status"),
                        lookup(name, F.col("lang")).alias("english_name"))


def asked(spark, folder):
    # there is no Italian text
    locale = {"BUILDING": "es", "FURNITURE": "fr", "MACHINERY": "de", "HOUSEHOLD": "it"}
    return T.read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("pid"), F.col("c_acctbal"),
        lookup(locale, F.col("c_mktsegment"), F.lit("en")).alias("locale"))


@QUERIES.query
def consent_receipts(spark, folder):
    out = consent.receipts(asked(spark, folder), catalogue(spark, folder))
    return out.select("pid", "locale",
                      F.when(F.col("refused_because").isNull(), F.col("text_version"))
                      .otherwise("").alias("text_version"),
                      F.coalesce("refused_because", F.lit("")).alias("because"))


@QUERIES.query
def consent_capable_locales(spark, folder):
    return consent.consent_locales(catalogue(spark, folder)).select(
        "locale", "text_version", "content_hash", "review_status")


@QUERIES.query
def reconsent(spark, folder):
    texts = catalogue(spark, folder)
    old = F.col("c_acctbal") < 1000
    held = consent.receipts(asked(spark, folder), texts).filter("refused_because IS NULL").select(
        "pid", "locale", F.when(old, "v0").otherwise(F.col("text_version")).alias("text_version"),
        "content_hash")
    return consent.reconsent(held, texts, T.consent_states(spark, folder))
