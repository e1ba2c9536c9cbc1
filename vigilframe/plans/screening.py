"""Queries from the raw extract to the verdict, over ``events`` and ``lineitem``."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from vigilframe.operators import cases as case_ops
from vigilframe.operators import deviation, features, protect, rhythm, views
from vigilframe.operators import gates as gate_ops
from vigilframe.operators import reviewers as panel
from vigilframe.operators.verdicts import decide, illegal_transitions
from vigilframe.plans.nightly import all_cases, last_year, nightly, screen
from vigilframe.plans.registry import Registry, day, joined, r9
from vigilframe.session import materialised, written_folder
from vigilframe.sources import connectors
from vigilframe.sources import tables as T

QUERIES = Registry()
CFG, AS_OF = T.EVENTS_CONFIG, T.EVENTS_AS_OF
SECRET = "registered query secret"


def covered(spark, folder):
    return protect.consent_filter(T.event_signals(spark, folder), T.consent_states(spark, folder))


def daily_of(spark, folder):
    return features.daily_series(
        features.in_history(T.event_signals(spark, folder), AS_OF, CFG.history_days),
        T.consent_states(spark, folder))


def profile_of(spark, folder):
    return screen(T.event_signals(spark, folder), AS_OF, CFG, T.consent_states(spark, folder))[1]


def deviations_of(spark, folder):
    profile = profile_of(spark, folder)
    return deviation.deviations(profile, CFG)


def night_of(spark, folder, detail=False):
    return nightly(T.event_signals(spark, folder), T.consent_states(spark, folder), AS_OF, CFG,
                   detail=detail)


# --------------------------------------------------------------------- raw extracts ---
def checked(spark, folder):
    return protect.validate(T.raw_event_rows(spark, folder), CFG, AS_OF, 20)


@QUERIES.query
def raw_row_validation(spark, folder):
    """Refused rows by domain and reason."""
    rows = checked(spark, folder).filter("reject_reason IS NOT NULL")
    return rows.groupBy("domain", "reject_reason").agg(F.count("*").alias("n"))


@QUERIES.query
def accepted_records(spark, folder):
    """Typed, scaled and clamped rows inside the period."""
    rows = protect.accepted(checked(spark, folder))
    return rows.groupBy("service_number", "unit_id", "domain", F.to_date("observed_at").alias("d")
                        ).agg(F.count("*").alias("n"), F.sum("value").alias("total"),
                              F.max("value").alias("top")).select(
        "service_number", "unit_id", "domain", day("d"), "n", r9("total"), r9("top"))


@QUERIES.query
def source_completeness(spark, folder):
    """Rows against the roster's expectation, per source, including a source with no file."""
    people = T.read(spark, folder, "events").agg(F.count_distinct("user_id").alias("people"))
    rates = {"self_report": 0.5, "workload": 1.0, "duty_roster": 2.0, "leave": 3.0,
             "training": 4.0, "biometric": 1.0}
    names = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in rates.items()]))
    expected = people.select("people", F.explode(names).alias("domain", "rate")).select(
        "domain", protect.roster_expectation(F.col("people"), 20, F.col("rate")).alias(
            "expected_rows"), (F.col("domain") != "biometric").alias("available"))
    out = protect.source_status(checked(spark, folder), expected)
    return out.select("domain", "expected_rows", "rows", "rejected", "out_of_window",
                      r9("missing_fraction"), "status")


# --------------------------------------------------------------------- connectors ---
def pulled(spark, folder, days):
    """``events`` written as one delimited extract per domain, each in its own dialect, and pulled back."""
    rows = T.raw_event_rows(spark, folder).withColumn(
        "loaded", F.coalesce(F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))), F.lit(AS_OF)))
    rows = materialised(rows, "raw-extract")
    where = f"{written_folder(spark)}/extracts-{uuid.uuid4().hex}"
    found = connectors.Registry()
    for i, domain in enumerate(sorted(CFG.domain_scale)):
        connector = connectors.DelimitedFolder(domain, f"{where}/{domain}", ",;|\t"[i % 4], {
            "service_no": f"id_{i}", "value": f"reading_{i}"} if i % 2 else {})
        connectors.write_extract(rows.where(F.col("domain") == domain), connector)
        found.register(domain, connector)
    return connectors.pull(spark, found, CFG, AS_OF, days, 150, quarantine=f"{where}/quarantine")


@QUERIES.query
def extract_accepted(spark, folder):
    """What the connectors accept of the period: the rows that ``accepted_records`` finds in the table."""
    return pulled(spark, folder, 20).signals.groupBy(
        "service_number", "unit_id", "domain", F.to_date("observed_at").alias("d")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")).select(
        "service_number", "unit_id", "domain", day("d"), "n", r9("total"), r9("top"))


@QUERIES.query
def extract_quarantine(spark, folder):
    """Refused rows by domain and reason, from the quarantine."""
    return pulled(spark, folder, 30).refused.groupBy("domain", "reject_reason").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ privacy at ingest ---
@QUERIES.query
def pseudonyms(spark, folder):
    """Every person's pseudonym and what the old identifier has become."""
    people = T.read(spark, folder, "events").groupBy(
        F.col("user_id").cast("string").alias("service_number")).agg(F.count("*").alias("n"))
    pid = protect.pseudonym(F.col("service_number"), SECRET, AS_OF, CFG)
    again = protect.pseudonym(F.trim("service_number"), SECRET, AS_OF, CFG)
    return people.select("service_number", pid.alias("pid"), "n",
                         (pid == again).alias("verified"))


@QUERIES.query
def pseudonym_epochs(spark, folder):
    """Salt epochs over the order book, negative ones included."""
    days = T.read(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("n"))
    out = protect.epochs(days, CFG)
    return out.groupBy("epoch", "epoch_label", "epoch_start", "epoch_end").agg(
        F.sum("n").alias("n")).select("epoch", "epoch_label", day("epoch_start"),
                                      day("epoch_end"), "n")


@QUERIES.query
def consent_filter(spark, folder):
    """What survives the consent boundary, per person and domain."""
    return covered(spark, folder).groupBy("pid", "domain").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(
        "pid", "domain", "n", r9("total"))


@QUERIES.query
def normalise_report(spark, folder):
    """Rows in, rows out and both drop counts, per domain."""
    return protect.normalise_report(protect.consent_outcome(
        T.event_signals(spark, folder), T.consent_states(spark, folder)))


@QUERIES.query
def checked_signals(spark, folder):
    """Range assertion and domain routing over every signal."""
    rows = protect.record_domains_only(
        protect.assert_range(T.event_signals(spark, folder)), ("voice",))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.min("value").alias("low"),
                                      F.max("value").alias("high")).select(
        "domain", "n", r9("low"), r9("high"))


@QUERIES.query
def sealed_payloads(spark, folder):
    """Sealed payloads open for their own person and for nobody else."""
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    rows = T.read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("pid"), F.col("event_type"),
        F.to_json(F.struct("event_id", "value")).alias("payload"))
    # the nonce is fresh per evaluation, so the blob is read once per row
    opened = rows.withColumn("blob", protect.seal(F.col("payload"), key, F.col("pid"))).select(
        "event_type", "payload",
        protect.unseal(F.col("blob"), key, F.col("pid")).alias("own"),
        protect.unseal(F.col("blob"), key, F.concat(F.col("pid"), F.lit("x"))).alias("other"))
    return opened.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("own") == F.col("payload")).alias("opened"),
        F.count_if(F.col("other").isNotNull()).alias("opened_by_others"))


@QUERIES.query
def identity_lookup(spark, folder):
    """Identities resolve only while their salt epoch is current."""
    orders = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.to_date("o_orderdate").alias("day"))
    first = orders.groupBy("pid").agg(F.min("day").alias("day"), F.count("*").alias("n"))
    seen = protect.epochs(first, CFG)
    identities = seen.select("pid", "epoch_label", F.lit(True).alias("found"))
    current = f"E{(date(1995, 3, 1) - date(2026, 1, 1)).days // CFG.salt_days:04d}"
    return protect.resolve_identities(seen.select("pid", "n"), identities, current).select(
        "pid", "n", F.coalesce("found", F.lit(False)).alias("resolved"))


@QUERIES.query
def erase_and_purge(spark, folder):
    """Rows left after erasing withdrawn people and purging old epochs."""
    orders = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.to_date("o_orderdate").alias("day"),
        F.to_date("o_orderdate").alias("created_on"))
    withdrawn = T.consent_states(spark, folder).filter("status = 'REVOKED'")
    left = protect.epochs(protect.erase(orders, withdrawn), CFG)
    kept = protect.purge(left, "E-117", date(1997, 3, 15))
    return left.groupBy("epoch_label").agg(F.count("*").alias("n")).join(
        kept.groupBy("epoch_label").agg(F.count("*").alias("kept")), "epoch_label", "left"
    ).na.fill(0, ["kept"])


@QUERIES.query
def latest_upsert(spark, folder):
    """Last write per person wins."""
    writes = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("state"))
    return protect.latest_by(writes, "pid", "at", "seq").select("pid", "seq", day("at"), "state")


# --------------------------------------------------------------------- feature store ---
@QUERIES.query
def daily_collapse(spark, folder):
    return daily_of(spark, folder).select("pid", "unit_id", "domain", day("day"), r9("value"),
                                          F.col("rows").alias("n_rows"))


@QUERIES.query
def personal_baseline(spark, folder):
    """Lagged window statistics and whether they are enough to compare against."""
    stats = features.window_stats(daily_of(spark, folder), AS_OF, CFG.baseline_days,
                                  CFG.baseline_lag, CFG)
    return stats.select("pid", "domain", "n", r9("mean"), r9("stdev"), r9("latest"), "usable")


@QUERIES.query
def unit_baseline(spark, folder):
    out = features.unit_baseline(profile_of(spark, folder), CFG)
    return out.select("unit_id", "domain", "unit_n", r9("unit_mean"), r9("unit_stdev"))


@QUERIES.query
def breach_fractions(spark, folder):
    """Share of elapsed days at or above the person's own breach level."""
    return profile_of(spark, folder).select(
        "pid", "domain", r9("level"), r9("breach_0"), r9("breach_1"), r9("breach_2"))


@QUERIES.query
def window_means(spark, folder):
    means = [r9(f"mean_{w}") for w in CFG.feature_windows]
    counts = [F.col(f"n_{w}") for w in CFG.feature_windows]
    return profile_of(spark, folder).select("pid", "domain", *counts, *means)


@QUERIES.query
def feature_matrix(spark, folder):
    return features.feature_matrix(profile_of(spark, folder), CFG)


@QUERIES.query
def rolling_baseline(spark, folder):
    """The lagged window evaluated for every day of history."""
    daily = features.daily_series(T.event_signals(spark, folder), T.consent_states(spark, folder))
    return features.rolling_stats(daily, 7, 3).select("pid", "domain", day("day"), "n", r9("mean"))


@QUERIES.query
def retention(spark, folder):
    """Daily rows kept and aged out, per domain."""
    cfg = CFG.but(retention_days=14)
    daily = features.daily_series(T.event_signals(spark, folder), T.consent_states(spark, folder))
    kept = features.retained(daily, AS_OF, cfg).groupBy("domain").agg(F.count("*").alias("kept"))
    return daily.groupBy("domain").agg(F.count("*").alias("n")).join(kept, "domain", "left").select(
        "domain", "kept", (F.col("n") - F.col("kept")).alias("removed"))


@QUERIES.query
def membership(spark, folder):
    return features.membership(daily_of(spark, folder)).select(
        "pid", "unit_id", joined("domains"), "observed_days")


# ----------------------------------------------------------------- deviation screening ---
def _deviation_columns(devs):
    return devs.select("pid", "unit_id", "domain", r9("z_self"), r9("z_unit"), "direction",
                       "windows_breached", "tier", "weight", r9("breach_0"), r9("breach_1"),
                       r9("breach_2"))


@QUERIES.query
def deviations(spark, folder):
    return _deviation_columns(deviations_of(spark, folder))


@QUERIES.query
def deviations_default_windows(spark, folder):
    """The published windows and cut-offs over six years of line items."""
    _, profile = screen(T.lineitem_signals(spark, folder), T.LINEITEM_AS_OF, T.LINEITEM_CONFIG)
    return _deviation_columns(deviation.deviations(profile, T.LINEITEM_CONFIG))


@QUERIES.query
def seasonal_deviations(spark, folder):
    """Line-item deviations that also stood out in the same window one year before."""
    cfg = T.LINEITEM_CONFIG.but(z_self=0.5, z_unit=0.5)
    signals = T.lineitem_signals(spark, folder)
    everyone = signals.select("pid").distinct().withColumns(
        {"status": F.lit("ACTIVE"), "scope": F.array(*[F.lit(d) for d in cfg.domains])})
    _, profile = screen(signals, T.LINEITEM_AS_OF, cfg)
    devs = deviation.deviations(profile, cfg)
    earlier = last_year(signals, everyone, T.LINEITEM_AS_OF, cfg)
    flags = case_ops.calendar_flags(
        devs, case_ops.seasonal_entries(devs, earlier, T.LINEITEM_AS_OF), T.LINEITEM_AS_OF)
    return flags.filter("seasonal").select("pid", "domain")


@QUERIES.query
def missingness(spark, folder):
    """Deviations with the shortfall their source reported."""
    people = T.read(spark, folder, "events").agg(F.count_distinct("user_id").alias("people"))
    expected = people.select(F.explode(F.array(*[F.lit(d) for d in CFG.domains])).alias("domain"),
                             (F.col("people") * 15).alias("expected_rows"),
                             F.lit(True).alias("available"))
    shortfall = protect.source_status(checked(spark, folder), expected)
    devs = deviation.deviations(profile_of(spark, folder), CFG, shortfall)
    return devs.groupBy("domain", "missing").agg(F.count("*").alias("n")).select(
        "domain", r9("missing"), "n")


@QUERIES.query
def candidates_and_cleared(spark, folder):
    """Everyone screened: deviating or cleared."""
    profile = profile_of(spark, folder)
    devs = deviation.deviations(profile, CFG)
    quiet = deviation.cleared(profile, devs)
    return deviation.candidates(devs).withColumn("decision", F.lit("DEVIATING")).unionByName(quiet)


@QUERIES.query
def unit_fractions(spark, folder):
    profile = profile_of(spark, folder)
    return deviation.unit_fractions(deviation.deviations(profile, CFG), profile).select(
        "unit_id", "domain", "cohort_size", r9("unit_fraction"))


@QUERIES.query
def deviating_by_unit(spark, folder):
    """How many people of each unit left their own lagged baseline, and in how many domains."""
    return deviations_of(spark, folder).groupBy("unit_id").agg(
        F.count_distinct("pid").alias("people"), F.count("*").alias("deviations"),
        F.count_if(F.col("direction") == "elevated").alias("elevated"))


# ------------------------------------------------------------------------------ rhythm ---
@QUERIES.query
def roster_rhythm(spark, folder):
    """Shape of the on/off pattern per person."""
    out = rhythm.rhythm(daily_of(spark, folder), AS_OF, CFG, "duty_roster")
    return out.select("pid", "observed_days", "longest_run", r9("break_adequacy"),
                      r9("block_variance"), r9("regularity"), "phrase")


# ------------------------------------------------------------------------------- gates ---
@QUERIES.query
def confounder_hits(spark, folder):
    return gate_ops.hits_long(night_of(spark, folder).verdicts).select(
        "pid", "domain", "rule", "mass", "label", "detail")


@QUERIES.query
def gate_evidence(spark, folder):
    return night_of(spark, folder).verdicts.select(
        "pid", r9("weighted_volume"), "distinct_domains", "has_t1", r9("evidence"),
        "evidence_passed", "evidence_formula")


@QUERIES.query
def gate_consistency(spark, folder):
    return night_of(spark, folder).verdicts.select(
        "pid", r9("consistency"), "consistency_passed", "n_domains", "per_domain", "confounders",
        "consistency_formula")


@QUERIES.query
def gate_persistence(spark, folder):
    return night_of(spark, folder).verdicts.select(
        "pid", r9("window_0"), r9("window_1"), r9("window_2"), r9("persistence"),
        "persistence_passed", "persistence_formula")


@QUERIES.query
def gate_actionability(spark, folder):
    return night_of(spark, folder).verdicts.select(
        "pid", joined("matched"), "has_match", "contact_ok", "capacity", r9("actionability"),
        "actionability_passed", "actionability_formula")


@QUERIES.query
def verdicts(spark, folder):
    return night_of(spark, folder).verdicts.select(
        "pid", "unit_id", "decision", "reason", joined("failed_gates"), joined("recommended"),
        r9("composite"), "config_version")


@QUERIES.query
def counterfactuals(spark, folder):
    """What would have changed each refusal, in the order it is reported."""
    rows = night_of(spark, folder, detail=True).verdicts.select(
        "pid", F.posexplode("mind_change"))
    return rows.select(
        "pid", F.col("pos").cast("bigint").alias("position"), F.col("col.gate").alias("gate"),
        r9("col.current", "current"), F.col("col.required").alias("required"),
        joined("col.failed_because", " / ", "failed_because"),
        joined("col.would_change_if", " / ", "would_change_if"),
        F.col("col.recoverable").alias("recoverable"))


@QUERIES.query
def verdicts_with_calendars(spark, folder):
    """The same run with leave, training and seasonal calendars, active actions and capacity."""
    night = night_of(spark, folder)
    orders = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), "o_orderstatus", "o_orderpriority",
        "o_totalprice")
    entries = orders.select(
        "pid", F.when(F.col("o_orderstatus") == "F", "leave").otherwise("training").alias("domain"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "leave")
        .when(F.col("o_orderpriority") == "2-HIGH", "training").otherwise("seasonal").alias("kind"),
        F.lit(AS_OF).alias("starts_on"),
        F.date_add(F.lit(AS_OF), (F.col("o_totalprice") / 50000).cast("int") - 5).alias("ends_on"))
    calendar = case_ops.calendar_flags(night.deviations, entries, AS_OF)
    active = orders.groupBy("pid").agg(
        F.when(F.max("o_totalprice") > 480000, F.array(F.lit("WLF-REST"))).otherwise(
            F.array().cast("array<string>")).alias("active_codes"))
    capacity = night.fractions.groupBy("unit_id").agg(
        (F.max("unit_fraction") < 0.4).alias("capacity"))
    context = case_ops.with_unit_context(night.deviations, night.fractions, calendar)
    cases = case_ops.build_cases(context, night.consent, capacity=capacity, active=active)
    return decide(cases, CFG, detail=False).select(
        "pid", "decision", r9("consistency"), r9("actionability"), "capacity", "confounders",
        F.coalesce("duplicate", F.lit("")).alias("duplicate"))


@QUERIES.query
def state_violations(spark, folder):
    """Order histories read as case states: moves the state table does not allow."""
    names = {"1-URGENT": "ESCALATED", "2-HIGH": "CONTACTED", "3-MEDIUM": "CLOSED",
             "4-NOT SPECIFIED": "MONITORED", "5-LOW": "OBSERVED"}
    log = T.read(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("seq"),
        T.lookup(names, F.col("o_orderpriority")).alias("state"))
    return illegal_transitions(log)


# --------------------------------------------------------------------------- reviewers ---
@QUERIES.query
def risk_advocate_findings(spark, folder):
    return panel.risk_advocate(night_of(spark, folder).verdicts, CFG).select(
        "pid", "narrative", "assessments")


@QUERIES.query
def confounder_check_findings(spark, folder):
    return panel.confounder_check(night_of(spark, folder).verdicts, CFG).select(
        "pid", "narrative", "assessments", joined("confounders_found"))


@QUERIES.query
def precedent_matches(spark, folder):
    """The comparable closed cases of every case, best first."""
    found = panel.precedents(night_of(spark, folder).verdicts)
    return found.select("pid", F.posexplode("precedents")).select(
        "pid", F.col("pos").cast("bigint").alias("position"), F.col("col.code").alias("code"),
        r9("col.score", "score"), F.col("col.action").alias("action"),
        F.col("col.outcome").alias("outcome"))


@QUERIES.query
def welfare_context_findings(spark, folder):
    return panel.welfare_context(night_of(spark, folder).verdicts).select(
        "pid", "narrative", joined("precedent_interventions"))


@QUERIES.query
def panel_findings(spark, folder):
    """Three findings per case, one of them from a reviewer that was never configured."""
    cases = night_of(spark, folder).verdicts
    reviewers = dict(panel.default_panel(CFG))
    reviewers.pop("welfare_context")
    return panel.assemble(cases, reviewers).groupBy("reviewer", "status").agg(
        F.count("*").alias("n"))


@QUERIES.query
def frozen_run(spark, folder):
    """A run whose confounder check is missing: nothing escalates."""
    night = night_of(spark, folder)
    reviewers = dict(panel.default_panel(CFG))
    reviewers.pop("confounder_check")
    freeze = panel.run_freeze(panel.assemble(night.cases, reviewers), F.lit(0.1), CFG)
    out = panel.decide_with_freeze(night.cases, freeze, CFG)
    return out.groupBy("decision", "reason", "freeze_reason").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- read views ---
@QUERIES.query
def funnel(spark, folder):
    return views.funnel(all_cases(night_of(spark, folder)))


@QUERIES.query
def run_headline(spark, folder):
    night = night_of(spark, folder)
    return views.headline(views.funnel(all_cases(night)), degraded=F.lit(0), absent=F.lit(0))


@QUERIES.query
def run_summary(spark, folder):
    """The identity-free record of a run as one JSON document."""
    night = night_of(spark, folder)
    return views.run_summary(all_cases(night), "run-1", AS_OF, CFG)


@QUERIES.query
def caseload(spark, folder):
    ranked = views.caseload(night_of(spark, folder).verdicts)
    return ranked.select("pid", "unit_id", "decision", r9("composite"))


@QUERIES.query
def scoped_caseload(spark, folder):
    """Each officer's own units; the clinician sees overrides of every unit."""
    night = night_of(spark, folder)
    officers = T.read(spark, folder, "supplier").select(
        F.concat(F.lit("officer-"), F.col("s_suppkey").cast("string")).alias("operator"),
        F.when(F.col("s_acctbal") > 0, "welfare_officer").otherwise("mental_health_authority")
        .alias("role"),
        F.concat(F.lit("U"), F.col("s_nationkey").cast("string")).alias("unit_id"))
    book = T.close_outs(spark, folder)
    return views.scoped_caseload(night.verdicts, officers, book).select(
        "operator", "role", "pid", "case_unit", "decision", "contacted", "closed_as", "blocking")


@QUERIES.query
def monitored_cases(spark, folder):
    held = views.monitored(night_of(spark, folder).verdicts)
    return held.select("pid", "unit_id", r9("composite"))


@QUERIES.query
def refused_nearest(spark, folder):
    """The twelve refusals that came closest, for the auditor."""
    return views.refused(night_of(spark, folder).verdicts, CFG, limit=12).select(
        "pid", "short_pid", "unit_id", "decision", "reason", r9("composite"), r9("closest_miss"))


@QUERIES.query
def own_reasons(spark, folder):
    """Gate values and messages as shown to the person themselves, for every person."""
    return views.own_reasons(night_of(spark, folder).verdicts, CFG).select(
        "pid", "named_to_an_officer", "message", "gate", r9("value"), "threshold", "passed")


@QUERIES.query
def case_payload(spark, folder):
    """Nested case documents, hashed so that one comparison covers every field."""
    out = views.case_payload(night_of(spark, folder, detail=True).verdicts, CFG)
    return out.select("pid", F.get_json_object("payload", "$.decision").alias("decision"),
                      F.get_json_object("payload", "$.reason").alias("reason"),
                      F.get_json_object("payload", "$.gates[0].name").alias("first_gate"),
                      F.get_json_object("payload", "$.gates[0].formula").alias("formula"),
                      *[F.get_json_object("payload", f"$.gates[{i}].threshold").cast("double")
                        .alias(f"threshold_{i}") for i in range(4)],
                      F.get_json_object("payload", "$.recommended[0].code").alias("first_action"))


@QUERIES.query
def gate_table(spark, folder):
    """One line per case: the gate values, marked where they fell short."""
    return views.gate_table(night_of(spark, folder).verdicts)


@QUERIES.query
def units_covered(spark, folder):
    return views.units_covered(all_cases(night_of(spark, folder)))


@QUERIES.query
def threshold_sweep(spark, folder):
    """Escalation rate and caseload as the evidence threshold moves."""
    night = night_of(spark, folder)
    screened = features.people(night.profile).agg(F.count("*").alias("screened"))
    sweep = views.threshold_sweep(night.verdicts, screened, [0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8])
    return sweep.select("threshold", "escalated", r9("rate"), "officers")


