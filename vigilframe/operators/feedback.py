"""What officers found out, and what it says about the thresholds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import GATES, OUTCOMES, Config
from vigilframe.functions.scalar import fixed, lookup, settled, strings

RAISE_CAP, LOWER_FLOOR = 0.95, 0.40
TIGHTENED_GATES = ("evidence", "consistency")
MISSED = ("monitored", "no_flag")
MIN_SUBGROUP_POSITIVES = 3


# ----------------------------------------------------------------------- case book ---
def valid_closes(closes: DataFrame) -> DataFrame:
    return closes.filter(F.col("outcome").isin(*OUTCOMES))


def rejected_closes(closes: DataFrame) -> DataFrame:
    return closes.filter(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)))


def latest_closes(closes: DataFrame) -> DataFrame:
    """Last valid close-out per person, merged map-side."""
    code = lookup({o: i for i, o in enumerate(OUTCOMES)}, F.col("outcome")).cast("int")
    last = valid_closes(closes).groupBy("pid").agg(F.max_by(code, "seq").alias("code"),
                                                   F.max("seq").alias("seq"))
    return last.select("pid", F.element_at(strings(OUTCOMES), F.col("code") + 1).alias("outcome"),
                       "seq")


def deferrals(rows: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    return rows.withColumn("refused", blank)


def blocking(escalated: DataFrame, contacted: DataFrame, closed: DataFrame) -> DataFrame:
    """Contacted but not closed: the console waits for these."""
    return escalated.join(contacted.select("pid"), "pid", "left_semi").join(
        closed.select("pid"), "pid", "left_anti")


def contest_routes(contests: DataFrame, cfg: Config) -> DataFrame:
    """contests: (pid, kind, driver, accepted, on) -> where each disagreement goes."""
    kind, ok = F.col("kind"), F.col("accepted")
    route = (F.when(kind == "factual_error", "correction")
             .when(kind == "objects_to_analysis", "consent")
             .when(ok, "annotation").otherwise("rejected"))
    action = lookup({"correction": "correction.requested", "consent": "consent.narrowed",
                     "annotation": "annotation.accepted", "rejected": "annotation.rejected"},
                    F.col("route"))
    return contests.withColumn("route", route).withColumns({
        "action": action,
        "expires_on": F.when(F.col("route") == "annotation",
                             F.date_add("on", cfg.annotation_days))})


def suppressed_drivers(routes: DataFrame, as_of: date) -> DataFrame:
    """Drivers the next run must ignore; the day of expiry still counts."""
    live = routes.filter((F.col("route") == "annotation") & (F.col("expires_on") >= F.lit(as_of)))
    return live.groupBy("pid").agg(F.array_sort(F.collect_set("driver")).alias("suppressed_drivers"))


def realised_precision(closes: DataFrame) -> DataFrame:
    supported = F.count_if(F.col("outcome") == "supported")
    judged = F.count_if(F.col("outcome").isin("supported", "not_supported"))
    return closes.agg(F.coalesce(F.try_divide(supported, judged), F.lit(0.0)).alias("precision"),
                      judged.alias("judged"))


def outcome_counts(closes: DataFrame) -> DataFrame:
    """Every category is present, zeros included."""
    counts = closes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in OUTCOMES])))


def weekly_report(closes: DataFrame, routes: DataFrame) -> DataFrame:
    """One row of counts and rates for the board."""
    outcome = F.col("outcome")
    judged = F.count_if(outcome.isin("supported", "not_supported"))
    book = closes.agg(
        settled(F.coalesce(F.try_divide(F.count_if(outcome == "supported"), judged), F.lit(0.0)), 4)
        .alias("precision"), judged.alias("judged"),
        F.count_if(outcome == "not_supported").alias("not_supported"))
    extra = routes.agg(F.count_if(F.col("route") == "annotation").alias("a"),
                       F.count_if(F.col("route") == "correction").alias("c"))
    return book.select("*", extra.select("a").scalar().alias("annotations_accepted"),
                       extra.select("c").scalar().alias("corrections_requested"))


# -------------------------------------------------------------------- missed cases ---
def missed_flags(cases: DataFrame) -> DataFrame:
    missed = F.col("prior_verdict").isin(*MISSED)
    return cases.withColumns({
        "missed": missed,
        "recoverable": (F.col("prior_verdict") == "monitored") & (F.col("blocking_gate") != "")})


def surfaced_report(cases: DataFrame, since: date | None = None) -> DataFrame:
    rows = missed_flags(cases if since is None else
                        cases.filter(F.col("surfaced_on") >= F.lit(since)))
    blocked = {f"blocked_{g}": F.count_if(F.col("recoverable") & (F.col("blocking_gate") == g))
               for g in GATES}
    out = rows.agg(
        F.count("*").alias("surfaced"), F.count_if("missed").alias("missed"),
        F.count_if(F.col("prior_verdict") == "escalated").alias("already_escalated"),
        F.count_if(F.col("prior_verdict") == "not_enrolled").alias("not_enrolled"),
        F.count_if("recoverable").alias("recoverable"), *[c.alias(n) for n, c in blocked.items()])
    chance = F.col("missed") + F.col("already_escalated")
    return out.withColumns({
        "missed_rate": F.coalesce(F.try_divide("missed", chance), F.lit(0.0)),
        "surfaced_recall": F.coalesce(F.try_divide("already_escalated", chance), F.lit(0.0)),
        "dominant_gate": dominant_gate(),
    })


def dominant_gate() -> Column:
    """The gate behind more than half of the recoverable misses; ties fall to the later name."""
    counts = F.array_sort(F.array(*[F.struct(F.col(f"blocked_{g}").alias("n"), F.lit(g).alias("g"))
                                    for g in GATES]))
    top = F.element_at(counts, -1)
    whole = sum((F.col(f"blocked_{g}") for g in GATES), F.lit(0))
    return F.when((whole > 0) & (F.try_divide(top["n"], whole) > 0.5), top["g"]).otherwise("")


def by_category(cases: DataFrame, column: str) -> DataFrame:
    rows = missed_flags(cases)
    if column == "blocking_gate":
        rows = rows.filter("recoverable")
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def prior_state(events: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """As-of join: the last history row of the same pid strictly before the event.

    events: (pid, at, ...); history: (pid, at, seq, columns...).  Neither side is paired with the
    other: both are stacked and read in time order, a month of one person at a time, and only one
    summary row per (person, month) carries over to the next month.  A person with a third of all
    rows is spread over their months.
    """
    month = F.date_format("at", "yyyy-MM")
    state = F.struct("at", "seq", *columns)
    left = events.withColumn("_period", month).withColumn("_row", F.struct(*events.columns))
    right = history.select("pid", "at", month.alias("_period"), state.alias("_state"))
    stacked = left.select("pid", "_period", "at", F.lit(0).alias("_side"), F.lit(0).cast("bigint")
                          .alias("_seq"), "_row", F.lit(None).cast(
                              right.schema["_state"].dataType).alias("_state")).unionByName(
        right.select("pid", "_period", "at", F.lit(1).alias("_side"),
                     F.col("_state.seq").cast("bigint").alias("_seq"),
                     F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_state"))
    inside = Window.partitionBy("pid", "_period").orderBy("at", "_side", "_seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = stacked.withColumn("_near", F.last("_state", ignorenulls=True).over(inside)).filter(
        F.col("_row").isNotNull())
    # the state struct starts with (at, seq), so the largest struct of a month is its last row
    months = stacked.groupBy("pid", "_period").agg(F.max("_state").alias("_last"))
    before = Window.partitionBy("pid").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select("pid", "_period",
                            F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    out = local.join(carried, ["pid", "_period"], "left")
    found = F.coalesce("_near", "_carried")
    return out.select("_row.*", *[found[c].alias(f"prior_{c}") for c in ("at", *columns)])


# ----------------------------------------------------------------------- proposals ---
def propose(report: DataFrame, surfaced: DataFrame | None, cfg: Config) -> DataFrame:
    """Threshold changes the evidence argues for.  Nothing here applies one.

    ``report`` and ``surfaced`` are one-row tables; the second is read as scalars.
    """
    out = report
    names = ("missed", "already_escalated", "missed_rate", "recoverable", "dominant_gate",
             *[f"blocked_{g}" for g in GATES])
    if surfaced is not None:
        out = out.select("*", *[surfaced.select(n).scalar().alias(f"s_{n}") for n in names])
    enough = F.col("judged") >= cfg.min_outcomes
    short = F.round(cfg.precision_floor - F.col("precision"), 9)
    step = F.least(F.lit(cfg.max_step), settled(short, 3))
    weak = enough & (short > 0)
    items = []
    for order, gate in enumerate(TIGHTENED_GATES):
        current = float(cfg.thresholds[gate])
        items.append(F.when(weak, F.struct(
            F.lit(order).alias("position"), F.lit(gate).alias("gate"),
            F.lit(current).alias("current"),
            settled(F.least(F.lit(RAISE_CAP), current + step), 3).alias("proposed"),
            F.concat(
                F.lit("Realised precision on closed ESCALATE cases is "),
                fixed(F.col("precision"), 2),
                F.lit(f" against a floor of {cfg.precision_floor:.2f}, over "),
                F.col("judged").cast("string"), F.lit(f" judged cases. Raising the {gate} "
                                                      "threshold by "), fixed(step, 3),
                F.lit(" is the smallest change that addresses it.")).alias("rationale"))))
    if surfaced is not None:
        chance = F.col("s_missed") + F.col("s_already_escalated")
        excess = F.round(F.col("s_missed_rate") - cfg.missed_ceiling, 9)
        down = F.least(F.lit(cfg.max_step), settled(excess, 3))
        gate = F.col("s_dominant_gate")
        current = lookup({g: float(t) for g, t in cfg.thresholds.items()}, gate)
        blocked = lookup({g: F.col(f"s_blocked_{g}") for g in GATES}, gate)
        room = (enough & (chance >= cfg.min_surfaced) & (excess > 0) & (gate != "")
                & (short <= 0))
        items.append(F.when(room, F.struct(
            F.lit(len(TIGHTENED_GATES)).alias("position"), gate.alias("gate"),
            current.alias("current"),
            settled(F.greatest(F.lit(LOWER_FLOOR), current - down), 3).alias("proposed"),
            F.concat(
                F.col("s_missed").cast("string"), F.lit(" of "), chance.cast("string"), F.lit(
                    " welfare concerns that surfaced through another channel had been declined by "
                    "this system — a missed rate of "), fixed(F.col("s_missed_rate"), 2),
                F.lit(f" against a ceiling of {cfg.missed_ceiling:.2f}. The "), gate,
                F.lit(" gate blocked "), blocked.cast("string"), F.lit(" of "),
                F.col("s_recoverable").cast("string"),
                F.lit(" recoverable misses. Realised precision is "), fixed(F.col("precision"), 2),
                F.lit(", so there is headroom to lower it by "), fixed(down, 3), F.lit(
                    ". This is surfaced-case recall and not recall: concerns that never surfaced "
                    "are invisible to this figure.")).alias("rationale"))))
    rows = F.filter(F.array(*items), lambda p: p.isNotNull())
    out = out.select(F.inline(rows)).withColumn("config_version", F.lit(cfg.version))
    return out.withColumn("direction", F.when(F.col("proposed") > F.col("current"), "tighten")
                          .when(F.col("proposed") < F.col("current"), "loosen").otherwise("none"))


def subgroup_proposals(metrics: DataFrame, cfg: Config) -> DataFrame:
    """A weak subgroup is reported with no change: a threshold applies to everybody."""
    name = F.concat("key", F.lit("="), "value")
    weak = metrics.filter((F.col("positives") >= MIN_SUBGROUP_POSITIVES)
                          & (F.col("precision") < cfg.precision_floor))
    return weak.select(
        F.concat(F.lit("subgroup:"), name).alias("gate"), F.lit(0.0).alias("current"),
        F.lit(0.0).alias("proposed"),
        F.concat(F.lit("Subgroup "), name, F.lit(" shows precision "), fixed(F.col("precision"), 2),
                 F.lit(f" against {cfg.precision_floor:.2f} overall. No threshold change is "
                       "proposed — a threshold applies to everybody, and this is a model problem. "
                       "Escalation for this subgroup should be reviewed directly."))
        .alias("rationale"))


def apply_decisions(proposals: DataFrame, decisions: DataFrame, cfg: Config) -> DataFrame:
    """Thresholds after the board: approved changes only, and never from a subgroup."""
    approved = proposals.join(decisions.filter("approved"), "gate").filter(
        ~F.col("gate").startswith("subgroup:"))
    changes = approved.agg(*[F.max(F.when(F.col("gate") == g, F.col("proposed"))).alias(g)
                             for g in GATES])
    return changes.select(F.inline(F.array(*[F.struct(
        F.lit(g).alias("gate"), F.lit(float(cfg.thresholds[g])).alias("before"),
        F.coalesce(F.col(g), F.lit(float(cfg.thresholds[g]))).alias("after")) for g in GATES])))


# --------------------------------------------------------------------------- drift ---
def stability(scores: DataFrame, cfg: Config) -> DataFrame:
    """Population stability index of (side, score), side in {baseline, current}.

    One aggregate counts every bin of both sides.  Negative scores are in no bin; the last bin is
    open; an empty bin is floored, not skipped.
    """
    bins = cfg.psi_bins
    slot = F.least(F.lit(bins - 1), F.floor(F.round(F.col("score") * bins, 9)))
    sides = ("baseline", "current")
    counts = scores.withColumn("bin", slot).groupBy().agg(
        *[F.count_if((F.col("side") == s) & (F.col("bin") == i)).alias(f"{s}_{i}")
          for s in sides for i in range(bins)],
        *[F.count_if(F.col("side") == s).alias(f"{s}_n") for s in sides])

    def share(side: str, i: int) -> Column:
        return F.greatest(F.lit(cfg.psi_floor),
                          F.try_divide(F.col(f"{side}_{i}"), F.col(f"{side}_n")))

    terms = F.lit(0.0)
    for i in range(bins):
        seen, was = share("current", i), share("baseline", i)
        terms = terms + (seen - was) * F.log(seen / was)
    empty = (F.col("baseline_n") == 0) | (F.col("current_n") == 0)
    out = counts.select(F.when(empty, 0.0).otherwise(settled(terms, 4)).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") >= cfg.psi_freeze, "frozen")
                          .otherwise("ok"))
