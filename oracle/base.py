"""Shared CTEs: the screening run over ``events``, stated relationally."""

from __future__ import annotations

PLAYBOOK = """
playbook(ord, code, authority, topic) AS (
  SELECT * FROM (VALUES
    (1,'MH-URGENT','mental_health','acute'), (1,'MH-URGENT','mental_health','phq9_item_9'),
    (1,'MH-URGENT','mental_health','clinician_concern'),
    (2,'WLF-COUNSEL','unit_welfare','self_report'), (2,'WLF-COUNSEL','unit_welfare','phq9'),
    (2,'WLF-COUNSEL','unit_welfare','gad7'), (2,'WLF-COUNSEL','unit_welfare','mbi'),
    (3,'WLF-FAMILY','unit_welfare','deployment'), (3,'WLF-FAMILY','unit_welfare','transfer'),
    (3,'WLF-FAMILY','unit_welfare','separation'),
    (4,'WLF-LEAVE','unit_welfare','leave'), (4,'WLF-LEAVE','unit_welfare','leave_denied'),
    (5,'WLF-PEER','unit_welfare','self_report'), (5,'WLF-PEER','unit_welfare','workload'),
    (5,'WLF-PEER','unit_welfare','duty_roster'), (5,'WLF-PEER','unit_welfare','training'),
    (6,'WLF-REST','unit_welfare','duty_roster'), (6,'WLF-REST','unit_welfare','consecutive_duty'),
    (6,'WLF-REST','unit_welfare','workload'), (6,'WLF-REST','unit_welfare','leave'),
    (7,'WLF-TRAINING-LOAD','unit_welfare','training'),
    (7,'WLF-TRAINING-LOAD','unit_welfare','course_load'))
)"""

SIGNALS = """
signals AS (
  SELECT user_id::VARCHAR AS pid, 'U' || (user_id % 10) AS unit_id,
         CASE event_type WHEN 'signup' THEN 'self_report' WHEN 'error' THEN 'workload'
              WHEN 'click' THEN 'duty_roster' WHEN 'purchase' THEN 'leave' ELSE 'training' END
           AS domain,
         ts AS observed_at, least(1.0::DOUBLE, value / 100.0::DOUBLE) AS value
  FROM events
), consent AS (
  SELECT c_custkey::VARCHAR AS pid,
         CASE WHEN c_acctbal < -500 THEN 'REVOKED'
              WHEN c_mktsegment IN ('BUILDING','FURNITURE','HOUSEHOLD') THEN 'PARTIAL'
              ELSE 'ACTIVE' END AS status,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'training' WHEN 'FURNITURE' THEN 'workload'
              WHEN 'HOUSEHOLD' THEN 'self_report' ELSE '' END AS dropped,
         c_acctbal >= 0 AS welfare_contact
  FROM customer
), outcome AS (
  SELECT s.*, c.status, c.welfare_contact,
         CASE WHEN c.pid IS NULL OR c.status = 'REVOKED' THEN 'not_enrolled'
              WHEN c.dropped = s.domain THEN 'no_consent' END AS drop_reason
  FROM signals s LEFT JOIN consent c USING (pid)
), covered AS (SELECT * FROM outcome WHERE drop_reason IS NULL)"""

SCREEN = SIGNALS + """,
in_history AS (
  SELECT * FROM covered
  WHERE observed_at::DATE BETWEEN DATE '2024-01-30' - 29 AND DATE '2024-01-30'
), daily0 AS (
  SELECT pid, domain, observed_at::DATE AS day, avg(value) AS value, count(*) AS n_rows
  FROM in_history GROUP BY ALL
), unit_of AS (
  SELECT pid, arg_max(unit_id, observed_at) AS unit_id FROM in_history GROUP BY pid
), daily AS (
  SELECT d.*, u.unit_id, date_diff('day', d.day, DATE '2024-01-30') AS age
  FROM daily0 d JOIN unit_of u USING (pid)
), base AS (
  SELECT pid, domain, count(*) AS base_n, avg(value) AS base_mean,
         greatest(stddev_pop(value), 0.02) AS base_stdev, arg_max(value, day) AS latest
  FROM daily WHERE age >= 10 AND age < 30 GROUP BY ALL
), windows AS (
  SELECT pid, unit_id, domain,
         count(*) FILTER (age < 3) AS n_3, avg(value) FILTER (age < 3) AS mean_3,
         count(*) FILTER (age < 7) AS n_7, avg(value) FILTER (age < 7) AS mean_7,
         count(*) FILTER (age < 10) AS n_10, avg(value) FILTER (age < 10) AS mean_10,
         count(*) FILTER (age < 20) AS n_20, avg(value) FILTER (age < 20) AS mean_20
  FROM daily GROUP BY ALL
), profile AS (
  SELECT w.*, coalesce(b.base_n, 0) AS base_n, coalesce(b.base_mean, 0) AS base_mean,
         coalesce(b.base_stdev, 0.02) AS base_stdev,
         coalesce(b.base_mean, 0) + 1.0 * coalesce(b.base_stdev, 0.02) AS level
  FROM windows w LEFT JOIN base b USING (pid, domain)
), breaches AS (
  SELECT d.pid, d.domain,
         count(*) FILTER (age < 3 AND round(value, 9) >= round(level, 9)) / 3 AS breach_0,
         count(*) FILTER (age < 7 AND round(value, 9) >= round(level, 9)) / 7 AS breach_1,
         count(*) FILTER (age < 10 AND round(value, 9) >= round(level, 9)) / 10 AS breach_2
  FROM daily d JOIN profile p USING (pid, domain) GROUP BY ALL
), unit_base AS (
  SELECT unit_id, domain, count(*) AS unit_n, avg(mean_3) AS unit_mean,
         greatest(stddev_pop(mean_3), 0.02) AS unit_stdev
  FROM profile WHERE n_3 > 0 GROUP BY ALL
), scored AS (
  SELECT p.*, u.unit_n, u.unit_mean, u.unit_stdev, b.breach_0, b.breach_1, b.breach_2,
         (p.mean_3 - p.base_mean) / p.base_stdev AS zs, (p.mean_3 - u.unit_mean) / u.unit_stdev AS zu
  FROM profile p JOIN unit_base u USING (unit_id, domain) JOIN breaches b USING (pid, domain)
  WHERE p.base_n >= 4 AND p.n_3 > 0
), devs AS (
  SELECT pid, unit_id, domain, round(zs::DECIMAL(28,10), 4)::DOUBLE AS z_self,
         round(zu::DECIMAL(28,10), 4)::DOUBLE AS z_unit,
         CASE WHEN round(zs, 9) >= 0 THEN 'elevated' ELSE 'reduced' END AS direction,
         (CASE WHEN round(abs((mean_3 - base_mean) / base_stdev), 9) >= 1 THEN 1 ELSE 0 END
          + CASE WHEN round(abs((coalesce(mean_7, 0) - base_mean) / base_stdev), 9) >= 1 THEN 1 ELSE 0 END
          + CASE WHEN round(abs((coalesce(mean_10, 0) - base_mean) / base_stdev), 9) >= 1 THEN 1 ELSE 0 END
         )::BIGINT AS windows_breached,
         CASE domain WHEN 'self_report' THEN 'T1' WHEN 'training' THEN 'T3' ELSE 'T2' END AS tier,
         CASE domain WHEN 'self_report' THEN 1.0 WHEN 'training' THEN 0.4 ELSE 0.7 END::DOUBLE AS weight,
         breach_0, breach_1, breach_2
  FROM scored WHERE round(abs(zs), 9) >= 1.0 OR round(abs(zu), 9) >= 1.0
), cohort AS (
  SELECT unit_id, count(DISTINCT pid) AS cohort_size FROM profile GROUP BY unit_id
), fractions AS (
  SELECT unit_id, domain, cohort_size, max(n) / cohort_size AS unit_fraction
  FROM (SELECT unit_id, domain, direction, count(*) AS n FROM devs GROUP BY ALL)
  JOIN cohort USING (unit_id) GROUP BY unit_id, domain, cohort_size
)"""

def rd(expr: str, digits: int) -> str:
    """Decimal half-up rounding: binary ``round`` misses ties such as 1.035."""
    return f"round(({expr})::DECIMAL(28,10), {digits})::DOUBLE"


def sg(expr: str, digits: int) -> str:
    return f"printf('%+.{digits}f', {rd(expr, digits)})"


def f(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rd(expr, digits)})"


def pct(expr: str) -> str:
    return f"(round_even(round(({expr}) * 100, 9), 0)::BIGINT || '%')"


def short(expr: str, digits: int) -> str:
    return (f"regexp_replace(regexp_replace({f(expr, digits)}, '0+$', ''), '\\.$', '.0')")


# The gates read ``case_devs`` (one row per deviation with context), ``case_facts`` (one row per
# case) and ``hits``; a caller may supply its own versions of the three.
CONTEXT = """
case_devs AS (
  SELECT d.*, f.cohort_size, f.unit_fraction, 0.0::DOUBLE AS missing,
         c.status, c.welfare_contact,
         (c.status IN ('ACTIVE','PARTIAL') AND c.dropped <> d.domain) AS covered
  FROM devs d JOIN consent c USING (pid) JOIN fractions f USING (unit_id, domain)
), case_facts AS (
  SELECT pid, unit_id, any_value(status) AS status, any_value(welfare_contact) AS welfare_contact,
         max(cohort_size) AS cohort_size, true AS capacity
  FROM case_devs GROUP BY pid, unit_id
), hits AS (
  SELECT pid, unit_id, domain, 'unit_op_tempo' AS rule, 0.70::DOUBLE AS mass,
         'unit-wide operational tempo' AS label,
         """ + pct("unit_fraction") + """ || ' of the unit cohort (' || cohort_size
         || ' personnel) deviates in ' || domain
         || ' in the same direction; threshold is 40%' AS detail
  FROM case_devs WHERE round(unit_fraction, 9) >= 0.40
), acute AS (SELECT NULL::VARCHAR AS pid, NULL::VARCHAR AS items WHERE false)"""

GATES = PLAYBOOK + """,
cons AS (SELECT * FROM case_devs WHERE covered),
ev0 AS (
  SELECT f.pid, coalesce(sum(c.weight), 0)::DOUBLE AS weighted_volume,
         count(DISTINCT c.domain) AS distinct_domains,
         coalesce(bool_or(c.tier = 'T1'), false) AS has_t1
  FROM case_facts f LEFT JOIN cons c USING (pid) GROUP BY f.pid
), ev AS (
  SELECT *, least(1.0::DOUBLE, weighted_volume / 2.4) AS volume,
         least(1.0::DOUBLE, distinct_domains / 3) AS breadth,
         least(1.0, 0.5 * least(1.0::DOUBLE, weighted_volume / 2.4)
           + 0.3 * least(1.0::DOUBLE, distinct_domains / 3) + 0.2 * has_t1::INT)::DOUBLE AS evidence
  FROM ev0
), pairs AS (
  SELECT d.pid, d.domain, o.domain AS other, o.direction = d.direction AS agrees, o.weight,
         coalesce((SELECT sum(h.mass) FROM hits h WHERE h.pid = o.pid AND h.domain = o.domain
                   AND NOT EXISTS (SELECT 1 FROM hits g WHERE g.pid = d.pid
                                   AND g.domain = d.domain AND g.rule = h.rule)), 0) AS unshared
  FROM cons d JOIN cons o ON d.pid = o.pid AND d.domain <> o.domain
), own AS (SELECT pid, domain, sum(mass) AS mass FROM hits GROUP BY ALL),
co0 AS (
  SELECT c.pid, c.domain,
         coalesce(sum(p.weight) FILTER (p.agrees), 0)::DOUBLE AS available,
         coalesce(sum(p.weight * greatest(0, 1 - least(1, p.unshared))) FILTER (p.agrees), 0)::DOUBLE
           AS credible,
         coalesce(sum(p.weight) FILTER (NOT p.agrees), 0)::DOUBLE
           + coalesce(any_value(own.mass), 0) AS against
  FROM cons c LEFT JOIN pairs p ON p.pid = c.pid AND p.domain = c.domain
  LEFT JOIN own ON own.pid = c.pid AND own.domain = c.domain GROUP BY c.pid, c.domain
), co1 AS (
  SELECT *, CASE WHEN available + against = 0 THEN 0 ELSE credible / (available + against) END
    AS agree FROM co0
), co AS (
  SELECT f.pid, count(c.domain) AS n_domains,
         coalesce(greatest(0, least(1, avg(c.agree))), 0)::DOUBLE AS consistency,
         string_agg(c.domain || ': ' || """ + f("credible", 2) + """ || '/(' || """ \
    + f("available", 2) + """ || '+' || """ + f("against", 2) + """ || ')=' || """ \
    + f("agree", 3) + """, ' | ' ORDER BY c.domain) AS per_domain,
         CASE WHEN count(c.domain) = 0 THEN 'consistency = 0.000 (no deviating domain)' ELSE
         'consistency = mean(' || string_agg(""" + f("agree", 3) + """, ', ' ORDER BY c.domain)
         || ') = ' || """ + f("avg(c.agree)", 3) + """ END AS consistency_formula
  FROM case_facts f LEFT JOIN co1 c USING (pid) GROUP BY f.pid
), pe0 AS (
  SELECT f.pid,
    coalesce(sum(weight * least(1, greatest(0, breach_0))) / nullif(sum(weight) FILTER (breach_0 IS NOT NULL), 0), 0)::DOUBLE AS w0,
    coalesce(sum(weight * least(1, greatest(0, breach_1))) / nullif(sum(weight) FILTER (breach_1 IS NOT NULL), 0), 0)::DOUBLE AS w1,
    coalesce(sum(weight * least(1, greatest(0, breach_2))) / nullif(sum(weight) FILTER (breach_2 IS NOT NULL), 0), 0)::DOUBLE AS w2
  FROM case_facts f LEFT JOIN cons c USING (pid) GROUP BY f.pid
), pe AS (
  SELECT *, least(1.0, 0.20 * w0 + 0.45 * w1 + 0.35 * w2)::DOUBLE AS persistence FROM pe0
), keys AS (
  SELECT pid, domain AS k FROM case_devs
  UNION ALL SELECT pid, 'acute' FROM acute
  UNION ALL SELECT pid, unnest(string_split(items, ', ')) FROM acute
), matches AS (
  SELECT DISTINCT k.pid, b.ord, b.code, b.authority FROM keys k JOIN playbook b
    ON contains(k.k, b.topic)
), ac AS (
  SELECT f.pid, f.capacity,
         EXISTS (SELECT 1 FROM matches m WHERE m.pid = f.pid) AS has_match,
         f.welfare_contact AND f.status IN ('ACTIVE','PARTIAL') AS contact_ok,
         coalesce((SELECT string_agg(code, ',' ORDER BY ord) FROM matches m WHERE m.pid = f.pid), '')
           AS matched,
         coalesce((SELECT string_agg(code, ',' ORDER BY ord) FROM matches m WHERE m.pid = f.pid
                   AND m.authority = 'mental_health'), '') AS urgent,
         (EXISTS (SELECT 1 FROM matches m WHERE m.pid = f.pid)::INT
           * (f.welfare_contact AND f.status IN ('ACTIVE','PARTIAL'))::INT
           * (0.75 + 0.25 * f.capacity::INT))::DOUBLE AS actionability
  FROM case_facts f
), gates AS (
  SELECT f.pid, f.unit_id, f.cohort_size, ev.* EXCLUDE (pid), co.* EXCLUDE (pid),
         pe.* EXCLUDE (pid), ac.* EXCLUDE (pid),
         round(evidence, 9) >= 0.65 AS evidence_passed,
         round(consistency, 9) >= 0.70 AS consistency_passed,
         round(persistence, 9) >= {persistence} AS persistence_passed,
         round(actionability, 9) >= 0.50 AS actionability_passed,
         (SELECT count(*) FROM cons c WHERE c.pid = f.pid) AS n_consented,
         pow(evidence, 0.30) * pow(consistency, 0.30) * pow(persistence, 0.25)
           * pow(actionability, 0.15) AS composite,
         a.items AS acute_items
  FROM case_facts f JOIN ev USING (pid) JOIN co USING (pid) JOIN pe USING (pid)
  JOIN ac USING (pid) LEFT JOIN acute a USING (pid)
), verdicts AS (
  SELECT *,
    CASE WHEN acute_items IS NOT NULL THEN 'IMMEDIATE_ESCALATE'
         WHEN n_consented = 0 THEN 'NO_FLAG'
         WHEN NOT actionability_passed THEN 'NO_FLAG'
         WHEN NOT persistence_passed THEN 'MONITOR'
         WHEN NOT evidence_passed OR NOT consistency_passed THEN 'MONITOR'
         ELSE 'ESCALATE' END AS decision,
    CASE WHEN acute_items IS NOT NULL THEN 'safety override: acute item(s) ' || acute_items
         WHEN n_consented = 0 THEN 'no consent basis for any deviating domain'
         WHEN NOT actionability_passed THEN 'no available or non-duplicate welfare action'
         WHEN NOT persistence_passed THEN 'not yet sustained'
         WHEN NOT evidence_passed OR NOT consistency_passed
           THEN 'insufficient or confounded evidence'
         ELSE 'all four gates passed' END AS reason,
    concat_ws(',', CASE WHEN NOT evidence_passed THEN 'evidence' END,
      CASE WHEN NOT consistency_passed THEN 'consistency' END,
      CASE WHEN NOT persistence_passed THEN 'persistence' END,
      CASE WHEN NOT actionability_passed THEN 'actionability' END) AS failed_gates
  FROM gates
), recommended AS (
  SELECT pid, CASE WHEN decision = 'IMMEDIATE_ESCALATE' AND urgent <> '' THEN urgent
                   WHEN decision IN ('IMMEDIATE_ESCALATE', 'ESCALATE') THEN matched
                   ELSE '' END AS recommended FROM verdicts
), cases AS (
  SELECT pid, unit_id, decision, reason, composite FROM verdicts
  UNION ALL
  SELECT DISTINCT pid, unit_id, 'CLEARED', '', 0.0::DOUBLE FROM profile
  WHERE pid NOT IN (SELECT pid FROM devs)
)"""

RUN = SCREEN + ",\n" + CONTEXT + ",\n" + GATES.replace("{persistence}", "0.20")


def screened(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((SCREEN, *ctes)) + "\n" + select


def run(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((RUN, *ctes)) + "\n" + select


def uniform(secret: str, text: str) -> str:
    """HMAC-SHA256 of a text expression under a fixed key, as a number in (0, 1): 52 bits of the digest."""
    key = secret.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in key) for pad in (0x36, 0x5C))
    digest = f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({text}))))"
    return f"((('0x' || substr({digest}, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
