"""SQL twins of the feedback queries."""

from __future__ import annotations

from oracle.base import f, rd
from oracle.modelling import SUBGROUPS

SQL: dict[str, str] = {}

BOOK = """
book AS (
  SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'done' WHEN '2-HIGH' THEN 'supported' WHEN '3-MEDIUM' THEN 'not_supported'
    WHEN '4-NOT SPECIFIED' THEN 'already_known' ELSE 'declined_contact' END AS outcome FROM orders
), latest AS (
  SELECT pid, arg_max(outcome, seq) AS outcome, max(seq) AS seq FROM book WHERE outcome <> 'done'
  GROUP BY pid
), contests AS (
  SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq, o_orderdate::DATE AS d,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'leave' WHEN '2-HIGH' THEN 'workload'
      WHEN '3-MEDIUM' THEN 'training' WHEN '4-NOT SPECIFIED' THEN 'duty_roster'
      ELSE 'self_report' END AS driver,
    CASE WHEN o_orderstatus = 'F' THEN 'correction' WHEN o_orderstatus = 'P' THEN 'consent'
      WHEN o_totalprice < 400000 THEN 'annotation' ELSE 'rejected' END AS route FROM orders
), weekly AS (
  SELECT """ + rd("coalesce(count(*) FILTER (outcome = 'supported') / nullif(count(*) FILTER "
                  "(outcome IN ('supported', 'not_supported')), 0), 0)", 4) + """ AS precision,
    count(*) FILTER (outcome IN ('supported', 'not_supported')) AS judged,
    count(*) FILTER (outcome = 'not_supported') AS not_supported FROM latest
)"""

SQL["close_outs_refused"] = "WITH " + BOOK + """
SELECT outcome, count(*) AS n FROM book WHERE outcome = 'done' GROUP BY outcome"""
SQL["close_outs_latest"] = "WITH " + BOOK + "\nSELECT * FROM latest"
SQL["deferrals"] = """
SELECT conv_id::VARCHAR AS pid, role = 'system' OR trim(text) = '' AS refused, count(*) AS n
FROM conversations GROUP BY ALL"""
SQL["blocking_cases"] = """
SELECT c_custkey::VARCHAR AS pid FROM customer WHERE c_acctbal >= 0
  AND c_custkey IN (SELECT o_custkey FROM orders)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')"""
SQL["contest_routing"] = "WITH " + BOOK + """
SELECT pid, seq, route, CASE route WHEN 'correction' THEN 'correction.requested'
  WHEN 'consent' THEN 'consent.narrowed' WHEN 'annotation' THEN 'annotation.accepted'
  ELSE 'annotation.rejected' END AS action,
  CASE WHEN route = 'annotation' THEN strftime(d + 90, '%Y-%m-%d') ELSE '' END AS expires_on
FROM contests"""
SQL["suppressed_drivers"] = "WITH " + BOOK + """
SELECT pid, string_agg(DISTINCT driver, ',' ORDER BY driver) AS suppressed_drivers FROM contests
WHERE route = 'annotation' AND d + 90 >= DATE '1998-06-30' GROUP BY pid"""
SQL["realised_precision"] = "WITH " + BOOK + """
SELECT round(count(*) FILTER (outcome = 'supported')
    / count(*) FILTER (outcome IN ('supported', 'not_supported')), 9) AS precision,
  count(*) FILTER (outcome IN ('supported', 'not_supported')) AS judged FROM latest"""
SQL["outcome_counts"] = "WITH " + BOOK + """
SELECT o.outcome, count(l.pid) AS n FROM (VALUES ('supported'), ('not_supported'),
  ('already_known'), ('declined_contact')) AS o(outcome) LEFT JOIN latest l USING (outcome)
GROUP BY o.outcome"""
SQL["weekly_report"] = "WITH " + BOOK + """
SELECT *, (SELECT count(*) FROM contests WHERE route = 'annotation') AS annotations_accepted,
  (SELECT count(*) FROM contests WHERE route = 'correction') AS corrections_requested FROM weekly"""

SURFACED = """
concerns AS (
  SELECT o_orderdate::DATE AS surfaced_on,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'medical_officer' WHEN '2-HIGH' THEN 'self_referral'
      WHEN '3-MEDIUM' THEN 'peer' WHEN '4-NOT SPECIFIED' THEN 'family' ELSE 'command' END AS channel,
    CASE WHEN o_totalprice < 20000 THEN 'not_enrolled' WHEN o_orderstatus = 'F' THEN 'monitored'
      WHEN o_orderstatus = 'O' THEN 'escalated' ELSE 'no_flag' END AS prior,
    CASE WHEN o_orderstatus <> 'F' OR o_totalprice >= 350000 THEN ''
      WHEN o_totalprice < 250000 THEN 'persistence' WHEN o_totalprice < 300000 THEN 'evidence'
      ELSE 'consistency' END AS gate
  FROM orders
), flagged AS (
  SELECT *, prior IN ('monitored', 'no_flag') AS missed, prior = 'monitored' AND gate <> ''
    AS recoverable FROM concerns
)"""
_REPORT = """
SELECT count(*) AS surfaced, count(*) FILTER (missed) AS missed,
  count(*) FILTER (prior = 'escalated') AS already_escalated,
  count(*) FILTER (prior = 'not_enrolled') AS not_enrolled,
  count(*) FILTER (recoverable) AS recoverable,
  round(count(*) FILTER (missed) / (count(*) FILTER (missed) + count(*) FILTER (prior = 'escalated')),
    9) AS missed_rate,
  round(count(*) FILTER (prior = 'escalated')
    / (count(*) FILTER (missed) + count(*) FILTER (prior = 'escalated')), 9) AS surfaced_recall,
  coalesce((SELECT CASE WHEN n / total > 0.5 THEN gate END FROM (
    SELECT gate, count(*) AS n, sum(count(*)) OVER () AS total FROM flagged
    WHERE recoverable AND {when} GROUP BY gate) ORDER BY n DESC, gate DESC LIMIT 1), '')
    AS dominant_gate
FROM flagged WHERE {when}"""
SQL["surfaced_report"] = "WITH " + SURFACED + _REPORT.replace(
    "{when}", "surfaced_on >= DATE '1997-01-01'")
SQL["surfaced_by_channel"] = "WITH " + SURFACED + """
SELECT channel, count(*) AS n FROM flagged GROUP BY channel"""
SQL["surfaced_by_gate"] = "WITH " + SURFACED + """
SELECT gate AS blocking_gate, count(*) AS n FROM flagged WHERE recoverable GROUP BY gate"""

SQL["prior_verdicts"] = """
WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS d FROM orders
           WHERE o_orderpriority = '1-URGENT'),
h AS (SELECT o_orderkey AS k, o_custkey, o_orderdate::DATE AS d, o_orderstatus AS v,
        o_totalprice AS x FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT c.o_orderkey AS concern_id, c.o_custkey::VARCHAR AS pid, strftime(c.d, '%Y-%m-%d') AS at,
  coalesce(strftime(arg_max(h.d, (h.d, h.k)), '%Y-%m-%d'), '') AS prior_at,
  coalesce(arg_max(h.v, (h.d, h.k)), 'not_enrolled') AS prior_verdict,
  coalesce(round(arg_max(h.x, (h.d, h.k)), 2), 0)::DOUBLE AS shortfall
FROM c LEFT JOIN h ON h.o_custkey = c.o_custkey AND h.d < c.d
GROUP BY c.o_orderkey, c.o_custkey, c.d"""

_STEP = f"least(0.05, {rd('0.70 - precision', 3)})"
SQL["tightening_proposals"] = "WITH " + BOOK + f"""
SELECT gate, t AS current, {rd(f"least(0.95, t + {_STEP})", 3)} AS proposed,
  'tighten' AS direction,
  'Realised precision on closed ESCALATE cases is ' || {f("precision", 2)}
    || ' against a floor of 0.70, over ' || judged || ' judged cases. Raising the ' || gate
    || ' threshold by ' || {f(_STEP, 3)} || ' is the smallest change that addresses it.' AS rationale
FROM weekly, (VALUES ('evidence', 0.65::DOUBLE), ('consistency', 0.70::DOUBLE)) AS g(gate, t)
WHERE judged >= 20 AND precision < 0.70"""

_DOWN = f"least(0.05, {rd('missed_rate - 0.30', 3)})"
SQL["loosening_proposals"] = "WITH " + BOOK + ",\n" + SURFACED + ",\nreport AS (" + \
    _REPORT.replace("{when}", "true") + f"""),
gate_counts AS (SELECT gate, count(*) AS n FROM flagged WHERE recoverable GROUP BY gate)
SELECT gate, t AS current, {rd(f"greatest(0.40, t - {_DOWN})", 3)} AS proposed,
  CASE WHEN greatest(0.40, t - {_DOWN}) < t THEN 'loosen' WHEN greatest(0.40, t - {_DOWN}) > t
    THEN 'tighten' ELSE 'none' END AS direction,
  missed || ' of ' || (missed + already_escalated) || ' welfare concerns that surfaced through '
    || 'another channel had been declined by this system — a missed rate of '
    || {f("missed_rate", 2)} || ' against a ceiling of 0.30. The ' || gate || ' gate blocked ' || n
    || ' of ' || recoverable || ' recoverable misses. Realised precision is ' || {f("precision", 2)}
    || ', so there is headroom to lower it by ' || {f(_DOWN, 3)} || '. This is surfaced-case '
    || 'recall and not recall: concerns that never surfaced are invisible to this figure.'
    AS rationale
FROM report JOIN gate_counts ON gate = dominant_gate JOIN (VALUES ('evidence', 0.65::DOUBLE),
  ('consistency', 0.70::DOUBLE), ('persistence', 0.20::DOUBLE), ('actionability', 0.50::DOUBLE))
  AS g(gate, t) USING (gate), weekly
WHERE judged >= 20 AND precision >= 0.30 AND missed + already_escalated >= 15 AND missed_rate > 0.30"""

SQL["subgroup_proposals"] = "WITH " + SUBGROUPS + f"""
SELECT 'subgroup:' || key || '=' || value AS gate, 0.0::DOUBLE AS current, 0.0::DOUBLE AS proposed,
  'Subgroup ' || key || '=' || value || ' shows precision ' || {f("precision", 2)}
    || ' against 0.90 overall. No threshold change is proposed — a threshold applies to '
    || 'everybody, and this is a model problem. Escalation for this subgroup should be reviewed '
    || 'directly.' AS rationale
FROM metrics WHERE positives >= 3 AND precision < 0.90"""

SQL["board_decisions"] = "WITH " + BOOK + f"""
SELECT gate, t AS before, CASE WHEN gate = 'evidence' AND judged >= 20 AND precision < 0.70
    THEN {rd(f"least(0.95, t + {_STEP})", 3)} ELSE t END AS after
FROM weekly, (VALUES ('evidence', 0.65::DOUBLE), ('consistency', 0.70::DOUBLE),
  ('persistence', 0.20::DOUBLE), ('actionability', 0.50::DOUBLE)) AS g(gate, t)"""


def _psi(rows: str) -> str:
    return f"""
WITH s AS ({rows}), sizes AS (SELECT side, count(*) AS n FROM s GROUP BY side),
bins AS (SELECT side, least(9, floor(round(score * 10, 9)))::INT AS bin, count(*) AS c FROM s
         GROUP BY ALL),
shares AS (
  SELECT i.bin, z.side, greatest(0.0001, coalesce(b.c, 0) / z.n) AS share
  FROM (SELECT range AS bin FROM range(10)) i CROSS JOIN sizes z
  LEFT JOIN bins b ON b.bin = i.bin AND b.side = z.side
), paired AS (
  SELECT bin, max(share) FILTER (side = 'baseline') AS e, max(share) FILTER (side = 'current') AS o
  FROM shares GROUP BY bin)
SELECT {rd("sum((o - e) * ln(o / e))", 4)} AS psi,
  CASE WHEN sum((o - e) * ln(o / e)) >= 0.25 THEN 'frozen' ELSE 'ok' END AS status FROM paired"""


SQL["score_drift"] = _psi("""
SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 'baseline' ELSE 'current' END AS side,
  o_totalprice / 450000 AS score FROM orders""")
SQL["score_drift_frozen"] = _psi("""
SELECT CASE WHEN lang = 'en' THEN 'baseline' ELSE 'current' END AS side,
  CASE WHEN lang = 'en' THEN n_chars / 8000.0::DOUBLE ELSE n_chars / 30000.0::DOUBLE END AS score
FROM documents""")
