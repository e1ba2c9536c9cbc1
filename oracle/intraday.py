"""SQL twins of the intraday queries."""

from __future__ import annotations

from oracle.base import CONTEXT, GATES, SCREEN, rd, screened

SQL: dict[str, str] = {}

SCORED = """
answers AS (
  SELECT o_orderkey AS response_id, o_custkey::VARCHAR AS pid, o_orderdate AS taken_at,
    list_transform(string_split(lpad(round(o_totalprice * 100)::BIGINT::VARCHAR, 9, '0'), ''),
                   lambda d: d::INT % 5) AS a FROM orders
), responses AS (
  SELECT *, CASE WHEN len(list_filter(a, lambda x: x > 3)) > 0
      THEN 'each item score must be 0 to 3' END AS refused,
    list_sum(a)::BIGINT AS total FROM answers
), good AS (
  SELECT *, total >= 10 AS above, a[9] > 0 AS acute FROM responses WHERE refused IS NULL
)"""

SQL["assessment_scoring"] = "WITH " + SCORED + """
SELECT response_id, pid, coalesce(refused, '') AS refused_because,
  CASE WHEN refused IS NULL THEN total ELSE -1 END AS total,
  refused IS NULL AND total >= 10 AS above_cutoff FROM responses"""

SQL["acute_routes"] = "WITH " + SCORED + """
SELECT response_id, pid, 'item_9' AS acute, 'mental_health_authority' AS routed_to,
  strftime(taken_at + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS acknowledge_by
FROM good WHERE acute"""

_NIGHT = CONTEXT.split("), hits AS")[0].replace("case_devs", "night_devs").replace(
    "case_facts", "night_facts") + ")"

FOLDED = SCREEN + ",\n" + _NIGHT + ",\n" + SCORED + f""",
reports AS (
  SELECT pid, max(total) AS total, bool_or(above) AS above, arg_max(acute, response_id) AS acute
  FROM good GROUP BY pid
), submitted AS (SELECT f.*, r.total, r.above, r.acute FROM night_facts f JOIN reports r USING (pid)
), fresh AS (
  SELECT s.pid, s.unit_id, 'self_report' AS domain,
    {rd("greatest(greatest(0, (s.total - 10) / 5), coalesce(d.z_self, 0))", 4)} AS z_self,
    coalesce(d.z_unit, 0)::DOUBLE AS z_unit, 'elevated' AS direction, 'T1' AS tier,
    1.0::DOUBLE AS weight,
    CASE WHEN s.above THEN greatest(coalesce(d.breach_0, 0), 1.0) ELSE d.breach_0 END::DOUBLE AS breach_0,
    CASE WHEN s.above AND d.breach_1 IS NOT NULL THEN greatest(d.breach_1, 1.0)
      ELSE d.breach_1 END::DOUBLE AS breach_1,
    CASE WHEN s.above AND d.breach_2 IS NOT NULL THEN greatest(d.breach_2, 1.0)
      ELSE d.breach_2 END::DOUBLE AS breach_2,
    s.cohort_size, coalesce(f.unit_fraction, 0)::DOUBLE AS unit_fraction
  FROM submitted s LEFT JOIN night_devs d ON d.pid = s.pid AND d.domain = 'self_report'
  LEFT JOIN fractions f ON f.unit_id = s.unit_id AND f.domain = 'self_report'
)"""

SQL["self_report_fold"] = "WITH " + FOLDED + """
SELECT f.pid, CASE WHEN s.acute THEN 'item_9' ELSE '' END AS acute_items,
  round(z_self, 9) AS z_self, round(z_unit, 9) AS z_unit,
  ((coalesce(breach_0, 0) > 0)::INT + (coalesce(breach_1, 0) > 0)::INT
    + (coalesce(breach_2, 0) > 0)::INT)::BIGINT AS windows_breached,
  coalesce(round(breach_0, 9), -1) AS breach_0, coalesce(round(breach_1, 9), -1) AS breach_1,
  coalesce(round(breach_2, 9), -1) AS breach_2
FROM fresh f JOIN submitted s USING (pid)"""

REDECIDED = FOLDED + """,
merged AS (
  SELECT pid, unit_id, domain, z_self, z_unit, direction, tier, weight, breach_0, breach_1,
    breach_2, cohort_size, unit_fraction FROM night_devs
  WHERE domain <> 'self_report' AND pid IN (SELECT pid FROM submitted)
  UNION ALL SELECT * FROM fresh
), case_devs AS (
  SELECT m.*, c.status, c.welfare_contact,
    c.status IN ('ACTIVE', 'PARTIAL') AND c.dropped <> m.domain AS covered
  FROM merged m JOIN consent c USING (pid)
), case_facts AS (
  SELECT pid, unit_id, status, welfare_contact, cohort_size, capacity FROM submitted
), hits AS (
  SELECT pid, unit_id, domain, 'unit_op_tempo' AS rule, 0.70::DOUBLE AS mass
  FROM case_devs WHERE round(unit_fraction, 9) >= 0.40
), acute AS (SELECT pid, 'item_9' AS items FROM submitted WHERE acute
),
""" + GATES.replace("{persistence}", "0.20").split(", cases AS (")[0]

SQL["intraday_verdicts"] = "WITH " + REDECIDED + """
SELECT pid, decision, reason, recommended, round(evidence, 9) AS evidence,
  round(consistency, 9) AS consistency, round(persistence, 9) AS persistence,
  round(actionability, 9) AS actionability
FROM verdicts JOIN recommended USING (pid)"""

SQL["acute_records"] = "WITH " + REDECIDED + """
SELECT 'override.applied' AS action, g.pid AS subject_pid, coalesce(unit_id, '') AS unit_id,
  response_id, 'item_9' AS acute_items, concat_ws(',',
    CASE WHEN NOT evidence_passed THEN 'evidence' END,
    CASE WHEN NOT consistency_passed THEN 'consistency' END,
    CASE WHEN NOT persistence_passed THEN 'persistence' END,
    CASE WHEN NOT actionability_passed THEN 'actionability' END) AS bypassed_gates,
  'mental_health_authority' AS routed_to, 12::BIGINT AS acknowledge_by_hours,
  strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS at
FROM good g LEFT JOIN verdicts v ON v.pid = g.pid WHERE g.acute"""

SQL["alerts_queued"] = "WITH " + REDECIDED + """
SELECT pid, unit_id, CASE decision WHEN 'ESCALATE' THEN 'routine' ELSE 'same_day' END AS priority,
  CASE decision WHEN 'ESCALATE' THEN 'welfare_officer' ELSE 'mental_health_authority' END AS route_to,
  split_part(recommended, ',', 1) AS intervention, reason, '2024-01-31 07:00:00' AS deliver_after
FROM verdicts JOIN recommended USING (pid)
WHERE decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE')"""

SQL["alerts_shadow"] = "WITH " + REDECIDED + """
SELECT 'verdict.recorded' AS action, decision AS would_have_alerted, count(*) AS n
FROM verdicts WHERE decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE') GROUP BY decision"""

# The queue itself, one event after the other: lists of waiting and served alerts per person.
QUEUE = """
log AS (
  SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'enqueue'
      WHEN o_orderpriority = '5-LOW' THEN 'cancel' ELSE 'deliver' END AS kind,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders
), state AS (
  SELECT pid, 0::BIGINT AS pos, []::BIGINT[] AS waiting, []::BIGINT[] AS served_alert,
    []::BIGINT[] AS served_at FROM (SELECT DISTINCT pid FROM log)
  UNION ALL
  SELECT s.pid, l.pos,
    CASE l.kind WHEN 'enqueue' THEN list_append(s.waiting, l.seq) WHEN 'cancel' THEN []::BIGINT[]
      ELSE s.waiting[2:] END,
    CASE WHEN l.kind = 'deliver' AND len(s.waiting) > 0
      THEN list_append(s.served_alert, s.waiting[1]) ELSE s.served_alert END,
    CASE WHEN l.kind = 'deliver' AND len(s.waiting) > 0
      THEN list_append(s.served_at, l.seq) ELSE s.served_at END
  FROM state s JOIN log l ON l.pid = s.pid AND l.pos = s.pos + 1
), final AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY pid ORDER BY pos DESC) = 1
), alerts AS (
  SELECT pid, unnest(served_alert) AS seq, unnest(served_at) AS delivered_seq FROM final
  UNION ALL SELECT pid, unnest(waiting), -1 FROM final
)"""
SQL["alerts_final"] = "WITH RECURSIVE " + QUEUE + "\nSELECT pid, seq, delivered_seq FROM alerts"
SQL["alerts_pending"] = "WITH RECURSIVE " + QUEUE + """
SELECT 'U' || (pid::BIGINT % 10) AS unit_id, count(*) AS n FROM alerts WHERE delivered_seq = -1
GROUP BY 1"""

SQL["journal_replay"] = "WITH " + SCORED + """
SELECT pid, count(*) AS events, max(total) AS total, arg_max(acute, response_id) AS acute
FROM good WHERE taken_at < TIMESTAMP '2001-01-01' AND response_id % 3 <> 0 GROUP BY pid"""

SQL["driver_phrases"] = screened("""
SELECT domain || s AS feature, n, CASE domain
    WHEN 'leave' THEN 'how often your leave applications were denied'
    WHEN 'duty_roster' THEN 'how many consecutive duty days you worked without a clear break'
    WHEN 'workload' THEN 'your duty hours against what the unit is established for'
    WHEN 'training' THEN 'how many course and training days you were assigned'
    ELSE 'the wellness self-assessment you filled in' END || w AS plain
FROM (SELECT domain, count(*) AS n FROM signals GROUP BY domain)
CROSS JOIN (VALUES ('_mean_7d', ' over the last week'), ('_mean_30d', ' over the last 30 days'),
  ('_mean_90d', ' over the last 90 days'), ('_mean_180d', ''),
  ('_slope', ' — and the direction it has been moving')) AS v(s, w)""")

SQL["daily_tumbling"] = screened("""
SELECT pid, domain, strftime(observed_at, '%Y-%m-%d') AS day, round(avg(value), 9) AS value,
  count(*) AS n FROM signals GROUP BY ALL""")

SQL["daily_store_values"] = SQL["daily_tumbling"]

SQL["journal_replay_kinds"] = """
WITH e AS (
  SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq, o_orderpriority AS p, o_orderstatus AS s,
    floor(o_totalprice)::BIGINT AS whole,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'self_report,voice'
        WHEN 'O' THEN 'self_report' ELSE 'voice' END
      WHEN o_orderpriority = '2-HIGH' THEN '' END AS given
  FROM orders
), placed AS (
  SELECT *, coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY pid ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS scope FROM e
), t AS (
  SELECT *, p = '3-MEDIUM' AND scope LIKE 'self_report%' AS told, p = '4-NOT SPECIFIED' AND scope LIKE '%voice' AS heard
  FROM placed
)
SELECT pid, count(*) AS events, count(*) FILTER (p = '5-LOW') AS skipped, arg_max(scope, seq) AS scope,
  coalesce(arg_max(s = 'F', seq) FILTER (p = '1-URGENT'), false) AS welfare_contact,
  count(*) FILTER (told) AS assessments, coalesce(max(whole % 31) FILTER (told), -1) AS total,
  coalesce(bool_or(whole % 31 >= 20) FILTER (told), false) AS above_cutoff,
  coalesce(arg_max(whole % 7 = 0, seq) FILTER (told), false) AS acute, count(*) FILTER (heard) AS sittings,
  coalesce(arg_max(whole::DOUBLE, seq) FILTER (heard), -1) AS level
FROM t GROUP BY pid"""
