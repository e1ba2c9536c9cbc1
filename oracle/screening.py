"""SQL twins of the screening queries."""

from __future__ import annotations


from oracle.base import CONTEXT, GATES, SCREEN, f, pct, rd, run, screened, sg, short

SQL: dict[str, str] = {}

RAW = """
raw AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'self_report' WHEN 'error' THEN 'workload'
              WHEN 'click' THEN 'duty_roster' WHEN 'purchase' THEN 'leave' ELSE 'training' END
              AS domain,
         json_extract_string(props, '$.k')::INT AS k
  FROM events
), typed AS (
  SELECT domain, user_id::VARCHAR AS service_number, 'U' || (user_id % 10) AS unit_id,
         CASE WHEN k < 50 THEN ts::TIMESTAMP(0) WHEN k IN (6, 8) THEN NULL
              ELSE ts::DATE::TIMESTAMP END::DATE AS d,
         CASE WHEN k < 2 THEN 'blank_id'
              WHEN k < 50 THEN CASE WHEN k = 3 OR k = 5 THEN 'bad_number' WHEN k = 4 THEN 'negative' END
              WHEN k IN (6, 8) THEN 'bad_date' END AS reject_reason,
         least(1.0::DOUBLE, round(value, 2) / 100.0::DOUBLE) AS value
  FROM raw
), ranged AS (
  SELECT *, reject_reason IS NULL AND d BETWEEN DATE '2024-01-30' - 19 AND DATE '2024-01-30'
    AS in_window FROM typed
)"""

SQL["raw_row_validation"] = "WITH " + RAW + """
SELECT domain, reject_reason, count(*) AS n FROM ranged WHERE reject_reason IS NOT NULL
GROUP BY ALL"""

SQL["accepted_records"] = "WITH " + RAW + """
SELECT service_number, unit_id, domain, strftime(d, '%Y-%m-%d') AS d, count(*) AS n,
       round(sum(value), 9) AS total, round(max(value), 9) AS top
FROM ranged WHERE in_window GROUP BY ALL"""

SQL["extract_accepted"] = SQL["accepted_records"]
SQL["extract_quarantine"] = SQL["raw_row_validation"]

SQL["source_completeness"] = "WITH " + RAW + """,
expected AS (
  SELECT domain, round_even((SELECT count(DISTINCT user_id) FROM events) * 20 * rate, 0)::BIGINT
           AS expected_rows, domain <> 'biometric' AS available
  FROM (VALUES ('self_report', 0.5::DOUBLE), ('workload', 1.0), ('duty_roster', 2.0),
               ('leave', 3.0), ('training', 4.0), ('biometric', 1.0)) AS r(domain, rate)
), counts AS (
  SELECT domain, count(*) FILTER (in_window) AS n_rows,
         count(*) FILTER (reject_reason IS NOT NULL) AS rejected,
         count(*) FILTER (reject_reason IS NULL AND NOT in_window) AS out_of_window
  FROM ranged GROUP BY domain
)
SELECT domain, expected_rows, coalesce(n_rows, 0) AS rows, coalesce(rejected, 0) AS rejected,
       coalesce(out_of_window, 0) AS out_of_window,
       round(CASE WHEN expected_rows <= 0 THEN 0
                  ELSE greatest(0, 1 - coalesce(n_rows, 0) / expected_rows) END, 9)::DOUBLE
         AS missing_fraction,
       CASE WHEN NOT available THEN 'unavailable' WHEN coalesce(rejected, 0) > 0 THEN 'partial'
            ELSE 'ok' END AS status
FROM expected LEFT JOIN counts USING (domain)"""

_KEY = b"registered query secret".ljust(64, b"\0")
_IPAD, _OPAD = ("".join(f"\\x{b ^ m:02X}" for b in _KEY) for m in (0x36, 0x5C))
_EPOCH = (19752 - 20454) // 90  # 2024-01-30 against 2026-01-01, in days since 1970


def _hmac(message: str) -> str:
    return (f"sha256('{_OPAD}'::BLOB || unhex(sha256('{_IPAD}'::BLOB || ({message})::BLOB)))")


SQL["pseudonyms"] = f"""
SELECT user_id::VARCHAR AS service_number,
       substr({_hmac(f"'E{_EPOCH:04d}:' || user_id::VARCHAR")}, 1, 32) AS pid,
       count(*) AS n, true AS verified
FROM events GROUP BY user_id"""

SQL["pseudonym_epochs"] = """
WITH d AS (
  SELECT floor(date_diff('day', DATE '2026-01-01', o_orderdate::DATE) / 90)::BIGINT AS epoch
  FROM orders)
SELECT epoch, 'E' || printf('%04d', epoch) AS epoch_label,
       strftime(DATE '2026-01-01' + (epoch * 90)::INT, '%Y-%m-%d') AS epoch_start,
       strftime(DATE '2026-01-01' + (epoch * 90 + 89)::INT, '%Y-%m-%d') AS epoch_end,
       count(*) AS n
FROM d GROUP BY epoch"""

SQL["consent_filter"] = screened("""
SELECT pid, domain, count(*) AS n, round(sum(value), 9) AS total FROM covered GROUP BY ALL""")

SQL["normalise_report"] = screened("""
SELECT domain, count(*) AS rows_in, count(*) FILTER (drop_reason IS NULL) AS rows_out,
       count(*) FILTER (drop_reason = 'not_enrolled') AS not_enrolled,
       count(*) FILTER (drop_reason = 'no_consent') AS no_consent
FROM outcome GROUP BY domain""")

SQL["checked_signals"] = screened("""
SELECT domain, count(*) AS n, round(min(value), 9) AS low, round(max(value), 9) AS high
FROM signals GROUP BY domain""")

SQL["sealed_payloads"] = """
SELECT event_type, count(*) AS n, count(*) AS opened, 0::BIGINT AS opened_by_others
FROM events GROUP BY event_type"""

_ORDER_EPOCH = "floor(date_diff('day', DATE '2026-01-01', o_orderdate::DATE) / 90)::BIGINT"

SQL["identity_lookup"] = """
WITH first AS (
  SELECT o_custkey::VARCHAR AS pid, min(o_orderdate::DATE) AS day, count(*) AS n
  FROM orders GROUP BY ALL)
SELECT pid, n, floor(date_diff('day', DATE '2026-01-01', day) / 90)
  = floor(date_diff('day', DATE '2026-01-01', DATE '1995-03-01') / 90) AS resolved FROM first"""

SQL["erase_and_purge"] = f"""
WITH left_over AS (
  SELECT {_ORDER_EPOCH} AS epoch, o_orderdate::DATE AS created_on FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500))
SELECT 'E' || printf('%04d', epoch) AS epoch_label, count(*) AS n,
       count(*) FILTER (epoch = -117 AND created_on >= DATE '1997-03-15') AS kept
FROM left_over GROUP BY epoch"""

SQL["latest_upsert"] = """
SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS at,
       o_orderstatus AS state
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
                                       ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""

SQL["daily_collapse"] = screened("""
SELECT pid, unit_id, domain, strftime(day, '%Y-%m-%d') AS day, round(value, 9) AS value, n_rows
FROM daily""")

SQL["personal_baseline"] = screened("""
SELECT pid, domain, base_n AS n, round(base_mean, 9) AS mean, round(base_stdev, 9) AS stdev,
       round(latest, 9) AS latest, base_n >= 4 AS usable FROM base""")

SQL["unit_baseline"] = screened("""
SELECT unit_id, domain, unit_n, round(unit_mean, 9) AS unit_mean,
       round(unit_stdev, 9) AS unit_stdev FROM unit_base""")

SQL["breach_fractions"] = screened("""
SELECT pid, domain, round(level, 9)::DOUBLE AS level, round(breach_0, 9) AS breach_0,
       round(breach_1, 9) AS breach_1, round(breach_2, 9) AS breach_2
FROM profile JOIN breaches USING (pid, domain)""")

SQL["window_means"] = screened("""
SELECT pid, domain, n_3, n_7, n_10, n_20, round(mean_3, 9) AS mean_3, round(mean_7, 9) AS mean_7,
       round(mean_10, 9) AS mean_10, round(mean_20, 9) AS mean_20 FROM profile""")

_DOMAINS = ("self_report", "workload", "duty_roster", "leave", "training")
_WINDOWS = (3, 7, 10, 20)


def _mean(d: str, w: int) -> str:
    return f"coalesce(max(mean_{w}) FILTER (domain = '{d}'), 0)"


SQL["feature_matrix"] = screened(
    "SELECT pid, unit_id, "
    + ", ".join([f"{rd(_mean(d, w), 6)} AS {d}_mean_{w}d"
                 for d in _DOMAINS for w in _WINDOWS]
                + [f"{rd(_mean(d, 3) + ' - ' + _mean(d, 20), 6)} AS {d}_slope"
                   for d in _DOMAINS])
    + " FROM profile GROUP BY pid, unit_id")

SQL["rolling_baseline"] = screened("""
SELECT a.pid, a.domain, strftime(a.day, '%Y-%m-%d') AS day, count(b.value) AS n,
       round(avg(b.value), 9) AS mean
FROM alldays a LEFT JOIN alldays b ON a.pid = b.pid AND a.domain = b.domain
  AND b.day BETWEEN a.day - 9 AND a.day - 3
GROUP BY a.pid, a.domain, a.day""", """
alldays AS (SELECT pid, domain, observed_at::DATE AS day, avg(value) AS value
            FROM covered GROUP BY ALL)""")

SQL["retention"] = screened("""
SELECT domain, count(*) FILTER (day >= DATE '2024-01-30' - 14) AS kept,
       count(*) FILTER (day < DATE '2024-01-30' - 14) AS removed
FROM (SELECT DISTINCT pid, domain, observed_at::DATE AS day FROM covered) GROUP BY domain""")

SQL["membership"] = screened("""
SELECT pid, unit_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains,
       count(*) AS observed_days FROM daily GROUP BY pid, unit_id""")

_DEVS = """
SELECT pid, unit_id, domain, round(z_self, 9) AS z_self, round(z_unit, 9) AS z_unit, direction,
       windows_breached, tier, weight, round(breach_0, 9) AS breach_0,
       round(breach_1, 9) AS breach_1, round(breach_2, 9) AS breach_2 FROM devs"""

SQL["deviations"] = screened(_DEVS)

SQL["deviations_default_windows"] = """
WITH signals AS (
  SELECT l_suppkey::VARCHAR AS pid, 'N' || s_nationkey AS unit_id,
         unnest([l_returnflag, l_linestatus]) AS domain, l_shipdate::DATE AS day,
         least(1.0::DOUBLE, l_quantity / 50.0::DOUBLE) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_shipdate::DATE BETWEEN DATE '2001-06-30' - 269 AND DATE '2001-06-30'
), daily AS (
  SELECT pid, unit_id, domain, day, avg(value) AS value,
         date_diff('day', day, DATE '2001-06-30') AS age FROM signals GROUP BY ALL
), base AS (
  SELECT pid, domain, count(*) AS base_n, avg(value) AS base_mean,
         greatest(stddev_pop(value), 0.02) AS base_stdev
  FROM daily WHERE age >= 90 AND age < 270 GROUP BY ALL
), windows AS (
  SELECT pid, unit_id, domain, count(*) FILTER (age < 7) AS n_7,
         avg(value) FILTER (age < 7) AS mean_7, avg(value) FILTER (age < 30) AS mean_30,
         avg(value) FILTER (age < 90) AS mean_90 FROM daily GROUP BY ALL
), profile AS (SELECT * FROM windows LEFT JOIN base USING (pid, domain)
), breaches AS (
  SELECT d.pid, d.domain,
    count(*) FILTER (age < 7 AND round(value, 9) >= round(base_mean + 1.5 * base_stdev, 9)) / 7 AS breach_0,
    count(*) FILTER (age < 30 AND round(value, 9) >= round(base_mean + 1.5 * base_stdev, 9)) / 30 AS breach_1,
    count(*) FILTER (age < 90 AND round(value, 9) >= round(base_mean + 1.5 * base_stdev, 9)) / 90 AS breach_2
  FROM daily d JOIN base USING (pid, domain) GROUP BY ALL
), unit_base AS (
  SELECT unit_id, domain, avg(mean_7) AS unit_mean, greatest(stddev_pop(mean_7), 0.02) AS unit_stdev
  FROM profile WHERE n_7 > 0 GROUP BY ALL
), scored AS (
  SELECT p.*, b.breach_0, b.breach_1, b.breach_2, (mean_7 - base_mean) / base_stdev AS zs,
         (mean_7 - unit_mean) / unit_stdev AS zu
  FROM profile p JOIN unit_base USING (unit_id, domain) JOIN breaches b USING (pid, domain)
  WHERE base_n >= 10 AND n_7 > 0
), devs AS (
  SELECT pid, unit_id, domain, round(zs::DECIMAL(28,10), 4)::DOUBLE AS z_self,
         round(zu::DECIMAL(28,10), 4)::DOUBLE AS z_unit,
    CASE WHEN round(zs, 9) >= 0 THEN 'elevated' ELSE 'reduced' END AS direction,
    ((round(abs(zs), 9) >= 2)::INT
     + (round(abs((coalesce(mean_30, 0) - base_mean) / base_stdev), 9) >= 2)::INT
     + (round(abs((coalesce(mean_90, 0) - base_mean) / base_stdev), 9) >= 2)::INT)::BIGINT
      AS windows_breached,
    CASE WHEN domain IN ('F', 'O') THEN 'T3' ELSE 'T2' END AS tier,
    CASE WHEN domain IN ('F', 'O') THEN 0.4 ELSE 0.7 END::DOUBLE AS weight,
    breach_0, breach_1, breach_2
  FROM scored WHERE round(abs(zs), 9) >= 2.0 OR round(abs(zu), 9) >= 2.0
)""" + _DEVS

_LAX = SQL["deviations_default_windows"].replace(">= 2.0", ">= 0.5").replace(">= 2)", ">= 0.5)")
SQL["seasonal_deviations"] = f"""
SELECT pid, domain FROM (SELECT pid, domain, direction FROM ({_LAX}))
JOIN (SELECT pid, domain, direction FROM ({_LAX.replace("2001-06-30", "2000-06-30")}))
  USING (pid, domain, direction)"""

SQL["missingness"] = screened("""
SELECT domain, round(round(greatest(0, 1 - n_rows
         / ((SELECT count(DISTINCT user_id) FROM events) * 15)), 4), 9)::DOUBLE AS missing,
       count(*) AS n
FROM devs JOIN (SELECT domain, count(*) FILTER (in_window) AS n_rows FROM ranged GROUP BY domain)
  USING (domain) GROUP BY ALL""", RAW)

SQL["candidates_and_cleared"] = screened("""
SELECT DISTINCT pid, unit_id, 'DEVIATING' AS decision FROM devs
UNION ALL
SELECT DISTINCT pid, unit_id, 'CLEARED' FROM profile WHERE pid NOT IN (SELECT pid FROM devs)""")

SQL["unit_fractions"] = screened("""
SELECT unit_id, domain, cohort_size, round(unit_fraction, 9) AS unit_fraction FROM fractions""")

SQL["deviating_by_unit"] = screened("""
SELECT unit_id, count(DISTINCT pid) AS people, count(*) AS deviations,
       count(*) FILTER (direction = 'elevated') AS elevated FROM devs GROUP BY unit_id""")

SQL["roster_rhythm"] = screened(f"""
SELECT pid, observed_days, longest_run, break_adequacy, block_variance, regularity,
  CASE WHEN longest_run = 0 THEN 'no duty days recorded in the last ' || observed_days || ' days'
  ELSE 'longest unbroken run ' || longest_run || ' days'
    || CASE WHEN longest_run > 14 THEN ' — beyond the 14-day sustainable run' ELSE '' END || '; '
    || {pct("break_adequacy")} || ' of breaks were 2 days or longer; roster regularity '
    || {f("regularity", 2)} END AS phrase
FROM rated""", """
flags AS (
  SELECT pid, day, round(value, 9) >= 0.5 AS is_on,
         row_number() OVER (PARTITION BY pid ORDER BY day)
         - row_number() OVER (PARTITION BY pid, round(value, 9) >= 0.5 ORDER BY day) AS island
  FROM daily WHERE domain = 'duty_roster'
), runs AS (SELECT pid, is_on, island, count(*) AS length FROM flags GROUP BY ALL
), shape AS (
  SELECT pid, sum(length)::BIGINT AS observed_days,
    coalesce(max(length) FILTER (is_on), 0) AS longest, count(*) FILTER (is_on) AS n_on,
    count(*) FILTER (NOT is_on) AS n_off,
    coalesce(count(*) FILTER (NOT is_on AND length >= 2)
             / nullif(count(*) FILTER (NOT is_on), 0), 0) AS adequacy,
    CASE WHEN count(*) FILTER (is_on) > 1
         THEN least(1, stddev_pop(length) FILTER (is_on) / avg(length) FILTER (is_on))
         WHEN count(*) FILTER (is_on) = 1 THEN 1 ELSE 0 END AS cv
  FROM runs GROUP BY pid
), rated AS (
  SELECT pid, observed_days, observed_days >= 4 AND n_on > 0 AS ok,
    (CASE WHEN ok THEN longest ELSE 0 END)::BIGINT AS longest_run,
    (CASE WHEN ok THEN round(adequacy, 4) ELSE 0 END)::DOUBLE AS break_adequacy,
    (CASE WHEN ok THEN round(cv, 4) ELSE 0 END)::DOUBLE AS block_variance,
    (CASE WHEN ok THEN round((1 - cv) * (0.5 + 0.5 * adequacy)
      * CASE WHEN longest <= 14 THEN 1 ELSE 14 / longest END, 4) ELSE 0 END)::DOUBLE AS regularity
  FROM shape
)""")

SQL["confounder_hits"] = run("SELECT pid, domain, rule, mass, label, detail FROM hits")

SQL["gate_evidence"] = run(f"""
SELECT pid, round(weighted_volume, 9) AS weighted_volume, distinct_domains, has_t1,
       round(evidence, 9) AS evidence, evidence_passed,
       'evidence = 0.50x' || {f("volume", 3)} || ' + 0.30x' || {f("breadth", 3)} || ' + 0.20x'
       || has_t1::INT || ' = ' || {f("evidence", 3)} AS evidence_formula
FROM gates""")

SQL["gate_consistency"] = run("""
SELECT pid, round(consistency, 9) AS consistency, consistency_passed, n_domains,
       coalesce(per_domain, '') AS per_domain, coalesce(
         (SELECT string_agg(DISTINCT rule, ',' ORDER BY rule) FROM hits h WHERE h.pid = g.pid), '')
         AS confounders, consistency_formula
FROM gates g""")

SQL["gate_persistence"] = run(f"""
SELECT pid, round(w0, 9) AS window_0, round(w1, 9) AS window_1, round(w2, 9) AS window_2,
       round(persistence, 9) AS persistence, persistence_passed,
       '0.20x' || {f("w0", 3)} || ' + 0.45x' || {f("w1", 3)} || ' + 0.35x' || {f("w2", 3)}
       || ' = ' || {f("persistence", 3)} AS persistence_formula
FROM gates""")

SQL["gate_actionability"] = run(f"""
SELECT pid, matched, has_match, contact_ok, capacity, round(actionability, 9) AS actionability,
       actionability_passed,
       'actionability = ' || has_match::INT || ' x 1 x ' || contact_ok::INT
       || ' x (0.75 + 0.25x' || capacity::INT || ') = ' || {f("actionability", 3)}
         AS actionability_formula
FROM gates""")

SQL["verdicts"] = run("""
SELECT pid, unit_id, decision, reason, failed_gates, recommended,
       round(composite, 9) AS composite, '2026.09.05-1' AS config_version
FROM verdicts JOIN recommended USING (pid)""")

_MIND = f"""
ev_items AS (
  SELECT pid, 0 AS stuck, round(0.65 - round(evidence, 4), 9) AS shortfall, 0 AS ord,
    'evidence' AS gate, round(evidence, 4) AS current, 0.65::DOUBLE AS required,
    concat_ws(' / ', 'volume(' || {short("weighted_volume", 4)} || ',2.4)',
      'domains(' || distinct_domains || ',3)', CASE WHEN NOT has_t1 THEN 'no_self_report()' END) AS failed_because,
    concat_ws(' / ',
      CASE WHEN NOT has_t1 AND round(0.65 - evidence, 9) <= 0.20 THEN 'self_report(0.20)' END,
      CASE WHEN volume < 1 THEN 'service_records(' || t2 || ',' || {f("needed", 2)} || ')' END,
      CASE WHEN breadth < 1 THEN 'more_domains(' || (3 - distinct_domains) || ')' END) AS would_change_if,
    true AS recoverable
  FROM (SELECT *, round(0.65 - evidence, 9) / 0.5 * 2.4 AS needed,
          ceil(round(round(0.65 - evidence, 9) / 0.5 * 2.4 / 0.7, 9))::BIGINT AS t2 FROM gates)
  WHERE NOT evidence_passed
), hit_text AS (
  SELECT pid, string_agg('explained(' || rule || ',' || domain || ',' || {f("mass", 2)} || ')', ' / '
      ORDER BY domain) AS because,
    string_agg('outlasts(' || rule || ',' || domain || ',' || {f("mass", 2)} || ')', ' / ' ORDER BY domain) AS changes
  FROM hits GROUP BY pid
), co_items AS (
  SELECT pid, (because IS NULL)::INT AS stuck, round(0.70 - round(consistency, 4), 9) AS shortfall,
    1 AS ord, 'consistency' AS gate, round(consistency, 4) AS current, 0.70::DOUBLE AS required,
    coalesce(because, 'domains_disagree(' || n_domains || ')') AS failed_because,
    coalesce(changes, 'same_direction()') AS would_change_if,
    because IS NOT NULL AS recoverable
  FROM gates LEFT JOIN hit_text USING (pid) WHERE NOT consistency_passed
), pe_items AS (
  SELECT pid, 0 AS stuck, round(0.20 - round(persistence, 4), 9) AS shortfall, 2 AS ord,
    'persistence' AS gate, round(persistence, 4) AS current, 0.20::DOUBLE AS required,
    'breach(3d=' || {short("w0", 4)} || ',7d=' || {short("w1", 4)} || ',10d=' || {short("w2", 4)} || ')'
      AS failed_because,
    CASE WHEN days > 0 AND round(round(w1, 4) + extra, 9) <= 1 THEN 'days_within(' || days || ',7)'
    ELSE 'throughout(10)' END AS would_change_if,
    true AS recoverable
  FROM (SELECT *, round(0.20 - persistence, 9) / 0.45 AS extra,
          ceil(round(least(1 - round(w1, 4), round(0.20 - persistence, 9) / 0.45) * 7, 9))::BIGINT
            AS days FROM gates) WHERE NOT persistence_passed
), ac_items AS (
  SELECT pid, 0 AS stuck, round(0.50 - round(actionability, 4), 9) AS shortfall, 3 AS ord,
    'actionability' AS gate, round(actionability, 4) AS current, 0.50::DOUBLE AS required,
    concat_ws(' / ', CASE WHEN NOT contact_ok THEN 'no_contact_consent()' END,
      CASE WHEN NOT has_match THEN 'no_playbook_match()' END) AS failed_because,
    concat_ws(' / ', CASE WHEN NOT contact_ok THEN 'contact_consent()' END,
      CASE WHEN NOT has_match THEN 'playbook_entry()' END) AS would_change_if,
    true AS recoverable
  FROM gates WHERE NOT actionability_passed
), items AS (
  SELECT * FROM ev_items UNION ALL SELECT * FROM co_items UNION ALL SELECT * FROM pe_items
  UNION ALL SELECT * FROM ac_items
)"""

SQL["counterfactuals"] = run("""
SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY stuck, shortfall, ord) - 1 AS position,
       gate, round(current, 9) AS current, required, failed_because, would_change_if, recoverable
FROM items""", _MIND)

SQL["state_violations"] = """
WITH log AS (
  SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'ESCALATED' WHEN '2-HIGH' THEN 'CONTACTED'
      WHEN '3-MEDIUM' THEN 'CLOSED' WHEN '4-NOT SPECIFIED' THEN 'MONITORED' ELSE 'OBSERVED' END
      AS state FROM orders
), moves AS (
  SELECT *, lag(state) OVER (PARTITION BY pid ORDER BY seq) AS previous FROM log
), legal(previous, state) AS (VALUES
  ('OBSERVED','DEVIATING'),('OBSERVED','CLEARED'),('DEVIATING','SCORED'),('DEVIATING','CLEARED'),
  ('SCORED','REVIEWED'),('REVIEWED','GATED'),('GATED','ESCALATED'),('GATED','MONITORED'),
  ('GATED','CLEARED'),('ESCALATED','CONTACTED'),('ESCALATED','MONITORED'),('ESCALATED','CLOSED'),
  ('CONTACTED','CLOSED'),('MONITORED','OBSERVED'),('MONITORED','ESCALATED'),('MONITORED','CLEARED')
)
SELECT pid, seq, previous, state FROM moves m WHERE previous IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM legal l WHERE l.previous = m.previous AND l.state = m.state)"""

SQL["risk_advocate_findings"] = run(f"""
SELECT f.pid, CASE WHEN count(r.domain) = 0 THEN 'concern=none'
    ELSE 'concern=' || string_agg(line, ',' ORDER BY pos) FILTER (pos <= 3)
      || CASE WHEN bool_or(tier = 'T1') THEN ';told_by_the_person'
         WHEN count(*) >= 3 THEN ';together=' || count(*) ELSE '' END END AS narrative,
  coalesce(string_agg(stance, ' / ' ORDER BY pos), '') AS assessments
FROM case_facts f LEFT JOIN ranked r USING (pid) GROUP BY f.pid""", f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY abs(z_self) DESC, domain) AS pos,
    domain || ':' || direction || ':z=' || {sg("z_self", 1)} || ':windows=' || windows_breached AS line,
    domain || '|' || CASE WHEN abs(z_self) >= 1 THEN 'supports' ELSE 'insufficient' END
      || '|z_self=' || {sg("z_self", 2)} || ', z_unit='
      || {sg("z_unit", 2)} || ', tier ' || tier AS stance
  FROM cons
)""")

SQL["confounder_check_findings"] = run(f"""
SELECT f.pid, CASE WHEN h.pid IS NULL THEN 'benign=none' || CASE WHEN n_consented < 2 THEN ';single_domain' ELSE '' END
  ELSE 'benign=' || parts || ';whole_unit' END AS narrative,
  coalesce((SELECT string_agg(c.domain || CASE WHEN h2.domain IS NULL
      THEN '|supports|none' ELSE '|contradicts|' || h2.reason END, ' / '
      ORDER BY c.domain)
    FROM cons c LEFT JOIN reasons h2 ON h2.pid = c.pid AND h2.domain = c.domain
    WHERE c.pid = f.pid), '') AS assessments,
  CASE WHEN h.pid IS NULL THEN '' ELSE 'unit_op_tempo' END AS confounders_found
FROM gates f LEFT JOIN (SELECT pid, string_agg(domain || ': ' || reason, ' | ' ORDER BY domain)
  AS parts FROM reasons GROUP BY pid) h USING (pid)""", f"""
reasons AS (
  SELECT pid, domain, label || ':mass=' || {f("mass", 2)} || ': ' || detail AS reason FROM hits
)""")

_PRECEDENTS = """
precedent(ord, code, drivers, action, outcome, note) AS (VALUES
 (1,'P-001','leave duty roster','WLF-LEAVE','supported','Leave sanction reviewed with the adjutant; two applications had been held pending rather than refused. Resolved within the week.'),
 (2,'P-002','duty roster workload','WLF-REST','supported','Rotation adjusted after 40 consecutive duty days. The pattern did not recur in the following quarter.'),
 (3,'P-003','deployment transfer','WLF-FAMILY','supported','Third posting in eighteen months with family at the previous station. Family liaison arranged; compassionate posting review initiated.'),
 (4,'P-004','self report workload','WLF-COUNSEL','already_known','Unit counselling cell was already engaged. The flag added nothing and the case was closed as duplicate.'),
 (5,'P-005','duty roster leave workload','WLF-REST','not_supported','Unit was mid-deployment; the whole company showed the same pattern. Raised with the commanding officer as a rostering matter instead.'),
 (6,'P-006','training workload','WLF-TRAINING-LOAD','supported','Two overlapping course assignments. One was deferred a cycle.'),
 (7,'P-007','self report','WLF-PEER','declined_contact','Peer-support offered and declined. Consent to welfare contact was subsequently narrowed, and that is the person''s right.')
), tokens AS (SELECT DISTINCT pid, unnest(string_split(domain, '_')) AS token FROM cons
), theirs AS (SELECT ord, unnest(string_split(drivers, ' ')) AS token FROM precedent
), sizes AS (SELECT pid, count(*) AS n FROM tokens GROUP BY pid
), overlap AS (
  SELECT t.pid, p.ord, count(*) AS shared FROM tokens t JOIN theirs p USING (token) GROUP BY ALL
), scored_precedents AS (
  SELECT o.pid, p.*, o.shared / (s.n + (SELECT count(*) FROM theirs x WHERE x.ord = p.ord) - o.shared)
    AS score FROM overlap o JOIN sizes s USING (pid) JOIN precedent p USING (ord)
), top_precedents AS (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, ord) AS pos
  FROM scored_precedents QUALIFY pos <= 3
)"""

SQL["precedent_matches"] = run("""
SELECT pid, pos - 1 AS position, code, round(score, 9) AS score, action, outcome
FROM top_precedents""", _PRECEDENTS)

SQL["welfare_context_findings"] = run(f"""
SELECT f.pid,
  CASE WHEN f.n_consented = 0 THEN 'precedents=none;no_domain' ELSE
    'precedents=' || coalesce(lines, 'none') || ';strength=' || f.cohort_size || ';capacity=free'
    || CASE WHEN cautions IS NULL THEN '' ELSE ';caution=' || cautions END END AS narrative,
  CASE WHEN f.n_consented = 0 THEN '' ELSE coalesce(actions, 'WLF-REST') END
    AS precedent_interventions
FROM gates f LEFT JOIN (
  SELECT pid, string_agg(code || ':overlap=' || {pct("score")} || ':' || outcome || ': ' || note, ' | '
      ORDER BY pos) AS lines,
    string_agg(code || ':' || outcome, ',' ORDER BY pos)
      FILTER (outcome IN ('not_supported', 'already_known')) AS cautions,
    string_agg(action, ',' ORDER BY pos) AS actions
  FROM top_precedents GROUP BY pid) USING (pid)""", _PRECEDENTS)

SQL["funnel"] = run("""
SELECT count(*) AS screened, count(*) FILTER (decision <> 'CLEARED') AS deviating,
  count(*) FILTER (decision <> 'CLEARED') AS reviewed,
  count(*) FILTER (decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE')) AS escalated,
  count(*) FILTER (decision = 'MONITOR') AS monitored,
  count(*) FILTER (decision = 'NO_FLAG') AS no_flag,
  count(*) FILTER (decision = 'CLEARED') AS cleared FROM cases""")

SQL["run_headline"] = run("""
SELECT 'Overnight: ' || format('{:,}', count(*)) || ' screened · '
  || count(*) FILTER (decision <> 'CLEARED') || ' deviating · '
  || count(*) FILTER (decision <> 'CLEARED') || ' reviewed · '
  || count(*) FILTER (decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE')) || ' escalated' AS headline,
  'COMPLETE' AS status FROM cases""")

SQL["run_summary"] = run("""
SELECT '{"run_id":"run-1","as_of":"2024-01-30","config_version":"2026.09.05-1","screened":'
  || count(*) || ',"deviating":' || count(*) FILTER (decision <> 'CLEARED')
  || ',"reviewed":' || count(*) FILTER (decision <> 'CLEARED')
  || ',"escalated":' || count(*) FILTER (decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE'))
  || ',"monitored":' || count(*) FILTER (decision = 'MONITOR')
  || ',"no_flag":' || count(*) FILTER (decision = 'NO_FLAG')
  || ',"cleared":' || count(*) FILTER (decision = 'CLEARED') || '}' AS summary FROM cases""")

SQL["caseload"] = run("""
SELECT pid, unit_id, decision, round(composite, 9) AS composite FROM verdicts
WHERE decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE')""")

SQL["scoped_caseload"] = run("""
SELECT 'officer-' || s_suppkey AS operator, 'welfare_officer' AS role, pid, unit_id AS case_unit,
  decision, contacted IS NOT NULL AS contacted, coalesce(closed_as, '') AS closed_as,
  contacted IS NOT NULL AND closed_as IS NULL AS blocking
FROM verdicts JOIN supplier ON unit_id = 'U' || s_nationkey AND s_acctbal > 0
LEFT JOIN (
  SELECT o_custkey::VARCHAR AS pid, true AS contacted, arg_max(CASE o_orderpriority
      WHEN '2-HIGH' THEN 'supported' WHEN '3-MEDIUM' THEN 'not_supported'
      WHEN '4-NOT SPECIFIED' THEN 'already_known' ELSE 'declined_contact' END, o_orderkey)
      FILTER (o_orderpriority <> '1-URGENT') AS closed_as FROM orders GROUP BY ALL) USING (pid)
WHERE decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE')""")

SQL["monitored_cases"] = run("""
SELECT pid, unit_id, round(composite, 9) AS composite FROM verdicts WHERE decision = 'MONITOR'""")

SQL["refused_nearest"] = run("""
SELECT pid, substr(pid, 1, 12) AS short_pid, unit_id, decision, reason, round(composite, 9) AS composite,
  round(miss, 9) AS closest_miss FROM (
  SELECT *, round(coalesce(least(CASE WHEN NOT evidence_passed THEN 0.65 - evidence END,
    CASE WHEN NOT consistency_passed THEN 0.70 - consistency END,
    CASE WHEN NOT persistence_passed THEN 0.20 - persistence END,
    CASE WHEN NOT actionability_passed THEN 0.50 - actionability END), 99.0), 4)::DOUBLE AS miss
  FROM verdicts WHERE decision IN ('MONITOR', 'NO_FLAG'))
ORDER BY miss, pid LIMIT 12""")

SQL["own_reasons"] = run("""
SELECT pid, decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE') AS named_to_an_officer,
  CASE WHEN decision IN ('ESCALATE', 'IMMEDIATE_ESCALATE')
    THEN 'named_with_reasons' ELSE 'withheld_with_reasons' END AS message, gate, round(value, 4)::DOUBLE AS value,
  threshold::DOUBLE AS threshold, passed
FROM (
  SELECT pid, decision, 'evidence' AS gate, evidence AS value, 0.65 AS threshold, evidence_passed AS passed FROM verdicts
  UNION ALL SELECT pid, decision, 'consistency', consistency, 0.70, consistency_passed FROM verdicts
  UNION ALL SELECT pid, decision, 'persistence', persistence, 0.20, persistence_passed FROM verdicts
  UNION ALL SELECT pid, decision, 'actionability', actionability, 0.50, actionability_passed FROM verdicts)""")

SQL["case_payload"] = run(f"""
SELECT pid, decision, reason, 'evidence' AS first_gate,
  'evidence = 0.50x' || {f("volume", 3)} || ' + 0.30x' || {f("breadth", 3)} || ' + 0.20x'
    || has_t1::INT || ' = ' || {f("evidence", 3)} AS formula,
  0.65::DOUBLE AS threshold_0, 0.70::DOUBLE AS threshold_1, 0.20::DOUBLE AS threshold_2,
  0.50::DOUBLE AS threshold_3, nullif(split_part(recommended, ',', 1), '') AS first_action
FROM verdicts JOIN recommended USING (pid)""")

SQL["gate_table"] = run(f"""
SELECT pid, decision, 'evid' || CASE WHEN evidence_passed THEN '+' ELSE '-' END || {f("evidence", 2)}
  || ' cons' || CASE WHEN consistency_passed THEN '+' ELSE '-' END || {f("consistency", 2)}
  || ' pers' || CASE WHEN persistence_passed THEN '+' ELSE '-' END || {f("persistence", 2)}
  || ' acti' || CASE WHEN actionability_passed THEN '+' ELSE '-' END || {f("actionability", 2)}
  AS gates, reason, substr(reason, 1, 38) AS short_reason FROM verdicts""")

SQL["units_covered"] = run("SELECT DISTINCT unit_id FROM cases WHERE unit_id <> ''")

SQL["threshold_sweep"] = run("""
SELECT threshold, escalated, round(escalated / screened, 9) AS rate,
       ceil(escalated / 6)::BIGINT AS officers
FROM (SELECT t.threshold, count(*) FILTER (n_consented > 0 AND consistency_passed
        AND persistence_passed AND actionability_passed AND round(evidence, 9) >= t.threshold)
        AS escalated, (SELECT count(DISTINCT pid) FROM profile) AS screened
      FROM verdicts CROSS JOIN (VALUES (0.4::DOUBLE), (0.5), (0.6), (0.65), (0.7), (0.75), (0.8))
        AS t(threshold) GROUP BY t.threshold)""")

SQL["panel_findings"] = run("""
SELECT reviewer, status, count(*) AS n FROM (
  SELECT unnest(['risk_advocate', 'confounder_check', 'welfare_context']) AS reviewer,
         unnest(['ok', 'ok', 'unavailable']) AS status FROM case_facts) GROUP BY ALL""")

SQL["frozen_run"] = run("""
SELECT CASE decision WHEN 'ESCALATE' THEN 'MONITOR' ELSE decision END AS decision,
  CASE decision WHEN 'ESCALATE' THEN 'all gates passed but escalation is frozen for this run '
    || '(reviewer unavailable or model drift beyond threshold)' ELSE reason END AS reason,
  'no_counter_case:monitor_only' AS freeze_reason, count(*) AS n
FROM verdicts GROUP BY ALL""")


SQL["verdicts_with_calendars"] = "WITH " + SCREEN + ",\n" + CONTEXT.split("), hits AS")[0].replace(
    "true AS capacity", "max(calm::INT) = 1 AS capacity").replace(
    "FROM case_devs GROUP BY", "FROM case_devs JOIN (SELECT unit_id, max(unit_fraction) < 0.4 AS calm "
    "FROM fractions GROUP BY unit_id) USING (unit_id) GROUP BY") + """
), entries AS (
  SELECT DISTINCT o_custkey::VARCHAR AS pid,
    CASE o_orderstatus WHEN 'F' THEN 'leave' ELSE 'training' END AS domain,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'planned_leave_cycle'
      WHEN '2-HIGH' THEN 'scheduled_training' ELSE 'seasonal_roster' END AS rule
  FROM orders WHERE floor(o_totalprice / 50000) >= 5
), hits AS (
  SELECT pid, domain, 'unit_op_tempo' AS rule, 0.70::DOUBLE AS mass FROM case_devs
  WHERE round(unit_fraction, 9) >= 0.40
  UNION ALL
  SELECT d.pid, d.domain, e.rule, CASE e.rule WHEN 'planned_leave_cycle' THEN 0.60
    WHEN 'scheduled_training' THEN 0.50 ELSE 0.45 END FROM case_devs d JOIN entries e
    USING (pid, domain)
), acute AS (SELECT NULL::VARCHAR AS pid, NULL::VARCHAR AS items WHERE false
), resting AS (
  SELECT o_custkey::VARCHAR AS pid FROM orders GROUP BY ALL HAVING max(o_totalprice) > 480000
),
""" + GATES.replace("{persistence}", "0.20").split(", verdicts AS (")[0] + """
, final AS (
  SELECT g.*, list_contains(string_split(matched, ','), 'WLF-REST') AND r.pid IS NOT NULL AS dup,
    CASE WHEN dup THEN 0 ELSE actionability END AS act
  FROM gates g LEFT JOIN resting r USING (pid)
)
SELECT pid, CASE WHEN n_consented = 0 OR round(act, 9) < 0.5 THEN 'NO_FLAG'
    WHEN NOT persistence_passed OR NOT evidence_passed OR NOT consistency_passed THEN 'MONITOR'
    ELSE 'ESCALATE' END AS decision,
  round(consistency, 9) AS consistency, round(act, 9)::DOUBLE AS actionability, capacity,
  coalesce((SELECT string_agg(DISTINCT rule, ',' ORDER BY rule) FROM hits h WHERE h.pid = f.pid), '')
    AS confounders, CASE WHEN dup THEN 'WLF-REST' ELSE '' END AS duplicate
FROM final f"""
