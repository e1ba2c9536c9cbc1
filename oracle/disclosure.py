"""SQL twins of the disclosure queries."""

from __future__ import annotations

from oracle.base import rd, run, uniform
from vigilframe import config

SQL: dict[str, str] = {}

REQUESTS = """
requests AS (
  SELECT o_orderkey AS seq, o_custkey::VARCHAR AS pid,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'welfare_officer' WHEN '2-HIGH' THEN
      'mental_health_authority' WHEN '3-MEDIUM' THEN 'commander'
      WHEN '4-NOT SPECIFIED' THEN 'personnel' ELSE 'auditor' END AS role,
    'op' || floor(o_totalprice / 100000)::BIGINT AS operator,
    ['welfare:screening','welfare:contact','welfare:acute','welfare:self','command:aggregate',
     'governance:audit','administrative:acr','administrative:promotion','administrative:posting'
    ][least(8, floor(o_totalprice / 60000))::INT + 1] AS purpose,
    'U' || (o_custkey % 10) AS unit_id,
    CASE o_orderstatus WHEN 'F' THEN ['U' || (o_orderkey % 10), 'U1']
      WHEN 'P' THEN ['U' || (o_custkey % 10)] ELSE []::VARCHAR[] END AS unit_scope
  FROM orders
), grants(role, purpose, may) AS (VALUES
  ('welfare_officer','welfare:screening',false),('welfare_officer','welfare:contact',true),
  ('mental_health_authority','welfare:screening',false),
  ('mental_health_authority','welfare:acute',true),('commander','command:aggregate',false),
  ('personnel','welfare:self',true),('auditor','governance:audit',false)
), checked AS (
  SELECT r.*, g.may,
    CASE WHEN starts_with(r.purpose, 'administrative:') THEN 'purpose ''' || r.purpose
        || ''' is barred for every role. Outputs of this system are not available to ACR, '
        || 'promotion, posting or disciplinary processes.'
      WHEN g.may IS NULL THEN 'role ''' || r.role || ''' has no grant for purpose ''' || r.purpose
        || ''''
      WHEN r.role IN ('welfare_officer', 'commander') AND len(unit_scope) = 0 THEN
        r.role || ':' || operator || ' has no unit scope. A ' || r.role || ' acts for named units; '
        || 'an empty scope is no authority, not universal authority.'
      WHEN len(unit_scope) > 0 AND NOT list_contains(unit_scope, unit_id) THEN
        r.role || ':' || operator || ' is not responsible for ' || unit_id || '; scope is ['
        || array_to_string(list_transform(list_sort(unit_scope), lambda u: '''' || u || ''''), ', ')
        || ']' END AS denied
  FROM requests r LEFT JOIN grants g USING (role, purpose)
)"""

SQL["access_decisions"] = "WITH " + REQUESTS + """
SELECT seq, role, purpose, CASE WHEN denied IS NOT NULL THEN 'denied' WHEN may THEN 'identify'
  ELSE 'aggregate' END AS access, coalesce(denied, '') AS because FROM checked"""

DECIDED = REQUESTS + """,
facts AS (
  SELECT q.*, coalesce(c.status, 'NOT_ENROLLED') AS status, c.welfare_contact AS contact,
    coalesce(v.decision, 'CLEARED') AS decision, p.c_name AS identity,
    CASE WHEN denied IS NOT NULL THEN NULL
      WHEN NOT may THEN 'aggregate-only grant'
      WHEN coalesce(c.status, 'NOT_ENROLLED') IN ('NOT_ENROLLED', 'REVOKED') THEN 'no consent basis'
      WHEN q.purpose <> 'welfare:acute' AND NOT c.welfare_contact
        THEN 'welfare contact not consented'
      WHEN coalesce(v.decision, 'CLEARED') NOT IN ('ESCALATE', 'IMMEDIATE_ESCALATE')
        THEN 'verdict is ' || coalesce(v.decision, 'CLEARED') END AS log_reason
  FROM checked q LEFT JOIN consent c USING (pid) LEFT JOIN verdicts v USING (pid)
  LEFT JOIN customer p ON p.c_custkey::VARCHAR = q.pid
)"""

SQL["disclosure_decisions"] = run("""
SELECT seq, pid, denied IS NULL AND log_reason IS NULL AND identity IS NOT NULL AS granted,
  CASE WHEN denied IS NULL AND log_reason IS NULL THEN coalesce(identity, '') ELSE '' END AS identity,
  CASE WHEN denied IS NOT NULL THEN denied
    WHEN log_reason = 'aggregate-only grant' THEN role || ':' || operator || ' may act for '''
      || purpose || ''' but only on aggregate data'
    WHEN log_reason = 'no consent basis' THEN 'no consent basis for this pid'
    WHEN log_reason = 'welfare contact not consented'
      THEN 'consent does not extend to welfare contact'
    WHEN log_reason IS NOT NULL THEN 'a ' || decision || ' verdict does not disclose an identity'
    WHEN identity IS NULL THEN 'pid could not be resolved (expired salt epoch, or unknown pid)'
    ELSE '' END AS because
FROM facts""", DECIDED)

SQL["disclosure_log"] = run("""
SELECT role || ':' || operator AS actor,
  CASE WHEN log_reason IS NULL THEN 'disclosure.granted' ELSE 'disclosure.denied' END AS action,
  purpose, coalesce(log_reason, '') AS reason, count(*) AS n
FROM facts WHERE denied IS NULL GROUP BY ALL""", DECIDED)

SERIES = """
gated AS (
  SELECT pid, unit_id, decision, composite, evidence, consistency, persistence, actionability
  FROM verdicts
  UNION ALL
  SELECT pid, unit_id, decision, composite, NULL, NULL, NULL, NULL FROM cases
  WHERE decision = 'CLEARED'
), series AS (
  SELECT unit_id, 'fatigue index' AS label, composite AS value FROM gated
  UNION ALL SELECT unit_id, 'evidence gate', evidence FROM gated
  UNION ALL SELECT unit_id, 'consistency gate', consistency FROM gated
  UNION ALL SELECT unit_id, 'persistence gate', persistence FROM gated
  UNION ALL SELECT unit_id, 'actionability gate', actionability FROM gated
  UNION ALL SELECT unit_id, 'deviating share', (decision <> 'CLEARED')::INT FROM gated
  UNION ALL SELECT unit_id, 'under active monitoring', (decision = 'MONITOR')::INT FROM gated
), grouped AS (
  SELECT unit_id, label, count(*) AS n, avg(value)::DOUBLE AS value FROM series
  WHERE value IS NOT NULL GROUP BY ALL
)"""

SQL["unit_view"] = run(f"""
SELECT unit_id, label, CASE WHEN n < 5 THEN 0 ELSE n END AS n,
  CASE WHEN n < 5 THEN NULL ELSE {rd("value", 4)} END AS value, n < 5 AS suppressed,
  CASE WHEN n < 5 THEN 'cohort below k=5' ELSE '' END AS reason FROM grouped""", SERIES)

_EPSILON = config.Config().epsilon_query
_ASKED = "'2024-01-30|' || unit_id || '|' || label || '|{}'"


def _laplace(scale: str, u: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


SQL["unit_view_private"] = run(f"""
SELECT unit_id, label,
  CASE WHEN n >= 5 THEN greatest(5, round_even(n + {_laplace(f"1.0 / {_EPSILON}", "un")}, 0)::BIGINT) END AS n,
  CASE WHEN n >= 5 THEN {rd(f"value + {_laplace(f'1.0 / {_EPSILON} / n', 'um')}", 4)} END AS value,
  n < 5 AS suppressed, spent
FROM (
  SELECT *, sum(CASE WHEN n < 5 THEN 0 ELSE 2 * {_EPSILON} END::DOUBLE) OVER (PARTITION BY unit_id ORDER BY label) AS spent,
    {uniform("release key", _ASKED.format("n"))} AS un, {uniform("release key", _ASKED.format("mean"))} AS um
  FROM grouped)
WHERE round(spent, 9) <= 5""", SERIES)

SQL["budget_carried"] = run(f"""
SELECT unit_id, label, suppressed, round(own + earlier, 9) AS spent FROM (
  SELECT *, max(CASE WHEN round(own, 9) <= 5 THEN own END) OVER (PARTITION BY unit_id) AS earlier FROM (
    SELECT unit_id, label, n < 5 AS suppressed,
      sum(CASE WHEN n < 5 THEN 0 ELSE 2 * {_EPSILON} END::DOUBLE) OVER (PARTITION BY unit_id ORDER BY label) AS own
    FROM grouped))
WHERE round(own + earlier, 9) <= 7""", SERIES)

SQL["release_log"] = run("""
SELECT unit_id, count(*) AS cells, count(*) FILTER (n < 12) AS suppressed,
  (count(*) FILTER (n >= 12) * 1.0)::DOUBLE AS epsilon,
  CASE WHEN count(*) FILTER (n < 12) < count(*) THEN 'aggregate.released'
    ELSE 'aggregate.suppressed' END AS action
FROM grouped GROUP BY unit_id""", SERIES)

SQL["heat_map"] = run(f"""
SELECT unit_id, sub_unit, domain, CASE WHEN n < 2 THEN 0 ELSE n END AS n,
  CASE WHEN n < 2 THEN NULL ELSE {rd("v", 4)} END AS value, n < 2 AS suppressed,
  CASE WHEN n < 2 THEN 'suppressed' WHEN {rd("v", 4)} >= 0.75 THEN 'critical'
    WHEN {rd("v", 4)} >= 0.55 THEN 'high' WHEN {rd("v", 4)} >= 0.35 THEN 'moderate'
    WHEN {rd("v", 4)} >= 0.18 THEN 'low' ELSE 'nominal' END AS band
FROM (
  SELECT c.unit_id, 'Coy ' || chr((65 + c.pid::BIGINT % 4)::INT) AS sub_unit, h.domain,
    count(s.pid) AS n, avg(c.composite) FILTER (s.pid IS NOT NULL) AS v
  FROM cases c CROSS JOIN (VALUES ('duty_roster'), ('leave'), ('workload'), ('deployment'),
    ('transfer'), ('training')) AS h(domain)
  LEFT JOIN cons s ON s.pid = c.pid AND s.domain = h.domain GROUP BY ALL)""")

SQL["laplace_noise"] = """
SELECT event_type, round(sum(x), 6) AS s, round(max(x), 6) AS top FROM (
  SELECT event_type, -2.0 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)) AS x FROM (
    SELECT event_type, greatest(0.001::DOUBLE, least(0.999::DOUBLE, value / 500)) AS u FROM events))
GROUP BY event_type"""

SQL["budget_use"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS asked,
  least(count(*), 120) AS admitted, count(*) - least(count(*), 120) AS refused,
  (least(count(*), 120) * 0.5)::DOUBLE AS spent,
  (60 - least(count(*), 120) * 0.5)::DOUBLE AS remaining
FROM orders GROUP BY 1"""

SQL["budget_admissions"] = """
SELECT period, seq, position FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderkey AS seq,
    row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS position,
    sum(0.5) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS spent
  FROM orders) WHERE spent <= 60"""

SQL["release_cache"] = """
WITH released AS (
  SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority || '|' || floor(o_totalprice / 50000)::BIGINT AS label
  FROM orders WHERE o_orderstatus = 'P')
SELECT q.period, q.label, count(*) - any_value((r.period IS NULL)::INT)::BIGINT AS hits,
  any_value((r.period IS NULL)::INT)::BIGINT AS misses
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority || '|' || floor(o_totalprice / 50000)::BIGINT AS label FROM orders
      WHERE o_orderstatus <> 'P') q LEFT JOIN released r USING (period, label)
GROUP BY q.period, q.label"""

SQL["new_questions"] = """
SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority || '|' || floor(o_totalprice / 50000)::BIGINT AS label FROM orders
WHERE o_orderstatus = 'O'
EXCEPT SELECT strftime(o_orderdate, '%Y-%m'), o_orderpriority || '|' || floor(o_totalprice / 50000)::BIGINT FROM orders WHERE o_orderstatus = 'F'
"""

CHAIN = """
parts AS (
  SELECT event_id AS seq, event_id // 1024 AS segment, event_id % 1024 AS pos,
    round(value * 100)::BIGINT AS cents, event_type, user_id, ts
  FROM events
), texts AS (
  SELECT *, '{"action":"' || event_type || '","actor":"system:gate_engine","at":"'
      || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","detail":{"cents":"' AS h1, '"},"prev_hash":"' AS h2,
    '","purpose":"welfare:screening","seq":' || seq || ',"subject_pid":"' || user_id
      || '","unit_id":"U' || (user_id % 10) || '"}' AS tail
  FROM parts
), chain AS (
  SELECT segment, pos, seq, repeat('0', 64) AS prev_hash,
    sha256(h1 || cents || h2 || repeat('0', 64) || tail) AS entry_hash FROM texts WHERE pos = 0
  UNION ALL
  SELECT t.segment, t.pos, t.seq, c.entry_hash,
    sha256(t.h1 || t.cents || t.h2 || c.entry_hash || t.tail)
  FROM chain c JOIN texts t ON t.segment = c.segment AND t.pos = c.pos + 1
)"""

SQL["ledger_chain"] = "WITH RECURSIVE " + CHAIN + """
SELECT segment, seq, prev_hash, entry_hash FROM chain"""

SQL["ledger_heads"] = "WITH RECURSIVE " + CHAIN + """,
tops AS (
  SELECT segment, arg_max(entry_hash, seq) AS head, count(*) AS rows FROM chain GROUP BY segment
), linked AS (
  SELECT segment, head, rows, sha256(head || repeat('0', 64)) AS chained_head FROM tops
  WHERE segment = 0
  UNION ALL
  SELECT t.segment, t.head, t.rows, sha256(t.head || l.chained_head)
  FROM linked l JOIN tops t ON t.segment = l.segment + 1
)
SELECT * FROM linked"""

TREE = CHAIN + """,
tops AS (
  SELECT segment, arg_max(entry_hash, seq) AS head, count(*) AS rows FROM chain GROUP BY segment
), tree AS (
  SELECT 0 AS level, segment AS idx, sha256('leaf|' || segment || '|' || rows || '|' || head) AS hash FROM tops
  UNION ALL
  SELECT level + 1, idx // 2, sha256('node|' || hash || '|' || right_hash)
  FROM (SELECT *, lead(hash) OVER (ORDER BY idx) AS right_hash FROM tree)
  WHERE idx % 2 = 0 AND right_hash IS NOT NULL
)"""

ROOTS = TREE + """,
peaks AS (
  SELECT size, list(hash ORDER BY level) AS h
  FROM (SELECT unnest(range(1, (SELECT count(*) FROM tops) + 1)) AS size)
  JOIN tree ON (size >> level) & 1 = 1 AND idx = (size >> (level + 1)) << 1 GROUP BY size
), roots AS (
  SELECT size, sha256('root|' || size || '|' || list_reduce(h,
    lambda bag, x: sha256('node|' || x || '|' || bag))) AS root FROM peaks
)"""

SQL["ledger_tree"] = "WITH RECURSIVE " + TREE + """
SELECT level, idx, hash FROM tree WHERE level > 0"""

SQL["ledger_seals"] = "WITH RECURSIVE " + ROOTS + """
SELECT size, root FROM roots"""

SQL["ledger_consistency"] = "WITH RECURSIVE " + ROOTS + """
SELECT b.size AS before, least(b.size + 1 + b.size % 7, (SELECT max(size) FROM roots)) AS size,
  claimed.root = b.root AS consistent
FROM roots b JOIN roots claimed ON claimed.size = CASE WHEN b.size % 3 = 0 THEN b.size + 1 ELSE b.size END
WHERE b.size < (SELECT max(size) FROM roots)"""

SQL["ledger_verification"] = "WITH RECURSIVE " + CHAIN + """,
kept AS (
  SELECT c.*, t.cents, t.h1, t.h2, t.tail,
    CASE WHEN t.cents > 48000 THEN 0 ELSE t.cents END AS shown
  FROM chain c JOIN texts t USING (seq) WHERE t.cents <> 1234 AND c.segment NOT IN (1, 2)
), near AS (
  SELECT *, lag(seq) OVER w AS last_seq, lag(entry_hash) OVER w AS last_hash FROM kept
  WINDOW w AS (PARTITION BY segment ORDER BY seq)
)
SELECT segment, seq, CASE
    WHEN seq <> coalesce(last_seq + 1, segment * 1024) THEN 'sequence gap'
    WHEN prev_hash <> coalesce(last_hash, repeat('0', 64))
      THEN 'prev_hash does not match the entry before'
    ELSE 'content does not match its hash' END AS reason
FROM near WHERE seq <> coalesce(last_seq + 1, segment * 1024)
  OR prev_hash <> coalesce(last_hash, repeat('0', 64)) OR shown <> cents
UNION ALL
SELECT s.segment, s.segment * 1024, CASE
    WHEN s.segment = 2 OR (s.segment <> 1 AND k.n IS NULL) THEN 'segment missing'
    ELSE 'segment does not match its sealed head' END
FROM (SELECT segment, count(*) AS n, arg_max(entry_hash, seq) AS head FROM chain GROUP BY segment) s
LEFT JOIN (SELECT segment, count(*) AS n, arg_max(entry_hash, seq) AS head FROM kept
           GROUP BY segment) k USING (segment)
WHERE s.segment IN (1, 2) OR k.n IS NULL OR k.n <> s.n OR k.head <> s.head"""

SQL["ledger_reads"] = """
SELECT user_id::VARCHAR AS subject_pid, count(*) AS n, max(event_id) AS last_seq FROM events
WHERE event_type = 'error' GROUP BY user_id"""

SQL["ledger_latest"] = """
SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_type AS action,
  user_id::VARCHAR AS subject_pid FROM events ORDER BY event_id DESC LIMIT 200"""

FOLD = """
log AS (
  SELECT o_custkey::VARCHAR AS pid, o_orderkey AS seq, o_orderstatus <> 'O' AS contact,
    ['leave','deployment','duty_roster','transfer','training','workload','self_report',
     'biometric','voice'][least(8, floor(o_totalprice / 60000))::INT + 1] AS picked,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'enrol' WHEN o_orderpriority = '2-HIGH' THEN 'narrow'
      WHEN o_orderpriority = '3-MEDIUM' THEN 'widen'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'set_contact'
      WHEN o_orderstatus = 'F' THEN 'revoke' WHEN o_orderstatus = 'P' THEN 'complete'
      ELSE 'enrol' END AS kind, o_orderpriority = '5-LOW' AS whole
  FROM orders
), per_domain AS (
  SELECT pid, domain, arg_max(kind IN ('enrol', 'widen')
      AND CASE WHEN kind = 'enrol' AND NOT whole THEN domain <> picked ELSE true END, seq) AS granted
  FROM log CROSS JOIN (SELECT unnest(['leave','deployment','duty_roster','transfer','training',
    'workload','self_report','biometric','voice']) AS domain)
  WHERE kind IN ('enrol', 'revoke', 'complete')
    OR (kind IN ('narrow', 'widen') AND domain = picked)
  GROUP BY pid, domain
), scopes AS (
  SELECT pid, string_agg(domain, ',' ORDER BY domain) AS scope, count(*) AS n
  FROM per_domain WHERE granted GROUP BY pid
), people AS (
  SELECT pid, arg_max(kind, seq) AS last_kind,
    coalesce(arg_max(kind IN ('enrol', 'set_contact') AND contact, seq)
      FILTER (kind IN ('enrol', 'revoke', 'complete', 'set_contact')), false) AS welfare_contact
  FROM log GROUP BY pid
), states AS (
  SELECT pid, CASE WHEN last_kind = 'revoke' THEN 'REVOKED' WHEN n IS NULL THEN 'NOT_ENROLLED'
      WHEN n = 9 THEN 'ACTIVE' ELSE 'PARTIAL' END AS status, coalesce(scope, '') AS scope,
    welfare_contact
  FROM people LEFT JOIN scopes USING (pid)
)"""

SQL["consent_latest"] = "WITH " + FOLD + "\nSELECT * FROM states"
SQL["consent_enrolled"] = "WITH " + FOLD + """
SELECT pid, status FROM states WHERE status IN ('ACTIVE', 'PARTIAL')"""
SQL["consent_revocations"] = "WITH " + FOLD + "\nSELECT pid, seq FROM log WHERE kind = 'revoke'"
SQL["forgotten_rows"] = "WITH " + FOLD + """,
had AS (
  SELECT user_id::VARCHAR AS pid, 'journal' AS kind, event_id AS seq, false AS safe FROM events
  UNION ALL SELECT pid, 'receipts', seq, false FROM log WHERE log.kind = 'enrol'
  UNION ALL SELECT o_custkey::VARCHAR, 'alerts', o_orderkey, o_orderstatus = 'F' FROM orders
)
SELECT kind, pid, count(*) AS n FROM had
WHERE safe OR NOT EXISTS (
  SELECT 1 FROM log WHERE log.kind = 'revoke' AND log.pid = had.pid AND log.seq > had.seq)
GROUP BY ALL"""

TEXTS = """
texts AS (
  SELECT lang AS locale, 'v' || count(DISTINCT source) AS text_version,
    sha256(sum(h1) || '.' || sum(h2) || '.' || sum(h3) || '.' || sum(h4)) AS content_hash,
    CASE lang WHEN 'en' THEN 'source' WHEN 'de' THEN 'draft' ELSE 'reviewed' END AS review_status,
    CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
      ELSE 'Spanish' END AS english_name
  FROM (SELECT lang, source, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS h1,
          ('0x' || substr(sha256(text), 16, 15))::BIGINT AS h2,
          ('0x' || substr(sha256(text), 31, 15))::BIGINT AS h3,
          ('0x' || substr(sha256(text), 46, 15))::BIGINT AS h4 FROM documents WHERE lang IS NOT NULL)
  GROUP BY lang
), asked AS (
  SELECT c_custkey::VARCHAR AS pid, c_acctbal, CASE c_mktsegment WHEN 'FURNITURE' THEN 'fr'
    WHEN 'MACHINERY' THEN 'de' WHEN 'HOUSEHOLD' THEN 'it' WHEN 'BUILDING' THEN 'es' ELSE 'en' END AS locale,
    CASE WHEN c_acctbal < -500 THEN 'REVOKED' ELSE 'ENROLLED' END AS status
  FROM customer
)"""

SQL["consent_receipts"] = "WITH " + TEXTS + """
SELECT pid, locale, CASE WHEN review_status IN ('source', 'reviewed') THEN text_version ELSE '' END
    AS text_version,
  CASE WHEN review_status IS NULL THEN 'no consent text for locale ''' || locale
      || '''. It is not offered, and the system will not substitute another language.'
    WHEN review_status = 'draft' THEN 'the German translation is marked ''draft'' and has not been '
      || 'checked by a native speaker. Consent cannot be recorded against it. Offer a reviewed '
      || 'language instead.' ELSE '' END AS because
FROM asked LEFT JOIN texts USING (locale)"""

SQL["consent_capable_locales"] = "WITH " + TEXTS + """
SELECT locale, text_version, content_hash, review_status FROM texts
WHERE review_status IN ('source', 'reviewed')"""

SQL["reconsent"] = "WITH " + TEXTS + """
SELECT pid, CASE WHEN ok THEN c_acctbal < 1000 ELSE status <> 'REVOKED' END AS ask_again,
  CASE WHEN NOT ok AND status = 'REVOKED' THEN 'not enrolled'
    WHEN NOT ok THEN 'no receipt was recorded for this consent'
    WHEN c_acctbal >= 1000 THEN 'consent matches the current text'
    ELSE 'the ' || english_name || ' consent text has changed since this person agreed (they read '
      || 'v0, current is ' || text_version || '); they must be asked again rather than carried over'
    END AS why
FROM (SELECT *, coalesce(review_status IN ('source', 'reviewed'), false) AS ok
      FROM asked LEFT JOIN texts USING (locale))"""
