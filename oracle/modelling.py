"""SQL twins of the modelling queries."""

from __future__ import annotations

from oracle.base import rd, screened, uniform
from vigilframe import config

SQL: dict[str, str] = {}

SCORED = """
scored AS (
  SELECT doc_id::VARCHAR AS pid, round(least(1.0::DOUBLE, n_chars / 8000.0::DOUBLE), 2) AS score,
         quality::INT AS label, lang, source
  FROM labels JOIN documents USING (doc_id)
)"""


def _area(source: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}sum(label)::BIGINT AS positives, count(*) FILTER (label = 0) AS negatives,
  CASE WHEN sum(label) = 0 OR sum(label) = count(*) THEN 0.5 ELSE
    (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2)
    / (sum(label) * (count(*) - sum(label))) END::DOUBLE AS auroc
FROM (SELECT *, rank() OVER ({part}ORDER BY score)
        + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2 AS r FROM {source}) {group}"""


SQL["score_auroc"] = "WITH " + SCORED + f"""
SELECT positives, negatives, round(auroc, 9) AS auroc FROM ({_area("scored", "")})"""

CURVE = SCORED + """,
steps AS (SELECT range / 100 AS t FROM range(1, 100)),
curve AS (
  SELECT t AS threshold, count(*) FILTER (score >= t) AS flagged,
    count(*) FILTER (score >= t AND label = 1) AS tp, sum(label) AS actual,
    coalesce(count(*) FILTER (score >= t AND label = 1)
      / nullif(count(*) FILTER (score >= t), 0), 0)::DOUBLE AS precision,
    coalesce(count(*) FILTER (score >= t AND label = 1) / nullif(sum(label), 0), 0)::DOUBLE AS recall
  FROM steps CROSS JOIN scored GROUP BY t
)"""

SQL["threshold_curve"] = "WITH " + CURVE + """
SELECT round(threshold, 9) AS threshold, flagged, tp, round(precision, 9) AS precision,
       round(recall, 9) AS recall FROM curve"""

SQL["threshold_choice"] = "WITH " + CURVE + """,
choice AS (
  SELECT 0 AS pref, threshold, precision, recall, recall AS k FROM curve
  WHERE round(precision, 9) >= 0.70 AND recall > 0
  UNION ALL SELECT 1, threshold, precision, recall, precision FROM curve WHERE precision > 0
  UNION ALL SELECT 2, 1.0, 0.0, 0.0, 0.0)
SELECT round(threshold, 9) AS threshold, round(precision, 9) AS precision,
       round(recall, 9) AS recall FROM choice ORDER BY pref, k DESC, threshold DESC LIMIT 1"""

SQL["calibration_error"] = "WITH " + SCORED + f"""
SELECT {rd("sum(n * abs(s - l)) / sum(n)", 4)} AS ece FROM (
  SELECT least(9, floor(round(score * 10, 9))) AS bin, count(*) AS n, avg(score) AS s,
         avg(label) AS l FROM scored GROUP BY ALL)"""

SUBGROUPS = SCORED + f""",
long AS (
  SELECT pid, score, label, 'lang' AS key, lang AS value FROM scored
  UNION ALL SELECT pid, score, label, 'source', source FROM scored
), areas AS ({_area("long", "key, value")}
), metrics AS (
  SELECT key, value, n, positives, {rd("positives / n", 4)} AS positive_rate,
    {rd("auroc", 4)} AS auroc, {rd("p", 4)} AS precision, {rd("r", 4)} AS recall,
    positives >= 3 AS measured
  FROM (SELECT key, value, count(*) AS n,
      coalesce(count(*) FILTER (score >= 0.5 AND label = 1)
        / nullif(count(*) FILTER (score >= 0.5), 0), 0) AS p,
      coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(sum(label), 0), 0) AS r
    FROM long GROUP BY key, value) JOIN areas USING (key, value) WHERE n >= 5
)"""

SQL["subgroup_metrics"] = "WITH " + SUBGROUPS + "\nSELECT * FROM metrics"
SQL["subgroup_gap"] = "WITH " + SUBGROUPS + """
SELECT round(max(auroc) FILTER (measured) - min(auroc) FILTER (measured), 9) AS gap,
       count(*) FILTER (measured) AS measured, count(*) AS subgroups FROM metrics"""

_DOMAINS = ("self_report", "workload", "duty_roster", "leave", "training")
_NAMES = [f"{d}_mean_{w}d" for d in _DOMAINS for w in (3, 7, 10, 20)] + [
    f"{d}_slope" for d in _DOMAINS]


def _mean(d: str, w: int) -> str:
    return f"coalesce(max(mean_{w}) FILTER (domain = '{d}'), 0)"


MATRIX = ("matrix AS (SELECT pid, unit_id, "
          + ", ".join([f"{rd(_mean(d, w), 6)} AS {d}_mean_{w}d" for d in _DOMAINS
                       for w in (3, 7, 10, 20)]
                      + [f"{rd(_mean(d, 3) + ' - ' + _mean(d, 20), 6)} AS {d}_slope"
                         for d in _DOMAINS])
          + " FROM profile GROUP BY pid, unit_id)")

SQL["training_rows"] = screened(
    "SELECT pid, " + ", ".join(f"{d}_slope" for d in _DOMAINS) + """,
  CASE WHEN c_nationkey * 2 + 18 < 30 THEN 'under-30' WHEN c_nationkey * 2 + 18 < 40 THEN '30-39'
       ELSE '40-plus' END AS age_band, c_mktsegment AS rank, (c_acctbal >= 6000)::BIGINT AS label
FROM matrix JOIN customer ON pid = c_custkey::VARCHAR""", MATRIX)

SQL["training_matrix"] = screened(
    "SELECT " + ", ".join(f"{rd(n, 6)} AS {n}" for n in _NAMES) + """,
  CASE WHEN c_nationkey * 2 + 18 < 30 THEN 'under-30' WHEN c_nationkey * 2 + 18 < 40 THEN '30-39'
       ELSE '40-plus' END AS age_band, c_mktsegment AS rank, (c_acctbal >= 6000)::BIGINT AS label
FROM matrix JOIN customer ON pid = c_custkey::VARCHAR""", MATRIX)

SQL["driver_topk"] = screened(f"""
SELECT pid, pos - 1 AS position, feature, {rd("value", 5)} AS contribution FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY abs(value) DESC, ord) AS pos
  FROM contributions) WHERE pos <= 3""", MATRIX, "contributions AS (" + " UNION ALL ".join(
    f"SELECT pid, {i} AS ord, '{n}' AS feature, {n} * ({i + 1}::DOUBLE / {len(_NAMES)}) AS value "
    "FROM matrix" for i, n in enumerate(_NAMES)) + ")")

SQL["hazard_horizons"] = "WITH " + SCORED + f""",
h AS (SELECT pid, least(0.95::DOUBLE, greatest(0.0001::DOUBLE, score / 5)) AS h FROM scored),
risk AS (
  SELECT pid, h, {rd("1 - pow(1 - h, 7 / 7)", 4)} AS risk_7d,
    {rd("1 - pow(1 - h, 30 / 7)", 4)} AS risk_30d, {rd("1 - pow(1 - h, 60 / 7)", 4)} AS risk_60d,
    {rd("1 - pow(1 - h, 90 / 7)", 4)} AS risk_90d, 7 * ln(0.5) / ln(1 - h) AS days FROM h
), placed AS (
  SELECT *, CASE WHEN risk_7d >= 0.5 THEN 7 WHEN risk_30d >= 0.5 THEN 30
    WHEN risk_60d >= 0.5 THEN 60 WHEN risk_90d >= 0.5 THEN 90 END::BIGINT AS soonest FROM risk)
SELECT pid, risk_7d, risk_30d, risk_60d, risk_90d,
  coalesce(CASE WHEN days <= 90 THEN round_even(days, 0)::BIGINT END::VARCHAR, '') AS median_days,
  coalesce(soonest::VARCHAR, '') AS soonest,
  CASE WHEN soonest IS NULL THEN 'the modelled hazard does not reach an even chance within 90 days'
    ELSE 'the modelled hazard reaches an even chance within ' || soonest || ' days' END AS phrase
FROM placed"""

FED = """
coords AS (
  SELECT 'V' || label AS unit_id, pos - 1 AS pos, embedding[pos]::DOUBLE AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(pos)
), local AS (
  SELECT unit_id, pos, avg(x) AS v, count(*) AS n FROM coords GROUP BY ALL
), norms AS (
  SELECT unit_id, max(n) AS n_examples, sqrt(sum(v * v)) AS norm FROM local GROUP BY unit_id
), sent AS (
  SELECT unit_id, pos, n_examples, norm,
         v * CASE WHEN norm <= 0.05 THEN 1 ELSE 0.05 / norm END AS v
  FROM local JOIN norms USING (unit_id)
)"""
SQL["federated_clip"] = "WITH " + FED + """
SELECT unit_id, any_value(n_examples) AS n_examples, round(any_value(norm), 9) AS norm,
       any_value(norm) > 0.05 AS clipped, round(sqrt(sum(v * v)), 9) AS update_norm
FROM sent GROUP BY unit_id"""
SQL["federated_average"] = "WITH " + FED + """
SELECT pos::BIGINT AS pos, round(sum(v * n_examples) / sum(n_examples), 9) AS step
FROM sent GROUP BY pos"""

_KEY = "'1|' || unit_id || '|' || pos || '|{}'"
SQL["federated_noised_average"] = "WITH " + FED + f""", drawn AS (
  SELECT *, {uniform("federation key", _KEY.format("r"))} AS u, {uniform("federation key", _KEY.format("a"))} AS w FROM sent
)
SELECT pos::BIGINT AS pos, round(sum((v + {config.Config().noise_multiplier} * 0.05 * sqrt(-2 * ln(u)) * cos(2 * pi() * w))
  * n_examples) / sum(n_examples), 9) AS step
FROM drawn GROUP BY pos"""

ROUNDS = """
per AS (
  SELECT floor(vec_id / 7)::BIGINT AS round, count(DISTINCT label) AS units
  FROM embeddings GROUP BY ALL
), asked AS (
  SELECT *, sum((units >= 5)::INT) OVER (ORDER BY round) AS n FROM per
), played AS (
  SELECT 'c1' AS campaign, round, units, units >= 5 AND n <= 8 AS completed,
    CASE WHEN units >= 5 AND n <= 8 THEN 1.0 ELSE 0.0 END::DOUBLE AS epsilon,
    CASE WHEN units < 5 THEN 'too few units' WHEN n > 8 THEN 'budget exhausted' ELSE '' END AS reason
  FROM asked
)"""
SQL["federated_rounds"] = "WITH " + ROUNDS + "\nSELECT * FROM played"
SQL["federated_campaign"] = "WITH " + ROUNDS + """
SELECT campaign, count(*) FILTER (completed) AS rounds_completed,
  count(*) FILTER (NOT completed) AS rounds_skipped, round(sum(epsilon), 4) AS epsilon_spent,
  round(greatest(0, 8.0 - sum(epsilon)), 4)::DOUBLE AS epsilon_remaining
FROM played GROUP BY campaign"""

INTERVALS = """
WITH last_day AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
people AS (
  SELECT c_custkey, c_mktsegment AS rank, CASE WHEN c_acctbal < 0 THEN 30 ELSE d - DATE '1996-01-01' END AS stay
  FROM customer, last_day
), events AS (
  SELECT o_custkey AS c_custkey, min(o_orderdate::DATE - DATE '1996-01-01') AS event_day
  FROM orders JOIN people ON o_custkey = c_custkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE - DATE '1996-01-01' BETWEEN 0 AND stay
  GROUP BY o_custkey
), followed AS (
  SELECT c_custkey, rank, coalesce(event_day < 90, false) AS event,
    CASE WHEN coalesce(event_day < 90, false) THEN event_day ELSE least(stay, 90) END AS days
  FROM people LEFT JOIN events USING (c_custkey)
), intervals AS (
  SELECT c_custkey, rank, k, (event AND k = days // 7)::INT AS label
  FROM (SELECT *, unnest(range(0, days // 7 + event::INT)) AS k FROM followed)
)"""

SQL["hazard_life_table"] = INTERVALS + """
SELECT k::BIGINT AS interval, count(*) AS at_risk, sum(label)::BIGINT AS events, round(avg(label), 9) AS hazard,
  round((SELECT product(1 - h) FROM (SELECT k AS j, avg(label) AS h FROM intervals GROUP BY k) WHERE j <= i.k), 9)
    AS survival
FROM intervals i GROUP BY k"""

SQL["hazard_by_stratum"] = INTERVALS + """,
fitted AS (SELECT rank, avg(label) AS hazard FROM intervals GROUP BY rank),
h AS (
  SELECT c_custkey::VARCHAR AS pid, hazard, least(0.95, greatest(0.0001, hazard)) AS h
  FROM customer LEFT JOIN fitted ON c_mktsegment = rank
), risks AS (
  SELECT pid, hazard, round(1 - pow(1 - h, 1), 4) AS risk_7d, round(1 - pow(1 - h, 30 / 7.0), 4) AS risk_30d,
    round(1 - pow(1 - h, 60 / 7.0), 4) AS risk_60d, round(1 - pow(1 - h, 90 / 7.0), 4) AS risk_90d,
    7 * ln(0.5) / ln(1 - h) AS days
  FROM h
)
SELECT pid, round(hazard, 9) AS hazard, risk_7d, risk_30d, risk_60d, risk_90d,
  CASE WHEN days <= 90 THEN round_even(days, 0)::BIGINT::VARCHAR ELSE '' END AS median_days,
  CASE WHEN risk_7d >= 0.5 THEN '7' WHEN risk_30d >= 0.5 THEN '30' WHEN risk_60d >= 0.5 THEN '60'
    WHEN risk_90d >= 0.5 THEN '90' ELSE '' END AS soonest,
  CASE WHEN hazard IS NULL THEN 'unavailable' ELSE 'ok' END AS horizon_status
FROM risks"""


def _campaign() -> str:
    """Rounds 1, 3 complete; 2 hears two units, 4 finds the budget spent."""
    parts = ["""WITH e AS (
  SELECT 'V' || label AS unit_id, vec_id % 4 + 1 AS round, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings WHERE vec_id % 4 <> 1 OR label < 2
), rep AS (
  SELECT round, unit_id, pos, avg(x) AS v, count(*) AS n FROM e GROUP BY ALL
), units AS (
  SELECT round, count(DISTINCT unit_id) AS units, array_to_string(list_sort(list(DISTINCT unit_id)), ',') AS names
  FROM rep GROUP BY round
), g0 AS (SELECT DISTINCT pos, 0::DOUBLE AS v FROM rep)"""]
    for r, before in ((1, "g0"), (3, "g1")):
        parts.append(f"""d{r} AS (
  SELECT unit_id, pos, n, rep.v - {before}.v AS delta FROM rep JOIN {before} USING (pos) WHERE round = {r}
), n{r} AS (SELECT unit_id, sqrt(sum(delta * delta)) AS norm FROM d{r} GROUP BY unit_id
), s{r} AS (
  SELECT pos, sum(delta * CASE WHEN norm > 0.05 THEN 0.05 / norm ELSE 1 END * n) / sum(n) AS step
  FROM d{r} JOIN n{r} USING (unit_id) GROUP BY pos
), g{r} AS (SELECT pos, {before}.v + step AS v FROM {before} JOIN s{r} USING (pos))""")
    return ", ".join(parts)


SQL["federated_vectors"] = _campaign() + """
SELECT r::BIGINT AS round, pos::BIGINT AS pos, round(v, 9) AS value
FROM (SELECT 1 AS r, * FROM g1 UNION ALL SELECT 2, * FROM g1 UNION ALL SELECT 3, * FROM g3 UNION ALL SELECT 4, * FROM g3)"""

SQL["federated_history"] = _campaign() + f"""
SELECT 'embeddings' AS campaign, round, units, names AS participants, round IN (1, 3) AS completed,
  CASE WHEN round IN (1, 3) THEN {{0}} ELSE 0 END::DOUBLE AS epsilon,
  CASE WHEN round < 3 THEN {{0}} ELSE 2 * {{0}} END::DOUBLE AS spent,
  CASE round WHEN 1 THEN (SELECT count(*) FROM n1 WHERE norm > 0.05) WHEN 3 THEN (SELECT count(*) FROM n3 WHERE norm > 0.05)
    ELSE 0 END AS clipped,
  CASE round WHEN 2 THEN 'too few units' WHEN 4 THEN 'budget exhausted' ELSE '' END AS reason
FROM units""".format(config.Config().fed_epsilon_round)
