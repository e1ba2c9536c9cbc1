"""SQL twins of the voice queries."""

from __future__ import annotations

from oracle.base import f, rd
from vigilframe import config
from vigilframe.plans.voice import PLANTED

SQL: dict[str, str] = {}

# RE2 word boundaries are ASCII; every letter outside ASCII becomes a plain letter of equal length.
SAID = r"""
said AS (
  SELECT conv_id || '-' || turn AS utterance_id, conv_id, turn,
    turn * 4 * 86400000 + turn * 3600000 AS at_ms,
    conv_id || '-' || floor((turn * 4 * 86400000 + turn * 3600000) / 604800000)::BIGINT AS session_id,
    lower(text) AS low, regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g') AS plain
  FROM conversations
), bank(ord, pattern, kind, base) AS (VALUES
  (0, '\bof (the|a)\b', 'wellbeing', 0.80::DOUBLE), (1, '\bis\b', 'dismissal', 0.70),
  (2, '\bde la\b', 'coping', 0.66), (3, '\bthe\b', 'normalising', 0.62),
  (4, '\bund\b', 'attribution', 0.30)
), cut AS (
  SELECT s.*, b.*, regexp_extract_all(plain, pattern) AS found,
    regexp_split_to_array(plain, pattern) AS pieces,
    CASE WHEN contains(low, 'that') OR contains(low, 'der ') THEN 0.10 ELSE 0 END
      + CASE WHEN contains(' ' || low || ' ', ' and ') OR contains(' ' || low || ' ', ' la ')
        THEN 0.08 ELSE 0 END AS bonus
  FROM said s CROSS JOIN bank b WHERE regexp_matches(plain, pattern)
), hits AS (
  SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut
), placed AS (
  SELECT utterance_id, session_id, at_ms, ord, kind, found[i] AS phrase, low, plain,
    list_sum(list_transform(pieces[1:i], lambda p: length(p)))::BIGINT
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0)::BIGINT AS start,
    """ + rd("least(1, base + bonus)", 3) + r""" AS confidence
  FROM hits
), tails AS (
  SELECT *, list_filter(regexp_split_to_array(regexp_split_to_array(plain[1:start],
    '[.!?;,]|\b(?:with|though|although|however|still|yet)\b')[-1], '\s+'), lambda w: w <> '')
    AS words FROM placed
), kept AS (
  SELECT * FROM (SELECT *, array_to_string(words[greatest(1, len(words) - 5):], ' ') AS tail FROM tails)
  WHERE NOT (contains(tail, 'to') OR contains(tail, 'en') OR contains(tail, 'pas'))
), best AS (
  SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY confidence DESC, ord, start) AS pos
  FROM kept QUALIFY pos = 1
)"""

SQL["cue_counts"] = "WITH " + SAID + """
SELECT utterance_id, start, phrase, kind, confidence FROM kept"""
SQL["cue_best"] = "WITH " + SAID + """
SELECT utterance_id, start, phrase, kind, confidence FROM best"""

# the published bank over planted sentences: fixed values of the configuration, the search as above
def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(names, where: str, pad: str = "") -> str:
    return " OR ".join(f"contains({where}, {_text(pad + n + pad)})" for n in names)


PLANTED_SAID = f"""
planted AS (
  SELECT conv_id || '-' || turn AS utterance_id,
    [{", ".join(map(_text, PLANTED))}][(conv_id * 7 + turn * 5) % {len(PLANTED)} + 1] || ' ' || coalesce(text, '') AS text
  FROM conversations
), said AS (
  SELECT utterance_id, lower(text) AS low, regexp_replace(lower(text), '[^\\x00-\\x7F]', 'x', 'g') AS plain FROM planted
)"""

PUBLISHED_CUES = f"""{PLANTED_SAID}, bank(ord, pattern, kind, base) AS (VALUES
  {", ".join(f"({i}, {_text(p)}, '{kind}', {base}::DOUBLE)" for i, (p, kind, base) in enumerate(config.CUES))}
), cut AS (
  SELECT s.*, b.*,
    list_transform(regexp_extract_all(plain, pattern), lambda x: x) AS found,
    string_split(regexp_replace(plain, pattern, chr(1), 'g'), chr(1)) AS pieces,
    CASE WHEN {_any(config.HEDGES, "low")} THEN 0.10 ELSE 0 END
      + CASE WHEN {_any(config.CONTRASTS, "' ' || low || ' '", " ")} THEN 0.08 ELSE 0 END AS bonus
  FROM said s CROSS JOIN bank b WHERE regexp_matches(plain, pattern)
), hits AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut
), placed AS (
  SELECT utterance_id, ord, kind, found[i] AS phrase, plain,
    list_sum(list_transform(pieces[1:i], lambda p: length(p)))::BIGINT
      + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0)::BIGINT AS start,
    """ + rd("least(1, base + bonus)", 3) + f""" AS confidence
  FROM hits
), tails AS (
  SELECT *, list_filter(string_split_regex(string_split(regexp_replace(plain[1:start], {_text(config.CLAUSE_BREAK)},
    chr(1), 'g'), chr(1))[-1], '\\s+'), lambda w: w <> '') AS words FROM placed
)
SELECT utterance_id, start, phrase, kind, confidence
FROM (SELECT *, array_to_string(words[greatest(1, len(words) - 5):], ' ') AS tail FROM tails)
WHERE NOT ({_any(config.NEGATORS, "tail")})"""

SQL["published_cues"] = "WITH " + PUBLISHED_CUES

SQL["published_acute"] = f"""WITH {PLANTED_SAID}
SELECT utterance_id, heard FROM (SELECT utterance_id, concat_ws(' + ', {", ".join(
    f"CASE WHEN regexp_matches(plain, {_text(p)}) THEN {_text(p)} END" for p in config.ACUTE_PHRASES)}) AS heard FROM said)
WHERE heard <> ''"""

SQL["acute_phrases"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g') AS plain FROM documents)
SELECT doc_id, heard FROM (
  SELECT doc_id, concat_ws(' + ',
    CASE WHEN regexp_matches(plain, '\bof the\b') THEN '\bof the\b' END,
    CASE WHEN regexp_matches(plain, '\bin (a|der)\b') THEN '\bin (a|der)\b' END,
    CASE WHEN regexp_matches(plain, '\bde l(a|os)\b') THEN '\bde l(a|os)\b' END,
    CASE WHEN regexp_matches(plain, '\bthe .* the\b') THEN '\bthe .* the\b' END) AS heard FROM t)
WHERE heard <> ''"""

FRAMES = """
raw_frames AS (
  SELECT user_id::VARCHAR AS pid, json_extract_string(props, '$.k')::INT AS k, event_type,
    least(1.0::DOUBLE, value / 50) AS v,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS at_ms FROM events
), all_frames AS (
  SELECT pid, pid || '-' || floor(at_ms / 604800000)::BIGINT AS session_id, at_ms,
    (0.3::DOUBLE + k / 50) AS duration_s, k / 100 AS voiced,
    0.005::DOUBLE + 0.035::DOUBLE * v AS jitter_local,
    CASE WHEN event_type <> 'signup' THEN 0.03::DOUBLE + 0.1::DOUBLE * v END AS shimmer_local,
    CASE WHEN event_type <> 'error' THEN 20 - 14 * v END AS hnr_db,
    9 - 7 * v AS f0_range_semitones,
    CASE WHEN event_type <> 'view' THEN 0.2::DOUBLE + 0.6::DOUBLE * v END AS pause_ratio,
    4 - 2.4::DOUBLE * v AS speech_rate_sps FROM raw_frames
), frames AS (SELECT * FROM all_frames WHERE voiced >= 0.25 AND duration_s >= 0.6
), bands(feature, normal, notable, weight) AS (VALUES
  ('jitter_local', 0.010::DOUBLE, 0.030::DOUBLE, 0.20::DOUBLE),
  ('shimmer_local', 0.040, 0.110, 0.16), ('hnr_db', 18.0, 7.0, 0.18),
  ('f0_range_semitones', 8.0, 2.5, 0.20), ('pause_ratio', 0.30, 0.70, 0.14),
  ('speech_rate_sps', 3.6, 1.8, 0.12)
), long AS (
  SELECT pid, session_id, at_ms, u.feature, u.value, b.weight, b.normal, b.notable,
    greatest(0, least(1, (u.value - b.normal) / (b.notable - b.normal))) AS divergence
  FROM (UNPIVOT frames ON jitter_local, shimmer_local, hnr_db, f0_range_semitones, pause_ratio,
        speech_rate_sps INTO NAME feature VALUE value) u JOIN bands b USING (feature)
), medians AS (
  SELECT pid, session_id, feature, median(value) AS value, median(divergence) AS typical,
    avg((round(divergence, 9) >= 0.25)::INT) AS held, any_value(weight) AS weight
  FROM long GROUP BY ALL
)"""

SQL["frame_divergence"] = "WITH " + FRAMES + """
SELECT session_id, feature, count(*) AS n, round(avg(divergence), 9) AS divergence
FROM long GROUP BY ALL"""

NEAR = """
near AS (
  SELECT b.utterance_id, b.at_ms AS said_at, fr.* FROM best b JOIN frames fr
    ON fr.session_id = b.session_id AND abs(fr.at_ms - b.at_ms) <= 2 * 86400000
)"""
SQL["utterance_frames"] = "WITH " + SAID + ",\n" + FRAMES + ",\n" + NEAR + """
SELECT utterance_id, count(*) AS frames, min(at_ms - said_at) AS first,
  max(at_ms - said_at) AS last FROM near GROUP BY utterance_id"""

GAPS = SAID + ",\n" + FRAMES + ",\n" + NEAR + f""",
counts AS (SELECT utterance_id, count(*) AS usable FROM near GROUP BY ALL
), near_medians AS (
  SELECT utterance_id, feature, median(value) AS value
  FROM (UNPIVOT near ON jitter_local, shimmer_local, hnr_db, f0_range_semitones, pause_ratio,
        speech_rate_sps INTO NAME feature VALUE value) GROUP BY ALL
), moved AS (
  SELECT utterance_id, weight,
    greatest(0, least(1, (value - normal) / (notable - normal))) AS raw
  FROM near_medians JOIN bands USING (feature)
), strength AS (
  SELECT utterance_id, count(*) AS features, sum({rd("raw", 3)} * weight) / sum(weight) AS pull
  FROM moved WHERE round(raw, 9) >= 0.25 GROUP BY ALL
), gap0 AS (
  SELECT b.utterance_id, b.session_id, b.phrase, b.confidence, coalesce(c.usable, 0) AS usable,
    coalesce(s.features, 0) AS features, coalesce({rd("s.pull * b.confidence", 4)}, 0) AS d
  FROM best b LEFT JOIN counts c USING (utterance_id) LEFT JOIN strength s USING (utterance_id)
), gaps AS (
  SELECT *, CASE WHEN confidence < 0.5 THEN 'weak_cue(' || phrase || ',' || {f("confidence", 2)} || ')'
    WHEN usable = 0 THEN 'unvoiced()'
    WHEN features < 2 THEN 'features(' || features || ',2)'
    WHEN d < 0.22 THEN 'divergence(' || {f("d", 2)} || ',0.22)'
    ELSE 'gap' END AS reason,
    (CASE WHEN confidence >= 0.5 AND usable > 0 AND features >= 2 THEN d ELSE 0 END)::DOUBLE
      AS divergence FROM gap0
)"""
SQL["concordance_gaps"] = "WITH " + GAPS + """
SELECT utterance_id, reason = 'gap' AS raised, round(divergence, 9) AS divergence,
  CASE WHEN divergence >= 0.66 THEN 'marked' WHEN divergence >= 0.40 THEN 'moderate'
    ELSE 'slight' END AS severity, features, reason FROM gaps"""

SQL["session_summaries"] = "WITH " + FRAMES + """
SELECT session_id, """ + ", ".join(
    f"max({rd('value', 5)}) FILTER (feature = '{n}') AS {n}" for n in (
        "jitter_local", "shimmer_local", "hnr_db", "f0_range_semitones", "pause_ratio",
        "speech_rate_sps")) + " FROM medians GROUP BY session_id"

STRAIN = f"""
strain0 AS (
  SELECT session_id, count(*) AS features,
    {rd(f"sum({rd('typical', 3)} * weight) / sum(weight)", 4)} AS d,
    {rd("sum(held * weight) / sum(weight)", 4)} AS c
  FROM medians WHERE round(typical, 9) >= 0.25 GROUP BY session_id
), strain1 AS (
  SELECT w.session_id, w.windows, coalesce(features, 0) AS features, d, c,
    w.windows >= 5 AND coalesce(features, 0) >= 4 AS shown
  FROM (SELECT session_id, count(*) AS windows FROM frames GROUP BY ALL) w
  LEFT JOIN strain0 USING (session_id)
), strain AS (
  SELECT session_id, windows, CASE WHEN windows >= 5 THEN features ELSE 0 END AS features,
    CASE WHEN shown THEN d ELSE 0 END::DOUBLE AS divergence,
    CASE WHEN shown THEN c ELSE 0 END::DOUBLE AS coverage,
    CASE WHEN windows < 5 THEN 'windows(' || windows || ',5)'
      WHEN features < 4 THEN 'features(' || features || ',4)'
      WHEN d < 0.45 THEN 'divergence(' || {f("d", 2)} || ',0.45)'
      WHEN c < 0.60 THEN 'coverage(' || round_even(round(c * 100, 9), 0)::BIGINT || '%,60%)'
      ELSE 'strain' END AS reason
  FROM strain1
)"""
SQL["sustained_strain"] = "WITH " + FRAMES + ",\n" + STRAIN + """
SELECT session_id, windows, features, round(divergence, 9) AS divergence,
  round(coverage, 9) AS coverage, reason = 'strain' AS raised,
  CASE WHEN divergence >= 0.66 THEN 'marked' WHEN divergence >= 0.50 THEN 'moderate'
    ELSE 'slight' END AS severity, reason FROM strain"""

SHIFT = f"""
sittings AS (SELECT pid, session_id, feature, {rd("value", 5)} AS value FROM medians
), last_one AS (SELECT pid, max(session_id) AS session_id FROM sittings GROUP BY pid
), history AS (
  SELECT s.* FROM sittings s JOIN last_one l USING (pid) WHERE s.session_id < l.session_id
), centres AS (
  SELECT pid, feature, count(*) AS n, median(value) AS centre FROM history GROUP BY ALL
), spreads AS (
  SELECT pid, feature, any_value(n) AS n, any_value(centre) AS centre,
    greatest(median(abs(value - centre)) * 1.4826, abs(any_value(centre)) * 0.05, 0.000001) AS spread
  FROM history JOIN centres USING (pid, feature) GROUP BY ALL
), depth AS (SELECT pid, count(DISTINCT session_id) AS sessions FROM history GROUP BY pid
), baselines AS (SELECT * FROM spreads JOIN depth USING (pid) WHERE n >= 2
), compared AS (
  SELECT c.pid, c.session_id, b.sessions,
    round((c.value - b.centre) / b.spread * sign(k.notable - k.normal), 9) AS z
  FROM sittings c JOIN last_one l ON l.pid = c.pid AND l.session_id = c.session_id
  JOIN bands k ON k.feature = c.feature
  LEFT JOIN baselines b ON b.pid = c.pid AND b.feature = c.feature
), shifts AS (
  SELECT pid, session_id, count(*) FILTER (sessions >= 3 AND z >= 1.5) AS shifted,
    coalesce(max(sessions), 0) AS history FROM compared GROUP BY ALL
)"""
SQL["voice_baselines"] = "WITH " + FRAMES + ",\n" + SHIFT + """
SELECT pid, feature, sessions, round(centre, 9) AS centre, round(spread, 9)::DOUBLE AS spread
FROM baselines"""
SQL["baseline_shifts"] = "WITH " + FRAMES + ",\n" + SHIFT + """
SELECT pid, session_id, shifted, history, history >= 3 AND shifted >= 3 AS raised,
  CASE WHEN history < 3 THEN 'history(' || history || ',3)'
    WHEN shifted < 3 THEN 'features(' || shifted || ',3)'
    ELSE 'shift' END AS reason FROM shifts"""

SQL["voice_deviations"] = "WITH " + GAPS + ",\n" + STRAIN + ",\n" + SHIFT + f""",
per AS (
  SELECT session_id, count(*) AS assessed, count(*) FILTER (reason = 'gap') AS n_gaps,
    avg(divergence) FILTER (reason = 'gap') AS gap_strength FROM gaps GROUP BY session_id
), every AS (
  SELECT session_id, coalesce(assessed, 0) AS assessed, coalesce(n_gaps, 0) AS n_gaps, gap_strength,
    coalesce(s.reason = 'strain', false) AS strained, s.divergence, s.coverage,
    coalesce(h.shifted, 0) AS shifted,
    coalesce(h.history >= 3 AND h.shifted >= 3, false) AS moved
  FROM strain s FULL JOIN per USING (session_id) FULL JOIN shifts h USING (session_id)
), valued AS (
  SELECT *, CASE WHEN n_gaps > 0 AND assessed >= 3 THEN n_gaps / assessed WHEN strained THEN coverage
      ELSE 0.5 END AS rate,
    least(1, CASE WHEN n_gaps > 0 AND assessed >= 3 THEN n_gaps / assessed * gap_strength * 2
      WHEN strained THEN divergence * coverage ELSE 0.1 * shifted END) AS value
  FROM every WHERE n_gaps > 0 OR strained OR moved
)
SELECT session_id, 'voice' AS domain, {rd("value / 0.15", 4)} AS z_self,
  {rd("value / 0.15 * 0.8", 4)} AS z_unit, 'T3' AS tier, 0.4::DOUBLE AS weight,
  {rd("rate", 4)} AS breach_0 FROM valued"""

SQL["sittings_by_silence"] = "WITH " + FRAMES + """
SELECT pid, sitting, count(*) AS frames, min(at_ms) AS first, max(at_ms) AS last FROM (
  SELECT pid, at_ms, sum(fresh) OVER (PARTITION BY pid ORDER BY at_ms
                                      ROWS UNBOUNDED PRECEDING)::BIGINT AS sitting
  FROM (SELECT pid, at_ms, coalesce(at_ms - lag(at_ms) OVER (PARTITION BY pid ORDER BY at_ms)
          > 3 * 86400000, true)::INT AS fresh FROM all_frames)) GROUP BY ALL"""
