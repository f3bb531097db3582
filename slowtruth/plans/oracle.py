"""SQL that must give the same results as the registered queries, run by another engine.

Recurrences are folded row by row over ordered lists, in a form unlike the blocked plans
they check.
"""

from __future__ import annotations

from slowtruth.functions.expr import FEATURE_DEFAULTS, FEATURE_NAMES, FEATURE_RANGES

PASSES_SQL = """
lines AS (
  SELECT l_orderkey AS o, CAST(l_linenumber AS INTEGER) AS p, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_shipdate, k
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
          l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS k FROM lineitem)),
base AS (
  SELECT o, p, CASE WHEN k = 1 THEN CAST(o AS VARCHAR) ELSE o || '-' || k END AS slab_id, p AS pass_number,
    CASE o % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'microalloyed' ELSE 'high_alloy' END AS steel_grade,
    CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST(o % 1440 AS INTEGER)) + to_seconds(10 * p) AS requested_at,
    CAST(2 + floor(l_quantity / 10) AS INTEGER) AS delay, l_shipdate, l_tax,
    15 + CAST(4.7 AS DOUBLE) * l_quantity AS entry_thickness_mm,
    1613 + CAST(floor(l_extendedprice) AS DOUBLE) % 2500 AS width_mm,
    1794 + 10 * CAST(l_partkey % 3600 AS DOUBLE) AS length_mm,
    889 + CAST((37 * l_suppkey + 11 * o) % 344 AS DOUBLE) AS temperature_c,
    round(CAST(0.01 AS DOUBLE) + 3 * l_discount, 3) AS reduction_pct,
    135 + CAST(l_partkey % 1000 AS DOUBLE) AS reheating_time_min,
    1042 + CAST(l_suppkey % 80 AS DOUBLE) AS roll_diameter_mm,
    CAST(o % 217 AS DOUBLE) AS roll_crown_mm,
    CAST(1.5 AS DOUBLE) + l_quantity * CAST(0.08 AS DOUBLE) AS speed_m_s,
    6 + CAST(l_partkey % 219 AS DOUBLE) AS wait_time_sec,
    CAST(0.02 AS DOUBLE) + l_discount * 5 AS strain,
    CAST(0.5 AS DOUBLE) + l_quantity * CAST(0.3 AS DOUBLE) AS strain_rate
  FROM lines),
forced AS (
  SELECT *,
    round(CASE steel_grade WHEN 'structural' THEN 18000e0 WHEN 'microalloyed' THEN 28000e0 ELSE 45000e0 END
          * width_mm * (entry_thickness_mm * reduction_pct) / greatest(temperature_c, 1e0), 2) AS baseline,
    CASE steel_grade WHEN 'structural' THEN 0e0
      WHEN 'high_alloy' THEN CASE WHEN l_shipdate >= TIMESTAMP '1998-07-01' THEN 60e0 ELSE 0e0 END
      ELSE 60e0 * abs(CAST(((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 730) + 730) % 730
                           AS DOUBLE) / 365 - 1) END AS wear_level
  FROM base),
passes AS (
  SELECT *,
    round(greatest(baseline * (1 + pow(greatest(0e0, least(wear_level, 100e0)) / 100, 1.5e0) * 0.4e0
        * (greatest(0.1e0, (1250 - temperature_c) / 200) * (100 / greatest(entry_thickness_mm, 10e0))
           * (1 + reduction_pct)))
      + CAST((31 * o + 17 * p) % 2001 - 1000 AS DOUBLE) / 1000 * 800, 0e0), 2) AS actual,
    requested_at + to_seconds(delay) AS measured_at
  FROM forced)"""

# Passes whose two events are both present and lie closer than the time limit, in the total order.
MATCHED_SQL = PASSES_SQL + """,
matched AS (
  SELECT *, row_number() OVER (PARTITION BY steel_grade ORDER BY measured_at, slab_id, pass_number) AS rn,
    actual - baseline AS residual
  FROM passes WHERE (o + p) % 50 NOT IN (0, 1))"""


MEASURED = tuple(FEATURE_DEFAULTS)
# What a request carries of each feature: three may be absent from the map.
SENT = {
    **{n: n for n in MEASURED},
    "roll_crown_mm": "CASE WHEN l_tax > 0.06 THEN NULL ELSE roll_crown_mm END",
    "strain": "CASE WHEN l_tax > 0.06 THEN NULL ELSE strain END",
    "flow_stress_mpa": "CAST(NULL AS DOUBLE)",
}
VECTOR = [f"coalesce({SENT[n]}, {FEATURE_DEFAULTS[n]!r}e0)" for n in MEASURED] + [
    "entry_thickness_mm * reduction_pct",
    "entry_thickness_mm * reduction_pct / temperature_c",
    "entry_thickness_mm * width_mm * length_mm",
]
KEYS = "slab_id, pass_number"
HAS_REQUEST, HAS_TRUTH = "(o + p) % 50 <> 1", "(o + p) % 50 <> 0"


def with_passes(select: str, more: str = "") -> str:
    return f"WITH {PASSES_SQL}{', ' + more if more else ''} {select}"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%g')"


def ape(predicted: str, actual: str) -> str:
    return f"CASE WHEN {actual} = 0 THEN 0e0 ELSE abs(({actual} - ({predicted})) / {actual}) * 100 END"


def folded(source: str, key: str, order: str, value: str, rate: str, name: str) -> str:
    """CTE ``name``: key, rn, the moving average before and after each row, by a plain left fold."""
    return f"""{name}_l AS (
      SELECT {key}, list_reduce(list([{value}] ORDER BY {order}),
        lambda acc, e: list_append(acc, {rate} * e[1] + (1e0 - {rate}) * acc[-1]), [0e0]) AS s
      FROM {source} GROUP BY {key}),
    {name} AS (
      SELECT {key}, i AS rn, s[i] AS prior, s[i + 1] AS post
      FROM (SELECT {key}, s, unnest(generate_series(1, len(s) - 1)) AS i FROM {name}_l))"""


TARGET_MEAN = f"""{MATCHED_SQL}, {folded("matched", "steel_grade", "rn", "residual", "2e-2", "tm")},
  tm_rows AS (SELECT m.*, m.baseline + tm.prior AS raw_force, tm.prior AS answer,
      {ape("m.baseline", "m.actual")} AS baseline_ape, {ape("m.baseline + tm.prior", "m.actual")} AS shadow_ape
    FROM matched m JOIN tm USING (steel_grade, rn))"""


def routed(rows: str, name: str) -> str:
    return f"""{folded(rows, "steel_grade", "rn", "shadow_ape", "2e-1", name + "_mt")},
  {folded(rows, "steel_grade", "rn", "baseline_ape", "2e-1", name + "_bt")},
  {name}_guard AS (SELECT r.*, mt.prior AS model_trust, bt.prior AS baseline_trust,
      (answer > baseline * 25e-2 OR answer < -(baseline * 2e-1)) AS unsafe,
      mt.prior > bt.prior + 3e0 AS untrusted
    FROM {rows} r JOIN {name}_mt mt USING (steel_grade, rn) JOIN {name}_bt bt USING (steel_grade, rn)),
  {name} AS (SELECT *, CAST(unsafe OR untrusted AS INTEGER) AS fallback,
      CASE WHEN unsafe OR untrusted THEN baseline ELSE raw_force END AS routed_force,
      CASE WHEN unsafe OR untrusted THEN baseline_ape ELSE shadow_ape END AS safe_ape
    FROM {name}_guard)"""


GTM = f"WITH {TARGET_MEAN}, {routed('tm_rows', 'gtm')}"

GUARDED_TARGET_MEAN = f"""{GTM}
SELECT {stamp("measured_at")} AS evaluation_timestamp, steel_grade, {KEYS}, baseline AS baseline_roll_force_kn,
  round(raw_force, 2) AS target_mean_roll_force_kn, round(routed_force, 2) AS routed_roll_force_kn,
  actual AS actual_roll_force_kn, round(baseline_ape, 4) AS baseline_ape, round(shadow_ape, 4) AS shadow_ape,
  round(safe_ape, 4) AS safe_ape, round(wear_level, 6) AS wear_level, fallback FROM gtm"""
UNTRUSTED_PREDICATE = f"""{GTM} SELECT {KEYS}, CAST(untrusted AS INTEGER) AS untrusted, CAST(unsafe AS INTEGER) AS unsafe
FROM gtm"""
TRUST_SCORES = f"""{GTM} SELECT {KEYS}, round(model_trust, 5) AS model_trust, round(baseline_trust, 5) AS baseline_trust
FROM gtm"""
SHADOW_VS_SAFE = f"""{GTM} SELECT steel_grade, count(*) AS n_rows, round(avg(baseline_ape), 4) AS baseline_ape,
  round(avg(shadow_ape), 4) AS shadow_ape, round(avg(safe_ape), 4) AS safe_ape,
  CAST(sum(fallback) AS BIGINT) AS n_fallbacks FROM gtm GROUP BY steel_grade"""
TARGET_MEAN_MODEL = f"WITH {TARGET_MEAN} SELECT {KEYS}, round(raw_force, 2) AS force FROM tm_rows"
METRICS_TABLE = f"""{GTM} SELECT steel_grade, count(*) AS n_rows, round(avg(baseline_ape), 4) AS baseline_ape,
  round(avg(safe_ape), 4) AS guarded_ape, strftime(min(measured_at), '%Y-%m-%d %H:%M:%S') AS first_at,
  strftime(max(measured_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM gtm GROUP BY steel_grade"""
GRADE_FILTER = f"""WITH {MATCHED_SQL} SELECT {KEYS}, round({ape("baseline", "actual")}, 4) AS baseline_ape
FROM matched WHERE steel_grade = 'high_alloy'"""
NEWEST = f"""{GTM}, newest AS (SELECT *, row_number() OVER (PARTITION BY steel_grade
  ORDER BY measured_at DESC, slab_id, pass_number) AS back FROM gtm),
  shown AS (SELECT *, 61 - back AS position FROM newest WHERE back <= 60)"""
LATEST_60 = f"""{NEWEST} SELECT steel_grade, CAST(position AS INTEGER) AS position, {KEYS},
  {stamp("measured_at")} AS evaluation_timestamp, round(baseline_ape, 4) AS baseline_ape,
  round(shadow_ape, 4) AS target_mean_ape, round(wear_level, 4) AS wear_level FROM shown"""
CURRENT_WEAR = f"{NEWEST} SELECT steel_grade, round(wear_level, 2) AS current_wear FROM newest WHERE back = 1"
METRIC_SERIES = f"""{NEWEST}
SELECT steel_grade, CAST(position AS INTEGER) AS position, series, strftime(measured_at, '%H:%M:%S') AS label,
  round(CASE series WHEN 'Baseline' THEN baseline_ape WHEN 'Target Mean' THEN shadow_ape ELSE safe_ape END, 2) AS value
FROM shown, (SELECT unnest(['Baseline', 'Target Mean', 'AMRules (Safe)']) AS series)"""

# --- linear model ---

_X = ", ".join(f"{v} AS x{i}" for i, v in enumerate(VECTOR))
_Z = ", ".join(
    f"CASE WHEN count(*) OVER w < 2 OR stddev_samp(x{i}) OVER w <= 1e-8 THEN 0e0 "
    f"ELSE (x{i} - avg(x{i}) OVER w) / stddev_samp(x{i}) OVER w END AS z{i}"
    for i in range(len(VECTOR))
)
_ELEMENT = "[residual, " + ", ".join(f"z{i}" for i in range(len(VECTOR))) + "]"
_N = len(VECTOR)
_DOT = " + ".join(["acc[1]"] + [f"acc[{i + 2}] * e[{i + 2}]" for i in range(_N)])
_MOVED = ", ".join(
    ["acc[1] + 1e-3 * d"] + [f"(1e0 - 1e-5) * acc[{i + 2}] + 1e-3 * d * e[{i + 2}]" for i in range(_N)]
)
SGD = f"""{MATCHED_SQL},
  vectors AS (SELECT *, {_X} FROM matched),
  scored AS (SELECT *, {_Z} FROM vectors
    WINDOW w AS (PARTITION BY steel_grade ORDER BY rn ROWS UNBOUNDED PRECEDING)),
  sgd_l AS (SELECT steel_grade, list_reduce(list({_ELEMENT} ORDER BY rn), lambda acc, e:
      list_transform([e[1] - ({_DOT})], lambda d: list_concat([{_MOVED}], acc[{_N + 2}:], [e[1] - d]))[1],
      list_transform(generate_series(1, {_N + 1}), lambda i: 0e0)) AS s FROM scored GROUP BY steel_grade),
  sgd AS (SELECT steel_grade, i AS rn, s[i + {_N + 1}] AS answer
    FROM (SELECT steel_grade, s, unnest(generate_series(1, len(s) - {_N + 1})) AS i FROM sgd_l)),
  sgd_rows AS (SELECT m.*, answer, m.baseline + answer AS raw_force, {ape("m.baseline", "m.actual")} AS baseline_ape,
      {ape("m.baseline + answer", "m.actual")} AS shadow_ape FROM matched m JOIN sgd USING (steel_grade, rn))"""
SGD_PREQUENTIAL = f"WITH {SGD} SELECT {KEYS}, round(raw_force, 2) AS force FROM sgd_rows"
SHADOW_ROUTE = f"""WITH {SGD}, {routed("sgd_rows", "gsgd")}
SELECT {KEYS}, round(routed_force, 2) AS routed_force, fallback, round(safe_ape, 4) AS safe_ape FROM gsgd"""

_TM_ROWS = folded("matched", "steel_grade", "rn", "residual", "2e-2", "tm")
PREQUENTIAL_LINEAR = f"""WITH {SGD}, {_TM_ROWS}, {routed("sgd_rows", "gsgd")}
SELECT {stamp("measured_at")} AS evaluation_timestamp, steel_grade, {KEYS}, baseline AS baseline_roll_force_kn,
  round(baseline + tm.prior, 2) AS target_mean_roll_force_kn, round(raw_force, 2) AS sgd_roll_force_kn,
  round(routed_force, 2) AS am_rules_roll_force_kn, actual AS actual_roll_force_kn, round(baseline_ape, 4) AS baseline_ape,
  round({ape("baseline + tm.prior", "actual")}, 4) AS target_mean_ape, round(shadow_ape, 4) AS sgd_ape,
  round(safe_ape, 4) AS am_rules_ape, round(shadow_ape, 4) AS am_rules_shadow_ape, round(wear_level, 6) AS wear_level,
  fallback AS is_am_rules_fallback, CAST(unsafe AS INTEGER) AS unsafe, CAST(untrusted AS INTEGER) AS untrusted
FROM gsgd JOIN tm USING (steel_grade, rn)"""
MODEL_HANDOVER = f"SELECT * EXCLUDE (unsafe, untrusted) FROM ({PREQUENTIAL_LINEAR})"

# --- drift test ---

_PH = f"""{MATCHED_SQL}, errors AS (SELECT *, {ape("baseline", "actual")} AS error FROM matched),
  ph_l AS (SELECT steel_grade, list_reduce(list([error] ORDER BY rn), lambda acc, e:
      list_transform([[acc[1] + 1, acc[2] + (e[1] - acc[2]) / (acc[1] + 1)]], lambda a:
        list_transform([acc[3] + (e[1] - a[2] - 5e-3)], lambda c:
          list_transform([c - least(acc[4], c)], lambda x:
            list_concat(CASE WHEN a[1] >= 30 AND x > 35 THEN [0e0, 0e0, 0e0, 0e0]
                             ELSE [a[1], a[2], c, least(acc[4], c)] END,
              acc[5:], [a[2], x, CASE WHEN a[1] >= 30 AND x > 35 THEN 1e0 ELSE 0e0 END]))[1])[1])[1],
      [0e0, 0e0, 0e0, 0e0]) AS s FROM errors GROUP BY steel_grade),
  ph AS (SELECT steel_grade, i AS rn, s[2 + 3 * i] AS running_mean, s[3 + 3 * i] AS excess, s[4 + 3 * i] AS alarm
    FROM (SELECT steel_grade, s, unnest(generate_series(1, (len(s) - 4) // 3)) AS i FROM ph_l))"""
DRIFT_DETECT = f"""WITH {_PH} SELECT {KEYS}, round(running_mean, 5) AS running_mean, round(excess, 4) AS excess,
  CAST(alarm AS INTEGER) AS alarm FROM errors JOIN ph USING (steel_grade, rn)"""
FIRST_DRIFT = f"""WITH {_PH} SELECT steel_grade, min(rn) AS n, round(min_by(excess, rn), 4) AS excess
FROM ph WHERE alarm = 1 GROUP BY steel_grade"""

# --- running aggregates over events ---

_EV = "ev AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)"
_EU = "eu AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_W = "(PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
RUNNING_MOMENTS = f"""SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS value_sum,
  round(sqrt(var_pop(value) OVER w), 6) AS value_sd FROM events WINDOW w AS {_W}"""
WELFORD_ZSCORE = f"""SELECT event_id, round(CASE WHEN count(*) OVER w < 2 OR stddev_samp(value) OVER w <= 1e-8 THEN 0e0
  ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 6) AS value_z FROM events WINDOW w AS {_W}"""
EWMA = f"""WITH {_EV}, {folded("ev", "event_type", "rn", "value", "2e-1", "s")}
SELECT event_id, round(post, 6) AS smooth, round(prior, 6) AS smooth_prior FROM ev JOIN s USING (event_type, rn)"""
EWMA_NULL_KEYS = f"""WITH nk AS (SELECT event_id, value, coalesce(key, '(null)') AS key, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn
    FROM (SELECT *, CASE WHEN event_type <> 'view' THEN event_type END AS key FROM events)),
  {folded("nk", "key", "rn", "value", "2e-1", "s")}
SELECT event_id, key, round(post, 6) AS smooth FROM nk JOIN s USING (key, rn)"""
PRIOR_STATE = f"""WITH {_EU}, {folded("eu", "user_id", "rn", "value", "2e-2", "s")}
SELECT event_id, round(prior, 6) AS smooth_prior FROM eu JOIN s USING (user_id, rn)"""

# --- pairing: the slot machine itself, folded over each key's events ---


def slot_machine(key: str, ttl: float) -> str:
    """CTE ``fate``: key, status, a_id, b_id of every event."""
    micros = int(ttl * 1_000_000)
    return f"""e AS (SELECT *, {key} AS k, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS side,
      epoch_us(ts) AS us FROM events),
    folded AS (SELECT k, list_reduce(list([side, us, event_id] ORDER BY us, side, event_id), lambda acc, e: CASE
        WHEN acc[1] = -1 THEN list_concat([e[1], e[2], e[3]], acc[4:])
        WHEN acc[2] + {micros} <= e[2] THEN list_concat([e[1], e[2], e[3]], acc[4:], [2, acc[1], acc[3], -1])
        WHEN acc[1] = e[1] THEN list_concat([e[1], e[2], e[3]], acc[4:], [3, acc[1], acc[3], -1])
        ELSE list_concat([CAST(-1 AS BIGINT), 0, 0], acc[4:], [1, acc[1], acc[3], e[3]]) END,
      [CAST(-1 AS BIGINT), 0, 0]) AS s FROM e GROUP BY k),
    closed AS (SELECT k, CASE WHEN s[1] = -1 THEN s ELSE list_concat(s, [
        CASE WHEN s[2] + {micros} <= (SELECT max(us) FROM e) THEN 2 ELSE 4 END, s[1], s[3], -1]) END AS s FROM folded),
    fates AS (SELECT k, s[4 * i] AS code, s[4 * i + 1] AS side, s[4 * i + 2] AS one, s[4 * i + 3] AS other
      FROM (SELECT k, s, unnest(generate_series(1, (len(s) - 3) // 4)) AS i FROM closed)),
    fate AS (SELECT k, CASE code WHEN 1 THEN 'matched' WHEN 2 THEN 'orphan' WHEN 3 THEN 'superseded'
        ELSE 'waiting' END AS status,
      CASE WHEN side = 0 THEN one WHEN code = 1 THEN other END AS a_id,
      CASE WHEN side = 1 THEN one WHEN code = 1 THEN other END AS b_id FROM fates)"""


_USER = slot_machine("user_id", 6 * 3600)
MATCH_PAIRS = f"WITH {_USER} SELECT k AS user_id, a_id, b_id FROM fate WHERE status = 'matched'"
MATCH_ORPHANS = f"""WITH {_USER} SELECT k AS user_id, CASE WHEN a_id IS NULL THEN 'B' ELSE 'A' END AS side,
  coalesce(a_id, b_id) AS event_id FROM fate WHERE status = 'orphan'"""
MATCH_SUPERSEDED = f"""WITH {_USER} SELECT k AS user_id, CASE WHEN a_id IS NULL THEN 'B' ELSE 'A' END AS side,
  coalesce(a_id, b_id) AS event_id FROM fate WHERE status = 'superseded'"""
MATCH_HOT_KEYS = f"WITH {slot_machine(chr(39) + 'all' + chr(39), 600)} SELECT status, coalesce(a_id, -1) AS a_id, coalesce(b_id, -1) AS b_id FROM fate"
MATCH_NULL_KEYS = f"""WITH {slot_machine("CASE WHEN user_id % 10 <> 0 THEN user_id END", 6 * 3600)}
SELECT coalesce(k, -1) AS key, status, coalesce(a_id, -1) AS a_id, coalesce(b_id, -1) AS b_id FROM fate"""
MATCH_PASSES = with_passes(f"""SELECT {KEYS},
  CASE WHEN {HAS_REQUEST} AND {HAS_TRUTH} THEN 'matched'
    WHEN CASE WHEN {HAS_REQUEST} THEN requested_at ELSE measured_at END + to_seconds(300) <= horizon THEN 'orphan'
    ELSE 'waiting' END AS status,
  {stamp(f"CASE WHEN {HAS_TRUTH} THEN measured_at ELSE requested_at END")} AS ts,
  CASE WHEN {HAS_REQUEST} THEN steel_grade ELSE 'unknown' END AS steel_grade,
  CASE WHEN {HAS_TRUTH} THEN actual ELSE -1e0 END AS actual
FROM passes, (SELECT max(CASE WHEN {HAS_TRUTH} THEN measured_at ELSE requested_at END) AS horizon FROM passes)""")
MATCH_UNIQUE = with_passes(f"SELECT {KEYS}, baseline, actual FROM passes WHERE {HAS_REQUEST} AND {HAS_TRUTH}")
TAG_UNION = with_passes(f"""SELECT {KEYS}, 'A' AS side, {stamp("requested_at")} AS ts FROM passes WHERE {HAS_REQUEST}
UNION ALL SELECT {KEYS}, 'B', {stamp("measured_at")} FROM passes WHERE {HAS_TRUTH}""")
KEYED_SHUFFLE = with_passes(f"""SELECT a, b, count(*) AS n_keys FROM (SELECT CAST({HAS_REQUEST} AS BIGINT) AS a,
  CAST({HAS_TRUTH} AS BIGINT) AS b FROM passes) GROUP BY a, b""")

# --- sources, sinks, expressions ---

READABLE = "o % 97 <> 0"
READ_EVENT_STREAM = with_passes(f"""SELECT {KEYS}, steel_grade, {stamp("requested_at")} AS ts,
  baseline AS baseline_roll_force_kn FROM passes WHERE {HAS_REQUEST} AND {READABLE}""")
DECODE_EVENTS = with_passes(f"""SELECT {KEYS}, steel_grade, steel_grade || '_mill' AS routing_key,
  {stamp("requested_at")} AS ts, baseline AS baseline_roll_force_kn,
  {", ".join(f"{v} AS {n}" for n, v in zip(MEASURED, VECTOR))}
FROM passes WHERE {HAS_REQUEST} AND {READABLE}""")
QUARANTINE_EVENTS = with_passes(f"""SELECT o, p, 'A' AS side, 'not readable' AS reject_reason FROM passes
WHERE {HAS_REQUEST} AND NOT {READABLE} UNION ALL SELECT o, p, 'B', 'not readable' FROM passes
WHERE {HAS_TRUTH} AND NOT {READABLE}""")
VALID_ROWS = with_passes(f"""SELECT {KEYS}, {stamp("measured_at")} AS ts, actual AS actual_roll_force_kn,
  round(wear_level, 6) AS wear_level FROM passes WHERE {HAS_TRUTH} AND {READABLE}""")
ROUTE_EVENTS = with_passes(f"""SELECT CASE WHEN p % 2 = 0 OR NOT {READABLE} THEN 'sim-lifecycle'
  WHEN side = 'A' THEN 'mill-predictions' ELSE 'mill-groundtruth' END AS topic, count(*) AS n_messages
FROM (SELECT o, p, 'A' AS side FROM passes WHERE {HAS_REQUEST} UNION ALL
      SELECT o, p, 'B' FROM passes WHERE {HAS_TRUTH}) GROUP BY 1""")
WRITE_METRICS = with_passes(f"""SELECT {KEYS}, {stamp("measured_at")} AS ts, actual AS actual_roll_force_kn,
  round(wear_level, 6) AS wear_level FROM passes WHERE {HAS_TRUTH}""")
EXPORT_TSV = with_passes(r"""SELECT concat_ws(chr(9), strftime(measured_at, '%Y-%m-%d %H:%M:%S') || '.0', steel_grade,
  slab_id, CAST(pass_number AS VARCHAR), CASE WHEN l_tax > 0.07 THEN 'a\tb\\c\nd\re' ELSE '\N' END,
  CAST(temperature_c / 8 AS VARCHAR)) AS line FROM passes""")
ENGINEER_FEATURES = with_passes(f"""SELECT {KEYS}, {VECTOR[13]} AS absolute_draft, {VECTOR[14]} AS temp_draft_interaction,
  {VECTOR[15]} AS volume FROM passes WHERE {HAS_REQUEST}""")
DEFAULT_FEATURES = with_passes(f"""SELECT {KEYS}, {", ".join(f"{v} AS {n}" for n, v in zip(MEASURED, VECTOR))}
FROM passes WHERE {HAS_REQUEST}""")
FEATURE_VECTOR = with_passes(f"""SELECT {KEYS}, {", ".join(f"{v} AS {n}" for n, v in zip(FEATURE_NAMES, VECTOR))}
FROM passes WHERE {HAS_REQUEST}""")
RESIDUAL_AND_APE = with_passes(f"""SELECT {KEYS}, round(actual - baseline, 2) AS residual,
  round({ape("baseline", "actual")}, 6) AS baseline_ape, 0e0 AS zero_actual_ape FROM passes""")
FINAL_FORCE = with_passes(f"""SELECT {KEYS},
  round(baseline + 5 + (100 * reduction_pct - 20 * strain + 3 * strain_rate), 3) AS force FROM passes""")
MATCH_KEY = with_passes(f"SELECT slab_id || '-' || pass_number AS match_key FROM passes WHERE {HAS_REQUEST}")
EVENT_TIME = f"""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'error') THEN
  {stamp("date_trunc('millisecond', ts)")} ELSE 'rejected' END AS event_time FROM events"""
_CHECKS = [
    f"SELECT '{n}' AS rule, 'request' AS kind FROM passes WHERE {HAS_REQUEST} AND "
    f"(({SENT[n]}) IS NULL OR ({SENT[n]}) NOT BETWEEN {low!r} AND {high!r})"
    for n, (low, high) in FEATURE_RANGES.items()
] + [
    f"SELECT 'pass_number', 'request' FROM passes WHERE {HAS_REQUEST} AND p NOT BETWEEN 1 AND 10",
    f"SELECT 'baseline_roll_force_kn', 'request' FROM passes WHERE {HAS_REQUEST} AND baseline < 0",
    f"SELECT 'pass_number', 'truth' FROM passes WHERE {HAS_TRUTH} AND p NOT BETWEEN 1 AND 10",
    f"SELECT 'actual_roll_force_kn', 'truth' FROM passes WHERE {HAS_TRUTH} AND actual < 0",
    f"SELECT 'wear_level', 'truth' FROM passes WHERE {HAS_TRUTH} AND wear_level NOT BETWEEN 0 AND 100",
]
VALIDATE_RANGES = with_passes(
    f"SELECT rule, kind, count(*) AS n_rows FROM ({' UNION ALL '.join(_CHECKS)}) GROUP BY rule, kind"
)
FALLBACK_FLAG = with_passes(f"SELECT {KEYS}, CAST(actual > baseline AS INTEGER) AS flag FROM passes")
DISPLAY_ROUND = "SELECT event_id, round(value * 1.37e0, 2) AS shown FROM events"
DISPLAY_TIME = "SELECT event_id, strftime(ts, '%H:%M:%S') AS label FROM events"
UNSAFE_PREDICATE = with_passes(f"""SELECT {KEYS}, CAST(actual - baseline > baseline * 25e-2
  OR actual - baseline < -(baseline * 2e-1) AS INTEGER) AS unsafe FROM passes""")

# --- plant history ---

BASELINE_FORCE = with_passes(f"SELECT {KEYS}, baseline FROM passes")
DRIFT_WHAT_IF = with_passes(f"""SELECT {KEYS}, wear, round(greatest(baseline * (1 + pow(wear / 100, 1.5e0) * 4e-1
    * (greatest(1e-1, (1250 - temperature_c) / 200) * (100 / greatest(entry_thickness_mm, 10e0))
       * (1 + reduction_pct))), 0e0), 2) AS expected_force
FROM passes, (SELECT unnest([0e0, 20e0, 60e0, 90e0]) AS wear)""")
SLAB_TRAJECTORY = f"""WITH RECURSIVE {PASSES_SQL},
plan AS (SELECT *, row_number() OVER (PARTITION BY slab_id ORDER BY p) AS i, wait_time_sec / 5 AS wait,
    wait_time_sec % 7 - 3 AS noise, 1042e0 + o % 79 AS dia FROM passes),
walk AS (
  SELECT slab_id, pass_number, i, reduction_pct AS r, dia, 200e0 + sqrt(25e-1 + o % 50) AS h, 2000e0 + sqrt(25e-1 + o % 1000) AS l,
    greatest(889e0, 940e0 + o % 280 - (wait * 5e-1 + reduction_pct * 30 + noise)) AS t,
    least(56e-1, 15e-1 + (o % 6) / 10e0 + 2 * reduction_pct) AS v
  FROM plan WHERE i = 1
  UNION ALL
  SELECT n.slab_id, n.pass_number, n.i, n.reduction_pct, n.dia, w.h * (1 - w.r), w.l / (1 - w.r),
    greatest(889e0, w.t - (n.wait * 5e-1 + n.reduction_pct * 30 + n.noise)), least(56e-1, w.v + 2 * n.reduction_pct)
  FROM walk w JOIN plan n ON n.slab_id = w.slab_id AND n.i = w.i + 1),
strained AS (SELECT *, -ln(1 - r) AS strain, greatest(5e-1, least(162e-1,
    v * 1000 / sqrt(dia / 2 * (h * r)) * -ln(1 - r))) AS strain_rate FROM walk)
SELECT {KEYS}, round(h, 4) AS entry_thickness_mm, round(l, 4) AS length_mm, round(t, 4) AS temperature_c,
  round(v, 4) AS speed_m_s, round(strain, 4) AS strain, round(strain_rate, 4) AS strain_rate,
  round(greatest(5e0, least(178e0, 20 * pow(1200 / t, 4e0) * (pow(strain, 2e-1) * pow(strain_rate, 1e-1)))), 4)
    AS flow_stress_mpa FROM strained"""

_GRADES = "CASE user_id % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'microalloyed' ELSE 'high_alloy' END"


def wear_now(source: str) -> str:
    """Adds ``now`` to rows that have wear, step, every, bounces, since and sec."""
    return f"""SELECT *, CASE WHEN ticks <= 0 OR step = 0 THEN wear
      WHEN NOT bounces THEN greatest(1e-3, least(1e2, wear + step * ticks))
      WHEN ticks < first THEN wear + step * ticks
      WHEN (phase < span) = (step > 0) THEN 60e0 - (CASE WHEN phase < span THEN phase ELSE phase - span END) * abs(step)
      ELSE 1e-3 + (CASE WHEN phase < span THEN phase ELSE phase - span END) * abs(step) END AS now
    FROM (SELECT *, (ticks - first) % (2 * span) AS phase
      FROM (SELECT *, CAST(greatest(1, ceil((60e0 - 1e-3) / nullif(abs(step), 0))) AS BIGINT) AS span,
          CAST(greatest(1, ceil(CASE WHEN step > 0 THEN 60e0 - wear ELSE wear - 1e-3 END / nullif(abs(step), 0)))
               AS BIGINT) AS first
        FROM (SELECT *, sec // every - since // every AS ticks FROM ({source}))))"""


_LOG = f"""WITH RECURSIVE ev AS (SELECT *, {_GRADES} AS steel_grade, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
cmd AS (SELECT *, row_number() OVER (PARTITION BY steel_grade ORDER BY ts, event_id) AS i FROM ev
  WHERE event_type IN ('signup', 'error', 'purchase')),
log AS (
  SELECT steel_grade, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS command_id, CAST(NULL AS TIMESTAMP) AS ts,
    1e-3 AS wear, 0e0 AS step, CAST(1 AS BIGINT) AS every, false AS bounces, CAST(0 AS BIGINT) AS since
  FROM cmd WHERE i = 1
  UNION ALL
  SELECT steel_grade, i, command_id, ts, CASE event_type WHEN 'signup' THEN least(value, 1e2) ELSE now END,
    CASE event_type WHEN 'signup' THEN 0e0 WHEN 'error' THEN CASE WHEN k > 0 THEN (value - 10) / 50 ELSE 0e0 END
      ELSE (value - 30) / 1000 END,
    CASE WHEN event_type = 'error' AND k > 0 THEN k ELSE 1 END, event_type = 'error', sec
  FROM ({wear_now("""SELECT c.steel_grade, c.i, c.event_id AS command_id, c.ts, c.event_type, c.value, c.k, c.sec,
      l.wear, l.step, l.every, l.bounces, l.since
    FROM log l JOIN cmd c ON c.steel_grade = l.steel_grade AND c.i = l.i + 1""")}))"""
WEAR_TIMELINE = f"""{_LOG} SELECT steel_grade, command_id, round(wear, 6) AS wear_start, round(step, 6) AS step,
  CAST(every AS INTEGER) AS every FROM log WHERE i > 0"""
WEAR_ASOF = f"""{_LOG},
looked AS (SELECT e.event_id, e.sec, l.wear, l.step, l.every, l.bounces, l.since
  FROM (SELECT * FROM ev WHERE event_type IN ('click', 'view')) e
  ASOF LEFT JOIN (SELECT * FROM log WHERE i > 0) l ON e.steel_grade = l.steel_grade AND e.ts >= l.ts)
SELECT event_id, round(CASE WHEN wear IS NULL THEN 1e-3 ELSE now END, 6) AS wear_now FROM ({wear_now("SELECT * FROM looked")})"""
PASS_PHASE = with_passes(f"""SELECT {KEYS}, CASE WHEN p <= 2 THEN 'roughing' WHEN p <= 4 THEN 'intermediate'
  ELSE 'finishing' END AS pass_phase FROM passes""")
REDUCTION_CLASS = with_passes(f"""SELECT {KEYS}, total AS total_passes, CASE WHEN CAST(p AS DOUBLE) / total < 0.4 THEN 'heavy'
  WHEN CAST(p AS DOUBLE) / total < 0.8 THEN 'medium' ELSE 'light' END AS reduction_class
FROM (SELECT *, max(p) OVER (PARTITION BY slab_id) AS total FROM passes)""")

# Two runs: messages delayed in the first come with the second, behind the watermark of the first or not.
_MIDDLE = "TIMESTAMP '1998-06-05'"
_A_SLOW, _B_SLOW = "(o + 2 * p) % 61 = 11", "(o + 2 * p) % 61 = 7"
SERVE_ACCOUNTS = with_passes(f"""SELECT fate, CAST(sum(n) AS BIGINT) AS n_messages FROM (
  SELECT unnest(CASE
      WHEN NOT ({READABLE}) THEN [{{'fate': 'unusable', 'n': a + b}}]
      WHEN a - a_late = 1 AND b - b_late = 1 THEN [{{'fate': 'matched', 'n': 2}}]
      ELSE [{{'fate': 'late', 'n': a_late + b_late}}, {{'fate': 'unpaired', 'n': a - a_late + b - b_late}}] END, recursive := true)
  FROM (SELECT *, CAST(a = 1 AND {_A_SLOW} AND requested_at <= mark AS INTEGER) AS a_late,
               CAST(b = 1 AND {_B_SLOW} AND measured_at <= mark AS INTEGER) AS b_late
        FROM (SELECT *, CAST({HAS_REQUEST} AS INTEGER) AS a, CAST({HAS_TRUTH} AS INTEGER) AS b FROM passes),
             (SELECT max(CASE WHEN sent < {_MIDDLE} AND NOT slow THEN sent END) - to_minutes(5) AS mark FROM (
                SELECT requested_at AS sent, {_A_SLOW} AS slow FROM passes WHERE {HAS_REQUEST} AND {READABLE}
                UNION ALL SELECT measured_at, {_B_SLOW} FROM passes WHERE {HAS_TRUTH} AND {READABLE}))))
WHERE n > 0 GROUP BY fate""")
