"""DuckDB SQL that recomputes each registered query from the raw tables.

These are deliberately *not* the closed forms the library uses: the grid is a real
range join (grid × sessions on arrival ≤ t < departure) and every policy is a
``WITH RECURSIVE`` step loop that carries the delivered energy from step to step,
the way the service we replace simulates it.
"""

from __future__ import annotations

SEED = 42


def h_of(minutes: int) -> str:
    return repr(minutes / 60.0)


def d_of(minutes: int) -> int:
    return minutes * 60_000_000


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


# Canonical sessions from events (same mapping as chargeload.plans.adapters) + duration + validity.
SESSIONS_CTE = f"""
raw AS (
  SELECT concat('events-', CAST(event_id AS VARCHAR)) AS session_id,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('ST-', CAST(user_id % 20 AS VARCHAR)) END AS station_id,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS arrival_ts,
         CAST(ts AS TIMESTAMP) + INTERVAL '1' MINUTE
           * (CASE WHEN event_id % 50 = 0 THEN 0 ELSE 20 + event_id % 220 END) AS departure_ts,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * {dbl(1.25)} END AS energy_requested_kwh,
         CASE WHEN event_id % 101 = 0 THEN -value WHEN event_id % 7 = 0 THEN NULL ELSE value END
           AS energy_delivered_kwh,
         CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN {dbl(6.6)} WHEN 2 THEN {dbl(11.0)}
           ELSE {dbl(50.0)} END AS max_charge_rate_kw,
         event_id, user_id, CAST(ts AS TIMESTAMP) AS t,
         CASE WHEN event_id % 50 = 0 THEN 0 ELSE 20 + event_id % 220 END AS minutes
  FROM events),
dur AS (
  SELECT *, CAST(CASE WHEN arrival_ts IS NULL OR departure_ts IS NULL THEN 0
              ELSE greatest(0, (epoch_us(departure_ts) - epoch_us(arrival_ts)) // 60000000) END AS INTEGER)
            AS session_duration_minutes
  FROM raw),
sessions AS (
  SELECT *,
    concat_ws('|',
      CASE WHEN arrival_ts IS NULL THEN 'arrival_ts:missing required timestamp' END,
      CASE WHEN departure_ts IS NULL THEN 'departure_ts:missing required timestamp' END,
      CASE WHEN departure_ts <= arrival_ts THEN 'departure_ts:departure must be after arrival' END,
      CASE WHEN session_duration_minutes <= 0 THEN 'session_duration_minutes:must be positive' END,
      CASE WHEN energy_requested_kwh < 0 THEN 'energy_requested_kwh:must be non-negative' END,
      CASE WHEN energy_delivered_kwh < 0 THEN 'energy_delivered_kwh:must be non-negative' END,
      CASE WHEN max_charge_rate_kw < 0 THEN 'max_charge_rate_kw:must be non-negative' END) AS errors
  FROM dur),
checked AS (SELECT *, errors = '' AS is_valid FROM sessions)
"""


def analysis_ctes(minutes: int, source: str = "checked") -> str:
    """Valid sessions, bounds, grid and the range join of grid × sessions."""
    d = d_of(minutes)
    return f"""
v AS (
  SELECT session_id, station_id, arrival_ts, departure_ts, energy_requested_kwh,
         coalesce(energy_requested_kwh, energy_delivered_kwh, {dbl(30.0)}) AS target,
         coalesce(max_charge_rate_kw, {dbl(7.2)}) AS r
  FROM {source} WHERE is_valid),
b AS (SELECT min(arrival_ts) AS t_start, max(departure_ts) AS t_end FROM v),
gi AS (SELECT t_start, unnest(generate_series(0, (epoch_us(t_end) - epoch_us(t_start)) // {d})) AS i FROM b),
grid AS (SELECT CAST(i AS BIGINT) AS step_index, t_start + to_microseconds(i * {d}) AS ts FROM gi),
steps AS (
  SELECT v.*, g.step_index, g.ts
  FROM v JOIN grid g ON g.ts >= v.arrival_ts AND g.ts < v.departure_ts)
"""


def _hours(us_expr: str) -> str:
    return f"CAST({us_expr} AS DOUBLE) / {dbl(1000000)} / {dbl(3600)}"


def _decision(policy: str, delivered: str, minutes: int) -> tuple[str, str]:
    """(energy, rate) SQL of one step, given the SQL of the energy delivered before it."""
    h = h_of(minutes)
    rem = f"greatest({dbl(0)}, s.target - ({delivered}))"
    immediate_e = f"least({rem}, s.r * {h})"
    if policy == "immediate_charge":
        return (f"CASE WHEN {rem} <= 0 THEN {dbl(0)} ELSE {immediate_e} END",
                f"CASE WHEN {rem} <= 0 THEN {dbl(0)} ELSE {immediate_e} / {h} END")
    if policy == "uniform_spread":
        rem_min = (f"greatest({dbl(0)}, CAST(epoch_us(s.departure_ts) - epoch_us(s.ts) AS DOUBLE)"
                   f" / {dbl(1000000)} / {dbl(60)})")
        rate = f"least({rem} / ({rem_min} / {dbl(60)}), s.r)"
        idle = f"{rem} <= 0 OR {rem_min} <= 0"
        return (f"CASE WHEN {idle} THEN {dbl(0)} ELSE least({rate} * {h}, {rem}) END",
                f"CASE WHEN {idle} THEN {dbl(0)} ELSE {rate} END")
    if policy == "randomized_delay":
        u = (f"CAST(CAST('0x' || substr(md5(concat('{SEED}:', s.session_id)), 1, 8) AS BIGINT) AS DOUBLE)"
             f" / {dbl(4294967296)}")
        window = _hours("epoch_us(s.departure_ts) - epoch_us(s.arrival_ts)")
        delay = f"CASE WHEN isnan(s.r) THEN {dbl(0)} ELSE greatest({dbl(0)}, {window} - s.target / s.r) * {u} END"
        elapsed = _hours("epoch_us(s.ts) - epoch_us(s.arrival_ts)")
        wait = f"{rem} <= 0 OR {elapsed} < {delay}"
        return (f"CASE WHEN {wait} THEN {dbl(0)} ELSE {immediate_e} END",
                f"CASE WHEN {wait} THEN {dbl(0)} ELSE {immediate_e} / {h} END")
    raise ValueError(policy)


def loop_cte(policy: str, minutes: int, name: str = "loop") -> str:
    """Step-by-step simulation: first step per session, then one step at a time."""
    e0, r0 = _decision(policy, dbl(0), minutes)
    nxt = "l.delivered + l.energy"
    e1, r1 = _decision(policy, nxt, minutes)
    return f"""
firsts AS (SELECT session_id, min(step_index) AS i0 FROM steps GROUP BY session_id),
{name} AS (
  SELECT s.session_id, s.station_id, s.step_index, s.ts, s.target, s.departure_ts,
         {dbl(0)} AS delivered, {e0} AS energy, {r0} AS rate
  FROM steps s JOIN firsts f ON s.session_id = f.session_id AND s.step_index = f.i0
  UNION ALL
  SELECT s.session_id, s.station_id, s.step_index, s.ts, s.target, s.departure_ts,
         {nxt} AS delivered, {e1} AS energy, {r1} AS rate
  FROM {name} l JOIN steps s ON s.session_id = l.session_id AND s.step_index = l.step_index + 1)
"""


def with_loop(policy: str, minutes: int, body: str) -> str:
    return f"WITH RECURSIVE {SESSIONS_CTE}, {analysis_ctes(minutes)}, {loop_cte(policy, minutes)} {body}"


# Rates and targets outside the usual range, by event: infinite, NaN and zero rates, a target of 10^25 kWh for a few.
EXTREME_CTE = f"""
extreme AS (
  SELECT * REPLACE (
    CASE event_id % 8 WHEN 1 THEN {dbl("'inf'")} WHEN 2 THEN {dbl("'nan'")} WHEN 3 THEN {dbl(0)} ELSE {dbl(6)} END AS max_charge_rate_kw,
    CASE WHEN event_id % 64 = 5 OR event_id % 640 = 9 THEN {dbl("'1e25'")} ELSE energy_requested_kwh END AS energy_requested_kwh)
  FROM checked)
"""


def with_extremes(policy: str, minutes: int, body: str) -> str:
    return f"WITH RECURSIVE {SESSIONS_CTE}, {EXTREME_CTE}, {analysis_ctes(minutes, 'extreme')}, {loop_cte(policy, minutes)} {body}"


def with_grid(minutes: int, body: str) -> str:
    return f"WITH {SESSIONS_CTE}, {analysis_ctes(minutes)} {body}"


def with_sessions(body: str) -> str:
    return f"WITH {SESSIONS_CTE} {body}"


def r2(x: str, digits: int) -> str:
    """Exact half-up rounding on the decimal value (mirrors functions.round_half_up)."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


# --- raw-file sources ------------------------------------------------------------------

ISO_RE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
OFFSET_RE = r"[T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)$"
UNKNOWN_ZONE = "Nowhere/Atlantis"


def parse_multi(text: str) -> str:
    """ISO (offset → UTC, naive as UTC), else the four layouts in order — DuckDB's own parsers."""
    return (f"CASE WHEN regexp_full_match(trim({text}), '{ISO_RE}') THEN "
            f"(CASE WHEN regexp_matches(trim({text}), '{OFFSET_RE}') "
            f"THEN timezone('UTC', CAST(trim({text}) AS TIMESTAMPTZ)) ELSE CAST(trim({text}) AS TIMESTAMP) END) "
            f"ELSE coalesce(try_strptime({text}, '%m/%d/%Y %H:%M'), try_strptime({text}, '%m/%d/%Y %I:%M:%S %p'), "
            f"try_strptime({text}, '%Y-%m-%d %H:%M:%S'), try_strptime({text}, '%d/%m/%Y %H:%M')) END")


def layout_text(c: str) -> str:
    """The same five layouts (and junk) the CSV fixture writes, formatted by DuckDB."""
    return (f"CASE WHEN event_id % 23 = 0 THEN 'not a date' "
            f"WHEN event_id % 5 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
            f"WHEN event_id % 5 = 1 THEN strftime({c}, '%m/%d/%Y %H:%M') "
            f"WHEN event_id % 5 = 2 THEN strftime({c}, '%-m/%-d/%Y %-I:%M:%S %p') "
            f"WHEN event_id % 5 = 3 THEN strftime({c}, '%d/%m/%Y %H:%M') "
            f"ELSE strftime({c} + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' END")


def charging_text() -> str:
    m = "((minutes * 3) // 4)"
    hh = f"CAST({m} // 60 AS VARCHAR)"
    mm = f"lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"
    ss = "lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')"
    return (f"CASE WHEN event_id % 17 = 0 THEN 'invalid' WHEN event_id % 7 = 3 THEN {hh} || ':' || {mm} "
            f"ELSE {hh} || ':' || {mm} || ':' || {ss} END")


def hms_parts(text: str) -> str:
    """Columns n, ph, pm, ps: the split of an h:mm[:ss] text (for parse_hms)."""
    p = f"string_split(trim({text}), ':')"
    return (f"len({p}) AS n, TRY_CAST(trim({p}[1]) AS INTEGER) AS ph, TRY_CAST(trim({p}[2]) AS INTEGER) AS pm, "
            f"TRY_CAST(trim({p}[3]) AS INTEGER) AS ps")


HMS_MINUTES = ("CAST(CASE WHEN n = 3 AND ph IS NOT NULL AND pm IS NOT NULL AND ps IS NOT NULL "
               "THEN ph * 60 + pm + CASE WHEN ps > 0 THEN 1 ELSE 0 END "
               "WHEN n = 2 AND ph IS NOT NULL AND pm IS NOT NULL THEN ph * 60 + pm END AS INTEGER)")


def valid_expr(extra: str = "") -> str:
    return ("(arrival_ts IS NOT NULL AND departure_ts IS NOT NULL AND departure_ts > arrival_ts "
            "AND session_duration_minutes > 0 AND coalesce(energy_requested_kwh, 0) >= 0 "
            "AND coalesce(energy_delivered_kwh, 0) >= 0 AND coalesce(max_charge_rate_kw, 0) >= 0 "
            "AND coalesce(charging_duration_minutes, 0) >= 0" + extra + ")")


def errors_expr() -> str:
    rules = [("arrival_ts IS NULL", "arrival_ts:missing required timestamp"),
             ("departure_ts IS NULL", "departure_ts:missing required timestamp"),
             ("departure_ts <= arrival_ts", "departure_ts:departure must be after arrival"),
             ("session_duration_minutes <= 0", "session_duration_minutes:must be positive")]
    rules += [(f"{c} < 0", f"{c}:must be non-negative") for c in
              ("energy_requested_kwh", "energy_delivered_kwh", "max_charge_rate_kw", "charging_duration_minutes")]
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules) + ")"


# Expected canonical rows of the JSON session fixture (chargeload.plans.fixtures.json_lines).
JSON_CTE = f"""
jx AS (
  SELECT r.*, (event_id % 10 = 7 OR event_id % 6 <> 5) AS zone_ok, (minutes * 3) // 4 AS ch_min FROM raw r),
jn AS (
  SELECT CASE WHEN event_id % 401 = 0 THEN 'acn-' ELSE concat('acn-', CAST(event_id AS VARCHAR)) END
           AS session_id,
         CASE WHEN event_id % 401 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS source_record_id,
         station_id,
         CASE WHEN event_id % 5 <> 0 THEN concat('P', CAST(event_id % 4 AS VARCHAR)) END AS port_id,
         CAST(user_id AS VARCHAR) AS vehicle_id,
         CASE WHEN zone_ok THEN arrival_ts END AS arrival_ts,
         CASE WHEN zone_ok THEN departure_ts END AS departure_ts,
         energy_requested_kwh,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE energy_delivered_kwh END AS energy_delivered_kwh,
         max_charge_rate_kw,
         CAST(CASE WHEN zone_ok AND arrival_ts IS NOT NULL THEN minutes ELSE 0 END AS INTEGER)
           AS session_duration_minutes,
         CAST(CASE WHEN zone_ok AND arrival_ts IS NOT NULL THEN ch_min END AS INTEGER) AS charging_duration_minutes,
         event_id
  FROM jx),
jv AS (SELECT *, {valid_expr()} AS is_valid, {errors_expr()} AS errors FROM jn)
"""

# Expected canonical rows of the CSV session fixture (chargeload.plans.fixtures.csv_frame).
CSV_CTE = f"""
ct AS (
  SELECT r.*, CAST(event_id % 8 AS INTEGER) AS bucket,
         {layout_text('arrival_ts')} AS start_text, {layout_text('departure_ts')} AS end_text,
         {charging_text()} AS ch_text,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE energy_delivered_kwh END AS kwh,
         CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 3 + 1 AS VARCHAR) END AS port,
         concat('EVSE-', CAST(event_id % 50 AS VARCHAR)) AS evse,
         row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1 AS row_ord
  FROM raw r),
cp AS (
  SELECT *, {parse_multi('start_text')} AS p_arr, {parse_multi('end_text')} AS p_dep, {hms_parts('ch_text')}
  FROM ct),
cn AS (
  SELECT bucket, CAST(row_ord AS VARCHAR) AS source_record_id, row_ord, station_id, port AS port_id, evse,
         p_arr AS arrival_ts, p_dep AS departure_ts, kwh AS energy_delivered_kwh,
         CAST(NULL AS DOUBLE) AS energy_requested_kwh, CAST(NULL AS DOUBLE) AS max_charge_rate_kw,
         {HMS_MINUTES} AS charging_duration_minutes,
         CAST(CASE WHEN p_arr IS NULL OR p_dep IS NULL THEN 0
              ELSE greatest(0, (epoch_us(p_dep) - epoch_us(p_arr)) // 60000000) END AS INTEGER)
           AS session_duration_minutes,
         start_text, ch_text, event_id
  FROM cp),
cv AS (SELECT *, {valid_expr()} AS is_valid, {errors_expr()} AS errors FROM cn)
"""


# Expected canonical rows of the CSV files whose cells go to the limits (chargeload.plans.fixtures.write_odd_csv_sessions).
ODD_CTE = f"""
ox AS (
  SELECT r.*, event_id % 41 = 0 AS short, event_id % 37 = 0 AND event_id % 41 <> 0 AS surplus, {charging_text()} AS ch_text,
         date_trunc('second', arrival_ts) AS a,
         CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 29 = 0 THEN TIMESTAMP '9999-12-31 00:00:00' ELSE date_trunc('second', departure_ts) END AS d,
         row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1 AS row_ord
  FROM raw r),
op AS (SELECT *, greatest(0, (epoch_us(d) - epoch_us(a)) // 60000000) AS wide, {hms_parts('ch_text')} FROM ox),
oq AS (
  SELECT concat('urbanev-b', CAST(event_id % 8 AS VARCHAR), '-', CAST(row_ord AS VARCHAR)) AS session_id, station_id, a AS arrival_ts, d AS departure_ts,
         CAST(NULL AS DOUBLE) AS energy_requested_kwh, CAST(NULL AS DOUBLE) AS max_charge_rate_kw,
         CASE WHEN short OR event_id % 13 = 0 THEN NULL ELSE energy_delivered_kwh END AS energy_delivered_kwh,
         CASE WHEN short OR event_id % 31 = 0 THEN NULL ELSE {HMS_MINUTES} END AS charging_duration_minutes,
         CAST(CASE WHEN coalesce(wide, 0) > 2147483647 THEN 0 ELSE coalesce(wide, 0) END AS INTEGER) AS session_duration_minutes,
         concat_ws('|', CASE WHEN surplus THEN 'raw_payload:more cells than the header' END,
                   CASE WHEN wide > 2147483647 THEN 'session_duration_minutes:out of range' END,
                   CASE WHEN event_id % 31 = 0 AND NOT short THEN 'charging_duration_minutes:out of range' END) AS notes,
         surplus
  FROM op),
ov AS (SELECT *, concat_ws('|', nullif({errors_expr()}, ''), nullif(notes, '')) AS errors FROM oq)
"""


def with_files(body: str, *ctes: str) -> str:
    extra = ", ".join(c.strip() for c in ctes)
    return f"WITH {SESSIONS_CTE}, {extra} {body}"
