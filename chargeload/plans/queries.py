"""Registered queries: one per operator of the inventory, each over the driver's tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame over the *whole* input
tables. Queries on files, stores and runs write those while they are built; the others only
plan. ``ORACLES`` holds, for each key that SQL can express, an independent
DuckDB statement over the same tables (see ``chargeload.plans.oracle``).

Reported kW / kWh figures are rounded to 6 decimals (micro-units), KPI figures the way
the KPI row rounds them, so results compare exactly across engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.functions.numbers import exact_sum, round6, round_half_up
from chargeload.operators import curves, metrics
from chargeload.operators.comparison import load_profiles
from chargeload.operators.policies import POLICY_DESCRIPTIONS, policies_frame
from chargeload.operators.profile import active_sessions_at, load_profile, session_frame, valid_sessions
from chargeload.operators.quality import errors_text
from chargeload.plans import oracle as O
from chargeload.plans.adapters import events_sessions

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

STEP_MINUTES = 5
ACTIVE_AT = "2024-01-15 12:00:00"


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _profile(spark: SparkSession, sf_dir: str, policy: str = "immediate_charge", minutes: int = STEP_MINUTES):
    return load_profile(events_sessions(spark, sf_dir), policy, minutes)


# --- B: projections and filters ----------------------------------------------------------

@query("validate_sessions", O.with_sessions(
    "SELECT session_id, is_valid, errors AS validation_errors, session_duration_minutes FROM checked"))
def q_validate_sessions(spark, sf_dir):
    s = events_sessions(spark, sf_dir)
    return s.select("session_id", "is_valid", errors_text("validation_errors").alias("validation_errors"),
                    "session_duration_minutes")


@query("session_duration", O.with_sessions(
    "SELECT session_id, arrival_ts, departure_ts, session_duration_minutes FROM checked"))
def q_session_duration(spark, sf_dir):
    return events_sessions(spark, sf_dir).select("session_id", "arrival_ts", "departure_ts",
                                                 "session_duration_minutes")


@query("valid_sessions", O.with_sessions(
    "SELECT session_id, station_id, arrival_ts, departure_ts, energy_requested_kwh, energy_delivered_kwh, "
    "max_charge_rate_kw, session_duration_minutes FROM checked WHERE is_valid"))
def q_valid_sessions(spark, sf_dir):
    return valid_sessions(events_sessions(spark, sf_dir)).select(
        "session_id", "station_id", "arrival_ts", "departure_ts", "energy_requested_kwh", "energy_delivered_kwh",
        "max_charge_rate_kw", "session_duration_minutes")


@query("session_frame", O.with_sessions(
    "SELECT session_id, station_id, arrival_ts, departure_ts, "
    f"coalesce(energy_requested_kwh, energy_delivered_kwh, {O.dbl(30.0)}) AS energy_target_kwh, "
    f"coalesce(energy_delivered_kwh, {O.dbl(0)}) AS energy_baseline_kwh, "
    f"coalesce(max_charge_rate_kw, {O.dbl(7.2)}) AS max_rate_kw, session_duration_minutes "
    "FROM checked WHERE is_valid"))
def q_session_frame(spark, sf_dir):
    return session_frame(valid_sessions(events_sessions(spark, sf_dir)))


@query("active_sessions_at", O.with_sessions(
    "SELECT session_id, station_id, arrival_ts, departure_ts FROM checked "
    f"WHERE is_valid AND arrival_ts <= TIMESTAMP '{ACTIVE_AT}' AND departure_ts > TIMESTAMP '{ACTIVE_AT}'"))
def q_active_sessions_at(spark, sf_dir):
    frame = session_frame(valid_sessions(events_sessions(spark, sf_dir)))
    return active_sessions_at(frame, ACTIVE_AT).select("session_id", "station_id", "arrival_ts", "departure_ts")


@query("station_map", O.with_sessions("SELECT DISTINCT session_id, station_id FROM checked"))
def q_station_map(spark, sf_dir):
    return curves.station_map(events_sessions(spark, sf_dir))


# --- E10 / G1 / F2: bounds, grid, expansion ---------------------------------------------

@query("time_bounds", O.with_grid(STEP_MINUTES,
    f"SELECT t_start AS grid_start, t_end AS grid_end, "
    f"(epoch_us(t_end) - epoch_us(t_start)) // {O.d_of(STEP_MINUTES)} + 1 AS n_steps FROM b"))
def q_time_bounds(spark, sf_dir):
    return _profile(spark, sf_dir).bounds.select("grid_start", "grid_end", "n_steps")


@query("time_grid", O.with_grid(STEP_MINUTES,
    f"SELECT ts AS timestamp, step_index, {O.dbl(O.h_of(STEP_MINUTES))} AS interval_hours FROM grid"))
def q_time_grid(spark, sf_dir):
    return _profile(spark, sf_dir).grid()


@query("session_steps", O.with_grid(STEP_MINUTES,
    "SELECT session_id, step_index, ts AS timestamp FROM steps"))
def q_session_steps(spark, sf_dir):
    return _profile(spark, sf_dir).steps().select("session_id", "step_index", "timestamp")


# --- G3–G9: state and policies ----------------------------------------------------------

def _decisions_sql(policy: str, minutes: int) -> str:
    return O.with_loop(policy, minutes,
        "SELECT session_id, ts AS timestamp, CAST(round(CAST(rate AS DECIMAL(28,9)), 6) AS DOUBLE) AS charge_rate_kw, "
        "CAST(round(CAST(energy AS DECIMAL(28,9)), 6) AS DOUBLE) AS energy_delivered_kwh FROM loop")


def _decisions(profile) -> DataFrame:
    return profile.decisions().select("session_id", "timestamp", round6("charge_rate_kw").alias("charge_rate_kw"),
                                      round6("energy_delivered_kwh").alias("energy_delivered_kwh"))


@query("policy_immediate", _decisions_sql("immediate_charge", STEP_MINUTES))
def q_policy_immediate(spark, sf_dir):
    return _decisions(_profile(spark, sf_dir, "immediate_charge"))


@query("policy_uniform", _decisions_sql("uniform_spread", STEP_MINUTES))
def q_policy_uniform(spark, sf_dir):
    return _decisions(_profile(spark, sf_dir, "uniform_spread"))


@query("policy_randomized_delay", _decisions_sql("randomized_delay", STEP_MINUTES))
def q_policy_randomized_delay(spark, sf_dir):
    return _decisions(_profile(spark, sf_dir, "randomized_delay"))


@query("load_profile", _decisions_sql("immediate_charge", 15))
def q_load_profile(spark, sf_dir):
    return _decisions(_profile(spark, sf_dir, "immediate_charge", 15))


@query("session_state", O.with_loop("immediate_charge", STEP_MINUTES,
    "SELECT session_id, step_index, CAST(round(CAST(delivered AS DECIMAL(28,9)), 6) AS DOUBLE) AS delivered_so_far_kwh, "
    f"CAST(round(CAST(greatest({O.dbl(0)}, target - delivered) AS DECIMAL(28,9)), 6) AS DOUBLE) AS remaining_energy_kwh, "
    f"CAST(round(CAST(greatest({O.dbl(0)}, CAST(epoch_us(departure_ts) - epoch_us(ts) AS DOUBLE) / {O.dbl(1000000)} "
    f"/ {O.dbl(60)}) AS DECIMAL(28,9)), 6) AS DOUBLE) AS remaining_minutes FROM loop"))
def q_session_state(spark, sf_dir):
    st = _profile(spark, sf_dir).steps()
    return st.select("session_id", "step_index",
                     round6("delivered_so_far_kwh").alias("delivered_so_far_kwh"),
                     round6("remaining_energy_kwh").alias("remaining_energy_kwh"),
                     round6("remaining_minutes").alias("remaining_minutes"))


# --- E1–E9: curves and KPIs -------------------------------------------------------------

@query("fleet_load_curve", O.with_loop("immediate_charge", STEP_MINUTES,
    "SELECT ts AS timestamp, CAST(round(CAST(sum(rate) AS DECIMAL(28,9)), 6) AS DOUBLE) AS total_load_kw, CAST(round(CAST(sum(energy) AS DECIMAL(28,9)), 6) AS DOUBLE) AS total_energy_kwh, "
    "count(session_id) AS active_sessions FROM loop GROUP BY ts"))
def q_fleet_load_curve(spark, sf_dir):
    f = curves.fleet_load_curve(_profile(spark, sf_dir).steps())
    return f.select("timestamp", round6("total_load_kw").alias("total_load_kw"),
                    round6("total_energy_kwh").alias("total_energy_kwh"), "active_sessions")


@query("station_load_curves", O.with_loop("uniform_spread", STEP_MINUTES,
    "SELECT ts AS timestamp, station_id, CAST(round(CAST(sum(rate) AS DECIMAL(28,9)), 6) AS DOUBLE) AS load_kw, CAST(round(CAST(sum(energy) AS DECIMAL(28,9)), 6) AS DOUBLE) AS energy_kwh "
    "FROM loop GROUP BY ts, station_id"))
def q_station_load_curves(spark, sf_dir):
    s = curves.station_load_curves(_profile(spark, sf_dir, "uniform_spread").steps())
    return s.select("timestamp", "station_id", round6("load_kw").alias("load_kw"),
                    round6("energy_kwh").alias("energy_kwh"))


@query("load_timeseries", O.with_loop("randomized_delay", STEP_MINUTES,
    "SELECT CASE WHEN grouping(station_id) = 1 THEN 'fleet' ELSE 'station' END AS level, ts AS timestamp, "
    "station_id, CAST(round(CAST(sum(rate) AS DECIMAL(28,9)), 6) AS DOUBLE) AS load_kw, CAST(round(CAST(sum(energy) AS DECIMAL(28,9)), 6) AS DOUBLE) AS energy_kwh, "
    "count(*) AS active_sessions FROM loop GROUP BY GROUPING SETS ((ts), (ts, station_id))"))
def q_load_timeseries(spark, sf_dir):
    t = curves.load_timeseries(_profile(spark, sf_dir, "randomized_delay").steps())
    return t.select("level", "timestamp", "station_id", round6("load_kw").alias("load_kw"),
                    round6("energy_kwh").alias("energy_kwh"), "active_sessions")


@query("load_curve_changepoints", O.with_loop("uniform_spread", 1,
    f"SELECT CASE WHEN grouping(station_id) = 1 THEN 'fleet' ELSE 'station' END AS level, ts AS timestamp, "
    f"station_id, {O.r2('sum(rate)', 6)} AS load_kw, {O.r2('sum(energy)', 6)} AS energy_kwh, "
    "count(*) AS active_sessions FROM loop GROUP BY GROUPING SETS ((ts), (ts, station_id))"))
def q_load_curve_changepoints(spark, sf_dir):
    """E3 by the change-point strategy (no per-step expansion of sessions), on a 1-minute
    grid where sessions span ~125 steps: the case the strategy is for."""
    from chargeload.operators.changepoints import profile_load_timeseries

    t = profile_load_timeseries(_profile(spark, sf_dir, "uniform_spread", 1), "changepoints")
    return t.select("level", "timestamp", "station_id", round6("load_kw").alias("load_kw"),
                    round6("energy_kwh").alias("energy_kwh"), "active_sessions")


@query("energy_per_session", O.with_loop("immediate_charge", STEP_MINUTES,
    "SELECT session_id, CAST(round(CAST(sum(energy) AS DECIMAL(28,9)), 6) AS DOUBLE) AS energy_kwh FROM loop GROUP BY session_id"))
def q_energy_per_session(spark, sf_dir):
    e = metrics.energy_per_session(_profile(spark, sf_dir).decisions())
    return e.select("session_id", round6("energy_kwh").alias("energy_kwh"))


@query("completion_rate", O.with_loop("immediate_charge", STEP_MINUTES, f"""
, delivered AS (SELECT session_id, sum(energy) AS energy_kwh FROM loop GROUP BY session_id),
t AS (SELECT session_id, energy_requested_kwh AS target FROM checked WHERE energy_requested_kwh > 0),
j AS (SELECT t.target, coalesce(d.energy_kwh, {O.dbl(0)}) AS got FROM t LEFT JOIN delivered d USING (session_id))
SELECT count(*) FILTER (WHERE target <= 0 OR got / target >= {O.dbl(0.95)}) AS sessions_completed,
       count(*) AS targets_total,
       {O.r2(f"coalesce(count(*) FILTER (WHERE target <= 0 OR got / target >= {O.dbl(0.95)}) / nullif(CAST(count(*) AS DOUBLE), 0), 0)", 4)} AS completion_rate
FROM j"""))
def q_completion_rate(spark, sf_dir):
    sessions = events_sessions(spark, sf_dir)
    p = load_profile(sessions, "immediate_charge", STEP_MINUTES)
    c = metrics.completion_rate(metrics.targets_of(sessions), metrics.energy_per_session(p.decisions()))
    return c.select("sessions_completed", "targets_total",
                    round_half_up("completion_rate", 4).alias("completion_rate"))


def _kpi_oracle_body(n_steps_sql: str) -> str:
    return f"""
, fl AS (SELECT ts, sum(rate) AS load FROM loop GROUP BY ts),
agg AS (SELECT coalesce(max(load), 0) AS peak, coalesce(sum(load), 0) AS total FROM fl),
nb AS (SELECT {n_steps_sql} AS n_steps FROM b)
"""


@query("load_kpis", O.with_loop("immediate_charge", STEP_MINUTES, _kpi_oracle_body(
    f"(epoch_us(t_end) - epoch_us(t_start)) // {O.d_of(STEP_MINUTES)} + 1") + f"""
SELECT {O.r2('peak', 6)} AS peak_load_kw, {O.r2('total / n_steps', 6)} AS average_load_kw,
       {O.r2(f'CASE WHEN peak > 0 THEN (total / n_steps) / peak ELSE 0 END', 6)} AS load_factor, n_steps
FROM agg, nb"""))
def q_load_kpis(spark, sf_dir):
    p = _profile(spark, sf_dir)
    k = metrics.load_kpis(curves.fleet_load_curve(p.steps(), sort=False), p.bounds)
    return k.select(round_half_up("peak_load_kw", 6).alias("peak_load_kw"),
                    round_half_up("average_load_kw", 6).alias("average_load_kw"),
                    round_half_up("load_factor", 6).alias("load_factor"), "n_steps")


@query("zero_filled_load", O.with_loop("immediate_charge", STEP_MINUTES, """
, fl AS (SELECT ts, sum(rate) AS load FROM loop GROUP BY ts)
SELECT g.step_index, g.ts AS timestamp, CAST(round(CAST(coalesce(fl.load, 0) AS DECIMAL(28,9)), 6) AS DOUBLE) AS load_kw
FROM grid g LEFT JOIN fl ON fl.ts = g.ts"""))
def q_zero_filled_load(spark, sf_dir):
    p = _profile(spark, sf_dir)
    z = curves.zero_filled_load(p.grid(), curves.fleet_load_curve(p.steps(), sort=False))
    return z.select("step_index", "timestamp", round6("load_kw").alias("load_kw"))


def _metrics_oracle(policy: str) -> str:
    body = f"""
, fl AS (SELECT ts, sum(rate) AS load FROM loop GROUP BY ts),
delivered AS (SELECT session_id, sum(energy) AS energy_kwh FROM loop GROUP BY session_id),
t AS (SELECT session_id, energy_requested_kwh AS target FROM checked WHERE energy_requested_kwh > 0),
j AS (SELECT t.target, coalesce(d.energy_kwh, {O.dbl(0)}) AS got FROM t LEFT JOIN delivered d USING (session_id)),
comp AS (SELECT count(*) FILTER (WHERE target <= 0 OR got / target >= {O.dbl(0.95)}) AS done, count(*) AS total FROM j),
agg AS (SELECT coalesce(max(load), 0) AS peak, coalesce(sum(load), 0) AS total_load FROM fl),
en AS (SELECT coalesce(sum(CAST(energy AS DECIMAL(38,18))), 0) AS energy, count(*) AS n_dec FROM loop),
nb AS (SELECT (epoch_us(t_end) - epoch_us(t_start)) // {O.d_of(STEP_MINUTES)} + 1 AS n_steps FROM b),
nv AS (SELECT count(*) AS n_valid FROM v)
SELECT '{policy}' AS policy_name, n_valid AS sessions_total,
  CASE WHEN n_dec > 0 THEN {O.r2('peak', 2)} ELSE 0 END AS peak_load_kw,
  CASE WHEN n_dec > 0 THEN {O.r2('energy', 2)} ELSE 0 END AS total_energy_kwh,
  CASE WHEN n_dec > 0 THEN {O.r2('coalesce(done / nullif(CAST(total AS DOUBLE), 0), 0)', 4)} ELSE 0 END
    AS completion_rate,
  CASE WHEN n_dec > 0 THEN {O.r2('total_load / n_steps', 2)} ELSE 0 END AS average_load_kw,
  CASE WHEN n_dec > 0 THEN {O.r2('CASE WHEN peak > 0 THEN (total_load / n_steps) / peak ELSE 0 END', 4)}
    ELSE 0 END AS load_factor,
  CASE WHEN n_dec > 0 THEN done ELSE 0 END AS sessions_completed,
  total AS targets_total
FROM comp, agg, en, nb, nv"""
    return O.with_loop(policy, STEP_MINUTES, body)


METRIC_POLICIES = ("immediate_charge", "uniform_spread", "randomized_delay")
ORACLES_BASELINE = " UNION ALL ".join(f"SELECT * FROM ({_metrics_oracle(p)})" for p in METRIC_POLICIES)


@query("baseline_metrics", ORACLES_BASELINE)
def q_baseline_metrics(spark, sf_dir):
    return load_profiles(events_sessions(spark, sf_dir), list(METRIC_POLICIES), STEP_MINUTES).metrics()


@query("decisions_with_station_map", O.with_loop("immediate_charge", STEP_MINUTES,
    f"SELECT station_id, count(*) AS decisions, count(DISTINCT session_id) AS sessions, {O.r2('sum(energy)', 6)} AS energy_kwh FROM loop GROUP BY station_id"))
def q_decisions_with_station_map(spark, sf_dir):
    """decisions, which name no station, joined to the session → station map."""
    sessions = events_sessions(spark, sf_dir)
    valid = valid_sessions(sessions)
    decisions = load_profile(sessions, "immediate_charge", STEP_MINUTES, by_session=curves.map_partitions(valid)).decisions()
    d = curves.with_station(decisions, valid)
    return d.groupBy("station_id").agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("session_id").alias("sessions"),
                                       round6(exact_sum("energy_delivered_kwh")).alias("energy_kwh"))


def _policies_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{p}' AS name, '{POLICY_DESCRIPTIONS[p]}' AS description, total_energy_kwh, sessions_total FROM ({_metrics_oracle(p)})" for p in METRIC_POLICIES)
    return f"SELECT * FROM ({rows})"


@query("policies_with_energy", _policies_sql())
def q_policies_with_energy(spark, sf_dir):
    """Every registered policy, as listed, next to what it delivers."""
    kpis = load_profiles(events_sessions(spark, sf_dir), None, STEP_MINUTES).metrics()
    listed = policies_frame(spark)
    return listed.join(kpis, listed["name"] == kpis["policy_name"]).select("name", "description", "total_energy_kwh", "sessions_total")


# Source, store, job and stream queries register themselves on import.
from chargeload.plans import queries_io  # noqa: E402,F401
