"""KPIs of a load analysis.

Peak and average load need the per-step fleet load; everything else (energy,
completion, counts) comes from per-session closed forms over the session table, so the
KPI row costs one pass over sessions plus the fleet curve — no join of decisions
against targets, no per-session grouping of expanded rows.

Precondition (guaranteed by the session store): ``session_id`` is unique. Repeated ids are
counted as often as they stand there; read a store that two writers filled at once with
``dedupe=True``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeload.functions.numbers import exact_sum, positive, round_half_up
from chargeload.operators.curves import fleet_load_curve
from chargeload.operators.profile import LoadProfile
from chargeload.operators.rows import attach_row

# Fixed value: share of the requested energy at which a session counts as completed.
COMPLETION_THRESHOLD = 0.95


def energy_per_session(decisions: DataFrame) -> DataFrame:
    """Energy delivered per session, summed over its decisions."""
    return decisions.groupBy("session_id").agg(F.sum("energy_delivered_kwh").alias("energy_kwh"))


def completed(target: Column, delivered: Column, threshold: float) -> Column:
    """Has a session with this target got its share of it? (A target of 0 or less is met.)"""
    return (target <= 0) | (F.coalesce(delivered, F.lit(0.0)) / target >= F.lit(threshold))


def completion_rate(targets: DataFrame, delivered: DataFrame, threshold: float = COMPLETION_THRESHOLD) -> DataFrame:
    """General form: targets(session_id, target_kwh) ⟕ delivered(session_id, energy_kwh).

    One row: sessions_completed, targets_total, completion_rate (0.0 without targets)."""
    t = targets.where(F.col("target_kwh").isNotNull())
    j = t.join(delivered, "session_id", "left")
    agg = j.agg(
        F.count_if(completed(F.col("target_kwh"), F.col("energy_kwh"), threshold)).alias("sessions_completed"),
        F.count(F.lit(1)).alias("targets_total"),
    )
    return agg.withColumn("completion_rate", F.coalesce(
        F.try_divide(F.col("sessions_completed").cast("double"), F.col("targets_total").cast("double")),
        F.lit(0.0)))


def targets_of(sessions: DataFrame) -> DataFrame:
    """Completion targets: requested energy > 0, from every given session (valid or not),
    one per session id. A repeated id takes its last row: by the source order (``_file``,
    ``_row``) where the frame still has it, else by arrival, departure and target (a partial
    aggregation, so a repeated id collapses map-side)."""
    order = [c for c in ("_file", "_row") if c in sessions.columns]
    order = order or [c for c in ("arrival_ts", "departure_ts", "energy_requested_kwh") if c in sessions.columns]
    return (sessions.where(positive("energy_requested_kwh")).groupBy("session_id")
            .agg(F.max_by("energy_requested_kwh", F.struct(*order)).alias("target_kwh")))


def load_kpis(fleet: DataFrame, bounds: DataFrame) -> DataFrame:
    """peak, average over every grid step (idle steps count as 0), load factor; unrounded."""
    agg = fleet.agg(
        F.coalesce(F.max("total_load_kw"), F.lit(0.0)).alias("peak_load_kw"),
        F.coalesce(exact_sum("total_load_kw"), F.lit(0.0)).alias("_sum_load"),
        F.coalesce(F.sum("active_sessions"), F.lit(0)).cast("long").alias("decisions"),
    )
    k = attach_row(agg, bounds.select(F.coalesce("n_steps", F.lit(0)).alias("n_steps")))
    avg = F.coalesce(F.try_divide(F.col("_sum_load"), F.col("n_steps").cast("double")), F.lit(0.0))
    k = k.withColumn("average_load_kw", avg)
    factor = F.when(F.col("peak_load_kw") > 0, F.col("average_load_kw") / F.col("peak_load_kw")).otherwise(0.0)
    return k.withColumn("load_factor", factor).drop("_sum_load")


def session_kpis(profile: LoadProfile, threshold: float = COMPLETION_THRESHOLD) -> DataFrame:
    """One row from one pass over every given session: sessions_count (valid),
    total_energy_kwh, sessions_completed, decisions (valid sessions' steps) and
    targets_total (requested > 0, valid or not). Closed-form delivered energy; no expansion."""
    t = profile.session_totals(all_rows=True)
    valid, req = F.col("_valid"), F.col("energy_requested_kwh")
    return t.agg(
        F.count_if(valid).alias("sessions_count"),
        # exact sum: the total does not depend on the summation order
        F.coalesce(exact_sum(F.when(valid, F.col("delivered_kwh"))), F.lit(0.0)).alias("total_energy_kwh"),
        F.count_if(valid & positive(req) & completed(req, F.col("delivered_kwh"), threshold))
        .alias("sessions_completed"),
        F.coalesce(F.sum(F.when(valid, F.col("n_session_steps"))), F.lit(0)).cast("long").alias("decisions"),
        F.count_if(positive(req)).alias("targets_total"),
    )


def baseline_metrics(profile: LoadProfile, fleet: DataFrame | None = None,
                     threshold: float = COMPLETION_THRESHOLD, strategy: str = "explode") -> DataFrame:
    """The KPI row. Rounded like the reported figures: loads and energy to 2 decimals,
    completion and load factor to 4. A run without any decision reports zeros.

    ``fleet`` (timestamp, total_load_kw, …) may be given, e.g. read back from the load
    store; otherwise it is computed by ``strategy`` ('explode', 'changepoints', 'auto')."""
    if fleet is None:
        if strategy == "explode":
            fleet = fleet_load_curve(profile.steps(), sort=False)
        else:
            from chargeload.operators.changepoints import profile_load_timeseries

            t = profile_load_timeseries(profile, strategy).where(F.col("level") == "fleet")
            fleet = t.select("timestamp", F.col("load_kw").alias("total_load_kw"), "active_sessions")
    lk = load_kpis(fleet, profile.bounds).drop("decisions")
    sk = session_kpis(profile, threshold)
    k = attach_row(sk, lk)
    any_decision = F.col("decisions") > 0

    def zero_if_idle(c: Column, digits: int) -> Column:
        return F.when(any_decision, round_half_up(c, digits)).otherwise(F.lit(0.0))

    rate = F.coalesce(F.try_divide(F.col("sessions_completed").cast("double"),
                                   F.col("targets_total").cast("double")), F.lit(0.0))
    return k.select(
        F.lit(profile.policy_name).alias("policy_name"),
        F.col("sessions_count").cast("long").alias("sessions_total"),
        zero_if_idle(F.col("peak_load_kw"), 2).alias("peak_load_kw"),
        zero_if_idle(F.col("total_energy_kwh"), 2).alias("total_energy_kwh"),
        zero_if_idle(rate, 4).alias("completion_rate"),
        zero_if_idle(F.col("average_load_kw"), 2).alias("average_load_kw"),
        zero_if_idle(F.col("load_factor"), 4).alias("load_factor"),
        F.when(any_decision, F.col("sessions_completed")).otherwise(F.lit(0)).cast("long").alias("sessions_completed"),
        F.col("targets_total").cast("long").alias("targets_total"),
    )
