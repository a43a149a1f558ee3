"""Load profile (G9): valid sessions → prepared frame → grid bounds → per-step decisions.

``load_profile`` is lazy: it returns a :class:`LoadProfile` whose frames are plans, not
results. Per-session quantities (steps, delivered energy) come from the closed forms
without expanding anything; only ``steps()``/``decisions()`` expand sessions to steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeload.functions.numbers import positive
from chargeload.operators.grid import (
    DEFAULT_CHUNK_STEPS,
    DEFAULT_INTERVAL_MINUTES,
    expand_steps,
    interval_hours,
    interval_micros,
    time_bounds,
    time_grid,
    with_step_range,
)
from chargeload.operators.policies import DEFAULT_SEED, Phases, Policy, StepContext, get_policy

# Fallbacks when a session lacks a max rate or any energy figure.
DEFAULT_MAX_RATE_KW = 7.2
DEFAULT_ENERGY_KWH = 30.0


def valid_sessions(sessions: DataFrame) -> DataFrame:
    """Rows marked valid; frames without an ``is_valid`` column pass unchanged."""
    if "is_valid" in sessions.columns:
        return sessions.where(F.col("is_valid"))
    return sessions


def session_frame(sessions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prepared sessions: target = requested → delivered → 30 kWh; rate → 7.2 kW."""
    return sessions.select(
        *keep,
        "session_id", "station_id", "arrival_ts", "departure_ts",
        F.coalesce(F.col("energy_requested_kwh"), F.col("energy_delivered_kwh"),
                   F.lit(DEFAULT_ENERGY_KWH)).alias("energy_target_kwh"),
        F.coalesce(F.col("energy_delivered_kwh"), F.lit(0.0)).alias("energy_baseline_kwh"),
        F.coalesce(F.col("max_charge_rate_kw"), F.lit(DEFAULT_MAX_RATE_KW)).alias("max_rate_kw"),
        "session_duration_minutes",
    )


def active_sessions_at(frame: DataFrame, ts) -> DataFrame:
    """Sessions plugged in at instant ``ts``: arrival ≤ ts < departure."""
    t = F.lit(ts).cast("timestamp")
    return frame.where((F.col("arrival_ts") <= t) & (F.col("departure_ts") > t))


def policy_context(policy_seed: int, interval_minutes: int) -> StepContext:
    d = interval_micros(interval_minutes)
    return StepContext(
        target=F.col("energy_target_kwh"), max_rate=F.col("max_rate_kw"), h=interval_hours(interval_minutes),
        first_step_us=F.col("start_us") + F.col("k0") * F.lit(d),
        arrival_us=F.unix_micros("arrival_ts"), departure_us=F.unix_micros("departure_ts"),
        session_id=F.col("session_id"), seed=policy_seed,
    )


#: Inputs estimated at fewer bytes than this may come as one split; their sessions are dealt out before they are
#: expanded. Larger ones come in splits enough, and are never shuffled for the expansion.
SMALL_INPUT_BYTES = 64 << 20


#: An estimate from here on (a frame made from an RDD has the largest bigint) says nothing.
UNKNOWN_BYTES = 1 << 50


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of ``df`` in bytes, None where it has none. (The plan's statistics; no job runs.)"""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    except Exception:  # noqa: BLE001 - no JVM plan at hand (Spark Connect)
        return None
    return size if size < UNKNOWN_BYTES else None


def _is_small(df: DataFrame) -> bool:
    """Is the input estimated below ``SMALL_INPUT_BYTES``?"""
    size = estimated_bytes(df)
    return size is not None and size < SMALL_INPUT_BYTES


def with_schedules(base: DataFrame, schedules: dict[str, Phases]) -> DataFrame:
    """``base`` plus each schedule's closed form, its columns ending in the schedule's key: _a offset, _q step
    energy (at most the target, so an infinite or NaN rate fills it in one step), _full whole steps, _rem the
    energy of the step after them, _span charging steps, _flat flat rate or NULL. Computed once per session,
    before any expansion, for all policies alike."""
    E, n = F.col("energy_target_kwh"), F.col("n_session_steps").cast("double")
    zero = F.lit(0.0)
    first, second, third = [], [], []
    for key, ph in schedules.items():
        flat = ph.flat_rate if ph.flat_rate is not None else F.lit(None).cast("double")
        # Only a positive target charges (a NaN target never does: "remaining" is then 0).
        q = F.when(positive(E), F.least(ph.step_energy, E)).otherwise(zero)
        first += [ph.offset.cast("long").alias(f"_a{key}"), q.alias(f"_q{key}"), flat.alias(f"_flat{key}")]
        q, x = F.col(f"_q{key}"), F.col(f"_x{key}")
        whole = F.when(~positive(q), zero).when(q >= E, F.lit(1.0)).otherwise(E / q)
        second.append(F.least(whole, n + F.lit(1.0)).alias(f"_x{key}"))        # finite; more steps are never used
        rem = F.when(positive(q) & (q < E), E - F.floor(x).cast("double") * q).otherwise(zero)
        third += [F.floor(F.least(x, n)).cast("long").alias(f"_full{key}"), F.when(positive(rem), rem).otherwise(zero).alias(f"_rem{key}"),
                  F.least(F.ceil(x).cast("double"), n).cast("long").alias(f"_span{key}")]
    kept = [*base.columns, *[f"_{c}{key}" for key in schedules for c in ("a", "q", "flat")]]
    return base.select("*", *first).select("*", *second).select(*kept, *third)


def delivered_energy(key: str = "") -> Column:
    """Energy that a session gets over all its steps (closed form), from :func:`with_schedules` columns."""
    q = F.col(f"_q{key}")
    charging_steps = F.greatest(F.lit(0).cast("long"), F.col("n_session_steps") - F.col(f"_a{key}"))
    return F.when((q > 0) & (charging_steps > 0), F.least(F.col("energy_target_kwh"), charging_steps * q)).otherwise(F.lit(0.0))


def step_values(h: float, key: str = "") -> tuple[Column, Column]:
    """(rate, energy) of a session's step, from :func:`with_schedules` columns and ``step_index``."""
    q, flat, zero = F.col(f"_q{key}"), F.col(f"_flat{key}"), F.lit(0.0)
    i = F.col("step_index") - F.col("k0") - F.col(f"_a{key}")              # steps since charging began
    energy = F.when((i >= 0) & (i < F.col(f"_full{key}")), q).when(i == F.col(f"_full{key}"), F.col(f"_rem{key}")).otherwise(zero)
    rate = F.when(flat.isNotNull(), F.when((i >= 0) & (i < F.col(f"_span{key}")), flat).otherwise(zero)).otherwise(energy / F.lit(h))
    return rate, energy


@dataclass
class LoadProfile:
    """A lazy load analysis of one set of sessions under one policy and step length."""

    sessions: DataFrame          # every given session (valid or not)
    ranged_all: DataFrame        # every prepared session + _valid flag, start_us, k0, k1, n_session_steps
    bounds: DataFrame            # one row: grid_start, grid_end, start_us, n_steps
    policy: Policy
    interval_minutes: int
    seed: int
    chunk_steps: int = DEFAULT_CHUNK_STEPS
    spread: int | None = None    # partitions to expand in, if the caller wants a number
    deal: bool = False           # a small input: deal its sessions out before they are expanded
    by_session: int | None = None    # deal the sessions by id over so many partitions before they are expanded

    @property
    def policy_name(self) -> str:
        return self.policy.name

    @property
    def ranged(self) -> DataFrame:
        """Valid, prepared sessions with their step range (what is expanded)."""
        return self.ranged_all.where(F.col("_valid")).drop("_valid")

    def grid(self) -> DataFrame:
        return time_grid(self.bounds, self.interval_minutes, self.chunk_steps, self.spread)

    def sessions_count(self) -> DataFrame:
        return self.ranged.agg(F.count(F.lit(1)).alias("sessions_count"))

    def phased(self, all_rows: bool = False) -> DataFrame:
        """``ranged`` plus the policy's per-session schedule (see :func:`with_schedules`);
        ``all_rows`` keeps invalid sessions too (with their ``_valid`` flag)."""
        base = self.ranged_all if all_rows else self.ranged
        return with_schedules(base, {"": self.policy.phases(policy_context(self.seed, self.interval_minutes))})

    def session_totals(self, all_rows: bool = False) -> DataFrame:
        """Per valid session (every session with ``all_rows``, flagged ``_valid``): steps
        plugged in and energy delivered over them (closed form; 0 for invalid ones)."""
        total = delivered_energy()
        cols = ["session_id", "station_id", "energy_requested_kwh", "energy_target_kwh", "n_session_steps"]
        if all_rows:
            return self.phased(True).select(*cols, "_valid",
                                            F.when(F.col("_valid"), total).otherwise(F.lit(0.0)).alias("delivered_kwh"))
        return self.phased().select(*cols, total.alias("delivered_kwh"))

    def steps(self, where=None) -> DataFrame:
        """(``where``: a condition on :meth:`phased` columns.) One row per (session, step): station, step, timestamp, rate, energy, state.

        With j the session-local step, a the start offset and q the step energy: energy is
        q on the whole steps from j = a on, then the remainder once; rate = energy / h, or
        the flat rate while energy remains; delivered before = min(E, (j−a)·q)."""
        phased = self.phased() if where is None else self.phased().where(where)
        if self.by_session:
            phased = phased.repartition(self.by_session, "session_id")
        elif self.deal and not self.spread:
            phased = phased.repartition("session_id")       # a small input; adaptive execution sizes the partitions
        expanded = expand_steps(phased, self.interval_minutes, self.chunk_steps, self.spread)
        E, q = F.col("energy_target_kwh"), F.col("_q")
        i = F.col("step_index") - F.col("k0") - F.col("_a")              # steps since charging began
        rate, energy = step_values(interval_hours(self.interval_minutes))
        before = F.when(i > 0, F.greatest(F.lit(0.0), F.least(E, i * q))).otherwise(F.lit(0.0))
        remaining_minutes = F.greatest(
            F.lit(0.0), (F.unix_micros("departure_ts") - F.unix_micros("timestamp")) / F.lit(1_000_000.0) / F.lit(60.0))
        return expanded.select(
            "session_id", "station_id", "step_index", "timestamp",
            rate.alias("charge_rate_kw"),
            energy.alias("energy_delivered_kwh"),
            before.alias("delivered_so_far_kwh"),
            F.when(positive(E - before), E - before).otherwise(F.lit(0.0)).alias("remaining_energy_kwh"),
            remaining_minutes.alias("remaining_minutes"),
        )

    def decisions(self) -> DataFrame:
        """DECISION rows: session_id, timestamp, charge_rate_kw, energy_delivered_kwh."""
        return self.steps().select("session_id", "timestamp", "charge_rate_kw", "energy_delivered_kwh")


def load_profile(sessions: DataFrame, policy: str = "immediate_charge",
                 interval_minutes: int = DEFAULT_INTERVAL_MINUTES, seed: int = DEFAULT_SEED,
                 chunk_steps: int = DEFAULT_CHUNK_STEPS, spread: int | str | None = "auto",
                 by_session: int | None = None) -> LoadProfile:
    """Plan a load analysis. Checks the policy and the step length first (cheap, eager);
    everything touching data stays lazy. ``by_session``: steps come hash-partitioned by session id in that many
    partitions, for a join by it (``curves.map_partitions``): sessions are shuffled then, not their many steps."""
    pol = get_policy(policy)
    interval_micros(interval_minutes)
    flag = F.col("is_valid") if "is_valid" in sessions.columns else F.lit(True)
    prepared_all = session_frame(sessions.withColumn("_valid", F.coalesce(flag, F.lit(False))),
                                 keep=("energy_requested_kwh", "_valid"))
    bounds = time_bounds(prepared_all.where(F.col("_valid")), interval_minutes)
    ranged_all = with_step_range(prepared_all, bounds, interval_minutes)
    deal = spread == "auto" and _is_small(sessions)
    spread = None if spread == "auto" else spread
    return LoadProfile(sessions=sessions, ranged_all=ranged_all, bounds=bounds, policy=pol,
                       interval_minutes=interval_minutes, seed=seed, chunk_steps=chunk_steps, spread=spread, deal=deal,
                       by_session=by_session)
