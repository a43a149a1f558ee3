"""Charging policies (G4–G8) as closed-form column expressions.

A session's state in the service we replace depends only on the session itself (no shared
station or fleet limit), so each policy's step-by-step recursion has a closed form in
the session-local step ordinal ``j = step_index − k0``. With target E, max rate r,
step length h (hours):

* immediate_charge:  e_j = max(0, min(r·h, E − j·r·h)),  rate = e_j / h
* uniform_spread:    c = min(E / H0, r) (H0 = hours from the first step to departure);
                     e_j = max(0, min(c·h, E − j·c·h)),  rate = c while energy remains
* randomized_delay:  charging starts at the first step whose elapsed time since arrival
                     reaches delay = max(0, window − E/r)·u, then charges like
                     immediate_charge. u ∈ [0,1) is a per-session hash of (seed, id), so
                     it is order-free and stable under task retries.

Each policy is stated as its per-session schedule (:class:`Phases`: start offset, step
energy, optional flat rate), computed once per session. No state, no loop, no Python
per row: every step row then follows independently.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.functions.numbers import positive
from chargeload.functions.timestamps import MICROS_PER_HOUR

DEFAULT_SEED = 42

# Policy names and their descriptions as listed to users.
POLICY_DESCRIPTIONS = {
    "immediate_charge": "Charge at max rate immediately upon arrival.",
    "uniform_spread": "Spread energy evenly across the charging window.",
    "randomized_delay": "Delay start randomly within slack, then charge at max rate.",
}


@dataclass(frozen=True)
class StepContext:
    """Per-session column handles a policy's schedule may use."""

    target: Column          # E, kWh
    max_rate: Column        # r, kW
    h: float                # step length in hours
    first_step_us: Column   # t_{k0} (first grid step the session is plugged in at), epoch micros
    arrival_us: Column
    departure_us: Column
    session_id: Column
    seed: int


@dataclass(frozen=True)
class Phases:
    """A policy's per-session schedule in session-local steps, for change-point curves:
    nothing before ``offset``; from there steps of ``step_energy`` until the target is
    reached, the last one partial. The rate of a step is its energy / h, unless
    ``flat_rate`` is given: then that rate holds on every step while energy remains."""

    offset: Column
    step_energy: Column
    flat_rate: Column | None = None


def _hours(us: Column) -> Column:
    # Same operation order as timedelta.total_seconds() / 3600.0.
    return us / F.lit(1_000_000.0) / F.lit(3600.0)


def delay_fraction(session_id: Column, seed: int = DEFAULT_SEED) -> Column:
    """u ∈ [0, 1): first 32 bits of md5('<seed>:<session_id>') over 2^32."""
    key = F.concat(F.lit(f"{seed}:"), session_id)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _immediate_phases(ctx: StepContext) -> Phases:
    return Phases(F.lit(0).cast("long"), ctx.max_rate * F.lit(ctx.h))


def _uniform_rate(ctx: StepContext) -> Column:
    h0 = (ctx.departure_us - ctx.first_step_us) / F.lit(1_000_000.0) / F.lit(60.0) / F.lit(60.0)
    return F.when(positive(ctx.target) & (h0 > 0), F.least(ctx.target / h0, ctx.max_rate)).otherwise(F.lit(0.0))


def _uniform_phases(ctx: StepContext) -> Phases:
    c = _uniform_rate(ctx)
    return Phases(F.lit(0).cast("long"), c * F.lit(ctx.h), c)


def _delay_start(ctx: StepContext) -> Column:
    """First session-local step at which charging may start (0 when no delay, as for a NaN rate)."""
    window = _hours(ctx.departure_us - ctx.arrival_us)
    # r = 0 passes validation; try_divide keeps it from failing (ANSI) → no charging.
    slack = F.greatest(F.lit(0.0), window - F.try_divide(ctx.target, ctx.max_rate))
    delay_us = slack * delay_fraction(ctx.session_id, ctx.seed) * F.lit(float(MICROS_PER_HOUR))
    step_us = float(ctx.h * MICROS_PER_HOUR)
    lag = F.ceil((delay_us - (ctx.first_step_us - ctx.arrival_us)) / F.lit(step_us))
    start = F.greatest(F.lit(0).cast("long"), lag.cast("long"))
    return F.when(F.isnan(ctx.max_rate), F.lit(0).cast("long")).otherwise(start)


def _randomized_delay_phases(ctx: StepContext) -> Phases:
    usable = ctx.max_rate > 0       # also NaN, which fills the target in one step like an infinite rate
    return Phases(F.when(usable, _delay_start(ctx)).otherwise(F.lit(0).cast("long")),
                  F.when(usable, ctx.max_rate * F.lit(ctx.h)).otherwise(F.lit(0.0)))


@dataclass(frozen=True)
class Policy:
    """A policy is its per-session schedule; per-step energy, rate and state follow from
    it (``LoadProfile.steps``), and so do its change points (``changepoints``)."""

    name: str
    description: str
    schedule: Callable[[StepContext], Phases]
    flat_rate: bool = False     # rate is a per-session constant rather than energy / h

    def phases(self, ctx: StepContext) -> Phases:
        return self.schedule(ctx)


POLICY_REGISTRY: dict[str, Policy] = {
    "immediate_charge": Policy("immediate_charge", POLICY_DESCRIPTIONS["immediate_charge"], _immediate_phases),
    "uniform_spread": Policy("uniform_spread", POLICY_DESCRIPTIONS["uniform_spread"], _uniform_phases,
                             flat_rate=True),
    "randomized_delay": Policy("randomized_delay", POLICY_DESCRIPTIONS["randomized_delay"],
                               _randomized_delay_phases),
}


def register_policy(policy: Policy) -> None:
    """Add (or replace) a policy. Its ``schedule`` maps a :class:`StepContext` to
    :class:`Phases`; steps, change points and KPIs then work for it unchanged."""
    POLICY_REGISTRY[policy.name] = policy


def get_policy(name: str) -> Policy:
    """Policy by name; unknown names raise the same message as the service we replace."""
    policy = POLICY_REGISTRY.get(name)
    if policy is None:
        available = ", ".join(sorted(POLICY_REGISTRY))
        raise ValueError(f"Unknown policy '{name}'. Available: {available}")
    return policy


def list_policies() -> list[str]:
    return sorted(POLICY_REGISTRY)


def policies_frame(spark: SparkSession) -> DataFrame:
    """(name, description) of every policy, sorted by name."""
    rows = [(n, POLICY_REGISTRY[n].description) for n in list_policies()]
    return spark.createDataFrame(rows, "name string, description string")
