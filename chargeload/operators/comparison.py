"""Several policies in one analysis (E9, G9): one scan and one expansion for all of them.

Which steps a session is plugged in at does not depend on the policy, so the sessions are expanded once and
every step row carries each policy's rate and energy (closed forms, see ``profile.with_schedules``). One
aggregation adds up all policies side by side; only its small result is turned to one row per policy.
For the KPI row the session itself goes through the same expansion as one more row without a step, which brings
the per-session sums (sessions, targets, energy, completion) into the group of the missing step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeload.functions.numbers import exact_sum, parts_total, positive, round_half_up, sum_parts
from chargeload.operators.curves import both_levels
from chargeload.operators.grid import DEFAULT_INTERVAL_MINUTES, floor_div, interval_hours, interval_micros
from chargeload.operators.metrics import COMPLETION_THRESHOLD, completed
from chargeload.operators.policies import DEFAULT_SEED, get_policy, list_policies
from chargeload.operators.profile import LoadProfile, delivered_energy, load_profile, policy_context, step_values, with_schedules
from chargeload.operators.rows import attach_row


@dataclass
class PolicySet:
    """A lazy load analysis of one set of sessions under several policies."""

    base: LoadProfile            # sessions, grid and step ranges, which all policies share
    names: list[str]

    def _keys(self) -> dict[str, str]:
        return {f"_{i}": name for i, name in enumerate(self.names)}

    def phased(self) -> DataFrame:
        """Every prepared session (valid or not) with each policy's schedule."""
        context = policy_context(self.base.seed, self.base.interval_minutes)
        return with_schedules(self.base.ranged_all, {k: get_policy(n).phases(context) for k, n in self._keys().items()})

    def _expanded(self, with_sessions: bool) -> DataFrame:
        """One row per (valid session, step); ``with_sessions`` adds one row per session, valid or not, with a NULL step."""
        rows, chunk = self.phased(), self.base.chunk_steps
        live = F.col("_valid") & (F.col("k1") >= F.col("k0"))
        if not with_sessions:
            rows = rows.where(live)
        if self.base.deal:
            rows = rows.repartition("session_id")       # a small input; adaptive execution sizes the partitions
        no, alone = F.lit(None).cast("bigint"), F.array(F.lit(None).cast("bigint"))
        chunks = F.sequence(floor_div(F.col("k0"), chunk), floor_div(F.col("k1"), chunk))
        if with_sessions:
            chunks = F.when(live, F.concat(alone, chunks)).otherwise(alone)
        rows = rows.select("*", F.explode(chunks).alias("_chunk"))
        first = F.greatest(F.col("k0"), F.col("_chunk") * chunk)
        last = F.least(F.col("k1"), F.col("_chunk") * chunk + (chunk - 1))
        steps = F.when(F.col("_chunk").isNull(), F.array(no)).otherwise(F.sequence(first, last)) if with_sessions else F.sequence(first, last)
        return rows.select("*", F.explode(steps).alias("step_index"))

    def _timestamp(self) -> Column:
        return F.timestamp_micros(F.col("start_us") + F.col("step_index") * interval_micros(self.base.interval_minutes))

    def load_timeseries(self) -> DataFrame:
        """LOAD rows of both levels with ``policy_name``: for each policy what ``curves.load_timeseries`` gives."""
        h, keys = interval_hours(self.base.interval_minutes), self._keys()
        values = {k: step_values(h, k) for k in keys}
        aggs = [a for k, (rate, energy) in values.items() for a in (*sum_parts(rate, f"load{k}"), *sum_parts(energy, f"energy{k}"))]
        station = self._expanded(False).groupBy(self._timestamp().alias("timestamp"), "station_id").agg(
            *aggs, F.count(F.lit(1)).alias("active_sessions"))
        parts = [c for c in station.columns if c.startswith(("load_0_", "energy_0_"))]
        each = [F.struct(F.lit(name).alias("policy_name"), *[F.col(p.replace("_0_", f"{k}_")).alias(p.replace("_0_", "_")) for p in parts])
                for k, name in keys.items()]
        rows = station.select("timestamp", "station_id", "active_sessions", F.explode(F.array(*each)).alias("_p"))
        return both_levels(rows.select("timestamp", "station_id", "active_sessions", "_p.*"), ["policy_name", "timestamp"])

    def session_totals(self) -> DataFrame:
        """(policy_name, session_id, is_valid, delivered_kwh) of every session, valid or not, under each policy."""
        each = [F.struct(F.lit(name).alias("policy_name"), F.when(F.col("_valid"), delivered_energy(k)).otherwise(F.lit(0.0)).alias("delivered_kwh"))
                for k, name in self._keys().items()]
        return (self.phased().select("session_id", F.col("_valid").alias("is_valid"), F.explode(F.array(*each)).alias("_p"))
                .select("_p.policy_name", "session_id", "is_valid", "_p.delivered_kwh"))

    def _session_aggs(self, threshold: float, where: Column) -> list[Column]:
        valid, req = F.col("_valid"), F.col("energy_requested_kwh")
        out = [F.count_if(where & valid).alias("sessions"), F.count_if(where & positive(req)).alias("targets"),
               F.coalesce(F.sum(F.when(where & valid, F.col("n_session_steps"))), F.lit(0)).cast("long").alias("decisions")]
        for k in self._keys():
            got = delivered_energy(k)
            out += [F.coalesce(exact_sum(F.when(where & valid, got), where), F.lit(0.0)).alias(f"kwh{k}"),
                    F.count_if(where & valid & positive(req) & completed(req, got, threshold)).alias(f"done{k}")]
        return out

    def metrics(self, fleet: DataFrame | None = None, threshold: float = COMPLETION_THRESHOLD) -> DataFrame:
        """One KPI row per policy, as ``metrics.baseline_metrics`` gives for each.

        ``fleet`` (policy_name, total_load_kw) may be given, e.g. read back from the load store: then nothing is expanded."""
        keys = self._keys()
        loads = [f(k) for k in keys for f in (
            lambda k: F.coalesce(F.max(F.col(f"load{k}")), F.lit(0.0)).alias(f"peak{k}"),
            lambda k: F.coalesce(exact_sum(F.col(f"load{k}")), F.lit(0.0)).alias(f"sum{k}"))]
        session = [c for k in keys for c in (f"kwh{k}", f"done{k}")] + ["sessions", "targets", "decisions"]
        if fleet is None:
            h, missing = interval_hours(self.base.interval_minutes), F.col("step_index").isNull()
            steps = [a for k in keys for a in sum_parts(step_values(h, k)[0], f"load{k}")]
            by_step = self._expanded(True).groupBy("step_index").agg(*steps, *self._session_aggs(threshold, missing))
            by_step = by_step.select("step_index", *[F.when(~missing, parts_total(f"load{k}")).alias(f"load{k}") for k in keys], *session)
            one = by_step.agg(*loads, *[F.max(F.when(missing, F.col(c))).alias(c) for c in session])
            one = one.select(*[c for k in keys for c in (f"peak{k}", f"sum{k}")],
                             *[F.coalesce(F.col(c), F.lit(0.0) if c.startswith("kwh") else F.lit(0)).alias(c) for c in session])
        else:
            wide = fleet.select(*[F.when(F.col("policy_name") == n, F.col("total_load_kw")).alias(f"load{k}") for k, n in keys.items()])
            one = attach_row(self.phased().agg(*self._session_aggs(threshold, F.lit(True))), wide.agg(*loads))
        one = attach_row(one, self.base.bounds.select(F.coalesce("n_steps", F.lit(0)).alias("n_steps")))
        each = F.array(*[F.struct(*self._kpi_columns(k, n)) for k, n in keys.items()])
        return one.select(F.explode(each).alias("_k")).select("_k.*")

    @staticmethod
    def _kpi_columns(k: str, name: str) -> list[Column]:
        busy, zero = F.col("decisions") > 0, F.lit(0.0)

        def figure(c: Column, digits: int) -> Column:
            return F.when(busy, round_half_up(c, digits)).otherwise(zero)

        peak = F.col(f"peak{k}")
        average = F.coalesce(F.try_divide(F.col(f"sum{k}"), F.col("n_steps").cast("double")), zero)
        rate = F.coalesce(F.try_divide(F.col(f"done{k}").cast("double"), F.col("targets").cast("double")), zero)
        return [
            F.lit(name).alias("policy_name"), F.col("sessions").cast("long").alias("sessions_total"),
            figure(peak, 2).alias("peak_load_kw"), figure(F.col(f"kwh{k}"), 2).alias("total_energy_kwh"),
            figure(rate, 4).alias("completion_rate"), figure(average, 2).alias("average_load_kw"),
            figure(F.when(peak > 0, average / peak).otherwise(zero), 4).alias("load_factor"),
            F.when(busy, F.col(f"done{k}")).otherwise(F.lit(0)).cast("long").alias("sessions_completed"),
            F.col("targets").cast("long").alias("targets_total"),
        ]


def load_profiles(sessions: DataFrame, policies: list[str] | None = None, interval_minutes: int = DEFAULT_INTERVAL_MINUTES,
                  seed: int = DEFAULT_SEED) -> PolicySet:
    """Plan a load analysis under several policies (all registered ones if none are named)."""
    names = list(policies or list_policies())
    if len(set(names)) < len(names):
        raise ValueError("each policy once")
    return PolicySet(load_profile(sessions, [get_policy(n).name for n in names][0], interval_minutes, seed), names)
