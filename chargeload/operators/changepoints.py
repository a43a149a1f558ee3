"""Load curves from rate change points (the scale path for E1–E3).

Expanding every session to one row per plugged-in step costs Σ(session length / Δ)
rows. But under every policy a session's rate and energy per step are piecewise
constant with at most three levels (nothing yet → full steps → one partial step →
nothing), so a session is fully described by the changes of its (rate, energy, count)
level at no more than 6 steps (see :func:`change_events`).

Per (station, step) the deltas are summed (hash aggregation with map-side combine, in
the whole-number limbs of ``functions.numbers``, so +x and −x cancel exactly). The fleet's deltas are the sums of
the stations' deltas, as a group of their own, and one running sum per group turns deltas
into levels. Only the stretches with ≥ 1 plugged-in session are expanded to steps, spread
over the cluster. Work is O(sessions + output rows) instead of O(Σ session steps); a
group's window holds at most one row per grid step whatever the data volume, so a hot
station does not concentrate the raw data in one task.

Sessions whose energies are beyond the exact range (huge, infinite) have no exact deltas;
they are expanded step by step and added in the larger limbs of ``functions.numbers``. Results equal the explode path
(``LoadProfile.steps()`` + ``curves``) bit for bit up to 10^27.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeload.functions.numbers import LARGE_PARTS, LIMB_PARTS, is_exact, limbs, merged_parts, parts_total, sum_parts
from chargeload.operators.grid import _chunked_range, interval_hours, interval_micros
from chargeload.operators.profile import LoadProfile
from chargeload.operators.rows import attach_row

#: Stretches of equal load longer than this are cut and dealt out before they are expanded.
LONG_STRETCH = 4096


#: Columns of a change: the number of sessions, and the limbs of load and energy.
_SUMMED = ("dc", *[f"{n}_{p}" for n in ("load", "energy") for p in LIMB_PARTS])


def change_events(profile: LoadProfile) -> DataFrame:
    """(station_id, k, dc, load and energy limbs): per session, the change of its (rate, energy, count)
    level at each step where that level can change.

    A session's level function L(k) is known in closed form (plugged in on [k0, k1];
    from step a = k0 + offset: ``full`` steps of energy q, then one step of the remainder,
    then nothing; the rate is energy / h, or the flat rate on the first ``span`` steps).
    It can only change at k0, a, a+full, a+full+1, a+span and k1+1, so each session
    emits L(p) − L(p−1) at those (distinct, clipped) positions — at most 6 rows, zero
    changes dropped. Differences are of whole numbers, so they telescope to 0."""
    h = interval_hours(profile.interval_minutes)
    flat = profile.policy.flat_rate

    live = profile.phased().where(F.col("k1") >= F.col("k0")).where(in_exact_range())
    if profile.deal and not profile.spread:
        live = live.repartition("session_id")       # a small input; adaptive execution sizes the partitions
    s = live.select("station_id", "k0", "k1", (F.col("k0") + F.col("_a")).alias("a"), F.col("_full").alias("full"),
                    F.col("_rem").alias("rem"), F.col("_q").alias("q"), F.col("_span").alias("span"),
                    F.col("_flat").alias("flat"))

    def level(k: Column) -> tuple[Column, Column, Column]:
        inside = (k >= F.col("k0")) & (k <= F.col("k1"))
        i = k - F.col("a")
        energy = (F.when(inside & (i >= 0) & (i < F.col("full")), F.col("q"))
                  .when(inside & (i == F.col("full")), F.col("rem")).otherwise(F.lit(0.0)))
        if flat:
            rate = F.when(inside & (i >= 0) & (i < F.col("span")), F.col("flat")).otherwise(F.lit(0.0))
        else:
            rate = energy / F.lit(h)
        return F.when(inside, 1).otherwise(0), rate, energy

    end = F.col("k1") + 1
    a_ = F.col("a")
    raw = [F.col("k0"), a_, a_ + F.col("full"), a_ + F.col("full") + 1, end]
    if flat:
        raw.append(a_ + F.col("span"))
    positions = F.array_distinct(F.array(*[F.least(F.greatest(p, F.col("k0")), end) for p in raw]))
    s = s.select("*", F.explode(positions).alias("k"))
    now, before = level(F.col("k")), level(F.col("k") - 1)
    s = s.select("station_id", "k", (now[0] - before[0]).alias("dc"), now[1].alias("r1"), before[1].alias("r0"), now[2].alias("e1"), before[2].alias("e0"))
    s = s.where((F.col("dc") != 0) | (F.col("r1") != F.col("r0")) | (F.col("e1") != F.col("e0")))
    changes = [(x - y).alias(f"{n}_{p}") for n, c in (("load", "r"), ("energy", "e"))
               for p, x, y in zip(LIMB_PARTS, limbs(f"{c}1"), limbs(f"{c}0"), strict=True)]
    return s.select("station_id", "k", "dc", *changes)


def in_exact_range() -> Column:
    """Sessions all of whose step energies and rates are summed exactly (a step's rate is at
    most 60 times its energy, a NaN target never charges)."""
    return is_exact(F.col("_q") * F.lit(60.0)) & (F.col("_flat").isNull() | is_exact("_flat"))


def levels(profile: LoadProfile) -> DataFrame:
    """(fleet, station_id, step_index, active, load and energy limbs) of every step with ≥ 1 session:
    for each station, and with ``fleet`` true for all stations together."""
    sums = [F.sum(c).alias(c) for c in _SUMMED]
    station = change_events(profile).groupBy("station_id", "k").agg(*sums)
    both = station.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("fleet"))
    both = both.withColumn("station_id", F.when(~F.col("fleet"), F.col("station_id")))
    agg = both.groupBy("fleet", "station_id", "k").agg(*sums)
    w = Window.partitionBy("fleet", "station_id").orderBy("k")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lv = agg.select("fleet", "station_id", "k", *[F.sum(c).over(run).alias(c) for c in _SUMMED], F.lead("k").over(w).alias("k_next"))
    lv = lv.withColumnRenamed("dc", "active").where(F.col("active") > 0)
    # A stretch is expanded where it is. Only long ones (a wrong year, say) are first cut into chunks that are
    # dealt out anew; both branches read the same exchange.
    long = F.col("k_next") - F.col("k") > LONG_STRETCH
    cols = ["fleet", "station_id", "step_index", "active", *_SUMMED[1:]]
    here = lv.where(~long).select("*", F.explode(F.sequence(F.col("k"), F.col("k_next") - 1)).alias("step_index"))
    cut = _chunked_range(F.col("k"), F.col("k_next") - 1, LONG_STRETCH, "step_index", lv.where(long), ["fleet", "station_id"], profile.spread, deal=True)
    return here.select(*cols).unionByName(cut.select(*cols))


def inexact_levels(profile: LoadProfile) -> DataFrame:
    """The columns of :func:`levels` for the sessions outside the exact range, expanded step
    by step: all parts of their sums."""
    steps = profile.steps(where=~in_exact_range())
    steps = steps.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("fleet"))
    steps = steps.withColumn("station_id", F.when(~F.col("fleet"), F.col("station_id")))
    return steps.groupBy("fleet", "station_id", "step_index").agg(
        *sum_parts("charge_rate_kw", "load"), *sum_parts("energy_delivered_kwh", "energy"), F.count(F.lit(1)).alias("active"))


def load_timeseries(profile: LoadProfile) -> DataFrame:
    """LOAD rows (level, timestamp, station_id, load_kw, energy_kwh, active_sessions);
    same content as ``curves.load_timeseries(profile.steps())``."""
    d = interval_micros(profile.interval_minutes)
    start = profile.bounds.select("start_us")
    none = {p: F.lit(None).cast("bigint") for p in LARGE_PARTS} | {"other": F.lit(None).cast("double")}
    rows = levels(profile).withColumns({f"{n}_{p}": c for n in ("load", "energy") for p, c in none.items()})
    if inexact_sessions(profile):
        rows = rows.unionByName(inexact_levels(profile)).groupBy("fleet", "station_id", "step_index").agg(
            *merged_parts("load"), *merged_parts("energy"), F.sum("active").alias("active"))
    rows = attach_row(rows, start)
    return rows.select(
        F.when(F.col("fleet"), "fleet").otherwise("station").alias("level"),
        F.timestamp_micros(F.col("start_us") + F.col("step_index") * F.lit(d)).alias("timestamp"),
        "station_id",
        parts_total("load").alias("load_kw"),
        parts_total("energy").alias("energy_kwh"),
        F.col("active").cast("long").alias("active_sessions"),
    )


def inexact_sessions(profile: LoadProfile) -> bool:
    """Is there any session outside the exact range? (One narrow scan that stops at the first.)"""
    return bool(profile.phased().where(~in_exact_range()).limit(1).count())


def fleet_load_curve(profile: LoadProfile) -> DataFrame:
    """FLEET rows (timestamp, total_load_kw, total_energy_kwh, active_sessions)."""
    t = load_timeseries(profile).where(F.col("level") == "fleet")
    return t.select("timestamp", F.col("load_kw").alias("total_load_kw"),
                    F.col("energy_kwh").alias("total_energy_kwh"), "active_sessions")


def station_load_curves(profile: LoadProfile) -> DataFrame:
    """STATION rows (timestamp, station_id, load_kw, energy_kwh)."""
    t = load_timeseries(profile).where(F.col("level") == "station")
    return t.select("timestamp", "station_id", "load_kw", "energy_kwh")


# Sessions must span more steps than this on average before change points pay off:
# below it, the decimal bookkeeping and the extra window stage cost more than the
# rows the expansion would add.
CHANGEPOINT_MIN_STEPS = 32
# One session longer than this would be a straggler of the explode path (it is expanded
# by the task that reads it); under change points it costs at most 6 events like any other.
CHANGEPOINT_MAX_SESSION_STEPS = 50_000


def choose_strategy(profile: LoadProfile) -> str:
    """'changepoints' when sessions are long in steps on average, or any one session is
    extremely long; else 'explode'. One cheap aggregate over the sessions decides. A choice
    of plan only: both give the same figures."""
    r = profile.ranged.agg(F.avg("n_session_steps").alias("a"), F.max("n_session_steps").alias("m")).first()
    avg = r["a"] if r is not None and r["a"] is not None else 0.0
    longest = r["m"] if r is not None and r["m"] is not None else 0
    if avg > CHANGEPOINT_MIN_STEPS or longest > CHANGEPOINT_MAX_SESSION_STEPS:
        return "changepoints"
    return "explode"


def profile_load_timeseries(profile: LoadProfile, strategy: str = "auto") -> DataFrame:
    """LOAD rows by the chosen strategy: 'explode', 'changepoints' or 'auto'."""
    from chargeload.operators import curves

    if strategy == "auto":
        strategy = choose_strategy(profile)
    if strategy == "explode":
        return curves.load_timeseries(profile.steps())
    if strategy == "changepoints":
        return load_timeseries(profile)
    raise ValueError("strategy must be 'auto', 'explode' or 'changepoints'")
