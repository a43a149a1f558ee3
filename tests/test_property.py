"""Closed-form policies vs a literal step-by-step loop on random sessions."""

import datetime as dt
import random

import pytest

from chargeload.operators.profile import load_profile
from steploop import SCHEMA, literal_loop

D = dt.datetime
def random_sessions(n, seed):
    rnd = random.Random(seed)
    base = D(2024, 1, 1)
    rows = []
    for i in range(n):
        arr = base + dt.timedelta(seconds=rnd.randrange(0, 2 * 86400), microseconds=rnd.randrange(0, 10**6))
        dep = arr + dt.timedelta(seconds=rnd.randrange(60, 8 * 3600))
        req = rnd.choice([None, 0.0, round(rnd.uniform(0.5, 80), 3)])
        dlv = rnd.choice([None, round(rnd.uniform(0, 60), 2)])
        rate = rnd.choice([None, 3.3, 6.6, 7.2, 11.0, 50.0, round(rnd.uniform(1, 20), 2)])
        rows.append((f"p{i}", f"st{i % 5}", arr, dep, req, dlv, rate, int((dep - arr).total_seconds() // 60), True))
    return rows


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread", "randomized_delay"])
@pytest.mark.parametrize("minutes", [5, 7, 13, 15, 60])
def test_closed_form_matches_step_loop(spark, policy, minutes):
    from pyspark.sql import functions as F

    from chargeload.operators.policies import delay_fraction

    rows = random_sessions(60, seed=minutes)
    sessions = spark.createDataFrame(rows, SCHEMA)
    u = {r["session_id"]: r["u"] for r in
         sessions.select("session_id", delay_fraction(F.col("session_id"), 42).alias("u")).collect()}
    expected = literal_loop(rows, policy, minutes, u.get)
    got = {(r["session_id"], r["timestamp"]): (r["charge_rate_kw"], r["energy_delivered_kwh"])
           for r in load_profile(sessions, policy, minutes).decisions().collect()}
    assert set(got) == set(expected)
    for k, (c, e) in expected.items():
        gc, ge = got[k]
        assert ge == pytest.approx(e, abs=1e-6), k
        assert gc == pytest.approx(c, abs=1e-6), k


def test_invariants(spark):
    from pyspark.sql import functions as F

    from chargeload.operators import curves

    sessions = spark.createDataFrame(random_sessions(200, seed=3), SCHEMA)
    for policy in ("immediate_charge", "uniform_spread", "randomized_delay"):
        p = load_profile(sessions, policy, 5)
        steps = p.steps()
        assert steps.where((F.col("charge_rate_kw") < 0) | (F.col("energy_delivered_kwh") < 0)).count() == 0
        per = steps.groupBy("session_id").agg(F.sum("energy_delivered_kwh").alias("e"))
        tot = p.session_totals().join(per, "session_id", "left")
        assert tot.where(F.col("e") > F.col("energy_target_kwh") + 1e-9).count() == 0
        assert tot.where(F.abs(F.coalesce("e", F.lit(0.0)) - F.col("delivered_kwh")) > 1e-9).count() == 0
        ts = curves.load_timeseries(steps)
        fleet = ts.where("level = 'fleet'").select("timestamp", F.col("load_kw").alias("f"))
        st = ts.where("level = 'station'").groupBy("timestamp").agg(F.sum("load_kw").alias("s"))
        assert fleet.join(st, "timestamp").where(F.abs(F.col("f") - F.col("s")) > 1e-9).count() == 0


EXTREME_RATES = [float("inf"), float("nan"), 0.0, 6.0, None]
EXTREME_TARGETS = [float("inf"), 1e25, 0.0, 7.5, None]


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread"])
def test_extreme_rates_and_targets_match_step_loop(spark, policy):
    """Infinite, NaN, zero and huge figures: every decision as the loop makes it."""
    import math

    base = D(2024, 2, 5, 6, 30)
    rows = [(f"x{i}-{j}", f"st{j}", base + dt.timedelta(minutes=7 * i), base + dt.timedelta(minutes=7 * i + 95), e, None, r, 95, True)
            for i, r in enumerate(EXTREME_RATES) for j, e in enumerate(EXTREME_TARGETS)]
    expected = literal_loop(rows, policy, 15, None)
    got = {(r["session_id"], r["timestamp"]): (r["charge_rate_kw"], r["energy_delivered_kwh"])
           for r in load_profile(spark.createDataFrame(rows, SCHEMA), policy, 15).decisions().collect()}
    assert set(got) == set(expected)
    for k, want in expected.items():
        for g, w in zip(got[k], want):
            assert g == w or math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-6), (k, got[k], want)


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread", "randomized_delay"])
def test_both_strategies_give_the_same_unrounded_figures(spark, policy):
    """Explode and change points agree bit for bit, infinite and huge sessions included."""
    from chargeload.operators import changepoints, curves, metrics

    base = D(2024, 2, 5, 6, 30)
    odd = [(f"x{i}-{j}", "st1", base + dt.timedelta(hours=3 * (5 * i + j)), base + dt.timedelta(hours=3 * (5 * i + j), minutes=95), e, None, r, 95, True)
           for i, r in enumerate(EXTREME_RATES) for j, e in enumerate(EXTREME_TARGETS)]
    sessions = spark.createDataFrame(random_sessions(150, seed=8) + odd, SCHEMA)
    p = load_profile(sessions, policy, 15)
    cols = ["level", "timestamp", "station_id", "load_kw", "energy_kwh", "active_sessions"]
    a, b = ({tuple(r[:3]): tuple(r[3:]) for r in f.select(*cols).collect()}
            for f in (curves.load_timeseries(p.steps()), changepoints.load_timeseries(p)))
    assert a.keys() == b.keys()
    assert [(k, a[k], b[k]) for k in a if a[k] != b[k]] == []
    one, two = (metrics.baseline_metrics(p, strategy=s).first() for s in ("explode", "changepoints"))
    assert str(one) == str(two)        # NaN equals NaN


def test_huge_targets_do_not_stop_the_run(spark):
    from chargeload.operators import changepoints, metrics

    rows = [("big", "st", D(2024, 3, 1, 4), D(2024, 3, 1, 6), 1e25, None, 1e25, 120, True),
            ("usual", "st", D(2024, 3, 1, 4), D(2024, 3, 1, 6), 3.0, None, 6.0, 120, True)]
    p = load_profile(spark.createDataFrame(rows, SCHEMA), "immediate_charge", 30)
    assert metrics.baseline_metrics(p).first()["total_energy_kwh"] == 1e25
    first = changepoints.load_timeseries(p).where("level = 'fleet'").orderBy("timestamp").first()
    assert first["load_kw"] == pytest.approx(1e25) and first["active_sessions"] == 2


def test_one_wrong_year_is_expanded_by_many_tasks(spark):
    from chargeload.operators import changepoints

    rows = [("w", "st", D(2024, 3, 1, 4), D(2031, 3, 1, 4), 5.0, None, 6.0, 10, True)]
    p = load_profile(spark.createDataFrame(rows, SCHEMA), "immediate_charge", 60, spread=8)
    df = changepoints.load_timeseries(p).where("level = 'fleet'")
    spread = df.select("timestamp").rdd.glom().map(len).collect()
    assert sum(spread) == (D(2031, 3, 1) - D(2024, 3, 1)).days * 24
    assert max(spread) < 0.5 * sum(spread)


@pytest.mark.parametrize("text,digits,want", [(0.00499996, 2, 0.0), (0.005, 2, 0.01), (13.124999999999998, 2, 13.13), (2.4999951, 0, 2.0)])
def test_rounding_is_not_done_twice(spark, text, digits, want):
    from pyspark.sql import functions as F

    from chargeload.functions.numbers import round_half_up

    assert spark.range(1).select(round_half_up(F.lit(text), digits)).first()[0] == want
