"""The change-point curves equal the explode-path curves (rounded to micro-units)."""

import datetime as dt

import pytest

from chargeload.functions.numbers import round6
from chargeload.operators import changepoints, curves
from chargeload.operators.profile import load_profile
from test_property import SCHEMA, random_sessions


def _norm(df):
    return df.select("level", "timestamp", "station_id", round6("load_kw").alias("l"),
                     round6("energy_kwh").alias("e"), "active_sessions")


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread", "randomized_delay"])
@pytest.mark.parametrize("minutes", [5, 60])
def test_strategies_agree(spark, policy, minutes):
    rows = random_sessions(150, seed=11 + minutes)
    rows.append(("zero-rate", "st0", dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 9), 12.0, None, 0.0, 360, True))
    rows.append(("zero-target", None, dt.datetime(2024, 1, 1, 4), dt.datetime(2024, 1, 1, 6), 0.0, None, 7.2, 120, True))
    rows.append(("tiny", None, dt.datetime(2024, 1, 1, 4, 0, 1), dt.datetime(2024, 1, 1, 4, 0, 2), 5.0, None, 7.2, 0, True))
    p = load_profile(spark.createDataFrame(rows, SCHEMA), policy, minutes)
    a = _norm(curves.load_timeseries(p.steps()))
    b = _norm(changepoints.load_timeseries(p))
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_strategy_choice(spark):
    short = random_sessions(20, seed=1)
    p = load_profile(spark.createDataFrame(short, SCHEMA), "immediate_charge", 60)
    assert changepoints.choose_strategy(p) == "explode"
    p = load_profile(spark.createDataFrame(short, SCHEMA), "immediate_charge", 1)
    assert changepoints.choose_strategy(p) == "changepoints"
    with pytest.raises(ValueError):
        changepoints.profile_load_timeseries(p, "nope")
    # one session of ~10 years at 5-minute steps: a straggler for the explode path
    rows = short + [("long", "st9", dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1), 50.0, None, 7.2, 0, True)]
    p = load_profile(spark.createDataFrame(rows, SCHEMA), "immediate_charge", 5)
    assert changepoints.choose_strategy(p) == "changepoints"


def test_hot_station_and_a_ten_year_session(spark):
    """One station holds a third of the sessions and one session runs for ten years: the
    strategies still agree, and 'auto' picks change points (no straggler expansion)."""
    from chargeload.operators import metrics

    rows = random_sessions(300, seed=77)
    rows = [(sid, "HOT" if i % 3 == 0 else st, *rest) for i, (sid, st, *rest) in enumerate(rows)]
    rows.append(("decade", "HOT", dt.datetime(2024, 1, 1), dt.datetime(2034, 1, 1), 5000.0, None, 11.0, 0, True))
    p = load_profile(spark.createDataFrame(rows, SCHEMA), "immediate_charge", 60)
    assert changepoints.choose_strategy(p) == "changepoints"
    a = metrics.baseline_metrics(p, strategy="explode").first()
    b = metrics.baseline_metrics(p, strategy="changepoints").first()
    assert a == b
    hot = _norm(changepoints.load_timeseries(p)).where("station_id = 'HOT'")
    assert hot.count() > 87_000          # the decade session keeps the hot station busy every hour
