"""Grid, expansion, policies, curves and KPIs; expected figures come from the step loop in ``steploop``."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chargeload.operators import curves, metrics
from chargeload.operators.grid import build_time_index, time_bounds
from chargeload.operators.policies import get_policy, list_policies, policies_frame
from chargeload.operators.profile import active_sessions_at, load_profile, session_frame
from steploop import SCHEMA, figures, session

D = dt.datetime
DAY = D(2023, 11, 24)


def at(hour, minute=0, second=0):
    return DAY + dt.timedelta(hours=hour, minutes=minute, seconds=second)


#: A depot evening: a van over midnight, a short fast stop inside it, a car without a station after a gap, one invalid row.
EVENING = [
    session("van", "gate", at(20, 45), at(29, 15), 61.0, 58.0, 11.0),
    session("taxi", "gate", at(22, 5, 30), at(22, 47), 18.0, None, 50.0),
    session("bike", "shed", at(21, 30), at(23), 0.9, 0.9, 0.25),
    session("guest", None, at(31), at(32, 20), None, 6.5, None),
    session("ghost", "shed", at(21), at(20), 9.0, None, 3.6, valid=False),
]


def evening(spark):
    return spark.createDataFrame(EVENING, SCHEMA)


def stored(spark, sessions, dataset="depot"):
    """The frame with the columns that the session store holds."""
    from chargeload.operators.quality import validate

    none = {"port_id": "string", "vehicle_id": "string", "average_charge_rate_kw": "double", "charging_duration_minutes": "int"}
    return validate(sessions.withColumns({"source_dataset": F.lit(dataset), "source_record_id": F.col("session_id"),
                                          "raw_payload": F.lit("{}"), **{c: F.lit(None).cast(t) for c, t in none.items()}}))


@pytest.mark.parametrize("span,minutes,n", [(90, 20, 5), (90, 90, 2), (100, 45, 3), (61, 60, 2), (7, 3, 3)])
def test_time_index(spark, span, minutes, n):
    start = at(13, 7)
    g = build_time_index(spark, start, start + dt.timedelta(minutes=span), minutes).orderBy("step_index").collect()
    assert [r["timestamp"] for r in g] == [start + k * dt.timedelta(minutes=minutes) for k in range(n)]
    assert {r["interval_hours"] for r in g} == {minutes / 60}


def test_time_index_zones_and_errors(spark):
    aware = dt.datetime(2023, 11, 24, 14, tzinfo=dt.timezone(dt.timedelta(hours=1)))
    assert build_time_index(spark, aware, at(13, 40), 10).orderBy("step_index").first()["timestamp"] == at(13)
    with pytest.raises(ValueError, match="end_ts must be after start_ts"):
        build_time_index(spark, at(9), at(8, 59), 5)
    with pytest.raises(ValueError, match="interval_minutes must be positive"):
        build_time_index(spark, at(8), at(9), -5)


def test_bounds_and_active_sessions(spark):
    s = spark.createDataFrame([r for r in EVENING if r[8]], SCHEMA)
    b = time_bounds(s).first()
    assert (b["grid_start"], b["grid_end"]) == (min(r[2] for r in EVENING if r[8]), max(r[3] for r in EVENING if r[8]))
    frame = session_frame(s)
    for t in (at(20, 44), at(20, 45), at(22, 30), at(22, 47), at(23), at(30), at(32, 20)):
        got = sorted(r["session_id"] for r in active_sessions_at(frame, t).collect())
        assert got == sorted(r[0] for r in EVENING if r[8] and r[2] <= t < r[3])


def test_session_frame_defaults(spark):
    rows = [session("a", None, at(1), at(2), None, 4.25), session("b", None, at(1), at(2), None), session("c", None, at(1), at(2), 0.0, 3.0, 0.0)]
    f = {r["session_id"]: r for r in session_frame(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(f[k]["energy_target_kwh"], f[k]["energy_baseline_kwh"], f[k]["max_rate_kw"]) for k in "abc"] == [
        (4.25, 4.25, 7.2), (30.0, 0.0, 7.2), (0.0, 3.0, 0.0)]


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread"])
@pytest.mark.parametrize("minutes", [5, 12, 30, 75])
def test_kpis(spark, policy, minutes):
    want = figures(EVENING, policy, minutes)
    p = load_profile(evening(spark), policy, minutes)
    assert p.bounds.first()["n_steps"] == len(want["steps"])
    assert curves.fleet_load_curve(p.steps()).count() == want["active"]
    per = {r["session_id"]: r["energy_kwh"] for r in metrics.energy_per_session(p.decisions()).collect()}
    assert per == pytest.approx(want["energy"])
    for strategy in ("explode", "changepoints"):
        k = metrics.baseline_metrics(p, strategy=strategy).first()
        assert k["peak_load_kw"] == pytest.approx(want["peak"], abs=0.0051)
        assert k["average_load_kw"] == pytest.approx(want["average"], abs=0.0051)
        assert k["load_factor"] == pytest.approx(want["average"] / want["peak"], abs=0.000051)
        assert k["total_energy_kwh"] == pytest.approx(sum(want["energy"].values()), abs=0.0051)
        assert (k["sessions_total"], k["targets_total"], k["sessions_completed"]) == (4, want["targets"], want["completed"])
        assert k["completion_rate"] == pytest.approx(want["completed"] / want["targets"], abs=0.000051)


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread"])
def test_step_loads(spark, policy):
    p = load_profile(evening(spark), policy, 15)
    z = curves.zero_filled_load(p.grid(), curves.fleet_load_curve(p.steps(), sort=False))
    got = [r["load_kw"] for r in z.orderBy("step_index").collect()]
    assert got == pytest.approx(figures(EVENING, policy, 15)["load"], abs=1e-9)


def test_invalid_sessions_only_count_as_targets(spark):
    p = load_profile(evening(spark), "immediate_charge", 15)
    assert p.sessions_count().first()["sessions_count"] == 4
    assert p.decisions().where("session_id = 'ghost'").count() == 0
    assert metrics.baseline_metrics(p).first()["targets_total"] == sum(1 for r in EVENING if r[4])


def test_no_sessions_gives_zeros(spark):
    p = load_profile(spark.createDataFrame([], SCHEMA), "randomized_delay", 10)
    assert p.decisions().count() == 0
    k = metrics.baseline_metrics(p).first()
    assert all(k[c] == 0 for c in ("peak_load_kw", "total_energy_kwh", "completion_rate", "sessions_total", "load_factor"))


def test_session_between_grid_points_counts_but_has_no_steps(spark):
    rows = [session("long", "st", at(3), at(5), 2.0), session("blink", "st", at(3, 21), at(3, 39), 2.0)]
    p = load_profile(spark.createDataFrame(rows, SCHEMA), "uniform_spread", 20)
    assert p.decisions().where("session_id = 'blink'").count() == 0
    assert metrics.baseline_metrics(p).first()["sessions_total"] == 2


def test_randomized_delay_is_stable_and_bounded(spark):
    runs = [load_profile(evening(spark), "randomized_delay", 10, seed=s).decisions().orderBy("session_id", "timestamp").collect()
            for s in (31, 31, 32)]
    assert runs[0] == runs[1] != runs[2]
    for sid, target in (("van", 61.0), ("taxi", 18.0), ("bike", 0.9)):
        assert sum(r["energy_delivered_kwh"] for r in runs[0] if r["session_id"] == sid) <= target + 1e-9


def test_zero_rate_does_not_fail(spark):
    rows = [session("still", "st", at(2), at(2, 50), 4.0, None, 0.0)]
    for policy in list_policies():
        d = load_profile(spark.createDataFrame(rows, SCHEMA), policy, 10).decisions().collect()
        assert len(d) == 5 and all(r["energy_delivered_kwh"] == 0.0 for r in d)


def test_curves_from_decisions(spark):
    times = [at(9, m) for m in (0, 20, 40)]
    rows = [(f"e{i}", times[j], 1.5 * (i + j), 0.5 * (i + j)) for i in range(3) for j in range(3) if i != j]
    dec = spark.createDataFrame(rows, "session_id string, timestamp timestamp, charge_rate_kw double, energy_delivered_kwh double")
    sessions = spark.createDataFrame([("e0", "n"), ("e1", "n"), ("e2", None)], "session_id string, station_id string")
    fleet = [(r["timestamp"], r["total_load_kw"], r["active_sessions"]) for r in curves.fleet_load_curve(dec).collect()]
    assert fleet == [(t, sum(x[2] for x in rows if x[1] == t), 2) for t in times]
    stations = {("n" if s in ("e0", "e1") else None, t) for s, t, _, _ in rows}
    assert curves.station_load_curves(dec, sessions).count() == len(stations)
    levels = {r["level"]: r["n"] for r in curves.load_timeseries(dec, sessions).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {"fleet": 3, "station": len(stations)}
    assert curves.fleet_load_curve(dec.limit(0)).count() == 0


def test_station_join_holds_as_many_decisions_a_task_at_any_size(spark):
    most = []
    for n in (600_000, 1_200_000):
        sessions = spark.range(n).select(F.concat(F.lit("s"), "id").alias("session_id"), F.concat(F.lit("st"), F.col("id") % 7).alias("station_id"))
        decisions = sessions.select("session_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("step"))
        tasks = (curves.with_station(decisions, sessions).groupBy(F.spark_partition_id())
                 .agg(F.count("*").alias("rows"), F.count("station_id").alias("mapped")).collect())
        assert sum(t["rows"] for t in tasks) == sum(t["mapped"] for t in tasks) == 2 * n
        most.append(max(t["rows"] for t in tasks))
    assert most[1] < 1.2 * most[0]


def test_station_join_dealt_by_number_gives_the_plain_joins_rows(spark, monkeypatch):
    sessions = spark.sql("SELECT * FROM VALUES ('a', 'n'), ('a', 'n'), ('b', NULL), ('c', 'n'), ('c', 's'), (NULL, 's'), ('idle', 's') t(session_id, station_id)")
    decisions = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 2), ('b', 1), ('c', 1), ('c', 2), (NULL, 1), ('stray', 1) t(session_id, step)")

    def rows():
        return sorted(map(tuple, curves.with_station(decisions, sessions).select("session_id", "step", "station_id").collect()), key=str)

    assert curves.map_partitions(sessions) is None
    plain = rows()
    monkeypatch.setattr(curves, "MAP_PARTITION_BYTES", 16)
    assert curves.map_partitions(sessions) >= curves.MIN_MAP_PARTITIONS
    assert rows() == plain == sorted([("a", 1, "n"), ("a", 2, "n"), ("b", 1, None), ("c", 1, "n"), ("c", 1, "s"), ("c", 2, "n"),
                                      ("c", 2, "s"), (None, 1, None), ("stray", 1, None)], key=str)


def test_station_query_dealt_by_number_gives_the_plain_querys_rows(spark, monkeypatch):
    from chargeload.plans.queries import QUERIES

    def rows():
        df = QUERIES["decisions_with_station_map"](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, df.collect()), key=str), plan

    plain, _ = rows()
    monkeypatch.setattr(curves, "MAP_PARTITION_BYTES", 512)
    dealt, plan = rows()
    assert dealt == plain and len(plain) > 1
    # sessions and map rows are shuffled once each, the expanded steps never
    assert plan.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("delivered,targets,want", [
    ({"a": 9.6, "b": 9.4, "c": 1.0}, {"a": 10.0, "b": 10.0}, (1, 0.5)),
    ({"a": 5.0}, {"a": 5.0, "b": 1.0, "c": 0.0, "d": -1.0}, (3, 0.75)),
    ({}, {}, (0, 0.0)),
])
def test_completion_rate_general_form(spark, delivered, targets, want):
    d = spark.createDataFrame(list(delivered.items()), "session_id string, energy_kwh double")
    t = spark.createDataFrame([*targets.items(), ("none", None)], "session_id string, target_kwh double")
    r = metrics.completion_rate(t, d).first()
    assert (r["sessions_completed"], r["completion_rate"]) == want


def test_targets_of_a_repeated_id_take_the_last_row(spark):
    rows = [("a", 5.0, "f1", 3), ("a", 8.0, "f2", 0), ("a", 7.0, "f1", 9), ("b", 0.0, "f1", 1), ("c", None, "f1", 2)]
    df = spark.createDataFrame(rows, "session_id string, energy_requested_kwh double, _file string, _row long")
    assert [tuple(r) for r in metrics.targets_of(df).collect()] == [("a", 8.0)]


def test_policy_registry(spark):
    assert list_policies() == ["immediate_charge", "randomized_delay", "uniform_spread"]
    with pytest.raises(ValueError, match="Unknown policy 'x'. Available: immediate_charge, randomized_delay, "
                                         "uniform_spread"):
        get_policy("x")
    rows = {r["name"]: r["description"] for r in policies_frame(spark).collect()}
    assert len(rows) == 3 and rows["uniform_spread"] == "Spread energy evenly across the charging window."


def test_analyze_job_and_run_lookup(spark, tmp_path):
    from chargeload.plans.jobs import analyze
    from chargeload.sinks import store

    root = str(tmp_path)
    store.insert_new_sessions(spark, stored(spark, evening(spark)), root, order_cols=["session_id"])
    with pytest.raises(ValueError, match="Unknown policy"):
        analyze(spark, root, "depot", policy="nope")
    with pytest.raises(LookupError, match="No sessions found"):
        analyze(spark, root, "other")
    want = figures(EVENING, "immediate_charge", 15)
    for strategy in ("explode", "changepoints", "auto"):
        run_id = analyze(spark, root, "depot", "immediate_charge", 15, strategy=strategy)
        kpi, fleet, stations = store.run_results(spark, root, run_id)
        k = kpi.first()
        assert (k["sessions_count"], k["interval_minutes"], k["policy_name"]) == (4, 15, "immediate_charge")
        assert fleet.count() == want["active"] and k["peak_load_kw"] == pytest.approx(want["peak"], abs=0.0051)
        assert {r["station_id"] for r in stations.collect()} == {"gate", "shed", None}
    with pytest.raises(LookupError, match="not found"):
        store.run_results(spark, root, "missing")


def test_analyze_with_only_invalid_sessions_stores_zeros(spark, tmp_path):
    from chargeload.plans.jobs import analyze
    from chargeload.sinks import store

    root = str(tmp_path)
    only = spark.createDataFrame([r for r in EVENING if not r[8]], SCHEMA)
    store.insert_new_sessions(spark, stored(spark, only), root, order_cols=["session_id"])
    run_id = analyze(spark, root, "depot", "uniform_spread", 5)
    k, fleet, stations = store.run_results(spark, root, run_id)
    r = k.first()
    assert (r["sessions_count"], r["peak_load_kw"], r["completion_rate"], r["targets_total"]) == (0, 0.0, 0.0, 1)
    assert fleet.count() == 0 and stations.count() == 0


def test_nan_target_never_charges(spark):
    rows = [session("nan", "st", at(4), at(6), float("nan")), session("ok", "st", at(4), at(6), 2.5)]
    for policy in list_policies():
        p = load_profile(spark.createDataFrame(rows, SCHEMA), policy, 20)
        d = p.steps().where("session_id = 'nan'").collect()
        assert len(d) == 6 and all(r["energy_delivered_kwh"] == r["charge_rate_kw"] == r["remaining_energy_kwh"] == 0.0 for r in d)
        assert metrics.baseline_metrics(p).first()["total_energy_kwh"] == 2.5


def test_concurrent_analyses_into_one_root(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from chargeload.plans.jobs import analyze
    from chargeload.sinks import store

    root = str(tmp_path)
    store.insert_new_sessions(spark, stored(spark, evening(spark)), root, order_cols=["session_id"])
    with ThreadPoolExecutor(2) as pool:
        ids = list(pool.map(lambda pol: analyze(spark, root, "depot", pol, 15), ["immediate_charge", "uniform_spread"]))
    assert len(set(ids)) == 2
    for run_id in ids:
        k, fleet, _ = store.run_results(spark, root, run_id)
        assert k.count() == 1 and fleet.count() == figures(EVENING, "immediate_charge", 15)["active"]


def test_custom_policy_through_the_extension_point(spark):
    from chargeload.operators import changepoints
    from chargeload.operators.policies import POLICY_REGISTRY, Phases, Policy, register_policy

    register_policy(Policy("third_rate", "Charge at a third of the max rate from arrival.",
                           lambda ctx: Phases(F.lit(0).cast("long"), ctx.max_rate * F.lit(ctx.h) / F.lit(3.0))))
    slow = [(*r[:6], (r[6] if r[6] is not None else 7.2) / 3.0, *r[7:]) for r in EVENING]
    want = figures(slow, "immediate_charge", 15)
    try:
        p = load_profile(evening(spark), "third_rate", 15)
        loads = [r["load_kw"] for r in curves.zero_filled_load(
            p.grid(), curves.fleet_load_curve(p.steps(), sort=False)).orderBy("step_index").collect()]
        assert loads == pytest.approx(want["load"], abs=1e-9)
        a = changepoints.load_timeseries(p).where("level = 'fleet'").agg(F.sum("energy_kwh")).first()[0]
        assert a == pytest.approx(sum(want["energy"].values()))
    finally:
        POLICY_REGISTRY.pop("third_rate", None)
