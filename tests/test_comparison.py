"""Several policies by one expansion, sums in any order, expansion without a shuffle, ledger rows of replayed epochs."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chargeload.functions.numbers import LIMB_UNITS, exact_sum, limbs, merged_parts, parts_total, sum_parts
from chargeload.operators import changepoints, curves, metrics
from chargeload.operators.comparison import load_profiles
from chargeload.operators.policies import list_policies
from chargeload.operators.profile import load_profile
from chargeload.plans.jobs import analyze, analyze_policies
from chargeload.sinks import store
from chargeload.sources.registry import get_loader
from chargeload.streaming.ingest_stream import ingest_stream
from steploop import SCHEMA, session
from test_profile import EVENING, evening, stored
from test_property import random_sessions

D = dt.datetime


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("minutes", [5, 37])
def test_each_policy_as_by_itself(spark, minutes):
    data = random_sessions(120, seed=minutes) + [("decade", "st1", D(2024, 1, 1), D(2024, 9, 1), 5000.0, None, 11.0, 0, True)]
    s = spark.createDataFrame(data, SCHEMA)
    both = load_profiles(s, None, minutes)
    kpis = {r["policy_name"]: r.asDict() for r in both.metrics().collect()}
    series = both.load_timeseries()
    for p in list_policies():
        alone = load_profile(s, p, minutes)
        assert kpis[p] == metrics.baseline_metrics(alone).first().asDict()
        mine = series.where(F.col("policy_name") == p).drop("policy_name")
        assert rows(mine) == rows(curves.load_timeseries(alone.steps()).select(*mine.columns))
    fleet = series.where("level = 'fleet'").withColumnRenamed("load_kw", "total_load_kw")
    assert {r["policy_name"]: r.asDict() for r in both.metrics(fleet=fleet).collect()} == kpis


def test_no_sessions_and_only_invalid_ones(spark):
    for data in ([], [r for r in EVENING if not r[8]]):
        s = spark.createDataFrame(data, SCHEMA)
        both = load_profiles(s)
        assert both.load_timeseries().count() == 0
        for r in both.metrics().collect():
            assert r.asDict() == metrics.baseline_metrics(load_profile(s, r["policy_name"])).first().asDict()


def test_policies_are_named_once(spark):
    with pytest.raises(ValueError, match="once"):
        load_profiles(evening(spark), ["immediate_charge", "immediate_charge"])
    with pytest.raises(ValueError, match="Unknown policy"):
        load_profiles(evening(spark), ["nope"])


def test_one_wide_scan_and_one_expansion(spark):
    from chargeload.plans.adapters import events_sessions

    text = plan(load_profiles(events_sessions(spark, "/root/testdata/sf0.001"), None, 5).metrics())
    main = "\n".join(x for x in text.splitlines() if ":" not in x.split("+-")[0])       # without the subquery of the grid bounds
    assert main.count("FileScan") == 1
    assert main.count("Generate explode") == 3       # chunks, steps; and the few results to one row a policy


def test_analysis_of_all_policies(spark, tmp_path):
    root = str(tmp_path)
    store.insert_new_sessions(spark, stored(spark, evening(spark)), root, order_cols=["session_id"])
    ids = analyze_policies(spark, root, "depot", None, 15)
    assert sorted(ids) == list_policies()
    for policy, run_id in ids.items():
        one = analyze(spark, root, "depot", policy, 15, strategy="explode")
        (a, fa, sa), (b, fb, sb) = (store.run_results(spark, root, r) for r in (run_id, one))
        drop = ("run_id", "created_at")
        assert rows(a.drop(*drop)) == rows(b.drop(*drop))
        assert rows(fa.drop("run_id")) == rows(fb.drop("run_id")) and rows(sa.drop("run_id")) == rows(sb.drop("run_id"))
    with pytest.raises(LookupError):
        analyze_policies(spark, root, "other")


# --- sums ------------------------------------------------------------------------------------------

def test_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(5)
    values = [1e18] + [1_000_000_001.0] * 1000 + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 26) for _ in range(3000)] + [3e26, -3e26, 0.1, 1e9, 9e25]
    from fractions import Fraction

    got = set()
    for seed in range(4):
        rng = random.Random(seed)
        rng.shuffle(values)
        df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "v double, g int").repartition(1 + seed * 3)
        got.add(df.agg(exact_sum("v")).first()[0])
        got.add(df.groupBy("g").agg(*sum_parts("v", "x")).agg(*merged_parts("x")).select(parts_total("x")).first()[0])
    assert len(got) == 1
    exact = float(sum(map(Fraction, values)))
    assert got.pop() == pytest.approx(exact, rel=1e-12)
    small = spark.createDataFrame([(v,) for v in [1e18] + [1_000_000_001.0] * 1000], "v double")
    assert small.agg(exact_sum("v")).first()[0] == 1e18 + 1_000_000_001_000.0


def test_limbs_make_up_their_value(spark):
    values = [0.1, -0.1, 7.2, -1e-9, 999_999_999.999, -999_999_999.999, 2.0**-60, 0.0, 123456.789]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *limbs("v"))
    for r in df.collect():
        assert abs(sum(x * u for x, u in zip(r[1:], LIMB_UNITS.values(), strict=True)) - r[0]) <= 2.0**-57 + abs(r[0]) * 2e-16


def test_sums_of_infinite_and_missing_values(spark):
    one = lambda vs: spark.createDataFrame([(v,) for v in vs], "v double").agg(exact_sum("v")).first()[0]
    assert one([1.0, float("inf"), 1e300]) == float("inf") and one([2.0, None, 3.0]) == 5.0
    assert one([float("nan"), 1.0]) != one([float("nan"), 1.0])
    assert one([1e300, 1e300]) == 2e300


@pytest.mark.parametrize("policy", ["immediate_charge", "uniform_spread", "randomized_delay"])
def test_strategies_agree_bit_for_bit_on_extreme_values(spark, policy):
    rng, data = random.Random(9), []
    for i in range(200):
        a = D(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 2000))
        rate = rng.choice([float("inf"), float("nan"), 0.0, 6.0, 3e10, 7.7e19])
        data.append(session(f"s{i}", f"st{i % 3}", a, a + dt.timedelta(minutes=rng.randint(1, 700)), rng.choice([1e25, 2e12, 7.7, 1e9, 3.3e18]), None, rate))
    cols = ["level", "timestamp", "station_id", "load_kw", "energy_kwh", "active_sessions"]
    want = None
    for n in (1, 5):
        p = load_profile(spark.createDataFrame(data, SCHEMA).repartition(n), policy, 20)
        for t in (curves.load_timeseries(p.steps()), changepoints.load_timeseries(p)):
            got = rows(t.select(*cols))
            want = want or got
            assert got == want


def test_a_rate_that_is_no_number_fills_the_target_at_once(spark):
    s = spark.createDataFrame([session("n", "st", D(2024, 1, 1, 4), D(2024, 1, 1, 8), 9.0, None, float("nan"))], SCHEMA)
    for policy, steps in (("immediate_charge", 1), ("randomized_delay", 1), ("uniform_spread", 4)):
        got = [r["energy_delivered_kwh"] for r in load_profile(s, policy, 60).decisions().orderBy("timestamp").collect()]
        assert sum(got) == pytest.approx(9.0) and sum(x > 0 for x in got) == steps


# --- expansion -----------------------------------------------------------------------------------------

def test_expansion_has_no_fixed_partition_count(spark, tmp_path):
    path = str(tmp_path / "many")
    (spark.range(0, 6400, 1, 64).select(
        F.concat(F.lit("s"), "id").alias("session_id"), F.lit("st").alias("station_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("arrival_ts"),
        F.timestamp_seconds(1_700_004_000 + F.col("id") * 60).alias("departure_ts"), F.lit(5.0).alias("energy_requested_kwh"),
        F.lit(5.0).alias("energy_delivered_kwh"), F.lit(7.0).alias("max_charge_rate_kw"), F.lit(60).alias("session_duration_minutes"), F.lit(True).alias("is_valid"))
     .write.parquet(path))
    s = spark.read.parquet(path)
    for deal in (True, False):       # as a small input, and as one that is not
        p = load_profile(s, "immediate_charge", 5)
        p.deal = deal
        for df in (p.steps(), curves.fleet_load_curve(p.steps()), curves.load_timeseries(p.steps()), changepoints.load_timeseries(p), p.grid()):
            assert "REPARTITION_BY_NUM" not in plan(df)
        if not deal:
            assert "Exchange" not in plan(p.steps()).split("Subquery")[0]       # sessions are expanded where they are read
            assert plan(changepoints.change_events(p)).split("Subquery")[0].count("Exchange") == 0
    large = s.withColumn("session_id", F.concat("session_id", F.repeat(F.lit("x"), 10)))
    assert load_profile(large, "immediate_charge", 5).deal       # statistics decide, not the number of files


# --- the ledger ----------------------------------------------------------------------------------------------

def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def records(ids):
    return "\n".join(json.dumps({"_id": i, "connectionTime": "2024-01-01T10:00:00", "disconnectTime": "2024-01-01T11:00:00"}) for i in ids)


@pytest.mark.parametrize("where", ["ledger", "index", "append"])
def test_a_replayed_epoch_leaves_one_row_with_its_counts(spark, tmp_path, monkeypatch, where):
    src, root = str(tmp_path / "in"), str(tmp_path / "store")
    write(os.path.join(src, "a.json"), records("abcde"))
    at = {"ledger": "append_ingest_run", "index": "_append_ids", "append": "_mend_index"}[where]
    real = getattr(store, at)

    def crash(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(store, at, crash)
    if where != "ledger":
        monkeypatch.setattr("chargeload.plans.jobs._counted", crash)       # nor does the failed run get into the ledger
    with pytest.raises(Exception, match="driver lost"):
        ingest_stream(spark, "acn", src, root)
    monkeypatch.undo()
    assert getattr(store, at) is real and store.read_ingest_runs(spark, root).count() == 0
    store.insert_new_sessions(spark, get_loader("acn").load(spark, os.path.join(src, "a.json")).where("source_record_id < 'a'"), root)       # another writer mends first
    (run,) = ingest_stream(spark, "acn", src, root)
    assert (run["records_seen"], run["records_inserted"]) == (5, 5)
    (row,) = store.read_ingest_runs(spark, root).collect()
    assert (row["status"], row["records_seen"], row["records_inserted"], row["run_id"]) == ("completed", 5, 5, run["run_id"])
    assert store.read_sessions(spark, root).count() == 5 and store.stored_ids(spark, root).count() == 5
    assert [f for f in os.listdir(os.path.join(root, "_staging")) if f.startswith("epoch")] == []


def test_ledger_compaction_by_day(spark, tmp_path):
    root = str(tmp_path)
    base = {"source_dataset": "acn", "source_path": "p", "completed_at": None, "status": "completed", "records_seen": 1, "records_inserted": 1, "records_invalid": 0, "notes": None}
    for i in range(6):
        store.append_ingest_run(spark, root, base | {"run_id": f"r{i}", "started_at": D(2024, 1, 1 + i // 2, 12, tzinfo=dt.timezone.utc)})
    assert store.compact_ingest_runs(spark, root, dt.date(2024, 1, 3)) == 4
    assert sorted(r["run_id"] for r in store.read_ingest_runs(spark, root).collect()) == [f"r{i}" for i in range(6)]
    assert len(os.listdir(os.path.join(root, "ingest_runs_archive"))) >= 2 and store.compact_ingest_runs(spark, root, dt.date(2024, 1, 3)) == 0
    store.append_ingest_run(spark, root, base | {"run_id": "r0", "started_at": D(2024, 1, 1, 12, tzinfo=dt.timezone.utc)})       # a compaction that died before its deletions
    assert store.read_ingest_runs(spark, root).count() == 6
