"""Physical-plan properties: no Python evaluation, pruning and pushdown reach the scan."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
ANALYSIS = ["validate_sessions", "session_steps", "policy_immediate", "policy_uniform", "policy_randomized_delay",
            "fleet_load_curve", "station_load_curves", "load_timeseries", "load_curve_changepoints",
            "baseline_metrics", "zero_filled_load",
            "parse_local_timestamp", "parse_multi_format_datetime", "parse_hms_minutes", "safe_double"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ANALYSIS)
def test_no_python_in_plan(spark, name):
    p = plan(E.queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct"):
        assert node not in p, (name, node)


def test_events_scan_is_pruned(spark):
    from chargeload.operators.profile import load_profile
    from chargeload.plans.adapters import events_sessions

    p = load_profile(events_sessions(spark, SF), "immediate_charge", 5)
    text = plan(p.steps())
    # raw_payload (to_json of every event column) and props/event_type are never read
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text
    assert "to_json" not in text


def test_store_scan_prunes_partitions_and_columns(spark, tmp_path):
    from chargeload.plans.adapters import events_sessions
    from chargeload.sinks import store

    root = str(tmp_path)
    s = events_sessions(spark, SF)
    store.insert_new_sessions(spark, s, root, order_cols=["source_record_id"])
    text = plan(store.sessions_by_dataset(spark, root, "events"))
    assert "PartitionFilters: [isnotnull(source_dataset" in text and "(source_dataset" in text
    assert "raw_payload" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_expansion_is_partially_aggregated_before_shuffle(spark):
    text = plan(E.queries()["fleet_load_curve"](spark, SF))
    # a partial aggregation sits below the first exchange of the grouping keys
    assert "partial_sum" in text or "HashAggregate(keys=[timestamp" in text


def test_bounds_are_a_scalar_subquery_not_a_join(spark):
    text = plan(E.queries()["session_steps"](spark, SF))
    assert "Subquery" in text
    for join in ("NestedLoopJoin", "SortMergeJoin", "CartesianProduct"):
        assert join not in text


def test_row_ordinal_never_shuffles_the_data(spark, tmp_path):
    from chargeload.sources.readers import read_csv_records

    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "\n".join(f"{i},{i * 2}" for i in range(500)) + "\n")
    text = plan(read_csv_records(spark, str(path)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in text


def test_insert_streams_the_store_against_broadcast_batch_ids(spark, tmp_path):
    from chargeload.plans.adapters import events_sessions
    from chargeload.sinks import store

    root = str(tmp_path)
    s = events_sessions(spark, SF)
    store.insert_new_sessions(spark, s, root, order_cols=["source_record_id"])
    captured = []
    orig = store.insert_new_sessions

    import pyspark.sql.readwriter as rw
    real_parquet = rw.DataFrameWriter.parquet

    def spy(self, path, *a, **k):
        if path.endswith("/winners"):
            captured.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real_parquet(self, path, *a, **k)

    rw.DataFrameWriter.parquet = spy
    try:
        assert orig(spark, s, root, order_cols=["source_record_id"]) == 0
    finally:
        rw.DataFrameWriter.parquet = real_parquet
    assert captured and "BroadcastHashJoin" in captured[0] and "LeftSemi" in captured[0]
    # the index alone is read, and of it the batch's buckets
    assert "PartitionFilters: [bucket" in captured[0] and "raw_payload" not in captured[0]


def test_lookup_filter_is_pushed_to_the_scan(spark, tmp_path):
    from chargeload.plans.adapters import events_sessions
    from chargeload.sinks import store

    root = str(tmp_path)
    store.insert_new_sessions(spark, events_sessions(spark, SF), root, order_cols=["source_record_id"])
    text = plan(store.session_lookup(spark, root, "events-12"))
    assert "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,events-12)]" in text


def test_expansion_runs_inside_whole_stage_codegen(spark):
    import re

    df = E.queries()["load_timeseries"](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\*\(\d+\) Generate explode", text)) >= 2     # both explode levels fused
    assert re.search(r"\*\(\d+\) HashAggregate\(keys=\[timestamp#\d+, station_id#\d+\], functions=\[partial_sum", text)
