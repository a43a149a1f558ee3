"""End-to-end jobs: ``ingest`` (D8) and ``analyze``.

Each job is a handful of Spark actions over lazy plans; nothing is collected except
counters and one-row results.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.operators.changepoints import profile_load_timeseries
from chargeload.operators.comparison import load_profiles
from chargeload.operators.metrics import baseline_metrics
from chargeload.operators.policies import DEFAULT_SEED, get_policy, list_policies
from chargeload.operators.profile import load_profile
from chargeload.sinks import store
from chargeload.sources.registry import SessionSource, get_loader


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def ingest(spark: SparkSession, dataset: str, path: str, root: str) -> dict:
    """Load → normalise → validate → insert new sessions → ledger row.

    A missing path, then an unknown dataset, fail before a ledger row exists. Any later
    error records a 'failed' row with the error text and is re-raised. The insert is one
    write job, so a failed run leaves no partial batch behind."""
    if not store.path_exists(spark, path):
        raise FileNotFoundError(f"Source path not found: {path}")
    source = get_loader(dataset)
    row = {"run_id": uuid.uuid4().hex, "source_dataset": dataset, "source_path": path, "started_at": _now(),
           "completed_at": None, "status": "running", "records_seen": 0, "records_inserted": 0,
           "records_invalid": 0, "notes": None}
    return recorded_ingest(spark, source, path, root, row)


def recorded_ingest(spark: SparkSession, source: SessionSource, path: str | list[str], root: str, row: dict, replay_key: str | None = None) -> dict:
    """Run one ingest and write its ledger row, completed or failed (with the whole error text).

    With ``replay_key`` (then part of the run id as well) a replay after a crash writes the same ledger row,
    with the counts that one undisturbed run would have had."""
    stats: dict = {}
    try:
        # ids that carry their dataset (checked on load) can only be stored in that dataset
        datasets = [source.dataset_name] if source.prefixed else None
        row["records_inserted"] = store.insert_new_sessions(spark, source.load(spark, path), root, datasets=datasets,
                                                            stats=stats, replay_key=replay_key)
    except Exception as exc:
        row |= _counted(stats) | {"status": "failed", "notes": str(exc), "completed_at": _now()}
        try:
            store.append_ingest_run(spark, root, row)
        except Exception as ledger:  # noqa: BLE001 - the ingest's own error comes first
            exc.add_note(f"the ledger row could not be written either: {ledger}")
        raise
    row |= _counted(stats) | {"status": "completed", "completed_at": _now()}
    if stats.get("records_surplus"):
        row["notes"] = f"{stats['records_surplus']} records with more cells than their header, kept as invalid"
    return _enter(spark, root, row, replay_key)


def _enter(spark: SparkSession, root: str, row: dict, replay_key: str | None) -> dict:
    store.append_ingest_run(spark, root, row)
    if replay_key:
        store.forget_replay(spark, root, replay_key)
    return row


def _counted(stats: dict) -> dict:
    """What was counted, also by a run that failed after its batch was staged."""
    return {c: stats.get(c, 0) for c in ("records_seen", "records_invalid")}


def _run_rows(kpi: DataFrame, run_id: Column, scenario_name: str, dataset: str, interval_minutes: int, seed: int) -> DataFrame:
    """RUN rows from KPI rows."""
    return kpi.select(
        run_id.alias("run_id"), F.lit(scenario_name).alias("scenario_name"), "policy_name",
        F.lit(dataset).alias("source_dataset"), F.lit(interval_minutes).alias("interval_minutes"),
        F.lit(seed).cast("long").alias("seed"), F.col("sessions_total").alias("sessions_count"),
        "peak_load_kw", "total_energy_kwh", "completion_rate", "average_load_kw", "load_factor",
        "sessions_completed", "targets_total", F.lit(None).cast("string").alias("notes"),
        F.current_timestamp().alias("created_at"))


def analyze(spark: SparkSession, root: str, dataset: str, policy: str = "immediate_charge",
            interval_minutes: int = 5, scenario_name: str = "default", seed: int = DEFAULT_SEED,
            strategy: str = "auto") -> str:
    """Load analysis of one stored dataset; persists LOAD rows and the RUN row.

    The expansion runs once: load rows are written first, and the KPIs then read the
    (small) stored fleet rows instead of expanding the sessions again."""
    get_policy(policy)
    sessions = store.sessions_by_dataset(spark, root, dataset)
    if not sessions.limit(1).collect():
        raise LookupError(f"No sessions found for dataset '{dataset}'")
    profile = load_profile(sessions, policy, interval_minutes, seed)
    run_id = uuid.uuid4().hex
    load = profile_load_timeseries(profile, strategy)
    store.write_load(load.withColumn("run_id", F.lit(run_id)), root)
    fleet = (store.get_load(spark, root, run_id).where(F.col("level") == "fleet")
             .select("timestamp", F.col("load_kw").alias("total_load_kw"),
                     F.col("energy_kwh").alias("total_energy_kwh"), "active_sessions"))
    kpi = baseline_metrics(profile, fleet=fleet)
    run_row = _run_rows(kpi, F.lit(run_id), scenario_name, dataset, interval_minutes, seed)
    store.append_run(spark, root, run_row)
    return run_id


def analyze_policies(spark: SparkSession, root: str, dataset: str, policies: list[str] | None = None,
                     interval_minutes: int = 5, scenario_name: str = "default", seed: int = DEFAULT_SEED) -> dict[str, str]:
    """:func:`analyze` under several policies (all registered ones by default): {policy: run_id}.

    The sessions are expanded once for all of them; every policy gets a RUN row and its LOAD rows."""
    policies = list(policies or list_policies())
    for p in policies:
        get_policy(p)
    sessions = store.sessions_by_dataset(spark, root, dataset)
    if not sessions.limit(1).collect():
        raise LookupError(f"No sessions found for dataset '{dataset}'")
    profiles = load_profiles(sessions, policies, interval_minutes, seed)
    run_ids = {p: uuid.uuid4().hex for p in policies}
    named = F.create_map(*[F.lit(x) for pair in run_ids.items() for x in pair])
    store.write_load(profiles.load_timeseries().withColumn("run_id", named[F.col("policy_name")]), root)
    policy_of = F.create_map(*[F.lit(x) for p, r in run_ids.items() for x in (r, p)])
    fleet = (store.get_loads(spark, root, list(run_ids.values())).where(F.col("level") == "fleet")
             .select(policy_of[F.col("run_id")].alias("policy_name"), F.col("load_kw").alias("total_load_kw")))
    store.append_run(spark, root, _run_rows(profiles.metrics(fleet=fleet), named[F.col("policy_name")], scenario_name, dataset, interval_minutes, seed))
    return run_ids
