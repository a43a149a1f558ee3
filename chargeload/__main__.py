"""Command line for the jobs (run with ``spark-submit -m``-style launchers or plain python):

    python -m chargeload ingest   --dataset acn --path RAW --root STORE
    python -m chargeload policies
    python -m chargeload run      --dataset acn --policy uniform_spread [--interval 5] --root STORE
    python -m chargeload results  --run-id ID --root STORE [--out DIR]

Each command prints one JSON object. ``results`` prints the KPI row only; the curves
are written by Spark to ``--out`` (they are not pulled through the driver).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("chargeload").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _jsonable(row: dict) -> dict:
    return {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in row.items()}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="chargeload")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--dataset", required=True)
    p.add_argument("--path", required=True)
    p.add_argument("--root", required=True)
    sub.add_parser("policies")
    p = sub.add_parser("run")
    p.add_argument("--dataset", required=True)
    p.add_argument("--policy", required=True)
    p.add_argument("--interval", type=int, default=5)
    p.add_argument("--scenario", default="default")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--strategy", default="auto", choices=["auto", "explode", "changepoints"])
    p.add_argument("--root", required=True)
    p = sub.add_parser("results")
    p.add_argument("--run-id", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--out")
    args = ap.parse_args(argv)

    if args.cmd == "policies":
        from chargeload.operators.policies import POLICY_DESCRIPTIONS, list_policies

        print(json.dumps([{"name": n, "description": POLICY_DESCRIPTIONS[n]} for n in list_policies()]))
        return 0

    spark = _session()
    from chargeload.plans.jobs import analyze, ingest
    from chargeload.sinks import store

    if args.cmd == "ingest":
        print(json.dumps(_jsonable(ingest(spark, args.dataset, args.path, args.root))))
    elif args.cmd == "run":
        run_id = analyze(spark, args.root, args.dataset, args.policy, args.interval, args.scenario, args.seed,
                         args.strategy)
        print(json.dumps(_jsonable(store.get_run(spark, args.root, run_id).first().asDict())))
    else:
        kpi, fleet, stations = store.run_results(spark, args.root, args.run_id)
        out = _jsonable(kpi.first().asDict())
        if args.out:
            fleet.write.mode("overwrite").option("header", True).csv(f"{args.out}/fleet_load_curve")
            stations.write.mode("overwrite").option("header", True).csv(f"{args.out}/station_load_curves")
            out["curves"] = args.out
        print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
