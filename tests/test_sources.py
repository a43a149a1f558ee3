"""Readers, normalisers, registry, store and ingest on small hand-written files."""

import datetime as dt
import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from chargeload.operators.quality import errors_text
from chargeload.plans.jobs import ingest
from chargeload.sinks import store
from chargeload.sources.csv_sessions import normalize_csv_sessions
from chargeload.sources.readers import read_csv_records, read_json_records, sniff_json_layouts
from chargeload.sources.registry import SessionSource, get_loader, list_loaders, register_loader
from chargeload.streaming.ingest_stream import ingest_stream

D = dt.datetime
ORDER = ["_file", "_block", "_row"]


def record(rid, start, end, zone="Europe/Berlin", **more):
    """One JSON session: local times (month-day hour:minute of 2022) in its zone."""
    out = {"_id": rid, "connectionTime": f"2022-{start}", "disconnectTime": f"2022-{end}", "timezone": zone}
    return {k: v for k, v in (out | more).items() if v != "absent"}


#: Winter and summer time, an hour that does not exist, one that comes twice, a session over midnight in another zone.
RECORDS = [
    record("night", "01-14T23:30:00", "01-15T06:45:00", kWhDelivered=44.0, kWhRequested=44, userID="amber", stationID="K7", spaceID="left", doneChargingTime="2022-01-15T04:00:00"),
    record("gap", "03-27T01:30:00", "03-27T03:30:00", kWhDelivered="12.75", maxRate=22, stationID="K7"),
    record("twice", "10-30T02:15:00", "10-30T04:15:00", kWhDelivered=0, kWhRequested=None, stationID="K8"),
    record("india", "06-30T23:00:00", "07-01T00:30:00", zone="Asia/Kolkata", userID=81, kWhDelivered=-0.5),
    record("turned", "05-02T12:00:00", "05-02T09:00:00", maxRate=-3),
    record("open", "05-03T12:00:00", "absent", doneChargingTime=None),
    record("never", "absent", "absent", kWhDelivered="n/a"),
]

CSV_TEXT = """Address,Port_Number,Total_kWh,Charging_Time__hh_mm_ss_,End_Date___Time,Start_Date___Time,Station_Name
Quay 3,L,7.04,0:55:12,2022-02-11 18:20:05,2022-02-11 17:00:00,Harbour
Quay 3,R,,1:05,14/02/2022 00:10,13/02/2022 22:40,Harbour
Hill 9,L,31.5,12:00:00,2/14/2022 6:30:00 PM,2/14/2022 5:15:00 AM,Summit
Hill 9,,3,x,2022-02-15 09:00:00,2022-02-15 09:00:00,
Hill 9,L,-2,0:10:00,,2022-02-16 08:00:00,Summit
Hill 9,R,1e1,0:00:30,2022-02-17T10:00:00+03:00,2022-02-17T06:30:00Z,Summit
"""
CSV_ROWS = 6


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def lines(records):
    return "\n".join(json.dumps(r) for r in records)


def ids(df):
    return [json.loads(r["record"].toJson()).get("_id") for r in df.orderBy(*ORDER).collect()]


def test_json_array_and_lines_read_the_same_records(spark, folder):
    a = write(folder, "a.json", json.dumps(RECORDS, indent=3))
    b = write(folder, "b.json", "\n" + lines(RECORDS) + "\n  \n")
    assert set(sniff_json_layouts(spark, a).values()) == {"array"} and set(sniff_json_layouts(spark, b).values()) == {"lines"}
    for path in (a, b):
        assert ids(read_json_records(spark, path)) == [r["_id"] for r in RECORDS]


def test_json_folder_of_both_layouts(spark, folder):
    write(folder, "mix/1.json", json.dumps(RECORDS[:2]))
    write(folder, "mix/2.json", lines(RECORDS[2:5]))
    write(folder, "mix/3.json", "\ufeff  [" + json.dumps(RECORDS[5]) + "]")
    with gzip.open(os.path.join(folder, "mix/4.json.gz"), "wt") as f:
        f.write(lines(RECORDS[6:]))
    write(folder, "mix/5.json", "")
    mix = os.path.join(folder, "mix")
    assert ids(read_json_records(spark, mix)) == [r["_id"] for r in RECORDS]
    row = ingest(spark, "acn", mix, os.path.join(folder, "store"))
    assert (row["records_seen"], row["records_inserted"]) == (len(RECORDS), len(RECORDS))


@pytest.mark.parametrize("name,text", [("lines", '{"_id": "a"}\n17\n'), ("lines", '{"_id": "a"}\n[1, 2]\n'), ("array", '[{"_id": "a"}, "b"]'), ("lines", '{"_id": "a"}\n{broken')])
def test_json_records_that_are_no_objects(spark, folder, name, text):
    path = write(folder, f"{name}.json", text)
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error class differs by fault
        read_json_records(spark, path).collect()
    assert ids(read_json_records(spark, path, on_malformed="skip")) == ["a"]


def test_json_document_that_is_no_array(spark, folder):
    path = write(folder, "object.json", json.dumps(RECORDS[0], indent=1))
    with pytest.raises(Exception, match="not an array"):
        read_json_records(spark, path, layout="array").collect()
    assert read_json_records(spark, path, layout="array", on_malformed="skip").count() == 0


def test_json_normalisation(spark, folder):
    path = write(folder, "s.json", json.dumps(RECORDS))
    df = get_loader("acn").load(spark, path).orderBy(*ORDER)
    r = {x["source_record_id"]: x for x in df.withColumn("e", errors_text()).collect()}
    assert [x["session_id"] for x in r.values()] == [f"acn-{x['_id']}" for x in RECORDS]
    assert (r["night"]["arrival_ts"], r["night"]["departure_ts"]) == (D(2022, 1, 14, 22, 30), D(2022, 1, 15, 5, 45))
    assert (r["night"]["session_duration_minutes"], r["night"]["charging_duration_minutes"]) == (435, 270)
    assert (r["gap"]["arrival_ts"], r["gap"]["session_duration_minutes"]) == (D(2022, 3, 27, 0, 30), 60)
    assert r["twice"]["session_duration_minutes"] == 180          # the first of the two hours
    assert r["india"]["departure_ts"] == D(2022, 6, 30, 19, 0)
    assert (r["gap"]["energy_delivered_kwh"], r["gap"]["max_charge_rate_kw"], r["night"]["energy_requested_kwh"]) == (12.75, 22.0, 44.0)
    assert (r["twice"]["energy_requested_kwh"], r["never"]["energy_delivered_kwh"]) == (None, None)
    assert (r["india"]["vehicle_id"], r["night"]["port_id"], r["gap"]["vehicle_id"]) == ("81", "left", None)
    assert [k for k, x in r.items() if x["is_valid"]] == ["night", "gap", "twice"]
    assert r["india"]["e"] == "energy_delivered_kwh:must be non-negative"
    assert r["turned"]["e"] == "departure_ts:departure must be after arrival|session_duration_minutes:must be positive|max_charge_rate_kw:must be non-negative"
    assert r["never"]["e"] == "arrival_ts:missing required timestamp|departure_ts:missing required timestamp|session_duration_minutes:must be positive"
    assert all(json.loads(r[x["_id"]]["raw_payload"]) == x for x in RECORDS)


def test_json_id_and_zone_edge_cases(spark, folder):
    t = "2022-07-09T16:00:00"
    recs = [{"connectionTime": t}, {"_id": None, "connectionTime": t, "timezone": None}, {"_id": 3.5, "connectionTime": t, "timezone": ""},
            {"_id": "n", "connectionTime": t, "timezone": "Atlantis/East"}, {"_id": "o", "connectionTime": t + "-05:00", "timezone": "Atlantis/East"}]
    rows = get_loader("acn").load(spark, write(folder, "e.json", lines(recs))).orderBy(*ORDER).collect()
    assert [r["session_id"] for r in rows] == ["acn-", "acn-None", "acn-3.5", "acn-n", "acn-o"]
    # no zone key: Pacific time; null or empty: UTC; unknown: no time; an offset in the text wins
    assert [r["arrival_ts"] for r in rows] == [D(2022, 7, 9, 23), D(2022, 7, 9, 16), D(2022, 7, 9, 16), None, D(2022, 7, 9, 21)]


def test_csv_normalisation(spark, folder):
    df = get_loader("urbanev").load(spark, write(folder, "u.csv", CSV_TEXT)).orderBy("_row")
    rows = df.withColumn("e", errors_text()).collect()
    assert [r["session_id"] for r in rows] == [f"urbanev-{i}" for i in range(CSV_ROWS)]
    assert [r["station_id"] for r in rows] == ["Harbour", "Harbour", "Summit", None, "Summit", "Summit"]
    assert [r["port_id"] for r in rows] == ["L", "R", "L", None, "L", "R"]
    assert [r["session_duration_minutes"] for r in rows] == [80, 90, 795, 0, 0, 30]
    assert [r["charging_duration_minutes"] for r in rows] == [56, 65, 720, None, 10, 1]
    assert [r["energy_delivered_kwh"] for r in rows] == [7.04, None, 31.5, 3.0, -2.0, 10.0]
    assert rows[1]["arrival_ts"] == D(2022, 2, 13, 22, 40) and rows[5]["departure_ts"] == D(2022, 2, 17, 7)
    assert [r["is_valid"] for r in rows] == [True, True, True, False, False, True]
    assert rows[4]["e"] == "departure_ts:missing required timestamp|session_duration_minutes:must be positive|energy_delivered_kwh:must be non-negative"
    assert json.loads(rows[2]["raw_payload"])["Address"] == "Hill 9"


def test_csv_folder_with_several_headers(spark, folder):
    write(folder, "c/1.csv", CSV_TEXT)
    head, *body = [x.split(",") for x in CSV_TEXT.splitlines()]
    write(folder, "c/2.csv", "\n".join(",".join(reversed(x)) for x in [head, *body]))
    write(folder, "c/3.csv", "EVSE_ID,Start,End,Port\nE-5,2022-02-11 17:00:00,2022-02-11 17:30:00,9\n")
    write(folder, "c/4.csv", "")
    root, c = os.path.join(folder, "store"), os.path.join(folder, "c")
    row = ingest(spark, "urbanev", c, root)
    assert (row["records_seen"], row["records_inserted"]) == (2 * CSV_ROWS + 1,) * 2
    rows = store.read_sessions(spark, root, "urbanev").collect()
    by_file = {}
    for r in rows:
        digest, number = r["source_record_id"].split("-")
        by_file.setdefault(digest, {})[int(number)] = (r["station_id"], r["port_id"], r["arrival_ts"], r["energy_delivered_kwh"])
    files = {r["_file"] for r in read_csv_records(spark, c).select("_file").collect()}
    assert {f.rsplit("/", 1)[1] for f in files} == {"1.csv", "2.csv", "3.csv"}
    assert set(by_file) == {hashlib.md5(f.encode()).hexdigest() for f in files}       # the whole digest
    assert sorted(map(len, by_file.values())) == [1, CSV_ROWS, CSV_ROWS]
    same = [x for x in by_file.values() if len(x) == CSV_ROWS]
    assert same[0] == same[1]
    assert next(x for x in by_file.values() if len(x) == 1)[0] == ("E-5", "9", D(2022, 2, 11, 17), None)


def test_csv_row_numbers_as_ids_need_one_file(spark, folder):
    write(folder, "c/1.csv", CSV_TEXT)
    write(folder, "c/2.csv", CSV_TEXT)
    with pytest.raises(Exception, match="one file"):
        normalize_csv_sessions(read_csv_records(spark, os.path.join(folder, "c")), id_scope="dataset").collect()


def test_csv_columns_by_name_in_one_frame(spark, folder):
    write(folder, "c/1.csv", "Station_Name,Start\nA,2022-02-11 17:00:00\n")
    write(folder, "c/2.csv", "Start,Station_Name\n2022-02-11 18:00:00,B\n")
    rows = read_csv_records(spark, os.path.join(folder, "c")).orderBy("Station_Name").collect()
    assert [(r["Station_Name"], r["Start"]) for r in rows] == [("A", "2022-02-11 17:00:00"), ("B", "2022-02-11 18:00:00")]


def test_row_ordinal_across_many_splits(spark, folder):
    text = "id,pad\n" + "".join(f"{i},{'y' * (20 + i % 41)}\n" for i in range(2500))
    path = write(folder, "big.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_csv_records(spark, path)
        assert df.rdd.getNumPartitions() > 5
        bad = df.where(F.col("id").cast("long") != F.col("_row")).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert bad == 0 and df.count() == 2500


def test_json_order_across_many_splits(spark, folder):
    path = write(folder, "big.json", lines({"_id": str(i), "pad": "z" * (i % 53)} for i in range(2500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_json_records(spark, path)
        assert df.rdd.getNumPartitions() > 5
        got = ids(df)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [str(i) for i in range(2500)]


def test_registry(spark):
    assert list_loaders()[:2] == ["acn", "urbanev"]
    with pytest.raises(ValueError, match="Unknown dataset 'nope'. Available: acn"):
        get_loader("nope")


def test_ingest_counters_and_idempotence(spark, folder):
    root = os.path.join(folder, "store")
    jpath, cpath = write(folder, "s.json", json.dumps(RECORDS)), write(folder, "u.csv", CSV_TEXT)
    rows = [ingest(spark, d, p, root) for d, p in (("acn", jpath), ("acn", jpath), ("urbanev", cpath), ("urbanev", cpath))]
    assert [(r["records_seen"], r["records_inserted"], r["records_invalid"]) for r in rows] == [(7, 7, 4), (7, 0, 4), (6, 6, 2), (6, 0, 2)]
    counts = {r["source_dataset"]: r["sessions"] for r in store.count_by_source(spark, root).collect()}
    assert counts == {"acn": 7, "urbanev": 6}
    ledger = store.read_ingest_runs(spark, root).orderBy("started_at").collect()
    assert [(r["records_inserted"], r["status"]) for r in ledger] == [(n, "completed") for n in (7, 0, 6, 0)]
    assert not os.path.exists(os.path.join(root, "_staging")) or not os.listdir(os.path.join(root, "_staging"))


def test_ingest_errors(spark, folder):
    root = os.path.join(folder, "store")
    with pytest.raises(ValueError, match="Unknown dataset"):
        ingest(spark, "nope", folder, root)
    for dataset in ("acn", "nope"):         # the path is checked first
        with pytest.raises(FileNotFoundError, match="not found"):
            ingest(spark, dataset, os.path.join(folder, "missing.json"), root)
    assert store.read_ingest_runs(spark, root).count() == 0


def test_first_writer_wins_inside_a_batch(spark, folder):
    twins = [record("t", "04-01T10:00:00", "04-01T11:00:00", stationID=s) for s in ("earlier", "later", "last")]
    root = os.path.join(folder, "store")
    r = ingest(spark, "acn", write(folder, "d.json", lines(twins)), root)
    assert (r["records_seen"], r["records_inserted"]) == (3, 1)
    assert store.session_lookup(spark, root, "acn-t").first()["station_id"] == "earlier"


def test_stream_ingest_remembers_its_files(spark, folder):
    src, root = os.path.join(folder, "in"), os.path.join(folder, "store")
    write(src, "a.json", json.dumps(RECORDS[:3]))
    write(src, "b.json", lines(RECORDS[3:5]))
    runs = ingest_stream(spark, "acn", src, root)
    assert sum(r["records_inserted"] for r in runs) == 5
    assert ingest_stream(spark, "acn", src, root) == []             # its checkpoint lies with the store
    write(src, "c.json", lines(RECORDS))
    runs = ingest_stream(spark, "acn", src, root, max_files_per_trigger=1)
    assert [(r["records_seen"], r["records_inserted"], r["status"]) for r in runs] == [(7, 2, "completed")]
    assert store.count_by_source(spark, root).first()["sessions"] == 7


def test_stream_ingest_of_csv_with_several_headers(spark, folder):
    src, root = os.path.join(folder, "in"), os.path.join(folder, "store")
    write(src, "a.csv", CSV_TEXT)
    write(src, "b.csv", "EVSE_ID,Start,End\nE-5,2022-02-11 17:00:00,2022-02-11 17:30:00\n")
    runs = ingest_stream(spark, "urbanev", src, root, checkpoint=os.path.join(folder, "ck"))
    assert (sum(r["records_seen"] for r in runs), sum(r["records_inserted"] for r in runs)) == (CSV_ROWS + 1,) * 2
    write(src, "c.csv", CSV_TEXT)
    assert [r["records_inserted"] for r in ingest_stream(spark, "urbanev", src, root, checkpoint=os.path.join(folder, "ck"))] == [CSV_ROWS]
    # a batch over the whole folder gives the same ids
    assert ingest(spark, "urbanev", src, root)["records_inserted"] == 0


def test_malformed_json_fails_the_run_and_is_recorded(spark, folder):
    root = os.path.join(folder, "store")
    path = write(folder, "bad.json", json.dumps(RECORDS[0]) + "\n{'quotes': wrong}\n")
    with pytest.raises(Exception) as error:  # noqa: PT011
        ingest(spark, "acn", path, root)
    (run,) = store.read_ingest_runs(spark, root).collect()
    assert run["status"] == "failed" and run["notes"] == str(error.value)       # the whole text
    assert store.count_by_source(spark, root).count() == 0          # nothing half-written


def test_an_error_of_the_ledger_does_not_hide_the_ingests_own(spark, folder, monkeypatch):
    def broken(*_):
        raise OSError("ledger folder is read-only")

    monkeypatch.setattr(store, "append_ingest_run", broken)
    with pytest.raises(Exception, match="(?i)json") as error:  # noqa: PT011
        ingest(spark, "acn", write(folder, "bad.json", "{no\n"), os.path.join(folder, "store"))
    assert any("read-only" in n for n in error.value.__notes__)


def test_loader_contract_is_checked(spark, folder):
    register_loader(SessionSource("broken", lambda s, p: s.read.text(p), lambda df: df.select("value")))
    with pytest.raises(ValueError, match="lack required columns"):
        get_loader("broken").load(spark, write(folder, "x.txt", "hello\n"))


def _other(name, prefixed, prefix):
    acn = get_loader("acn")
    return SessionSource(name, acn.read, lambda df: acn.normalize(df).withColumns(
        {"source_dataset": F.lit(name), "session_id": F.concat(F.lit(prefix), "source_record_id")}), prefixed=prefixed)


def test_ids_are_unique_across_sources(spark, folder):
    root, path = os.path.join(folder, "store"), write(folder, "s.json", json.dumps(RECORDS))
    for name in ("first", "second"):
        register_loader(_other(name, False, "shared-"))
    assert [ingest(spark, n, path, root)["records_inserted"] for n in ("first", "second", "second")] == [7, 0, 0]


def test_a_prefixed_source_must_prefix_its_ids(spark, folder):
    register_loader(_other("claims", True, "other-"))
    with pytest.raises(Exception, match="without its dataset prefix"):
        ingest(spark, "claims", write(folder, "s.json", json.dumps(RECORDS)), os.path.join(folder, "store"))


def test_store_reads(spark, folder):
    root = os.path.join(folder, "store")
    ingest(spark, "acn", write(folder, "s.json", json.dumps(RECORDS)), root)
    assert store.read_sessions(spark, root, "acn", ["session_id"]).columns == ["session_id"]
    assert store.read_sessions(spark, root, "nope").count() == 0
    order = [f"acn-{x}" for x in ("night", "gap", "turned", "open", "india", "twice", "never")]       # by arrival, without one last
    assert [r["session_id"] for r in store.page_by_source(spark, root, "acn", limit=3, offset=2).collect()] == order[2:5]
    seen, after = [], None
    while page := store.page_after(spark, root, "acn", 2, after).collect():
        seen += [r["session_id"] for r in page]
        after = page[-1]["arrival_ts"], page[-1]["session_id"]
    assert seen == order
    assert store.sessions_by_dataset(spark, root, "acn").columns[-1] == "is_valid"
    assert store.session_lookup(spark, root, "acn-zzz").count() == 0
    assert store.session_lookup(spark, root, "acn-gap", "acn").count() == 1
    empty_root = os.path.join(folder, "empty")
    assert store.read_sessions(spark, empty_root).count() == 0
    assert store.read_ingest_runs(spark, empty_root).count() == 0


def test_lookup_reaches_the_scan(spark, folder):
    root = os.path.join(folder, "store")
    ingest(spark, "acn", write(folder, "s.json", json.dumps(RECORDS)), root)
    plan = store.session_lookup(spark, root, "acn-gap", "acn")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,acn-gap)" in plan and "PartitionFilters: [isnotnull(source_dataset" in plan


def test_command_line(spark, folder, capsys):
    from chargeload.__main__ import main

    root = os.path.join(folder, "store")
    path = write(folder, "s.json", json.dumps(RECORDS))
    assert main(["policies"]) == 0
    assert "uniform_spread" in capsys.readouterr().out
    main(["ingest", "--dataset", "acn", "--path", path, "--root", root])
    assert json.loads(capsys.readouterr().out)["records_inserted"] == 7
    main(["run", "--dataset", "acn", "--policy", "immediate_charge", "--interval", "15", "--root", root])
    run = json.loads(capsys.readouterr().out)
    assert run["sessions_count"] == 3 and run["policy_name"] == "immediate_charge"
    out = os.path.join(folder, "out")
    main(["results", "--run-id", run["run_id"], "--root", root, "--out", out])
    assert json.loads(capsys.readouterr().out)["run_id"] == run["run_id"]
    assert spark.read.option("header", True).csv(f"{out}/fleet_load_curve").count() > 0


@pytest.mark.parametrize("dataset,name,text", [("acn", "e.json", ""), ("acn", "b.json", "\n\t\n  \n"), ("acn", "a.json", " [ ]"), ("urbanev", "h.csv", CSV_TEXT.splitlines()[0] + "\n")])
def test_empty_inputs_ingest_nothing(spark, folder, dataset, name, text):
    r = ingest(spark, dataset, write(folder, name, text), os.path.join(folder, "store"))
    assert (r["records_seen"], r["records_inserted"], r["status"]) == (0, 0, "completed")


def test_byte_order_marks(spark, folder):
    rows = get_loader("urbanev").load(spark, write(folder, "bom.csv", "\ufeffStation_Name,Start\nPier,2022-02-11 17:00:00\n")).collect()
    assert [r["station_id"] for r in rows] == ["Pier"]
    assert ids(read_json_records(spark, write(folder, "bom.json", "\ufeff" + lines(RECORDS)))) == [r["_id"] for r in RECORDS]


def test_created_at_and_dedupe_on_read(spark, folder):
    root = os.path.join(folder, "store")
    ingest(spark, "acn", write(folder, "s.json", json.dumps(RECORDS)), root)
    rows = store.read_sessions(spark, root, "acn", ["session_id", "created_at", "updated_at"]).collect()
    assert all(r["created_at"] is not None and r["created_at"] == r["updated_at"] for r in rows)
    # a second, unguarded writer appends a known id later
    dup = (store.read_sessions(spark, root, "acn").where("session_id = 'acn-gap'")
           .withColumns({"station_id": F.lit("K9"), "created_at": F.current_timestamp() + F.expr("INTERVAL 2 HOURS")})
           .withColumn("updated_at", F.col("created_at")))
    dup.write.mode("append").partitionBy("source_dataset").parquet(os.path.join(root, "sessions"))
    assert store.read_sessions(spark, root, "acn").count() == 8
    kept = store.read_sessions(spark, root, "acn", dedupe=True)
    assert kept.count() == 7
    assert kept.where("session_id = 'acn-gap'").first()["station_id"] == "K7"


def test_csv_quoted_line_breaks(spark, folder):
    path = write(folder, "ml.csv", CSV_TEXT.replace("Quay 3", '"Quay 3\nsecond gate"'))
    recs = read_csv_records(spark, path, multi_line=True).orderBy("_row").collect()
    assert [r["_row"] for r in recs] == list(range(CSV_ROWS))
    assert recs[0]["Address"] == "Quay 3\nsecond gate" and recs[5]["Station_Name"] == "Summit"
