"""No cell, header, line break or second writer may stop or tear an ingest."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from chargeload.operators.quality import errors_text
from chargeload.plans.jobs import ingest
from chargeload.sinks import guard, store
from chargeload.sources.csv_lines import distinct_names, read_csv_cells
from chargeload.sources.readers import read_csv_records, read_json_records
from chargeload.sources.registry import get_loader

HEAD = "Station_Name,Start,End,Total_kWh,charging_time"


def write(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def load(spark, path, dataset="urbanev"):
    df = get_loader(dataset).load(spark, path)
    return {r["session_id"].split("-", 1)[1]: r for r in df.withColumn("e", errors_text()).collect()}


def test_values_beyond_an_integer_are_errors_of_their_row(spark, tmp_path):
    path = write(tmp_path, "x.csv", f"{HEAD}\nA,2022-01-01 10:00:00,9999-12-31 00:00:00,1,1:00\nB,2022-01-01 10:00:00,2022-01-01 11:00:00,1,40000000:00:00\n"
                 "C,2022-01-01 10:00:00,2022-01-01 11:00:00,1,99999999999999999999:00\nD,2022-01-01 10:00:00,2022-01-01 11:00:00,1,0:45:01\n")
    r = load(spark, path)
    assert r["0"]["e"] == "session_duration_minutes:must be positive|session_duration_minutes:out of range"
    assert (r["0"]["session_duration_minutes"], r["1"]["charging_duration_minutes"]) == (0, None)
    assert r["1"]["e"] == "charging_duration_minutes:out of range"
    assert (r["2"]["charging_duration_minutes"], r["2"]["is_valid"]) == (None, True)       # no number at all: as any text
    assert (r["3"]["charging_duration_minutes"], r["3"]["is_valid"]) == (46, True)
    row = ingest(spark, "urbanev", path, str(tmp_path / "store"))
    assert (row["status"], row["records_seen"], row["records_inserted"], row["records_invalid"]) == ("completed", 4, 4, 2)


def test_json_values_beyond_an_integer(spark, tmp_path):
    recs = [{"_id": "far", "connectionTime": "2022-01-01T10:00:00", "disconnectTime": "2022-01-01T11:00:00", "doneChargingTime": "9999-01-01T00:00:00"}]
    r = load(spark, write(tmp_path, "x.json", json.dumps(recs)), "acn")
    assert (r["far"]["charging_duration_minutes"], r["far"]["e"]) == (None, "charging_duration_minutes:out of range")


def test_quoted_line_breaks_need_no_option(spark, tmp_path):
    rows = [f'"Pier\nnorth ""{i}""",2022-01-01 10:00:00,2022-01-01 11:00:00,{i},0:30:00' for i in range(5)]
    write(tmp_path, "in/a.csv", "\n".join([HEAD, *rows]) + "\n")
    write(tmp_path, "in/b.csv", f"{HEAD}\nplain,2022-01-01 10:00:00,2022-01-01 11:00:00,7,0:30:00\n")
    r = load(spark, str(tmp_path / "in"))
    assert sorted(x["station_id"] for x in r.values()) == [f'Pier\nnorth "{i}"' for i in range(5)] + ["plain"]
    assert all(x["is_valid"] for x in r.values()) and sorted(k.split("-")[1] for k in r) == ["0", "0", "1", "2", "3", "4"]
    row = ingest(spark, "urbanev", str(tmp_path / "in"), str(tmp_path / "store"))
    assert (row["records_seen"], row["records_invalid"]) == (6, 0)


def test_a_header_over_several_lines(spark, tmp_path):
    path = write(tmp_path, "a.csv", '"Station_Name","Note\nof the day",Start\nA,"x\ny",2022-01-01 10:00:00\n')
    (r,) = read_csv_records(spark, path).collect()
    assert (r["Station_Name"], r["Note\nof the day"], r["Start"], r["_row"]) == ("A", "x\ny", "2022-01-01 10:00:00", 0)


def test_inch_marks_and_backslashes_are_plain_text(spark, tmp_path):
    path = write(tmp_path, "a.csv", f'{HEAD}\n5" post,2022-01-01 10:00:00,2022-01-01 11:00:00,1,\n"C:\\",2022-01-01 10:00:00,2022-01-01 11:00:00,2,\nplain,2022-01-01 10:00:00,2022-01-01 11:00:00,3,\n')
    r = load(spark, path)
    assert [r[str(i)]["station_id"] for i in range(3)] == ['5" post', "C:\\", "plain"]


def test_surplus_cells_are_kept_and_noted(spark, tmp_path):
    path = write(tmp_path, "a.csv", f'{HEAD}\nA,2022-01-01 10:00:00,2022-01-01 11:00:00,1,0:30:00,more\nB,2022-01-01 10:00:00,2022-01-01 11:00:00,1,0:30:00,,\n'
                 '"C, x",2022-01-01 10:00:00,2022-01-01 11:00:00,1,"0:30:00"\nD,2022-01-01 10:00:00\n')
    r = load(spark, path)
    assert [r[str(i)]["e"] for i in range(3)] == ["raw_payload:more cells than the header", "", ""]
    assert json.loads(r["0"]["raw_payload"])["_record"].endswith(",more") and "_record" not in json.loads(r["1"]["raw_payload"])
    assert r["3"]["e"].startswith("departure_ts:missing")       # a short record is padded
    root = str(tmp_path / "store")
    row = ingest(spark, "urbanev", path, root)
    assert (row["status"], row["records_invalid"]) == ("completed", 2)
    assert store.read_ingest_runs(spark, root).first()["notes"] == "1 records with more cells than their header, kept as invalid"


@pytest.mark.parametrize("head", ["Start,start,End,EVSE_ID", "Start,Start,End,EVSE_ID", "start,Start,End,EVSE_ID", "Start,end,End,EVSE_ID"])
def test_headers_are_taken_by_exact_name_and_place(spark, tmp_path, head):
    cells = {"Start": "2022-01-01 10:00:00", "End": "2022-01-01 11:00:00", "EVSE_ID": "E"}
    names = distinct_names(head.split(","))
    path = write(tmp_path, "a.csv", f"{head}\n" + ",".join(cells.get(n, "no date") for n in names) + "\n")
    r = load(spark, path)["0"]
    assert r["is_valid"] and r["session_duration_minutes"] == 60 and r["station_id"] == "E"
    assert list(json.loads(r["raw_payload"])) == names
    assert read_csv_records(spark, path).count() == 1


def test_many_headers_take_one_pass_over_the_blocks(spark, tmp_path):
    for i in range(6):
        write(tmp_path, f"in/{i}.csv", f"Start,End,EVSE_ID,extra{i}\n2022-01-01 10:00:00,2022-01-01 11:00:00,E{i},z\n")
    df = read_csv_cells(spark, str(tmp_path / "in"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan text") == 1 and "SortMergeJoin" not in text       # one scan of the lines, whatever the number of headers
    assert sorted(r["_cells"][2] for r in df.collect()) == [f"E{i}" for i in range(6)]


def test_the_driver_opens_no_file(spark, tmp_path, monkeypatch):
    import chargeload.sources.files as files

    assert not hasattr(files, "first_lines") and not hasattr(files, "_each")
    monkeypatch.setattr(files, "LARGEST_ARRAY", 40)       # larger files can hold lines only, and are not looked at
    path = write(tmp_path, "a.json", "\n".join(json.dumps({"_id": str(i)}) for i in range(9)))
    assert files.sniff_json_layouts(spark, path) == {} and read_json_records(spark, path).count() == 9


# --- the store ------------------------------------------------------------------------------------

def sessions(spark, names, dataset="one"):
    rows = [(f"id-{n}", dataset, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "session_id string, source_dataset string, _row long")
    from chargeload.schemas import SESSION

    for f in SESSION.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.withColumns({"is_valid": F.lit(True), "session_duration_minutes": F.lit(1), "validation_errors": F.expr("filter(array(named_struct('field', '', 'error', '')), x -> false)")})


def test_two_writers_leave_one_row_of_an_id(spark, tmp_path):
    root, got, errors = str(tmp_path), [], []

    def work(name):
        try:
            got.append(store.insert_new_sessions(spark, sessions(spark, range(60), name), root, order_cols=["_row"]))
        except Exception as exc:  # noqa: BLE001
            errors.append(exc)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("one", "two", "three")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(got) == [0, 0, 60]
    stored = store.read_sessions(spark, root)
    assert (stored.count(), stored.select("session_id").distinct().count()) == (60, 60)
    assert not os.path.exists(os.path.join(root, "_writer.lock"))


def test_a_live_lock_is_waited_for_and_a_dead_one_taken_over(spark, tmp_path):
    root = str(tmp_path)
    lock = os.path.join(root, "_writer.lock")
    with guard.writing(spark, root):
        with pytest.raises(TimeoutError, match="another writer"):
            with guard.writing(spark, root, wait=0.3):
                pass
    open(lock, "w").close()
    os.utime(lock, (time.time() - 1000,) * 2)       # its driver has not renewed it for long
    with guard.writing(spark, root, stale_after=300):
        assert time.time() - os.path.getmtime(lock) < 100
    assert not os.path.exists(lock)


def test_a_crash_between_rows_and_index_is_mended(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    append = store._append_ids

    def crash(*_):
        raise RuntimeError("driver lost")

    store.insert_new_sessions(spark, sessions(spark, range(5)), root, order_cols=["_row"])
    monkeypatch.setattr(store, "_append_ids", crash)
    with pytest.raises(RuntimeError, match="driver lost"):
        store.insert_new_sessions(spark, sessions(spark, range(3, 9)), root, order_cols=["_row"])
    monkeypatch.setattr(store, "_append_ids", append)
    assert store.insert_new_sessions(spark, sessions(spark, range(12)), root, order_cols=["_row"]) == 3
    stored = store.read_sessions(spark, root)
    assert (stored.count(), stored.select("session_id").distinct().count(), store.stored_ids(spark, root).count()) == (12, 12, 12)
    assert os.listdir(os.path.join(root, "_staging")) == []


def test_a_store_without_index_gets_one(spark, tmp_path):
    root = str(tmp_path)
    now = F.current_timestamp()
    (sessions(spark, range(4)).drop("_row").withColumns({"created_at": now, "updated_at": now})
     .write.partitionBy("source_dataset").parquet(os.path.join(root, "sessions")))
    assert store.insert_new_sessions(spark, sessions(spark, range(6)), root, order_cols=["_row"]) == 2
    assert store.stored_ids(spark, root).count() == 6


def test_insert_and_lookup_open_the_buckets_of_their_ids(spark, tmp_path):
    root = str(tmp_path)
    store.insert_new_sessions(spark, sessions(spark, range(500)), root, order_cols=["_row"])
    assert len([d for d in os.listdir(os.path.join(root, "session_ids")) if d.startswith("bucket=")]) == store.ID_BUCKETS
    one = store.stored_ids(spark, root, [7])
    assert 0 < len(one.inputFiles()) <= store.ID_BUCKETS
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "= 7)], PushedFilters: []" in plan       # a partition filter, not one on rows
    assert one.count() == sum(r[0] == 7 for r in sessions(spark, range(500)).select(store.id_bucket(F.col("session_id"))).collect())
    found = store.session_lookup(spark, root, "id-42")
    assert found.count() == 1 and "source_dataset" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:80]
    assert store.session_lookup(spark, root, "nobody").count() == 0


def test_the_first_row_of_an_id_is_chosen_on_narrow_columns(spark, tmp_path, monkeypatch):
    import pyspark.sql.readwriter as rw

    seen, real = [], rw.DataFrameWriter.parquet

    def spy(self, path, *a, **k):
        if path.endswith("/first"):
            seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **k)

    monkeypatch.setattr(rw.DataFrameWriter, "parquet", spy)
    twins = sessions(spark, range(50)).unionByName(sessions(spark, range(50)).withColumns({"_row": F.col("_row") - 100, "station_id": F.lit("first")}))
    assert store.insert_new_sessions(spark, twins, str(tmp_path), order_cols=["_row"]) == 50
    assert {r["station_id"] for r in store.read_sessions(spark, str(tmp_path)).collect()} == {"first"}
    schema = seen[0].split("ReadSchema:")[1]
    assert "session_id" in schema and "raw_payload" not in schema and "validation_errors" not in schema


def test_counters_of_a_run_that_fails_after_staging(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    path = write(tmp_path, "x.csv", f"{HEAD}\nA,2022-01-01 10:00:00,2022-01-01 09:00:00,1,1:00\n")

    def crash(*_):
        raise RuntimeError("no index")

    monkeypatch.setattr(store, "_append_ids", crash)
    with pytest.raises(RuntimeError):
        ingest(spark, "urbanev", path, root)
    (run,) = store.read_ingest_runs(spark, root).collect()
    assert (run["status"], run["records_seen"], run["records_invalid"]) == ("failed", 1, 1)
