"""Parquet stores: sessions (A7, A8, B9, E11, H2), ingest ledger (A9), runs and loads
(A10–A12, B10, B11).

Layout (all under one root the caller chooses, typically a shared folder):

* ``sessions/``  SESSION rows, partitioned by ``source_dataset``; ``session_id`` unique
* ``session_ids/`` (session_id, source_dataset), partitioned by ``bucket``, a hash of the id:
  an insert reads the buckets its ids fall into, a lookup opens one
* ``ingest_runs/`` one INGEST_RUN row per finished ingest; older ones by date in
  ``ingest_runs_archive/`` (:func:`compact_ingest_runs`)
* ``runs/``      one RUN row per analysis
* ``loads/``     LOAD rows, partitioned by ``run_id``

Any number of ingests may run at once: each stages its batch on its own, and holds the store's
write lock (see ``guard``) only while it compares ids and appends. ``dedupe=True`` on a read is
for rows that something else than :func:`insert_new_sessions` appended.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chargeload.operators.quality import SURPLUS_CELLS
from chargeload.schemas import ANALYSIS_COLUMNS, INGEST_RUN, LOAD, RUN, SESSION_COLUMNS, STORED_SESSION
from chargeload.sinks.guard import writing

#: Buckets of the id index: folders of about equal size, whatever the ids look like.
ID_BUCKETS = 64
_ID = "session_id string, source_dataset string, bucket int"
_REPLAYABLE = "epoch-"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on its file system (local, HDFS, object store)."""
    try:
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    except Exception:  # noqa: BLE001 - no JVM handle (Spark Connect): ask a file listing
        try:
            spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
            return True
        except Exception:  # noqa: BLE001
            return False
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def _sessions_dir(root: str) -> str:
    return f"{root.rstrip('/')}/sessions"


def _read_store(spark: SparkSession, path: str) -> DataFrame:
    """The session store with its known schema (no inference; an empty store reads fine)."""
    return spark.read.schema(STORED_SESSION).parquet(path)


def read_sessions(spark: SparkSession, root: str, dataset: str | None = None,
                  columns: list[str] | None = None, dedupe: bool = False) -> DataFrame:
    """Stored sessions; ``dataset`` prunes partitions, ``columns`` prunes the scan.

    ``dedupe=True`` keeps the earliest stored row per id (``created_at``), for stores
    that two writers may have appended to at once (a map-side-combined aggregation)."""
    path = _sessions_dir(root)
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED_SESSION).select(*(columns or SESSION_COLUMNS))
    df = _read_store(spark, path)
    if dataset is not None:
        df = df.where(F.col("source_dataset") == dataset)
    if dedupe:
        rest = [c for c in STORED_SESSION.fieldNames() if c != "session_id"]
        df = (df.groupBy("session_id").agg(F.min_by(F.struct(*rest), F.col("created_at")).alias("_r"))
              .select("session_id", "_r.*"))
    return df.select(*(columns or SESSION_COLUMNS))


def id_bucket(session_id) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(ID_BUCKETS)).cast("int")


def _ids_dir(root: str) -> str:
    return f"{root.rstrip('/')}/session_ids"


def stored_ids(spark: SparkSession, root: str, buckets: list[int] | None = None, datasets: list[str] | None = None) -> DataFrame:
    """The id index; ``buckets`` prunes its folders."""
    if not path_exists(spark, _ids_dir(root)):
        return spark.createDataFrame([], _ID)
    df = spark.read.schema(_ID).parquet(_ids_dir(root))
    if buckets is not None:
        df = df.where(F.col("bucket").isin(buckets))
    return df.where(F.col("source_dataset").isin(list(datasets))) if datasets else df


def _append_ids(ids: DataFrame, root: str) -> None:
    (ids.select("session_id", "source_dataset", id_bucket(F.col("session_id")).alias("bucket"))
     .repartition(ID_BUCKETS, "bucket").sortWithinPartitions("bucket", "session_id")
     .write.mode("append").option("parquet.bloom.filter.enabled#session_id", "true").partitionBy("bucket").parquet(_ids_dir(root)))


def _mend_index(spark: SparkSession, root: str) -> None:
    """Under the write lock: index what a writer that died had appended but not indexed, and a
    store that has no index yet. Only such a store costs a scan of its ids."""
    if not path_exists(spark, _sessions_dir(root)):
        return
    if not path_exists(spark, _ids_dir(root)):
        _append_ids(_read_store(spark, _sessions_dir(root)).select("session_id", "source_dataset"), root)
    for folder in _folders(spark, _staging_dir(root)):
        if not path_exists(spark, f"{folder}/winners/_SUCCESS"):      # staging, or died before it appended anything
            continue
        left = spark.read.schema("session_id string, source_dataset string").parquet(f"{folder}/winners")
        stored = _read_store(spark, _sessions_dir(root)).select("session_id", "source_dataset")
        both = left.join(stored, ["session_id", "source_dataset"], "left_semi").dropDuplicates()
        _append_ids(both.join(stored_ids(spark, root), "session_id", "left_anti"), root)
        _finished(spark, folder, both.count())


def _staging_dir(root: str) -> str:
    return f"{root.rstrip('/')}/_staging"


def _finished(spark: SparkSession, folder: str, appended: int) -> None:
    """Drop a batch's staging folder; of a batch that may be replayed keep how many rows it appended."""
    if not folder.rsplit("/", 1)[-1].startswith(_REPLAYABLE):
        _drop_folder(spark, folder)
        return
    spark.createDataFrame([(appended,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/appended")
    for part in ("winners", "rows", "first"):
        _drop_folder(spark, f"{folder}/{part}")


def _attempts(spark: SparkSession, root: str, replay_key: str) -> list[str]:
    return [f for f in _folders(spark, _staging_dir(root)) if f.rsplit("/", 1)[-1].startswith(f"{_REPLAYABLE}{replay_key}-")]


def forget_replay(spark: SparkSession, root: str, replay_key: str) -> None:
    """The batch of this key is in the ledger: its attempts need not be remembered any more."""
    for folder in _attempts(spark, root, replay_key):
        _drop_folder(spark, folder)


def insert_new_sessions(spark: SparkSession, incoming: DataFrame, root: str,
                        order_cols: list[str] | None = None, datasets: list[str] | None = None,
                        stats: dict | None = None, replay_key: str | None = None) -> int:
    """Insert sessions whose id is not stored yet; return how many were inserted.

    ``incoming`` holds SESSION columns (+ the ``order_cols`` deciding the first of
    duplicate ids). The batch is written once to the store's staging folder (a lineage cut that
    survives executor loss). All decisions are taken on its ids and places alone: the first row of
    each id, and the ids that the index already has, from the buckets that the batch falls into.
    The rows that lose (or, where they are fewer, the rows that win) then meet the staged rows, which
    Spark does without a shuffle of the rows wherever those few are small. ``datasets``
    restricts the id check to those datasets (valid when ids carry their dataset prefix, as every
    built-in source's do).

    Two writers of one id: the ids are compared and appended under the store's write lock, so the
    second one finds the first one's.

    ``stats`` (if given) receives ``records_seen``, ``records_invalid`` and ``records_surplus`` (rows
    with more cells than their header) of the raw batch, counted as it is staged: the write's only stage
    is its result stage, so no row is counted twice.

    ``replay_key`` names a batch that may come again after a crash (a stream's epoch): what an earlier attempt
    of it had appended counts as inserted, until :func:`forget_replay`.
    """
    if order_cols is None:
        order_cols = [c for c in ("_file", "_block", "_row") if c in incoming.columns]
    name = f"{_REPLAYABLE}{replay_key}" if replay_key else "sessions"
    folder = f"{_staging_dir(root)}/{name}-{uuid.uuid4().hex[:12]}"
    counts = Observation(f"staged-{uuid.uuid4().hex[:12]}")
    surplus = F.exists("validation_errors", lambda e: e["error"] == SURPLUS_CELLS)
    whole = incoming.select(*SESSION_COLUMNS, F.struct(*[F.col(c) for c in order_cols] or [F.lit(0)]).alias("_place"))
    whole = whole.withColumn("_n", F.monotonically_increasing_id())       # tells rows of one place apart
    (whole.observe(counts, F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("is_valid")).alias("bad"),
                   F.count_if(surplus).alias("surplus"))
     .write.parquet(f"{folder}/rows"))
    c = counts.get
    if stats is not None:
        stats |= {"records_seen": int(c.get("seen", 0)), "records_invalid": int(c.get("bad", 0)),
                  "records_surplus": int(c.get("surplus", 0))}
    if int(c.get("seen", 0)) == 0:
        _drop_folder(spark, folder)
        return 0
    rows = spark.read.schema(whole.schema).parquet(f"{folder}/rows")
    place = F.struct("_place", "_n")
    # partial aggregation: an id that stands there a million times is collapsed before the shuffle
    first = rows.groupBy("session_id").agg(F.min(place).alias("_p"), F.min_by("source_dataset", place).alias("source_dataset"))
    first = first.select("session_id", "source_dataset", F.col("_p._n").alias("_n"), id_bucket(F.col("session_id")).alias("bucket"))
    first.write.parquet(f"{folder}/first")
    first = spark.read.schema(first.schema).parquet(f"{folder}/first")
    per_bucket = {r["bucket"]: r["count"] for r in first.groupBy("bucket").count().collect()}     # ID_BUCKETS rows at most
    ids = sum(per_bucket.values())
    with writing(spark, root):
        _mend_index(spark, root)
        earlier = [f"{f}/appended" for f in _attempts(spark, root, replay_key) if path_exists(spark, f"{f}/appended")] if replay_key else []
        before = spark.read.schema("n long").parquet(*earlier).agg(F.sum("n")).first()[0] if earlier else 0
        known = stored_ids(spark, root, sorted(per_bucket), datasets).select("session_id")
        # Semi-join first: the stored ids meet the batch's (broadcast where the staged files prove them
        # small), and only the few matches meet the batch again.
        known = known.join(first.select("session_id"), "session_id", "left_semi")
        new = first.join(known, "session_id", "left_anti").select("session_id", "source_dataset", "_n")
        counted = Observation(f"winners-{uuid.uuid4().hex[:12]}")
        new.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/winners")     # what a crash from here on leaves behind
        n = int(counted.get.get("n", 0))
        if n:
            new = spark.read.schema(new.schema).parquet(f"{folder}/winners")
            if 2 * n >= int(c["seen"]):
                lost = rows.select("_n").join(new.select("_n"), "_n", "left_anti") if n < int(c["seen"]) else None
                kept = rows if lost is None else rows.join(lost, "_n", "left_anti")
            else:
                kept = rows.join(new.select("_n"), "_n", "left_semi")
            now = F.current_timestamp()
            (kept.select(*SESSION_COLUMNS, now.alias("created_at"), now.alias("updated_at"))
             .sortWithinPartitions("source_dataset", "session_id")       # row groups with narrow id ranges
             .write.mode("append").option("parquet.bloom.filter.enabled#session_id", "true")
             .partitionBy("source_dataset").parquet(_sessions_dir(root)))
            _append_ids(new, root)
        _finished(spark, folder, n)
    return n + before


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []


def _drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a staging folder of this job (a unique name below the store's root)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def sessions_by_dataset(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The 9 analysis columns of one dataset (partition + column pruning)."""
    return read_sessions(spark, root, dataset, ANALYSIS_COLUMNS)


def session_lookup(spark: SparkSession, root: str, session_id: str, dataset: str | None = None) -> DataFrame:
    """The session of one id. Without ``dataset``, one bucket of the id index tells it; the id then reaches
    the scan of that dataset, where bloom filters and the files' id order skip most row groups."""
    if dataset is None:
        found = stored_ids(spark, root).where((F.col("bucket") == id_bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
        dataset = next((r["source_dataset"] for r in found.select("source_dataset").limit(1).collect()), None)
    return read_sessions(spark, root, dataset).where(F.col("session_id") == session_id)


def count_by_source(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    df = read_sessions(spark, root, dataset, ["source_dataset"])
    return df.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("sessions"))


def page_by_source(spark: SparkSession, root: str, dataset: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Sessions of one dataset ordered by arrival (NULLs last, then id), one page.

    Spark plans ``orderBy(...).offset(o).limit(l)`` as a top-(o+l) per partition, so the
    cost is a scan plus a small merge, not a full sort. The merge grows with the offset:
    deep pages are better taken by :func:`page_after`."""
    df = read_sessions(spark, root, dataset)
    return df.orderBy(F.col("arrival_ts").asc_nulls_last(), "session_id").offset(offset).limit(limit)


def page_after(spark: SparkSession, root: str, dataset: str, limit: int = 100, after=None) -> DataFrame:
    """The page that follows the session ``after`` = (arrival_ts or None, session_id) in the
    order of :func:`page_by_source`; the first page without it. Costs a filtered scan and a
    merge of ``limit`` rows per task, however deep the page."""
    df = read_sessions(spark, root, dataset)
    if after is not None:
        arrival, session_id = after
        later_id = F.col("session_id") > F.lit(session_id)
        if arrival is None:
            df = df.where(F.col("arrival_ts").isNull() & later_id)
        else:
            ts = F.lit(arrival).cast("timestamp")
            df = df.where(F.col("arrival_ts").isNull() | (F.col("arrival_ts") > ts)
                          | ((F.col("arrival_ts") == ts) & later_id))
    return df.orderBy(F.col("arrival_ts").asc_nulls_last(), "session_id").limit(limit)


# --- ledgers -----------------------------------------------------------------------------
#
# Runs, loads and ledger rows are written into their own ``run_id`` partition with
# dynamic partition overwrite: each job then stages in a private folder
# (``.spark-staging-<job>``), so concurrent analyses or ingests into one root cannot
# trip over a shared ``_temporary`` folder, and for a fresh run_id it is an append.

def _write_run_partition(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("run_id").parquet(path))


def append_ingest_run(spark: SparkSession, root: str, row: dict) -> None:
    _write_run_partition(spark.createDataFrame([row], INGEST_RUN), f"{root.rstrip('/')}/ingest_runs")


def read_ingest_runs(spark: SparkSession, root: str) -> DataFrame:
    """The ledger, live and archived; one row per run."""
    live, archive = f"{root.rstrip('/')}/ingest_runs", f"{root.rstrip('/')}/ingest_runs_archive"
    df = spark.read.schema(INGEST_RUN).parquet(live) if path_exists(spark, live) else spark.createDataFrame([], INGEST_RUN)
    if path_exists(spark, archive):
        old = spark.read.schema(INGEST_RUN).parquet(archive).select(*INGEST_RUN.fieldNames())
        df = df.select(*INGEST_RUN.fieldNames()).unionByName(old).dropDuplicates(["run_id"])     # a compaction that died leaves a row in both
    return df


def compact_ingest_runs(spark: SparkSession, root: str, before: dt.date) -> int:
    """Move the ledger rows of runs that started before a day from their own folders into one file per day; returns how many."""
    live = f"{root.rstrip('/')}/ingest_runs"
    if not path_exists(spark, live):
        return 0
    with writing(spark, root):
        old = spark.read.schema(INGEST_RUN).parquet(live).where(F.col("started_at") < F.lit(before).cast("timestamp")).select(*INGEST_RUN.fieldNames())
        names = [r["run_id"] for r in old.select("run_id").collect()]       # the folders to drop
        if names:
            days = old.withColumn("day", F.to_date("started_at"))
            days.repartition("day").write.mode("append").partitionBy("day").parquet(f"{root.rstrip('/')}/ingest_runs_archive")
            for name in names:
                _drop_folder(spark, f"{live}/run_id={name}")
    return len(names)


def append_run(spark: SparkSession, root: str, run_row: DataFrame) -> None:
    _write_run_partition(run_row.select(*[F.col(f.name).cast(f.dataType) for f in RUN.fields]),
                         f"{root.rstrip('/')}/runs")


def write_load(load: DataFrame, root: str) -> None:
    """Add the LOAD rows of one run (its own run_id partition)."""
    _write_run_partition(load.select(*[F.col(f.name).cast(f.dataType) for f in LOAD.fields]),
                         f"{root.rstrip('/')}/loads")


def get_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(f"{root.rstrip('/')}/runs").where(F.col("run_id") == run_id)


def get_load(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.schema(LOAD).parquet(f"{root.rstrip('/')}/loads").where(F.col("run_id") == run_id)


def get_loads(spark: SparkSession, root: str, run_ids: list[str]) -> DataFrame:
    """LOAD rows of several runs (their partitions)."""
    return spark.read.schema(LOAD).parquet(f"{root.rstrip('/')}/loads").where(F.col("run_id").isin(run_ids))


def get_fleet_load(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return get_load(spark, root, run_id).where(F.col("level") == "fleet").orderBy("timestamp")


def get_station_load(spark: SparkSession, root: str, run_id: str, station_id: str | None = None) -> DataFrame:
    df = get_load(spark, root, run_id).where(F.col("level") == "station")
    if station_id is not None:
        df = df.where(F.col("station_id") == station_id)
    return df.orderBy(F.col("station_id").asc_nulls_first(), "timestamp")


def run_results(spark: SparkSession, root: str, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(KPI row, fleet curve, station curves) of one run; raises if the run is unknown."""
    run = get_run(spark, root, run_id)
    if not run.limit(1).collect():
        raise LookupError(f"Simulation run {run_id} not found")
    return run, get_fleet_load(spark, root, run_id), get_station_load(spark, root, run_id)
