"""Time grid (G1), time bounds (E10) and the session × step expansion (F2).

The grid is regular (start + k·Δ), so the steps a session is plugged in for are an
integer range computed arithmetically:

    k0 = ceil((arrival − start) / Δ)          first step with t_k ≥ arrival
    k1 = ceil((departure − start) / Δ) − 1    last step with t_k < departure

That replaces the per-step rescan of all sessions (a theta join) of the service we replace with a
generator. The range is exploded in two levels — chunks of ``chunk_steps`` first, then
steps inside a chunk — so no row ever builds an array longer than
``max(chunk_steps, steps/chunk_steps)``. A session is expanded by the task that reads it: nothing is
shuffled, whatever the input's partitions. Only an input too small for Spark to split (see
``LoadProfile``), and the grid itself, are dealt out first, by an exchange that adaptive execution sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.functions.timestamps import MICROS_PER_MINUTE
from chargeload.operators.rows import attach_row

DEFAULT_INTERVAL_MINUTES = 5
DEFAULT_CHUNK_STEPS = 512


def interval_micros(interval_minutes: int) -> int:
    if interval_minutes is None or interval_minutes <= 0:
        raise ValueError("interval_minutes must be positive")
    return int(interval_minutes) * MICROS_PER_MINUTE


def interval_hours(interval_minutes: int) -> float:
    return interval_minutes / 60.0


def floor_div(a: Column, d: int) -> Column:
    """Exact integer floor division by a positive constant (any sign of ``a``)."""
    return F.call_function("div", a - F.pmod(a, F.lit(d)), F.lit(d))


def ceil_div(a: Column, d: int) -> Column:
    return -floor_div(-a, d)


def time_bounds(sessions: DataFrame, interval_minutes: int = DEFAULT_INTERVAL_MINUTES) -> DataFrame:
    """One row: grid_start (min arrival), grid_end (max departure), start_us, n_steps.

    ``n_steps`` is NULL when there is nothing to bound (no rows / NULL bounds)."""
    d = interval_micros(interval_minutes)
    b = sessions.agg(F.min("arrival_ts").alias("grid_start"), F.max("departure_ts").alias("grid_end"))
    start_us = F.unix_micros("grid_start")
    span = F.unix_micros("grid_end") - start_us
    return b.select(
        "grid_start", "grid_end",
        start_us.alias("start_us"),
        F.when(span > 0, floor_div(span, d) + 1).alias("n_steps"),
    )


def _chunked_range(lo: Column, hi: Column, chunk: int, name: str, df: DataFrame, keys: list[str],
                   spread: int | None = None, deal: bool = False) -> DataFrame:
    """Explode the inclusive integer range [lo, hi] of every row into column ``name``. ``deal`` distributes the
    chunks by an exchange without a fixed number of partitions, ``spread`` over as many as the caller names."""
    c = F.explode(F.sequence(floor_div(lo, chunk), floor_div(hi, chunk))).alias("_chunk")
    out = df.select("*", c)
    if spread:
        out = out.repartition(spread, *keys, "_chunk")
    elif deal:
        out = out.repartition(*keys, "_chunk")
    first = F.greatest(lo, F.col("_chunk") * chunk)
    last = F.least(hi, F.col("_chunk") * chunk + (chunk - 1))
    return out.select("*", F.explode(F.sequence(first, last)).alias(name)).drop("_chunk")


def time_grid(bounds: DataFrame, interval_minutes: int = DEFAULT_INTERVAL_MINUTES,
              chunk_steps: int = DEFAULT_CHUNK_STEPS, spread: int | None = None) -> DataFrame:
    """GRID rows (timestamp, step_index, interval_hours) from a one-row bounds frame.

    Start and end are inclusive: start, start+Δ, … ≤ end. The chunk rows are always
    dealt out, so a long grid is not generated by one task."""
    d = interval_micros(interval_minutes)
    b = bounds.where(F.col("n_steps").isNotNull()).select("start_us", "n_steps")
    g = _chunked_range(F.lit(0).cast("long"), F.col("n_steps") - 1, chunk_steps, "step_index", b,
                       ["start_us"], spread, deal=True)
    return g.select(
        F.timestamp_micros(F.col("start_us") + F.col("step_index") * d).alias("timestamp"),
        F.col("step_index").cast("long").alias("step_index"),
        F.lit(interval_hours(interval_minutes)).alias("interval_hours"),
    )


def build_time_index(spark: SparkSession, start_ts, end_ts,
                     interval_minutes: int = DEFAULT_INTERVAL_MINUTES) -> DataFrame:
    """GRID between two given instants (naive datetimes are read as UTC).

    Raises ``ValueError`` for an empty span or a non-positive interval, like the grid
    builder it replaces."""
    import datetime as _dt

    def utc(ts):
        if ts.tzinfo is None:
            return ts.replace(tzinfo=_dt.timezone.utc)
        return ts.astimezone(_dt.timezone.utc)

    start_ts, end_ts = utc(start_ts), utc(end_ts)
    if end_ts <= start_ts:
        raise ValueError("end_ts must be after start_ts")
    interval_micros(interval_minutes)
    bounds = spark.createDataFrame([(start_ts, end_ts)], "grid_start timestamp, grid_end timestamp")
    d = interval_micros(interval_minutes)
    span = F.unix_micros("grid_end") - F.unix_micros("grid_start")
    bounds = bounds.select(F.unix_micros("grid_start").alias("start_us"), (floor_div(span, d) + 1).alias("n_steps"))
    return time_grid(bounds, interval_minutes)


def with_step_range(prepared: DataFrame, bounds: DataFrame,
                    interval_minutes: int = DEFAULT_INTERVAL_MINUTES) -> DataFrame:
    """Add start_us, k0 (first step), k1 (last step) and n_session_steps to each session.

    ``bounds`` is the one-row frame of :func:`time_bounds`; its start is attached as a
    scalar subquery (computed once, no join). Sessions lying between two grid points get
    k1 < k0 and ``n_session_steps`` = 0; they keep their row."""
    d = interval_micros(interval_minutes)
    s = attach_row(prepared, bounds.select("start_us"))
    k0 = ceil_div(F.unix_micros("arrival_ts") - F.col("start_us"), d)
    k1 = ceil_div(F.unix_micros("departure_ts") - F.col("start_us"), d) - 1
    return (s.withColumn("k0", k0).withColumn("k1", k1)
             .withColumn("n_session_steps", F.greatest(F.lit(0).cast("long"), F.col("k1") - F.col("k0") + 1)))


def expand_steps(ranged: DataFrame, interval_minutes: int = DEFAULT_INTERVAL_MINUTES,
                 chunk_steps: int = DEFAULT_CHUNK_STEPS, spread: int | None = None) -> DataFrame:
    """One row per (session, grid step it is plugged in at): adds step_index, timestamp.

    Input is the output of :func:`with_step_range`. Each row is expanded where it is; ``spread`` > 0
    distributes the step chunks over that many partitions first."""
    d = interval_micros(interval_minutes)
    live = ranged.where(F.col("k1") >= F.col("k0"))
    steps = _chunked_range(F.col("k0"), F.col("k1"), chunk_steps, "step_index", live, ["session_id"], spread)
    return steps.withColumn("timestamp", F.timestamp_micros(F.col("start_us") + F.col("step_index") * d))
