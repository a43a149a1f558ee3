"""Load curves (E1–E3, E8, E12): aggregations of per-step decisions.

Every curve is a hash aggregation with map-side partial aggregation, so the expanded
(session × step) rows never cross the network: each task ships at most one row per
(step[, station]) it saw. A hot station or a busy step therefore costs no more shuffle
than a quiet one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeload.functions.numbers import exact_sum, merged_parts, parts_total, sum_parts
from chargeload.operators.profile import estimated_bytes

#: Estimated bytes of (session_id, station_id) rows in one partition of the join to the station map: from Parquet, some
#: 50,000 sessions. Below the least number of partitions adaptive execution sizes them; above the most, they grow (and spill).
MAP_PARTITION_BYTES = 512 << 10
MIN_MAP_PARTITIONS, MAX_MAP_PARTITIONS = 16, 20_000


def station_map(sessions: DataFrame) -> DataFrame:
    """Distinct (session_id, station_id) pairs."""
    return sessions.select("session_id", "station_id").dropDuplicates()


def map_partitions(sessions: DataFrame) -> int | None:
    """Partitions to join decisions to the map of ``sessions`` in, in proportion to its estimated size; None where it is
    small or has no estimate."""
    size = estimated_bytes(sessions.select("session_id", "station_id"))
    parts = 0 if size is None else -(-size // MAP_PARTITION_BYTES)
    return min(parts, MAX_MAP_PARTITIONS) if parts >= MIN_MAP_PARTITIONS else None


def with_station(decisions: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Decisions with the station of their session, by the map of ``sessions`` where they lack it."""
    if "station_id" in decisions.columns:
        return decisions
    if sessions is None:
        raise ValueError("decisions lack station_id: pass the sessions frame to map them")
    parts = map_partitions(sessions)
    if parts is None:
        # Plain left join: AQE turns it into a broadcast join at run time when the map is
        # small, and keeps a shuffle join when it is not.
        return decisions.join(station_map(sessions), "session_id", "left")
    # AQE sizes partitions by their shuffled bytes, and a decision comes to about one: a task would sort tens of millions
    # of rows, the more the larger the input. Dealt by number, a task holds as many sessions at any size.
    # Decisions that come in these partitions already (load_profile's by_session) are not shuffled again.
    pairs = sessions.select("session_id", "station_id").repartition(parts, "session_id")
    return decisions.repartition(parts, "session_id").join(station_map(pairs), "session_id", "left")


def fleet_load_curve(decisions: DataFrame, sort: bool = True) -> DataFrame:
    """Per step with ≥ 1 plugged-in session: total load, total energy, active sessions."""
    out = decisions.groupBy("timestamp").agg(
        exact_sum("charge_rate_kw").alias("total_load_kw"),
        exact_sum("energy_delivered_kwh").alias("total_energy_kwh"),
        F.count("session_id").alias("active_sessions"),
    )
    return out.orderBy("timestamp") if sort else out


def station_load_curves(decisions: DataFrame, sessions: DataFrame | None = None, sort: bool = True) -> DataFrame:
    """Per (step, station): load and energy. Sessions without a station form the NULL group."""
    d = with_station(decisions, sessions)
    out = d.groupBy("timestamp", "station_id").agg(
        exact_sum("charge_rate_kw").alias("load_kw"),
        exact_sum("energy_delivered_kwh").alias("energy_kwh"),
    )
    return out.orderBy(F.col("station_id").asc_nulls_first(), "timestamp") if sort else out


def load_timeseries(decisions: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Fleet and station rows in one table, told apart by ``level`` ('fleet'/'station').

    Two-level aggregation: decisions → (step, station) rows (partial aggregation before
    the shuffle), then the fleet rows from those already small station rows. The large
    input is read and shuffled once, unlike GROUPING SETS, which would double it."""
    d = with_station(decisions, sessions)
    station = d.groupBy("timestamp", "station_id").agg(
        *sum_parts("charge_rate_kw", "load"), *sum_parts("energy_delivered_kwh", "energy"),
        F.count("session_id").alias("active_sessions"))
    return both_levels(station, ["timestamp"])


def both_levels(station: DataFrame, by: list[str], load: str = "load", energy: str = "energy") -> DataFrame:
    """LOAD rows of both levels from station rows (columns ``by``, station_id, sum parts, active_sessions)."""
    fleet = station.groupBy(*by).agg(*merged_parts(load), *merged_parts(energy), F.sum("active_sessions").alias("active_sessions"))
    cols = ["level", *by, "station_id", parts_total(load).alias("load_kw"), parts_total(energy).alias("energy_kwh"), "active_sessions"]
    return (station.withColumn("level", F.lit("station")).select(*cols)
            .unionByName(fleet.withColumn("level", F.lit("fleet"))
                         .withColumn("station_id", F.lit(None).cast("string")).select(*cols)))


def zero_filled_load(grid: DataFrame, fleet: DataFrame) -> DataFrame:
    """Load at every grid step; steps nobody is plugged in at get 0."""
    f = fleet.select("timestamp", F.col("total_load_kw").alias("_load"))
    return (grid.join(f, "timestamp", "left")
            .select("step_index", "timestamp", F.coalesce("_load", F.lit(0.0)).alias("load_kw")))
