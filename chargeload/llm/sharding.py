"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record is hashed into one of `SLOTS` virtual slots, a number that never changes. Bytes are
added up by slot, and a map says which shard has which slot. The map is a small table (a row a
slot) kept in versions: balancing reads the newest version, moves as few slots as it can, and writes the
next one. Records are never hashed anew; those of a slot that stays, stay.

The first version deals the slots out in turn. `rebalance` edits: first slots of shards that are gone or new are
seen to, then, while the heaviest and the lightest shard differ by more than the tolerance, the heaviest gives
the slot, or exchanges the pair of slots, that brings the two nearest to each other. The law is `bytes`: shards differ by the
tolerance (a thousandth of the mean), or by what no move or exchange of the two extreme shards can mend. Only the map
(`SLOTS` rows, a parameter) comes to the driver.

A record's place in its shard is the number of records in the shard's earlier slots plus its place in its own
slot, in the order of (doc_id, hash, copy); so no task sorts a whole shard.

Hot keys: the hash takes id and text together, so neither an id nor a text that many rows share fills a slot. Rows equal in both
are counted before the exchange and then dealt out as copies 0, 1, 2 ... each hashed with its number.

Defined cases: a null text has no bytes and the crc of nothing; rows without id are records like others, repeated rows are
records of their own; an empty table has an empty map of loads and no rows; other columns of the
input, whatever their names, are left out by `place` and kept by `write_shards` (which drops those that bear a name of its own).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargeload.sinks.store import path_exists

from .common import staged, without

SLOTS = 4096
SHARDS = 24
ROW_BYTES = 8
TOLERANCE = 0.001
COPIES_AT_ONCE = 4096

PLACED = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


def records(docs: DataFrame, slots: int = SLOTS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, virtual_slot, `_hash`, `_copy`, and the columns `keep`."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + ROW_BYTES).cast("bigint")
    same = docs.select(*[F.col(f"`{c}`") for c in keep], *[c for c in ("doc_id",) if c not in keep], size.alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(F.col("doc_id"), text).alias("_hash"))
    same = same.groupBy(*[F.col(f"`{c}`") for c in same.columns]).agg(F.count(F.lit(1)).alias("_n"))
    # as many rows again as there were, numbered; in two steps, so that no array is long
    same = same.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {COPIES_AT_ONCE}"))))
    low = F.col("_part") * COPIES_AT_ONCE
    same = same.withColumn("_copy", F.explode(F.sequence(low, F.least(low + (COPIES_AT_ONCE - 1), F.col("_n") - 1))))
    return same.drop("_n", "_part").withColumn("virtual_slot", F.pmod(F.xxhash64("_hash", "_copy"), F.lit(slots)).cast("int"))


def slot_loads(recs: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots in use."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> list[int]:
    """Version 0: shard by slot, dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(shard_of: Sequence[int], load: Sequence[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """An edited copy of the map for `shards` shards; slots move only where that lessens the difference of two shards."""
    out = list(shard_of)
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for s, shard in enumerate(out):
        if shard < shards:
            total[shard] += load[s]
            held[shard].append(s)
        else:
            homeless.append(s)
    heap = [(t, i) for i, t in enumerate(total)]
    heapq.heapify(heap)
    for s in sorted(homeless, key=lambda s: (-load[s], s)):  # shards that are gone: largest slots first, each to the lightest
        t, i = heapq.heappop(heap)
        out[s] = i
        held[i].append(s)
        total[i] = t + load[s]
        heapq.heappush(heap, (total[i], i))
    near = tolerance * sum(total) / shards
    while True:
        low = min(range(shards), key=lambda i: (total[i], i))
        high = max(range(shards), key=lambda i: (total[i], -i))
        gap = total[high] - total[low]
        if gap <= near:
            return out
        give, take = _best_move(held[high], held[low], load, gap)
        if give is None:
            return out
        held[high].remove(give)
        held[low].append(give)
        out[give] = low
        if take is not None:
            held[low].remove(take)
            held[high].append(take)
            out[take] = high
        moved = load[give] - (load[take] if take is not None else 0)
        total[high] -= moved
        total[low] += moved


def _best_move(high: list[int], low: list[int], load: Sequence[int], gap: int) -> tuple[int | None, int | None]:
    """The slot to give, or pair to exchange, that leaves the least difference; (None, None) if none lessens it."""
    best = (gap, None, None)
    for s in high:  # one slot: fewest edits
        left = abs(gap - 2 * load[s])
        if load[s] and left < best[0]:
            best = (left, s, None)
    if best[1] is not None and best[0] <= gap // 2:
        return best[1], best[2]
    by_load = sorted(low, key=lambda s: (load[s], s))
    j = 0
    for s in sorted(high, key=lambda s: (load[s], s)):  # a pair: its difference nearest to half of the gap
        while j + 1 < len(by_load) and load[s] - load[by_load[j + 1]] >= gap / 2:
            j += 1
        for t in by_load[j: j + 2]:
            left = abs(gap - 2 * (load[s] - load[t]))
            if left < best[0]:
                best = (left, s, t)
    return best[1], best[2]


def write_map(spark: SparkSession, root: str, version: int, shard_of: Sequence[int], load: Sequence[int], rows: Sequence[int]) -> None:
    """Store a version of the map below `root`; a version once written is not changed."""
    table = [(s, shard, int(load[s]), int(rows[s])) for s, shard in enumerate(shard_of)]
    frame = spark.createDataFrame(table, "virtual_slot int, shard int, bytes long, rows long").coalesce(1)
    frame.write.mode("error").parquet(f"{root.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, root: str, version: int | None = None) -> tuple[int | None, DataFrame]:
    """(version, table) of one stored version; the newest if none is named, (None, no rows) if none is stored."""
    schema = "virtual_slot int, shard int, bytes long, rows long, version int"
    every = spark.createDataFrame([], schema)
    if path_exists(spark, root):
        every = spark.read.option("basePath", root).schema(schema).parquet(root)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return version, every.where(F.col("version") == version).drop("version")


def _loads(recs: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    load, rows = [0] * slots, [0] * slots
    for r in slot_loads(recs).collect():  # a row a slot at most
        load[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    return load, rows


def balanced_map(recs: DataFrame, root: str, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE) -> int:
    """Write the next version of the map below `root` for the loads of `recs` and return its number.

    Without any version yet, version 0 (dealt out in turn) is written first and version 1 edits it."""
    spark = recs.sparkSession
    load, rows = _loads(recs, slots)
    version, table = read_map(spark, root)
    if version is None:
        version, shard_of = 0, first_map(slots, shards)
        write_map(spark, root, 0, shard_of, load, rows)
    else:
        shard_of = [r["shard"] for r in table.orderBy("virtual_slot").collect()]
    if len(shard_of) != slots:
        raise ValueError(f"the stored map has {len(shard_of)} slots, not {slots}")
    write_map(spark, root, version + 1, rebalance(shard_of, load, shards, tolerance), load, rows)
    return version + 1


def placed(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`recs` with `law`, `shard`, `slot` (place in the shard, from 0) and `grown_shard`."""
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "_hash", "_copy", "size", "text_crc32")
    out = recs.withColumn("_place", F.row_number().over(inside) - 1).join(F.broadcast(starts), "virtual_slot")  # a row a slot: `SLOTS` rows
    out = out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.withColumn("slot", (F.col("_start") + F.col("_place")).cast("bigint")).drop("_start", "_place", "_hash", "_copy")


def place(docs: DataFrame, root: str, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE, version: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    The map is stored below `root`; without `version` the next one is made for these rows. Texts are read
    once: what is placed is the written table of their sizes and hashes."""
    recs = staged(records(docs, slots), "shard-records")
    if version is None:
        version = balanced_map(recs, root, shards, slots, tolerance)
        table = read_map(docs.sparkSession, root, version)[1]
    else:  # an older map: its shards, with the counts of these rows
        table = read_map(docs.sparkSession, root, version)[1].drop("bytes", "rows").join(slot_loads(recs), "virtual_slot", "left").na.fill(0, ["bytes", "rows"])
    return placed(recs, table).select(*PLACED)


def write_shards(docs: DataFrame, root: str, path: str, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE) -> int:
    """Write the rows of `docs` with all their columns to `path`, one folder a shard, each slot's rows together; returns the map's version."""
    own = without(docs, *[c for c in PLACED if c != "doc_id"], "_hash", "_copy")
    recs = staged(records(own, slots, own.columns), "shard-rows")
    version = balanced_map(recs.drop("text"), root, shards, slots, tolerance)
    out = placed(recs, read_map(docs.sparkSession, root, version)[1])
    out.write.partitionBy("shard").parquet(path)
    return version
