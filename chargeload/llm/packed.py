"""Exchange of packed arrays between Spark tasks.

A map task groups its numbers by bucket (a hash of the key they must meet on) and sends one
binary row per bucket and flush instead of one row per number. Spark shuffles those rows, a
bucket to a partition. The number of buckets is ``spark.sql.shuffle.partitions``, so it is
sized to the input like that of any other shuffle. Where a task should hold less than a
partition at a time, senders use several buckets for each partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "bucket int, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def packed_rows(parts: Iterable[tuple[int, bytes]], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Record batches of (bucket, blob), a few rows each."""
    b, v = [], []
    for bucket, blob in parts:
        b.append(bucket)
        v.append(blob)
        if len(b) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(v, pa.binary())], schema=_SCHEMA)
            b, v = [], []
    if b:
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(v, pa.binary())], schema=_SCHEMA)


def split_by_bucket(buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that occurs, positions in input order."""
    order = np.argsort(buckets.astype(np.uint16) if n < 65536 else buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n + 1))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(b), order[edges[b]: edges[b + 1]]


def per_bucket(rows: DataFrame, parts: int, fn: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the blobs of each bucket together, in a stable order, and apply `fn` to each bucket."""
    def run(batches):
        found: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(b, []).append(blob)
        for b in sorted(found):
            yield from fn(b, [unpack(x) for x in sorted(found.pop(b))])

    return rows.repartitionById(parts, F.col("bucket") % parts).mapInArrow(run, schema)
