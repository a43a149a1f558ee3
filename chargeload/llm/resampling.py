"""Importance resampling towards a target distribution of hashed word runs.

Features are runs of consecutive terms; a feature's bucket is the crc32 of its bytes modulo
`buckets`. The gain of a bucket is the log ratio of its smoothed shares in the target and in the corpus; a document's
weight is the sum of its features' gains, and Gumbel noise from a hash of its id makes
"the highest weights plus noise" a draw without replacement.

Texts are read once: a task turns each into the array of its features' buckets, which is
written. The gains are one array of `buckets` numbers; a task scores the arrays by looking
them up in it.

Ranks come from a parallel sort by regular sampling. Each task sorts its candidates (a locally sorted run of at most
`RUN_ROWS`) and marks `SAMPLES` rows at regular distances. The marked rows, each standing for
its share of its run, give splitters at regular weights; runs are cut at the splitters, the pieces are exchanged,
a task for each segment, and merged there. The counts of the segments before it give a segment's first rank, so ranks are exact
without any total order in one task. Keys are (score, id, features, run, place in the run): no two rows are equal, so
splitters part even rows that tie in all columns, and a segment holds at most rows/segments + rows/`SAMPLES`.

To the driver come the bucket counts (`buckets` rows), the marked rows (`SAMPLES` for each `RUN_ROWS` or task) and
a count for each segment. Nothing depends on the number of partitions but the work's layout.

Defined cases: null and empty texts have no features and weight 0; a null id is hashed as the empty
string and comes after all ids of its score; rows of one id are documents of their own; other columns are left out; empty
tables give no rows, and without a target text every gain follows from the smoothing alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .packed import bucket_count
from .terms import crc32_spans, joined, term_spans
from .textblocks import utf8_blocks

BUCKETS = 10_000
WORDS = 1  # longest run of terms that is a feature
SEED = 2024
LEAST_TERMS = 20
SHARE = (10, 100)
RUN_ROWS = 1 << 21
SAMPLES = 256

_RESULT = "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"


def _bucketed(words: int, buckets: int):
    """(doc_id, n_terms, features): the buckets of all runs of 1 to `words` terms, as little-endian uint32."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int64()), ("features", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in utf8_blocks(batch, "text"):
                low, starts, ends, rows = term_spans(data, offsets)
                n = np.bincount(rows, minlength=hi - lo)
                flat, first, last = joined(low, starts, ends)
                found, owner = [], []
                for width in range(1, words + 1):
                    if len(rows) < width:
                        break
                    inside = rows[: len(rows) - width + 1] == rows[width - 1:]
                    at = np.flatnonzero(inside)
                    found.append(crc32_spans(flat, first[at], last[at + width - 1]) % np.uint32(buckets))
                    owner.append(rows[at])
                feature = np.concatenate(found).astype("<u4") if found else np.zeros(0, "<u4")
                owners = np.concatenate(owner) if owner else np.zeros(0, np.int64)
                if words > 1:
                    order = np.argsort(owners, kind="stable")
                    feature, owners = feature[order], owners[order]
                edges = np.searchsorted(owners, np.arange(hi - lo + 1)) * 4
                blob = pa.py_buffer(feature.tobytes())
                blobs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), blob])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), blobs], schema=schema)

    return run


def featured(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id bigint, n_terms, features) of docs (doc_id, text); features are uint32 bucket numbers, in text order for each width."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_bucketed(words, buckets), "doc_id bigint, n_terms bigint, features binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All feature numbers of a batch and the edges of its rows."""
    blobs = batch.column("features")
    edges = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset: blobs.offset + len(blobs) + 1].astype(np.int64)
    data = blobs.buffers()[2]
    if data is None or edges[-1] == edges[0]:
        return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
    flat = np.frombuffer(data, np.uint8)[edges[0]: edges[-1]].view("<u4")
    return flat, (edges - edges[0]) // 4


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: counted in each task, then added up by bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = features.select("features").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket, in doubles."""
    n = float(len(target))
    t, s = target.astype(float), corpus.astype(float)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _order(score, absent, ids, n, run, place) -> np.ndarray:
    """Highest score first; then ids upwards, rows without id last; then features, run and place."""
    return np.lexsort((place, run, n, ids, absent, -score))


def _scored_runs(gain: np.ndarray, seed: int, least: int, run_rows: int, samples: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()),
                        ("run", pa.int64()), ("place", pa.int64()), ("stands_for", pa.float64())])

    def out(ids, absent, n, weight, score, run=None, place=None, stands_for=None):
        null = lambda kind: pa.nulls(len(ids), kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=absent), pa.array(n), pa.array(weight), pa.array(score), null(pa.int64()) if run is None else pa.array(run),
             null(pa.int64()) if place is None else pa.array(place), null(pa.float64()) if stands_for is None else pa.array(stands_for, mask=stands_for == 0)], schema=schema)

    def sorted_run(held, run):
        ids, absent, n, weight, score = (np.concatenate(x) for x in zip(*held, strict=True))
        order = _order(score, absent, ids, n, np.zeros_like(ids), np.arange(len(ids)))
        mark = np.zeros(len(ids))
        at = np.unique(np.arange(samples) * len(ids) // samples)
        mark[at] = np.diff(np.append(at, len(ids)))
        for lo in range(0, len(ids), 1 << 16):
            o = order[lo: lo + (1 << 16)]
            yield out(ids[o], absent[o], n[o], weight[o], score[o], np.full(len(o), run), np.arange(lo, lo + len(o)), mark[lo: lo + len(o)])

    def run(batches):
        number = TaskContext.get().partitionId() << 20
        held, rows = [], 0
        for batch in batches:
            flat, edges = _flat(batch)
            upto = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(gain[flat], out=upto[1:])
            weight, n = upto[edges[1:]] - upto[edges[:-1]], np.diff(edges)
            names = batch.column("doc_id")
            absent = np.asarray(names.is_null())
            score = weight + np.array([noise(i, seed) for i in names.to_pylist()], np.int64)
            ids = np.asarray(names.fill_null(0))
            drawn = np.asarray(batch.column("n_terms")) >= least
            rest = ~drawn
            if rest.any():
                yield out(ids[rest], absent[rest], n[rest], weight[rest], score[rest])
            if drawn.any():
                held.append((ids[drawn], absent[drawn], n[drawn], weight[drawn], score[drawn]))
                rows += int(drawn.sum())
            if rows >= run_rows:
                yield from sorted_run(held, number)
                held, rows, number = [], 0, number + 1
        if held:
            yield from sorted_run(held, number)

    return run


def _columns(table) -> tuple[np.ndarray, ...]:
    """score, absent, id, features, run, place of an Arrow table or batch."""
    ids = table.column("doc_id")
    plain = lambda c: table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
    return plain("score"), np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)), plain("n_features"), plain("run"), plain("place")


def splitters(marked: pa.Table, segments: int) -> tuple[np.ndarray, ...]:
    """Keys of the last rows of all segments but the last: marked rows at regular weights."""
    keys = _columns(marked)
    order = _order(*keys)
    upto = np.cumsum(marked.column("stands_for").to_numpy()[order])
    if not len(upto):
        return tuple(k[:0] for k in keys)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, segments) / segments))
    return tuple(k[order[at]] for k in keys)


def segment_of(keys: tuple[np.ndarray, ...], cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Segment of each row: the number of splitters before it."""
    both = [np.concatenate([c, k]) for c, k in zip(cuts, keys, strict=True)]
    order = _order(*both)
    is_cut = order < len(cuts[0])
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(is_cut) - is_cut
    return out[len(cuts[0]):]


def draw(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, least_terms: int = LEAST_TERMS,
         share: tuple[int, int] = SHARE, seed: int = SEED, run_rows: int = RUN_ROWS, samples: int = SAMPLES, segments: int | None = None) -> DataFrame:
    """Every row of `docs` (doc_id, text) with n_features, weight, score and its rank in the draw towards `target` (text); null if not drawn."""
    spark = docs.sparkSession
    features = staged(featured(docs, words, buckets), "resampling-features")
    corpus = bucket_totals(features, buckets)
    wanted = bucket_totals(featured(target.select(F.lit(None).alias("doc_id"), "text"), words, buckets), buckets)
    runs = features.mapInArrow(_scored_runs(gains(wanted, corpus), seed, least_terms, run_rows, samples),
                               "doc_id bigint, n_features bigint, weight bigint, score bigint, run bigint, place bigint, stands_for double")
    runs = staged(runs, "resampling-runs")
    candidates = runs.where("run is not null")
    cuts = splitters(candidates.where("stands_for is not null").toArrow(), segments or bucket_count(spark))

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment_of(_columns(batch), cuts))], names=[*batch.schema.names, "segment"])

    names = "doc_id bigint, n_features bigint, weight bigint, score bigint, run bigint, place bigint"
    pieces = candidates.drop("stands_for").mapInArrow(cut, f"{names}, segment int")
    counts = np.zeros(len(cuts[0]) + 1, np.int64)
    for r in pieces.groupBy("segment").count().collect():  # a row a segment
        counts[r["segment"]] = r["count"]
    base, drawn = np.cumsum(counts) - counts, int(counts.sum()) * share[0] // share[1]

    def merge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            part = np.asarray(batch.column("segment"))
            for s in np.unique(part).tolist():
                held.setdefault(s, []).append(batch.filter(pa.array(part == s)))
        for s in sorted(held):
            table = pa.Table.from_batches(held.pop(s)).combine_chunks()
            order = pa.array(_order(*_columns(table)))
            rank = np.arange(len(order), dtype=np.int64) + base[s] + 1
            cols = [table.column(c).combine_chunks().take(order) for c in ("doc_id", "n_features", "weight", "score")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rank, mask=rank > drawn)], names=["doc_id", "n_features", "weight", "score", "rank"])

    ranked = pieces.repartitionById(len(counts), F.col("segment")).mapInArrow(merge, _RESULT)
    rest = runs.where("run is null").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest)
