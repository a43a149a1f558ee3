"""Variable-capacity best-fit packing of texts into training sequences.

Texts longer than the largest permitted length are cut into full pieces and a rest. Pieces, longest
first, go to the open bin that they fill best. Where none has room, a bin opens with the length
whose cost for each token that can still fill it is least; all permitted lengths compete for every
new bin. In the end each bin shrinks to the shortest permitted length that holds its contents.

Spark deals the pieces (ids and lengths, never texts) evenly to as many groups as the session
has shuffle partitions, and each group packs by itself; a group costs at most some bins that are not
full, however many groups there are.

Defined cases: null and blank texts have no words and get one row without a bin; equal lengths go by
id; rows of one id are separate texts of that id, numbered by their length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged
from .packed import bucket_count

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 64  # fixed cost of a bin, in tokens
QUADRATIC = 1 / 65536  # cost of attention for a squared token

SCHEMA = "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, bin_length int, bin_used int"


def bin_cost(length: int) -> float:
    return OVERHEAD + length + QUADRATIC * length * length


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each size, and each bin's contents and final length. Sizes come largest first and fit the largest length."""
    lengths = sorted(lengths)
    cost = [bin_cost(n) for n in lengths]
    left = int(sum(sizes))
    used: list[int] = []
    room: dict[int, list[tuple[int, int]]] = {}  # open bins by free tokens: (bin, opened length)
    some = 0  # bit r: a bin with r free tokens is open
    out = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        above = some >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            bin_, length = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            # a bin holds at most what is still to come
            length = min((c / min(n, left), n) for n, c in zip(lengths, cost, strict=True) if n >= size)[1]
            bin_, free = len(used), length
            used.append(0)
        out[i] = bin_
        used[bin_] += size
        left -= size
        free -= size
        if free:
            room.setdefault(free, []).append((bin_, length))
            some |= 1 << free
    used_ = np.array(used, np.int64)
    return out, used_, np.array(lengths)[np.searchsorted(lengths, used_)]


def pieces_of(n_tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece number, tokens) of the pieces of texts."""
    count = (n_tokens + longest - 1) // longest
    row = np.repeat(np.arange(len(n_tokens)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, piece, np.minimum(longest, n_tokens[row] - piece * longest)


def _packed_rows(lengths: Sequence[int], groups: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        group = int(table.column("grp")[0].as_py())
        ids = table.column("doc_id")
        n = table.column("n_tokens").to_numpy().astype(np.int64)
        rank = np.asarray(ids.fill_null(-(1 << 63)).to_numpy(), np.int64)
        row, piece, size = pieces_of(n, max(lengths))
        order = np.lexsort((piece, rank[row], -size))
        row, piece, size = row[order], piece[order], size[order]
        bin_, used, length = best_fit(size.tolist(), lengths)
        for lo in range(0, len(row), 50_000):
            s = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(row[s])).combine_chunks().cast(pa.int64()), pa.array(piece[s].astype(np.int32)), pa.array(piece[s] * max(lengths)), pa.array(size[s]),
                pa.array(bin_[s] * groups + group), pa.array(length[bin_[s]].astype(np.int32)), pa.array(used[bin_[s]].astype(np.int32)),
            ], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_used"])

    return run


def pack_texts(docs: DataFrame, lengths: Sequence[int] = LENGTHS, n_tokens: Column | None = None) -> DataFrame:
    """One row per piece of `docs` (doc_id bigint, text string): its tokens [start, start + n_tokens) of the text, its bin, and the bin's final
    length and contents. `n_tokens` overrides the word count."""
    groups = bucket_count(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)) if n_tokens is None else n_tokens, F.lit(0)).cast("bigint").alias("n_tokens"))
    counted = staged(counted, "packing-counts")  # texts are read once, for both branches
    dealt = counted.select("*", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups)).cast("int").alias("grp")).repartitionById(groups, F.col("grp"))
    # blank texts take no room
    packed = dealt.where("n_tokens > 0").mapInArrow(_packed_rows(tuple(lengths), groups), SCHEMA)
    blank = counted.where("n_tokens <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_used"))
    return packed.unionByName(blank)
