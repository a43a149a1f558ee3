"""Nearest neighbours by a block matrix join over int8 product tiles.

Vectors are scaled to length one and rounded to int8 with a scale of their own; the norm of
what rounding lost is kept with them. Queries and rows are each dealt into blocks, and the blocks form a square grid of
cells, a cell to a task: a query goes to the cells of its block's line, a row to those of its block's column. With N
rows there are N/`GROUP_ROWS` cells, so each vector travels sqrt(N/`GROUP_ROWS`) times and the exchange grows as N sqrt(N).
A task holds its queries (about `GROUP_ROWS` sqrt(cells) / 50 of them), and its rows pass by tile by tile. The product of two int8 tiles
gives all cosines up to the bound |ex||y| + |x||ey| + |ex||ey| (Cauchy-Schwarz on the rounding errors). A pair
survives if its upper bound reaches the k-th largest lower bound that its query has met so
far; survivors are recomputed from the original numbers in double precision and merged in
a heap of k for each query. The cells' heaps meet by query. The bounds are strict, so the result is exact.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; only vectors
of one dimension are compared; rows with the query's own id are not its candidates; several query rows of one id
are one query (its least vector); vectors are first divided by a power of two, so huge and tiny components count too; repeated rows with other ids are candidates of their own; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import bucket_count

K = 5
GROUP_ROWS = 16_384  # rows for each cell of the grid
TILE = 512  # queries, and rows of one product


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of the rounded rows, norms of the rounding errors) of rows scaled to length one."""
    x = x / np.abs(x).max(1)[:, None]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    tile = np.rint(unit / scale[:, None]).astype(np.int8)
    back = tile * scale[:, None]
    error = np.sqrt(((unit - back) ** 2).sum(1)) + 1e-12  # and what double arithmetic loses
    return tile, scale, np.sqrt((back * back).sum(1)), error


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed in the order of the components."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = a[:, j], b[:, j]
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Tile:
    """Some queries of one dimension with their heaps; rows come to them tile by tile."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.queries, self.ids, self.k = queries, ids, k
        width = queries.shape[1]
        self.exact = np.float32 if width * 127 * 127 < 1 << 24 else np.float64  # products of int8 rows are whole numbers
        tile, self.scale, self.norm, self.error = quantised(queries)
        self.tile = tile.astype(self.exact)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
        self.lows = np.full((len(queries), k), -np.inf)  # the k largest lower bounds so far, least first

    def meet(self, rows: np.ndarray, ids: np.ndarray, quantity: tuple[np.ndarray, ...]) -> None:
        """Bring the heaps up to date with a tile of rows; `quantity` is what `quantised` gives for them."""
        tile, scale, norm, error = quantity
        near = (self.tile @ tile.astype(self.exact).T).astype(np.float64) * self.scale[:, None] * scale[None, :]
        bound = self.error[:, None] * (norm + error)[None, :] + self.norm[:, None] * error[None, :]
        own = self.ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        self.lows = np.sort(np.concatenate([self.lows, low], 1), 1)[:, -self.k:]
        i, j = np.nonzero((near + bound >= self.lows[:, :1]) & ~own)
        if not len(i):
            return
        score, row_id = cosines(self.queries[i], rows[j]), ids[j]
        order = np.lexsort((row_id, -score, i))
        i, score, row_id = i[order], score[order], row_id[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        for n, value, name in zip(i[rank < self.k].tolist(), score[rank < self.k].tolist(), row_id[rank < self.k].tolist(), strict=True):
            heap = self.heaps[n]
            if len(heap) < self.k:
                heapq.heappush(heap, (value, -name))
            elif (value, -name) > heap[0]:
                heapq.heapreplace(heap, (value, -name))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row id, cosine) of what the heaps hold."""
        out = [(q, -name, value) for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for value, name in heap]
        q, name, value = zip(*out, strict=True) if out else ((), (), ())
        return np.array(q, np.int64), np.array(name, np.int64), np.array(value, np.float64)


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The vectors, each divided by the power of two of its largest component: exact, and no square leaves a double's range."""
    lists = batch.column("vector")
    flat, edges = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    edges = edges - edges[0]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        x = flat[a:b]
        out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])))
    return out


def _searched(k: int):
    def run(batches):
        asked: dict[int, tuple[list, list]] = {}  # queries of the cell by dimension
        tiles: dict[int, list[Tile]] = {}
        waiting: dict[int, tuple[list, list]] = {}  # rows that do not fill a tile yet

        def meet(width):
            vectors, names = waiting.pop(width)
            rows, ids = np.stack(vectors), np.array(names, np.int64)
            quantity = quantised(rows)
            for tile in tiles.get(width, ()):
                tile.meet(rows, ids, quantity)

        def ready():
            for width, (vectors, names) in asked.items():
                x, ids = np.stack(vectors), np.array(names, np.int64)
                tiles[width] = [Tile(x[at: at + TILE], ids[at: at + TILE], k) for at in range(0, len(x), TILE)]
            asked.clear()

        for batch in batches:  # queries first, then rows
            for is_query, name, x in zip(batch.column("is_query").to_pylist(), batch.column("vec_id").to_pylist(), _vectors(batch), strict=True):
                if is_query:
                    to = asked.setdefault(len(x), ([], []))
                    to[0].append(x)
                    to[1].append(name)
                    continue
                if asked:
                    ready()
                if len(x) in tiles:
                    to = waiting.setdefault(len(x), ([], []))
                    to[0].append(x)
                    to[1].append(name)
                    if len(to[1]) >= TILE:
                        meet(len(x))
        for width in list(waiting):
            meet(width)
        for tile in (t for ts in tiles.values() for t in ts):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in tile.found()], names=["query_id", "vec_id", "score"])

    return run


def grid(rows: int, cells: int) -> tuple[int, int]:
    """(blocks of queries, blocks of rows): a square grid of at least a cell for each `GROUP_ROWS` rows and `cells` in all."""
    cells = max(1, -(-rows // GROUP_ROWS), cells)
    across = math.isqrt(cells - 1) + 1
    return -(-cells // across), across


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector of doubles) that can be compared."""
    # NaN is above all numbers, and comparisons with null are not true
    ok = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ok)


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` rows of `vectors` (vec_id bigint, vector array<double>) with the largest cosine for each row where `is_query` holds."""
    rows = usable(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")))
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    down, across = grid(rows.count(), min(bucket_count(vectors.sparkSession), vectors.sparkSession.sparkContext.defaultParallelism))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = rows.select("vec_id", "vector", F.lit(False).alias("is_query"), each(down).alias("q"), block(across).alias("r"))
    visits = queries.select("vec_id", "vector", F.lit(True).alias("is_query"), block(down).alias("q"), each(across).alias("r"))
    cells = placed.unionByName(visits).withColumn("cell", F.col("q") * across + F.col("r")).drop("q", "r")
    met = cells.repartitionById(down * across, F.col("cell")).sortWithinPartitions(F.col("is_query").desc(), "vec_id")
    found = met.mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
