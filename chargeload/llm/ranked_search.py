"""Ranked lexical search over posting lists in geometric blocks with coordinatewise-maximum summaries.

A document's vector has, for each term, `1000000000 tf div (1000 tf + 12 m)`; an item's has the term's weight times its
count; the score is their product, all in 64-bit integers. Texts are read once: a task keeps of each
document its number of terms and its counts of the items' terms, which is written; the statistics come from what is written.

The search takes the written documents part by part (about `PART_POSTINGS` postings, whatever the partition
holds), and builds for each part an index: every term's posting list is clustered by the similarity
of its documents (inner products of random sign projections of their vectors; representatives are taken
at regular places of the list, about one for `BLOCK` documents), a cluster is a block, and each block stores the largest value
of every coordinate over its documents. A block's product with an item bounds the score of each of its documents from above. For
each item the blocks of its terms' lists are visited from the largest bound down; a block is skipped only if its bound
is below the item's k-th best score so far, which is carried from part to part of a task, so the result is exact. What is visited is scored on the
whole vectors. Coordinates that share no item with the block's term are left out: no item reads them.

Each task sends its k best for each item; they meet by item in two steps (by task group, then all).

Items are the stated query set. They are taken in rounds of at most `ROUND_TERMS` term occurrences (one round up to about
two million words), so what tasks are sent is bounded whatever the size of the item table; an item longer than that is a round of its own.

Defined cases: null and empty texts have no terms; documents without id are documents, and come after all ids of their
score; rows of one id are documents of their own; rows of one item id (null too) are one item with the terms of all; items whose terms
occur nowhere have no result; other columns are left out. Terms meet by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .terms import ranges, term_spans
from .textblocks import prefix_sums, span_hash, utf8_blocks

K = 20
PART_POSTINGS = 1 << 19
BLOCK = 64
SKETCH = 32
ROUND_TERMS = 1 << 21
PAIR_TERMS = 8192  # up to so many distinct terms, which coordinates meet in an item is looked up in a table
_CHUNK = 1 << 21

_SPLIT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])


# --- reading texts -----------------------------------------------------------------------

def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), starts, ends)


def _item_terms(batches):
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for lo, hi, data, offsets in utf8_blocks(batch, "text"):
            low, starts, ends, rows = term_spans(data, offsets)
            keys = _hashed(low, starts, ends).astype("<u8")
            at = np.searchsorted(rows, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                                              pa.array(np.diff(at))], names=["item_id", "keys", "n"])


def _vectors(vocabulary: np.ndarray):
    """(doc_id, n, terms, counts): number of terms, and the vocabulary's terms in the text with their counts, for every row."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in utf8_blocks(batch, "text"):
                low, starts, ends, rows = term_spans(data, offsets)
                n = np.bincount(rows, minlength=hi - lo)
                if len(vocabulary) and len(rows):
                    keys = _hashed(low, starts, ends)
                    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
                    hit = vocabulary[at] == keys
                    code, count = np.unique(rows[hit] * len(vocabulary) + at[hit], return_counts=True)
                    row, term = np.divmod(code, len(vocabulary))
                else:
                    row, term, count = (np.zeros(0, np.int64) for _ in range(3))
                edges = pa.py_buffer((np.searchsorted(row, np.arange(hi - lo + 1)) * 4).astype(np.int32).tobytes())
                blobs = [pa.Array.from_buffers(pa.binary(), hi - lo, [None, edges, pa.py_buffer(x.astype("<u4").tobytes())]) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), *blobs], schema=_SPLIT)

    return run


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, terms, counts) of a batch of vectors."""
    out = []
    for name in ("terms", "counts"):
        blobs = batch.column(name)
        edges = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset: blobs.offset + len(blobs) + 1].astype(np.int64)
        data = blobs.buffers()[2]
        flat = np.zeros(0, np.uint32) if data is None else np.frombuffer(data, np.uint8)[edges[0]: edges[-1]].view("<u4")
        out.append(flat.astype(np.int64))
    return (edges - edges[0]) // 4, *out


def _document_counts(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_rows(batch)[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])

    return run


# --- the index of a part -------------------------------------------------------------------

class PartIndex:
    """Blocked posting lists of some documents: `edges`, `terms`, `values` are their vectors, row by row."""

    def __init__(self, edges: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, together: np.ndarray | None, block: int = BLOCK) -> None:
        self.edges, self.terms, self.values, self.size = edges, terms, values, len(weights)
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = np.argsort(terms, kind="stable")
        docs, lists = owner[order], np.searchsorted(terms[order], np.arange(self.size + 1))
        sketches = self._sketches(weights)
        cuts, parts = [], []  # first posting of every block, and its term
        for t in np.flatnonzero(np.diff(lists)):
            a, b = int(lists[t]), int(lists[t + 1])
            if b - a > block:
                inner, starts = self._clusters(sketches, docs[a:b], block)
                docs[a:b] = docs[a:b][inner]
                cuts.append(a + starts)
            else:
                cuts.append(np.array([a]))
            parts.append(np.full(len(cuts[-1]), t))
        self.docs = docs
        self.starts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        self.ends = np.append(self.starts[1:], len(docs)) if len(self.starts) else self.starts
        self.block_term = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.blocks_of = np.searchsorted(self.block_term, np.arange(self.size + 1))
        self._summarise(together)

    def _sketches(self, weights: np.ndarray) -> np.ndarray:
        signs = np.random.default_rng(7).integers(0, 2, (self.size, SKETCH)).astype(np.float32) * 2 - 1
        out = np.zeros((len(self.edges) - 1, SKETCH), np.float32)
        full = np.flatnonzero(np.diff(self.edges))
        for lo in range(0, len(full), 4096):
            rows = full[lo: lo + 4096]
            a, b = self.edges[rows[0]], self.edges[rows[-1] + 1]
            part = (weights[self.terms[a:b]] * self.values[a:b]).astype(np.float32)[:, None] * signs[self.terms[a:b]]
            out[rows] = np.add.reduceat(part, self.edges[rows] - a)
        length = np.sqrt((out * out).sum(1))
        return out / np.where(length > 0, length, 1)[:, None]

    @staticmethod
    def _clusters(sketches: np.ndarray, docs: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of a list's documents by cluster, first place of every cluster)."""
        count = -(-len(docs) // block)
        heads = sketches[docs[np.arange(count) * len(docs) // count]]
        near = np.empty(len(docs), np.int64)
        for lo in range(0, len(docs), 1 << 14):
            near[lo: lo + (1 << 14)] = np.argmax(sketches[docs[lo: lo + (1 << 14)]] @ heads.T, 1)
        order = np.argsort(near, kind="stable")
        return order, np.flatnonzero(np.diff(near[order], prepend=-1))

    def _summarise(self, together: np.ndarray | None) -> None:
        """Largest value of each coordinate over the documents of each block, laid out by (term of the list, coordinate)."""
        lengths = np.diff(self.edges)
        upto = np.append(0, np.cumsum(lengths[self.docs]))
        until = upto[self.ends]
        pair, block, most = [], [], []
        lo = 0
        while lo < len(self.starts):
            hi = max(lo + 1, int(np.searchsorted(until, upto[self.starts[lo]] + _CHUNK, "right")))
            a, b = self.starts[lo], self.ends[hi - 1]
            docs = self.docs[a:b]
            at = ranges(self.edges[docs], self.edges[docs + 1])
            where = np.repeat(np.repeat(np.arange(lo, hi), self.ends[lo:hi] - self.starts[lo:hi]), lengths[docs])
            term, value = self.terms[at], self.values[at]
            if together is not None:
                keep = together[self.block_term[where], term]
                where, term, value = where[keep], term[keep], value[keep]
            key = (where - lo) * self.size + term
            if (hi - lo) * self.size < 1 << 43:  # value < 2^20: both in one number
                both = np.sort((key << 20) | value)
                last = np.flatnonzero(np.diff(both >> 20, append=-1))
                key, value = both[last] >> 20, both[last] & ((1 << 20) - 1)
            else:
                order = np.lexsort((value, key))
                last = order[np.flatnonzero(np.diff(key[order], append=-1))]
                key, value = key[last], value[last]
            b_of, t_of = np.divmod(key, self.size)
            pair.append(self.block_term[b_of + lo] * self.size + t_of)
            block.append((b_of + lo).astype(np.int32))
            most.append(value.astype(np.int32))
            lo = hi
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        pairs = cat(pair, np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pair_block, self.pair_most = cat(block, np.int32)[order], cat(most, np.int32)[order]
        pairs = pairs[order]
        self.pair_start = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.pairs = pairs[self.pair_start]
        self.pair_end = np.append(self.pair_start[1:], len(pairs)).astype(np.int64) if len(pairs) else self.pair_start

    def bounds(self, terms: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks of the lists of an item's terms, upper bound of each one's scores)."""
        blocks = ranges(self.blocks_of[terms], self.blocks_of[terms + 1])
        if not len(blocks):
            return blocks, blocks
        wanted = (terms[:, None] * self.size + terms[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        hit = self.pairs[at] == wanted
        a, b = self.pair_start[at[hit]], self.pair_end[at[hit]]
        entries = ranges(a, b)
        gain = np.repeat(np.broadcast_to(factors, (len(terms), len(terms))).ravel()[hit], b - a) * self.pair_most[entries]
        local = np.searchsorted(blocks, self.pair_block[entries])
        total = np.zeros(len(blocks), np.int64)
        np.add.at(total, local, gain)
        return blocks, total

    def scores(self, docs: np.ndarray, factor_of: np.ndarray) -> np.ndarray:
        a, b = self.edges[docs], self.edges[docs + 1]
        at = ranges(a, b)
        gain = factor_of[self.terms[at]] * self.values[at]
        return np.add.reduceat(gain, np.cumsum(b - a) - (b - a))  # every posted document has a term


class Best:
    """The k best documents of an item so far: higher score, then smaller id, rows without id last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.absent, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """A document with a lower score cannot be among them; scores of 0 never are."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.floor
        s, a, i = (np.concatenate([x, y[keep]]) for x, y in ((self.score, score), (self.absent, absent), (self.ids, ids)))
        order = np.lexsort((i, a, -s))[: self.k]
        self.score, self.absent, self.ids = s[order], a[order], i[order]


def search_part(index: PartIndex, ids: np.ndarray, absent: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best], seen: Counter) -> None:
    """Bring each item's `best` up to date with the documents of a part."""
    factor_of = np.zeros(index.size, np.int64)
    for (terms, factors), top in zip(items, best, strict=True):
        blocks, bound = index.bounds(terms, factors)
        if not len(blocks):
            continue
        order = np.argsort(-bound, kind="stable")
        blocks, bound = blocks[order], bound[order]
        factor_of[terms] = factors
        visited = np.zeros(len(ids), bool)
        at, step = 0, 4
        while at < len(blocks):
            end = min(at + step, int(np.searchsorted(-bound, -top.floor, "right")))  # bounds below the floor fail
            if end <= at:
                break
            docs = np.unique(index.docs[ranges(index.starts[blocks[at:end]], index.ends[blocks[at:end]])])
            docs = docs[~visited[docs]]
            if len(docs):
                visited[docs] = True
                seen["scored"] += len(docs)
                top.add(index.scores(docs, factor_of), absent[docs], ids[docs])
            at, step = end, step * 2
        seen["blocks"] += len(blocks)
        seen["skipped"] += len(blocks) - at
        factor_of[terms] = 0


# --- the search ------------------------------------------------------------------------------

def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _searching(items: list[tuple[int | None, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, part: int, block: int, report: bool):
    names = [i for i, _, _ in items]
    vectors = [(t, weights[t] * c) for _, t, c in items]
    together = None
    if len(weights) <= PAIR_TERMS:
        together = np.zeros((len(weights), len(weights)), bool)
        for t, _ in vectors:
            together[np.ix_(t, t)] = True

    def run(batches):
        best, seen = [Best(k) for _ in items], Counter()

        def search(held):
            ids, absent, edges, terms, counts, n = zip(*held, strict=True)
            base = np.cumsum([0, *[e[-1] for e in edges]])
            edge = np.concatenate([[0], *[e[1:] + b for e, b in zip(edges, base[:-1], strict=True)]])
            terms, counts, n = np.concatenate(terms), np.concatenate(counts), np.concatenate(n)
            m = np.repeat(75 + (25 * n * n_docs) // max(n_terms, 1), np.diff(edge))
            values = (1_000_000_000 * counts) // (1000 * counts + 12 * m)
            search_part(PartIndex(edge, terms, values, weights, together, block), np.concatenate(ids), np.concatenate(absent), vectors, best, seen)

        held, size = [], 0
        for batch in batches:
            edges, terms, counts = _rows(batch)
            has = np.diff(edges) > 0  # documents with none of the terms cannot score
            names_of = batch.column("doc_id")
            held.append((np.asarray(names_of.fill_null(0))[has], np.asarray(names_of.is_null())[has], np.append(0, np.cumsum(np.diff(edges)[has])), terms, counts,
                         np.asarray(batch.column("n"))[has]))
            size += len(terms)
            if size >= part:
                search(held)
                held, size = [], 0
        if size:
            search(held)
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([seen[c]], pa.int64()) for c in ("blocks", "skipped", "scored")], names=["blocks", "skipped", "scored"])
            return
        for name, top in zip(names, best, strict=True):
            if len(top.score):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(top.score), pa.int64()), pa.array(top.ids, mask=top.absent), pa.array(top.score)], names=["item_id", "doc_id", "score"])

    return run


def _rounds(items: DataFrame, most: int) -> list[DataFrame]:
    """The items' terms, written, in groups of about `most` occurrences."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_item_terms, "item_id bigint, keys binary, n bigint")
    rows = staged(rows, "search-items")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = -(-total // most)
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, part_postings: int = PART_POSTINGS, block: int = BLOCK, round_terms: int = ROUND_TERMS, report: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `k` best documents of `docs` (doc_id, text) for each item of `items` (item_id, text).

    With `report`, one row for each task instead: blocks of the lists that items named, those skipped, and documents scored."""
    spark = docs.sparkSession
    schema = "blocks bigint, skipped bigint, scored bigint" if report else "item_id bigint, doc_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    for some in _rounds(items, round_terms):
        terms_of: dict[int | None, list[np.ndarray]] = {}
        for r in some.collect():  # at most `round_terms` occurrences, or one item
            terms_of.setdefault(r["item_id"], []).append(np.frombuffer(r["keys"], "<u8"))
        keyed = {i: np.unique(np.concatenate(x), return_counts=True) for i, x in terms_of.items()}
        vocabulary = np.unique(np.concatenate([t for t, _ in keyed.values()]))
        vectors = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_vectors(vocabulary), "doc_id bigint, n bigint, terms binary, counts binary")
        vectors = staged(vectors, "search-vectors")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        counted = vectors.select("terms", "counts").mapInArrow(_document_counts(len(vocabulary)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        for r in counted.collect():  # a row a term of these items
            df[r["term"]] = r["df"]
        listed = [(i, np.searchsorted(vocabulary, t), c.astype(np.int64)) for i, (t, c) in keyed.items()]
        found = found.unionByName(vectors.mapInArrow(_searching(listed, term_weights(n_docs, df), n_docs, n_terms, k, part_postings, block, report), schema))
    if report:
        return found
    found = found.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(64)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (("item_id", "_task"), ("item_id",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
