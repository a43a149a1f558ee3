"""Near-copy join: word n-gram Jaccard similarity by a MinHash LSH forest and exact verification.

1. Each text becomes the set of its windows of `width` words. Documents with equal sets form
   one class, which travels on as one row.
2. A class has `trees` labels of `depth` min-hashes, one for each tree of the forest. A tree is a prefix trie of its labels,
   kept as the sorted list of the labels: a node is a run of labels with a common prefix. Pairs are matched at whole labels first, then at
   prefixes shorter by one hash, and so on. Shortening ends for the forest at the prefix at which a pair at the threshold meets
   in some tree with probability `recall` (`prefix_length`), and for a node before that, as soon as its classes are linked
   with each other already. Nodes of that shortest prefix are the groups that Spark brings together; the trie below them is
   the order of the rows in their task.
3. Matched classes are compared by their whole signatures; pairs whose estimate
   lies within five standard errors of the threshold link them. Large nodes are compared in pairs of
   blocks, so that no task holds more than two blocks.
4. Linked classes fetch their texts once, and all pairs of a linked component are verified on their
   exact window sets, again in pairs of blocks. Only counts and a spanning forest leave a task.

Defined cases: null and blank texts have no windows and no links; a text of fewer than `width`
words is one window; rows with a null id are left out; repeated rows of one id count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .components import connected_components
from .textblocks import mix, prefix_sums, span_hash, utf8_blocks, word_windows, words

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
BLOCK = 1024  # classes in one block of a large group
PAIRS = 200_000  # pairs of signatures compared at once


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten from whole labels on until a pair at the threshold meets in some tree with probability `recall`."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def text_windows(batch: pa.RecordBatch, width: int):
    """(first row, end row, hashes, rows) of the windows of each text of a batch, in row order."""
    for lo, hi, data, offsets in utf8_blocks(batch, "text"):
        start, end, row = words(data, offsets)
        yield lo, hi, *word_windows(span_hash(prefix_sums(data), start, end), row, hi - lo, width)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows once per row, by 44 bits of their hashes; the row takes the 20 bits above (blocks have fewer rows)."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    key = key[np.append(True, key[1:] != key[:-1])]
    return key & np.uint64((1 << 44) - 1), (key >> np.uint64(44)).astype(np.int64)


def _signature_rows(width: int, trees: int, depth: int, use: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        seeds = np.random.default_rng(7).integers(1, 1 << 63, (trees * depth, 2), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, h, row in text_windows(batch, width):
                if not len(h):
                    continue
                h, row = _distinct(h, row)
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                who = ids[lo:hi][row[first]].astype(np.int64)
                digest = np.stack([np.add.reduceat(mix(h ^ np.uint64(c)), first) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)], 1)
                h = mix(h)
                least = np.stack([np.minimum.reduceat((h ^ a) * b, first) for a, b in seeds], 1)
                sig = (mix(least) & np.uint64(255)).astype(np.uint8)
                label = least.reshape(len(first), trees, depth)
                keys = np.zeros((len(first), trees), np.uint64)
                for k in range(use):
                    keys = mix(keys * np.uint64(31) + label[:, :, k])
                yield pa.RecordBatch.from_arrays([
                    pa.array(who), pa.array([x.tobytes() for x in digest], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, trees), pa.int32()), pa.array(keys.ravel().view(np.int64))),
                ], schema=schema)

    return run


def in_block_pairs(rows: DataFrame, keys: list[str], member: str, size: Column, block: int) -> DataFrame:
    """Deal the members of each group to the pairs of its blocks: adds `side` (own block), `lo` and `hi`. A group of up to
    `block` members is one pair (0, 0); each member of a larger one goes to as many pairs as there are blocks."""
    n = F.ceil(size / block).cast("int")
    rows = rows.withColumn("_n", n).withColumn("side", F.pmod(F.xxhash64(member, F.lit(11)), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other")).drop("_n", "_other")


def whole_groups(batches, key_names: list[str]):
    """(table, edges) pieces that hold whole groups, from batches sorted by the key columns."""
    tail = None
    for batch in _with_end(batches):
        if batch is not None:
            tail = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            if not tail.num_rows:
                continue
        if tail is None or not tail.num_rows:
            return
        tail = tail.combine_chunks()
        key = np.stack([tail.column(k).to_numpy().astype(np.int64) for k in key_names], 1)
        starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
        end = tail.num_rows if batch is None else int(starts[-1])
        if end:
            edges = np.append(starts[starts < end], end)
            yield tail.slice(0, end), edges
        tail = tail.slice(end)


def _with_end(batches):
    yield from batches
    yield None


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the label classes that the pairs (i, j) connect; a class is named by its least member."""
    while len(i):
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = to[to]
            if (up == to).all():
                break
            to = up
        labels = to[labels]
    return labels


def _pair_blocks(side: np.ndarray, cross: bool):
    """Index arrays (i, j) of all pairs of a group, or of the pairs across its two blocks, some at a time."""
    a = np.flatnonzero(side == side.min()) if cross else np.arange(len(side))
    b = np.flatnonzero(side != side.min()) if cross else a
    step = max(1, PAIRS // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = np.repeat(a[lo: lo + step], len(b)), np.tile(b, len(a[lo: lo + step]))
        if not cross:
            i, j = i[i < j], j[i < j]
        yield i, j


def _small_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Index pairs of many small groups."""
    i, j = [], []
    for n in np.unique(sizes):
        x, y = np.triu_indices(int(n), 1)
        at = starts[sizes == n][:, None]
        i.append((at + x).ravel())
        j.append((at + y).ravel())
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64),) * 2


def match_by_level(sig: np.ndarray, label: np.ndarray, labels: np.ndarray, pairs, least_equal: int) -> tuple[np.ndarray, int]:
    """Link the members of trie nodes, longest common prefix first; returns the link classes and how many signatures were compared.

    `label` holds the hashes of each row's label below the nodes' own prefix; `pairs` gives (i, j) pieces of the pairs within nodes.
    At each level only pairs whose labels part there meet, and of them those that longer prefixes have not linked yet."""
    compared = 0
    for level in range(label.shape[1], -1, -1):
        for i, j in pairs():
            same = label[i, :level] == label[j, :level]
            meet = same.all(1)
            if level < label.shape[1]:
                meet &= label[i, level] != label[j, level]
            i, j = i[meet], j[meet]
            # neighbours in the sorted list first, then one pair of each two classes, then what these have not linked
            for step in range(3):
                open_ = labels[i] != labels[j]
                i, j = i[open_], j[open_]
                at = np.flatnonzero(j == i + 1) if step == 0 else np.arange(len(i))
                if step == 1:
                    at = np.unique(labels[i] * len(sig) + labels[j], return_index=True)[1]
                near = (sig[i[at]] == sig[j[at]]).sum(1) >= least_equal
                compared += len(at)
                labels = _join_labels(labels, i[at][near], j[at][near])
        if (labels == labels[0]).all():  # nothing is left to link: no need of shorter prefixes
            break
    return labels, compared


def _likely_links(least_equal: int, depth: int, use: int):
    def run(batches):
        for part, edges in whole_groups(batches, ["key", "tree", "lo", "hi"]):
            ids, side = part.column("class_id").to_numpy(), part.column("side").to_numpy()
            cross = part.column("lo").to_numpy() != part.column("hi").to_numpy()
            sig = np.frombuffer(b"".join(part.column("sig").combine_chunks().to_pylist()), np.uint8).reshape(len(ids), -1)
            below = part.column("tree").to_numpy()[:, None] * depth + np.arange(use, depth)
            label = np.take_along_axis(sig, below, 1)
            labels = np.arange(len(ids))
            size = np.diff(edges)
            small = (size <= 32) & ~cross[edges[:-1]]
            many_i, many_j = _small_pairs(edges[:-1][small], size[small])
            if len(many_i):  # many small nodes side by side
                labels, _ = match_by_level(sig, label, labels, lambda: ((many_i[k: k + PAIRS], many_j[k: k + PAIRS]) for k in range(0, len(many_i), PAIRS)), least_equal)
            for g in np.flatnonzero(~small):
                s = slice(int(edges[g]), int(edges[g + 1]))
                if cross[s.start] and len(np.unique(side[s])) < 2:
                    continue
                own, _ = match_by_level(sig[s], label[s], np.arange(s.stop - s.start), lambda s=s: _pair_blocks(side[s], bool(cross[s.start])), least_equal)
                labels = _join_labels(labels, np.arange(s.start, s.stop), s.start + own)
            moved = np.flatnonzero(labels != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[labels[moved]], pa.int64())], names=["u", "v"])

    return run


def _window_sets(width: int, others: list[str]):
    def run(batches):
        for batch in batches:
            for lo, hi, h, row in text_windows(batch, width):
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                sets = pa.array([np.unique(h[edges[i]: edges[i + 1]]).tobytes() for i in range(hi - lo)], pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], sets], names=[*others, "windows"])

    return run


def shared_windows(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a x b: products of incidence matrices, some windows at a time."""
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    use = count[column] > 1
    _, column = np.unique(column[use], return_inverse=True)
    owner = owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(column):
        return out
    step = 2048
    for lo in range(0, int(column[-1]) + 1, step):
        s = slice(*np.searchsorted(column, [lo, lo + step]))
        x = np.zeros((len(sets), min(step, int(column[-1]) + 1 - lo)), np.float32)
        x[owner[s], column[s] - lo] = 1
        out += x[a] @ x[b].T
    return out


def _verified(threshold: float):
    def run(batches):
        for part, edges in whole_groups(batches, ["component", "lo", "hi"]):
            all_ids, all_sides, all_copies = (part.column(c).to_numpy() for c in ("class_id", "side", "copies"))
            windows = part.column("windows")
            split = part.column("lo").to_numpy() != part.column("hi").to_numpy()
            out = []
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                raw = windows.slice(start, end - start).to_pylist()
                # of several texts under one id the least window set counts
                keep = sorted({int(i): k for k, i in sorted(enumerate(all_ids[start:end]), key=lambda x: raw[x[0]], reverse=True)}.values())
                ids, side, copies = all_ids[start:end][keep], all_sides[start:end][keep], all_copies[start:end][keep]
                cross = bool(split[start])
                if len(ids) < 2 or cross and len(np.unique(side)) < 2:
                    continue
                sets = [np.frombuffer(raw[k], np.uint64) for k in keep]
                a = np.flatnonzero(side == side.min()) if cross else np.arange(len(ids))
                b = np.flatnonzero(side != side.min()) if cross else a
                size = np.array([len(s) for s in sets], np.float64)
                both = shared_windows(sets, a, b).astype(np.float64)
                near = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9
                if not cross:
                    np.fill_diagonal(near, False)
                links = np.zeros(len(ids), np.int64)
                links[a] += near @ copies[b]
                if cross:
                    links[b] += near.T @ copies[a]
                i, j = np.nonzero(near)
                labels = _join_labels(np.arange(len(ids)), a[i], b[j])
                out.append((ids, ids[labels], links))
            if out:
                u, v, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "links"])

    return run


def near_copies(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per doc_id of `docs` (doc_id bigint, text string): class_id, the least id of the documents that links
    connect it with, and n_links, the number of other documents at the threshold or above."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    use = prefix_length(threshold, trees, depth, recall)
    signed = staged(docs.mapInArrow(_signature_rows(width, trees, depth, use), "doc_id bigint, digest binary, sig binary, keys array<bigint>"), "signatures")
    classes = staged(signed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys")), "classes")
    hashes = trees * depth
    least_equal = int(hashes * max(0.0, threshold - 5 * (threshold * (1 - threshold) / hashes) ** 0.5))
    nodes = classes.select("class_id", F.posexplode("keys").alias("tree", "key"))
    sizes = nodes.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    below = nodes.join(sizes, ["tree", "key"]).join(classes.select("class_id", "sig"), "class_id")
    dealt = in_block_pairs(below, ["tree", "key"], "class_id", F.col("size"), BLOCK)
    order = ["key", "tree", "lo", "hi"]
    # a node's rows in the order of their labels: the trie below the shortest prefix
    label = F.substring("sig", F.col("tree") * depth + use + 1, depth - use)
    links = dealt.select(*order, "side", "class_id", "sig").repartition(*order).sortWithinPartitions(*order, label).mapInArrow(_likely_links(least_equal, depth, use), "u bigint, v bigint")
    likely = staged(connected_components(links).withColumnRenamed("node", "class_id"), "likely")
    members = likely.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    candidates = likely.join(members, "component").join(classes.select("class_id", "copies"), "class_id")
    names = ["component", "size", "class_id", "copies"]
    texts = docs.select(F.col("doc_id").alias("class_id"), "text")
    sets = candidates.join(texts, "class_id").select(*names, "text").mapInArrow(_window_sets(width, names), "component bigint, size bigint, class_id bigint, copies bigint, windows binary")
    dealt = in_block_pairs(sets, ["component"], "class_id", F.col("size"), BLOCK)
    order = ["component", "lo", "hi"]
    found = staged(dealt.select(*order, "side", "class_id", "copies", "windows").repartition(*order).sortWithinPartitions(*order).mapInArrow(_verified(threshold), "u bigint, v bigint, links bigint"), "verified")
    linked = connected_components(found.select("u", "v")).withColumnRenamed("node", "class_id")
    counts = found.groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("links"))
    named = classes.select("digest", "class_id", "copies").join(linked, "class_id", "left").join(counts, "class_id", "left")
    named = named.select("digest", F.coalesce("component", "class_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = signed.select("doc_id", "digest").join(named, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    blank = docs.select("doc_id").distinct().join(result, "doc_id", "left")
    return blank.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
