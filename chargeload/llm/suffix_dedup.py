"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of `width` bytes that covers it also starts in a document with a
smaller id. Steps:

1. Every window of `width` bytes picks an anchor: the leftmost of the `GRAM`-byte strings inside
   it with the least hash. Equal windows pick equal anchors, and about one byte in sixteen is
   an anchor. Anchors meet by hash; those found under one id only can't repeat and go.
2. Around each anchor that stays, the segment of all windows that picked it goes to the
   anchor's bucket. Equal segments of one flush travel once, with their places.
3. A bucket's segments are suffix-sorted in two stages: suffixes smaller than their successors
   are sorted directly, the others are induced by bucket scans. Adjacent
   common prefixes of `width` or more form groups of equal windows, whose least
   document id owns them.
4. Places owned by a smaller id return to their document as spans.

Windows are equal if their bytes are. Which segments of a flush are the same, and which row of an id a
span belongs to, is told by 64-bit hashes of whole segments and texts. Whole copies of a document
with a smaller id are found by SHA-256 beforehand and go as one span; other rows of the copy's id
are treated like any other.

Defined cases: null text is empty; rows with a null id neither own nor lose bytes; rows
with one id never remove each other; texts shorter than `width` stay; other columns pass
through; an existing column named like the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, without
from .packed import PACKED, bucket_count, pack, packed_rows, per_bucket, split_by_bucket
from .textblocks import mix, prefix_sums, span_hash, utf8_blocks, window_hash

WIDTH = 50
GRAM = 20
FLUSH = 1_000_000  # anchors that a map task holds before it sends them; a quarter as many segments
BLOCK = 1 << 20  # bytes of text scanned at once
PLACES = 20_000  # places of segments whose windows are looked up at once
SORT_BYTES = 1 << 20  # bytes of segments sorted at once, unless one anchor has more
_H48 = np.uint64((1 << 48) - 1)
_SPANS = "spans array<struct<start: bigint, end: bigint>>"


# ---- suffix sorting -------------------------------------------------------------------------

def byte_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the text."""
    n = len(text)
    padded = np.zeros((n + 15) // 8 * 8 + 8, np.uint8)
    padded[:n] = text
    out = np.zeros(n + 64, np.uint64)
    for r in range(min(8, n)):
        part = padded[r: r + (n - r + 7) // 8 * 8].view(">u8")
        out[r: n: 8] = part
    return out


def _smaller_than_successor(text: np.ndarray) -> np.ndarray:
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(change, np.arange(n))
    inside = nxt < len(change)
    out = np.zeros(n, bool)
    at = change[nxt[inside]]
    out[inside] = text[at] < text[at + 1]
    return out


def _direct_sort(start: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes: sort by eight bytes, then only what is still tied by the next eight."""
    start = start[np.argsort(keys[start], kind="stable")]
    if len(start) < 2:
        return start
    first = np.ones(len(start), bool)
    first[1:] = keys[start[1:]] != keys[start[:-1]]
    for skip in range(8, depth, 8):
        group = np.cumsum(first)
        tied = np.flatnonzero(~first | np.append(~first[1:], False))
        if not len(tied):
            break
        part, gid = start[tied], group[tied]
        key = keys[part + skip]
        order = np.lexsort((key, gid))
        part, key = part[order], key[order]
        start[tied] = part
        split = np.zeros(len(tied), bool)
        split[1:] = (gid[1:] == gid[:-1]) & (key[1:] != key[:-1])
        first[tied] |= split
    return start


def suffix_order(text: np.ndarray, depth: int = WIDTH, keys: np.ndarray | None = None) -> np.ndarray:
    """Positions of `text` in the order of their suffixes, compared over at least `depth` bytes (two-stage sorting)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    keys = byte_words(text) if keys is None else keys
    small = _direct_sort(np.flatnonzero(_smaller_than_successor(text)), keys, depth)
    small_edges = np.searchsorted(text[small], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1], np.int64))
    out = []
    for c in range(256):
        queue = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        scan = [queue]
        while len(queue):  # predecessors with the same byte belong to this bucket, in scan order
            before = queue[queue > 0] - 1
            queue = before[text[before] == c]
            scan.append(queue)
        scan.append(small[small_edges[c]: small_edges[c + 1]])
        bucket = np.concatenate(scan)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        edges = np.searchsorted(byte, np.arange(257))
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            induced[b].append(before[edges[b]: edges[b + 1]])
    return np.concatenate(out)


def common_prefixes(keys: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix lengths, up to `width`, of neighbours in `order`; the first has 0."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for skip in range(0, width, 8):
        if not len(live):
            break
        differ = keys[order[live] + skip] ^ keys[order[live - 1] + skip]
        same = np.full(len(live), 8, np.int64)
        for b in range(8):
            same -= (differ >> np.uint64(8 * b)) != 0
        out[live] += same
        live = live[same == 8]
    return np.minimum(out, width)


# ---- anchors and segments -------------------------------------------------------------------

def segments(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, first window start, end of the last window) of every anchor of a block."""
    gram = min(GRAM, width)
    reach = width - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none.astype(np.uint64), none, none
    grams = window_hash(prefix_sums(data), gram)
    bits = int(len(grams)).bit_length()
    low = np.uint64((1 << bits) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(grams) - reach + 1], least[reach - span:])
    rows = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - width + 1, 0))
    ends = np.cumsum(np.maximum(np.diff(offsets) - width + 1, 0))
    if not len(rows):
        return none, none.astype(np.uint64), none, none
    window = np.arange(len(rows)) - np.repeat(ends - np.maximum(np.diff(offsets) - width + 1, 0) - offsets[:-1], np.maximum(np.diff(offsets) - width + 1, 0))
    anchor = (least[window] & low).astype(np.int64)
    first = np.ones(len(window), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(window)) - 1
    return rows[at], grams[anchor[at]] & _H48, window[at], window[last] + width


def _batch_ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False), np.int64)


def _anchor_rows(width: int, buckets: int):
    def flush(held):
        h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        for b, at in split_by_bucket((h % np.uint64(buckets)).astype(np.int64), buckets):
            yield b, pack((h[at] >> np.uint64(32)).astype(np.uint16), h[at].astype(np.uint32), np.diff(doc[at], prepend=0))

    def run(batches):
        def parts():
            held, n = [], 0
            for batch in batches:
                ids, keys = _batch_ids(batch, "doc_id"), _batch_ids(batch, "k")
                for lo, hi, data, offsets in utf8_blocks(batch, "text", BLOCK):
                    row, h, _, _ = segments(data, offsets, width)
                    # of equal texts in a block only the one with the least id can be a first occurrence
                    order = np.lexsort((ids[lo:hi], keys[lo:hi]))
                    least = np.ones(hi - lo, bool)
                    least[order[1:]] = keys[lo:hi][order[1:]] != keys[lo:hi][order[:-1]]
                    use = least[row]
                    held.append((h[use], ids[lo:hi][row[use]]))
                    n += int(use.sum())
                    if n >= FLUSH:
                        yield from flush(held)
                        held, n = [], 0
            if held:
                yield from flush(held)
        yield from packed_rows(parts())

    return run


def _binary(parts: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows of raw bytes: slices of a contiguous array between edges."""
    size = parts.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def _shared_anchors(buckets: int):
    """Anchors found under two ids or more, on their way to the documents that have them."""
    def shared_of(blobs):
        h = np.concatenate([(a.astype(np.uint64) << np.uint64(32)) | b for a, b, _ in blobs])
        doc = np.concatenate([np.cumsum(d) for _, _, d in blobs])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        shared = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        use = shared[np.cumsum(first) - 1]
        h, doc = h[use], doc[use]
        if not len(h):
            return
        for b, at in split_by_bucket(_doc_bucket(doc, buckets), buckets):
            at = at[np.argsort(doc[at], kind="stable")]
            yield b, pack(np.diff(doc[at], prepend=0), (h[at] >> np.uint64(32)).astype(np.uint16), h[at].astype(np.uint32))

    return lambda bucket, blobs: packed_rows(shared_of(blobs))


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _anchors_by_document(_bucket, blobs):
    doc = np.concatenate([np.cumsum(b[0]) for b in blobs])
    h = np.concatenate([(b[1].astype(np.uint64) << np.uint64(32)) | b[2] for b in blobs])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    for lo in range(0, len(edges) - 1, 5_000):
        e = edges[lo: lo + 5_001]
        yield pa.RecordBatch.from_arrays([pa.array(doc[e[:-1]]), _binary(h[e[0]: e[-1]], e - e[0])], names=["doc_id", "anchors"])


def take_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    total = int(lengths.sum())
    return data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]


def _segment_rows(width: int, buckets: int):
    def flush(held):
        h, mark, length, doc, key, start = (np.concatenate([x[i] for x in held]) for i in range(6))
        text = np.concatenate([x[6] for x in held])
        place = np.cumsum(length) - length
        for b, at in split_by_bucket((h % np.uint64(buckets)).astype(np.int64), buckets):
            _, once, which = np.unique(mark[at], return_index=True, return_inverse=True)
            n = length[at][once]
            yield b, pack(take_spans(text, place[at][once], n), n.astype(np.uint32), h[at][once], which.astype(np.uint32), np.diff(doc[at], prepend=0), key[at], start[at].astype(np.uint32 if start.max() < 1 << 32 else np.int64))

    def run(batches):
        def parts():
            held, n = [], 0
            for batch in batches:
                ids, keys, lists = _batch_ids(batch, "doc_id"), _batch_ids(batch, "k"), batch.column("anchors")
                for lo, hi, data, offsets in utf8_blocks(batch, "text", BLOCK):
                    row, h, start, end = segments(data, offsets, width)
                    known = np.frombuffer(b"".join(lists[lo: hi].to_pylist()), np.uint64)
                    use = np.isin(h, known)
                    row, h, start, length = row[use], h[use], start[use], (end - start)[use]
                    if not len(h):
                        continue
                    held.append((h, span_hash(prefix_sums(data), start, start + length) + length.astype(np.uint64), length, ids[lo:hi][row], keys[lo:hi][row], start - offsets[row], take_spans(data, start, length)))
                    n += len(h)
                    if n >= FLUSH // 4:
                        yield from flush(held)
                        held, n = [], 0
            if held:
                yield from flush(held)
        yield from packed_rows(parts())

    return run


def _window_owners(raw: np.ndarray, length: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """The least id among the segments that hold each window, for all windows of all segments in order."""
    # one byte between segments; windows never cross it, so its value doesn't matter
    at = np.cumsum(length + 1) - (length + 1)
    text = np.zeros(int((length + 1).sum()), np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(len(length)), length)] = raw
    windows = length - width + 1
    of = np.full(len(text), -1, np.int32)
    starts = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    of[starts] = np.repeat(np.arange(len(length), dtype=np.int32), windows)
    keys = byte_words(text)
    order = suffix_order(text, width, keys)
    order = order[of[order] >= 0]
    group = np.cumsum(common_prefixes(keys, order, width) < width) - 1
    owner = np.zeros(len(text), np.int64)
    owner[order] = np.minimum.reduceat(least[of[order]], np.flatnonzero(np.diff(group, prepend=-1)))[group]
    return owner[starts]


def _marks(raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the segments that lie one after the other in `raw`, a block at a time."""
    out = np.empty(len(at), np.uint64)
    cuts = np.append(np.flatnonzero(np.diff(at // BLOCK, prepend=-1)), len(at))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin = int(at[lo])
        sums = prefix_sums(raw[begin: int(at[hi - 1] + length[hi - 1])])
        out[lo:hi] = span_hash(sums, at[lo:hi] - begin, at[lo:hi] - begin + length[lo:hi])
    return out


def _removed_runs(owner: np.ndarray, at: np.ndarray, count: np.ndarray, doc: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, windows) of the runs of windows that a smaller id owns, for places with `count` windows from `at` on."""
    place = np.repeat(np.arange(len(at)), count)
    step = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    gone = owner[at[place] + step] < doc[place]
    place, step = place[gone], step[gone]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (step[1:] != step[:-1] + 1)
    i = np.flatnonzero(new)
    return place[i] + first, step[i], np.diff(np.append(i, len(place)))


def _owned_spans(width: int, buckets: int):
    def owned(blobs):
        """Suffix-sort a bucket's segments and give each document the spans that a smaller id owns."""
        length = np.concatenate([b[1].astype(np.int64) for b in blobs])
        anchor = np.concatenate([b[2] for b in blobs])
        base = np.cumsum([0, *[len(b[1]) for b in blobs]])
        seg = np.concatenate([b[3].astype(np.int64) + base[i] for i, b in enumerate(blobs)])
        doc = np.concatenate([np.cumsum(b[4]) for b in blobs])
        key = np.concatenate([b[5] for b in blobs])
        start = np.concatenate([b[6].astype(np.int64) for b in blobs])
        raw = np.concatenate([b[0] for b in blobs])
        # equal segments of several senders become one
        at = np.cumsum(length) - length
        mark = _marks(raw, at, length)
        order = np.lexsort((mark, anchor))
        new = np.append(True, (anchor[order[1:]] != anchor[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]]))
        to = np.empty(len(order), np.int64)
        to[order] = np.cumsum(new) - 1
        seg, once = to[seg], order[new]
        length, anchor, at = length[once], anchor[once], at[once]
        least = np.full(len(once), np.iinfo(np.int64).max)
        np.minimum.at(least, seg, doc)
        windows = length - width + 1
        # an anchor with one segment owns it whole; the windows of the others' segments are told apart by sorting
        alone = np.append(True, anchor[1:] != anchor[:-1])
        alone &= np.append(alone[1:], True)
        owner_at = np.cumsum(windows) - windows
        owner = np.repeat(least, windows)
        mixed = np.flatnonzero(~alone)  # in anchor order: parts end where an anchor does
        share = np.cumsum(length[mixed]) // SORT_BYTES
        share = share[np.searchsorted(anchor[mixed], anchor[mixed])]
        for part in np.split(mixed, np.flatnonzero(np.diff(share)) + 1) if len(mixed) else ():
            owner[np.repeat(owner_at[part] - (np.cumsum(windows[part]) - windows[part]), windows[part]) + np.arange(int(windows[part].sum()))] = _window_owners(take_spans(raw, at[part], length[part]), length[part], least[part], width)
        # places that a smaller id owns in part
        low = np.minimum.reduceat(owner, owner_at)
        open_ = low[seg] < doc
        seg, doc, key, start = seg[open_], doc[open_], key[open_], start[open_]
        if not len(seg):
            return
        found = [_removed_runs(owner, owner_at[seg[lo: lo + PLACES]], windows[seg[lo: lo + PLACES]], doc[lo: lo + PLACES], lo) for lo in range(0, len(seg), PLACES)]
        p, step, size = (np.concatenate(x) for x in zip(*found, strict=True))
        d, k, begin, size = doc[p], key[p], start[p] + step, size + width - 1
        for b, at in split_by_bucket(_doc_bucket(d, buckets), buckets):
            yield b, pack(np.diff(d[at], prepend=0), k[at], begin[at], size[at])

    return lambda bucket, blobs: packed_rows(owned(blobs))


def _spans_by_document(_bucket, blobs):
    doc = np.concatenate([np.cumsum(b[0]) for b in blobs])
    key, begin, size = (np.concatenate([b[i] for b in blobs]) for i in (1, 2, 3))
    order = np.lexsort((begin, key, doc))
    d, k = doc[order], key[order]
    spans = np.stack([begin[order], begin[order] + size[order]], 1)
    edges = np.append(np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))), len(d))
    parts = [union_spans(spans[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    for lo in range(0, len(parts), 5_000):
        at = edges[:-1][lo: lo + 5_000]
        yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(k[at]), pa.array([x.astype(np.int64).tobytes() for x in parts[lo: lo + 5_000]], pa.binary())], names=["doc_id", "k", "spans"])


def union_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by (start, end) pairs, in order; touching pairs join."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


def _kept_rows(width: int, as_text: bool):
    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rest = [n for n in batch.schema.names if n not in ("marks", "k")]
            texts, marks, keys = batch.column("text"), batch.column("marks"), batch.column("k").to_pylist()
            n_bytes, kept, spans = [], [], []
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                own = [m["spans"] for m in marks[i].as_py() or () if m["k"] == keys[i]]
                if None in own:  # a whole copy
                    runs = np.array([[0, len(raw)]] if len(raw) >= width else [], np.int64).reshape(-1, 2)
                else:
                    runs = union_spans(np.frombuffer(b"".join(own), np.int64).reshape(-1, 2))
                out, end = [], 0
                for a, b in runs.tolist():
                    out.append(raw[end:a])
                    end = b
                out.append(raw[end:])
                n_bytes.append(len(raw))
                kept.append("".join(x.decode("utf-8", "ignore") for x in out) if as_text else b"".join(out))
                spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
            result = pa.StructArray.from_arrays([pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["kept", "n_bytes", "spans"])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], result], names=[*rest, "dedup"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, as_text: bool = False) -> DataFrame:
    """`docs` (doc_id bigint, text string, any others) with a struct `dedup`: kept (binary: the bytes that
    stay; or their whole characters, as a string), n_bytes (of the text), spans (the maximal removed byte runs)."""
    spark, buckets = docs.sparkSession, bucket_count(docs.sparkSession)
    small_batches(spark)
    docs = without(docs, "dedup")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # the column itself where no cast is needed: a renaming would keep the two joins from sharing their exchange
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(doc_id, F.col("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others") if others else F.lit(1).alias("others"))
    named = rows.where(F.col("doc_id").isNotNull())
    # whole copies
    digests = staged(named.select("doc_id", "k", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")), "digests")
    # written before the join: Spark can then split the partition of a text with very many copies
    least = staged(digests.groupBy("digest").agg(F.min("doc_id").alias("least")), "least")
    copies = digests.join(least, "digest").where(F.col("doc_id") > F.col("least")).select("doc_id", "k").distinct()
    # shared anchors of the first documents with a text
    anchors = named.select("doc_id", "k", "text").mapInArrow(_anchor_rows(width, buckets), PACKED)
    shared = per_bucket(per_bucket(anchors, buckets, _shared_anchors(buckets), PACKED), buckets, _anchors_by_document, "doc_id bigint, anchors binary")
    by_id = named.repartition(buckets, "doc_id")
    # a row that is a whole copy sends nothing; other rows of its id do
    first = shared.join(copies.groupBy("doc_id").agg(F.collect_set("k").alias("gone")), "doc_id", "left")
    # both joins read the same exchange of the texts: all its columns, by doc_id alone
    kept_rows = by_id.join(first, "doc_id").where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("k"))).drop("gone")
    sent = kept_rows.mapInArrow(_segment_rows(width, buckets), PACKED)
    spans = per_bucket(per_bucket(sent, buckets, _owned_spans(width, buckets), PACKED), buckets, _spans_by_document, "doc_id bigint, k bigint, spans binary")
    marks = spans.union(copies.select("doc_id", "k", F.lit(None).cast("binary"))).groupBy("doc_id").agg(F.collect_list(F.struct("k", "spans")).alias("marks"))
    joined = by_id.join(marks, "doc_id", "left")
    unnamed = rows.where(F.col("doc_id").isNull()).withColumn("marks", F.lit(None).cast(joined.schema["marks"].dataType))
    columns = ["doc_id", "text", "others", "k", "marks"]
    joined = joined.select(*columns).unionByName(unnamed.select(*columns))
    schema = f"doc_id bigint, text string, others {joined.schema['others'].dataType.simpleString()}, dedup struct<kept: {'string' if as_text else 'binary'}, n_bytes: bigint, {_SPANS.replace(' array', ': array')}>"
    out = joined.mapInArrow(_kept_rows(width, as_text), schema)
    by_name = {c: F.col(f"others.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[by_name[c].alias(c) for c in docs.columns], "dedup")

