"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end token a text. The token before names the context
restaurant: 8 bits of its ending and 8 bits of a hash of the whole word, 65,536 restaurants in
all, so that their totals have a proven size while every (context, word) pair of the corpus is
counted. The 256 contexts with one ending share a parent restaurant, and all parents share the root,
whose base is uniform over the training vocabulary and one unknown word.

Seating: a restaurant's customers for a word sit at tables; each table is one customer of the
parent. A Gibbs sweep lets the customers of every (restaurant, word) leave and re-enter one
after the other by the Chinese-restaurant rule, given the rest of the seating of the sweep before
(all restaurants at once; beyond 24 customers in blocks of an eighth of those seated). Discounts
come from the counts of words seen once and twice. After `burn_in` sweeps the predictive
probabilities of each sweep are averaged; their logarithm is the token's score.

Spark's part: counts of (word, context) pairs are added up in buckets by pair and meet in buckets by
predicted word, where all seatings of that word are local. The places (a document's number of a pair) stay
apart as many rows; they meet the pairs' probabilities at the end, a large bucket in several parts. A sweep is one job over the staged counts that returns tables per restaurant
(65,536 + 256 + 1 sums); a later sweep replays the earlier ones from these totals and its seeds, so
no seating is stored and a lost executor only repeats its buckets. Documents' sums go packed
to the document's bucket; they travel as whole multiples of 2^-30.

Defined cases: null and blank texts are the end token alone; every row is a document of its own, also rows that share an
id; rows without id are used for training. Without training tokens every token is unknown.
Draws depend on the number of buckets: name it for the same scores under any ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .packed import PACKED, bucket_count, pack, packed_rows, per_bucket, split_by_bucket, unpack
from .textblocks import ASCII_LOWER, mix, prefix_sums, span_hash, utf8_blocks, words

SWEEPS, BURN_IN, SEED = 4, 2, 17
STRENGTH = (0.5, 0.5, 0.5)  # root, endings, contexts
FLUSH = 1_500_000  # tokens that a map task holds before it sends them
MANY_CONTEXTS = 1000  # contexts of a word in one task, beyond which many tasks add up its counts
PART_BYTES = 32 << 20  # packed places that are scored as one part of a bucket
_UNIT = 2.0**-30
_END = np.uint64(0x51ED270B0A1F3C29)
_START_CONTEXT = 0xFFFF
_NO_ID = -(1 << 63)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True


def block_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, context and row of every token of a block of texts, end tokens included."""
    data = ASCII_LOWER[data]
    start, end, row = words(data, offsets)
    n_rows = len(offsets) - 1
    sums = prefix_sums(data)
    stem = end.copy()
    for _ in range(3):
        stem -= (stem - 1 > start) & _PUNCTUATION[data[stem - 1]] if len(stem) else 0
    last = data[stem - 1].astype(np.uint64) if len(stem) else np.zeros(0, np.uint64)
    before = data[np.maximum(stem - 2, start)].astype(np.uint64) if len(stem) else last
    ending = mix(last << np.uint64(8) | before) & np.uint64(255)
    context = (ending << np.uint64(8) | (span_hash(sums, start, stem) & np.uint64(255))).astype(np.uint16)
    at = np.arange(len(start)) + row
    ends = np.cumsum(np.bincount(row, minlength=n_rows)) + np.arange(n_rows)
    h = np.full(len(start) + n_rows, _END, np.uint64)
    h[at] = span_hash(sums, start, end)
    rows = np.empty(len(h), np.int64)
    rows[at], rows[ends] = row, np.arange(n_rows)
    previous = np.full(len(h), _START_CONTEXT, np.uint16)
    previous[at + 1] = context
    previous[np.append(0, ends[:-1] + 1)[:n_rows]] = _START_CONTEXT
    return h, previous, rows


def _token_rows(buckets: int):
    """Places by word bucket: a document's occurrences of a (word, context) are one entry with their number. Documents go by
    the numbers of their rows; what ids these have goes to the rows' buckets, counted down from -1."""
    def flush(held):
        h, context, doc = (np.concatenate([x[i] for x in held]) for i in range(3))
        ids, held_out, names = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5))
        for b, at in split_by_bucket((mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets):
            yield -1 - b, pack(np.diff(ids[at], prepend=0), names[at])
        for b, at in split_by_bucket((h % np.uint64(buckets)).astype(np.int64), buckets):
            at = at[np.lexsort((context[at], h[at]))]  # stable: documents stay in order
            new_word = _changes(h[at])
            new_pair = new_word | _changes(context[at])
            place = np.flatnonzero(new_pair | _changes(doc[at]))
            pair = np.flatnonzero(new_pair)
            docs, which = np.unique(doc[at][place], return_inverse=True)
            yield b, pack(h[at][np.flatnonzero(new_word)], _lengths(new_word[pair]), context[at][pair], _lengths(new_pair[place]), which.astype(np.uint16 if len(docs) < 65536 else np.uint32),
                          np.diff(np.append(place, len(at))).astype(np.uint32), np.diff(ids[docs], prepend=0), held_out[docs])

    def run(batches):
        def parts():
            held, n, docs = [], 0, 0
            number = TaskContext.get().partitionId() << 33  # of the task's next row
            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                held_out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                for lo, hi, data, offsets in utf8_blocks(batch, "text"):
                    h, context, row = block_tokens(data, offsets)
                    held.append((h, context, (row + docs).astype(np.int32), np.arange(number, number + hi - lo), held_out[lo:hi], ids[lo:hi]))
                    n, docs, number = n + len(h), docs + hi - lo, number + hi - lo
                    if n >= FLUSH:
                        yield from flush(held)
                        held, n, docs = [], 0, 0
            if held:
                yield from flush(held)
        yield from packed_rows(parts())

    return run


def _changes(x: np.ndarray) -> np.ndarray:
    return np.append(True, x[1:] != x[:-1])


def _lengths(first: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin where `first` is true."""
    return np.diff(np.append(np.flatnonzero(first), len(first))).astype(np.uint32)


def _merged(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, training count), each pair once and in order."""
    h, context, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((context, h))
    h, context = h[order], context[order]
    first = np.flatnonzero(_changes(h) | _changes(context))
    return h[first], context[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _pack_pairs(h: np.ndarray, context: np.ndarray, counts: np.ndarray) -> bytes:
    new_word = _changes(h)
    return pack(h[new_word], _lengths(new_word), context, counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64))


def _unpacked_pairs(blobs) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(np.repeat(word, per_word), context, counts) for word, per_word, context, counts in blobs]


def _pair_rows(buckets: int):
    """Training counts by (word, context), to the word's bucket; those of a word with many contexts to buckets of the pairs,
    so that the counts of one frequent word are added up in many tasks."""
    def flush(held):
        h, context, counts = _merged(held)
        per_word = _lengths(_changes(h))
        spread = np.where(np.repeat(per_word, per_word) > MANY_CONTEXTS, mix(h + context), h)
        for b, at in split_by_bucket((spread % np.uint64(buckets)).astype(np.int64), buckets):
            yield b, _pack_pairs(h[at], context[at], counts[at])

    def run(batches):
        def parts():
            held, n = [], 0
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    word, per_word, context, per_pair, place, counts, _, held_out = unpack(blob)
                    pair = np.repeat(np.arange(len(context)), per_pair)
                    held.append((np.repeat(word, per_word), context, np.bincount(pair, counts * ~held_out[place], minlength=len(context)).astype(np.int64)))
                    n += len(context)
                    if n >= FLUSH:
                        yield from flush(held)
                        held, n = [], 0
            if held:
                yield from flush(held)
        yield from packed_rows(parts())

    return run


def _pair_sums(buckets: int):
    def run(_bucket, blobs):
        h, context, counts = _merged(_unpacked_pairs(blobs))
        yield from packed_rows((b, _pack_pairs(h[at], context[at], counts[at])) for b, at in split_by_bucket((h % np.uint64(buckets)).astype(np.int64), buckets))

    return run


def _count_rows(bucket, blobs):
    """A bucket's words and their counts (`model`: contexts a word, contexts, training counts)."""
    h, context, counts = _merged(_unpacked_pairs(blobs))
    new_word = _changes(h)
    model = pack(_lengths(new_word), context, counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack(h[new_word])], pa.binary()), pa.array([model], pa.binary())], names=["bucket", "words", "model"])


# ---- seating --------------------------------------------------------------------------------

def seat(rng: np.random.Generator, customers: np.ndarray, strength: np.ndarray, discount: float, parent: np.ndarray) -> np.ndarray:
    """Tables after all `customers` of each (restaurant, word) have sat down one after the other. strength: that of the
    restaurant with the discounts of its other tables; parent: the word's probability in the parent restaurant."""
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        block = 1 if seated < 24 else seated // 8
        c, t = customers[live], tables[live]
        new = (strength[live] + discount * t) * parent[live]
        chance = np.clip(new / (new + np.maximum(seated - discount * t, 1e-9)), 0.0, 1.0)
        if block == 1:
            tables[live] += rng.random(len(live)) < chance
        else:
            tables[live] += rng.binomial(np.minimum(block, c - seated), chance)
        seated += block
        live = live[c > seated]
    return tables


class Bucket:
    """Counts and seating of one bucket's words in the three levels."""

    def __init__(self, model: tuple, base: float, discounts: tuple[float, float, float]):
        per_word, context, counts = model
        self.word = np.repeat(np.arange(len(per_word)), per_word)
        self.context = context.astype(np.int64)
        self.counts = counts.astype(np.int64)
        pairs, self.up = np.unique(self.word << 8 | self.context >> 8, return_inverse=True)
        self.pair_word, self.ending = pairs >> 8, pairs & 255
        self.word_counts = np.bincount(self.word, self.counts, minlength=len(per_word)).astype(np.int64)
        self.base, self.discounts = base, discounts
        self._seat_up(np.minimum(self.counts, 1), lambda c, *_: np.minimum(c, 1))

    def _seat_up(self, tables: np.ndarray, sit) -> None:
        self.t2 = tables
        self.c1 = np.bincount(self.up, self.t2, minlength=len(self.pair_word)).astype(np.int64)
        self.t1 = sit(self.c1, 1)
        self.c0 = np.bincount(self.pair_word, self.t1, minlength=len(self.word_counts)).astype(np.int64)
        self.t0 = sit(self.c0, 0)

    def probabilities(self, g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities in the root, by ending and by context, given all restaurants' totals."""
        d0, d1, d2 = self.discounts
        s0, s1, s2 = STRENGTH
        p0 = (self.c0 - d0 * self.t0 + (s0 + d0 * g["t0"]) * self.base) / (s0 + g["c0"])
        e, u = self.ending, self.context
        p1 = (self.c1 - d1 * self.t1 + (s1 + d1 * g["t1"][e]) * p0[self.pair_word]) / (s1 + g["c1"][e])
        p2 = (self.counts - d2 * self.t2 + (s2 + d2 * g["t2"][u]) * p1[self.up]) / (s2 + g["c2"][u])
        return p0, p1, p2

    def sweep(self, rng: np.random.Generator, g: dict) -> None:
        d0, d1, d2 = self.discounts
        s0, s1, s2 = STRENGTH
        p0, _, _ = self.probabilities(g)
        e, u = self.ending, self.context
        # the parent's probability without the customers that this restaurant sent to it
        rest = self.c1[self.up] - self.t2
        tables = np.minimum(self.t1[self.up], rest)
        parent = (rest - d1 * tables + (s1 + d1 * g["t1"][e][self.up]) * p0[self.pair_word][self.up]) / (s1 + np.maximum(g["c1"][e][self.up] - self.t2, 0))
        t2 = seat(rng, self.counts, s2 + d2 * (g["t2"][u] - self.t2), d2, parent)
        rest0 = self.c0[self.pair_word] - self.t1
        parent0 = (rest0 - d0 * np.minimum(self.t0[self.pair_word], rest0) + (s0 + d0 * g["t0"]) * self.base) / (s0 + np.maximum(g["c0"] - self.t1, 0))
        old1, old0 = self.t1, self.t0

        def sit(customers, level):
            if level == 1:
                return seat(rng, customers, s1 + d1 * (g["t1"][e] - old1), d1, parent0)
            return seat(rng, customers, s0 + d0 * (g["t0"] - old0), d0, np.full(len(customers), self.base))

        self._seat_up(t2, sit)

    def totals(self):
        """(kind, key, sum) of what the other buckets need to know."""
        def by(kind, key, value, n):
            sums = np.bincount(key, value, minlength=n).astype(np.int64)
            at = np.flatnonzero(sums)
            return np.full(len(at), kind), at, sums[at]
        parts = [by(0, self.context, self.counts, 65536), by(1, self.context, self.t2, 65536), by(2, self.ending, self.t1, 256), by(3, np.zeros(len(self.t0), np.int64), self.t0, 1)]
        seen = [int((self.word_counts > 0).sum()), *[int((x == k).sum()) for x in (self.c0, self.c1, self.counts) for k in (1, 2)]]
        return [np.concatenate(x) for x in zip(*parts, (np.full(7, 4), np.arange(7), np.array(seen)), strict=True)]


def _replayed(bucket: int, blob: bytes, history: list[dict], base: float, discounts):
    """The bucket after each sweep so far, the first seating included."""
    state = Bucket(unpack(blob), base, discounts)
    yield state
    for k, g in enumerate(history):
        state.sweep(np.random.default_rng([SEED, bucket, k]), g)
        yield state


def _total_rows(history: list[dict], base: float, discounts):
    def run(batches):
        held = []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("model").to_pylist(), strict=True):
                for state in _replayed(bucket, blob, history, base, discounts):
                    pass
                held.append(state.totals())
        if held:
            kind, key, value = (np.concatenate(x) for x in zip(*held, strict=True))
            both, at = np.unique(kind << 20 | key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((both >> 20).astype(np.int32)), pa.array((both & 0xFFFFF).astype(np.int32)), pa.array(np.bincount(at, value).astype(np.int64))], names=["kind", "key", "value"])

    return run


def _gather(state: DataFrame, history: list[dict], base: float, discounts) -> dict:
    """All restaurants' totals: at most 65,536 contexts twice, 256 endings and eight numbers."""
    rows = state.select("bucket", "model").mapInArrow(_total_rows(history, base, discounts), "kind int, key int, value bigint").groupBy("kind", "key").agg(F.sum("value").alias("value")).toArrow()
    kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
    out = []
    for k, n in enumerate((65536, 65536, 256, 1, 7)):
        x = np.zeros(n, np.int64)
        x[key[kind == k]] = value[kind == k]
        out.append(x)
    c2, t2, t1, t0, seen = out
    return {"c2": c2, "t2": t2, "c1": t2.reshape(256, 256).sum(1), "t1": t1, "c0": int(t1.sum()), "t0": int(t0[0]), "tokens": int(c2.sum()), "seen": seen.tolist()}


def _planes(units: np.ndarray) -> np.ndarray:
    """Whole multiples of the unit, by byte: the empty upper bytes of many numbers pack to nothing."""
    return np.ascontiguousarray(units.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<i8").ravel() * _UNIT


def _probability_rows(history: list[dict], base: float, discounts, burn_in: int):
    """A bucket's words, contexts, training counts of the words and scores of the (word, context) pairs."""
    def rows(batches):
        for batch in batches:
            for bucket, word, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "model")), strict=True):
                total, n = 0.0, 0
                for k, state in enumerate(_replayed(bucket, blob, history[:-1], base, discounts)):
                    if k >= burn_in or k == len(history) - 1 and not n:
                        total, n = total + state.probabilities(history[k])[2], n + 1
                per_word, context, _ = unpack(blob)
                yield bucket, pack(*unpack(word), per_word, context, state.word_counts, -np.log10(total / n))

    return lambda batches: packed_rows(rows(batches), 1)


def _score_rows(tokens: int, vocabulary: int, parts: int):
    """Sums by document, from rows in order of (bucket, part, kind): a part's probabilities come before its places."""
    def flush(held):
        ids, held_out, *sums = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(_changes(ids[order]))
        ids = ids[order][first]
        held_out = np.logical_or.reduceat(held_out[order], first)
        n_tokens, n_known, base_score, score = (np.add.reduceat(x[order], first) for x in sums)
        for b, at in split_by_bucket((mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts):
            yield b, pack(np.diff(ids[at], prepend=0), held_out[at], n_tokens[at].astype(np.uint32), n_known[at].astype(np.uint32), _planes(base_score[at]), _planes(score[at]))

    def sums(batches):
        held, n = [], 0
        for batch in batches:
            for kind, blob in zip(batch.column("kind"), batch.column("blob"), strict=True):
                if kind.as_py() == 0:
                    words_, per_word, context, count, score = unpack(blob.as_py())
                    keys = np.repeat(np.arange(len(words_)), per_word) << 16 | context
                    base_score = -np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                    continue
                word, per_word, context, per_pair, place, times, ids, held_out = unpack(blob.as_py())
                at = np.repeat(np.searchsorted(words_, word), per_word)
                pair = np.searchsorted(keys, at << 16 | context)
                # one sum for each id, as whole multiples of the unit: later sums are exact in any order
                ids, which = np.unique(np.cumsum(ids), return_inverse=True)
                out = np.zeros(len(ids), bool)
                out[which] = held_out
                values = (None, (count > 0)[at], base_score[at], score[pair])
                found = [np.bincount(which[place], times if v is None else times * np.repeat(v, per_pair), minlength=len(ids)) for v in values]
                held.append((ids, out, *[x.astype(np.int64) for x in found[:2]], *[np.rint(x / _UNIT).astype(np.int64) for x in found[2:]]))
                n += len(ids)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return lambda batches: packed_rows(sums(batches))


def _with_probabilities(places: DataFrame, probabilities: DataFrame, buckets: int) -> DataFrame:
    """Both sides by (bucket, part): a bucket with many bytes of places is dealt to many parts, each with its own copy of the probabilities."""
    parts = F.broadcast(places.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("blob")) / F.lit(PART_BYTES)).cast("int").alias("parts")))  # a row per bucket
    left = places.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("blob"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "blob")
    right = probabilities.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "blob")
    return left.unionByName(right).repartitionById(buckets, ((F.col("bucket") + F.col("part")) % buckets).cast("int")).sortWithinPartitions("bucket", "part", "kind")


def _document_rows(_bucket, blobs):
    named = [b for b in blobs if len(b) == 2]
    blobs = [b for b in blobs if len(b) > 2]
    numbers, names = np.concatenate([np.cumsum(b[0]) for b in named]), np.concatenate([b[1] for b in named])
    order = np.argsort(numbers)
    ids, which = np.unique(np.concatenate([np.cumsum(b[0]) for b in blobs]), return_inverse=True)
    held_out = np.zeros(len(ids), bool)
    held_out[which] = np.concatenate([b[1] for b in blobs])
    n_tokens, n_known, base_score, score = (np.bincount(which, np.concatenate([f(b[k]) for b in blobs])) for k, f in ((2, np.asarray), (3, np.asarray), (4, _from_planes), (5, _from_planes)))
    ids = names[order][np.searchsorted(numbers[order], ids)]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(held_out), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(-base_score), pa.array(-score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def discount(once: int, twice: int) -> float:
    """The leave-one-out estimate, kept inside (0, 1)."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def score_texts(docs: DataFrame, held_out: Column, sweeps: int = SWEEPS, burn_in: int = BURN_IN, buckets: int | None = None) -> DataFrame:
    """Scores of every text of `docs` (doc_id bigint, text string): the model learns from rows where `held_out` is not true.
    The seating's draws depend on `buckets`, by default the session's number of shuffle partitions."""
    buckets = buckets or bucket_count(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sent = staged(rows.mapInArrow(_token_rows(buckets), PACKED), "places")
    places, names = sent.where("bucket >= 0"), sent.where("bucket < 0").select((-1 - F.col("bucket")).cast("int").alias("bucket"), "blob")
    pairs = per_bucket(places.mapInArrow(_pair_rows(buckets), PACKED), buckets, _pair_sums(buckets), PACKED)
    state = staged(per_bucket(pairs, buckets, _count_rows, "bucket int, words binary, model binary"), "counts")
    history = [_gather(state, [], 1.0, (0.5, 0.5, 0.5))]
    vocabulary, *seen = history[0]["seen"]
    base = 1.0 / (vocabulary + 1)
    discounts = tuple(discount(seen[2 * k], seen[2 * k + 1]) for k in range(3))
    for _ in range(sweeps):
        history.append(_gather(state, history, base, discounts))
    probabilities = state.mapInArrow(_probability_rows(history, base, discounts, burn_in), PACKED)
    sums = _with_probabilities(places, probabilities, buckets).mapInArrow(_score_rows(history[0]["tokens"], vocabulary, buckets), PACKED)
    out = per_bucket(sums.unionByName(names), buckets, _document_rows, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(history[0]["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
