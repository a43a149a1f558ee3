"""Language-model scores: counts and base scores by brute force, and laws of the model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeload.llm import pitman_yor as py
from chargeload.llm.common import crc32_mod

from .conftest import WORD


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + ["\n"]


def brute(rows):
    train = Counter(t for d, x in rows if zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    return {d: (zlib.crc32(str(d).encode()) % 5 == 1, len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), n,
                sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for d, x in rows}


def scores(df):
    return {r.doc_id: r for r in py.score_texts(df, crc32_mod(F.col("doc_id"), 5) == 1).collect()}


def test_counts_and_base(documents):
    want, got = brute([(r.doc_id, r.text) for r in documents.collect()]), scores(documents.select("doc_id", "text"))
    assert set(got) == set(want)
    for d, (held_out, n, known, train, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The the THE"), (4, "Ärger ärger"), (4, "more of the same id"), (None, "no id"), (None, "no id"), (None, None), (6, "w " * 50_000), (4, "Ärger ärger")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = py.score_texts(df, crc32_mod(F.col("doc_id"), 5) == 1).collect()
    want = [(d, len(tokens(t))) for d, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) for r in got)
    for key in ((4, 3), (None, 3)):  # equal rows have equal scores
        assert len({(r.score, r.base_score, r.held_out) for r in got if (r.doc_id, r.n_tokens) == key}) == 1
    base = {t: b for (_, t), (_, _, _, _, b) in zip(rows, brute(enumerate_ids(rows)).values(), strict=True)}
    assert all(any(abs(r.base_score - b) < 1e-6 for b in base.values()) for r in got)


def enumerate_ids(rows):
    """The rows under ids of their own that are held out or not as theirs are."""
    used, out = set(), []
    for d, t in rows:
        held = d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        new = next(i for i in range(10_000) if i not in used and (zlib.crc32(str(i).encode()) % 5 == 1) == held)
        used.add(new)
        out.append((new, t))
    return out


def test_empty_tables(spark):
    assert scores(spark.createDataFrame([], "doc_id long, text string")) == {}
    held = spark.createDataFrame([(1, "all is held out")], "doc_id long, text string")
    (row,) = py.score_texts(held, F.lit(True)).collect()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)


def test_predictive_probabilities_sum_to_one():
    """One bucket with the whole vocabulary: for each context the words and one unknown make up 1, after any sweep."""
    rng = np.random.default_rng(5)
    per_word, contexts, counts = [], [], []
    all_contexts = np.array([3, 4, 260, 261, 900])
    for w in range(30):
        per_word.append(len(all_contexts))
        contexts += all_contexts.tolist()
        counts += rng.poisson(3 / (w + 1), len(all_contexts)).tolist()
    per_word.append(len(all_contexts))  # a word that training never saw
    contexts, counts = contexts + all_contexts.tolist(), counts + [0] * len(all_contexts)
    counts = np.array(counts)
    known = int((counts.reshape(31, 5).sum(1) > 0).sum())
    counts = counts.reshape(31, 5)
    rows = [r for r in counts if r.sum()] + [np.zeros(5, int)]
    model = (np.full(len(rows), 5, np.uint32), np.tile(all_contexts, len(rows)).astype(np.uint16), np.concatenate(rows).astype(np.uint32))
    b = py.Bucket(model, 1 / (known + 1), (0.4, 0.5, 0.6))
    for k in range(4):
        kind, key, value = b.totals()
        g = {"c2": np.zeros(65536), "t2": np.zeros(65536), "t1": np.zeros(256)}
        for name, i in (("c2", 0), ("t2", 1), ("t1", 2)):
            g[name][key[kind == i]] = value[kind == i]
        g |= {"c1": g["t2"].reshape(256, 256).sum(1), "c0": g["t1"].sum(), "t0": int(value[kind == 3].sum())}
        p0, _, p2 = b.probabilities(g)
        assert p0.sum() == pytest.approx(1)
        assert p2.reshape(len(rows), 5).sum(0) == pytest.approx(np.ones(5))
        assert (b.t2 <= b.counts).all() and (b.t2[b.counts > 0] >= 1).all()
        b.sweep(np.random.default_rng(k), g)


def test_seating_follows_the_restaurant_rule():
    """Mean tables of many restaurants against the exact chain of seating probabilities."""
    customers, strength, discount, parent = 12, 1.5, 0.5, 0.3
    seen = py.seat(np.random.default_rng(1), np.full(40_000, customers), np.full(40_000, strength), discount, np.full(40_000, parent)).mean()
    chance = {1: 1.0}
    for n in range(1, customers):
        nxt = Counter()
        for t, p in chance.items():
            new = (strength + discount * t) * parent
            q = new / (new + n - discount * t)
            nxt[t + 1] += p * q
            nxt[t] += p * (1 - q)
        chance = nxt
    assert seen == pytest.approx(sum(t * p for t, p in chance.items()), abs=0.03)


def test_a_frequent_word_fills_no_cell(spark, monkeypatch):
    """With four times the documents no staged cell is much larger, though one word is a third of all tokens."""
    monkeypatch.setattr(py, "FLUSH", 2_000)
    largest, write = {}, py.staged

    def noted(df, name):
        out = write(df, name)
        binary = [c for c, t in out.dtypes if t == "binary"]
        largest[n] = max(largest.get(n, 0), *out.agg(*[F.max(F.octet_length(c)) for c in binary]).first())
        return out

    monkeypatch.setattr(py, "staged", noted)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        for n in (4000, 16_000):
            scores(spark.createDataFrame([(i, f"the a{i % 7} b{i % 5} the the a{i % 3}") for i in range(n)], "doc_id long, text string"))
    finally:
        spark.conf.set(key, before)
    assert largest[16_000] < 1.5 * largest[4000]


def test_parts_of_a_bucket_change_nothing(spark, documents, monkeypatch):
    docs = documents.select("doc_id", "text").limit(300).cache()
    want = scores(docs)
    monkeypatch.setattr(py, "FLUSH", 3_000)
    monkeypatch.setattr(py, "PART_BYTES", 500, raising=False)
    got = scores(docs)
    assert set(got) == set(want)
    for d, r in want.items():
        assert got[d][:5] == r[:5]
        assert (got[d].base_score, got[d].score) == (pytest.approx(r.base_score, rel=1e-6), pytest.approx(r.score, rel=1e-6))


def test_a_named_number_of_buckets_gives_the_same_scores(spark, documents):
    docs = documents.select("doc_id", "text").limit(60).cache()
    got, key = [], "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        for n in ("3", "7"):
            spark.conf.set(key, n)
            got.append(sorted(tuple(r) for r in py.score_texts(docs, F.lit(False), buckets=5).collect()))
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1]
