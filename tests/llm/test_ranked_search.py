"""Ranked search against scoring every document, and the block bounds by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chargeload.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in wanted.items():
        found = []
        for (d, b), n in zip(bags, sizes, strict=True):
            if n:
                m = 75 + (25 * n * n_docs) // n_terms
                s = sum(c * w[t] * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in q.items() if b[t])
                if s > 0:
                    found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in rs.ranked_search(docs, items, **options).collect()), key=str)


ODD = [(1, "Alpha beta gamma"), (2, None), (3, ""), (None, "alpha alpha"), (None, "ALPHA alpha"), (4, "alpha beta"), (4, "alpha beta"), (5, "ÄPFEL äpfel Äpfel 42"),
       (6, "!!! ... \n"), (7, "delta " * 5000), (8, "x" * 100_000 + " alpha"), (9, "alpha\x00beta\x7fgamma"), (10, "alpha_beta-gamma`delta{alpha")]
ITEMS = [(0, "alpha BETA beta"), (1, None), (2, ""), (3, "nowhere"), (None, "gamma"), (None, "delta delta"), (5, "äpfel 42"), (5, "alpha"), (6, "x" * 100_000)]


def test_odd_rows(spark):
    assert found(spark, ODD, ITEMS) == brute(ODD, ITEMS)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == [] and found(spark, ODD, []) == [] and found(spark, [], []) == []


@pytest.mark.parametrize("seed", range(3))
def test_small_parts_and_blocks_ties_and_rounds(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.choice([3, 10, 40])))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(200)]  # a group of copies
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, part_postings=300, block=4) == want
    assert found(spark, docs, items, round_terms=20, block=8) == want


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "z"), (2, "a", 8, "y")], "doc_id int, text string, score int, item_id string")
    items = spark.createDataFrame([(1, "a", 3)], "item_id int, text string, rank int")
    assert sorted(tuple(r) for r in rs.ranked_search(docs, items).collect()) == brute([(1, "a b"), (2, "a")], [(1, "a")])


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(3)
    size, n = 50, 3000
    topic = rng.integers(0, 10, n)  # documents of a topic share terms
    rows = [np.unique(np.concatenate([t * 5 + rng.integers(0, 5, 4), rng.integers(0, size, 1)])) for t in topic]
    edges = np.cumsum([0, *[len(r) for r in rows]])
    term = np.concatenate(rows)
    value = rng.integers(1, 900_000, len(term))
    weights = rng.integers(1, 9000, size)
    index = rs.PartIndex(edges, term, value, weights, None, 32)
    items = [(np.unique(rng.integers(0, size, 5)), None) for _ in range(30)]
    items = [(t, weights[t] * 1) for t, _ in items]
    every = np.zeros((n, size), np.int64)
    for d, r in enumerate(rows):
        every[d, r] = value[edges[d]: edges[d + 1]]
    best, seen = [rs.Best(20) for _ in items], Counter()
    for t, f in items:
        blocks, bound = index.bounds(t, f)
        exact = every[:, t] @ f
        for b, top in zip(blocks, bound, strict=True):
            assert exact[index.docs[index.starts[b]: index.ends[b]]].max() <= top
    rs.search_part(index, np.arange(n), np.zeros(n, bool), items, best, seen)
    for (t, f), top in zip(items, best, strict=True):
        exact = every[:, t] @ f
        order = np.lexsort((np.arange(n), -exact))[:20]
        assert top.ids.tolist() == order[exact[order] > 0].tolist()
    assert seen["skipped"] > seen["blocks"] // 10
