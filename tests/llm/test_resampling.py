"""Importance resampling against plain counting and sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chargeload.llm import resampling as rp
from chargeload.llm.terms import crc32_spans

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, width=1):
    w = TERM.findall((text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[i: i + k]).encode()) % 10000 for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, width=1):
    every = [(d, *features(t, width)) for d, t in docs]
    s, t = Counter(f for _, _, fs in every for f in fs), Counter(f for x in target for f in features(x, width)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in s}
    rows = []
    for d, n, fs in every:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in fs)
        rows.append((d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = [(d, f, w, s, i + 1) for i, (d, _, f, w, s) in enumerate(order[: len(order) * 10 // 100])]
    rest = [(d, f, w, s, None) for d, _, f, w, s in order[len(drawn):]] + [(d, f, w, s, None) for d, n, f, w, s in rows if n < 20]
    return sorted(drawn + rest, key=str)


def found(spark, docs, target, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in rp.draw(docs, target, **options).collect()), key=str)


def some(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "über", "x1", "zeta", "the", "of", "日本", "q"] + [f"w{i}" for i in range(200)]
    return [(i, rng.choice([" ", "\n", "-", "\x00"]).join(rng.choices(words, k=rng.choice([5, 20, 30, 60])))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"run_rows": 40, "samples": 4, "segments": 13}, {"words": 2, "segments": 3}, {"words": 3, "run_rows": 7, "samples": 1}])
def test_against_counting(spark, options):
    docs, target = some(1, 500), [t for _, t in some(2, 30)] + [None, ""]
    assert found(spark, docs, target, **options) == brute(docs, target, options.get("words", 1))


def test_odd_rows_and_ties(spark):
    long = " ".join(["tie"] * 25)
    docs = [(1, None), (2, ""), (None, long), (None, long), (None, "tie " * 30), (3, "x" * 100_000), (4, "y " * 50_000), (5, "!?"), *[(7, long)] * 60, *some(4, 40)]
    for options in ({}, {"run_rows": 9, "samples": 3, "segments": 11}):
        assert found(spark, docs, ["tie und tie", None], **options) == brute(docs, ["tie und tie", None])


def test_empty_tables(spark):
    docs = some(5, 30)
    assert found(spark, [], ["a"]) == [] and found(spark, docs, []) == brute(docs, [])


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a " * 25, 5, "r")], "doc_id int, text string, score int, run string")
    target = spark.createDataFrame([("a", 1)], "text string, doc_id int")
    assert [tuple(r)[:2] for r in rp.draw(df, target).collect()] == [(1, 25)]


def test_segments_are_even_and_part_ties():
    n = 20_000
    score = np.where(np.arange(n) % 3 == 0, 5, np.random.default_rng(1).integers(0, 1000, n))
    run = np.arange(n) % 8
    zero = np.zeros(n, np.int64)
    keys = (score, zero.astype(bool), zero, zero, run, np.arange(n) // 8)
    order = rp._order(*keys)
    place = np.empty(n, np.int64)
    for r in range(8):  # places in each sorted run
        mine = order[run[order] == r]
        place[mine] = np.arange(len(mine))
    keys = (*keys[:5], place)
    marked = place % 16 == 0
    cuts = tuple(k[marked][rp._order(*(x[marked] for x in keys))] for k in keys)
    at = np.arange(1, 20) * len(cuts[0]) // 20
    part = rp.segment_of(keys, tuple(c[at] for c in cuts))
    assert np.bincount(part).max() <= n / 20 + 8 * 16  # though a third of all rows tie
    assert (np.diff(part[rp._order(*keys)]) >= 0).all()


def test_crc32_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.choice([0, 1, 3, 8, 47, 48, 49, 50, 900], 300)
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
