"""Near copies against all pairs by brute force."""

import random

import numpy as np
import pytest

from chargeload.llm import jaccard_join as jj
from chargeload.llm.components import connected_components

from .conftest import WORD


def windows(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    sets = {d: windows(t) for d, t in rows}
    links = {d: 0 for d in ids}
    name = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {d: new if n == old else n for d, n in name.items()}
    return [(d, name[d], links[d]) for d in ids]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jj.near_copies(df, **options).collect())


def test_whole_small_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = found(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 10


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "x"), (6, "x"), (7, " ".join(map(str, range(100)))), (8, " ".join(map(str, range(99)))),
            (9, " ".join(map(str, range(80)))), (9, " ".join(map(str, range(80)))), (None, "x"), (10, "w " * 30_000), (11, "w " * 20_000)]
    assert found(spark, rows) == brute(rows)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 7)
    random.seed(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: random.randint(0, 180)] + [f"q{i}"] + base[190:] if i % 3 == 0 else base[: 100 + i % 7] + [f"r{i % 20}"] + base[101:])) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_prefix_is_shortened_until_the_recall_holds():
    lengths = [jj.prefix_length(0.8, 20, 5, r) for r in (0.9, 0.999, 0.9999, 0.9999999)]
    assert lengths == sorted(lengths, reverse=True)
    for r, k in zip((0.9, 0.999, 0.9999), lengths, strict=False):
        assert 1 - (1 - 0.8**k) ** 20 >= r


def test_tries_match_level_by_level():
    """All pairs that meet and are near end in one class, though deeper links spare most of the comparisons."""
    rng = np.random.default_rng(2)
    heads = rng.integers(0, 256, (3, 40)).astype(np.uint8)
    sig = heads[rng.integers(0, 3, 400)]
    noise = rng.random(sig.shape) < 0.05
    sig[noise] = rng.integers(0, 256, noise.sum())
    sig = sig[np.lexsort(sig[:, 2::-1].T)]  # as in a task: in the order of their labels
    label = sig[:, :3]
    pairs = lambda: jj._pair_blocks(np.zeros(400, int), False)
    got, compared = jj.match_by_level(sig, label, np.arange(400), pairs, 30)
    want = np.arange(400)
    for i, j in pairs():
        near = (sig[i] == sig[j]).sum(1) >= 30
        want = jj._join_labels(want, i[near], j[near])
    assert (got == want).all() and len(set(want.tolist())) == 3
    assert compared < 0.75 * 400 * 399 // 2  # pairs within a class that longer prefixes had linked
    one, few = jj.match_by_level(sig[:1].repeat(50, 0), label[:1].repeat(50, 0), np.arange(50), lambda: jj._pair_blocks(np.zeros(50, int), False), 30)
    assert (one == 0).all() and few == 49  # all are linked at whole labels: no prefix is shortened


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_paths_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5000, 5001)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(n + 1)} == {0}
    assert {got[1000 + i] for i in range(30)} == {1000}
    assert got[5001] == 5000
