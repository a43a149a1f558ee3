"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeload.llm import ann

from .conftest import SF


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    queries = {}
    for i, v in ok:
        if i % 50 == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    for q, v in queries.items():
        near = sorted((-float(ann.cosines(v[None], x[None])[0]), i) for i, x in ok if i != q and len(x) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())


def test_whole_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    assert found(df) == brute([(r.vec_id, r.vector) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 1.0]), (10, [1.0, 1.0]), (11, [5.0, 0.0]), (12, [1.0, -1.0]), (13, [-1.0, 0.0]), (50, [1.0]), (100, [0.5, 0.5]), (0, [1.0, 0.0]), (14, [7.0, 0.0]), (15, [1e-3, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    assert found(df) == brute(rows)


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.5]) for i in range(301)]
    assert found(spark.createDataFrame(rows, "vec_id long, vector array<double>")) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "vec_id long, vector array<double>")) == []


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, 200, 24)) * rng.lognormal(size=(2, 200, 24))
    (aq, as_, an, ae), (bq, bs, bn, be) = ann.quantised(a), ann.quantised(b)
    near = (aq.astype(float) * bq).sum(1) * as_ * bs
    bound = ae * bn + an * be + ae * be
    assert (np.abs(near - ann.cosines(a, b)) <= bound).all()


def test_huge_and_tiny_components(spark):
    base = [(0, [1.0, 2.0, -0.5]), (1, [2.0, 1.0, 0.25]), (2, [-1.0, 0.5, 3.0]), (3, [0.125, 0.125, 0.125]), (50, [1.0, 1.0, 1.0]), (51, [1.0, 2.0, -0.5])]
    plain = found(spark.createDataFrame(base, "vec_id long, vector array<double>"))
    for powers in ([664, -664, 0, 700, -700, 1000], [-1000, -1000, 900, 0, 664, -1]):
        rows = [(i, [float(np.ldexp(x, p)) for x in v]) for (i, v), p in zip(base, powers, strict=True)]
        assert found(spark.createDataFrame(rows, "vec_id long, vector array<double>")) == plain
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e-200])]
    got = found(spark.createDataFrame(rows, "vec_id long, vector array<double>"))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2)] and [r[3] for r in got] == pytest.approx([1.0, 0.5 ** 0.5])


def test_vectors_travel_a_root_of_the_cells():
    for n in (1, 10_000, 1_000_000, 10**9):
        down, across = ann.grid(n, 1)
        assert down * across >= n // ann.GROUP_ROWS and max(down, across) <= (n / ann.GROUP_ROWS) ** 0.5 + 1
    assert ann.grid(100, 6) == (2, 3)


def test_a_wide_grid_gives_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    want = found(df)
    monkeypatch.setattr(ann, "GROUP_ROWS", 20)
    monkeypatch.setattr(ann, "TILE", 7)
    assert found(df) == want
