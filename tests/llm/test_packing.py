"""Best-fit packing: a plain best-fit search, laws of every packing, and odd rows."""

import random
from collections import defaultdict

import pytest

from chargeload.llm import packing as pk

from .conftest import WORD


def plain_best_fit(sizes, lengths):
    """The same rules by linear search over the open bins."""
    bins, out, left = [], [], sum(sizes)  # [free, contents]
    for s in sizes:
        fits = [(b[0], -b[2], i) for i, b in enumerate(bins) if b[0] >= s]
        if fits:
            i = min(fits)[2]
        else:
            n = min((pk.bin_cost(n) / min(n, left), n) for n in lengths if n >= s)[1]
            bins.append([n, 0, 0])
            i = len(bins) - 1
        bins[i][0] -= s
        bins[i][1] += s
        bins[i][2] = len(out)  # the bin that took a piece last comes first among equals
        left -= s
        out.append(i)
    return out, [b[1] for b in bins], [min(n for n in lengths if n >= b[1]) for b in bins]


@pytest.mark.parametrize("seed", range(25))
def test_against_linear_search(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 120))), reverse=True)
    got = [x.tolist() for x in pk.best_fit(sizes, (16, 32, 64))]
    assert got == [list(x) for x in plain_best_fit(sizes, (16, 32, 64))]


def check_laws(df, rows, lengths=pk.LENGTHS):
    got = df.collect()
    spans, bins = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.start + r.n_tokens))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    want = defaultdict(list)
    for d, t in rows:
        n, k = len(WORD.findall(t or "")), 0
        want[d] += [(k, min(k + max(lengths), n)) for k in range(0, n, max(lengths))] or [(0, 0)]
    assert {d: sorted(x) for d, x in spans.items()} == {d: sorted(x) for d, x in want.items()}
    for pieces in bins.values():
        used = sum(r.n_tokens for r in pieces)
        assert {(r.bin_used, r.bin_length) for r in pieces} == {(used, min(n for n in lengths if n >= used))}
    return bins


def test_whole_small_table(documents):
    bins = check_laws(pk.pack_texts(documents), [(r.doc_id, r.text) for r in documents.collect()])
    assert sum(b[0].bin_used for b in bins.values()) > 0.93 * sum(b[0].bin_length for b in bins.values())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "w " * 20_000), (5, "v " * 4096), (6, " ")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bin_id int, grp string")
    check_laws(pk.pack_texts(df), rows)
    assert pk.pack_texts(df.limit(0)).count() == 0


def test_one_large_bin_or_several_small_ones():
    _, used, length = pk.best_fit([100], (128, 1024))
    assert (used.tolist(), length.tolist()) == ([100], [128])
    _, used, length = pk.best_fit([600, 500, 90, 10], (128, 1024))
    assert sum(used) == 1200 and all(u <= n for u, n in zip(used, length, strict=True))
