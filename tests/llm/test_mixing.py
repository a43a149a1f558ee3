"""Source mixing: shares by a plain recursive rule, selection by brute force, odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chargeload.llm import mixing as mx

from .conftest import WORD


def fair_shares(budget, children):
    """Shares (exact fractions) of {name: (weight, capacity)}: exhausted children give all, the others share the rest."""
    out, open_ = {}, dict(children)
    budget = Fraction(min(budget, sum(c for _, c in children.values())))
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if budget * w / total >= c}
        if not full:
            return out | {n: budget * w / total for n, (w, _) in open_.items()}
        for n in full:
            out[n] = Fraction(open_.pop(n)[1])
            budget -= out[n]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_shares(spark, seed):
    rng = random.Random(seed)
    groups = {p: {f"n{i}": (rng.randint(1, 9), rng.choice([1, 5, 40, 10**9, rng.randint(1, 500)])) for i in range(rng.randint(1, 12))} for p in "abc"}
    budgets = {p: min(rng.choice([0, 3, 77, 1000, 10**10]), sum(c for _, c in g.values())) for p, g in groups.items()}
    df = spark.createDataFrame([(p, n, w, c, budgets[p]) for p, g in groups.items() for n, (w, c) in g.items()], "parent string, name string, weight long, capacity long, budget long")
    got = defaultdict(dict)
    for r in mx.share(df, ["parent"], "name").collect():
        got[r.parent][r.name] = r.granted
    for p, g in groups.items():
        want = fair_shares(budgets[p], g)
        assert sum(got[p].values()) == budgets[p]
        assert all(abs(got[p][n] - want[n]) < 1 and got[p][n] <= g[n][1] for n in g)


def selected(rows, granted, seed=mx.SEED):
    """{(doc_id, domain, lang, source): epochs} from each leaf's tokens."""
    out = Counter()
    for leaf, docs in rows.items():
        tokens = sum(docs.values())
        whole, rest = divmod(granted[leaf], tokens)
        before = 0
        for d in sorted(docs, key=lambda d: hashlib.md5(f"{seed}|{whole}|{'' if d is None else d}".encode()).hexdigest()):
            out[d, *leaf] = whole + (before < rest)
            before += docs[d]
    return Counter({k: n for k, n in out.items() if n})


def test_selection(spark, documents):
    leaves = defaultdict(Counter)
    for r in documents.collect():
        n = len(WORD.findall(r.text or ""))
        if n:
            leaves[f"d{int(r.source[3:]) % 4}", r.lang, r.source][r.doc_id] += n
    df = spark.createDataFrame([(*leaf, sum(d.values())) for leaf, d in leaves.items()], "domain string, lang string, source string, tokens long")
    granted = {(r.domain, r.lang, r.source): r.granted for r in mx.leaf_budgets(df, F.expr("total div 5 * 4")).collect()}
    total = sum(sum(d.values()) for d in leaves.values())
    assert sum(granted.values()) == total // 5 * 4
    got = Counter((r.doc_id, r.domain, r.lang, r.source) for r in mx.select_epochs(documents).collect())
    assert got == selected(leaves, granted)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.granted for r in mx.leaf_budgets(leaves, F.lit(700), 1, {"domain": {"d0": 1, "d1": 1}}).collect()}
    assert got == {"a": 10, "b": 340, "c": 350}
    got = {r.source: r.granted for r in mx.leaf_budgets(leaves.where("source <> 'b'"), F.lit(700), 1, {}).collect()}
    assert got == {"a": 10, "c": 690}


def test_odd_rows(spark):
    rows = [(1, None, "en", "src1"), (2, "", "en", "src1"), (3, "a b c", None, None), (3, "a b c", None, None), (None, "d e", "xx", "web"), (4, "f " * 50_000, "en", "src99999999999999999999"), (5, "g h", "en", "src1")]
    df = spark.createDataFrame([(*r, 7, 1.5, "z") for r in rows], "doc_id long, text string, lang string, source string, epoch int, granted double, domain string")
    got = Counter((r.doc_id, r.epoch) for r in mx.select_epochs(df, budget=F.expr("total * 2"), max_epochs=2).collect())
    assert got == Counter({(3, 0): 2, (3, 1): 2, (None, 0): 1, (None, 1): 1, (4, 0): 1, (4, 1): 1, (5, 0): 1, (5, 1): 1})
    back = mx.mixed_documents(df, budget=F.expr("total * 2"), max_epochs=2)
    assert back.columns == df.columns
    assert Counter(r.doc_id for r in back.collect()) == Counter({3: 4, None: 2, 4: 2, 5: 2})
    assert mx.select_epochs(df.limit(0)).count() == 0
