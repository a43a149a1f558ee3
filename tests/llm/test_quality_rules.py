"""Quality rules: statistics by brute force, learning on made cases, held-out agreement with the labels."""

from collections import Counter

from pyspark.sql import functions as F

from chargeload.llm import quality_rules as qr

from .conftest import SF, WORD


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_of_the_small_table(documents):
    want = sorted((r.doc_id, *statistics(r.text)) for r in documents.collect())
    got = sorted(tuple(r) for r in qr.text_statistics(documents.select("doc_id", "text")).select("doc_id", *NAMES).collect())
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e"), (4, "a b c d e a b c d e"), (5, "x " * 500), (6, "one two\n\n \none two\nthree\r\nthree"), (None, "#$ €uro é f"), (4, "a b c d e a b c d e"),
            (7, " ".join(str(i % 9000) for i in range(18_000))), (8, "a b c d a b c d a"), (9, "\x0b\x0c"), (10, "a b c d e f")]
    df = spark.createDataFrame([(*r, 5, "k", True) for r in rows], "doc_id long, text string, n_words int, rule string, kept boolean")
    out = qr.judge(df, [])
    assert out.columns.count("n_words") == out.columns.count("kept") == 1
    key = lambda r: (r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in out.select("doc_id", *NAMES, "base_failed", "kept").collect()), key=key)
    want = sorted(((d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0], not (s[0] < 10 or 100 * s[4] > 20 * s[0])) for d, t in rows for s in [statistics(t)]), key=key)
    assert got == want
    assert qr.judge(df.limit(0), []).count() == 0


def test_covering_finds_and_prunes_conjunctions():
    names = ["n_words", "symbol_share", "upper_share"]
    cells = Counter()
    for words in range(6):
        for symbols in range(8):
            for upper in range(6):
                bad = symbols >= 5 or (upper >= 4 and words < 2)
                for aside in (True, False):
                    cells[(words, symbols, upper), bad, aside] += 3
    rules = qr.learn_rules(cells, names)
    place = {n: i for i, n in enumerate(names)}
    for (cell, bad, _), _n in cells.items():
        assert bad == any(all(qr._holds(cell, c, place) for c in rule) for rule in rules)
    assert all(len(rule) <= 2 for rule in rules)


def test_no_rules_without_both_kinds():
    assert qr.learn_rules(Counter({((1,), True, False): 50, ((1,), True, True): 50}), ["n_words"]) == []
    assert qr.learn_rules(Counter(), ["n_words"]) == []
    assert qr.learn_rules(Counter({((1,), bool(i % 2), bool(i % 3)): 50 for i in range(6)}), ["n_words"]) == []


def test_rules_are_ordered_conditions(spark):
    df = spark.createDataFrame([(1, "% # $ five words and some more of them to pass"), (2, "five words and some more of them to pass the base rules")], "doc_id long, text string")
    rules = [[("symbol_share", True, 4)], [("n_words", False, 0)]]
    assert {r.doc_id: (r.rule, r.kept) for r in qr.judge(df, rules).collect()} == {1: (1, False), 2: (2, False)}


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2))
    rules = qr.train(docs, labels.where(half == 0))
    judged = qr.judge(docs.join(labels.where(half == 1).select("doc_id", "quality"), "doc_id"), rules).where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[1, True] > 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_labels_without_texts(spark, documents):
    none = spark.createDataFrame([(None, 0), (-5, 1), (1, None)], "doc_id long, quality int")
    assert qr.train(documents, none) == []
    assert SF
