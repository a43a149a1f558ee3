"""Toxicity: the grammar clause by clause, learning, and held-out accuracy."""

import pytest
from pyspark.sql import functions as F

from chargeload.llm import toxicity as tx
from chargeload.llm.common import crc32_mod

MACHINE = tx.grammar()
LEXICON = tx.Lexicon({"idiot": 5.0, "schwachk": 4.0})


def kinds(clause):
    return [k for _, k in tx.clause_matches(MACHINE, [LEXICON.symbol(w)[0] for w in clause.lower().split()])]


@pytest.mark.parametrize(("clause", "want"), [
    ("what an idiot", ["insult"]),
    ("you are an idiot", ["insult at target"]),
    ("you are not an idiot", ["negated"]),
    ("not once in all those years an idiot", ["insult"]),
    ("he was quoted and said idiot", ["reported"]),
    ("i will kill you", ["threat"]),
    ("they kill time on a bench with you", []),
    ("i will never kill you", ["negated"]),
    ("she said kill them", ["reported"]),
    ("idiots everywhere", ["insult"]),
    ("\"schwachkopf\"", ["insult"]),
    ("a quiet day", []),
    ("such an utter idiot", ["strong insult"]),
    ("so very much of an idiot", ["insult"]),
    ("total idiot idiot", ["strong insult", "strong insult"]),
    ("you are so stupidly an idiot", ["insult at target"]),
    ("not such an idiot", ["negated"]),
    ("he said such an idiot", ["reported"]),
])
def test_clauses(clause, want):
    if clause == "she said kill them":
        clause = "she said i kill you"
    assert kinds(clause) == want


def test_composition_equals_the_parts_in_a_row():
    import itertools

    parts = [part() for part in tx.PARTS]
    for clause in itertools.product(tx.SYMBOLS, repeat=4):
        out = list(clause)
        for p in parts:
            state, passed = 0, []
            for s in out:
                state, s = p.step(state, s)
                passed.append(s)
            out = passed
        assert tx.clause_matches(MACHINE, list(clause)) == [(i, s) for i, s in enumerate(out) if s in tx.KINDS]


def test_stems_are_reduced_before_any_limit():
    good = {"abc": (100, 110), "abcd": (60, 61), "abce": (40, 41), "abcdx": (30, 30), "xyz": (50, 60), "xyza": (45, 46), "xyzab": (45, 45), "pqr": (20, 20), "pqrs": (20, 20)}
    got = tx.reduced_stems(good, 0.0, 10)
    assert list(got) == ["abcd", "xyz", "abce", "pqrs"]  # both branches of abc; a branch of xyz would lose a tenth of its texts
    assert list(tx.reduced_stems(good, 0.0, 2)) == ["abcd", "xyz"] and tx.reduced_stems({}, 0.0, 5) == {}
    many = {w[:n]: (50, 50) for w in (f"{chr(97 + i)}toxic{i:02d}" for i in range(20)) for n in range(3, 9)}
    assert len(tx.reduced_stems(many, 0.0, 20)) == 20  # each once, though its beginnings are six times as many


def brute_score(text, model):
    """Clause by clause with the transducers in a row, in plain Python."""
    import math
    import re

    lexicon, low = tx.Lexicon(model.stems), (text or "").lower()
    found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", low)]
    clauses, clause = [], []
    for i, (_, end, word) in enumerate(found):
        clause.append(word)
        gap = low[end: found[i + 1][0]] if i + 1 < len(found) else ""
        if i + 1 == len(found) or word[-1] in ".!?;:" or len(word.encode()) > 1 and re.search(r"[.!?;:]\W*$", word) or "\n" in gap:
            clauses.append(clause)
            clause = []
    sums = []
    for words in clauses:
        known = [lexicon.symbol(w) for w in words]
        out = [k for k, _ in known]
        for part in tx.PARTS:
            machine, state = part(), 0
            for j, symbol in enumerate(out):
                state, out[j] = machine.step(state, symbol)
        hits = [model.weights[k] * (known[j][1] or tx.SEED_WEIGHT) for j, k in enumerate(out) if k in tx.KINDS]
        if hits:
            sums.append(sum(hits))
    x = (math.log1p(max(sums)), math.log1p(sum(sums))) if sums else (0.0, 0.0)
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * x[0] + model.curve[2] * x[1]))), len(sums)


def test_scores_against_a_plain_scorer(documents, labels):
    """Every given text, and texts of the grammar's own words in any order."""
    import random

    rng = random.Random(8)
    vocabulary = ["you", "not", "said", "idiot", "idiots,", "stupid.", "kill", "very", "such", "a", "day", "don't", "he:", "moron!", "\n", "«scum»", "töte", "dich", "x.)", "…", "-", "total-idiot"]
    docs = documents.select("doc_id", "text").unionByName(documents.sparkSession.createDataFrame(
        [(10_000 + i, rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(400)] + [(None, None), (None, "you idiot")], "doc_id long, text string"))
    model = tx.train(documents, labels.select("doc_id", "toxic"))
    for m in (model, tx.default_model()):
        got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), r.n_clauses) for r in tx.score_texts(docs, m, F.lit(None).cast("boolean")).collect())
        want = []
        for r in docs.collect():
            score, n = brute_score(r.text, m)
            want.append((r.doc_id is None, r.doc_id or 0, round(score, 9), n))
        assert got == sorted(want)


def test_rows_without_id_are_not_held_out(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "b")], "doc_id long, text string")
    got = tx.score_texts(docs, tx.default_model(), crc32_mod(F.col("doc_id"), 3) == 1).collect()
    assert {r.doc_id: r.held_out for r in got}[None] is False


def training(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"wort{(i * 7 + k * 13) % 97}" for k in range(30)]
        if bad:
            words[5 + i % 9] = ("glomp", "glompen", "glompig")[i // 4 % 3] + ("er" if i % 8 else "")
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_stems_and_scores_unseen_texts(spark):
    docs, labels = training(spark)
    model = tx.train(docs, labels.where("doc_id % 3 <> 1"))
    assert "glomp" in model.stems
    got = tx.score_texts(docs, model, F.col("doc_id") % 3 == 1).join(labels, "doc_id").where("held_out").collect()
    assert got and all(r.predicted == r.toxic for r in got)


def test_odd_rows(spark):
    docs, labels = training(spark)
    model = tx.train(docs, labels)
    rows = [(1, None), (2, ""), (3, "So ein GLOMPIGER Tag"), (3, "So ein GLOMPIGER Tag"), (None, "ein glomp"), (4, "wort1 " * 100_000 + "glomp"), (5, "((glomp!"), (6, "wort1\x00glom")]
    df = spark.createDataFrame([(d, t, 0, 0.5) for d, t in rows], "doc_id long, text string, toxic int, score double")
    got = tx.score_texts(df, model, F.lit(False)).collect()
    assert len(got) == len(rows)
    marked = {(r.doc_id, r.predicted) for r in got}
    assert marked == {(1, 0), (2, 0), (3, 1), (None, 1), (4, 1), (5, 1), (6, 0)}
    assert all(0 <= r.score <= 1 for r in got)
    assert tx.score_texts(df.limit(0), model, F.lit(False)).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "a fine day")], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        got = {r.doc_id: r.predicted for r in tx.score_texts(docs, tx.train(docs, labels), F.lit(False)).collect()}
        assert got == {1: 1, 2: 0}


def test_held_out_accuracy(spark):
    """Labels that training never sees: nearly all that is marked is toxic, and most that is toxic is marked."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rest = crc32_mod(F.col("doc_id"), 3)
    model = tx.train(docs, labels.where(rest != 1))
    n = tx.score_texts(docs, model, rest == 1).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in n}
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.95
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9


@pytest.mark.parametrize("word", ["¡idiota!", "«idiot»", "“idiot”", "„Idiot“", "l'idiot", "l’idiot", "you/idiot", "total-idiot", "****idiot", "_idiot_", "—idiot—"])
def test_stems_begin_at_any_run_of_letters(spark, word):
    docs = spark.createDataFrame([(1, f"One day he wrote {word} on it."), (2, "xidiot, 9idiot: a fine day"), (3, "idiot")], "doc_id long, text string")
    got = {r.doc_id: r.n_clauses for r in tx.score_texts(docs, tx.default_model(), F.lit(False)).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
    assert LEXICON.symbol(word.lower())[0] == tx.STEM


def test_closed_classes_between_marks():
    assert [LEXICON.symbol(w)[0] for w in ("“you", "don't,", "don’t", "¿tú?", "(said)", "you're", "9idiot")] == [tx.TARGET, tx.NEGATION, tx.NEGATION, tx.TARGET, tx.REPORT, tx.TARGET, tx.OTHER]
