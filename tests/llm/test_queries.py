"""Registered queries: columns, oracles, and the pipeline against its stages by brute force."""

import os
import sys
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from chargeload.llm import mixing as mx
from chargeload.llm import quality_rules as qr
from chargeload.llm.queries import ORACLES, QUERIES

from .conftest import SF, WORD
from .test_jaccard_join import brute as near_brute
from .test_mixing import selected
from .test_quality_rules import statistics

sys.path.insert(0, os.path.join(os.path.dirname(E.__file__), "scripts"))
from check_oracle import TABLES, rows_of  # noqa: E402

COLUMNS = {
    "op2_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_": ["query_id", "rank", "vec_id", "score"],
    "op4_": ["page_id", "url", "text", "n_chars"],
    "op5_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_": ["doc_id", "class_id", "n_links"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op9_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_": ["item_id", "rank", "doc_id", "score"],
    "op12_": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    want = next((c for k, c in COLUMNS.items() if name.startswith(k)), None)
    assert want is None or df.columns[: len(want)] == want
    got = df.toPandas()
    assert len(got)
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        assert rows_of(got) == rows_of(con.sql(ORACLES[name]).df())


def brute_passages(rows, width=50):
    first = {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - width + 1):
            first[raw[i: i + width]] = min(first.get(raw[i: i + width], d), d)
    out = {}
    for d, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i: i + width]] < d:
                gone[i: i + width] = b"\1" * width
        parts, k = [], 0
        while k < len(raw):
            end = k
            while end < len(raw) and gone[end] == gone[k]:
                end += 1
            if not gone[k]:
                parts.append(raw[k:end].decode("utf-8", "ignore"))
            k = end
        out[d] = "".join(parts)
    return out


def test_pipeline_stage_by_stage(spark, documents, labels):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near copies", "repeated passages", "source mixing", "best-fit packing"]
    docs = documents
    rules = qr.train(docs, labels.select("doc_id", "quality"))
    judged = {r.doc_id: r.rule for r in qr.judge(docs, rules).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {d for d, r in rows.items() for s in [statistics(r.text)] if s[0] >= 10 and 100 * s[4] <= 20 * s[0] and judged[d] == 0}
    docs = stages["quality rules"](spark, docs, SF).cache()
    assert docs.columns == documents.columns
    assert {r.doc_id for r in docs.collect()} == kept < set(rows)

    least = {c for _, c, _ in near_brute([(d, rows[d].text) for d in kept])}
    docs = stages["near copies"](spark, docs, SF).cache()
    assert docs.columns == documents.columns
    assert sorted(r.doc_id for r in docs.collect()) == sorted(least)

    texts = brute_passages([(d, rows[d].text) for d in least])
    docs = stages["repeated passages"](spark, docs, SF).cache()
    assert docs.columns == documents.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {d: (t, len(t) if t != rows[d].text else rows[d].n_chars) for d, t in texts.items()}

    leaves = defaultdict(Counter)
    for d, t in texts.items():
        if WORD.findall(t):
            leaves[f"d{int(rows[d].source[3:]) % 4}", rows[d].lang, rows[d].source][d] += len(WORD.findall(t))
    tokens = spark.createDataFrame([(*leaf, sum(x.values())) for leaf, x in leaves.items()], "domain string, lang string, source string, tokens long")
    from pyspark.sql import functions as F

    granted = {(r.domain, r.lang, r.source): r.granted for r in mx.leaf_budgets(tokens, F.expr("total div 5 * 4")).collect()}
    chosen = Counter()
    for (d, *_), n in selected(leaves, granted).items():
        chosen[d] += n
    docs = stages["source mixing"](spark, docs, SF).cache()
    assert docs.columns == documents.columns
    assert Counter(r.doc_id for r in docs.collect()) == chosen

    packed = Counter()
    for r in stages["best-fit packing"](spark, docs, SF).collect():
        packed[r.doc_id] += r.n_tokens
    assert packed == Counter({d: n * len(WORD.findall(texts[d])) for d, n in chosen.items()})

    whole = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        whole[r.doc_id] += r.n_tokens
    assert whole == packed


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_no_rows(spark, stage):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (None, words, "en", "src2", 5), (3, words + " end", "de", None, 9), (3, words + " end", "de", None, 9), (4, "é" * 100_000, "fr", "src3", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = df.selectExpr("*", "1 AS epoch", "'x' AS dedup", "2 AS class_id", "TRUE AS kept")
    run = dict(corpus_pipeline.STAGES)[stage]
    for given in (df, extra, df.limit(0)):
        out = run(spark, given, SF)
        if stage != "best-fit packing":
            assert out.columns == df.columns
        assert len(out.collect()) <= len(rows)
