"""Repeated byte strings against a brute-force rule, and the two-stage sort against plain sorting."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chargeload.llm import suffix_dedup as sd


@pytest.mark.parametrize("seed", range(60))
def test_two_stage_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, rng.integers(1, 5), rng.integers(1, 400)).astype(np.uint8) * 60
    raw = text.tobytes()
    order = sd.suffix_order(text, 50)
    assert sorted(order) == list(range(len(raw)))
    cut = [raw[i: i + 50] for i in order]
    assert cut == sorted(cut)
    lengths = sd.common_prefixes(sd.byte_words(text), order, 50)
    for i in range(1, len(raw)):
        a, b = raw[order[i]:] + b"\0" * 60, raw[order[i - 1]:] + b"\0" * 60
        same = next((k for k in range(50) if a[k] != b[k]), 50)
        assert lengths[i] == same


def test_no_text_and_one_byte():
    assert len(sd.suffix_order(np.zeros(0, np.uint8))) == 0
    assert sd.suffix_order(np.array([7], np.uint8)).tolist() == [0]


def brute(rows, width=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1 if d is not None else 0):
            first[raw[i: i + width]] = min(first.get(raw[i: i + width], d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - width + 1 if d is not None else 0):
            if first[raw[i: i + width]] < d:
                gone[i: i + width] = 1
        kept = bytes(np.frombuffer(raw, np.uint8)[gone[:-1] == 0])
        out.append((d, len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    rows = sd.remove_repeats(df, **options).select(
        "doc_id", "dedup.n_bytes", F.col("dedup.n_bytes") - F.octet_length("dedup.kept"), F.size("dedup.spans"), F.sha2("dedup.kept", 256))
    return sorted((tuple(r) for r in rows.collect()), key=str)


PASSAGE = "A passage about ships and tides that several authors have used before, word for word. "


def test_against_brute_force_with_odd_rows(spark):
    rows = [
        (5, PASSAGE), (3, PASSAGE), (None, PASSAGE), (7, None), (8, ""), (9, "x" * 300), (2, "x" * 49), (10, "ab" * 120), (11, "a" + PASSAGE + "zz" + PASSAGE),
        (11, "another text of the same id " + PASSAGE), (3, PASSAGE), (12, "é" * 60), (1, "é" * 30 + "a"), (13, "yx" * 40_000), (14, "long " + "yx" * 30_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


OTHER = "Quite another passage, of mills and rivers, that nobody but these few documents has ever used, to the letter. "


@pytest.mark.parametrize("rows", [
    [(1, OTHER), (2, PASSAGE), (5, OTHER), (5, f"aa {PASSAGE} bb")],
    [(1, OTHER), (5, OTHER), (5, f"aa {PASSAGE} bb"), (9, f"cc {PASSAGE} dd")],
    [(1, OTHER), (5, OTHER), (5, OTHER), (5, PASSAGE), (7, PASSAGE), (7, OTHER), (7, OTHER + PASSAGE), (7, "q" + PASSAGE)],
    [(4, PASSAGE), (4, PASSAGE), (4, OTHER), (6, OTHER + "x"), (6, PASSAGE)],
])
def test_a_copy_among_the_rows_of_an_id(spark, rows):
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_whole_small_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = found(documents.select("doc_id", "text"))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_other_columns_pass_and_clashing_ones_do_not_disturb(spark):
    df = spark.createDataFrame([(2, PASSAGE, "q", 1, 9), (1, PASSAGE, "r", 2, 8)], "doc_id long, text string, k string, dedup int, spans int")
    out = {r.doc_id: r for r in sd.remove_repeats(df, as_text=True).collect()}
    assert (out[2].k, out[2].spans, out[2].dedup.kept) == ("q", 9, "")
    assert out[1].dedup.kept == PASSAGE


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_characters_go_whole(spark):
    rows = [(1, "é" * 40), (2, "xé" + "é" * 39 + "ü")]
    out = {r.doc_id: r.dedup.kept for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()}
    assert out[2] == "x"        # the first byte of ü stands in a string that repeats
