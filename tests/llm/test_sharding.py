"""Virtual slots, the versioned map and places in shards."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from chargeload.llm import sharding as sh


def placed(spark, rows, root, schema="doc_id long, text string", **options):
    return [r.asDict() for r in sh.place(spark.createDataFrame(rows, schema), str(root), **options).collect()]


def check(rows, out, shards):
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r["virtual_slot"], r["shard"]) for r in out}) == len({r["virtual_slot"] for r in out})


def spread(out, shards):
    total = [0] * shards
    for r in out:
        total[r["shard"]] += r["size"]
    return max(total) - min(total)


def some(n, seed=1):
    rng = random.Random(seed)
    return [(i, "é" * rng.choice([0, 5, 50, 400])) for i in range(n)]


def test_sizes_places_and_balance(spark, tmp_path):
    rows = some(4000)
    out = placed(spark, rows, tmp_path)
    check(rows, out, 24)
    assert spread(out, 24) <= 0.001 * sum(r["size"] for r in out) / 24 + 16


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (None, None), (None, "a"), (None, "a"), (2, ""), (3, "z" * 1_000_000), (4, "日本")]
    check(rows, placed(spark, rows, tmp_path), 24)


def test_hot_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sh, "COPIES_AT_ONCE", 7)
    rows = [(None, "same")] * 3000 + [(5, f"t{i}") for i in range(3000)] + some(3000)
    out = placed(spark, rows, tmp_path, slots=512)
    check(rows, out, 24)
    assert max(Counter(r["virtual_slot"] for r in out).values()) < 60
    assert spread(out, 24) <= 0.001 * sum(r["size"] for r in out) / 24 + 16


def test_empty_table(spark, tmp_path):
    assert placed(spark, [], tmp_path / "a") == []


def test_versions_and_edits(spark, tmp_path):
    root, rows = str(tmp_path), some(3000)
    first = placed(spark, rows, root)
    assert sh.read_map(spark, root)[0] == 1
    grown = placed(spark, rows + some(3000, 2), root, shards=25)  # the next version, with one shard more
    assert sh.read_map(spark, root)[0] == 2
    check(rows + some(3000, 2), grown, 25)
    old = {r["virtual_slot"]: r["shard"] for r in first}
    kept = [old[r["virtual_slot"]] == r["shard"] for r in grown if r["virtual_slot"] in old]
    assert sum(kept) > 0.75 * len(kept)  # most slots stay where they were
    again = placed(spark, rows, root, version=1)
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(again, key=key) == sorted(first, key=key)
    with pytest.raises(ValueError):
        placed(spark, rows, root, slots=100)


def test_rebalance():
    rng = random.Random(3)
    load = [rng.randint(0, 1000) for _ in range(600)]
    before = sh.first_map(600, 7)
    even = sh.rebalance(before, load, 7)
    total = lambda m, n: [sum(x for x, s in zip(load, m, strict=True) if s == i) for i in range(n)]
    assert max(total(even, 7)) - min(total(even, 7)) <= 0.001 * sum(load) / 7 + 1
    assert sh.rebalance(even, load, 7) == even  # nothing to mend, nothing moves
    assert sum(a != b for a, b in zip(before, even, strict=True)) < 60
    fewer = sh.rebalance(even, load, 5)
    assert max(fewer) == 4 and max(total(fewer, 5)) - min(total(fewer, 5)) <= 0.001 * sum(load) / 5 + 1
    assert all(a == b for a, b in zip(even, sh.rebalance(even, [0] * 600, 9), strict=True))
    one = [10**9] + [1] * 599  # one slot above all others stays alone
    alone = sh.rebalance(before, one, 7)
    assert [s for s, shard in enumerate(alone) if shard == alone[0] and one[s]] == [0]


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, "t" * (i % 9), i % 3, "x", "en") for i in range(300)], "doc_id int, text string, shard int, slot string, lang string")
    assert sh.write_shards(df, str(tmp_path / "map"), str(tmp_path / "out"), shards=4, slots=64) == 1
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.lang) for r in back.collect()) == Counter((r.doc_id, r.text, r.lang) for r in df.collect())
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(4)}
