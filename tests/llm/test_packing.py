import random

import pytest

from tessellar.llm import packing

pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")


def test_patterns_hold_the_histogram():
    rnd = random.Random(1)
    for cap in (10, 100, 2048):
        hist = {rnd.randint(1, cap): rnd.randint(1, 10_000) for _ in range(60)}
        patterns = packing.shortest_pack_first(hist, cap)
        got = {}
        for p in patterns:
            assert p.room >= 0 and sum(n * m for n, m in p.parts) == cap - p.room
            for n, m in p.parts:
                got[n] = got.get(n, 0) + m * p.count
        assert got == hist
        room = sum(p.count for p in patterns) * cap
        assert sum(n * c for n, c in hist.items()) <= room
    with pytest.raises(ValueError, match="fit"):
        packing.shortest_pack_first({11: 1}, 10)


def test_round_trip(spark, tiny):
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    got = packing.pack(d).collect()
    count = packing.token_counter(packing.TOKENIZER)
    want = {r[0]: n for r in d.select("doc_id", "text").collect() if r[1] and (n := count([r[1]])[0])}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["seq_id"], []).append(r)
    assert {k: sum(r["n_tokens"] for r in v) for k, v in by_doc.items()} == want
    assert all(len(v) == -(-want[k] // 2048) for k, v in by_doc.items())
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["slot"]):
            assert r["at"] == at
            at += r["n_tokens"]
        assert at <= 2048 and sorted(r["slot"] for r in v) == list(range(len(v)))
    assert sum(want.values()) / (2048 * len(by_seq)) > 0.95


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d e"), (4, "word " * 9000)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, pid string")
    got = packing.pack(d, capacity=1000).collect()
    assert sorted({(r["doc_id"] or 0) for r in got}) == [0, 3, 4] and sum(r["doc_id"] == 3 for r in got) == 2
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 4)[1:] == [1000] * (sum(r["doc_id"] == 4 for r in got) - 1)
    assert packing.pack(d.limit(0)).count() == 0


def test_checks_find_what_is_wrong(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x"), (4, "")], "doc_id bigint, text string")
    good = packing.pack(d)
    assert tuple(packing.checks(d, good).first()) == (2, 0, 0, 0, 0)
    assert packing.checks(d, good.filter("doc_id = 1")).first()["missing"] == 1
    assert packing.checks(d, good.unionAll(good)).first()["overlapping"] > 0
