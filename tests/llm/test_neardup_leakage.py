import random
import re

import numpy as np
import pyarrow as pa

from tessellar.llm import leakage, neardup
from tessellar.llm.components import components
from tessellar.llm.wordhash import word_hashes

WORD = re.compile("[a-z0-9]+")


def grams(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_words_are_the_regular_expressions():
    texts = ["Ab-c É 12x", "", None, "a", "b", "KK! ß", "x" * 10_000, "  ", "trailing9"]
    h, o = word_hashes(pa.array(texts, pa.string()))
    want = [WORD.findall(t.lower()) if t else [] for t in texts]
    assert np.diff(o).tolist() == [len(w) for w in want]
    seen = {}
    for x, w in zip(h.tolist(), [w for ws in want for w in ws], strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def brute_pairs(rows, t=0.6):
    s = {k: grams(x, 3) for k, x in rows.items()}
    ks = sorted(k for k in s if s[k])
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= t}


def test_pairs_against_brute_force(spark, tiny):
    d = spark.read.parquet(f"{tiny}/pool_candidates.parquet")
    rows = {r[0]: r[1] for r in d.select("chunk_id", "chunk").collect() if r[1]}
    got = {tuple(r) for r in neardup.found(d).collect()}
    assert got == brute_pairs(rows) and got


def test_odd_rows_copies_and_clashing_names(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(200)]
    edited = base[:90] + ["new"] + base[90:]
    rows = [("a", " ".join(base)), ("b", " ".join(base).upper()), ("c", " ".join(edited)), ("c", " ".join(edited)), ("d", None), ("e", ""), ("f", "two words"), (None, " ".join(base)), ("g", " ".join(f"z{i}" for i in range(99)))]
    rows += [(f"m{i:03d}", " ".join(base)) for i in range(60)]
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "chunk_id string, chunk string, id int, k string, rep int")
    pairs = {tuple(r) for r in neardup.found(d).collect()}
    assert pairs == brute_pairs({k: x for k, x in rows if k})
    few = neardup.near_pairs(d, ix=neardup.Index(expand=10)).collect()
    assert {x for r in few for x in r[:2]} == {x for p in pairs for x in p} and len(few) < 150
    groups = {r["chunk_id"]: (r["group_id"], r["n_links"]) for r in neardup.near_groups(d).collect()}
    assert groups["a"] == ("a", 62) and groups["c"][0] == "a" and groups["g"] == ("g", 0) and "f" not in groups
    assert neardup.found(d.limit(0)).count() == 0 and neardup.near_groups(d.limit(0)).count() == 0


def test_runs_across_batches():
    key = np.array([1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4], np.int64)
    ids = np.arange(len(key), dtype=np.int64)
    want = {(i, j) for i in ids for j in ids if i < j and key[i] == key[j]}
    for step in (1, 2, 3, 5, 11):
        for limit in (2, 3, 4, 100):
            batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(ids[i : i + step])], names=["key", "id"]) for i in range(0, len(key), step)]
            out = [r for b in neardup._meetings(limit)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            pairs, hot = [r[:2] for r in out if r[1] is not None], [(r[2], r[0], r[3]) for r in out if r[1] is None]
            long = {k for k in key if (key == k).sum() > limit}
            assert set(pairs) == {p for p in want if key[p[0]] not in long} and len(pairs) == len(set(pairs))
            assert sorted(h[:2] for h in hot) == [(k, i) for k, i in zip(key, ids, strict=True) if k in long]
            for k in long:
                blocks = [h[2] for h in hot if h[0] == k]
                assert sorted(set(blocks)) == list(range(max(blocks) + 1)) and max(blocks.count(x) for x in blocks) <= limit


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_leaks_against_brute_force(spark, tiny):
    d, b = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = [(r[0], grams(r[1], 10)) for r in b.select("item_id", "text").collect()]
    docs = [(r[0], grams(r[1], 10)) for r in d.select("doc_id", "text").collect()]
    want = {(i, j) for i, x in docs for j, y in items if x & y}
    assert {tuple(r) for r in leakage.found(d, b).collect()} == want


def test_leaks_of_odd_rows_in_blocks(spark):
    run = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(["x"] * 50 + run[5:15] + ["y"] * 50)), (2, " ".join(run[:9])), (3, None), (4, ""), (None, " ".join(run)), (5, " ".join(run[:12] + ["other"] + run[13:])), (5, " ".join(run[:12] + ["other"] + run[13:]))]
    items = [(10, " ".join(run)), (11, None), (12, "a b"), (None, " ".join(run)), (13, " ".join(f"v{i}" for i in range(20)))]
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id bigint, text string, i string, k int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, t int")
    assert {tuple(r) for r in leakage.found(d, b).collect()} == {(1, 10), (5, 10)}
    small = leakage.leaks(d, b, cfg=leakage.Align(block_chars=50)).filter("run >= 10").select("doc_id", "item_id", "run", "at").collect()
    assert sorted(map(tuple, small)) == [(1, 10, 10, 50), (5, 10, 27, 13)]
    assert leakage.leaks(d.limit(0), b).count() == 0 and leakage.leaks(d, b.limit(0)).count() == 0


def test_leaks_of_copies_with_an_edit_every_eight_words(spark):
    item = [f"w{i}" for i in range(80)]
    swapped = [f"e{i}" if i % 8 == 7 else w for i, w in enumerate(item)]
    longer = [x for i, w in enumerate(item) for x in ([w, f"e{i}"] if i % 8 == 7 else [w])]
    docs = [(1, " ".join(["x"] * 30 + swapped + ["y"] * 30)), (2, " ".join(longer)), (3, " ".join(f"z{i}" for i in range(80))), (4, " ".join(item))]
    b = spark.createDataFrame([(10, " ".join(item))], "item_id bigint, text string")
    for some in (docs, docs[:3]):  # with the item itself in the corpus and without
        got = {r["doc_id"]: (r["score"], r["run"]) for r in leakage.leaks(spark.createDataFrame(some, "doc_id bigint, text string"), b).collect()}
        assert got == {1: (2 * 70 - 2 * 9, 7), 2: (2 * 80 - 2 * 9, 8)} | ({4: (160, 80)} if len(some) == 4 else {})


def test_alignment():
    a, b = np.array([1, 2, 3, 9, 4, 5]), np.array([7, 1, 2, 3, 4, 5, 8])
    assert leakage.smith_waterman(a, b, leakage.Align()) == (8, 3, 0, 2)


def test_links_are_those_of_all_members(spark):
    """The number of links sums to twice the pairs, whatever the sizes of the classes on either side of a link."""
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
    near = [*base[:70], "new", *base[70:]]
    rows = [(f"a{i:03d}", " ".join(base)) for i in range(40)] + [(f"b{i:03d}", " ".join(near)) for i in range(25)] + [("lone", " ".join(near[:140]))]
    d = spark.createDataFrame(rows, "chunk_id string, chunk string")
    for ix in (neardup.Index(), neardup.Index(block=7), neardup.Index(block=3, expand=10)):
        pairs = {tuple(r)[:2] for r in neardup.near_pairs(d, ix=ix).collect()}
        links = {r["chunk_id"]: r["n_links"] for r in neardup.near_groups(d, ix=ix).collect()}
        want = brute_pairs(dict(rows))
        if ix.expand > 40:
            assert pairs == want and sum(links.values()) == 2 * len(want)
        across = {p for p in want if p[0][0] != p[1][0]}
        assert across <= pairs and links["lone"] == sum("lone" in p for p in want) and links["a000"] == sum("a000" in p for p in want)


def test_boilerplate_does_not_make_one_task_all_work(spark):
    """Different texts that share half their words fill table keys; these are cut into blocks and no pair is lost."""
    rnd = random.Random(5)
    same = [f"s{i}" for i in range(60)]
    rows = {f"c{i:04d}": " ".join(same + [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]) for i in range(600)}
    rows |= {f"e{i:04d}": rows[f"c{i:04d}"] + " more words" for i in range(0, 600, 40)}
    d = spark.createDataFrame(list(rows.items()), "chunk_id string, chunk string")
    assert {tuple(r)[:2] for r in neardup.near_pairs(d, ix=neardup.Index(block=20)).collect()} == {(f"c{i:04d}", f"e{i:04d}") for i in range(0, 600, 40)}
