import math
import random
import time

from pyspark.sql import functions as F

from tessellar.llm import splitting, topn

POOL = "candidate_id bigint, query string, combined_score double, ingested_at string, grp string, item int, score string, pos int"


def test_ties_nulls_repeats_and_clashing_names(spark):
    rows = [
        (1, "q ", 0.5, "a", "x", 0, "s", 9),
        (2, " q", 0.5, "a", "x", 0, "s", 9),
        (3, "q", 0.9, "a", None, 0, "s", 9),
        (3, "q", 0.9, "b", None, 0, "s", 9),  # again
        (4, "q", None, "a", "x", 0, "s", 9),
        (5, "q", math.nan, "a", "x", 0, "s", 9),
        (6, None, 1.0, "a", "x", 0, "s", 9),
        (7, "  ", 1.0, "a", "x", 0, "s", 9),
        (None, "q", 1.0, "a", "x", 0, "s", 9),
        (8, "r", 0.1, None, "x", 0, "s", 9),
        (9, "q", 0.2, "a", "x", 0, "s", 9),
        (9, "q", 0.95, "b", "x", 0, "s", 9),  # later and better
    ]
    d = spark.createDataFrame(rows, POOL)
    got = topn.top_n(d, topn.query_name("query"), "candidate_id", F.col("combined_score"), 3, version="ingested_at")
    assert sorted((r["grp"], r["pos"], r["item"]) for r in got.collect()) == [("q", 1, 9), ("q", 2, 3), ("q", 3, 1), ("r", 1, 8)]
    assert topn.top_n(d.limit(0), topn.query_name("query"), "candidate_id", F.col("combined_score"), 3).count() == 0


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc") if rnd.random() < 0.6 else "hot", rnd.randint(0, 5) / 5, "t", "", 0, "", 0) for i in range(3000)]
    d = spark.createDataFrame(rows, POOL)
    got = {(r["grp"], r["item"]) for r in topn.top_n(d, F.col("query"), "candidate_id", F.col("combined_score"), 10, version="ingested_at").collect()}
    want = {(q, i) for q in {r[1] for r in rows} for _, i in sorted((-r[2], r[0]) for r in rows if r[1] == q)[:10]}
    assert got == want


def test_group_limit_on_both_sides_of_the_shuffle(spark):
    d = spark.createDataFrame([(1, "q", 0.5, "a", "", 0, "", 0)], POOL)
    plan = topn.top_n(d, F.col("query"), "candidate_id", F.col("combined_score"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_page_numbers():
    want = {"8": 8, " 101 ": 101, "006": 6, "33.0": 33, "Page 24": 24, "p. 8": 8, "S. 17": 17, "nan": -1, "Unknown": -1, "": -1, None: -1, "12-13": -1}
    assert {k: splitting.page_number(k) for k in want} == want


def sentence(rnd):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(3, 30))).capitalize() + "."


def test_pieces_keep_all_words_and_the_limit():
    rnd = random.Random(5)
    for n in (1, 7, 40, 200):
        text = " ".join(sentence(rnd) for _ in range(n))
        pieces = splitting.split_text(text, 3, limit=60)
        assert all(p.n_words <= 60 and len(p.text.split()) == p.n_words for p in pieces)
        own = [w for p in pieces for w in p.text.split()[p.n_overlap :]]
        assert own == text.split()
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert a.text.split()[-b.n_overlap :] == b.text.split()[: b.n_overlap] and 0 < b.n_overlap <= 30
            assert a.text.endswith(".")


def test_text_without_any_boundary_and_marks():
    pieces = splitting.split_text("w " * 1000, 1, limit=250)
    assert all(p.n_words <= 250 for p in pieces) and sum(p.n_words - p.n_overlap for p in pieces) == 1000
    marked = "a b.\n###  PAGE  4  ###\nc d.\n### Page 5 - Empty ###\n### page 6 ###\n\ne"
    (p,) = splitting.split_text(marked, 3)
    assert p.pages == (3, 4, 6) and "#" not in p.text and p.n_words == 5
    assert splitting.split_text("### Page 4 ###\n \n", 3) == []


def test_table(spark):
    long = "\n".join(["one two three four five. " * 30, "### Page 9 ###", "six seven. " * 60])
    d = spark.createDataFrame([("c1", long, "p. 8", 1, "x"), ("c1", long, "p. 8", 1, "x"), ("c2", "short", "1", 1, "x"), ("c3", None, None, None, None), (None, long, None, 1, "x"), ("c4", "", "", 1, "x")], "chunk_id string, chunk string, page string, k int, t string")
    got = splitting.split_oversized(d).collect()
    assert {r["chunk_id"] for r in got} == {"c1", None} and all(r["n_words"] <= 250 for r in got)
    assert sorted((str(r[0]), r[1]) for r in splitting.found(d).collect()) == [("None", -1), ("None", 9), ("c1", 8), ("c1", 9)]
    assert splitting.found(d.limit(0)).count() == 0


def test_texts_without_sentences_take_time_in_proportion():
    ends = [splitting.HARD] * 200_000 + [splitting.NEW_PAGE]
    start = time.process_time()
    cuts = splitting.cut_points(ends, 250, 125)
    assert time.process_time() - start < 30 and cuts[-1][1] == len(ends) and all(b - a <= 250 for a, b in cuts)


def test_checks_find_what_is_wrong(spark, tiny):
    got = splitting.checks(spark.read.parquet(f"{tiny}/pool_candidates.parquet")).collect()
    assert got and all(r["within"] and r["joined"] for r in got)
