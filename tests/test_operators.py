import random

import pytest
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.operators import coverage, dense, evaluate, fusion, lexical, pages, segment
from tessellar.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


MARKED = "pre\n### Page 1 ###\none.\n### page 2 ###\n\n### Page 3 - Empty ###\n### Page 2 ###\nagain"


def test_pages(spark):
    d = spark.createDataFrame([(1, MARKED), (2, "plain"), (3, None), (4, " ")], "doc_id bigint, text string")
    assert [(r[0], r[2]) for r in rows(segment.split_pages(d))] == [(1, 0), (1, 1), (1, 2), (1, 2), (2, 0)]
    assert [(r[0], r[2]) for r in rows(segment.split_pages(d, keep_preamble=False))] == [(1, 1), (1, 2), (1, 2), (2, 1), (4, 1)]


@pytest.mark.parametrize(("line", "following", "want"), [("# Risk", "", True), ("# a b c d e f g h i j", "", False), ("# Risk:", "", False), ("# 12", "", False), ("# Risk", "# Other", False), ("Risk", "", False), ("#", "", False)])
def test_heading(spark, line, following, want):
    d = spark.createDataFrame([(line, following)], "a string, b string")
    assert d.select(segment.is_heading(F.col("a"), F.col("b"))).first()[0] is want


def test_sections_keep_the_last_of_headings_in_a_row(spark):
    d = spark.createDataFrame([(1, "# A\n\n# B\nx\ny\n# C")], "doc_id bigint, text string")
    assert [(r["heading"], r["section_text"]) for r in segment.sections(d).collect()] == [("B", "x\ny")]


def test_packing_never_exceeds_unless_one_sentence_does(spark):
    rnd = random.Random(1)
    texts = [(i, " ".join(" ".join(["w"] * rnd.randint(1, 40)) + "." for _ in range(rnd.randint(1, 30)))) for i in range(30)]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = segment.pack_sentences(d, 50, ["doc_id"], "text").collect()
    assert all(r["n_words"] <= 50 or r["chunk"].count(".") == 1 for r in got)
    by = {i: " ".join(r["chunk"] for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["chunk_no"])) for i, _ in texts}
    assert by == dict(texts)


def test_word_windows_and_overlap(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert [r["window"] for r in segment.word_windows(d, 2).orderBy("pos").collect()] == ["a b", "c d", "e"]
    c = spark.createDataFrame([(1, 0, "A. B. C."), (1, 1, "D.")], "doc_id bigint, chunk_no int, chunk string")
    assert [r["chunk"] for r in segment.with_overlap(c, ["doc_id"], 2).orderBy("chunk_no").collect()] == ["A. B. C.", "B. C. D."]


def test_text_functions(spark):
    d = spark.createDataFrame([("The Audit-Committee, R&D!", 91.0), (None, 10.0)], "t string, n double")
    assert d.select(T.words(F.col("t"))).first()[0] == ["the", "audit", "committee", "r", "d"]
    assert d.select(T.terms(F.col("t"))).first()[0] == ["audit", "committee"]
    assert [r[0] for r in d.select(T.band(F.col("n"))).collect()] == ["Excellent", "Poor"]
    p = spark.createDataFrame([("008",), ("8.0",), ("S. 17",), ("Unknown",), (None,)], "page string")
    assert [r[0] for r in p.select(T.page_number(F.col("page"))).collect()] == [8, 8, 17, None, None]


def test_ranks_and_fusion(spark):
    x = spark.createDataFrame([("q", i, 0.5) for i in (3, 1, 2)], "query string, id bigint, s double")
    assert [r["id"] for r in lexical.best(x, "query", "s", "id", 2).orderBy("rank").collect()] == [1, 2]
    lists = spark.createDataFrame([("q", 1, "a", 0), ("q", 2, "a", 1), ("q", 2, "b", 0)], "query string, id bigint, method string, rank int")
    got = {r["id"]: (r["rrf"], r["methods"]) for r in fusion.rrf(lists, "query", "id").collect()}
    assert got == {1: (round(1 / 60, 9), "a"), 2: (round(1 / 61 + 1 / 60, 9), "a,b")}
    even = fusion.scale_each(x.withColumn("method", F.lit("m")), ["query", "method"], "s")
    assert {r["norm"] for r in even.collect()} == {0.5}


def test_greedy_dedupe_is_not_transitive(spark):
    x = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    links = spark.createDataFrame([("q", "a", "b"), ("q", "b", "c")], "query string, a string, b string")
    assert [r["id"] for r in fusion.greedy_dedupe(x, links, "query", "id", "rank").orderBy("id").collect()] == ["a", "c"]


def test_knn_against_brute_force(spark, tiny):
    import numpy as np

    e = spark.read.parquet(f"{tiny}/embeddings.parquet")
    got = dense.knn(e, e.filter("vec_id % 50 = 0"), 5, block=3).collect()
    pdf = e.toPandas()
    m, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    for q in ids[ids % 50 == 0]:
        s = np.round(m @ m[ids == q][0], 5)
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0")
    exact = {(r[0], r[1]) for r in dense.knn(e, q, 20).select("qid", "vec_id").collect()}
    near = {(r[0], r[1]) for r in dense.ivf(e, q, 20).select("qid", "vec_id").collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_mmr_with_full_weight_is_top_k(spark, tiny):
    e = spark.read.parquet(f"{tiny}/embeddings.parquet")
    hits = dense.knn(e, e.filter("vec_id % 50 = 0"), 12)
    got = {(r["qid"], r["pick"]): r["vec_id"] for r in dense.mmr(hits, e, 4, trade=1.0).collect()}
    assert got == {(r["qid"], r["rank"]): r["vec_id"] for r in hits.filter("rank <= 4").collect()}


def test_sentence_scores_against_brute_force(spark, tiny):
    b, d = spark.read.parquet(f"{tiny}/benchmark.parquet"), spark.read.parquet(f"{tiny}/documents.parquet")
    got = {tuple(r) for r in coverage.sentence_scores(b, d).collect()}
    s = [(r["item_id"], r["sid"], set(r["words"])) for r in coverage.bench_sentences(b).collect()]
    docs = [(r[0], set(r[1])) for r in d.filter("text is not null").select("doc_id", T.terms(F.col("text"))).collect()]
    want = {(i, k, j, round(len(w & t) / len(w), 6)) for i, k, w in s for j, t in docs if round(len(w & t) / len(w), 6) >= 0.5}
    assert got == want


def test_greedy_cover(spark):
    a = spark.createDataFrame([(1, i, 10 + (i >= 5) + (i >= 8) + (i >= 9), 1.0) for i in range(10)], "item_id bigint, sid int, doc_id bigint, overlap double")
    n = spark.createDataFrame([(1, 10), (2, 4)], "item_id bigint, n bigint")
    c = coverage.greedy_cover(a, n, hard=3)
    assert [(r["doc_id"], r["covered"]) for r in c.orderBy("pick").collect()] == [(10, 5), (11, 3), (12, 1)]
    assert rows(coverage.report(c, n)) == [(1, 10, 9, 90.0, 3), (2, 4, 0, 0.0, 0)]


def test_rouge(spark):
    d = spark.createDataFrame([(1, "a b c d", "a x c d"), (2, "", "a"), (3, None, None)], "id int, a string, b string")
    assert rows(evaluate.rouge_l(d, "id", "a", "b")) == [(1, 75.0), (2, 0.0), (3, 0.0)]


def test_rounds(spark):
    c = spark.createDataFrame([("q", f"c{i}", 1 - i / 100, "alpha" if i < 4 else "beta") for i in range(8)], "query string, chunk_id string, score double, chunk string")
    k = spark.createDataFrame([("q", "alpha"), ("q", "beta"), ("q", "gamma")], "query string, keyword string")
    got = pages.rounds(c, k, size=2, least_new=1).orderBy("round", "chunk_id").collect()
    assert [(r["chunk_id"], r["round"]) for r in got] == [("c0", 1), ("c1", 1), ("c4", 2)]
    assert pages.rounds(c.limit(0), k).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "page_2.txt").write_text("two")
    (tmp_path / "page_10.txt").write_text("ten")
    assert rows(files.page_folder(spark, str(tmp_path))) == [(2, "two"), (10, "ten")]
    t = files.whole_texts(spark, str(tmp_path), str(tmp_path))
    assert t.count() == 2 and files.to_ingest(t, t.filter("filename = 'page_2.txt'")).count() == 1
    out = str(tmp_path / "chunks")
    a = spark.createDataFrame([("f", "x"), ("g", "y")], "filename string, chunk string")
    files.write_chunks(a, out)
    files.write_chunks(spark.createDataFrame([("g", "z")], "filename string, chunk string"), out)
    assert rows(spark.read.parquet(out).select("filename", "chunk")) == [("f", "x"), ("g", "z")]
    files.write_results(spark.createDataFrame([(1, 0.123456)], "id int, s double"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first()["s"] == "0.1235"
    w = spark.createDataFrame([("a", None, "b"), (" ", None, "c")], "q1 string, q2 string, q3 string")
    assert rows(files.wide_to_long(w)) == [("q1", 1, "a"), ("q3", 1, "b"), ("q3", 2, "c")]
    k = spark.createDataFrame([(1, "q", "['a', 'b c']"), (2, "q", "x, y"), (3, "r", None)], "kw_id int, question string, keywords string")
    assert rows(files.keyword_book(k)) == [("q", ["x", "y"])]


def test_coverage_of_words_spread_over_sentences(spark, tiny):
    words = [f"word{i:02d}" for i in range(20)]
    items = [(1, ". ".join(" ".join(words[i : i + 4]) for i in range(0, 20, 4))), (2, None), (3, "of the")]
    docs = [(1, " ".join(words[::4])), (2, " ".join(words[:3])), (3, None), (4, "other words"), (5, " ".join(words).upper())]
    b, d = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {(1, 1, 25.0), (1, 5, 100.0)}  # document 1 holds a word of each sentence, and 2 just 15 %
    assert {tuple(r) for r in coverage.item_scores(b, d).collect()} == want
    assert {tuple(r) for r in coverage.item_scores(b.union(b.selectExpr("item_id + 10", "text")), d, block_words=5).collect()} == want | {(i + 10, j, x) for i, j, x in want}
    assert coverage.item_scores(b.limit(0), d).count() == 0 and coverage.item_scores(b, d.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["chunk_coverage_all", "adaptive_coverage_all", "coverage_bands_all"])
def test_coverage_of_all_pairs_against_sql(spark, tiny, name):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    key = lambda rows: sorted(tuple(round(float(x), 6) if not isinstance(x, str) else x for x in r) for r in rows)
    want = key(cur.fetchall())
    assert key(entry.queries()[name](spark, tiny).select(*names).collect()) == want and want


def test_tables_and_long_sentences_reach_chunks(spark):
    d = spark.createDataFrame([(1, "One two three. |x\n| a | b |\n| 1 | 2 |\nw1 w2 w3 w4 w5 w6 w7.\n| z |"), (2, None), (3, "")], "doc_id bigint, text string")
    got = rows(segment.chunks_and_tables(d, 4))
    assert [r[2] for r in got] == ["text"] * (len(got) - 2) + ["table"] * 2 and {r[0] for r in got} == {1}
    assert [r[4] for r in got[-2:]] == ["| a | b |\n| 1 | 2 |", "| z |"]
    assert all(r[3] <= 4 for r in got[:-2]) and " ".join(r[4] for r in got[:-2]) == "One two three. |x w1 w2 w3 w4 w5 w6 w7."


def test_first_occurrences_of_pages(spark):
    d = spark.createDataFrame([(1, "### Page 1 ###\na\n### Page 2 ###\nb\n### Page 2 ###\nc\n### Page 3 ###\nd"), (2, "plain"), (3, None)], "doc_id bigint, text string")
    w = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (1, 9), (2, 5)], "doc_id bigint, page_no int")
    assert rows(segment.stitched(d, w)) == [(1, "### Page 2 ###\nb\n### Page 3 ###\nd\n")]


def test_bleu_by_hand_without_joins(spark):
    d = spark.createDataFrame([(1, "a b a b", "a b x"), (2, "one", "one"), (3, None, "x"), (None, "a b", "a b"), (4, "a b", "a b")], "k int, a string, b string")
    out = evaluate.bleu(d, ["k"], "a", "b")
    assert {r["k"]: r["bleu"] for r in out.collect()} == {1: pytest.approx(100 * (2 / 4 * 1 / 3) ** 0.5, abs=1e-6), 2: 0, 3: 0, None: 0, 4: pytest.approx(100, abs=1e-6)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Exchange", "Generate"))  # words are not listed row by row
