import math
import re

import pytest
from pyspark.sql import functions as F

from tessellar.config import PRESETS, PipelineConfig
from tessellar.functions.providers import Providers, cosine_of_terms
from tessellar.operators import fusion, lexical, mor, pages, pipeline, qc
from tessellar.session import numbered, release


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CANDS = [("q audit risk", 1, "a", 2.0, 0.2), ("q audit risk", 2, "b", 1.0, 0.1), ("q audit risk", 3, "c", 1.0, 0.1), ("q audit risk", 4, "d", None, 0.9), ("other", 5, "a", 1.0, 1.0)]
CHUNKS = [("a", "Audit risk rose. Nothing else.", "Audit"), ("b", None, None), ("c", "# Risk\nThe risk.", "Introduction"), ("e", "unused", None)]


@pytest.fixture(scope="module")
def tables(spark):
    c = spark.createDataFrame([(*r, "x", 0) for r in CANDS], "query string, candidate_id bigint, chunk_id string, bm25_score double, tfidf_score double, chunk string, rank int")
    t = spark.createDataFrame(CHUNKS, "chunk_id string, chunk string, heading string")
    k = spark.createDataFrame([("q audit risk", ["risk", "audit committee"]), ("none", None)], "query string, keywords array<string>")
    return c, t, k


@pytest.mark.parametrize("preset", ["canonical", "heading_keyword", "multi_query", "dense_first"])
def test_presets_with_odd_rows(tables, preset):
    c, t, k = tables
    got = pipeline.search(c, t, k, PRESETS[preset]).collect()
    by = {(r["query"], r["candidate_id"]): r for r in got}
    assert set(by) == {("q audit risk", 1), ("q audit risk", 2), ("q audit risk", 3), ("other", 5)}  # 4 lacks a score
    assert by["q audit risk", 2]["similarity"] == 0 and (PRESETS[preset].fuse != "scores" or by["q audit risk", 1]["rank"] == 1)
    assert pipeline.search(c.limit(0), t, k, PRESETS[preset]).count() == 0


def test_stages_cut_and_ties_go_to_smaller_ids(spark):
    c = spark.createDataFrame([("q", i, "a", 1.0, 1.0) for i in range(9)], "query string, candidate_id bigint, chunk_id string, bm25_score double, tfidf_score double")
    t = spark.createDataFrame([("a", "q text", None)], "chunk_id string, chunk string, heading string")
    k = spark.createDataFrame([], "query string, keywords array<string>")
    got = pipeline.search(c, t, k, PipelineConfig(7, 5, 3, 2)).select("candidate_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 2)]


def test_a_provider_replaces_the_default(tables):
    c, t, k = tables
    p = Providers(similarity=lambda a, b: F.lit(0.5))
    assert all(r["similarity"] == 0.5 for r in pipeline.search(c, t, k, PRESETS["canonical"], p).collect())


def test_scores_by_hand(spark):
    d = spark.createDataFrame([("Audit risk of Acme", "Audit of Acme", "x\n## Audit risk\ny", ["audit", "no such"])], "q string, h string, c string, k array<string>")
    p, qt, ct = Providers(), F.array_distinct(lexical.T.terms(F.col("q"))), lexical.T.terms(F.col("c"))
    r = d.select(pipeline.heading_relevance(F.col("q"), qt, F.col("h"), p), pipeline.hierarchy_bonus(F.col("q"), qt, F.col("c"), p), pipeline.keyword_score(F.col("k"), F.col("c"), ct, p)).first()
    assert r[0] == pytest.approx(0.3 * 2 / 3 + 0.3 + 0.4 * 2 / math.sqrt(6))  # names: Audit, Acme
    assert r[1] == pytest.approx((0.3 * 2 / 3 + 0.3 * 1 / 2 + 0.4 * 2 / math.sqrt(6)) / 2)
    assert r[2] == pytest.approx(0.6 / 2 + 0.4 * (1 / math.sqrt(2) + 0) / 2)
    assert spark.range(1).select(cosine_of_terms(F.array(), F.array(F.lit("a")))).first()[0] == 0


def test_phrases_stand_where_their_words_do(spark):
    docs = spark.createDataFrame([(1, "Working capital, net."), (2, "working. Capital"), (3, "networking capital"), (4, None)], "k int, t string")
    q = spark.createDataFrame([("q1", "working capital needs", ["Working Capital", "working-capital", "net"]), ("q2", "x", None)], "q string, text string, kw array<string>")
    assert rows(lexical.phrases(q, "q", "kw")) == [("q1", "working capital")]
    assert rows(lexical.phrase_postings(docs, "k", "t", lexical.phrases(q, "q", "kw"))) == [(1, "working_capital"), (2, "working_capital")]
    pool = lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw").collect()
    assert [(r["q"], r["k"]) for r in sorted(pool, key=lambda r: r["rank"])][0] == ("q1", 1) and {r["q"] for r in pool} == {"q1"}


def test_tfidf_dedupe_is_greedy(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta"
    d = spark.createDataFrame([("q", 1, 1, long), ("q", 2, 2, long), ("q", 3, 3, "other words here"), ("q", 4, 4, None), ("p", 5, 1, long)], "q string, i int, r int, t string")
    links = fusion.tfidf_links(d, "q", "i", "r", "t", 0.9)
    assert rows(links) == [("q", 1, 2)]
    assert [r[1] for r in rows(fusion.greedy_dedupe(d.select("q", "i", "r"), links, "q", "i", "r"))] == [5, 1, 3, 4]


def test_match_scores_against_all_pairs(spark):
    bench = [(1, "The audit found gaps, and costs rose by ten percent. Short one here."), (2, None), (3, "Equal text")]
    docs = [(10, "equal text"), (11, "In 2020 the audit found gaps everywhere"), (12, "costs rose by ten percent of the audit found gaps and"), (13, None), (14, ""), (15, "short here one")]
    b, d = spark.createDataFrame(bench, "item_id int, text string"), spark.createDataFrame([(*r, 1) for r in docs], "doc_id int, text string, sid int")
    assert rows(qc.match_scores(b, d)) == [(1, 0, 11, 0.9), (1, 0, 12, 1.0), (1, 1, 15, 1.0), (3, 0, 10, 1.0)]
    how = {(r[0], r[1]): r[2] for r in qc.cascade(b, d).collect()}
    assert how == {(1, 0): "overlap", (1, 1): "overlap", (3, 0): "exact"}
    assert qc.match_scores(b.limit(0), d).count() == 0 and qc.cascade(b, d.limit(0)).filter("how <> 'none'").count() == 0


def test_pair_scores_by_hand(spark):
    d = spark.createDataFrame([(1, "audit risk", "audit plan"), (2, None, "x"), (3, "same words", "same words")], "k int, a string, b string")
    pairs = qc.arrays(d, ["k"], "a", "a").join(qc.arrays(d, ["k"], "b", "b"), "k")
    got = {r["k"]: r for r in qc.pair_scores(pairs, ["k"]).collect()}
    w = math.log(1.5) + 1
    assert got[1]["tfidf"] == pytest.approx(100 / (1 + 2 * w * w), abs=1e-6) and got[1]["exact"] == 50
    assert got[2]["tfidf"] == got[2]["exact"] == 0 and got[3]["tfidf"] == got[3]["fuzzy"] == 100
    top, means = qc.analysis(qc.pair_scores(pairs, ["k"]).withColumn("item_id", F.lit(1)).withColumnRenamed("k", "doc_id"), spark.createDataFrame([(1,), (2,)], "item_id int"))
    assert [tuple(r)[:2] for r in top.orderBy("rank").collect()] == [(1, 3), (1, 1)]
    assert {r["item_id"]: (r["n"], r["pattern"]) for r in means.collect()} == {1: (2, "concentrated"), 2: (0, "none")}


def test_signals_are_the_same_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(i, i % 5, [float(i % 3), 1.0, float(i % 7)]) for i in range(40)], "vec_id bigint, label int, embedding array<double>")
    hits = spark.createDataFrame([(0, i) for i in range(5, 15)], "qid bigint, vec_id bigint")
    whole = rows(mor.pre_signal(e, mor.centroids(e))), rows(mor.post_signal(hits, e, mor.centroids(e)))
    monkeypatch.setattr(mor, "BLOCK", 2)
    assert (rows(mor.pre_signal(e, mor.centroids(e))), rows(mor.post_signal(hits, e, mor.centroids(e)))) == whole


def test_row_numbers_and_release(spark):
    d = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k bigint")
    assert rows(numbered(d, "k").select("k", "n")) == [(i, i + 1) for i in range(101)] and numbered(d.limit(0), "k").count() == 0
    assert release() > 0 and release() == 0


def test_local_scores_keep_the_best_of_each_page(spark):
    d = spark.createDataFrame([("f", 1, "a", "audit risk"), ("f", 1, "b", "audit risk"), ("f", 1, "c", "x"), ("f", 2, "d", None)], "document string, page_no int, chunk_id string, chunk string")
    assert rows(pages.local_scores(d, ["audit", "risk"]).select("chunk_id", "rank")) == [("a", 1), ("b", 2), ("d", 1)]


def test_best_pairs_against_scores_of_joined_pairs(spark):
    words = ["audit", "risk", "the", "of", "costs", "rose", "a", "plan", "water", "use", "net"]
    text = lambda i, n: " ".join(words[(i * j + j * j) % len(words)] for j in range(1, n))
    bench = spark.createDataFrame([*((i, text(i, 9)) for i in range(1, 40)), (50, None), (51, "the of a")], "item_id int, text string")
    docs = spark.createDataFrame([*((i, text(3 * i + 1, 2 + i % 13)) for i in range(60)), (70, None), (71, "")], "doc_id int, text string")
    x = qc.arrays(bench, ["item_id"], "text", "a").crossJoin(qc.arrays(docs.filter("text is not null"), ["doc_id"], "text", "b"))
    want = qc.pair_scores(x, ["item_id", "doc_id"]).filter("semantic > 15").drop("cautious", "generous")
    got = qc.best_pairs(bench, docs, n=100, block_words=100)  # in several blocks
    assert rows(got.drop("top", "met")) == rows(want) and want.count() > 500
    few = qc.best_pairs(bench, docs, n=3)
    pick = lambda a: (rows(a[0].filter("rank <= 3")), rows(a[1].select("item_id", "n", "pattern")))
    assert pick(qc.analysis(few, bench, met=F.sum("met"))) == pick(qc.analysis(want, bench))
    assert qc.best_pairs(bench.limit(0), docs).count() == qc.best_pairs(bench, docs.limit(0)).count() == 0


def test_match_question_against_all_pairs(spark):
    import random

    r = random.Random(5)
    text = lambda: " ".join(r.choice("how did net debt of acme change after 2016 and what part".split()) for _ in range(r.choice([1, 2, 3, 5, 9, 16, 70, 90])))
    vary = lambda t: " ".join(w for w in t.split() if r.random() > 0.08) + r.choice(["", " x", "?"])
    long = [" ".join(f"w{j}" for j in range(n)) for n in (50, 55, 63, 64, 65, 66, 79)]
    known = [text() for _ in range(60)] + long + ["???", "Net  Debt"]
    asked = [vary(r.choice(known)) for _ in range(200)] + long + ["???", "net debt", "", "何"]
    q, k = spark.createDataFrame([(x,) for x in asked], "t string"), spark.createDataFrame([(i, x) for i, x in enumerate([*known, None])], "kw_id int, question string")
    flat = lambda t: " ".join(t.lower().split())
    bag = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    last = {flat(x): i for i, x in enumerate(known)}
    want = {}
    for t in set(asked):
        a, rank = bag(t), []
        for x, i in last.items():
            b = bag(x)
            over = round(len(a & b) / max(len(a), len(b)), 6) if a or b else 0
            if x == flat(t) or over > 0.8:
                rank.append((x != flat(t), -over, i))
        if rank:
            other, over, i = min(rank)
            want[t] = (i, "overlap" if other else "exact", -over)
    got = {x["t"]: (x["kw_id"], x["how"], 0 if math.isnan(x["overlap"]) else x["overlap"]) for x in lexical.match_question(q, k, "t", "t").collect()}
    assert got == want and {x[1] for x in want.values()} == {"exact", "overlap"}


def test_frequent_words_make_few_signatures_meet(spark):
    d = spark.createDataFrame([(f"how did debt of the group {i} change in {i + 1000}",) for i in range(200)], "s string")
    n = lexical.signatures(d, 0.8).groupBy("g").count().selectExpr("sum(count * count)").first()[0]
    assert n < 200 * 40  # words alone make 200 * 200 pairs for every frequent word


def test_tfidf_dedupe_of_streamed_groups(spark):
    import random

    r = random.Random(3)
    d = spark.createDataFrame([(f"q{g}", 100 * g + i, i, None if r.random() < 0.1 else " ".join(r.choice("ab bc cd de".split()) for _ in range(r.randint(0, 4)))) for g in range(30) for i in range(r.randint(1, 9))], "q string, i int, r int, t string")
    links = fusion.tfidf_links(d, "q", "i", "r", "t", 0.9)
    want = rows(fusion.greedy_dedupe(d.select("q", "i", "r"), links, "q", "i", "r"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # groups reach over batches
    try:
        out = fusion.tfidf_dedupe(d, "q", "i", "r", "t", 0.9)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # texts move once, no term does
        assert rows(out) == want and len(want) < d.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert fusion.tfidf_dedupe(d.limit(0), "q", "i", "r", "t", 0.9).count() == 0


def test_chunk_queries_list_no_pairs(spark, tmp_path, monkeypatch):
    from tessellar.plans import qc as plans

    spark.createDataFrame([(1, "audit risk rose"), (2, "none")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "audit risk") for i in range(7)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(qc, "pair_tfidf", lambda *a: pytest.fail("pairs are exploded"))
    assert [tuple(r)[:2] for r in plans.chunk_analysis(spark, tmp_path).orderBy("rank").collect()] == [(1, i) for i in range(7)]
    assert [tuple(r)[:3] for r in plans.chunk_method_means(spark, tmp_path).orderBy("item_id").collect()] == [(1, 7, "concentrated"), (2, 0, "none")]


def test_keyword_pool_in_blocks_equals_joined_scores(spark, monkeypatch):
    import random

    r = random.Random(7)
    words = "audit risk costs rose plan water use net debt group board".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([*((i, text(r.randint(0, 14))) for i in range(120)), (500, None)], "k int, t string")
    q = spark.createDataFrame([*((f"{text(3)} {i}", ["net debt", r.choice(words)]) for i in range(12)), ("zzz", None)], "q string, kw array<string>").withColumn("text", F.col("q"))
    sides = {}
    for name in ("bm25", "tfidf"):
        real = getattr(lexical, name)
        monkeypatch.setattr(lexical, name, lambda *a, real=real, name=name, **k: sides.setdefault(name, real(*a, **k)) if k.get("sides") else pytest.fail("pairs are listed"))
    got = lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw", 9)
    score = lambda name: sides[name][0].join(sides[name][1], "term").groupBy("q", "k").agg(F.round(F.sum(F.col("v") * F.col("w")), 6).alias(name))
    want = rows(lexical.lexical_pool(score("bm25"), score("tfidf"), "q", "k", 9))
    assert rows(got) == want and len(want) > 90
    assert rows(lexical.pool_of_sides(sides["bm25"], sides["tfidf"], "q", "k", 9, block=20)) == want
    assert lexical.pool_of_sides(tuple(x.limit(0) for x in sides["bm25"]), tuple(x.limit(0) for x in sides["tfidf"]), "q", "k", 9).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_keyword_pool_by_index_equals_joined_scores(spark, monkeypatch, seed):
    import random

    r = random.Random(seed)
    words = "the audit risk costs rose plan of water use net debt group board x".split() + [f"w{i}" for i in range(90)]
    text = lambda n: " ".join(r.choices(words, [40 / (i + 3) for i in range(len(words))], k=n))
    docs = spark.createDataFrame([*((f"d{i}", text(r.randint(0, 60) if i % 9 else 3)) for i in range(700)), ("dx", None), ("dy", "  ")], "k string, t string").repartition(3)
    q = spark.createDataFrame([*((f"{text(4)} {i}", ["net debt", "use of water", "the x", text(2), r.choice(words)][: r.randint(0, 5)]) for i in range(40)), ("zzz", None), ("w89", ["w88"]), ("the", ["of the"])], "q string, kw array<string>").withColumn("text", F.col("q"))
    monkeypatch.setattr(lexical, "MANY", 1 << 60)
    want = rows(lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw", 9))
    monkeypatch.setattr(lexical, "MANY", 0)
    for name in ("bm25", "tfidf", "pool_of_sides"):
        monkeypatch.setattr(lexical, name, lambda *a, **k: pytest.fail("postings of all terms are shuffled"))
    assert rows(lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw", 9)) == want and len(want) > 300
    real = lexical.lexical_index.pool
    monkeypatch.setattr(lexical.lexical_index, "pool", lambda *a: real(*a, block=50, most=7))
    assert rows(lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw", 9)) == want


def test_keyword_pool_of_terms_that_weigh_less_than_zero(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "audit risk" if i else "audit") for i in range(9)], "k int, t string")
    q = spark.createDataFrame([("audit risk", ["audit risk"])], "q string, kw array<string>").withColumn("text", F.col("q"))
    want = rows(lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw", 4))
    monkeypatch.setattr(lexical, "MANY", 0)
    assert rows(lexical.keyword_pool(docs, q, "k", "t", "q", "text", "kw", 4)) == want and len(want) == 4
