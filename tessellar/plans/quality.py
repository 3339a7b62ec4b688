"""Queries over retriever mixing, coverage and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.functions.vectors import cosine
from tessellar.operators import coverage, dense, evaluate, fusion, lexical, mor
from tessellar.plans import retrieval as R
from tessellar.plans.retrieval import _TERMS
from tessellar.plans.text_queries import SENTS, WORDS, typed
from tessellar.session import cut


def _t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def _q(s, d):
    return _t(s, d, "embeddings").filter("vec_id % 50 = 0")


def _hits(s, d, n=10):
    return dense.knn(_t(s, d, "embeddings"), _q(s, d), n)


def mor_pre_signal(s, d):
    return mor.pre_signal(_q(s, d), mor.centroids(_t(s, d, "embeddings")))


def mor_post_signal(s, d):
    e = _t(s, d, "embeddings")
    return mor.post_signal(_hits(s, d), e, mor.centroids(e))


def mor_diversity(s, d):
    return mor.diversity(_hits(s, d), _t(s, d, "embeddings"))


def mor_moran(s, d):
    return mor.moran(_hits(s, d), _t(s, d, "embeddings"))


def _scaled(s, d):
    return fusion.scale_each(R.candidates_by_retriever(s, d), ["query", "method"], "score")


def mor_scores(s, d):
    return _scaled(s, d).select("query", "candidate_id", "method", F.round("norm", 6).alias("norm"))


def mor_weights(s, d):
    """Weights of the three score lists from their spread, size and mean."""
    x = _scaled(s, d).groupBy("query", "method").agg(F.round(F.avg("norm"), 6).alias("pre"), F.round(F.coalesce(F.stddev_pop("norm"), F.lit(0.0)), 6).alias("post"), F.round(F.count("*") / 80, 6).alias("moran"))
    return mor.weights(x, "query")


def mor_fuse(s, d):
    return fusion.weighted(_scaled(s, d), mor_weights(s, d), "query", "candidate_id")


def retriever_shares(s, d):
    """What each score list contributes to the fused best 20."""
    top = lexical.best(mor_fuse(s, d), "query", "fused", "candidate_id", 20).select("query", "candidate_id", "fused")
    x = R.candidates_by_retriever(s, d).join(top, ["query", "candidate_id"])
    return x.groupBy("method").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"))


def dense_rerank(s, d):
    """Nearest rows of each query, scored again with their label's agreement."""
    e = _t(s, d, "embeddings")
    x = dense.knn(e, _q(s, d), 80).join(e.select("vec_id", "label"), "vec_id").join(_q(s, d).select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid")
    x = x.select("qid", "vec_id", F.round(0.3 * (F.col("label") == F.col("ql")).cast("int") + 0.7 * F.col("sim"), 6).alias("dense"))
    return lexical.best(x, "qid", "dense", "vec_id", 60)


def main_query_rerank(s, d):
    """Reciprocal-rank fusion times one plus the similarity of the candidate's chunk words to the query's."""
    f = R.rrf_fuse(s, d)
    h = R.heading_score(s, d).select("candidate_id", "heading_share")
    x = f.join(h, "candidate_id").select("query", "candidate_id", F.round(F.col("rrf") * (1 + F.col("heading_share")), 9).alias("score"))
    return lexical.best(x, "query", "score", "candidate_id", 50)


def best_query_match(s, d):
    """For each vector query the most similar other row."""
    return dense.knn(_t(s, d, "embeddings"), _q(s, d), 1).select("qid", "vec_id", "sim")


def vector_agreement(s, d):
    """Cosine in percent, and its band, of each row and the row before it of the same label."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    x = _t(s, d, "embeddings").select("label", "vec_id", F.lag("embedding").over(w).alias("before"), "embedding").filter("before is not null").select("label", "vec_id", F.round(100 * cosine(F.col("embedding"), F.col("before")), 2).alias("pct"))
    return x.select("label", "vec_id", "pct", T.band(F.col("pct")).alias("band"))


def coverage_sentence_scores(s, d):
    return coverage.sentence_scores(_t(s, d, "benchmark"), _t(s, d))


def _totals(s, d):
    return coverage.bench_sentences(_t(s, d, "benchmark")).groupBy("item_id").agg(F.count("*").alias("n"))


def coverage_assign(s, d):
    return coverage.assign(coverage_sentence_scores(s, d))


def coverage_greedy(s, d):
    return coverage.greedy_cover(coverage_assign(s, d), _totals(s, d))


def coverage_report(s, d):
    return coverage.report(coverage_greedy(s, d), _totals(s, d))


def _chunk(s, d):
    """Share in percent of a benchmark item's words that a document holds, above 15, where any sentence matches."""
    b = _t(s, d, "benchmark").select("item_id", F.array_distinct(T.terms(F.col("text"))).alias("bw"))
    x = coverage_sentence_scores(s, d).select("item_id", "doc_id").distinct().join(b, "item_id")
    x = x.join(_t(s, d).select("doc_id", F.array_distinct(T.terms(F.col("text"))).alias("dw")), "doc_id")
    return x.select("item_id", "doc_id", F.round(100 * F.size(F.array_intersect("bw", "dw")) / F.size("bw"), 6).alias("score")).filter("score > 15")


def chunk_coverage(s, d):
    return _chunk(s, d)


def adaptive_coverage(s, d):
    return coverage.adaptive(_chunk(s, d))


def coverage_bands(s, d):
    return _bands(adaptive_coverage(s, d))


def _bands(x):
    b = F.when(F.col("score") >= 90, "90+").when(F.col("score") >= 70, "70+").when(F.col("score") >= 50, "50+").when(F.col("score") >= 30, "30+").otherwise("<30")
    return x.groupBy(b.alias("band"), "pattern").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def chunk_coverage_all(s, d):
    """Share in percent of a benchmark item's words that a document holds, above 15, wherever in the item they stand."""
    return coverage.item_scores(_t(s, d, "benchmark"), _t(s, d))


def adaptive_coverage_all(s, d):
    return coverage.adaptive(cut(chunk_coverage_all(s, d), "item_scores"))


def coverage_bands_all(s, d):
    return _bands(adaptive_coverage_all(s, d))


def _pairs(s, d):
    f = _t(s, d, "final_results").groupBy("result_id").agg(F.max_by(F.struct("extracted_sentences", "chunk_context"), "ingested_at").alias("r"))
    return f.select("result_id", "r.*")


def bleu_pairs(s, d):
    return evaluate.bleu(_pairs(s, d), ["result_id"], "extracted_sentences", "chunk_context")


def rouge_l(s, d):
    return evaluate.rouge_l(_pairs(s, d), "result_id", "extracted_sentences", "chunk_context")


def fuzzy_coverage(s, d):
    return evaluate.ratio(_pairs(s, d), "result_id", "extracted_sentences", "chunk_context")


_CENT = "ce AS (SELECT label, count(*) AS n, list(v ORDER BY i) AS centre FROM (SELECT label, i, avg(v) AS v, count(*) AS c FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1), cn AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), cen AS (SELECT centre, cn.n FROM ce JOIN cn USING (label))"
_HITS = "h AS (" + R._KNN.replace("rank <= 20", "rank <= 10") + ")"
_COS = "(list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1})))"
_PAIR = f"x AS (SELECT qid, vec_id, embedding::DOUBLE[] AS v FROM h JOIN embeddings USING (vec_id)), p AS (SELECT a.qid, a.vec_id AS a, b.vec_id AS b, {_COS.format('a.v', 'b.v')} AS w FROM x a JOIN x b ON a.qid = b.qid AND a.vec_id <> b.vec_id)"
_SCALED = R._LIST + ", mm AS (SELECT query, method, min(score) AS lo, max(score) AS hi FROM rk GROUP BY 1, 2), sc AS (SELECT query, candidate_id, method, score, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END::DOUBLE AS norm FROM rk JOIN mm USING (query, method))"
_WEIGHTS = _SCALED + ", sg AS (SELECT query, method, 0.4::DOUBLE * round(avg(norm), 6) + 0.3::DOUBLE * round(stddev_pop(norm), 6) + 0.3::DOUBLE * round(count(*) / 80, 6) AS s FROM sc GROUP BY 1, 2), wt AS (SELECT query, method, round(CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS weight FROM sg WINDOW w AS (PARTITION BY query))"
_FUSE = _WEIGHTS + ", fu AS (SELECT query, candidate_id, round(sum(weight * norm), 6) AS fused, count(*) AS n_methods FROM sc JOIN wt USING (query, method) GROUP BY 1, 2)"
_BS = f"bs AS (SELECT item_id, sid, sentence, list_distinct({_TERMS.format('sentence')}) AS words FROM (SELECT item_id, unnest(range(len(s)))::INT AS sid, unnest(s) AS sentence FROM (SELECT item_id, {SENTS.format('text')} AS s FROM benchmark)) WHERE len({_TERMS.format('sentence')}) > 0)"
_SS = f"""{_BS}, dw AS (SELECT doc_id, list_distinct({_TERMS.format('text')}) AS dw FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, unnest(dw) AS w FROM dw),
 bl AS (SELECT item_id, sid, len(words) AS n, unnest(words) AS w FROM bs), ss AS (SELECT item_id, sid, doc_id, round(count(*) / any_value(n), 6) AS overlap FROM bl JOIN dl USING (w) GROUP BY 1, 2, 3 HAVING round(count(*) / any_value(n), 6) >= 0.5),
 sa AS (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY item_id, sid ORDER BY overlap DESC, doc_id) = 1), tt AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
 gc AS (SELECT item_id, doc_id, count(*) AS covered FROM sa WHERE overlap >= 0.8 GROUP BY 1, 2), gp AS (SELECT item_id, doc_id, covered, n, row_number() OVER w AS pick, coalesce(sum(covered) OVER (PARTITION BY item_id ORDER BY covered DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gc JOIN tt USING (item_id) WINDOW w AS (PARTITION BY item_id ORDER BY covered DESC, doc_id)),
 cov AS (SELECT item_id, doc_id, covered, pick::INT AS pick FROM gp WHERE pick <= 5 AND before < ceil(n * 0.95))"""
_CH = f"{_SS}, bw AS (SELECT item_id, list_distinct({_TERMS.format('text')}) AS bw FROM benchmark), ck AS (SELECT item_id, doc_id, round(100 * len(list_intersect(bw, dw)) / len(bw), 6) AS score FROM (SELECT DISTINCT item_id, doc_id FROM ss) JOIN bw USING (item_id) JOIN dw USING (doc_id)), cc AS (SELECT * FROM ck WHERE score > 15)"
_AD = f"{_CH}, cr_ AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM cc), ap AS (SELECT item_id, count(*) AS n, coalesce(max(score) FILTER (r = 1), 0) AS a, coalesce(max(score) FILTER (r = 2), 0) AS b, coalesce(max(score) FILTER (r = 3), 0) AS c FROM cr_ GROUP BY 1), ad AS (SELECT item_id, round(CASE WHEN a >= 80 THEN a WHEN n >= 2 AND (a >= 40 OR a + b + c >= 60) THEN least(100, a + 0.7::DOUBLE * b + 0.5::DOUBLE * c) ELSE a END, 6) AS score, CASE WHEN n = 1 OR a >= 80 THEN 'concentrated' WHEN a < 60 THEN 'distributed' ELSE 'mixed' END AS pattern, n FROM ap)"
_CHA = f"bw AS (SELECT item_id, list_distinct({_TERMS.format('text')}) AS bw FROM benchmark), dw AS (SELECT doc_id, list_distinct({_TERMS.format('text')}) AS dw FROM documents WHERE text IS NOT NULL), cc AS (SELECT * FROM (SELECT item_id, doc_id, round(100 * len(list_intersect(bw, dw)) / len(bw), 6) AS score FROM bw, dw WHERE len(bw) > 0) WHERE score > 15)"
_PR = f"pr AS (SELECT result_id, {WORDS.format('r.a')} AS a, {WORDS.format('r.b')} AS b FROM (SELECT result_id, arg_max({{'a': extracted_sentences, 'b': chunk_context}}, ingested_at) AS r FROM final_results GROUP BY 1))"
_G2 = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


def _match(n: int) -> str:
    a, b = ("a", "b") if n == 1 else (_G2.format("a"), _G2.format("b"))
    return f"SELECT result_id, ln(sum(least(ca, coalesce(cb, 0))) / sum(ca) + 1e-10) AS l FROM (SELECT result_id, g, count(*) AS ca FROM (SELECT result_id, unnest({a}) AS g FROM pr) GROUP BY 1, 2) LEFT JOIN (SELECT result_id, g, count(*) AS cb FROM (SELECT result_id, unnest({b}) AS g FROM pr) GROUP BY 1, 2) USING (result_id, g) GROUP BY 1"


SQL = {
    "mor_pre_signal": f"WITH {_CENT}, x AS (SELECT vec_id, cen.n, list_dot_product(e, e) - 2 * list_dot_product(e, centre) + list_dot_product(centre, centre) AS d2 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), cen) SELECT vec_id, round(coalesce(sqrt(sum(CASE WHEN d2 > 1e-9 THEN pow(n / (SELECT count(*) FROM cen) / sqrt(d2), 2) END)), 0.5), 5) AS pre FROM x GROUP BY 1",
    "mor_post_signal": f"WITH {_CENT}, {_HITS}, x AS (SELECT vec_id, sum(CASE WHEN d2 > 1e-9 THEN 1 / d2 END) AS s FROM (SELECT vec_id, list_dot_product(e, e) - 2 * list_dot_product(e, centre) + list_dot_product(centre, centre) AS d2 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), cen) GROUP BY 1) SELECT qid, round(sqrt(sum(s)), 5) AS post FROM h JOIN x USING (vec_id) GROUP BY 1",
    "mor_diversity": f"WITH {_HITS}, {_PAIR} SELECT qid, round(greatest(0, 1 - avg(w)), 5) AS diversity FROM p GROUP BY 1",
    "mor_moran": f"WITH {_HITS}, {_PAIR}, y AS (SELECT qid, vec_id, list_sum(v) AS x FROM x), m AS (SELECT qid, count(*) AS n, avg(x) AS m FROM y GROUP BY 1), z AS (SELECT qid, vec_id, x - m AS z, n FROM y JOIN m USING (qid)), dn AS (SELECT qid, any_value(n) AS n, sum(z * z) AS den FROM z GROUP BY 1), nu AS (SELECT p.qid, sum(w) AS w, sum(w * za.z * zb.z) AS num FROM p JOIN z za ON za.qid = p.qid AND za.vec_id = p.a JOIN z zb ON zb.qid = p.qid AND zb.vec_id = p.b GROUP BY 1) SELECT qid, round(CASE WHEN n >= 3 AND abs(w) > 1e-12 AND den > 1e-12 THEN least(1, greatest(0, (n / w * num / den + 1) / 2)) ELSE 0 END, 5) AS moran FROM dn LEFT JOIN nu USING (qid)",
    "mor_scores": f"WITH {_SCALED} SELECT query, candidate_id, method, round(norm, 6) AS norm FROM sc",
    "mor_weights": f"WITH {_WEIGHTS} SELECT * FROM wt",
    "mor_fuse": f"WITH {_FUSE} SELECT * FROM fu",
    "retriever_shares": f"WITH {_FUSE}, tp AS (SELECT query, candidate_id FROM fu QUALIFY row_number() OVER (PARTITION BY query ORDER BY fused DESC, candidate_id) <= 20) SELECT method, count(*) AS n, min(score) AS least, max(score) AS most, round(avg(score), 6) AS mean FROM rk JOIN tp USING (query, candidate_id) GROUP BY 1",
    "dense_rerank": "WITH h AS (" + R._KNN.replace("rank <= 20", "rank <= 80") + "), x AS (SELECT qid, h.vec_id, round(0.3::DOUBLE * (e.label = q.label)::INT + 0.7::DOUBLE * sim, 6) AS dense FROM h JOIN embeddings e ON e.vec_id = h.vec_id JOIN embeddings q ON q.vec_id = h.qid) " + R._top("qid, vec_id, dense", "x", "qid", "dense", "vec_id", 60),
    "main_query_rerank": "WITH rr AS (" + R.SQL["rrf_fuse"] + "), hs AS (" + R.SQL["heading_score"] + "), x AS (SELECT query, candidate_id, round(rrf * (1 + heading_share), 9) AS score FROM rr JOIN hs USING (candidate_id)) " + R._top("query, candidate_id, score", "x", "query", "score", "candidate_id", 50),
    "best_query_match": "SELECT qid, vec_id, sim FROM (" + R._KNN + ") WHERE rank = 1",
    "vector_agreement": f"SELECT label, vec_id, pct, CASE WHEN pct >= 85 THEN 'Excellent' WHEN pct >= 70 THEN 'Very Good' WHEN pct >= 50 THEN 'Good' WHEN pct >= 30 THEN 'Fair' ELSE 'Poor' END AS band FROM (SELECT label, vec_id, round(100 * {_COS.format('e', 'f')}, 2) AS pct FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)) WHERE pct IS NOT NULL",
    "coverage_sentence_scores": f"WITH {_SS} SELECT * FROM ss",
    "coverage_assign": f"WITH {_SS} SELECT * FROM sa",
    "coverage_greedy": f"WITH {_SS} SELECT * FROM cov",
    "coverage_report": f"WITH {_SS} SELECT item_id, n AS sentences, coalesce(sum(covered), 0) AS covered, round(100 * coalesce(sum(covered), 0) / n, 6) AS coverage, count(doc_id) AS documents FROM tt LEFT JOIN cov USING (item_id) GROUP BY 1, 2",
    "chunk_coverage": f"WITH {_CH} SELECT * FROM cc",
    "adaptive_coverage": f"WITH {_AD} SELECT * FROM ad",
    "coverage_bands": f"WITH {_AD} SELECT CASE WHEN score >= 90 THEN '90+' WHEN score >= 70 THEN '70+' WHEN score >= 50 THEN '50+' WHEN score >= 30 THEN '30+' ELSE '<30' END AS band, pattern, count(*) AS n, round(avg(score), 6) AS mean FROM ad GROUP BY 1, 2",
    "bleu_pairs": f"WITH {_PR}, m1 AS ({_match(1)}), m2 AS ({_match(2)}) SELECT result_id, round(CASE WHEN m1.l IS NULL OR m2.l IS NULL THEN 0 ELSE 100 * exp((m1.l + m2.l) / 2) END, 6) AS bleu FROM pr LEFT JOIN m1 USING (result_id) LEFT JOIN m2 USING (result_id)",
}
for _name in ("chunk_coverage", "adaptive_coverage", "coverage_bands"):  # over all pairs, without the gate by sentences
    SQL[_name + "_all"] = SQL[_name].replace(_CH, _CHA)
SQL["coverage_report"] = typed(SQL["coverage_report"], covered="BIGINT")
QUERIES = {f.__name__: f for f in (mor_pre_signal, mor_post_signal, mor_diversity, mor_moran, mor_scores, mor_weights, mor_fuse, retriever_shares, dense_rerank, main_query_rerank, best_query_match, vector_agreement, coverage_sentence_scores, coverage_assign, coverage_greedy, coverage_report, chunk_coverage, adaptive_coverage, coverage_bands, chunk_coverage_all, adaptive_coverage_all, coverage_bands_all, bleu_pairs, rouge_l, fuzzy_coverage)}
