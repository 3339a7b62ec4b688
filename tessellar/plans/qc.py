"""Queries over the match of benchmark sentences and documents, by the rules of the quality check."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.operators import coverage, qc
from tessellar.plans.presets import _cos
from tessellar.plans.retrieval import _GRAMS, _TERMS, _tf_sql
from tessellar.plans.text_queries import BARE, SENTS, WORDS, typed
from tessellar.session import cut


def _t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def qc_sentence_matches(s, d):
    return qc.match_scores(_t(s, d, "benchmark"), _t(s, d))


def _covers(s, d):
    m = qc_sentence_matches(s, d).withColumnRenamed("score", "overlap")
    totals = cut(qc.sentences(_t(s, d, "benchmark")).groupBy("item_id").agg(F.count("*").alias("n")), "totals")
    return coverage.greedy_cover(coverage.assign(m), totals, least=0.0), totals


def qc_cover(s, d):
    """Each sentence to its best document, then the documents that cover an item."""
    return _covers(s, d)[0]


def qc_coverage(s, d):
    return coverage.report(*_covers(s, d))


def coverage_cascade(s, d):
    return qc.cascade(_t(s, d, "benchmark"), _t(s, d))


def coverage_methods(s, d):
    return coverage_cascade(s, d).groupBy("how").agg(F.count("*").alias("n"))


def sentence_candidates(s, d):
    """Of each benchmark sentence 25 documents by TF-IDF and 25 by similarity."""
    x = qc.sentences(_t(s, d, "benchmark")).select(F.concat_ws(":", "item_id", "sid").alias("sk"), "sentence")
    return qc.candidates(x, _t(s, d).filter("text IS NOT NULL"), "sk", "sentence")


def _results(s, d):
    f = _t(s, d, "final_results").groupBy("result_id").agg(F.max_by(F.struct("extracted_sentences", "chunk_context"), "ingested_at").alias("r"))
    return f.select("result_id", "r.*")


def _pairs(s, d):
    f = _results(s, d)
    return qc.arrays(f, ["result_id"], "extracted_sentences", "a").join(qc.arrays(f, ["result_id"], "chunk_context", "b"), "result_id")


def pair_tfidf(s, d):
    return qc.pair_tfidf(_pairs(s, d), ["result_id"]).select("result_id", F.round("raw", 6).alias("tfidf"))


def pair_scores(s, d):
    return qc.pair_scores(_pairs(s, d), ["result_id"])


def _analysis(s, d):
    """Scores of every item and document that holds more than 15 % of its words."""
    b = _t(s, d, "benchmark")
    return qc.analysis(cut(qc.best_pairs(b, _t(s, d)), "best_pairs"), b, met=F.sum("met"))


def chunk_analysis(s, d):
    return _analysis(s, d)[0]


def chunk_method_means(s, d):
    return _analysis(s, d)[1]


_FR = f"list_filter(list_transform(regexp_split_to_array(lower(sentence), '[,;]|\\s(?:and|but|or|although|though)\\s'), lambda x: {BARE.format('x')}), lambda x: x <> '')"
_S = f"""qs AS (SELECT * FROM (SELECT item_id, sid, sentence, {BARE.format('sentence')} AS b, list_distinct({WORDS.format(BARE.format('sentence'))}) AS w FROM (SELECT item_id, unnest(range(len(s)))::INT AS sid, unnest(s) AS sentence FROM (SELECT item_id, {SENTS.format('text')} AS s FROM benchmark))) WHERE len(w) > 0),
 qd AS (SELECT doc_id, t, list_distinct({WORDS.format('t')}) AS dw FROM (SELECT doc_id, {BARE.format('text')} AS t FROM documents WHERE text IS NOT NULL)),
 qu AS (SELECT item_id, sid, -1 AS u, b AS f, w AS uw FROM qs UNION ALL SELECT item_id, sid, u, f, list_distinct({WORDS.format('f')}) FROM (SELECT item_id, sid, unnest(range(len(fr))) AS u, unnest(fr) AS f FROM (SELECT item_id, sid, {_FR} AS fr FROM qs)) WHERE len({WORDS.format('f')}) > 0),
 qh AS (SELECT item_id, sid, u, doc_id, count(*) AS c FROM (SELECT item_id, sid, u, unnest(uw) AS word FROM qu) JOIN (SELECT doc_id, unnest(dw) AS word FROM qd) USING (word) GROUP BY 1, 2, 3, 4),
 qv AS (SELECT item_id, sid, u, doc_id, c, len(uw) AS n, len(dw) AS m, f, t FROM qh JOIN qu USING (item_id, sid, u) JOIN qd USING (doc_id))"""
_M = f"{_S}, qm AS (SELECT item_id, sid, doc_id, round(CASE WHEN bool_or(u = -1 AND f = t) THEN 1 ELSE max(CASE WHEN u = -1 THEN greatest(CASE WHEN c / n >= 0.95 THEN c / n ELSE 0 END, CASE WHEN c / sqrt(n * m) >= 0.95 THEN c / sqrt(n * m) ELSE 0 END) WHEN c = n AND contains(' ' || t || ' ', ' ' || f || ' ') THEN 0.9 WHEN c / n > 0.95 THEN c / n ELSE 0 END) END, 6) AS score FROM qv GROUP BY 1, 2, 3), mm AS (SELECT * FROM qm WHERE score > 0)"
_C = f"""{_M}, sa AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY item_id, sid ORDER BY score DESC, doc_id) = 1), tt AS (SELECT item_id, count(*) AS n FROM qs GROUP BY 1), gc AS (SELECT item_id, doc_id, count(*) AS covered FROM sa GROUP BY 1, 2),
 gp AS (SELECT item_id, doc_id, covered, n, row_number() OVER (PARTITION BY item_id ORDER BY covered DESC, doc_id) AS pick, coalesce(sum(covered) OVER (PARTITION BY item_id ORDER BY covered DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gc JOIN tt USING (item_id)), cov AS (SELECT item_id, doc_id, covered, pick::INT AS pick FROM gp WHERE pick <= 5 AND before < ceil(n * 0.95))"""
_TFS = _tf_sql(False).replace("FROM documents", "FROM documents WHERE text IS NOT NULL").replace("FROM benchmark", "FROM bq").replace("item_id", "sk")
_CA = f"""bq AS (SELECT concat_ws(':', item_id, sid) AS sk, sentence AS question FROM qs), {_TFS}, ca AS (SELECT sk, doc_id FROM tf QUALIFY row_number() OVER (PARTITION BY sk ORDER BY tfidf DESC, doc_id) <= 25),
 nq AS (SELECT sk, len(q) AS n, unnest(q) AS term FROM (SELECT sk, list_distinct({_TERMS.format('question')}) AS q FROM bq)), nd AS (SELECT doc_id, len(q) AS m, unnest(q) AS term FROM (SELECT doc_id, list_distinct({_TERMS.format('text')}) AS q FROM documents WHERE text IS NOT NULL)),
 ne AS (SELECT sk, doc_id, round(count(*) / sqrt(any_value(n) * any_value(m)), 6) AS near FROM nq JOIN nd USING (term) GROUP BY 1, 2), cd AS (SELECT sk, doc_id FROM ca UNION SELECT sk, doc_id FROM (SELECT * FROM ne QUALIFY row_number() OVER (PARTITION BY sk ORDER BY near DESC, doc_id) <= 25))"""
_CAS = f"""{_S}, {_CA}, qk AS (SELECT concat_ws(':', item_id, sid) AS sk, b, w, {_FR} AS fr, sentence FROM qs), cx AS (SELECT sk, doc_id, len(w) AS n, list_intersect(w, dw) AS hit, contains(' ' || t || ' ', ' ' || b || ' ') AS sub, len(list_intersect(w, dw)) / sqrt(len(w) * len(dw)) AS near,
 len(list_filter(fr, lambda x: len({WORDS.format('x')}) > 0 AND (contains(' ' || t || ' ', ' ' || x || ' ') OR len(list_intersect(list_distinct({WORDS.format('x')}), dw)) / len(list_distinct({WORDS.format('x')})) >= 0.8))) > 0 AS frag FROM cd JOIN qk USING (sk) JOIN qd USING (doc_id)),
 fl AS (SELECT sk, bool_or(sub) AS sub, max(len(hit) / n) AS over, bool_or(frag) AS frag, max(near) AS near FROM cx GROUP BY 1), tw AS (SELECT a.sk, max((len(a.hit) + len(b.hit) - len(list_intersect(a.hit, b.hit))) / a.n) AS two FROM cx a JOIN cx b ON a.sk = b.sk AND a.doc_id < b.doc_id GROUP BY 1),
 kv AS (SELECT DISTINCT unnest({_TERMS.format('text')}) AS term, 1 AS known FROM documents), kk AS (SELECT sk, count(known) / count(*) AS kw FROM nq LEFT JOIN kv USING (term) GROUP BY 1),
 cas AS (SELECT item_id, sid, CASE WHEN b IN (SELECT t FROM qd) THEN 'exact' WHEN sub THEN 'substring' WHEN over >= 0.8 THEN 'overlap' WHEN frag THEN 'fragment' WHEN near >= 0.8 THEN 'semantic' WHEN two >= 0.8 THEN 'multi-sent' WHEN kw >= 0.9 THEN 'keywords' ELSE 'none' END AS how FROM (SELECT *, concat_ws(':', item_id, sid) AS sk FROM qs) LEFT JOIN fl USING (sk) LEFT JOIN tw USING (sk) LEFT JOIN kk USING (sk))"""
_PR = "pr AS (SELECT result_id, r.a AS a, r.b AS b FROM (SELECT result_id, arg_max({'a': extracted_sentences, 'b': chunk_context}, ingested_at) AS r FROM final_results GROUP BY 1))"


def _pair(keys: str) -> str:
    """CTE ``ps`` of the scores of the pairs ``pr (keys, a, b)``."""
    g = lambda c: _GRAMS.replace("t[", f"{c}[").replace("(t,", f"({c},").replace("len(t)", f"len({c})")
    using = f"USING ({keys})"
    share = lambda f: f"CASE WHEN len(list_distinct({f('a')})) > 0 THEN 100 * len(list_intersect(list_distinct({f('a')}), {f('b')})) / len(list_distinct({f('a')})) ELSE 0 END"
    return f"""pt AS (SELECT {keys}, {_TERMS.format("coalesce(a, '')")} AS ta, {_TERMS.format("coalesce(b, '')")} AS tb FROM pr), pg AS (SELECT {keys}, g, sum(x) AS x, sum(y) AS y FROM (SELECT {keys}, unnest({g('ta')}) AS g, 1 AS x, 0 AS y FROM pt UNION ALL SELECT {keys}, unnest({g('tb')}), 0, 1 FROM pt) GROUP BY ALL),
 pw AS (SELECT {keys}, sum(x * y) AS dot, sum(pow(x * CASE WHEN x > 0 AND y > 0 THEN 1 ELSE ln(1.5) + 1 END, 2)) AS na, sum(pow(y * CASE WHEN x > 0 AND y > 0 THEN 1 ELSE ln(1.5) + 1 END, 2)) AS nb FROM pg GROUP BY ALL),
 pf AS (SELECT {keys}, coalesce(CASE WHEN na > 0 AND nb > 0 THEN 100 * dot / sqrt(na * nb) ELSE 0 END, 0) AS v FROM pr LEFT JOIN pw {using}),
 pe AS (SELECT {keys}, {share(lambda c: WORDS.format(c))} AS e, 100 * ({_cos(_TERMS.format("coalesce(a, '')"), _TERMS.format("coalesce(b, '')"))}) AS f, {share(lambda c: _TERMS.format(f"coalesce({c}, '')"))} AS m FROM pr),
 ps AS (SELECT {keys}, round(e, 6) AS exact, round(f, 6) AS fuzzy, round(v, 6) AS tfidf, round(m, 6) AS semantic, round((e + v) / 2, 6) AS cautious, round(0.35::DOUBLE * e + 0.15::DOUBLE * f + 0.5::DOUBLE * m, 6) AS generous FROM pe JOIN pf {using})"""


_AN = f"bw AS (SELECT item_id, text, list_distinct({_TERMS.format('text')}) AS bw FROM benchmark), dw AS (SELECT doc_id, text, list_distinct({_TERMS.format('text')}) AS dw FROM documents WHERE text IS NOT NULL), pr AS (SELECT item_id, doc_id, bw.text AS a, dw.text AS b FROM bw, dw WHERE len(bw) > 0 AND 100 * len(list_intersect(bw, dw)) / len(bw) > 15), {_pair('item_id, doc_id')}, an AS (SELECT *, greatest(exact, fuzzy, tfidf, semantic) AS top FROM ps), ar AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY top DESC, doc_id)::INT AS rank FROM an WHERE top > 15)"
SQL = {
    "qc_sentence_matches": f"WITH {_M} SELECT * FROM mm",
    "qc_cover": f"WITH {_C} SELECT * FROM cov",
    "qc_coverage": typed(f"WITH {_C} SELECT item_id, n AS sentences, coalesce(sum(covered), 0) AS covered, round(100 * coalesce(sum(covered), 0) / n, 6) AS coverage, count(doc_id) AS documents FROM tt LEFT JOIN cov USING (item_id) GROUP BY 1, 2", covered="BIGINT"),
    "coverage_cascade": f"WITH {_CAS} SELECT * FROM cas",
    "coverage_methods": f"WITH {_CAS} SELECT how, count(*) AS n FROM cas GROUP BY 1",
    "sentence_candidates": f"WITH {_S}, {_CA} SELECT * FROM cd",
    "pair_tfidf": f"WITH {_PR}, {_pair('result_id')} SELECT result_id, round(v, 6) AS tfidf FROM pf",
    "pair_scores": f"WITH {_PR}, {_pair('result_id')} SELECT result_id, exact, fuzzy, tfidf, semantic, cautious, generous FROM ps",
    "chunk_analysis": f"WITH {_AN} SELECT item_id, doc_id, top, rank FROM ar WHERE rank <= 10",
    "chunk_method_means": f"WITH {_AN}, am AS (SELECT item_id, count(*) AS n, max(top) AS most, round(avg(exact) FILTER (rank <= 5), 6) AS exact, round(avg(fuzzy) FILTER (rank <= 5), 6) AS fuzzy, round(avg(tfidf) FILTER (rank <= 5), 6) AS tfidf, round(avg(semantic) FILTER (rank <= 5), 6) AS semantic FROM ar GROUP BY 1) SELECT item_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 OR most >= 80 THEN 'concentrated' WHEN most < 60 THEN 'distributed' ELSE 'mixed' END AS pattern, coalesce(exact, 0) AS exact, coalesce(fuzzy, 0) AS fuzzy, coalesce(tfidf, 0) AS tfidf, coalesce(semantic, 0) AS semantic FROM benchmark LEFT JOIN am USING (item_id)",
}
QUERIES = {f.__name__: f for f in (qc_sentence_matches, qc_cover, qc_coverage, coverage_cascade, coverage_methods, sentence_candidates, pair_tfidf, pair_scores, chunk_analysis, chunk_method_means)}
