"""The retrieval pipeline by each preset, and its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tessellar.config import PRESETS, PipelineConfig
from tessellar.operators import pipeline
from tessellar.operators.pipeline import SUBQUERIES
from tessellar.plans import retrieval as R
from tessellar.plans.retrieval import _TERMS
from tessellar.plans.text_queries import SENTS


def keywords_of_queries(s, d):
    """``(query, keywords)``: of each query that was run the keywords that stood beside it."""
    f = R._t(s, d, "final_results").filter("trim(query) <> ''").groupBy(F.trim("query").alias("query")).agg(F.max("keywords").alias("k"))
    return f.select("query", F.array_distinct(F.filter(F.transform(F.split("k", ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("keywords"))


def chunk_texts(s, d):
    """``(chunk_id, chunk, heading)``, one row each."""
    return R._t(s, d, "pool_candidates").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("chunk").alias("chunk"), F.max("heading").alias("heading"))


def search(s, d, preset: str):
    return pipeline.search(R.candidates(s, d), chunk_texts(s, d), keywords_of_queries(s, d), PRESETS[preset])


_D = "::DOUBLE"
_NAMES = R._NAMES


def _cos(a: str, b: str) -> str:
    x, y = f"list_distinct({a})", f"list_distinct({b})"
    return f"CASE WHEN coalesce(len({a}), 0) > 0 AND coalesce(len({b}), 0) > 0 THEN len(list_intersect({x}, {y})) / sqrt(len({x}) * len({y})) ELSE 0 END"


def _terms(c: str) -> str:
    return _TERMS.format(f"coalesce({c}, '')")


def _heading(h: str) -> str:
    part = lambda a, b: f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0 END)"
    return f"CASE WHEN {h} IS NOT NULL THEN 0.3{_D} * {part('qt', _terms(h))} + 0.3{_D} * {part(_NAMES.format('query'), _NAMES.format(h))} + 0.4{_D} * ({_cos('qt', _terms(h))}) ELSE 0 END"


_KWQ = "kq AS (SELECT query, list_distinct(list_filter(list_transform(string_split(k, ';'), lambda x: trim(x)), lambda x: x <> '')) AS keywords FROM (SELECT trim(query) AS query, max(keywords) AS k FROM final_results WHERE trim(query) <> '' GROUP BY 1))"
_TXT = "ch AS (SELECT chunk_id, max(chunk) AS chunk, max(heading) AS heading FROM pool_candidates WHERE chunk_id IS NOT NULL GROUP BY 1)"
_KW = f"CASE WHEN len(keywords) > 0 THEN 0.6{_D} * len(list_filter(keywords, lambda x: contains(lower(chunk), lower(x)))) / len(keywords) + 0.4{_D} * list_sum(list_transform(keywords, lambda x: {_cos(_terms('x'), _terms('chunk'))})) / len(keywords) ELSE 0 END"


def _cut(name: str, source: str, score: str, n: int, expr: str, partition: str = "query") -> str:
    return f"{name} AS (SELECT *, {expr} AS {score} FROM {source} QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY {score} DESC, candidate_id) <= {n})"


def sql(cfg: PipelineConfig) -> str:
    bm, tf = "(bm25_score - b0) / (b1 - b0 + 1e-8)", "(tfidf_score - t0) / (t1 - t0 + 1e-8)"
    lexical = f"{cfg.lexical_mix[0]}{_D} * ({bm}) + {cfg.lexical_mix[1]}{_D} * ({tf})"
    steps = [R._CAND, "x AS (SELECT * FROM c WHERE bm25_score IS NOT NULL AND tfidf_score IS NOT NULL)", "m AS (SELECT query, min(bm25_score) AS b0, max(bm25_score) AS b1, min(tfidf_score) AS t0, max(tfidf_score) AS t1 FROM x GROUP BY 1)", _KWQ, _TXT]
    text = f"SELECT *, list_distinct({_terms('query')}) AS qt, round({_KW}, 9) AS kw FROM {{0}} JOIN ch USING (chunk_id) LEFT JOIN kq USING (query)"
    if len(cfg.lexical_mix) > 2:
        steps += [f"w AS ({text.format('x JOIN m USING (query)')})", _cut("k", "w", "pool_score", cfg.pool, f"round({lexical} + {cfg.lexical_mix[2]}{_D} * kw, 9)")]
    else:
        steps += [_cut("k0", "x JOIN m USING (query)", "pool_score", cfg.pool, f"round({lexical}, 9)"), f"k AS ({text.format('k0')})"]
    steps.append(f"n AS (SELECT *, round({_cos('qt', _terms('chunk'))}, 9) AS near FROM k)")
    if cfg.fuse == "scores":
        mix = cfg.dense_mix
        steps.append(_cut("e", "n", "dense", cfg.dense, f"round({mix[0]}{_D} * pool_score + {mix[1]}{_D} * near" + (f" + {mix[2]}{_D} * kw" if len(mix) > 2 else "") + ", 9)"))
    else:
        base = "n"
        if cfg.fuse == "nearest":
            steps.append(f"n2 AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY near DESC, candidate_id) <= {cfg.pool})")
            base = "n2"
        lists = [("pool", "pool_score")]
        if cfg.fuse == "subqueries":
            whole = f"array_to_string({_terms('query')}, ' ')"
            lists += [(f"sub{i}", f"round({_cos(_terms(f"('{t}' || {whole})"), _terms('chunk'))}, 9)") for i, t in enumerate(SUBQUERIES)]
        else:
            lists.append(("near", "near"))
        steps.append("l AS (" + " UNION ALL ".join(f"SELECT query, candidate_id, '{m}' AS method, {v} AS v FROM {base}" for m, v in lists) + ")")
        steps.append(f"lr AS (SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY v DESC, candidate_id) AS r FROM l QUALIFY r <= {cfg.pool})")
        steps.append("rf AS (SELECT query, candidate_id, round(sum(1.0 / (r - 1 + 60)), 9) AS rrf FROM lr GROUP BY 1, 2)")
        steps.append(_cut("e", f"{base} JOIN rf USING (query, candidate_id)", "dense", cfg.dense, f"round(rrf * (1 + {cfg.main}{_D} * near), 9)"))
    if cfg.neural:
        m = cfg.neural_mix
        rel = f"(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {_terms('chunk')})) / len(qt) ELSE 0 END)"
        steps.append(_cut("g", "e", "neural", cfg.neural, f"round({m[0]}{_D} * pool_score + {m[1]}{_D} * dense + {m[2]}{_D} * {rel}, 9)"))
    else:
        steps.append("g AS (SELECT *, dense AS neural FROM e)")
    more = f"{cfg.context}{_D} * 0.1{_D} * len(list_intersect(qt, {_terms('chunk')})) + {cfg.context}{_D} * 0.2{_D} * len(list_intersect({_NAMES.format('query')}, {_NAMES.format('chunk')}))"
    if cfg.heading:
        own = "(CASE WHEN NOT contains(lower(heading), 'introduction') THEN heading END)"
        lines = "list_filter(string_split(coalesce(chunk, ''), chr(10)), lambda x: regexp_matches(x, '^#+\\s*\\S'))"
        bonus = f"least(1, coalesce(list_sum(list_transform({lines}, lambda x: ({_heading('x')}) / length(regexp_extract(x, '^(#+)', 1)))), 0))"
        more += f" + {cfg.heading}{_D} * (0.6{_D} * ({_heading(own)}) + 0.4{_D} * {bonus})"
    if cfg.keyword:
        more += f" + {cfg.keyword}{_D} * kw"
    hits = f"list_filter({SENTS.format('chunk')}, lambda z: len(list_intersect({_terms('z')}, qt)) > 0)"
    best = f"list_max(list_transform({hits}, lambda z: {_cos('qt', _terms('z'))}))"
    steps.append(f"h AS (SELECT *, round(neural + {more}, 9) AS enhanced, round(coalesce({best}, {_cos('qt', _terms('substring(chunk, 1, 200)'))}, 0), 9) AS similarity FROM g)")
    last = f"enhanced * (1 + {cfg.sentence}{_D} * similarity)" + (" * (1 + kw)" if cfg.keyword else "")
    steps.append(f"u AS (SELECT query, candidate_id, pool_score, dense, neural, enhanced, similarity, round({last}, 9) AS ultimate FROM h)")
    by = "ultimate" if cfg.sort_by == "ultimate" else "similarity"
    return "WITH " + ", ".join(steps) + " " + R._top("query, candidate_id, pool_score, dense, neural, enhanced, similarity, ultimate", "u", "query", by, "candidate_id", cfg.final)


def _name(preset: str) -> str:
    return "search_pipeline" if preset == "canonical" else f"search_{preset}"


QUERIES = {_name(k): partial(search, preset=k) for k in PRESETS}
SQL = {_name(k): sql(cfg) for k, cfg in PRESETS.items()}
