"""Queries over the page gate, search in rounds, reports, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.operators import pages, segment
from tessellar.plans import retrieval as R
from tessellar.plans import text_queries as X
from tessellar.plans.presets import _cos
from tessellar.plans.retrieval import _TERMS
from tessellar.plans.text_queries import typed
from tessellar.sources import files
from tessellar.streaming import events as E

KEYWORDS = ["climate risk", "dividend", "working capital", "audit", "supply chain"]
_KSQL = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"


def _t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def page_gate(s, d):
    p = segment.split_pages(_t(s, d))
    return pages.gate(p, KEYWORDS).select("doc_id", "ord", "page_no", "relevance", F.array_join("matched", ",").alias("matched"), F.size("missing").alias("n_missing"))


def _chunks(s, d):
    p = _t(s, d, "pool_candidates").filter("chunk_id is not null")
    score = F.nanvl("combined_score", F.lit(None).cast("double"))
    return p.groupBy("chunk_id").agg(F.max(score).alias("score"), F.max("document").alias("document"), F.max("page").alias("page"), F.max("chunk").alias("chunk")).withColumn("page_no", T.page_number(F.col("page"))).drop("page")


def page_chunks_ranked(s, d):
    return pages.rank_page_chunks(_chunks(s, d).filter("page_no is not null"), KEYWORDS, 5).select("document", "page_no", "chunk_id", "adjusted", "rank")


def page_fallback(s, d):
    """Chunks of unknown page take the page of the best-scored chunk of the same file and heading."""
    p = _t(s, d, "pool_candidates").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("heading").alias("heading"))
    c = _chunks(s, d).join(p, "chunk_id").select("chunk_id", "document", "page_no", "score", T.squash(F.col("heading")).alias("h"))
    known = c.filter("page_no is not null and h <> ''").groupBy("document", "h").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), "chunk_id", "page_no")).alias("m"))
    return c.filter("page_no is null").join(known, ["document", "h"], "left").select("chunk_id", F.col("m.page_no").alias("page_no"))


def _used(s, d):
    return _t(s, d, "final_results").select("document", T.page_number(F.col("page")).alias("page_no"))


def remaining_pages(s, d):
    return pages.remaining(_chunks(s, d).select("document", "page_no"), _used(s, d))


def orchestrate_union(s, d):
    rest = _chunks(s, d).join(remaining_pages(s, d), ["document", "page_no"], "left_semi")
    gate = rest.filter(F.greatest(pages.keyword_hits(F.col("chunk"), F.array(*map(F.lit, KEYWORDS))), F.lit(0)) > 0)
    f = _t(s, d, "final_results").groupBy("result_id").agg(F.max_by(F.struct("document", "page", "rank"), "ingested_at").alias("r"))
    first = f.select("r.document", T.page_number(F.col("r.page")).alias("page_no"), F.col("result_id").cast("string").alias("chunk_id"), F.round(1.0 / (60 + F.col("r.rank")), 9).alias("score"))
    return pages.union_sources(("retrieval", first), ("pages", gate))


def _book(s, d):
    return files.keyword_book(_t(s, d, "keywords_excel")).select(T.squash(F.col("question")).alias("q"), F.explode(F.array_distinct(F.transform("keywords", lambda x: F.lower(x)))).alias("keyword")).distinct()


def _seen(s, d):
    """``(q, keyword)``: keywords that stand in the query or in the chunk or heading of a candidate pooled for it."""
    k = _book(s, d)
    c = _t(s, d, "pool_candidates").select(T.squash(F.col("query")).alias("q"), F.lower(F.concat_ws(" ", "chunk", "heading")).alias("x")).filter("q <> ''").distinct()
    return c.join(k, "q").filter(F.contains("x", "keyword") | F.contains("q", "keyword")).select("q", "keyword").distinct(), k, c


def agent_coverage(s, d):
    """Of each question's keywords, the part that the question or what is pooled for it holds."""
    hit, k, c = _seen(s, d)
    n = k.groupBy("q").agg(F.count("*").alias("n")).join(c.select("q").distinct(), "q", "left_semi")
    return n.join(hit.groupBy("q").agg(F.count("*").alias("hits")), "q", "left").select(F.md5("q").alias("question"), "n", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("coverage"))


def refined_queries(s, d):
    """Each question with bundles of the keywords that nothing pooled for it holds."""
    hit, k, c = _seen(s, d)
    missing = k.join(c.select("q").distinct(), "q", "left_semi").join(hit, ["q", "keyword"], "left_anti")
    return pages.missing_bundles(missing.select(F.col("q").alias("query"), "keyword"))


def agent_rounds(s, d):
    c = _t(s, d, "pool_candidates").filter("query is not null and chunk is not null").select(T.squash(F.col("query")).alias("query"), "chunk_id", F.coalesce(F.nanvl("combined_score", F.lit(None).cast("double")), F.lit(0.0)).alias("score"), "chunk")
    k = files.keyword_book(_t(s, d, "keywords_excel")).select(T.squash(F.col("question")).alias("query"), F.explode("keywords").alias("keyword")).distinct()
    return pages.rounds(c, k)


def page_chunks_local(s, d):
    """Of each page's chunks those that are like the keywords, at least the best."""
    return pages.local_scores(_chunks(s, d).filter("page_no is not null"), KEYWORDS).select("document", "page_no", "chunk_id", "local", "rank")


def stitched_pages(s, d):
    """Each document as the pages that the gate lets through, the first of each number, in order."""
    wanted = pages.gate(segment.split_pages(_t(s, d), keep_preamble=False), KEYWORDS).select("doc_id", "page_no").distinct()
    return segment.stitched(_t(s, d), wanted).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def keyword_book(s, d):
    return files.keyword_book(_t(s, d, "keywords_excel")).select("question", F.size("keywords").alias("n"), F.array_join("keywords", "; ").alias("keywords"))


def keyword_union(s, d):
    k = _t(s, d, "keywords_excel").filter("sheet is not null and keywords is not null").select(F.trim("sheet").alias("sheet"), F.explode(files.keyword_list(F.col("keywords"))).alias("k"))
    return k.groupBy("sheet").agg(F.count_distinct("k").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set("k")), ";")).alias("digest"))


def group_sentences(s, d):
    f = _t(s, d, "final_results").filter("trim(query) <> '' and trim(extracted_sentences) <> ''").groupBy("result_id").agg(F.max_by(F.struct(F.trim("query").alias("query"), F.trim("extracted_sentences").alias("x")), "ingested_at").alias("r")).select("result_id", "r.*")
    g = f.groupBy("query").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("result_id", "x"))).alias("p"))
    return g.select("query", "n", F.md5(F.array_join(F.transform("p", lambda z: z["x"]), "\n- ")).alias("digest"), F.when(F.col("n") >= 3, "Processed").otherwise("Unable to score").alias("status"))


def wide_to_long(s, d):
    w = _t(s, d, "store_files").groupBy("filename").agg(F.max("filepath").alias("filepath"), F.max("file_hash").alias("file_hash"), F.max("processing_timestamp").alias("stamp"))
    return files.wide_to_long(w, "field", "cell", "filename")


def melt_levels(s, d):
    w = _t(s, d, "benchmark").select(F.col("item_id").alias("Question"), F.lower("question").alias("Response1"), F.upper("question").alias("Response2"))
    return files.levels(w).select(F.col("Question").alias("item_id"), "level", "response")


def stage_dump(s, d):
    c = _chunks(s, d)
    return files.stage_dump(c, "document", "score", "chunk_id", "chunk", 50).select("document", "rank", "chunk_id", F.md5("preview").alias("digest"))


def grouped_txt(s, d):
    f = _t(s, d, "final_results").groupBy("result_id").agg(F.max_by(F.struct("document", "page", "extracted_sentences"), "ingested_at").alias("r"))
    x = f.select("result_id", "r.document", F.coalesce(T.page_number(F.col("r.page")), F.lit(-1)).alias("page_no"), "r.extracted_sentences")
    return files.grouped_text(x, ["document", "page_no"], ["result_id"], "extracted_sentences").select("document", "page_no", "result_id", "header")


def sheets(s, d):
    return files.sheet_names(_t(s, d, "final_results").select(F.trim("query").alias("query")), "query")


def scanned_files(s, d):
    return files.scanned(segment.split_pages(_t(s, d)))


def file_state(s, d):
    """Files of the store by their last processing."""
    x = _t(s, d, "store_files").groupBy("filename").agg(F.max("file_size_bytes").alias("bytes"), F.count_distinct("file_hash").alias("versions"), F.max("processing_timestamp").alias("last"))
    return x


def relational_extras(s, d):
    """Rollup over issuer and year with conditional counts."""
    x = _t(s, d).rollup("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("empty"), F.sum("n_chars").alias("chars"))
    return x


def ext_stream_windows(s, d):
    return E.run_now(s, E.windows(E.read_events(s, d)))


def ext_sliding(s, d):
    return E.run_now(s, E.windows(E.read_events(s, d), "1 hour", "30 minutes"))


def ext_sessions(s, d):
    return E.sessions(_t(s, d, "events"))


_PAGE = "try_cast(nullif(regexp_extract({0}, '(?i)^\\s*(?:(?:page|pp?|s)\\.?)?\\s*([0-9]{{1,9}})(?:\\.0*)?\\s*$', 1), '') AS INT)"
_CK = f"ck AS (SELECT chunk_id, max(CASE WHEN isnan(combined_score) THEN NULL ELSE combined_score END) AS score, max(document) AS document, {_PAGE.format('max(page)')} AS page_no, max(chunk) AS chunk, max(heading) AS heading FROM pool_candidates WHERE chunk_id IS NOT NULL GROUP BY 1)"
_REM = f"{_CK}, us AS (SELECT DISTINCT document, {_PAGE.format('page')} AS page_no FROM final_results), rem AS (SELECT DISTINCT document, page_no FROM ck WHERE page_no IS NOT NULL AND (document, page_no) NOT IN (SELECT (document, page_no) FROM us WHERE page_no IS NOT NULL AND document IS NOT NULL))"
_SQ = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_KL = "list_filter(list_transform(string_split(regexp_replace(trim({0}), '^\\[|\\]$', '', 'g'), ','), lambda x: regexp_replace(trim(x), '^[\"''\\s]+|[\"''\\s]+$', '', 'g')), lambda x: x <> '')"
_KB = f"kb AS (SELECT question, {_KL.format('cell')} AS keywords FROM (SELECT trim(question) AS question, arg_max(keywords, kw_id) AS cell FROM keywords_excel WHERE question IS NOT NULL AND keywords IS NOT NULL GROUP BY 1))"
_SEEN = f"{_KB}, k AS (SELECT DISTINCT {_SQ.format('question')} AS q, unnest(list_transform(keywords, lambda x: lower(x))) AS keyword FROM kb), c AS (SELECT DISTINCT {_SQ.format('query')} AS q, lower(concat_ws(' ', chunk, heading)) AS x FROM pool_candidates WHERE {_SQ.format('query')} <> ''), h AS (SELECT DISTINCT q, keyword FROM c JOIN k USING (q) WHERE contains(x, keyword) OR contains(q, keyword))"
_KTERMS = _TERMS.format(f"'{' '.join(KEYWORDS)}'")
SQL = {
    "page_gate": "WITH p AS (" + X.SPLIT_PAGES.replace("length(regexp_replace(t, '\\s+', '', 'g')) AS n", "t") + f"), m AS (SELECT doc_id, ord, page_no, list_filter({_KSQL}, lambda k: contains(lower(t), k)) AS m FROM p) SELECT doc_id, ord, page_no, 1.0::DOUBLE AS relevance, array_to_string(m, ',') AS matched, (5 - len(m))::INT AS n_missing FROM m WHERE len(m) > 0",
    "page_chunks_ranked": f"WITH {_CK}, x AS (SELECT document, page_no, chunk_id, round(coalesce(score, 0) + 0.05::DOUBLE * coalesce(len(list_filter({_KSQL}, lambda k: contains(lower(chunk), k))), 0), 6) AS adjusted FROM ck WHERE page_no IS NOT NULL) " + R._top("document, page_no, chunk_id, adjusted", "x", "document, page_no", "adjusted", "chunk_id", 5),
    "page_fallback": f"WITH {_CK}, h AS (SELECT *, {_SQ.format('heading')} AS h FROM ck), k AS (SELECT document, h, arg_max(page_no, {{'s': coalesce(score, 0), 'c': chunk_id}}) AS page_no FROM h WHERE page_no IS NOT NULL AND h <> '' GROUP BY 1, 2) SELECT chunk_id, k.page_no FROM h LEFT JOIN k USING (document, h) WHERE h.page_no IS NULL",
    "remaining_pages": f"WITH {_REM} SELECT * FROM rem",
    "orchestrate_union": f"WITH {_REM} SELECT 'pages' AS source, document, page_no, chunk_id, score FROM ck JOIN rem USING (document, page_no) WHERE len(list_filter({_KSQL}, lambda k: contains(lower(chunk), k))) > 0 UNION ALL SELECT 'retrieval', r.document, {_PAGE.format('r.page')}, result_id::VARCHAR, round(1.0 / (60 + r.rank), 9) FROM (SELECT result_id, arg_max({{'document': document, 'page': page, 'rank': rank}}, ingested_at) AS r FROM final_results GROUP BY 1)",
    "agent_coverage": f"WITH {_SEEN} SELECT md5(q) AS question, n, round(coalesce(hits, 0) / n, 6) AS coverage FROM (SELECT q, count(*) AS n FROM k WHERE q IN (SELECT q FROM c) GROUP BY 1) LEFT JOIN (SELECT q, count(*) AS hits FROM h GROUP BY 1) USING (q)",
    "refined_queries": f"WITH {_SEEN}, m AS (SELECT q AS query, keyword, row_number() OVER (PARTITION BY q ORDER BY keyword) - 1 AS r FROM k WHERE q IN (SELECT q FROM c) AND (q, keyword) NOT IN (SELECT (q, keyword) FROM h)) SELECT query, (r // 3)::INT AS n, query || ' ' || string_agg(keyword, ' ' ORDER BY keyword) AS rewrite FROM m WHERE r < 12 GROUP BY 1, 2",
    "page_chunks_local": f"WITH {_CK}, x AS (SELECT document, page_no, chunk_id, round({_cos(_KTERMS, _TERMS.format("coalesce(chunk, '')"))}, 6) AS local FROM ck WHERE page_no IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY document, page_no ORDER BY local DESC, chunk_id)::INT AS rank FROM x) SELECT * FROM y WHERE local >= 0.6 OR rank = 1",
    "stitched_pages": "WITH p AS (" + X.SPLIT_D02.replace("length(regexp_replace(t, '\\s+', '', 'g')) AS n", "t") + f"), g AS (SELECT DISTINCT doc_id, page_no FROM p WHERE len(list_filter({_KSQL}, lambda k: contains(lower(t), k))) > 0), f AS (SELECT doc_id, ord, regexp_replace(t, '^\\s+|\\s+$', '', 'g') || chr(10) AS t FROM p JOIN g USING (doc_id, page_no) QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ord) = 1) SELECT doc_id, md5(string_agg(t, '' ORDER BY ord)) AS digest, length(string_agg(t, '' ORDER BY ord))::INT AS n_chars FROM f GROUP BY 1",
    "keyword_book": f"WITH {_KB} SELECT question, len(keywords)::INT AS n, array_to_string(keywords, '; ') AS keywords FROM kb",
    "keyword_union": f"SELECT sheet, count(DISTINCT k) AS n, md5(string_agg(DISTINCT k, ';' ORDER BY k)) AS digest FROM (SELECT trim(sheet) AS sheet, unnest({_KL.format('keywords')}) AS k FROM keywords_excel WHERE sheet IS NOT NULL AND keywords IS NOT NULL) GROUP BY 1",
    "group_sentences": "WITH f AS (SELECT result_id, r.* FROM (SELECT result_id, arg_max({'query': trim(query), 'x': trim(extracted_sentences)}, ingested_at) AS r FROM final_results WHERE trim(query) <> '' AND trim(extracted_sentences) <> '' GROUP BY 1)) SELECT query, count(*) AS n, md5(string_agg(x, chr(10) || '- ' ORDER BY result_id)) AS digest, CASE WHEN count(*) >= 3 THEN 'Processed' ELSE 'Unable to score' END AS status FROM f GROUP BY 1",
    "wide_to_long": "WITH w AS (SELECT filename, max(filepath) AS filepath, max(file_hash) AS file_hash, max(processing_timestamp) AS stamp FROM store_files GROUP BY 1), l AS (SELECT filename, 'filepath' AS field, trim(filepath) AS cell FROM w UNION ALL SELECT filename, 'file_hash', trim(file_hash) FROM w UNION ALL SELECT filename, 'stamp', trim(stamp) FROM w) SELECT field, row_number() OVER (PARTITION BY field ORDER BY filename)::INT AS pos, cell FROM l WHERE cell <> ''",
    "melt_levels": "SELECT item_id, 1 AS level, lower(question) AS response FROM benchmark WHERE question IS NOT NULL UNION ALL SELECT item_id, 2, upper(question) FROM benchmark WHERE question IS NOT NULL",
    "stage_dump": f"WITH {_CK} SELECT document, rank, chunk_id, md5(substring({_SQ.format('chunk')}, 1, 200)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC NULLS LAST, chunk_id)::INT AS rank FROM ck) WHERE rank <= 50",
    "grouped_txt": f"WITH x AS (SELECT result_id, r.document AS document, coalesce({_PAGE.format('r.page')}, -1) AS page_no FROM (SELECT result_id, arg_max({{'document': document, 'page': page}}, ingested_at) AS r FROM final_results GROUP BY 1)), k AS (SELECT *, concat_ws(' | ', coalesce(document, '?'), page_no::VARCHAR) AS key FROM x) SELECT document, page_no, result_id, CASE WHEN coalesce(lag(key) OVER (PARTITION BY document ORDER BY page_no, result_id) <> key, true) THEN '== ' || key || ' ==' || chr(10) ELSE '' END AS header FROM k",
    "sheets": "WITH x AS (SELECT DISTINCT trim(query) AS name FROM final_results WHERE query IS NOT NULL), y AS (SELECT name, substring(regexp_replace(name, '[\\[\\]:*?/\\\\]', '_', 'g'), 1, 27) AS s FROM x), z AS (SELECT name, s, row_number() OVER (PARTITION BY lower(s) ORDER BY name) AS n FROM y) SELECT name, CASE WHEN n = 1 THEN s ELSE s || '_' || n END AS sheet FROM z",
    "scanned_files": "WITH p AS (" + X.SPLIT_PAGES.replace("length(regexp_replace(t, '\\s+', '', 'g')) AS n", "t") + "), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM p) SELECT doc_id, sum(length(trim(t))) <= 100 * count(*) AS scanned FROM q WHERE n <= 5 GROUP BY 1",
    "file_state": "SELECT filename, max(file_size_bytes) AS bytes, count(DISTINCT file_hash) AS versions, max(processing_timestamp) AS last FROM store_files GROUP BY 1",
    "relational_extras": "SELECT source, lang, count(*) AS n, count(*) FILTER (text IS NULL) AS empty, sum(n_chars) AS chars FROM documents GROUP BY ROLLUP (source, lang)",
    "ext_stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ext_sliding": "SELECT b AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY 1, 2",
    "ext_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM y GROUP BY user_id, g",
}
SQL["relational_extras"] = typed(SQL["relational_extras"], chars="BIGINT")
QUERIES = {f.__name__: f for f in (page_gate, page_chunks_ranked, page_fallback, remaining_pages, orchestrate_union, agent_coverage, agent_rounds, refined_queries, page_chunks_local, stitched_pages, keyword_book, keyword_union, group_sentences, wide_to_long, melt_levels, stage_dump, grouped_txt, sheets, scanned_files, file_state, relational_extras, ext_stream_windows, ext_sliding, ext_sessions)}
