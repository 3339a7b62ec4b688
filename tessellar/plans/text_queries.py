"""Queries over text functions and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.functions import vectors as V
from tessellar.operators import segment as G

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
#: DuckDB's text of the shared definitions
WORDS = "coalesce(regexp_extract_all(lower({0}), '[a-z0-9]+'), [])"
SENTS = "list_filter(list_transform(coalesce(regexp_extract_all(regexp_replace({0}, '\\s+', ' ', 'g'), '[^.!?]+[.!?]*'), []), lambda x: trim(x)), lambda x: x <> '')"
PUNCT = "regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g')"
BARE = "trim(regexp_replace(" + PUNCT + ", '\\s+', ' ', 'g'))"
KEYWORDS = ("climate risk", "dividend", "working capital", "audit", "supply chain", "cyber resilience", "co2")


def _t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def tokens_per_doc(s, d):
    w = T.words(F.col("text"))
    return _t(s, d).select("doc_id", F.size(w).alias("n_words"), F.size(T.terms(F.col("text"))).alias("n_terms"), F.size(F.array_distinct(w)).alias("n_distinct"), F.md5(F.array_join(w, " ")).alias("digest"))


def preprocess_text(s, d):
    t = F.col("text")
    return _t(s, d).select("doc_id", F.md5(T.bare(t)).alias("bare"), F.md5(T.squash(t)).alias("squashed"))


def fragments(s, d):
    return _t(s, d, "benchmark").select("item_id", F.posexplode(T.fragments(F.col("text"))).alias("pos", "fragment"))


def keyword_presence(s, d):
    k = F.explode(F.array(*map(F.lit, KEYWORDS))).alias("keyword")
    return _t(s, d).select("text", k).groupBy("keyword").agg(F.count_if(T.has_keyword(F.col("text"), F.col("keyword"))).alias("documents"))


def keyword_hits(s, d):
    hits = F.size(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.lower("text"), k)))
    return _t(s, d).select("doc_id", F.coalesce(F.greatest(hits, F.lit(0)), F.lit(0)).alias("hits"))


def smart_truncate(s, d):
    return _t(s, d).filter("text is not null").select("doc_id", F.md5(T.smart_cut(F.col("text"), 300)).alias("digest"))


def names(s, d):
    return _t(s, d, "store_files").select(T.base_name(F.col("filepath")).alias("name"), F.replace(F.lower("filename"), F.lit("_"), F.lit(" ")).alias("phrase"), T.unsentinel(F.col("file_hash")).alias("hash")).distinct()


def page_spellings(s, d):
    return _t(s, d, "pool_candidates").groupBy(T.page_number(F.col("page")).alias("page_no")).agg(F.count("*").alias("n"))


def answers(s, d):
    a = F.concat(F.lit("<think>no\nyes</think> score "), F.col("combined_score").cast("decimal(18,3)").cast("string"), F.lit(" of 1"))
    x = _t(s, d, "pool_candidates").filter("combined_score is not null and not isnan(combined_score)").withColumn("answer", T.no_thinking(a))
    x = x.withColumn("score", T.first_number(F.col("answer")))
    return x.groupBy(T.band(F.col("score") * 100).alias("band")).agg(F.count("*").alias("n"))


def sentence_context_window(s, d):
    x = G.sentence_context(_t(s, d), 1)
    return x.select("doc_id", "pos", F.md5("context").alias("digest"))


def split_pages_d01(s, d):
    return G.split_pages(_t(s, d)).select("doc_id", "ord", "page_no", F.length(F.regexp_replace("page_text", r"\s+", "")).alias("n"))


def split_pages_d02(s, d):
    return G.split_pages(_t(s, d), keep_preamble=False).select("doc_id", "ord", "page_no", F.length(F.regexp_replace("page_text", r"\s+", "")).alias("n"))


def line_page_map(s, d):
    return G.line_map(_t(s, d)).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.sum(F.col("heading").cast("int")).alias("headings"))


def sections(s, d):
    return G.sections(_t(s, d)).select("doc_id", "section", "heading", "page_no", "n_lines", F.md5("section_text").alias("digest"))


def heading_context_asof(s, d):
    return G.heading_levels(_t(s, d)).select("doc_id", "line_no", "start", "level", "title", "parent")


def tables_extract(s, d):
    return G.tables(_t(s, d)).select("doc_id", "n_tables", "n_rows", F.md5("rest").alias("digest"))


def word_windows(s, d):
    return G.word_windows(_t(s, d), 125).select("doc_id", "pos", F.md5("window").alias("digest"))


def chunks_and_tables(s, d):
    return G.chunks_and_tables(_t(s, d), 200).select("doc_id", "chunk_no", "kind", "n_words", F.md5("chunk").alias("digest"))


def pack_sentences(s, d):
    return G.pack_sentences(_t(s, d), 200, ["doc_id"], "text").select("doc_id", "chunk_no", "n_words", F.md5("chunk").alias("digest"))


def pack_by_heading(s, d):
    x = G.pack_sentences(G.sections(_t(s, d)), 120, ["doc_id", "section"], "section_text")
    return x.select("doc_id", "section", "chunk_no", "n_words", F.md5("chunk").alias("digest"))


def chunk_overlap(s, d):
    x = G.with_overlap(G.pack_sentences(_t(s, d), 200, ["doc_id"], "text"), ["doc_id"], 2)
    return x.select("doc_id", "chunk_no", "has_overlap", F.md5("chunk").alias("digest"))


def page_chunker_semantic(s, d):
    return G.semantic_pages(_t(s, d), "doc_id", "text")


def breakpoint_chunker(s, d):
    return G.breakpoints(_t(s, d, "embeddings"), "label", "vec_id", "embedding", 0.35)


def ingest_stats(s, d):
    c = G.pack_sentences(_t(s, d), 200, ["doc_id"], "text").join(_t(s, d).select("doc_id", "source"), "doc_id")
    return c.groupBy("source").agg(F.count("*").alias("chunks"), F.min("n_words").alias("least"), F.max("n_words").alias("most"), F.round(F.avg("n_words"), 6).alias("mean"))


def hype_weighted_embedding(s, d):
    """The weighted mean vector of each label: the first vector counts 7, the others share the rest."""
    e = _t(s, d, "embeddings")
    x = e.join(e.groupBy("label").agg(F.min("vec_id").alias("first")), "label")
    x = x.withColumn("w", F.when(F.col("vec_id") == F.col("first"), F.lit(7.0)).otherwise(0.2))
    m = V.mean_vector(x, ["label"], "embedding", F.col("w"))
    return m.select("label", F.posexplode("embedding").alias("i", "v")).select("label", "i", F.round("v", 5).alias("v"))


def incremental_antijoin(s, d):
    """Files to ingest: those whose latest content hash the store doesn't hold for them."""
    x = _t(s, d, "pool_candidates").filter("chunk_id is not null").groupBy("chunk_id").agg(F.md5(F.max("chunk")).alias("hash"))
    old = _t(s, d, "pool_candidates").filter("ingested_at < timestamp '2024-06-01'").groupBy("chunk_id").agg(F.md5(F.max("chunk")).alias("hash"))
    return x.join(old, ["chunk_id", "hash"], "left_anti").select("chunk_id", "hash")


_LINES = """l AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""
_IS_PAGE = "regexp_matches(trim(line, ' '), '(?i)^(#*\\s*)?(Page|p\\.)?\\s*\\d+\\s*(#*\\s*)?$')"
_H = "regexp_replace(trim(line, ' '), '^#+\\s*', '')"
_TITLE = f"({_H} = upper({_H}) OR length(regexp_replace({_H}, '[^\\p{{Lu}}]', '', 'g')) > 0.7 * length(regexp_replace({_H}, '[^\\p{{L}}]', '', 'g')) OR regexp_matches({_H}, '^\\p{{Lu}}'))"
_HEADING = f"(starts_with(trim(line, ' '), '#') AND {_H} <> '' AND len(regexp_split_to_array({_H}, '\\s+')) < 10 AND NOT regexp_matches({_H}, '[.:?;!]$') AND {_TITLE} AND NOT {_IS_PAGE} AND NOT coalesce(starts_with(trim(lead(line) OVER w, ' '), '#'), false))"
_MAP = f"""WITH {_LINES}, m AS (SELECT doc_id, line_no, line, coalesce(last_value(CASE WHEN {_IS_PAGE} THEN regexp_extract(line, '(\\d{{1,9}})', 1)::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS page_no, {_HEADING} AS heading FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
_SECTIONS = f"""{_MAP}, q AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM m),
 t AS (SELECT doc_id, section, max(CASE WHEN heading THEN {_H} END) AS title FROM q GROUP BY 1, 2),
 sec AS (SELECT q.doc_id, q.section, coalesce(any_value(title), 'No Heading') AS heading, arg_min(page_no, line_no) AS page_no, count(*)::INT AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS section_text FROM q JOIN t USING (doc_id, section) WHERE NOT heading AND trim(line, ' ') <> '' AND NOT {_IS_PAGE} GROUP BY 1, 2)"""


def _packed(source: str, keys: str, most: int) -> str:
    return f"""sx AS (SELECT {keys}, {SENTS.format("txt")} AS s FROM {source}),
 sn AS (SELECT {keys}, unnest(range(len(s))) AS i, unnest(s) AS s FROM sx), sw AS (SELECT *, len(string_split(s, ' ')) AS n FROM sn),
 r AS (SELECT {keys}, i, s, n, n AS acc, 0 AS c FROM sw WHERE i = 0 UNION ALL
  SELECT {", ".join("b." + k.strip() for k in keys.split(","))}, b.i, b.s, b.n, CASE WHEN r.acc + b.n > {most} THEN b.n ELSE r.acc + b.n END, r.c + (r.acc + b.n > {most})::INT FROM r JOIN sw b ON {" AND ".join(f"r.{k.strip()} = b.{k.strip()}" for k in keys.split(","))} AND b.i = r.i + 1),
 ch AS (SELECT {keys}, c AS chunk_no, sum(n)::INT AS n_words, string_agg(s, ' ' ORDER BY i) AS chunk FROM r GROUP BY ALL)"""


_DOCS = "dx AS (SELECT doc_id, text AS txt, source FROM documents)"
_CHUNKS = f"WITH RECURSIVE {_DOCS}, {_packed('dx', 'doc_id', 200)}"

SQL = {
    "tokens_per_doc": f"SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL}))) AS n_terms, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)",
    "preprocess_text": f"SELECT doc_id, md5({BARE.format('text')}) AS bare, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS squashed FROM documents",
    "fragments": f"SELECT item_id, unnest(range(len(f)))::INT AS pos, unnest(f) AS fragment FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[,;]|\\s(?:and|but|or|although|though)\\s'), lambda x: {BARE.format('x')}), lambda x: x <> '') AS f FROM benchmark)",
    "keyword_presence": "SELECT keyword, count(*) FILTER (CASE WHEN contains(keyword, ' ') THEN contains(t, keyword) ELSE regexp_matches(t, '\\b' || keyword || '\\b') END) AS documents FROM (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), (SELECT unnest([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]) AS keyword) GROUP BY 1",
    "keyword_hits": "SELECT doc_id, coalesce(len(list_filter([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "], lambda k: contains(lower(text), k))), 0)::INT AS hits FROM documents",
    "smart_truncate": "SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN length(regexp_extract(h, '(?s)^(.*[.!?…])', 1)) >= 210 THEN regexp_extract(h, '(?s)^(.*[.!?…])', 1) WHEN length(regexp_extract(h, '(?s)^(.*) ', 1)) >= 150 THEN regexp_extract(h, '(?s)^(.*) ', 1) ELSE h END) AS digest FROM (SELECT doc_id, text, substring(text, 1, 300) AS h FROM documents WHERE text IS NOT NULL)",
    "names": "SELECT DISTINCT lower(trim(regexp_extract(filepath, '([^/\\\\]*)$', 1))) AS name, replace(lower(filename), '_', ' ') AS phrase, CASE WHEN lower(trim(file_hash)) NOT IN ('', 'nan', 'null', 'none', 'unknown', 'no heading') THEN trim(file_hash) END AS hash FROM store_files",
    "page_spellings": "SELECT try_cast(nullif(regexp_extract(page, '(?i)^\\s*(?:(?:page|pp?|s)\\.?)?\\s*([0-9]{1,9})(?:\\.0*)?\\s*$', 1), '') AS INT) AS page_no, count(*) AS n FROM pool_candidates GROUP BY 1",
    "answers": "SELECT CASE WHEN s >= 85 THEN 'Excellent' WHEN s >= 70 THEN 'Very Good' WHEN s >= 50 THEN 'Good' WHEN s >= 30 THEN 'Fair' ELSE 'Poor' END AS band, count(*) AS n FROM (SELECT least(1, greatest(0, abs(combined_score::DECIMAL(18,3)::DOUBLE))) * 100 AS s FROM pool_candidates WHERE combined_score IS NOT NULL AND NOT isnan(combined_score)) GROUP BY 1",
    "sentence_context_window": f"SELECT doc_id, pos::INT AS pos, md5(array_to_string(s[greatest(pos, 1):pos + 2], ' ')) AS digest FROM (SELECT doc_id, s, unnest(range(len(s))) AS pos FROM (SELECT doc_id, {SENTS.format('text')} AS s FROM documents))",
    "split_pages_d01": "SELECT doc_id, ord::INT AS ord, page_no::INT AS page_no, length(regexp_replace(t, '\\s+', '', 'g')) AS n FROM (SELECT doc_id, unnest(range(len(p))) AS ord, unnest(p) AS t, unnest(list_concat([0], m)) AS page_no FROM (SELECT doc_id, regexp_split_to_array(text, '(?i)###\\s*Page\\s+\\d+\\s*###') AS p, list_transform(regexp_extract_all(text, '(?i)###\\s*Page\\s+(\\d+)\\s*###', 1), lambda x: x::INT) AS m FROM documents WHERE text IS NOT NULL)) WHERE ord > 0 OR trim(t) <> ''",
    "split_pages_d02": "SELECT doc_id, ord::INT AS ord, page_no::INT AS page_no, length(regexp_replace(t, '\\s+', '', 'g')) AS n FROM (SELECT doc_id, CASE WHEN len(m) = 0 THEN 0 ELSE unnest(range(len(p) - 1)) END AS ord, unnest(list_transform(range(1, len(p)), lambda i: k[i] || p[i + 1])) AS t, unnest(m) AS page_no FROM (SELECT doc_id, regexp_split_to_array(text, '(?i)###\\s*Page\\s+\\d+\\s*###') AS p, regexp_extract_all(text, '(?i)###\\s*Page\\s+\\d+\\s*###') AS k, list_transform(regexp_extract_all(text, '(?i)###\\s*Page\\s+(\\d+)\\s*###', 1), lambda x: x::INT) AS m FROM documents WHERE text IS NOT NULL) WHERE len(m) > 0 UNION ALL SELECT doc_id, 0, text, 1 FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)###\\s*Page\\s+\\d+\\s*###'))",
    "line_page_map": f"{_MAP} SELECT doc_id, page_no, count(*) AS n_lines, sum(heading::INT) AS headings FROM m GROUP BY 1, 2",
    "sections": f"{_SECTIONS} SELECT doc_id, section, heading, page_no, n_lines, md5(section_text) AS digest FROM sec",
    "tables_extract": "SELECT doc_id, len(t) AS n_tables, list_sum(list_transform(list_concat(t, ['']), lambda x: len(string_split(x, chr(10))) - 1)) AS n_rows, md5(regexp_replace(text, '(?:\\|[^\\n]*\\|\\n)+', '', 'g')) AS digest FROM (SELECT doc_id, text, regexp_extract_all(text, '(?:\\|[^\\n]*\\|\\n)+') AS t FROM documents WHERE text IS NOT NULL)",
    "word_windows": "SELECT doc_id, (a / 125)::INT AS pos, md5(array_to_string(w[a + 1:a + 125], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, len(w), 125)) AS a FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))",
    "pack_sentences": f"{_CHUNKS} SELECT doc_id, chunk_no, n_words, md5(chunk) AS digest FROM ch",
    "pack_by_heading": f"{_SECTIONS.replace('WITH ', 'WITH RECURSIVE ', 1)}, dx AS (SELECT doc_id, section, section_text AS txt FROM sec), {_packed('dx', 'doc_id, section', 120)} SELECT doc_id, section, chunk_no, n_words, md5(chunk) AS digest FROM ch",
    "chunk_overlap": f"{_CHUNKS}, cs AS (SELECT *, {SENTS.format('chunk')} AS s FROM ch) SELECT doc_id, chunk_no, lag(chunk) OVER w IS NOT NULL AS has_overlap, md5(concat_ws(' ', lag(array_to_string(s[-2:], ' ')) OVER w, chunk)) AS digest FROM cs WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)",
    "ingest_stats": f"{_CHUNKS} SELECT source, count(*) AS chunks, min(n_words) AS least, max(n_words) AS most, round(avg(n_words), 6) AS mean FROM ch JOIN documents USING (doc_id) GROUP BY 1",
    "breakpoint_chunker": "WITH s AS (SELECT label, vec_id, round(list_dot_product(lag(embedding::DOUBLE[]) OVER w, embedding::DOUBLE[]), 5) AS sim FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)), c AS (SELECT label, quantile_cont(sim, 0.35) AS cut FROM s GROUP BY 1) SELECT label, vec_id, sim, sum(CASE WHEN sim < cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS segment FROM s JOIN c USING (label)",
    "hype_weighted_embedding": "SELECT label, i, round(sum(w * v) / sum(w), 5) AS v FROM (SELECT label, w, unnest(range(64))::INT AS i, unnest(embedding::DOUBLE[]) AS v FROM (SELECT label, embedding, CASE WHEN vec_id = min(vec_id) OVER (PARTITION BY label) THEN 7.0 ELSE 0.2 END::DOUBLE AS w FROM embeddings)) GROUP BY 1, 2",
    "incremental_antijoin": "WITH x AS (SELECT chunk_id, md5(max(chunk)) AS hash FROM pool_candidates WHERE chunk_id IS NOT NULL GROUP BY 1), o AS (SELECT chunk_id, md5(max(chunk)) AS hash FROM pool_candidates WHERE ingested_at < TIMESTAMP '2024-06-01' GROUP BY 1) SELECT chunk_id, hash FROM x ANTI JOIN o USING (chunk_id, hash)",
}
SPLIT_PAGES = SQL["split_pages_d01"]
SPLIT_D02 = SQL["split_pages_d02"]
SQL["heading_context_asof"] = f"""WITH {_LINES}, a AS (SELECT doc_id, line_no, trim(line, ' ') AS s, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start FROM l),
 v AS (SELECT *, CASE WHEN s = upper(s) AND regexp_matches(s, '\\p{{Lu}}') AND length(s) > 3 AND NOT starts_with(s, '|') THEN 1
  WHEN regexp_matches(s, '^\\*\\*.+\\*\\*$') OR regexp_matches(s, '^#\\s+\\S') OR regexp_matches(s, '^[0-9]+\\.\\s+[A-Z]') OR regexp_matches(s, '^[A-Z][a-z]+:$') THEN 2
  WHEN regexp_matches(s, '^[0-9]+\\.[0-9]+\\s+[A-Z]') OR regexp_matches(s, '^[a-z]\\)\\s+[A-Z]') THEN 3 END AS level FROM a),
 h AS (SELECT * FROM v WHERE level IS NOT NULL),
 b AS (SELECT *, max(line_no) FILTER (level = 1) OVER w AS a1, max(line_no) FILTER (level = 2) OVER w AS a2, last_value(CASE WHEN level = 1 THEN s END IGNORE NULLS) OVER w AS l1, last_value(CASE WHEN level = 2 THEN s END IGNORE NULLS) OVER w AS l2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT doc_id, line_no::INT AS line_no, start::BIGINT AS start, level, s AS title, CASE WHEN level = 3 AND a2 > coalesce(a1, -1) THEN l2 WHEN level > 1 THEN l1 END AS parent FROM b"""


def typed(sql: str, **kinds: str) -> str:
    """SQL whose columns have the widths that Spark's have."""
    return f"SELECT * REPLACE ({', '.join(f'{c}::{k} AS {c}' for c, k in kinds.items())}) FROM ({sql})"


for _name, _kinds in {
    "tokens_per_doc": {"n_words": "INT", "n_terms": "INT", "n_distinct": "INT"},
    "split_pages_d01": {"n": "INT"},
    "split_pages_d02": {"n": "INT"},
    "line_page_map": {"headings": "BIGINT"},
    "sections": {"section": "BIGINT"},
    "tables_extract": {"n_tables": "INT", "n_rows": "INT"},
    "pack_by_heading": {"section": "BIGINT"},
    "breakpoint_chunker": {"segment": "BIGINT"},
}.items():
    SQL[_name] = typed(SQL[_name], **_kinds)
QUERIES = {f.__name__: f for f in (tokens_per_doc, preprocess_text, fragments, keyword_presence, keyword_hits, smart_truncate, names, page_spellings, answers, sentence_context_window, split_pages_d01, split_pages_d02, line_page_map, sections, heading_context_asof, tables_extract, word_windows, chunks_and_tables, pack_sentences, pack_by_heading, chunk_overlap, page_chunker_semantic, breakpoint_chunker, ingest_stats, hype_weighted_embedding, incremental_antijoin)}
