"""SQL that must give the same rows as the core queries."""

from __future__ import annotations

from tessera.operators.lexical import STOP, TOKEN

_TOKEN = TOKEN.replace("'", "''")
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_TOK = f"regexp_extract_all(lower(%s), '{_TOKEN}')"
_TERMS = f"""q AS (SELECT query_id, query, list_filter({_TOK % "query"}, lambda x: length(x) > 1) AS long FROM queries),
 terms AS (SELECT query_id, CASE WHEN len(list_filter(long, lambda x: NOT list_contains({_STOPS}, x))) > 0 THEN list_filter(long, lambda x: NOT list_contains({_STOPS}, x)) ELSE long END AS t FROM q)"""
_HITS = """h AS (SELECT DISTINCT * FROM hits),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM h)"""
_RERANK = _HITS + """,
 short AS (SELECT *, round(1 / (1 + exp(-rerank_logit / 4.0)), 6) AS confidence FROM ranked WHERE rank <= 50),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY confidence DESC NULLS LAST, rank) AS final_rank FROM short),
 fin AS (SELECT * FROM ordered WHERE final_rank <= 8)"""
_QRELS = """j AS (SELECT query_id, doc_id, grade, judged_by FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id
  ORDER BY (judged_by = 'human') DESC NULLS LAST, judged_at DESC NULLS LAST, grade DESC, judged_by) AS r FROM qrels) WHERE r = 1)"""
_RUNS = _HITS + """,
 latest AS (SELECT search_id FROM (SELECT search_id, row_number() OVER (PARTITION BY config_name, query_id ORDER BY searched_at DESC, search_id DESC) AS r
  FROM (SELECT DISTINCT config_name, query_id, search_id, searched_at FROM h)) WHERE r = 1),
 firsts AS (SELECT config_name, query_id, doc_id, min(rank) AS first FROM ranked JOIN latest USING (search_id) GROUP BY ALL),
 runs AS (SELECT config_name, query_id, doc_id, row_number() OVER (PARTITION BY config_name, query_id ORDER BY first) AS rank FROM firsts)"""
_METRICS = _RUNS + ", " + _QRELS + """,
 own AS (SELECT config_name, query_id, count(*) FILTER (grade > 0 AND rank <= 100) AS found, min(rank) FILTER (grade > 0 AND rank <= 10) AS first,
  sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM runs LEFT JOIN j USING (query_id, doc_id) GROUP BY ALL),
 placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM j WHERE grade > 0),
 ideal AS (SELECT query_id, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(p + 1)) FILTER (p <= 10) AS idcg FROM placed GROUP BY ALL),
 m AS (SELECT config_name, query_id, CASE WHEN relevant IS NOT NULL THEN round(found / relevant, 6) END AS recall,
  CASE WHEN relevant IS NOT NULL THEN round(coalesce(1 / first, 0), 6) END AS mrr, CASE WHEN relevant IS NOT NULL THEN round(coalesce(dcg, 0) / idcg, 6) END AS ndcg
  FROM own LEFT JOIN ideal USING (query_id))"""
_FEATURES = _RERANK + """,
 f AS (SELECT s.search_id, coalesce(x.n, 0) AS n, x.top, x.s[len(x.s) // 2 + 1] AS median, x.docs FROM (SELECT DISTINCT search_id FROM hits) s LEFT JOIN
  (SELECT search_id, count(*) AS n, max(confidence) FILTER (final_rank = 1) AS top, list_sort(list(coalesce(confidence, 0)) FILTER (final_rank <= 5)) AS s,
   count(DISTINCT doc_id) FILTER (final_rank <= 5) AS docs FROM fin GROUP BY search_id) x USING (search_id))"""


def _gate(tau: str, on: str) -> str:
    return f"""CASE WHEN n = 0 THEN 'no_results' WHEN top IS NULL THEN 'no_confidence_signal' WHEN top < {tau} THEN 'low_confidence'
  WHEN {on} AND n >= 4 AND top < {tau} + 0.15 AND top - median < 0.05 AND docs >= 3 THEN 'ambiguous' ELSE '' END"""


def _gated(tau: str, on: str) -> str:
    return f"""WITH {_FEATURES}, g AS (SELECT *, {_gate(tau, on)} AS reason FROM f)
 SELECT search_id, coalesce(top, 0) AS top, reason IN ('no_results', 'low_confidence', 'ambiguous') AS abstain, reason, coalesce(top < {tau} + 0.15, false) AS needs_review FROM g"""


def _bootstrap(values: str, extra: str = "") -> str:
    """values: a relation v (by, item, v) without nulls. 1,000 iterations, places drawn by md5."""
    return f"""{values},
 n AS (SELECT config_name, count(*) AS n, avg(v) AS m FROM v GROUP BY ALL),
 placed_v AS (SELECT config_name, v, row_number() OVER (PARTITION BY config_name ORDER BY query_id) - 1 AS place FROM v),
 draws AS (SELECT config_name, n, i, unnest(range(n)) AS d FROM (SELECT config_name, n, unnest(range(1000)) AS i FROM n WHERE n > 1)),
 means AS (SELECT config_name, i, round(avg(v), 9) AS mean FROM (SELECT config_name, i, ('0x' || substr(md5('20240901:' || i || ':' || d), 1, 15))::BIGINT % n AS place FROM draws) JOIN placed_v USING (config_name, place) GROUP BY ALL),
 s AS (SELECT config_name, list_sort(list(mean)) AS s, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) AS p FROM means GROUP BY ALL),
 b AS (SELECT config_name, round(m, 6) AS mean, round(coalesce(s[26], m), 6) AS lo, round(coalesce(s[976], m), 6) AS hi, round(p, 6) AS p_better FROM n LEFT JOIN s USING (config_name))
 SELECT *{extra} FROM b"""


#: Fewer than two pairs have no interval.
_PAIRED = f"""v AS (SELECT a.config_name, query_id, a.ndcg - b.ndcg AS v FROM m a JOIN m b USING (query_id) WHERE a.config_name <> 'bm25' AND b.config_name = 'bm25' AND a.ndcg - b.ndcg IS NOT NULL),
 pb AS (WITH {_bootstrap("z AS (SELECT 1)")}) SELECT config_name, {", ".join(f"CASE WHEN p_better IS NULL THEN 'nan'::DOUBLE ELSE {c} END AS {c}" for c in ("mean", "lo", "hi", "p_better"))},
 p_better IS NOT NULL AND (lo > 0 OR hi < 0) AS significant FROM pb"""


def _dense(queries: str, items: str, item: str, k: int = 10) -> str:
    return f"""(SELECT * FROM (SELECT query_id, {item}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item}) AS rank FROM
 (SELECT q.id AS query_id, x.id AS {item}, round(list_cosine_similarity(q.v, x.v), 6) AS score FROM {queries} q, {items} x)) WHERE rank <= {k})"""


_EMB = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_RRF = """SELECT search_id, chunk_id, score, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT search_id, chunk_id, round(sum(part), 9) AS score FROM
 (SELECT DISTINCT search_id, chunk_id, {w} / (60 + lexical_rank) AS part, 1 AS l FROM hits WHERE lexical_rank IS NOT NULL UNION ALL SELECT DISTINCT search_id, chunk_id, 1.0 / (60 + dense_rank), 2 FROM hits WHERE dense_rank IS NOT NULL) GROUP BY ALL)"""
_HYD = _RERANK + """,
 c AS (SELECT DISTINCT chunk_id, char_start, char_end, text FROM chunks),
 hyd AS (SELECT fin.search_id, fin.query_id, fin.final_rank AS rank, fin.chunk_id, fin.doc_id, c.char_start, c.text, d.heading, d.citation FROM fin JOIN c USING (chunk_id) JOIN documents d ON d.doc_id = fin.doc_id)"""
_FOLD = r"""trim(lower(regexp_replace(translate(%s, '‘’“”–— §', '''''""-- S'), '\s+', ' ', 'g')))"""
_CONTEXT = "trim(coalesce(array_to_string(list_slice(string_split(heading_path, ' > '), 1, len(string_split(heading_path, ' > ')) - 1), ' '), '') || '. ' || heading)"
_POOL = _RUNS + ", " + _QRELS + """, pool AS (SELECT query_id, doc_id, found_by, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY n, best_rank, doc_id) AS place FROM
 (SELECT query_id, doc_id, string_agg(DISTINCT config_name, ',' ORDER BY config_name) AS found_by, count(DISTINCT config_name) AS n, min(rank) AS best_rank FROM runs WHERE rank <= 20 GROUP BY query_id, doc_id)
 WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM j))"""
_SWEEP = _FEATURES + ", " + _QRELS + """, ans AS (SELECT query_id, max(grade) > 0 AS answerable FROM j GROUP BY ALL),
 rec AS (SELECT f.*, ans.answerable, coalesce(j.grade > 0, false) AS ok FROM f JOIN (SELECT DISTINCT search_id, query_id FROM hits) s USING (search_id) JOIN ans USING (query_id)
  LEFT JOIN fin t ON t.search_id = f.search_id AND t.final_rank = 1 LEFT JOIN j ON j.query_id = s.query_id AND j.doc_id = t.doc_id),
 dec AS (SELECT amb, i / 20.0::DOUBLE AS tau, answerable AS k, ok, (""" + _gate("(i / 20.0::DOUBLE)", "amb = 1") + """) IN ('no_results', 'low_confidence', 'ambiguous') AS ab FROM rec, range(21) t(i), range(2) u(amb)),
 sweep AS (SELECT amb::INT AS amb, tau, round(count(*) FILTER (NOT ab) / count(*), 6) AS coverage, round(count(*) FILTER (NOT ab AND k AND ok) / nullif(count(*) FILTER (NOT ab AND k), 0), 6) AS accuracy,
  round(count(*) FILTER (ab AND k) / nullif(count(*) FILTER (k), 0), 6) AS false_abstain, round(count(*) FILTER (ab AND NOT k) / nullif(count(*) FILTER (NOT k), 0), 6) AS refusal FROM dec GROUP BY amb, tau)"""


def _system(config: str) -> str:
    return f"""(SELECT query_id, doc_id AS top, status FROM (SELECT fin.query_id, fin.doc_id, CASE WHEN confidence IS NULL THEN 'no_confidence_signal' WHEN confidence < 0.2 THEN 'low_confidence' ELSE '' END AS status,
 row_number() OVER (PARTITION BY fin.query_id ORDER BY fin.search_id DESC) AS r FROM fin WHERE final_rank = 1 AND config_name = '{config}') WHERE r = 1)"""


_REWRITES = _RERANK + ", " + _QRELS + """, e AS (SELECT query_id, min(search_id) AS a, max(search_id) AS b FROM hits GROUP BY query_id HAVING min(search_id) < max(search_id)),
 t AS (SELECT search_id, confidence AS c, CASE WHEN j.grade > 0 THEN 1.0 ELSE 0.0 END AS g FROM fin LEFT JOIN j USING (query_id, doc_id) WHERE final_rank = 1),
 rw AS (SELECT e.query_id, x.c AS conf, y.c AS conf2, round(1 - abs(x.c - y.c), 6) AS sim, CASE WHEN x.c < 0.8 AND y.c >= 0.8 AND NOT k.answerable THEN 'HARMFUL' WHEN x.c < 0.8 AND y.c >= 0.8 AND y.g > 0 THEN 'rescued'
  WHEN y.g > x.g + 1e-9 THEN 'improved' ELSE 'no change' END AS verdict FROM e JOIN t x ON x.search_id = a JOIN t y ON y.search_id = b JOIN (SELECT query_id, max(grade) > 0 AS answerable FROM j GROUP BY ALL) k ON k.query_id = e.query_id)"""

_WS = r"[\s\x{A0}\x{2002}\x{2007}\x{2009}\x{202F}\x{85}]"
_ANY_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Paragraphs; packed where they fit (a group begins where the last one was too long or is full), else cut like fixed windows; then trimmed.
_STRUCTURED = rf"""WITH RECURSIVE a AS (SELECT doc_id, string_split(text, E'\n\n') AS a FROM documents WHERE length(text) > 0), x AS (SELECT doc_id, a, unnest(range(len(a))) AS i FROM a),
 y AS (SELECT doc_id, a[i + 1] AS p, coalesce(list_sum(list_transform(a[1:i], lambda z: length(z) + 2)), 0) AS pos FROM x),
 z AS (SELECT doc_id, (pos + length(p) - length(ltrim(p, E'\n \t')))::BIGINT AS s, (pos + length(p) - length(ltrim(p, E'\n \t')) + length(trim(p, E'\n \t')))::BIGINT AS e FROM y WHERE length(trim(p, E'\n \t')) > 0),
 par AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM z),
 g AS (SELECT doc_id, k, s, e, CASE WHEN e - s <= 1400 THEN s END AS gs FROM par WHERE k = 1
  UNION ALL SELECT q.doc_id, q.k, q.s, q.e, CASE WHEN q.e - q.s > 1400 THEN NULL WHEN g.gs IS NULL OR q.e - g.gs > 1400 THEN q.s ELSE g.gs END FROM g JOIN par q ON q.doc_id = g.doc_id AND q.k = g.k + 1),
 big AS (SELECT g.doc_id, g.s AS off, substring(d.text, g.s + 1, g.e - g.s) AS t, g.e - g.s AS n FROM g JOIN documents d USING (doc_id) WHERE gs IS NULL),
 w AS (SELECT doc_id, off, t, n, 0::BIGINT AS s, 1400 - (CASE WHEN strpos(reverse(substring(t, 701, 700)), ' ') > 0 THEN strpos(reverse(substring(t, 701, 700)), ' ') ELSE 0 END) AS e FROM big
  UNION ALL SELECT doc_id, off, t, n, e - 200, CASE WHEN e + 1200 < n AND strpos(reverse(substring(t, e + 501, 700)), ' ') > 0 THEN e + 1200 - strpos(reverse(substring(t, e + 501, 700)), ' ') ELSE least(e + 1200, n) END FROM w WHERE e < n),
 spans AS (SELECT doc_id, gs AS s, max(e) AS e FROM g WHERE gs IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, off + s, off + e FROM w WHERE e - s >= 120 OR s = 0
  UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM par)),
 b AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS i, substring(text, s + 1, e - s) AS p FROM spans JOIN documents USING (doc_id)),
 l AS (SELECT *, regexp_replace(p, '^{_WS}+', '') AS l FROM b), u AS (SELECT *, regexp_replace(l, '{_WS}+$', '') AS k FROM l),
 chunked AS (SELECT doc_id, i::INT AS ordinal, (s + length(p) - length(l))::INT AS char_start, (s + length(p) - length(l) + length(k))::INT AS char_end FROM u WHERE length(k) >= 120 OR i = 0)"""

SQL: dict[str, str] = {
    "structured_chunks": f"{_STRUCTURED} SELECT * FROM chunked",
    "contextual_chunks": f"{_STRUCTURED} SELECT chunked.*, CASE WHEN heading_path IS NOT NULL AND heading IS NOT NULL THEN {_CONTEXT} END AS context FROM chunked JOIN documents USING (doc_id)",
    "rewrite_verdict": f"WITH {_REWRITES} SELECT query_id, conf, conf2, verdict FROM rw",
    "guard_sweep": f"""WITH {_REWRITES} SELECT threshold::DOUBLE AS threshold, count(*) FILTER (verdict = 'HARMFUL' AND sim < threshold) AS blocked, count(*) FILTER (verdict IN ('rescued', 'improved') AND sim < threshold) AS lost,
 count(*) FILTER (verdict = 'HARMFUL' AND sim >= threshold) AS survivors FROM rw, (SELECT unnest([0.5, 0.6, 0.7, 0.75, 0.8]) AS threshold) GROUP BY threshold""",
    "tokenize_terms": f"""WITH {_TERMS} SELECT query_id, array_to_string(t, ' ') AS terms, array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' OR ') AS expression FROM terms""",
    "term_stats": f"""WITH w AS (SELECT strategy, chunk_id, unnest({_TOK % "text"}) AS term FROM (SELECT DISTINCT strategy, chunk_id, text FROM chunks)),
 t AS (SELECT strategy, chunk_id, term, count(*) AS n FROM w GROUP BY ALL) SELECT strategy, term, count(*) AS df, sum(n)::BIGINT AS tf FROM t GROUP BY ALL""",
    "bm25_topk": f"""WITH {_TERMS}, asked AS (SELECT DISTINCT query_id, unnest(t) AS term FROM terms),
 c AS (SELECT DISTINCT chunk_id, {_TOK % "text"} AS t FROM chunks WHERE strategy = 'structured'), corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
 tf AS (SELECT term, chunk_id, count(*) AS tf, max(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 10""",
    "dense_topk": """WITH v AS (SELECT DISTINCT chunk_id AS id, strategy, model, vec::DOUBLE[] AS v FROM vectors WHERE len(vec) = 64 AND list_max(list_transform(vec, lambda x: abs(x))) > 0)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.id AS query_id, x.id AS chunk_id, round(list_cosine_similarity(q.v, x.v), 6) AS score
 FROM v q JOIN v x USING (strategy, model) WHERE split_part(q.id, '#', 1)::BIGINT % 50 = 0)) WHERE rank <= 10""",
    "embed_pending": "SELECT DISTINCT chunk_id, strategy, 'hv64-b' AS model, 64 AS dim FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE model = 'hv64-b')",
    "rewrite_faithfulness": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS faithfulness FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "budget_calls": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 300 AS allowed FROM events WHERE ts IS NOT NULL",
    "config_labels": """SELECT strategy, i::INT AS i, strategy || ' / ' || CASE WHEN i % 4 = 3 THEN 'hybrid(rrf)' WHEN i % 2 = 1 THEN 'bm25' WHEN i % 4 = 2 THEN 'dense' ELSE 'none' END || ' / rerank=' || (i >= 4) AS label FROM (SELECT DISTINCT strategy FROM chunks), range(8) t(i)""",
    "dense_topk_embeddings": f"WITH {_EMB} SELECT * FROM {_dense('(SELECT * FROM v WHERE id % 50 = 0)', 'v', 'vec_id')}",
    "normalize_vectors": """WITH v AS (SELECT DISTINCT chunk_id, vec::DOUBLE[] AS v FROM vectors WHERE vec IS NOT NULL), n AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v),
 u AS (SELECT *, list_transform(v, lambda x: x / greatest(norm, 1e-12)) AS u FROM n) SELECT chunk_id, round(norm, 5) AS norm, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 5) AS unit_norm, round(u[1], 5) AS first FROM u""",
    "int8_quantize": """WITH s AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS m FROM embeddings), q AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(round_even(x::DOUBLE * 127.0 / m, 0), -127), 127)::INT) AS q FROM embeddings, s)
 SELECT vec_id, list_sum(q)::INT AS total, list_max(q) AS most, list_min(q) AS least FROM q""",
    "int8_agreement": f"""WITH {_EMB}, s AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) AS m FROM v), w AS (SELECT id, list_transform(v, lambda x: least(greatest(round_even(x * 127.0 / m, 0), -127), 127)) AS v FROM v, s),
 a AS (SELECT * FROM {_dense('(SELECT * FROM v WHERE id % 50 = 0)', 'v', 'vec_id')}), b AS (SELECT * FROM {_dense('(SELECT * FROM v WHERE id % 50 = 0)', 'w', 'vec_id')})
 SELECT a.query_id, count(b.vec_id) AS common FROM a LEFT JOIN b USING (query_id, vec_id) GROUP BY a.query_id""",
    "semantic_cache_hits": f"WITH {_EMB} SELECT query_id, vec_id AS cached_id, round(score, 4) AS similarity, score >= 0.97 AS hit FROM {_dense('(SELECT * FROM v WHERE id % 50 = 0)', '(SELECT * FROM v WHERE id % 50 <> 0)', 'vec_id', 1)}",
    "exact_cache_hits": "WITH k AS (SELECT query_id, sha256(lower(trim(query))) AS k FROM queries) SELECT a.query_id AS request_id, min(b.query_id) AS cached_id FROM k a JOIN k b USING (k) GROUP BY a.query_id",
    "pending_vectors": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE model = 'hv64-b')",
    "rrf_fuse": _RRF.replace("{w}", "1.0"),
    "rrf_weighted": _RRF.replace("{w}", "2.0"),
    "provenance_ranks": "SELECT search_id, chunk_id, max(lexical_rank) AS lexical_rank, max(dense_rank) AS dense_rank FROM hits WHERE lexical_rank IS NOT NULL OR dense_rank IS NOT NULL GROUP BY ALL",
    "rerank_confidence": f"WITH {_RERANK} SELECT search_id, chunk_id, confidence, final_rank FROM fin",
    "hydrate_hits": rf"WITH {_HYD} SELECT search_id, rank, chunk_id, heading, citation, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 60) AS snippet FROM hyd",
    "overlap_rerank": f"WITH {_HYD}, {_TERMS} SELECT search_id, chunk_id, round(len(list_intersect(t, {_TOK % 'text'})) / greatest(len(list_distinct(t)), 1) * 12 - 6, 6) AS logit FROM hyd JOIN terms USING (query_id)",
    "abstain_gate": _gated("0.2", "false"),
    "ambiguity_gate": _gated("0.5", "true"),
    "top_score": f"WITH {_FEATURES} SELECT search_id, n, coalesce(top, 0) AS top, median, docs FROM f",
    "dedupe_docs": f"WITH {_RUNS} SELECT * FROM runs",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "ablation": f"WITH {_METRICS} SELECT config_name, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(ndcg) AS queries FROM m GROUP BY config_name",
    "answerable_queries": f"WITH {_QRELS} SELECT query_id, max(grade) > 0 AS answerable FROM j GROUP BY query_id",
    "latency_percentile": """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
 SELECT event_type, max(value) FILTER (r = least(n, floor(0.5 * n) + 1)) AS p50, max(value) FILTER (r = least(n, floor(0.95 * n) + 1)) AS p95 FROM e GROUP BY event_type""",
    "bootstrap_ci": f"WITH {_METRICS}, " + _bootstrap("v AS (SELECT config_name, query_id, ndcg AS v FROM m WHERE ndcg IS NOT NULL)"),
    "paired_bootstrap": f"WITH {_METRICS}, {_PAIRED}",
    "incremental_delta": f"""WITH {_METRICS}, a AS (SELECT config_name, avg(ndcg) AS m, list_position(['bm25', 'dense', 'hybrid', 'weighted'], config_name) AS p FROM m GROUP BY config_name), x AS (WITH {_PAIRED})
 SELECT config_name, round(m, 6) AS mean, round(m - first(m) OVER (ORDER BY p), 6) AS vs_first, round(m - lag(m) OVER (ORDER BY p), 6) AS vs_previous, lo, hi,
  CASE WHEN p = 1 THEN 'base' WHEN significant AND x.mean > 0 THEN 'earns it' ELSE 'not shown' END AS verdict FROM a LEFT JOIN x USING (config_name)""",
    "worst_queries": f"""WITH {_METRICS}, low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_name ORDER BY ndcg, query_id) AS r FROM m WHERE ndcg IS NOT NULL) WHERE r <= 10),
 want AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY p) AS wanted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id DESC) AS p FROM j WHERE grade > 0) WHERE p <= 3 GROUP BY query_id),
 got AS (SELECT config_name, query_id, string_agg(doc_id, ',' ORDER BY rank) AS got FROM runs WHERE rank <= 3 GROUP BY ALL) SELECT config_name, query_id, ndcg, wanted, got FROM low LEFT JOIN want USING (query_id) LEFT JOIN got USING (config_name, query_id)""",
    "pool_candidates": rf"WITH {_POOL} SELECT pool.*, citation, heading, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 600) AS snippet FROM pool LEFT JOIN documents USING (doc_id)",
    "pool_pending_page": f"WITH {_POOL} SELECT query_id, doc_id, place FROM pool ORDER BY query_id, place LIMIT 20 OFFSET 20",
    "blind_dump": f"WITH {_POOL} SELECT query_id, doc_id FROM (SELECT *, dense_rank() OVER (ORDER BY query_id) AS q FROM pool) WHERE q <= 10",
    "calibrate_tau": f"WITH {_SWEEP} SELECT * FROM sweep",
    "best_tau": f"WITH {_SWEEP} SELECT * FROM sweep WHERE accuracy >= 0 AND false_abstain <= 1 AND refusal IS NOT NULL ORDER BY refusal DESC, false_abstain, coverage DESC, amb, tau DESC, accuracy DESC LIMIT 1",
    "system_agreement": f"WITH {_RERANK} SELECT count(*) AS pairs, count(*) FILTER (a.top = b.top) AS same_top, count(*) FILTER (a.status = b.status) AS same_status FROM {_system('bm25')} a JOIN {_system('hybrid')} b USING (query_id)",
    "paragraph_spans": r"""WITH p AS (SELECT doc_id, string_split(text, E'\n\n') AS a FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, a, unnest(range(len(a))) AS i FROM p),
 y AS (SELECT doc_id, i, a[i + 1] AS p, coalesce(list_sum(list_transform(a[1:i], lambda z: length(z) + 2)), 0) AS pos FROM x)
 SELECT doc_id, i::INT AS ordinal, (pos + length(p) - length(ltrim(p, E'\n \t')))::INT AS char_start, (pos + length(p) - length(ltrim(p, E'\n \t')) + length(trim(p, E'\n \t')))::INT AS char_end FROM y WHERE length(trim(p, E'\n \t')) > 0""",
    "context_prefix": f"SELECT doc_id, CASE WHEN heading_path IS NOT NULL AND heading IS NOT NULL THEN {_CONTEXT} END AS context FROM documents",
    "section_chunks": r"""WITH s AS (SELECT doc_id, text, length(regexp_extract(text, '^[\s\x{A0}\x{2002}\x{2007}\x{2009}\x{202F}\x{85}]*')) AS l FROM documents WHERE length(text) > 0), t AS (SELECT doc_id, l, length(regexp_replace(regexp_replace(text, '^[\s\x{A0}\x{2002}\x{2007}\x{2009}\x{202F}\x{85}]+', ''), '[\s\x{A0}\x{2002}\x{2007}\x{2009}\x{202F}\x{85}]+$', '')) AS n FROM s)
 SELECT doc_id, 0 AS ordinal, l::INT AS char_start, (l + n)::INT AS char_end FROM t""",
    "offset_audit": r"""WITH c AS (SELECT DISTINCT chunk_id, doc_id, strategy, char_start, char_end, text FROM chunks)
 SELECT strategy, count(*) AS checked, count(*) FILTER (regexp_replace(substring(d.text, char_start + 1, char_end - char_start), '^\s+|\s+$', '', 'g') <> regexp_replace(c.text, '^\s+|\s+$', '', 'g')) AS bad FROM c JOIN documents d USING (doc_id) GROUP BY strategy""",
    "exact_quote_match": f"""WITH c AS (SELECT DISTINCT chunk_id, doc_id, text AS q FROM chunks)
 SELECT chunk_id, length({_FOLD % 'q'}) >= 12 AND contains({_FOLD % 'd.text'}, {_FOLD % 'q'}) AS found FROM c JOIN documents d USING (doc_id)""",
    "verify_citations": f"WITH {_HYD} SELECT search_id AS query_id, count(*) FILTER (length({_FOLD % 'text'}) >= 12) AS verified, count(*) FILTER (length({_FOLD % 'text'}) < 12) + 1 AS dropped FROM hyd GROUP BY search_id",
    "prompt_assembly": f"""WITH {_HYD} SELECT search_id, md5(string_agg('[' || rank || '] ' || coalesce(citation, '') || ' - ' || coalesce(heading, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)
 || chr(10) || chr(10) || 'Question: ' || coalesce(max(query), '')) AS prompt FROM hyd JOIN queries USING (query_id) GROUP BY search_id""",
    "highlight_spans": """WITH c AS (SELECT DISTINCT chunk_id, doc_id, char_start AS s, char_end AS e FROM chunks) SELECT chunk_id, md5(CASE WHEN s >= 0 AND s < e AND e <= length(text) THEN substring(text, 1, s) || '[[' || substring(text, s + 1, e - s) || ']]' || substring(text, e + 1) ELSE text END) AS marked
 FROM c JOIN documents USING (doc_id)""",
    "daily_budget": "SELECT strftime(ts, '%Y-%m-%d') AS day, least(count(*), 300) AS used, greatest(300 - count(*), 0) AS remaining, greatest(count(*) - 300, 0) AS refused FROM events WHERE ts IS NOT NULL GROUP BY strftime(ts, '%Y-%m-%d')",
    "token_bucket": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 b AS (SELECT event_id, user_id, t, r, 2.0::DOUBLE AS had FROM e WHERE r = 1 UNION ALL
  SELECT e.event_id, e.user_id, e.t, e.r, least(2.0, (CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END) + greatest(0.0, e.t - b.t) / 86400) FROM b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1)
 SELECT event_id, user_id, had >= 1 AS allowed, round(CASE WHEN had >= 1 THEN 0.0 ELSE (1 - had) * 86400 END, 1) AS wait FROM b""",
    "retry_after": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR value IS NULL THEN 86400.0::DOUBLE ELSE round(value, 1) END AS seconds FROM events",
    "client_key": """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (event_id % 256) END, CASE WHEN event_id % 4 > 0 THEN 'h' || user_id END, 'unknown') AS client FROM events""",
    "guard_status": "SELECT query_id, CASE WHEN coalesce(trim(query), '') = '' THEN 400 WHEN length(query) > 500 THEN 413 WHEN coalesce(type, 'structured') NOT IN ('fixed', 'section', 'structured', 'contextual') THEN 400 ELSE 200 END AS status, least(length(query), 20)::INT AS k FROM queries",
    "grade_guard": "SELECT query_id, doc_id, judged_at, CASE WHEN grade - 1 BETWEEN 0 AND 3 THEN 200 ELSE 400 END AS status FROM (SELECT DISTINCT * FROM qrels)",
    "index_text": "SELECT DISTINCT chunk_id, md5(CASE WHEN coalesce(context, '') <> '' THEN context || chr(10) || text ELSE text END) AS indexed FROM chunks",
    "cache_put": "SELECT key, search_id FROM (SELECT sha256(lower(trim(query))) AS key, search_id, row_number() OVER (PARTITION BY sha256(lower(trim(query))) ORDER BY searched_at DESC, search_id DESC) AS r FROM (SELECT DISTINCT query_id, search_id, searched_at FROM hits) JOIN queries USING (query_id)) WHERE r = 1",
    "point_lookup": "SELECT doc_id, heading, citation, n_chars FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)",
    "single_list": _RRF.split(" UNION ALL ")[0].replace("{w} / (60 + lexical_rank) AS part, 1 AS l", "-lexical_rank::DOUBLE AS part") + ") GROUP BY ALL)",
    "p6_found": """WITH s AS (SELECT snapshot_id, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, doc_id ORDER BY fetched_at DESC NULLS LAST) AS r FROM doc_snapshots) WHERE r = 1),
 p AS (SELECT snapshot_id AS cur, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS prev FROM (SELECT DISTINCT snapshot_id FROM doc_snapshots)),
 n AS (SELECT p.cur, s.doc_id, s.text FROM p JOIN s ON s.snapshot_id = p.cur WHERE prev IS NOT NULL), o AS (SELECT p.cur, s.doc_id, s.text FROM p JOIN s ON s.snapshot_id = p.prev)
 SELECT coalesce(n.cur, o.cur) AS snapshot_id, coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM n FULL JOIN o ON n.cur = o.cur AND n.doc_id = o.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR n.text IS DISTINCT FROM o.text""",
    "upsert_documents": """WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY snapshot_id DESC, fetched_at DESC NULLS LAST, heading NULLS FIRST, text NULLS FIRST) AS r FROM doc_snapshots) WHERE r = 1)
 SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE o.title END AS title, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE o.part END AS part, CASE WHEN n.doc_id IS NULL THEN o.heading ELSE n.heading END AS heading,
 md5(CASE WHEN n.doc_id IS NULL THEN o.text ELSE n.text END) AS text FROM documents o FULL JOIN n ON o.doc_id = n.doc_id""",
    "qrels_merge": f"WITH {_QRELS} SELECT * FROM j",
    "qrels_status": f"""WITH {_QRELS} SELECT 'judged_by' AS what, judged_by AS value, count(*) AS n, count(DISTINCT query_id) FILTER (grade > 0) AS answerable FROM j GROUP BY judged_by
 UNION ALL SELECT 'grade', grade::VARCHAR, count(*), count(DISTINCT query_id) FILTER (grade > 0) FROM j GROUP BY grade""",
    "dup_id_suffix": "SELECT doc_id, CASE WHEN r > 1 THEN doc_key || '~' || (r - 1) ELSE doc_key END AS unique_key FROM (SELECT doc_id, doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY doc_id) AS r FROM documents)",
    "corpus_stats": """SELECT c.strategy, chunks, coalesce(vectors, 0) AS vectors, (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(length(text)), 0)::BIGINT FROM documents) AS characters, (SELECT count(DISTINCT query_id) FROM qrels) AS judged_queries
 FROM (SELECT strategy, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY ALL) c LEFT JOIN (SELECT strategy, count(DISTINCT chunk_id) AS vectors FROM vectors GROUP BY ALL) v USING (strategy)""",
    "missing_parents": "SELECT DISTINCT doc_id FROM doc_snapshots WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "citation_extract": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND citation IS NOT NULL THEN citation ELSE title || ' CFR ' || section END AS citation FROM documents",
    "xml_sections": rf"""WITH x AS (SELECT doc_id, title, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x09\x0A\x20-\x{{D7FF}}]', '', 'g'), '[ \t\x{{A0}}]+', ' ', 'g'), '^{_ANY_WS}+|{_ANY_WS}+$', '', 'g') AS t FROM documents)
 SELECT 'ecfr:' || title || ':' || doc_id AS doc_id, doc_id::VARCHAR AS section, 'Title ' || title || ' > Part > Head' AS heading_path, md5('Head' || chr(10) || chr(10) || regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM x WHERE t <> ''""",
    "fixed_chunks": r"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n, 0::BIGINT AS i, 0::BIGINT AS s, least(1400, length(text)) AS hard FROM documents WHERE length(text) > 0),
 c AS (SELECT doc_id, text, n, i, s, CASE WHEN hard < n AND strpos(reverse(substring(text, s + 701, hard - s - 700)), ' ') > 0 THEN hard - strpos(reverse(substring(text, s + 701, hard - s - 700)), ' ') ELSE hard END AS e FROM w
  UNION ALL SELECT doc_id, text, n, i + (CASE WHEN e - s >= 120 OR i = 0 THEN 1 ELSE 0 END), t, CASE WHEN least(t + 1400, n) < n AND strpos(reverse(substring(text, t + 701, 700)), ' ') > 0 THEN t + 1400 - strpos(reverse(substring(text, t + 701, 700)), ' ') ELSE least(t + 1400, n) END
   FROM (SELECT *, greatest(e - 200, s + 1) AS t FROM c WHERE e < n)),
 b AS (SELECT doc_id, i, s, substring(text, s + 1, e - s) AS p FROM c WHERE e - s >= 120 OR i = 0),
 t AS (SELECT doc_id, i, s, p, regexp_replace(p, '^[\s\x{A0}\x{2002}\x{2007}\x{2009}\x{202F}\x{85}]+', '') AS l FROM b), u AS (SELECT *, regexp_replace(l, '[\s\x{A0}\x{2002}\x{2007}\x{2009}\x{202F}\x{85}]+$', '') AS k FROM t)
 SELECT doc_id, i::INT AS ordinal, (s + length(p) - length(l))::INT AS char_start, (s + length(p) - length(l) + length(k))::INT AS char_end FROM u WHERE length(k) >= 120 OR i = 0""",
}


SQL["best_tau_targets"] = SQL["best_tau"].replace("accuracy >= 0 AND false_abstain <= 1 ", "accuracy >= 0.90 AND false_abstain <= 0.05 ")
