"""SQL that must give the same rows as the queries, where SQL can say it within reason."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(%s, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _grams(words: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({words}) - {n - 2}, 1)), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


_HITS = """h AS (SELECT search_id, chunk_id, max(score) AS a, max(rerank_score) AS b, max(-lexical_rank) AS c, max(-dense_rank) AS d FROM hits GROUP BY ALL)"""
_BEATS = " + ".join(f"(CASE WHEN coalesce(x.{f}, '-infinity'::DOUBLE) > coalesce(y.{f}, '-infinity'::DOUBLE) THEN 1 ELSE 0 END)" for f in "abcd")
_RANKS = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY search_id ORDER BY {f} DESC NULLS LAST) END AS r{f}" for f in "abcd")
_VECTORS = """v AS (SELECT DISTINCT chunk_id AS id, strategy, model, vec::DOUBLE[] AS v FROM vectors WHERE len(vec) = 64 AND list_max(list_transform(vec, lambda x: abs(x))) > 0)"""
_SPREAD = f"""w AS (SELECT doc_id, unnest({_WORDS % "text"}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
 spread AS (SELECT term, count(*) AS df, 1 - (ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf)) / ln((SELECT count(text) FROM documents)) AS gw FROM tf GROUP BY term)"""

def _end(before: str) -> str:
    """The last end in the second half of the window that the pattern stands before."""
    found = f"length(regexp_extract(w, '(?s)^.*{before}'))"
    return f"CASE WHEN {found} >= 700 THEN e - 200 + {found} END"


SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 1400),
 p AS (SELECT doc_id, n, NULL::BIGINT AS s, 200::BIGINT AS e FROM d
  UNION ALL SELECT doc_id, n, e - 200, CASE WHEN n - (e - 200) <= 1400 THEN n ELSE coalesce(
     {_end(r"\n\n")}, {_end(r"(?:。|[.;:!?][ \t\n])")}, {_end(r"[ \t\n]")}, e + 1200) END
   FROM (SELECT p.doc_id, p.n, p.e, substring(d.text, p.e - 200 + 1, 1400) AS w FROM p JOIN d USING (doc_id) WHERE p.e < p.n))
 SELECT doc_id, s AS char_start, e AS char_end FROM p WHERE s IS NOT NULL""",
    "p2_found": f"""WITH {_HITS} SELECT search_id, chunk_id FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.search_id = x.search_id AND y.chunk_id <> x.chunk_id AND {_BEATS} < 3)""",
    "p2_ranking": f"""WITH {_HITS}, r AS (SELECT search_id, chunk_id, {_RANKS} FROM h),
 f AS (SELECT search_id, chunk_id, coalesce(1 / (60 + ra), 0) + coalesce(1 / (60 + rb), 0) + coalesce(1 / (60 + rc), 0) + coalesce(1 / (60 + rd), 0) AS rrf FROM r)
 SELECT search_id, chunk_id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY search_id ORDER BY rrf DESC, chunk_id) AS fused_rank FROM f""",
    "p3_found": f"""WITH {_VECTORS}, s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 7) AS s FROM v a JOIN v b ON a.strategy = b.strategy AND a.model = b.model AND a.id <> b.id),
 n AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s) WHERE r <= 5 AND s >= 0.85)
 SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM n""",
    "p4_found": f"""WITH c AS (SELECT DISTINCT chunk_id, strategy, {_WORDS % "text"} AS w FROM chunks), g AS (SELECT DISTINCT chunk_id, strategy, unnest({_grams("w", 3)}) AS g FROM c),
 n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id HAVING count(*) >= 20), p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, count(*) AS k FROM g x JOIN g y ON x.strategy = y.strategy AND x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY ALL)
 SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n na ON na.chunk_id = a JOIN n nb ON nb.chunk_id = b WHERE 10 * k >= 7 * (na.n + nb.n - k)""",
    "p5_found": rf"""WITH {_SPREAD}, c AS (SELECT chunk_id, doc_id, term, count(*) AS n FROM (SELECT chunk_id, doc_id, unnest({_WORDS % "text"}) AS term FROM (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE strategy = 'structured')) GROUP BY ALL),
 h AS (SELECT DISTINCT doc_id, unnest({_WORDS % "heading"}) AS term FROM documents)
 SELECT chunk_id, term FROM c JOIN h USING (doc_id, term) JOIN spread USING (term) WHERE n >= 3 AND df BETWEEN 1 AND 5 AND length(term) >= 4 AND regexp_full_match(term, '\p{{L}}+')""",
    "p5_weights": f"""WITH {_SPREAD}, c AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest({_WORDS % "text"}) AS term FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE strategy = 'structured')) GROUP BY ALL)
 SELECT chunk_id, count(*) AS terms, round(sum(ln(1 + n) * gw), 4) AS total, round(max(ln(1 + n) * gw), 4) AS most FROM c JOIN spread USING (term) GROUP BY chunk_id""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS % "text"} AS w FROM documents), i AS (SELECT item_id, {_WORDS % "text"} AS w FROM eval_items),
 dg AS (SELECT DISTINCT doc_id, unnest({_grams("w", 13)}) AS g FROM d), ig AS (SELECT DISTINCT item_id, unnest({_grams("w", 13)}) AS g FROM i) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_found": f"""WITH d AS (SELECT doc_id, {_WORDS % "text"} AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, {_grams("w", 5)} AS g FROM d WHERE len(w) >= 50)
 SELECT doc_id FROM g WHERE 10 * (len(g) - len(list_distinct(g))) >= 3 * len(g)""",
    "p10_shares": f"""WITH d AS (SELECT doc_id, {_WORDS % "text"} AS w FROM documents), g AS (SELECT doc_id, len(w) AS words, {_grams("w", 5)} AS g FROM d)
 SELECT doc_id, words, round(CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0 END, 9) AS share FROM g""",
}
