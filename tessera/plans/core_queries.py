"""Queries of the core operators over the given tables. Their SQL is in core_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import chunking, dense, evaluation, fusion, lexical, quotes, serving, snapshots, tables
from tessera.plans.core_sql import SQL as SQL
from tessera.session import table
from tessera.sources import files, xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIGS = ["bm25", "dense", "hybrid", "weighted"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- retrieval


@query
def bm25_topk(s, d):
    return lexical.bm25_plain(table(s, d, "chunks"), table(s, d, "queries"))


@query
def bm25_fts5(s, d):
    return lexical.bm25_fulltext(table(s, d, "chunks"), table(s, d, "queries"))


@query
def tokenize_terms(s, d):
    q = F.col("query")
    return table(s, d, "queries").select("query_id", F.array_join(lexical.query_terms(q), " ").alias("terms"), lexical.match_expression(q).alias("expression"))


@query
def term_stats(s, d):
    return lexical.term_stats(table(s, d, "chunks"))


def _fiftieth(c):
    return F.split_part(c, F.lit("#"), F.lit(1)).cast("bigint") % 50 == 0


@query
def dense_topk(s, d):
    """Every vector of a document whose id is divisible by 50, against all vectors of its strategy and model."""
    v = table(s, d, "vectors").dropDuplicates(["chunk_id"]).withColumn("index", F.concat_ws("/", "strategy", "model"))
    return dense.dense_topk(v.filter(_fiftieth(F.col("chunk_id"))).withColumnRenamed("chunk_id", "query_id"), v, item="chunk_id", within="index")


@query
def dense_topk_embeddings(s, d):
    v = table(s, d, "embeddings")
    return dense.dense_topk(v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, item="vec_id", vec="embedding")


@query
def normalize_vectors(s, d):
    v = table(s, d, "vectors").filter("vec IS NOT NULL").distinct()
    u = dense.normalize(F.col("vec"))
    return v.select("chunk_id", F.round(dense.norm(F.col("vec")), 5).alias("norm"), F.round(dense.norm(u), 5).alias("unit_norm"), F.round(F.get(u, F.lit(0)), 5).alias("first"))


@query
def int8_quantize(s, d):
    q = dense.quantize(table(s, d, "embeddings"), "vec_id", "embedding")
    whole = F.transform("q", lambda x: x.cast("int"))
    return q.select("vec_id", F.aggregate(whole, F.lit(0), lambda a, x: a + x).alias("total"), F.array_max(whole).alias("most"), F.array_min(whole).alias("least"))


@query
def int8_agreement(s, d):
    v = table(s, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    near = dense.quantize(v, "vec_id", "embedding").withColumn("embedding", F.transform("q", lambda x: x.cast("float")))
    a = dense.dense_topk(q, v, item="vec_id", vec="embedding")
    b = dense.dense_topk(q, near, item="vec_id", vec="embedding").select("query_id", "vec_id", F.lit(1).alias("also"))
    return a.join(b, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("also").alias("common"))


@query
def semantic_cache_hits(s, d):
    v = table(s, d, "embeddings")
    best = dense.dense_topk(v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v.filter("vec_id % 50 <> 0"), k=1, item="vec_id", vec="embedding")
    return best.select("query_id", F.col("vec_id").alias("cached_id"), F.round("score", 4).alias("similarity"), (F.col("score") >= serving.CACHE_COSINE).alias("hit"))


@query
def exact_cache_hits(s, d):
    q = table(s, d, "queries")
    return serving.exact_cache_hits(q.withColumnRenamed("query_id", "request_id"), q.withColumnRenamed("query_id", "cached_id"))


@query
def pending_vectors(s, d):
    return dense.pending_vectors(table(s, d, "chunks"), table(s, d, "vectors"), "hv64-b")


@query
def embed_pending(s, d):
    made = dense.embed_pending(table(s, d, "chunks"), table(s, d, "vectors"), "hv64-b", dense.hashing_embedder)
    return made.select("chunk_id", "strategy", "model", "dim")


@query
def rewrite_faithfulness(s, d):
    """Each embedding and the next one, as if that were of its rewritten query."""
    v = table(s, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(dense.faithfulness(F.col("embedding"), F.col("next")), 5).alias("faithfulness"))


# --- fusion, rerank, gate


def _given(s, d, column):
    return table(s, d, "hits").select("search_id", "chunk_id", F.col(column).alias("rank")).filter("rank IS NOT NULL").distinct()


@query
def rrf_fuse(s, d):
    return fusion.reciprocal_rank_fusion([_given(s, d, "lexical_rank"), _given(s, d, "dense_rank")], "search_id")


@query
def rrf_weighted(s, d):
    return fusion.reciprocal_rank_fusion([_given(s, d, "lexical_rank"), _given(s, d, "dense_rank")], "search_id", weights=[2.0, 1.0])


@query
def single_list(s, d):
    """One retriever alone: its list passes as it is, without fusion."""
    return fusion.combined([_given(s, d, "lexical_rank")], "search_id")


@query
def provenance_ranks(s, d):
    a, b = _given(s, d, "lexical_rank").withColumnRenamed("rank", "lexical_rank"), _given(s, d, "dense_rank").withColumnRenamed("rank", "dense_rank")
    return a.join(b, ["search_id", "chunk_id"], "full")


def _reranked(s, d):
    return fusion.rerank(table(s, d, "hits"))


@query
def rerank_confidence(s, d):
    return _reranked(s, d).select("search_id", "chunk_id", "confidence", "final_rank")


def _hydrated(s, d):
    ranked = _reranked(s, d).select("search_id", "query_id", "chunk_id", "doc_id", F.col("final_rank").alias("rank"))
    return fusion.hydrate(ranked, table(s, d, "chunks"), table(s, d, "documents"))


@query
def hydrate_hits(s, d):
    return _hydrated(s, d).select("search_id", "rank", "chunk_id", "heading", "citation", quotes.snippet(F.col("text"), 60).alias("snippet"))


@query
def overlap_rerank(s, d):
    asked = table(s, d, "queries").select("query_id", lexical.query_terms(F.col("query")).alias("q"))
    return _hydrated(s, d).join(asked, "query_id").select("search_id", "chunk_id", fusion.overlap_score(F.col("q"), lexical.tokens(F.col("text"))).alias("logit"))


@query
def abstain_gate(s, d):
    return fusion.gate(_reranked(s, d), table(s, d, "hits"))


@query
def ambiguity_gate(s, d):
    return fusion.gate(_reranked(s, d), table(s, d, "hits"), tau=0.5, ambiguity=True)


@query
def top_score(s, d):
    return fusion.features(_reranked(s, d), table(s, d, "hits")).select("search_id", "n", F.coalesce("top", F.lit(0.0)).alias("top"), "median", "docs")


# --- evaluation


def _judged(s, d):
    return evaluation.merged_qrels(table(s, d, "qrels"))


def _runs(s, d):
    return evaluation.latest_runs(table(s, d, "hits"))


def _metrics(s, d):
    return evaluation.metrics(_runs(s, d), _judged(s, d))


@query
def dedupe_docs(s, d):
    return _runs(s, d)


@query
def retrieval_metrics(s, d):
    return _metrics(s, d)


@query
def ablation(s, d):
    return _metrics(s, d).groupBy("config_name").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")), F.count("ndcg").alias("queries"))


@query
def answerable_queries(s, d):
    return evaluation.answerable(_judged(s, d))


@query
def latency_percentile(s, d):
    e = table(s, d, "events")
    return evaluation.percentile(e, ["event_type"], "value", 0.5, "p50").join(evaluation.percentile(e, ["event_type"], "value", 0.95, "p95"), "event_type")


@query
def bootstrap_ci(s, d):
    return evaluation.bootstrap(_metrics(s, d), "config_name", "query_id", "ndcg")


def _deltas(s, d):
    m = _metrics(s, d).select("config_name", "query_id", "ndcg")
    base = m.filter("config_name = 'bm25'").select("query_id", F.col("ndcg").alias("base"))
    return m.filter("config_name <> 'bm25'").join(base, "query_id").select("config_name", "query_id", (F.col("ndcg") - F.col("base")).alias("delta"))


@query
def paired_bootstrap(s, d):
    return evaluation.paired(_deltas(s, d), "config_name", "query_id", "delta")


@query
def incremental_delta(s, d):
    return evaluation.incremental(_metrics(s, d), CONFIGS).join(
        evaluation.paired(_deltas(s, d), "config_name", "query_id", "delta").select("config_name", F.col("mean").alias("gain"), "lo", "hi", "significant"), "config_name", "left"
    ).select("config_name", "mean", "vs_first", "vs_previous", "lo", "hi", evaluation.verdict(F.col("config_name") == CONFIGS[0], F.col("significant"), F.col("gain")).alias("verdict"))


@query
def worst_queries(s, d):
    return evaluation.worst_queries(_metrics(s, d), _runs(s, d), _judged(s, d))


@query
def pool_candidates(s, d):
    about = table(s, d, "documents").select("doc_id", "citation", "heading", quotes.snippet(F.col("text"), 600).alias("snippet"))
    return evaluation.pool(_runs(s, d), _judged(s, d)).join(about, "doc_id", "left")


@query
def pool_pending_page(s, d):
    return files.page(evaluation.pool(_runs(s, d), _judged(s, d)).select("query_id", "doc_id", "place"), ["query_id", "place"], 20, 20)


@query
def blind_dump(s, d):
    return files.blind(evaluation.pool(_runs(s, d), _judged(s, d)), 10)


@query
def calibrate_tau(s, d):
    return evaluation.sweep(_reranked(s, d), table(s, d, "hits"), _judged(s, d))


@query
def best_tau(s, d):
    """The best row of the sweep whatever its accuracy and false abstentions, as its SQL states; best_tau_targets asks for the reference's targets."""
    return evaluation.best_threshold(calibrate_tau(s, d), accuracy=0.0, false_abstain=1.0)


@query
def best_tau_targets(s, d):
    return evaluation.best_threshold(calibrate_tau(s, d))


def _system(s, d, config):
    hits = table(s, d, "hits").filter(F.col("config_name") == config)
    gate = fusion.gate(fusion.rerank(hits), hits)
    top = fusion.rerank(hits).filter("final_rank = 1")
    last = Window.partitionBy("query_id").orderBy(F.desc("search_id"))
    return top.join(gate.select("search_id", "reason"), "search_id").withColumn("r", F.row_number().over(last)).filter("r = 1").select("query_id", F.col("doc_id").alias("top"), F.col("reason").alias("status"))


@query
def system_agreement(s, d):
    return evaluation.agreement(_system(s, d, "bm25"), _system(s, d, "hybrid"), "query_id")


def _rewrites(s, d):
    """The first and the last search of each query, as if the last were a rewrite of the first."""
    hits = table(s, d, "hits")
    ends = hits.groupBy("query_id").agg(F.min("search_id").alias("a"), F.max("search_id").alias("b")).filter("a < b")
    ranked = fusion.rerank(hits)
    tops = ranked.filter("final_rank = 1").join(_judged(s, d).select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").select("search_id", "confidence", F.when(F.col("grade") > 0, 1.0).otherwise(0.0).alias("good"))
    a, b = tops.toDF("a", "conf", "ndcg"), tops.toDF("b", "conf2", "ndcg2")
    both = ends.join(a, "a").join(b, "b").join(evaluation.answerable(_judged(s, d)), "query_id")
    return evaluation.rewrite_verdict(both.withColumn("sim", F.round(1 - F.abs(F.col("conf") - F.col("conf2")), 6)), F.lit(0.8))


@query
def rewrite_verdict(s, d):
    return _rewrites(s, d).select("query_id", "conf", "conf2", "verdict")


@query
def guard_sweep(s, d):
    return evaluation.guard_sweep(_rewrites(s, d))


def search_ndcg(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(search_id, ndcg) at 10 of every search, not only of a query's latest."""
    runs = fusion.first_docs(fusion.ranked_hits(hits), ["search_id", "query_id"]).withColumnRenamed("search_id", "config_name")
    return evaluation.metrics(runs, qrels).select(F.col("config_name").alias("search_id"), "ndcg")


def rewrites(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every search of a query and the next one, as if that were its rewrite, with nDCG; ``sim``, from the confidences, stands in for the queries' similarity."""
    tops = fusion.rerank(hits).filter("final_rank = 1").select("search_id", "confidence").join(search_ndcg(hits, qrels), "search_id", "left")
    following = F.lead("search_id").over(Window.partitionBy("query_id").orderBy("search_id"))
    pairs = hits.select("query_id", "search_id").distinct().withColumn("search_id2", following).filter("search_id2 IS NOT NULL")
    both = pairs.join(tops.toDF("search_id", "conf", "ndcg"), "search_id").join(tops.toDF("search_id2", "conf2", "ndcg2"), "search_id2").join(evaluation.answerable(qrels), "query_id")
    return evaluation.rewrite_verdict(both.withColumn("sim", F.round(1 - F.abs(F.col("conf") - F.col("conf2")), 6)), F.lit(0.8))


@query
def rewrite_verdict_ndcg(s, d):
    return rewrites(table(s, d, "hits"), _judged(s, d)).select("query_id", "search_id", "search_id2", "conf", "conf2", "ndcg", "ndcg2", "verdict")


@query
def guard_sweep_ndcg(s, d):
    return evaluation.guard_sweep(rewrites(table(s, d, "hits"), _judged(s, d)))


# --- chunks


@query
def paragraph_spans(s, d):
    return chunking.paragraph_spans(table(s, d, "documents"))


@query
def fixed_chunks(s, d):
    return chunking.build_chunks(table(s, d, "documents"), "fixed").select("doc_id", "ordinal", "char_start", "char_end")


@query
def structured_chunks(s, d):
    return chunking.build_chunks(table(s, d, "documents"), "structured").select("doc_id", "ordinal", "char_start", "char_end")


@query
def contextual_chunks(s, d):
    c = chunking.build_chunks(table(s, d, "documents"), "contextual", keep=("heading_path", "heading"))
    return c.select("doc_id", "ordinal", "char_start", "char_end", chunking.context_of(F.col("heading_path"), F.col("heading")).alias("context"))


@query
def section_chunks(s, d):
    return chunking.build_chunks(table(s, d, "documents"), "section").select("doc_id", "ordinal", "char_start", "char_end")


@query
def context_prefix(s, d):
    return table(s, d, "documents").select("doc_id", chunking.context_of(F.col("heading_path"), F.col("heading")).alias("context"))


@query
def offset_audit(s, d):
    return chunking.offset_audit(table(s, d, "chunks"), table(s, d, "documents"))


# --- quotes and answers


def _quoted(s, d):
    """Every chunk's whole text as a quote of its document."""
    chunks = table(s, d, "chunks").dropDuplicates(["chunk_id"])
    return chunks.select("chunk_id", "doc_id", F.col("text").alias("quote")).join(table(s, d, "documents").select("doc_id", "text"), "doc_id")


@query
def exact_quote_match(s, d):
    return quotes.exact_matches(_quoted(s, d)).select("chunk_id", "found")


@query
def fuzzy_quotes(s, d):
    worn = F.regexp_replace("quote", r"(?<=\w{5})e(?=\w)", "")
    return quotes.locate_quotes(_quoted(s, d).withColumn("quote", worn)).select("chunk_id", "start", "end", "ratio")


@query
def verify_citations(s, d):
    sources = _hydrated(s, d).select(F.col("search_id").alias("query_id"), F.col("rank").alias("place"), "chunk_id", "char_start", "text")
    real = sources.select("query_id", F.col("place").cast("string").alias("source"), F.col("text").alias("quote"))
    wrong = sources.select("query_id", F.lit("n/a").alias("source"), F.lit("a quote without any source").alias("quote")).distinct()
    return quotes.verify_citations(real.unionByName(wrong), sources, fuzzy=False)[1]


@query
def verify_citations_fuzzy(s, d):
    """Quotes from the middle of every source, by place: as they are, with a word left out, with letters worn off, exchanged for another text; and places that aren't there."""
    sources = _hydrated(s, d).select(F.col("search_id").alias("query_id"), F.col("rank").alias("place"), "chunk_id", "char_start", "text")
    middle = F.substring("text", F.floor(F.length("text") / 3).cast("int") + 1, F.lit(80))
    quote = (
        F.when(F.col("place") % 4 == 1, middle)
        .when(F.col("place") % 4 == 2, F.regexp_replace(middle, r"^(.{20,40}?) \w+ ", "$1 "))
        .when(F.col("place") % 4 == 3, F.regexp_replace(middle, r"(?<=\w{5})e(?=\w)", ""))
        .otherwise(F.reverse(middle))
    )
    cited = sources.select("query_id", F.col("place").cast("string").alias("source"), quote.alias("quote"))
    outside = sources.filter("place = 1").select("query_id", F.explode(F.array(*map(F.lit, ("0", "99", "-1", "n/a")))).alias("source"), middle.alias("quote"))
    return quotes.verify_citations(cited.unionByName(outside), sources)[1]


@query
def prompt_assembly(s, d):
    hits = _hydrated(s, d).join(table(s, d, "queries").select("query_id", "query"), "query_id")
    return serving.prompts(hits, "search_id").select("search_id", F.md5("prompt").alias("prompt"))


@query
def highlight_spans(s, d):
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).join(table(s, d, "documents").select("doc_id", F.col("text").alias("doc")), "doc_id")
    return c.select("chunk_id", F.md5(quotes.highlight(F.col("doc"), F.col("char_start"), F.col("char_end"))).alias("marked"))


@query
def index_text(s, d):
    return table(s, d, "chunks").distinct().select("chunk_id", F.md5(chunking.index_text(F.col("context"), F.col("text"))).alias("indexed")).distinct()


# --- budgets, limits, guards


@query
def daily_budget(s, d):
    return serving.daily_budget(table(s, d, "events"), limit=300).withColumn("day", F.col("day").cast("string"))


@query
def budget_calls(s, d):
    return serving.admitted(table(s, d, "events"), limit=300).withColumn("day", F.col("day").cast("string"))


@query
def config_labels(s, d):
    flag = lambda n: (F.floor(F.col("i") / n) % 2 == 1)
    grid = table(s, d, "chunks").select("strategy").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return grid.select("strategy", "i", fusion.describe(F.col("strategy"), flag(1), flag(2), flag(4)).alias("label"))


@query
def token_bucket(s, d):
    got = serving.token_bucket(table(s, d, "events"), capacity=2.0, refill=1 / 86400)
    return got.select("event_id", "user_id", "allowed", F.round("wait", 1).alias("wait"))


@query
def retry_after(s, d):
    wait = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(s, d, "events").select("event_id", serving.retry_after(wait).alias("seconds"))


@query
def client_key(s, d):
    e = F.col("event_id")
    forwarded = F.when(e % 3 == 0, F.concat(F.lit(" 10.0.0."), e % 256, F.lit(" , proxy"))).when(e % 3 == 1, F.lit(""))
    host = F.when(e % 4 > 0, F.concat(F.lit("h"), F.col("user_id")))
    return table(s, d, "events").select("event_id", serving.client_key(forwarded, host).alias("client"))


@query
def guard_status(s, d):
    return table(s, d, "queries").select("query_id", serving.guard(F.col("query"), F.coalesce("type", F.lit("structured"))).alias("status"), serving.served_k(F.length("query")).alias("k"))


@query
def grade_guard(s, d):
    return table(s, d, "qrels").distinct().select("query_id", "doc_id", "judged_at", serving.grade_guard(F.col("grade") - 1).alias("status"))


@query
def cache_put(s, d):
    answered = table(s, d, "hits").select("query_id", "search_id", "searched_at").distinct().join(table(s, d, "queries").select("query_id", "query"), "query_id")
    old = answered.filter("search_id % 3 = 0").select(serving.query_key(F.col("query")).alias("key"), "search_id", "searched_at")
    return serving.cache_put(old, answered, ["search_id"], "searched_at", "search_id").select("key", "search_id")


# --- tables


@query
def p6_found(s, d):
    return snapshots.snapshot_changes(table(s, d, "doc_snapshots"))


@query
def point_lookup(s, d):
    documents = table(s, d, "documents")
    return tables.lookup(documents, "doc_id", documents.agg(F.max("doc_id")).first()[0]).select("doc_id", "heading", "citation", "n_chars")


@query
def upsert_documents(s, d):
    snaps = table(s, d, "doc_snapshots")
    order = Window.partitionBy("doc_id").orderBy(F.desc("snapshot_id"), F.desc_nulls_last("fetched_at"), "heading", "text")
    newest = snaps.withColumn("r", F.row_number().over(order)).filter("r = 1").withColumns({"title": F.lit("new"), "part": F.lit("new")})
    both = tables.upsert(table(s, d, "documents"), newest, "doc_id", ["heading", "text"], ["title", "part"])
    return both.select("doc_id", "title", "part", "heading", F.md5("text").alias("text"))


@query
def qrels_merge(s, d):
    return _judged(s, d).select("query_id", "doc_id", "grade", "judged_by")


@query
def qrels_status(s, d):
    j = _judged(s, d)
    by = lambda kind, c: j.groupBy(F.lit(kind).alias("what"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("grade") > 0, F.col("query_id"))).alias("answerable"))
    return by("judged_by", "judged_by").unionByName(by("grade", "grade"))


@query
def dup_id_suffix(s, d):
    return tables.suffix_duplicates(table(s, d, "documents"), "doc_key", "doc_id").select("doc_id", "unique_key")


@query
def corpus_stats(s, d):
    return tables.corpus_stats(table(s, d, "documents"), table(s, d, "chunks"), table(s, d, "vectors"), table(s, d, "qrels"))


@query
def missing_parents(s, d):
    return tables.missing_parents(table(s, d, "doc_snapshots"), table(s, d, "documents"), "doc_id")


@query
def citation_extract(s, d):
    i = F.col("doc_id")
    meta = F.when(i % 3 == 0, F.concat(F.lit("{&quot;citation&quot;:&quot;"), F.col("citation"), F.lit("&quot;}"))).when(i % 3 == 1, F.lit("{}"))
    return table(s, d, "documents").select("doc_id", files.citation_from_metadata(meta, F.col("title"), F.col("section")).alias("citation"))


@query
def xml_sections(s, d):
    safe = F.replace(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x09\x0A\x20-퟿]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<DIV5 N='1'><HEAD>Part</HEAD><DIV8 N='"), F.col("doc_id"), F.lit("'><HEAD>Head</HEAD><P>"), safe, F.lit("</P></DIV8></DIV5>"))
    source = table(s, d, "documents").select("title", "part", F.lit("").alias("url"), F.encode(body, "utf-8").alias("content"))
    return xml.documents(source).select("doc_id", "section", "heading_path", F.md5("text").alias("text"))
