"""Fusion, shortlists, reranking and abstention over rankings keyed by query or search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_in_groups

RRF_K, TEMPERATURE = 60, 4.0
TAU, BAND, SPREAD, LEAST_DOCS, REVIEW = 0.20, 0.15, 0.05, 3, 0.15


def reciprocal_rank_fusion(rankings: list[DataFrame], by: str, item: str = "chunk_id", k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(by, item, score, rank) from rankings with a 1-based rank; scores rounded to 9 places, equal ones by item."""
    weights = weights or [1.0] * len(rankings)
    if not rankings or len(weights) != len(rankings):
        raise ValueError("one weight for each of at least one ranking")
    parts = [r.select(by, item, (F.lit(w) / (k + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return rank_in_groups(both.groupBy(by, item).agg(F.round(F.sum("part"), 9).alias("score")), [by], "score", "rank", ties=[item])


def combined(rankings: list[DataFrame], by: str, item: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(by, item, score, rank): a single ranking passes as it is, with the negative rank as its score; several are fused."""
    if len(rankings) != 1:
        return reciprocal_rank_fusion(rankings, by, item, k)
    own = rankings[0].groupBy(by, item).agg((-F.min("rank")).cast("double").alias("score"))
    return rank_in_groups(own, [by], "score", "rank", ties=[item])


def describe(strategy: Column, lexical: Column, dense: Column, reranked: Column) -> Column:
    """A configuration in words: strategy, retriever and whether it reranks."""
    by = F.when(lexical & dense, "hybrid(rrf)").when(lexical, "bm25").when(dense, "dense").otherwise("none")
    return F.concat(strategy, F.lit(" / "), by, F.lit(" / rerank="), reranked.cast("string"))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Exact repeats of hits removed."""
    return hits.distinct()


def ranked_hits(hits: DataFrame, by: str = "search_id") -> DataFrame:
    """Hits with their rank in the search by score; nulls last, equal scores by chunk."""
    rows = distinct_hits(hits).withColumn("__score", F.coalesce("score", F.lit(float("-inf"))))
    return rank_in_groups(rows, [by], "__score", "rank", ties=["chunk_id"]).drop("__score")


def confidence(logit: Column, temperature: float = TEMPERATURE) -> Column:
    """Sigmoid of the logit over the temperature; stays in (0, 1) for any logit."""
    return 1 / (1 + F.exp(-logit / max(temperature, 1e-6)))


def rerank(hits: DataFrame, depth: int = 50, final: int = 8, by: str = "search_id") -> DataFrame:
    """The best ``depth`` hits by score, ordered anew by confidence (ties keep their order, null last), cut to ``final``."""
    short = ranked_hits(hits, by).filter(F.col("rank") <= depth).withColumn("confidence", F.round(confidence(F.col("rerank_logit")), 6))
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last("confidence"), "rank")
    return short.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= final)


def overlap_score(query_terms: Column, passage_terms: Column) -> Column:
    """A deterministic stand-in for a pair scorer: the share of the query's terms that the passage has, as a logit in -6..6."""
    share = F.size(F.array_intersect(query_terms, passage_terms)) / F.greatest(F.size(F.array_distinct(query_terms)), F.lit(1))
    return F.round(share * 12 - 6, 6)


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str = "query", passage: str = "passage", most_chars: int = 0) -> DataFrame:
    """Adds ``logit`` from any vectorised pair scorer; passages are cut to ``most_chars`` first unless it is 0."""
    cut = F.substring(passage, 1, most_chars) if most_chars else F.col(passage)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            yield scorer(q, p).astype("float64")

    return pairs.withColumn("logit", score(F.col(query), cut))


def hydrate(ranked: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts and headings for a shortlist, joined after the ranking so that only its rows carry them; unknown ids fall away."""
    body = chunks.select("chunk_id", "char_start", "char_end", "text").dropDuplicates(["chunk_id"])
    return ranked.join(body, "chunk_id").join(docs.select("doc_id", "heading", "citation"), "doc_id")


def first_docs(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by, doc_id, rank): each document once, at its best place."""
    best = ranked.groupBy(*by, "doc_id").agg((-F.min("rank")).alias("__first"))
    return rank_in_groups(best, by, "__first", "rank", ties=["doc_id"]).drop("__first")


def gate(reranked: DataFrame, searches: DataFrame, tau: Column | float = TAU, ambiguity: Column | bool = False, by: str = "search_id") -> DataFrame:
    """(by, top, abstain, reason, needs_review) for every search, also for those without hits.

    In this order: no hits; no confidence on the best hit (not abstained); best below tau; with ``ambiguity`` on, at least four
    hits, the best within BAND of tau, less than SPREAD above the median of the first five, and LEAST_DOCS documents among these.
    """
    own = features(reranked, searches, by)
    tau = F.lit(tau) if not isinstance(tau, Column) else tau
    on = F.lit(ambiguity) if not isinstance(ambiguity, Column) else ambiguity
    return own.select(by, F.coalesce("top", F.lit(0.0)).alias("top"), *_decide(tau, on))


def features(reranked: DataFrame, searches: DataFrame, by: str = "search_id") -> DataFrame:
    """What the gate looks at, a row per search: n, top, median (upper) of the first five, docs among them."""
    five = F.col("final_rank") <= 5
    rows = reranked.groupBy(by).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("final_rank") == 1, F.col("confidence"))).alias("top"),
        F.sort_array(F.collect_list(F.when(five, F.coalesce("confidence", F.lit(0.0))))).alias("s"), F.countDistinct(F.when(five, F.col("doc_id"))).alias("docs"),
    )
    return searches.select(by).distinct().join(rows, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), "top", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"), "docs")


def _decide(tau: Column, on: Column) -> list[Column]:
    ambiguous = on & (F.col("n") >= 4) & (F.col("top") < tau + BAND) & (F.col("top") - F.col("median") < SPREAD) & (F.col("docs") >= LEAST_DOCS)
    reason = F.when(F.col("n") == 0, "no_results").when(F.col("top").isNull(), "no_confidence_signal").when(F.col("top") < tau, "low_confidence").when(ambiguous, "ambiguous").otherwise("")
    return [reason.isin("no_results", "low_confidence", "ambiguous").alias("abstain"), reason.alias("reason"), F.coalesce(F.col("top") < tau + REVIEW, F.lit(False)).alias("needs_review")]
