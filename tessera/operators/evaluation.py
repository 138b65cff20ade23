"""Graded-relevance metrics, bootstrap intervals, pooling and threshold calibration, all keyed by configuration and query."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fusion import _decide, features, first_docs, ranked_hits
from tessera.operators.ranking import running_total

SEED, ITERATIONS = 20240901, 1000


def merged_qrels(qrels: DataFrame) -> DataFrame:
    """One judgement for each (query_id, doc_id): the latest human one if there is any, else the latest. Ties: the higher grade."""
    order = Window.partitionBy("query_id", "doc_id").orderBy((F.col("judged_by") == "human").desc_nulls_last(), F.desc_nulls_last("judged_at"), F.desc("grade"), "judged_by")
    return qrels.withColumn("r", F.row_number().over(order)).filter("r = 1").select("query_id", "doc_id", "grade", "judged_by", "judged_at")


def latest_runs(hits: DataFrame) -> DataFrame:
    """(config_name, query_id, doc_id, rank): the documents of each configuration's latest search for each query."""
    ranked = ranked_hits(hits)
    last = Window.partitionBy("config_name", "query_id").orderBy(F.desc("searched_at"), F.desc("search_id"))
    latest = ranked.select("config_name", "query_id", "search_id", "searched_at").distinct().withColumn("r", F.row_number().over(last)).filter("r = 1").select("search_id")
    return first_docs(ranked.join(latest, "search_id"), ["config_name", "query_id"])


def metrics(runs: DataFrame, qrels: DataFrame, recall_at: int = 100, at: int = 10) -> DataFrame:
    """(config_name, query_id, recall, mrr, ndcg), rounded to 6 places; null where the query has no relevant document."""
    judged = runs.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    gain = F.when(F.col("rank") <= at, (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1))
    own = judged.groupBy("config_name", "query_id").agg(
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= recall_at)).alias("found"), F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= at), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = qrels.filter("grade > 0").withColumn("p", place).groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("p") <= at, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("p") + 1))).alias("idcg"))
    known = F.col("relevant").isNotNull()
    return own.join(ideal, "query_id", "left").select(
        "config_name", "query_id",
        F.when(known, F.round(F.col("found") / F.col("relevant"), 6)).alias("recall"), F.when(known, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"), F.when(known, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6)).alias("ndcg"),
    )


def answerable(qrels: DataFrame) -> DataFrame:
    """(query_id, answerable): whether any judged document has a positive grade."""
    return qrels.groupBy("query_id").agg((F.max("grade") > 0).alias("answerable"))


def percentile(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at index min(n - 1, floor(share * n)) of the sorted ones; never between two values. Nulls don't count."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias(name))
    counts = rows.groupBy(*by, name).agg(F.count("*").alias("__c"))  # equal values are one row
    sized = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    placed = running_total(counts, by, [F.col(name)], F.col("__c"), "__before")
    want = F.least(F.col("__n") - 1, F.floor(F.lit(share) * F.col("__n")))
    return placed.join(sized, by).filter((F.col("__before") <= want) & (want < F.col("__before") + F.col("__c"))).select(*by, name)


def hashed_index(iteration: Column, draw: Column, n: Column) -> Column:
    """A place from 0 to n - 1 by the first 15 hexadecimal digits of md5('seed:iteration:draw'), so that places are drawn with replacement."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), iteration.cast("string"), draw.cast("string"))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % n


def bootstrap(values: DataFrame, by: str, item: str, value: str, iterations: int = ITERATIONS, places: Callable[[Column, Column, Column], Column] = hashed_index) -> DataFrame:
    """(by, mean, lo, hi, p_better): 95 % interval of the mean by resampling; p_better: share of means over 0.

    ``places`` gives the place of each (iteration, draw), drawn with replacement. Draws are aggregated as they are made; a group's rows are its queries, whose number is bounded.
    """
    rows = values.filter(F.col(value).isNotNull()).select(by, item, F.col(value).alias("v"))
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(item)) - 1)
    draws = n.filter("n > 1").select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i")).select(by, "n", "i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("d"))
    drawn = draws.select(by, "i", places(F.col("i").cast("bigint"), F.col("d").cast("bigint"), F.col("n")).cast("int").alias("place")).join(placed, [by, "place"])
    means = drawn.groupBy(by, "i").agg(F.round(F.avg("v"), 9).alias("mean"))
    sorted_ = means.groupBy(by).agg(F.sort_array(F.collect_list("mean")).alias("s"), F.avg(F.when(F.col("mean") > 0, 1.0).otherwise(0.0)).alias("p"))
    low, high = int(0.025 * iterations), min(iterations - 1, int(0.975 * iterations))
    return n.join(sorted_, by, "left").select(by, F.round("m", 6).alias("mean"), F.round(F.coalesce(F.get("s", F.lit(low)), F.col("m")), 6).alias("lo"), F.round(F.coalesce(F.get("s", F.lit(high)), F.col("m")), 6).alias("hi"), F.round("p", 6).alias("p_better"))


def paired(deltas: DataFrame, by: str, item: str, value: str, iterations: int = ITERATIONS) -> DataFrame:
    """(by, mean, lo, hi, p_better, significant) of differences between pairs; NaN, and not significant, for less than two pairs."""
    got = bootstrap(deltas, by, item, value, iterations)
    known = F.col("p_better").isNotNull()
    got = got.select(by, *(F.when(known, F.col(c)).otherwise(F.lit(math.nan)).alias(c) for c in ("mean", "lo", "hi", "p_better")))
    return got.withColumn("significant", significant(F.col("lo"), F.col("hi")))


def _resampled_means(values: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """Sorted means of ``iterations`` resamples whose places are the Mersenne Twister's, a row of the matrix each."""
    twister = random.Random(seed)
    places = np.fromiter(map(twister.randrange, repeat(len(values), iterations * len(values))), np.int64).reshape(iterations, -1)
    return np.sort(values[places].mean(axis=1))


def bootstrap_exact(values: list[float], iterations: int = ITERATIONS, level: float = 0.95, seed: int = SEED) -> tuple[float, float, float]:
    """(mean, lo, hi) for a list of one value per query on the driver; NaN without values, the mean alone for a single one."""
    own = np.asarray(values, np.float64)
    if own.size < 2:
        return (float(own[0]),) * 3 if own.size else (math.nan,) * 3
    ordered = _resampled_means(own, iterations, seed)
    tail = (1 - level) / 2
    return float(own.mean()), float(ordered[int(tail * iterations)]), float(ordered[min(iterations - 1, int((1 - tail) * iterations))])


def paired_exact(a: list[float | None], b: list[float | None], iterations: int = ITERATIONS, seed: int = SEED) -> dict[str, float]:
    """delta, lo, hi and p_better of b over a, for pairs where both have a value; NaN for less than two."""
    gains = np.array([(math.nan if v is None else v) for v in b], np.float64) - np.array([(math.nan if v is None else v) for v in a], np.float64)
    gains = gains[~np.isnan(gains)]
    names = ("delta", "lo", "hi", "p_better")
    if gains.size < 2:
        return dict.fromkeys(names, math.nan)
    delta, lo, hi = bootstrap_exact(gains.tolist(), iterations, 0.95, seed)
    return dict(zip(names, (delta, lo, hi, float((_resampled_means(gains, iterations, seed) > 0).mean()))))


def significant(lo: Column, hi: Column) -> Column:
    """Whether the interval leaves out zero; an unknown one doesn't."""
    return F.coalesce(~(F.isnan(lo) | F.isnan(hi)) & ((lo > 0) | (hi < 0)), F.lit(False))


def incremental(scores: DataFrame, order: list[str], value: str = "ndcg") -> DataFrame:
    """(config_name, mean, vs_first, vs_previous) in the order of the configurations; means skip nulls."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("config_name"))
    means = scores.groupBy("config_name").agg(F.avg(value).alias("m")).withColumn("place", place).filter("place > 0")
    w = Window.partitionBy().orderBy("place")  # a row per configuration
    return means.select("config_name", F.round("m", 6).alias("mean"), F.round(F.col("m") - F.first("m").over(w), 6).alias("vs_first"), F.round(F.col("m") - F.lag("m").over(w), 6).alias("vs_previous"))


def verdict(base: Column, significant: Column, gain: Column) -> Column:
    """Whether a configuration earns its place: its gain over the base is significant and positive."""
    return F.when(base, "base").when(F.coalesce(significant & (gain > 0), F.lit(False)), "earns it").otherwise("not shown")


def worst_queries(scores: DataFrame, runs: DataFrame, qrels: DataFrame, limit: int = 10) -> DataFrame:
    """(config_name, query_id, ndcg, wanted, got): the lowest ndcg first; wanted and got are the best and the first three documents."""
    low = scores.filter("ndcg IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("config_name").orderBy("ndcg", "query_id"))).filter(F.col("r") <= limit)
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), F.desc("doc_id"))
    wanted = qrels.filter("grade > 0").withColumn("p", F.row_number().over(best)).filter("p <= 3").groupBy("query_id").agg(_listed("p", "doc_id").alias("wanted"))
    got = runs.filter("rank <= 3").groupBy("config_name", "query_id").agg(_listed("rank", "doc_id").alias("got"))
    return low.join(wanted, "query_id", "left").join(got, ["config_name", "query_id"], "left").select("config_name", "query_id", "ndcg", "wanted", "got")


def _listed(place: str, value: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ",")


def pool(runs: DataFrame, qrels: DataFrame, depth: int = 20) -> DataFrame:
    """(query_id, doc_id, found_by, best_rank, place): unjudged documents that any configuration has within ``depth``; those found by fewest first."""
    seen = runs.filter(F.col("rank") <= depth).groupBy("query_id", "doc_id").agg(F.array_join(F.sort_array(F.collect_set("config_name")), ",").alias("found_by"), F.countDistinct("config_name").alias("n"), F.min("rank").alias("best_rank"))
    left = seen.join(qrels, ["query_id", "doc_id"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "best_rank", "doc_id"))).drop("n")


def sweep(reranked: DataFrame, searches: DataFrame, qrels: DataFrame) -> DataFrame:
    """(amb, tau, coverage, accuracy, false_abstain, refusal): the gate at tau 0, 0.05 .. 1, without and with the ambiguity rule."""
    first = reranked.filter("final_rank = 1").select("search_id", "doc_id")
    graded = searches.select("search_id", "query_id").distinct().join(answerable(qrels), "query_id").join(first, "search_id", "left").join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    records = features(reranked, searches).join(graded.select("search_id", "answerable", F.coalesce(F.col("grade") > 0, F.lit(False)).alias("ok")), "search_id")
    grid = records.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("amb", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("tau", F.col("i") / 20.0)
    decided = grid.select("amb", "tau", "answerable", "ok", _decide(F.col("tau"), F.col("amb") == 1)[0])
    answered, known = ~F.col("abstain"), F.col("answerable")
    rate = lambda c, of: F.round(F.count_if(c) / F.nullif(F.count_if(of), F.lit(0)), 6)
    return decided.groupBy("amb", "tau").agg(
        F.round(F.count_if(answered) / F.count("*"), 6).alias("coverage"), rate(answered & known & F.col("ok"), answered & known).alias("accuracy"), rate(F.col("abstain") & known, known).alias("false_abstain"), rate(F.col("abstain") & ~known, ~known).alias("refusal"),
    )


def best_threshold(swept: DataFrame, accuracy: float = 0.90, false_abstain: float = 0.05) -> DataFrame:
    """The best eligible row of a sweep: refusal, then few false abstentions, coverage; of equal ones without ambiguity, then the greater tau."""
    fit = swept.filter((F.col("accuracy") >= accuracy) & (F.col("false_abstain") <= false_abstain) & F.col("refusal").isNotNull())
    return fit.orderBy(F.desc("refusal"), "false_abstain", F.desc("coverage"), "amb", F.desc("tau"), F.desc("accuracy")).limit(1)


def rewrite_verdict(records: DataFrame, tau: Column) -> DataFrame:
    """Adds ``verdict`` to records (conf, conf2, ndcg, ndcg2, answerable): what a rewritten query did to the gate and the ranking."""
    crossed = (F.col("conf") < tau) & (F.col("conf2") >= tau)
    return records.withColumn("verdict", F.when(crossed & ~F.col("answerable"), "HARMFUL").when(crossed & (F.coalesce("ndcg2", F.lit(0.0)) > 0), "rescued").when(F.col("ndcg2") > F.col("ndcg") + 1e-9, "improved").otherwise("no change"))


def guard_sweep(judged: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.75, 0.8)) -> DataFrame:
    """(threshold, blocked, lost, survivors) over records with verdict and sim: harmful rewrites that a guard on similarity blocks, good ones it loses."""
    grid = judged.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    harmful, below = F.col("verdict") == "HARMFUL", F.col("sim") < F.col("threshold")
    return grid.groupBy("threshold").agg(F.count_if(harmful & below).alias("blocked"), F.count_if(F.col("verdict").isin("rescued", "improved") & below).alias("lost"), F.count_if(harmful & ~below).alias("survivors"))


def agreement(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(pairs, same_top, same_status) of two systems' results (by, top, status)."""
    both = a.select(by, F.col("top").alias("ta"), F.col("status").alias("sa")).join(b.select(by, F.col("top").alias("tb"), F.col("status").alias("sb")), by)
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("ta") == F.col("tb")).alias("same_top"), F.count_if(F.col("sa") == F.col("sb")).alias("same_status"))
