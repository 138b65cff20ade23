"""What stands around an answer: caches, budgets, prompts, rate limits, input guards; for whole tables of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import running_total

DAILY, CACHE_COSINE, MOST_K = 500, 0.97, 20
#: Tokens and refill a second of the search and of the far dearer answer requests.
CAPACITY, REFILL = 60.0, 1.0
ANSWER_CAPACITY, ANSWER_REFILL = 8.0, 0.05


def query_key(query: Column) -> Column:
    """Key of the exact cache: hash of the trimmed, lower-cased query."""
    return F.sha2(F.lower(F.trim(query)), 256)


def exact_cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(request_id, cached_id): the first cached entry whose query has the same key."""
    entries = cache.select(query_key(F.col("query")).alias("key"), "cached_id").groupBy("key").agg(F.min("cached_id").alias("cached_id"))
    return requests.select("request_id", query_key(F.col("query")).alias("key")).join(entries, "key").select("request_id", "cached_id")


def daily_budget(calls: DataFrame, limit: int = DAILY, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(day, used, remaining, refused): calls by UTC day against the limit. Only counts are shuffled."""
    days = calls.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", F.least("n", F.lit(limit)).alias("used"), F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).alias("remaining"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def admitted(calls: DataFrame, limit: int = DAILY, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(key, day, allowed): each call in time order against its UTC day's budget; equal times by key. Calls without a time are left out.

    A day may hold most calls; its order is then worked out in ranges.
    """
    rows = calls.filter(F.col(ts).isNotNull()).select(key, ts, F.to_date(ts).alias("day"))
    before = running_total(rows, ["day"], [F.col(ts), F.col(key)], F.lit(1), "__before")
    return before.select(key, "day", (F.col("__before") < limit).alias("allowed"))


def prompts(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, prompt) from hydrated hits with ``rank`` and ``query``: numbered sources, then the question. Hits are a shortlist."""
    source = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("citation", F.lit("")), F.lit(" - "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = hits.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", source.alias("s")))).alias("all"), F.max("query").alias("query"))
    return rows.select(by, F.concat(F.array_join(F.transform("all", lambda x: x["s"]), "\n\n---\n\n"), F.lit("\n\nQuestion: "), F.coalesce("query", F.lit(""))).alias("prompt"))


def guard(query: Column, strategy: Column) -> Column:
    """Status of a request: blank, too long, unknown strategy, or ok."""
    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", 400).when(F.length(query) > 500, 413)
        .when(~F.coalesce(strategy, F.lit("")).isin("fixed", "section", "structured", "contextual"), 400).otherwise(200)
    )


def served_k(k: Column, most: int = MOST_K) -> Column:
    """How many results are served: what was asked for, ``most`` at most."""
    return F.least(k, F.lit(most))


def grade_guard(grade: Column) -> Column:
    """Status of a judgement: ok for the grades 0 to 3, else, and for null, refused."""
    return F.when(grade.between(0, 3), 200).otherwise(400)


def cache_put(cache: DataFrame, entries: DataFrame, payload: list[str], at: str, ties: str) -> DataFrame:
    """(key, *payload, at): the cache with the entries (query, *payload, at) put in. Of one key the newest stays, of equally new ones the one
    with the greatest ``ties``. Only the newest of each key in a task is shuffled."""
    fresh = entries.select(query_key(F.col("query")).alias("key"), *payload, at)
    both = cache.select("key", *payload, at).unionByName(fresh).filter(F.col("key").isNotNull())
    newest = both.groupBy("key").agg(F.max_by(F.struct(*payload, at), F.struct(F.col(at), F.col(ties))).alias("m"))
    return newest.select("key", *(F.col(f"m.{c}").alias(c) for c in payload), F.col(f"m.{at}").alias(at))


def client_key(forwarded: Column, host: Column) -> Column:
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), host, F.lit("unknown"))


def retry_after(wait: Column) -> Column:
    """Seconds to wait in full; a day for an endless or unknown wait."""
    endless = wait.isNull() | F.isnan(wait) | (wait == float("inf"))
    return F.when(endless, F.lit(86400.0)).otherwise(F.round(wait, 1))


class Bucket:
    """Tokens of one key. Starts full; refills with time; a request takes ``cost`` if there is enough."""

    def __init__(self, capacity: float = CAPACITY, refill: float = REFILL, tokens: float | None = None, at: float | None = None):
        self.capacity, self.refill, self.tokens, self.at = capacity, refill, capacity if tokens is None else tokens, at

    def take(self, now: float, cost: float = 1.0) -> tuple[bool, float]:
        if self.at is not None:
            self.tokens = min(self.capacity, self.tokens + max(0.0, now - self.at) * self.refill)
        self.at = now
        if self.tokens >= cost:
            self.tokens -= cost
            return True, 0.0
        return False, (cost - self.tokens) / self.refill if self.refill > 0 else float("inf")


def token_bucket(requests: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """(order, key, allowed, wait): every request in time order against its key's bucket. Rows with a null key or time are left out.

    A task streams over its keys' sorted rows and holds one bucket at a time, so a key of any size needs no more memory.
    """
    rows = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(order).alias("o"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bucket = None, Bucket(capacity, refill)
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != current:
                    current, bucket = k, Bucket(capacity, refill)
                out.append(bucket.take(t))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([a for a, _ in out], pa.bool_()), pa.array([w for _, w in out], pa.float64())], names=[order, key, "allowed", "wait"])

    return rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInArrow(run, f"`{order}` {kinds[2]}, `{key}` {kinds[0]}, allowed boolean, wait double")
