"""How distinctive a term is of a record: log-entropy weights from two SQL aggregations.

weight(term, record) = ln(1 + tf) * (1 - H(term) / ln(N)), where H is the entropy of the term's spread over the N records of
the collection. With p = tf / gf for each record, H = ln(gf) - sum(tf ln tf) / gf, so one aggregation by (record, term)
and one by term are enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import SEPARATOR_SQL


def _counted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf). The texts are shuffled once, by key and after copies are combined; all words of a record then lie in one
    task, so that counting them needs no exchange of the far larger set of words."""
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max(F.col(text)).alias("__text"))
    words = rows.select(*keys, F.explode(F.split(F.lower("__text"), SEPARATOR_SQL)).alias("term")).filter("term <> ''")
    return words.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def term_counts(df: DataFrame, keys: list[str], text: str = "text", least: int = 1) -> DataFrame:
    """(keys, term, tf): how often each word occurs in the record's text, if at least ``least`` times.

    Null and empty texts give no row. Repeated rows count once; if a key's rows differ, the greatest text counts. Rows with a
    null key are left out.
    """
    return _counted(df, keys, text).filter(F.col("tf") >= least)


def term_spread(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, gf, global_weight, n) over the whole collection; n is the number of its records.

    global_weight is 1 for a term of a single record and 0 for one spread evenly over all. Records with a null text don't
    count, those with an empty one do. In a collection of one record all weights are 1.
    """
    n = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).agg(F.countDistinct(key).alias("n"))
    by_term = _counted(df, [key], text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log("tf")).alias("tlogt"))
    entropy = F.log("gf") - F.col("tlogt") / F.col("gf")
    weight = F.when(F.col("n") > 1, 1 - entropy / F.log("n")).otherwise(F.lit(1.0))
    return by_term.crossJoin(F.broadcast(n)).select("term", "df", "gf", weight.alias("global_weight"), "n")  # n is a single row


def weights(counts: DataFrame, spread: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf, df, n, weight, global_weight): a row for each counted term that the collection has.

    A term may be very frequent, so its rows may be many: the join is by term, and adaptive execution splits large partitions.
    """
    return counts.join(spread, "term").select(*keys, "term", "tf", "df", "n", (F.log1p("tf") * F.col("global_weight")).alias("weight"), "global_weight")
