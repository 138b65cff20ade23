"""Keeping tables: upserts, duplicate ids, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import rank_in_groups


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str], insert_only: list[str]) -> DataFrame:
    """Rows of ``old`` with ``update`` taken from ``new`` where the key is in both, and the new keys with all columns."""
    o, n = old.alias("o"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    taken = [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in update]
    kept = [F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in insert_only]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *kept, *taken)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, or none. The condition reaches the scan, where row groups are skipped by their statistics."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def suffix_duplicates(df: DataFrame, key: str, order: str, name: str = "unique_key") -> DataFrame:
    """Adds ``name``: the key, with ~1, ~2 and so on for its repeats in the order of a unique number. Null keys stay null."""
    numbered = rank_in_groups(df.withColumn("__at", -F.col(order)), [key], "__at", "__n", ties=[order])
    return numbered.withColumn(name, F.when(F.col("__n") > 1, F.concat(F.col(key), F.lit("~"), F.col("__n") - 1)).otherwise(F.col(key))).drop("__at", "__n")


def replace_strategy(spark_path_df: DataFrame, path: str) -> None:
    """Write chunks (or vectors) so that the strategies in the frame replace theirs in the table, and others stay."""
    spark_path_df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def corpus_stats(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, qrels: DataFrame) -> DataFrame:
    """(strategy, chunks, vectors, documents, characters, judged_queries): a row per strategy with the corpus's totals."""
    own = chunks.groupBy("strategy").agg(F.countDistinct("chunk_id").alias("chunks"))
    vec = vectors.groupBy("strategy").agg(F.countDistinct("chunk_id").alias("vectors"))
    whole = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters")).crossJoin(qrels.agg(F.countDistinct("query_id").alias("judged_queries")))
    return own.join(vec, "strategy", "left").crossJoin(F.broadcast(whole)).select("strategy", "chunks", F.coalesce("vectors", F.lit(0)).alias("vectors"), "documents", "characters", "judged_queries")  # one row


def missing_parents(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of the child table that the parent lacks; what a foreign key would have refused."""
    return child.select(key).filter(F.col(key).isNotNull()).distinct().join(parent.select(key), key, "left_anti")
