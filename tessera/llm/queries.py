"""Queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canon, encode, leak, neardup, neighbours, rank, repeat, split, terms
from tessera.session import cut, table

HIGHER, LOWER = ["score", "rerank_score"], ["lexical_rank", "dense_rank"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "documents"), "doc_id").select("doc_id", "char_start", "char_end")


def p1_balanced(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "documents"), "doc_id", keep=("heading_path",), lookahead=1.0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fused = rank.fuse_scores(table(spark, d, "hits"), "search_id", "chunk_id", HIGHER, LOWER)
    return rank.undisputed_first(cut(fused), "search_id", "chunk_id", HIGHER + LOWER)


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    fused = rank.fuse_scores(table(spark, d, "hits"), "search_id", "chunk_id", HIGHER, LOWER)
    return fused.select("search_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "fused_rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "vectors"), ["strategy", "model"])
    return near.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "chunks"), gram=3, threshold=0.7, least=20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expanded(*_near(spark, d)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_near(spark, d)).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    chunks = table(spark, d, "chunks").filter("strategy = 'structured'")
    counts = terms.term_counts(chunks, ["chunk_id", "doc_id"], least=3)
    announced = terms.term_counts(documents.select("doc_id", "heading"), ["doc_id"], "heading").select("doc_id", "term")
    own = counts.join(announced, ["doc_id", "term"])
    weighed = terms.weights(own, terms.term_spread(documents, "doc_id"), ["chunk_id"])
    # five records spread a term's entropy to ln 5 at most, so a lower weight can't belong to a rare term
    rare = weighed.filter(F.col("global_weight") >= 1 - F.log(F.lit(5.0)) / F.log(F.col("n")) - 1e-9)
    return rare.filter("df BETWEEN 1 AND 5 AND length(term) >= 4").filter(F.col("term").rlike(r"^\p{L}+$")).select("chunk_id", "term").distinct()


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weights of all terms of all structured chunks, summed up for each chunk with its most distinctive term."""
    counts = terms.term_counts(table(spark, d, "chunks").filter("strategy = 'structured'"), ["chunk_id"])
    weighed = terms.weights(counts, terms.term_spread(table(spark, d, "documents"), "doc_id"), ["chunk_id"])
    return weighed.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 4).alias("most"))


def _look_alike(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("k"), "text")
    chunks = table(spark, d, "chunks").filter("strategy = 'structured'").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("k"), "text")
    return canon.look_alike_classes(documents.unionByName(chunks), ["table_name", "k"], within="table_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = cut(_look_alike(spark, d).select("table_name", "class_id", "raw", "k", F.expr("try_cast(k AS bigint)").alias("n")))
    pairs = found.alias("x").join(found.alias("y"), ["table_name", "class_id"]).filter("x.raw <> y.raw")
    pairs = pairs.filter("CASE WHEN table_name = 'documents' THEN x.n < y.n ELSE x.k < y.k END")
    return pairs.select("table_name", F.col("x.k").alias("key_a"), F.col("y.k").alias("key_b"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, key, class_id): a row for each text that looks the same as another, different one; copies are not multiplied out."""
    return _look_alike(spark, d).select("table_name", F.col("k").alias("key"), "class_id")


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """A hash of every document's text in its one form."""
    return canon.canonical_texts(table(spark, d, "documents"), "doc_id").select("doc_id", F.sha2("form", 256).alias("form"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id")


def p8_reuse(spark: SparkSession, d: str) -> DataFrame:
    return encode.chunk_reuse(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    scored = repeat.repetition(table(spark, d, "documents"), "doc_id")
    return scored.filter(F.col("candidate") & (F.col("share") >= repeat.LEAST_SHARE)).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeat.shares(table(spark, d, "documents"), "doc_id").select("doc_id", "words", F.round("share", 9).alias("share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_balanced, p2_found, p2_ranking, p3_found, p4_found, p4_groups, p5_found, p5_weights, p7_found, p7_classes, p7_forms, p8_ids, p8_reuse, p9_found, p10_found, p10_shares)
}
