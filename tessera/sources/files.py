"""Readers and writers of JSON lines, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = "query_id string, type string, query string"
QRELS = "query_id string, doc_id bigint, grade int, judged_at timestamp_ntz, judged_by string, note string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line under a fixed schema; blank lines are skipped. A missing file raises."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", "false").json(path)


def export_qrels(qrels: DataFrame, path: str) -> None:
    """Judgements as JSON lines, ordered by query and document."""
    write_jsonl(qrels.orderBy("query_id", "doc_id"), path)


def import_qrels(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """``existing`` judgements with those of a file of JSON lines merged in: a human one is only replaced by a later human one."""
    from tessera.operators.evaluation import merged_qrels

    columns = ["query_id", "doc_id", "grade", "judged_by", "judged_at"]
    return merged_qrels(existing.select(*columns).unionByName(read_jsonl(spark, path, QRELS).select(*columns)))


def citation_from_metadata(meta: Column, title: Column, section: Column) -> Column:
    """The citation in escaped JSON metadata, or one made of title and section."""
    plain = F.regexp_replace(F.regexp_replace(meta, "&amp;quot;", '"'), "&quot;", '"')
    return F.coalesce(F.nullif(F.get_json_object(plain, "$.citation"), F.lit("")), F.concat(title, F.lit(" CFR "), section))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def export_static(chunks: DataFrame, vectors: DataFrame, docs: DataFrame, path: str) -> None:
    """Gzipped JSON of documents and chunks, 8-bit vectors as parquet, all by chunk id. Raises if chunks and vectors aren't the same ids."""
    from tessera.operators.dense import quantize

    a, b = chunks.select("chunk_id").distinct(), vectors.select("chunk_id").distinct()
    if not a.join(b, "chunk_id", "left_anti").isEmpty() or not b.join(a, "chunk_id", "left_anti").isEmpty():
        raise ValueError("chunks and vectors differ")
    write_jsonl(docs.select("doc_id", "citation", "heading", "text", "source_url").orderBy("doc_id"), f"{path}/docs", "gzip")
    write_jsonl(chunks.select("chunk_id", "doc_id", "text", "char_start", "char_end").dropDuplicates(["chunk_id"]).orderBy("chunk_id"), f"{path}/chunks", "gzip")
    quantize(vectors, "chunk_id").dropDuplicates(["chunk_id"]).orderBy("chunk_id").write.mode("overwrite").parquet(f"{path}/vectors")


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page of a table in a fixed order."""
    return df.orderBy(*order).offset(offset).limit(size)


def blind(pool: DataFrame, queries: int) -> DataFrame:
    """Judging sheet: the first queries' documents by id, without who found them and where."""
    first = pool.select("query_id").distinct().orderBy("query_id").limit(queries)
    return pool.join(first, "query_id", "left_semi").select("query_id", "doc_id")
