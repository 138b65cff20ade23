"""Dense retrieval: normalised vectors, exhaustive cosine top-k in blocks, 8-bit quantisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors that travel with one pass over the collection.
BLOCK = 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector as doubles; the norm is floored so that a zero vector stays zero. Null stays null."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, query_id: str = "query_id", item: str = "item", vec: str = "vec", dim: int = 64, within: str | None = None) -> DataFrame:
    """(query_id, item, score, rank): the exact best k by cosine, rounded to 6 places, equal scores by item.

    ``within``: a string column of both tables, such as the model's name; only items that have the query's value are looked at.

    Queries are taken in blocks of BLOCK; each block goes over the collection once as a matrix product, and every task keeps only its own best
    k of each query before the shuffle. Null vectors, vectors of another length and zero vectors take no part.
    """
    spark = vectors.sparkSession
    part = F.col(within) if within else F.lit("")
    rows = vectors.filter((F.size(vec) == dim) & part.isNotNull()).select(item, vec, part.alias("__part"))
    kinds = [queries.schema[query_id].dataType, vectors.schema[item].dataType]
    schema = f"`{query_id}` {kinds[0].simpleString()}, `{item}` {kinds[1].simpleString()}, score double"
    types = [to_arrow_type(k) for k in kinds]
    parts: list[DataFrame] = []

    def scan_for(ids: list, own: list, parts_of: list) -> None:
        q = np.array(own, np.float64).reshape(-1, dim)
        size = np.linalg.norm(q, axis=1)
        held = spark.sparkContext.broadcast(([i for i, s in zip(ids, size) if s > 0], q[size > 0] / size[size > 0][:, None], np.array(parts_of)[size > 0]))  # BLOCK vectors at most

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, part_of = held.value
            row, name, score = np.zeros(0, np.int64), None, np.zeros(0)
            floor = np.full(len(names), -np.inf)
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                size = np.linalg.norm(x, axis=1)
                ok = size > 0
                items = np.array(b.column(0).to_pylist())[ok]
                if not len(names) or not len(items):
                    continue
                s = np.round(q @ (x[ok] / size[ok][:, None]).T, 6)
                if within:
                    s[part_of[:, None] != np.array(b.column(2).to_pylist())[ok][None, :]] = -np.inf
                # what is below the best k so far, or below this batch's own k-th, is out; ties stay until ids can decide
                least = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, -k]) if s.shape[1] > k else floor
                r, c = np.nonzero((s >= least[:, None]) & (s > -2))
                row, score = np.concatenate([row, r]), np.concatenate([score, s[r, c]])
                name = items[c] if name is None else np.concatenate([name, items[c]])
                order = np.lexsort((name, -score, row))
                row, score, name = row[order], score[order], name[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, score, name = row[best], score[best], name[best]
                full = np.flatnonzero(np.bincount(row, minlength=len(names)) == k)
                floor[full] = score[np.searchsorted(row, full, side="right") - 1]
            columns = [[names[r] for r in row], [] if name is None else name.tolist(), score]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), pa.array(columns[2], pa.float64())], names=[query_id, item, "score"])

        parts.append(rows.mapInArrow(scan, schema))

    held: list[tuple] = []
    for r in queries.filter((F.size(vec) == dim) & part.isNotNull()).select(query_id, vec, part).toLocalIterator():
        held.append(tuple(r))
        if len(held) == BLOCK:
            scan_for(*map(list, zip(*held)))
            held = []
    if held or not parts:
        scan_for(*(map(list, zip(*held)) if held else ([], [], [])))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), item)
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def quantize(vectors: DataFrame, item: str, vec: str = "vec") -> DataFrame:
    """(item, q): 8-bit integers under one scale for the whole collection, 127 over the greatest absolute value, half to even."""
    most = vectors.agg(F.max(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))).alias("m"))
    whole = lambda x: F.least(F.greatest(F.rint(x.cast("double") * 127.0 / F.col("m")), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")
    return vectors.crossJoin(F.broadcast(most)).select(item, F.transform(vec, whole).alias("q"))  # one row


def pending_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(chunk_id): chunks that have no vector of the model yet; what an incremental embedding run has to do."""
    return chunks.select("chunk_id").distinct().join(vectors.filter(F.col("model") == model), "chunk_id", "left_anti")


def embed_pending(chunks: DataFrame, vectors: DataFrame, model: str, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """(chunk_id, strategy, model, dim, vec) of the chunks that have no vector of the model yet, ready to be appended; a second run finds nothing to do.

    ``embed`` makes a vector of a text column: built-in functions, or any pandas function that calls a model batch by batch. Of a repeated
    chunk_id the greatest text counts; only pending chunks are embedded.
    """
    due = chunks.join(pending_vectors(chunks, vectors, model), "chunk_id", "left_semi").groupBy("chunk_id", "strategy").agg(F.max(text).alias("__text"))
    made = due.select("chunk_id", "strategy", F.lit(model).alias("model"), embed(F.col("__text")).alias("vec"))
    return made.select("chunk_id", "strategy", "model", F.size("vec").alias("dim"), "vec")


def faithfulness(a: Column, b: Column) -> Column:
    """How close a rewritten query's vector stays to the first one's: their cosine. Vectors need not be normalised."""
    return dot(normalize(a), normalize(b))


def hashing_embedder(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of word hashes, by built-in functions."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+")
    add = lambda v, w: F.transform(v, lambda x, i: F.when(i == F.pmod(F.xxhash64(w), F.lit(dim)), x + F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(x))
    return F.aggregate(F.filter(words, lambda w: w != ""), F.array_repeat(F.lit(0.0), dim), add)


def canary(vector: Column, reference: list[float], least: float = 0.99) -> Column:
    """Whether a freshly made vector still agrees with a stored one; a changed model shows here first."""
    return cosine(vector, F.array(*map(F.lit, reference))) > least
