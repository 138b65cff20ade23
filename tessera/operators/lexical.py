"""Lexical retrieval: query terms and two kinds of BM25."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stem import stem
from tessera.session import cut, spread

K1, B = 1.2, 0.75
#: Different query terms that are listed in the plan, so that other tokens are dropped within their array; that are broadcast for it; terms that travel with one pass of the full-text search.
LISTED_TERMS, BROADCAST_TERMS, PHRASES = 10_000, 1_000_000, 200_000
# The token pattern and the stop words.
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+(?:\.\d+)+|\d+"
STOP = (
    "a an the and or of to in for on at by is are was were be been being as "
    "that this these those it its from with which what when where who whom how "
    "do does did can could shall should may might must will would i you we they "
    "my your our their there here if then than so such not no nor but"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """Tokens of two characters or more without stop words; with them if nothing else is left. Repeats stay."""
    long = F.filter(tokens(query), lambda t: F.length(t) > 1)
    kept = F.filter(long, lambda t: ~t.isin(STOP))
    return F.when(F.size(kept) > 0, kept).otherwise(long)


def match_expression(query: Column) -> Column:
    """The terms as a full-text expression of quoted words, so that operators in the query are plain words."""
    return F.array_join(F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def term_stats(chunks: DataFrame) -> DataFrame:
    """(strategy, term, df, tf) over all chunks; repeated rows count once."""
    rows = chunks.groupBy("strategy", "chunk_id").agg(F.max("text").alias("text"))
    words = rows.select("strategy", "chunk_id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("strategy", "chunk_id", "term").agg(F.count("*").alias("n")).groupBy("strategy", "term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_plain(chunks: DataFrame, queries: DataFrame, k: int = 10, strategy: str = "structured") -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 over the text with whole tokens; statistics are those of the strategy.

    Each different query term counts once. Queries without terms and chunks without text have no rows. Scores are rounded to 6 places and equal
    ones are ordered by chunk. Of a chunk_id with several texts the one with the greatest hash counts.

    Texts are read and tokenised once and never shuffled: of up to LISTED_TERMS query terms, other tokens are dropped where they arise, and only
    what is left of a chunk moves (with more terms, all its tokens do). A row for each chunk and query term in it and one for each chunk's
    length are written to the checkpoint folder.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(query_terms(F.col("query")))).alias("term"))
    terms = asked.select("term").distinct()
    several = [r[0] for r in terms.limit(LISTED_TERMS + 1).collect()]
    listed = ", ".join("'" + t.replace("'", "\\'") + "'" for t in several)  # letters, digits, stops and apostrophes only
    own = F.expr("slice(t, 1, 0)" if not several else "t" if len(several) > LISTED_TERMS else f"filter(t, x -> x IN ({listed}))")
    rows = spread(chunks.filter(F.col("strategy") == strategy).select("chunk_id", "text")).select("chunk_id", F.xxhash64("text").alias("h"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    one = rows.select("chunk_id", "h", F.struct(F.size("t").alias("dl"), own.alias("t")).alias("x")).groupBy("chunk_id").agg(F.max_by("x", "h").alias("x"))
    words = one.select("chunk_id", "x.dl", F.explode(F.array_append("x.t", F.lit(""))).alias("term"))  # "" stands for the chunk itself
    if len(several) > LISTED_TERMS:
        known = terms.unionByName(chunks.sparkSession.createDataFrame([("",)], "term string"))
        words = words.join(F.broadcast(known) if known.count() <= BROADCAST_TERMS else known, "term", "left_semi")
    counted = cut(words.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf")))
    corpus = counted.filter("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = counted.filter("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(corpus)).select(  # one row
        "term", "chunk_id",
        (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("w"),
    )
    return _best(asked.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score")), k)


class _Bare(dict):
    """Code point -> the Latin letter without its diacritics; other characters stay, combining marks fall away. Filled as they are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        self[code] = out = "" if unicodedata.combining(c) else base if base.isascii() else c
        return out


_BARE = _Bare()
#: Letters, digits and private characters.
_WORD = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")
_stem = lru_cache(1 << 17)(stem)


def unicode_words(text: str | None) -> list[str]:
    """Words of letters and digits, lower-cased, without diacritics, stemmed. A word is stemmed once in a worker."""
    if not text:
        return []
    low = text.lower()
    return [_stem(w) for w in _WORD.findall(low if low.isascii() else low.translate(_BARE))]


def bm25_fulltext(chunks: DataFrame, queries: DataFrame, k: int = 10, strategy: str = "structured", heading_weight: float = 1.0) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 with stemming, phrases and two columns, as a full-text index over all strategies.

    Statistics are those of all chunks; the strategy filters afterwards. A token that holds several words ("262.17") is a phrase within one
    column. A repeated query token scores again. The inverse document frequency is at least 1e-6. The different terms of the queries travel with
    the task in blocks of PHRASES; every block is another pass over the chunks. What a pass finds is written to the checkpoint folder.
    """
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "strategy", "heading_path", "text").dropDuplicates(["chunk_id"])
    asked = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    passes: list[DataFrame] = []

    def search(terms: list[str]) -> None:
        phrases: dict[str, list[tuple[str, tuple[str, ...]]]] = defaultdict(list)
        for term in terms:
            if parts := tuple(unicode_words(term)):
                phrases[parts[0]].append((term, parts))
        index = spark.sparkContext.broadcast(dict(phrases))
        sized = not passes  # the first pass also gives the chunks' sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for chunk, kind, *columns in zip(*(c.to_pylist() for c in b.columns)):
                    found: dict[str, float] = defaultdict(float)
                    size = 0
                    for column, weight in zip(columns, (heading_weight, 1.0)):
                        w = unicode_words(column)
                        size += len(w)
                        for i, x in enumerate(w):
                            for term, parts in index.value.get(x, ()):
                                if len(parts) == 1 or tuple(w[i : i + len(parts)]) == parts:
                                    found[term] += weight
                    if sized:
                        out.append((chunk, kind, None, 0.0, size))
                    out += [(chunk, kind, term, f, size) for term, f in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["chunk_id", "strategy", "term", "f", "dl"])

        passes.append(cut(rows.mapInArrow(run, "chunk_id string, strategy string, term string, f double, dl bigint")))

    held: list[str] = []
    for r in asked.select("term").distinct().toLocalIterator():
        held.append(r[0])
        if len(held) == PHRASES:
            search(held)
            held = []
    if held or not passes:
        search(held)
    counted = reduce(DataFrame.unionByName, passes)
    corpus = counted.filter("term IS NULL").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = counted.filter("term IS NOT NULL")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = hits.filter(F.col("strategy") == strategy).join(df, "term").crossJoin(F.broadcast(corpus)).select("term", "chunk_id", score.alias("w"))  # one row
    return _best(asked.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("times")), 9).alias("score")), k)
