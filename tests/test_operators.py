import datetime as dt
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, dense, evaluation, filters, fusion, lexical, quotes, ranking, serving, snapshots, tables
from tessera.plans.core_queries import QUERIES, rewrites
from tessera.sources import files, xml

FILLER = "The operator must keep the record at the site. " * 40
DOC = f"Conditions\n\nA generator may keep waste for 90 days.\n\nIt must be labelled.\n\n{FILLER.strip()}\n\n  Last part, short."


# --- chunks


@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
@pytest.mark.parametrize("text", [DOC, "x" * 3000, "", None, "   ", " lead " + DOC, "a\n\n\n\nb"])
def test_chunks_slice_their_document(spark, strategy, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = chunking.build_chunks(docs, strategy).collect()
    assert bool(rows) == bool(text)
    for r in rows:
        assert text[r.char_start : r.char_end] == r.text == r.text.strip()
        assert strategy == "section" or len(r.text) <= chunking.TARGET


def test_fixed_windows_of_unbroken_text():
    assert chunking.fixed("x" * 3000) == [(0, 1400), (1200, 2600), (2400, 3000)]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunking.build_chunks(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "other")


def test_context(spark):
    row = spark.sql("SELECT 'Title 1 > Part 2 > H' AS p, 'H' AS h").select(chunking.context_of(F.col("p"), F.col("h")), chunking.context_of(F.lit("H"), F.col("h"))).first()
    assert row[0] == "Title 1 Part 2. H" and row[1] == ". H"


# --- lexical

HOSTILE = ['say "x"', "NEAR AND OR NOT", "262.17*", "-x", "^2", "(unbalanced", "'; DROP TABLE a; --", "   ", "???", "\\", None]


def test_hostile_queries(spark):
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(HOSTILE)], "query_id string, query string")
    c = spark.createDataFrame([("a", "structured", "H", "See 262.17 on near misses"), ("b", "structured", None, None), ("c", "fixed", "H", "262.17")], "chunk_id string, strategy string, heading_path string, text string")
    for mode in (lexical.bm25_plain, lexical.bm25_fulltext):
        rows = mode(c, q).collect()
        assert ("2", "a") in {(r.query_id, r.chunk_id) for r in rows}
        assert {r.chunk_id for r in rows} == {"a"}


def test_terms(spark):
    rows = spark.createDataFrame([("What is the employer's 262.17 duty",), ("the of and",), ("a b",)], "q string").select(lexical.query_terms(F.col("q")).alias("t")).collect()
    assert [r.t for r in rows] == [["employer's", "262.17", "duty"], ["the", "of", "and"], []]


def test_fulltext_against_sqlite(spark, data):
    chunks = spark.read.parquet(f"{data}/chunks.parquet").dropDuplicates(["chunk_id"])
    queries = spark.read.parquet(f"{data}/queries.parquet").filter("query_id < 'q040'")
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(chunk_id UNINDEXED, strategy UNINDEXED, heading_path, text, tokenize='porter unicode61')")
    c.executemany("INSERT INTO f VALUES (?,?,?,?)", [tuple(r) for r in chunks.select("chunk_id", "strategy", "heading_path", "text").collect()])
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_fulltext(chunks, queries, k=5).collect()}
    expressions = queries.select("query_id", lexical.match_expression(F.col("query")).alias("e")).collect()
    near = total = 0
    for qid, e in expressions:
        want = c.execute("SELECT chunk_id, -bm25(f) FROM f WHERE f MATCH ? AND strategy = 'structured' ORDER BY 2 DESC LIMIT 5", (e,)).fetchall() if e else []
        for chunk, score in want:
            total += 1
            near += math.isclose(got.get((qid, chunk), -1), score, rel_tol=5e-3)
    assert total > 100 and near >= 0.97 * total  # words of mixed scripts stem apart


# --- fusion and gate


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "q string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "c", 1), ("q", "a", 2), ("q", "d", 3)], "q string, chunk_id string, rank int")
    got = {r.chunk_id: (r.rank, r.score) for r in fusion.reciprocal_rank_fusion([a, b], "q").collect()}
    assert got == {"a": (1, 0.032522475), "c": (2, 0.032266458), "b": (3, 0.016129032), "d": (4, 0.015873016)}
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([a], "q", weights=[1.0, 2.0])


def test_confidence(spark):
    df = spark.createDataFrame([(x,) for x in (-11.0, -4.0, -0.5, 0.0, 2.5, 8.8, 10.0, 1e6, -1e6)], "x double")
    got = [r[0] for r in df.select(F.round(fusion.confidence(F.col("x")), 6)).collect()]
    assert got == [0.060087, 0.268941, 0.468791, 0.5, 0.651355, 0.90025, 0.924142, 1.0, 0.0]


def test_gate(spark):
    rows = [(1, i + 1, c, i) for i, c in enumerate([0.30, 0.295, 0.29, 0.285, 0.28])] + [(2, 1, 0.1, 1), (3, 1, None, 1), (4, 1, 0.9, 1)]
    r = spark.createDataFrame(rows, "search_id int, final_rank int, confidence double, doc_id int")
    s = spark.createDataFrame([(i,) for i in range(1, 6)], "search_id int")
    off = {x.search_id: (x.abstain, x.reason) for x in fusion.gate(r, s).collect()}
    assert off == {1: (False, ""), 2: (True, "low_confidence"), 3: (False, "no_confidence_signal"), 4: (False, ""), 5: (True, "no_results")}
    assert {x.search_id: x.reason for x in fusion.gate(r, s, ambiguity=True).collect()}[1] == "ambiguous"


# --- evaluation


def test_metrics_by_hand(spark):
    runs = spark.createDataFrame([("c", "q", d, i + 1) for i, d in enumerate([1, 2, 3])] + [("c", "z", 1, 1)], "config_name string, query_id string, doc_id bigint, rank int")
    qrels = spark.createDataFrame([("q", 1, 3), ("q", 2, 0), ("q", 3, 1), ("z", 1, 0)], "query_id string, doc_id bigint, grade int")
    got = {r.query_id: (r.recall, r.mrr, r.ndcg) for r in evaluation.metrics(runs, qrels).collect()}
    assert got == {"q": (1.0, 1.0, 0.982842), "z": (None, None, None)}


def test_bootstrap():
    mean, lo, hi = evaluation.bootstrap_exact([0.5, 0.6, 0.7, 0.8, 0.9] * 10, 500)
    assert (round(mean, 3), round(lo, 3), round(hi, 3)) == (0.7, 0.666, 0.742)
    assert [round(x, 2) for x in evaluation.bootstrap_exact([0.2, 0.4, 0.9, 1, 0])] == [0.5, 0.16, 0.84]
    assert evaluation.bootstrap_exact([0.3]) == (0.3, 0.3, 0.3) and math.isnan(evaluation.bootstrap_exact([])[0])
    assert math.isnan(evaluation.paired_exact([1.0], [None])["delta"])


def test_bootstrap_width(spark):
    rng = random.Random(5)
    values = {f"n{n}": [rng.random() for _ in range(n)] for n in (2, 40, 120, 1000)} | {"one": [0.4]}
    df = spark.createDataFrame([(g, i, v) for g, own in values.items() for i, v in enumerate(own)], "g string, item int, v double")
    got = {r.g: r for r in evaluation.bootstrap(df, "g", "item", "v").collect()}
    for g in ("n40", "n120", "n1000"):
        mean, lo, hi = evaluation.bootstrap_exact(values[g])
        assert abs(got[g].mean - mean) < 1e-6 and 0.85 < (got[g].hi - got[g].lo) / (hi - lo) < 1.15
    assert got["one"].lo == got["one"].hi == 0.4
    one = {r.g: r for r in evaluation.paired(df, "g", "item", "v").collect()}
    assert math.isnan(one["one"].lo) and not one["one"].significant and one["n40"].significant and one["n40"].lo == got["n40"].lo


def test_bootstrap_draws(spark):
    """Places are drawn with replacement: each iteration has about 1 - 1/e different ones."""
    for n in (40, 120, 1000):
        df = spark.range(50).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("d"))
        r = df.withColumn("p", evaluation.hashed_index(F.col("i"), F.col("d"), F.lit(n))).groupBy("i").agg(F.countDistinct("p").alias("c"), F.min("p").alias("a"), F.max("p").alias("b")).agg(F.avg("c"), F.min("a"), F.max("b")).first()
        assert abs(r[0] / n - 0.632) < 0.03 and r[1] == 0 and r[2] == n - 1


def test_best_threshold_targets(spark):
    rows = [(0, 0.1, 1.0, 0.70, 0.00, 0.2), (0, 0.3, 0.8, 0.92, 0.04, 0.5), (0, 0.5, 0.5, 0.95, 0.20, 0.9), (1, 0.2, 0.9, None, 0.00, 1.0)]
    swept = spark.createDataFrame(rows, "amb int, tau double, coverage double, accuracy double, false_abstain double, refusal double")
    tau = lambda **x: [r.tau for r in evaluation.best_threshold(swept, **x).collect()]
    assert tau() == [0.3] and tau(false_abstain=0.2) == [0.5] and tau(accuracy=0.6, false_abstain=0.0) == [0.1] and tau(accuracy=0.99) == []


def test_best_tau_targets(spark, data):
    """The registered query leaves out what misses the targets, where best_tau takes it."""
    good = lambda r: r.accuracy >= 0.90 and r.false_abstain <= 0.05
    loose, kept = (QUERIES[n](spark, data).collect() for n in ("best_tau", "best_tau_targets"))
    assert loose and not good(loose[0]) and all(map(good, kept))


def test_rewrites_by_ndcg(spark, data):
    """Relevant hits that rise from place 5 to 2 are an improvement; searches between the first and the last count; so do relevant hits below place 1."""
    places, logit = {1: 5, 2: 2, 3: 2, 4: 5}, {1: 0.0, 2: 0.0, 3: 20.0, 4: 20.0}
    rows = []
    for search, place in places.items():
        for rank in range(1, 7):
            doc = 100 if rank == place else 10 * search + rank
            rows.append((search, "q", "bm25", dt.datetime(2025, 1, search), f"c{doc}", doc, 10.0 - rank, None, logit[search] - rank / 10, None, None))
    hits = spark.createDataFrame(rows, spark.read.parquet(f"{data}/hits.parquet").schema)
    qrels = spark.createDataFrame([("q", 100, 2)], "query_id string, doc_id bigint, grade int")
    got = {(r.search_id, r.search_id2): r.verdict for r in rewrites(hits, qrels).collect()}
    assert got == {(1, 2): "improved", (2, 3): "rescued", (3, 4): "no change"}


def test_human_judgement_wins(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    rows = [("q", 1, 1, t(1), "human"), ("q", 1, 3, t(5), "llm"), ("q", 2, 0, t(1), "llm"), ("q", 2, 2, t(2), "pool"), ("q", 3, 1, t(1), "human"), ("q", 3, 2, t(2), "human")]
    df = spark.createDataFrame(rows, "query_id string, doc_id bigint, grade int, judged_at timestamp, judged_by string")
    assert {r.doc_id: r.grade for r in evaluation.merged_qrels(df).collect()} == {1: 1, 2: 2, 3: 2}


# --- quotes

SRC = "A large quantity generator may accumulate hazardous waste on-site for no more than 90 days without a permit."


@pytest.mark.parametrize("quote", ["may accumulate hazardous waste", "MAY ACCUMULATE  hazardous\nwaste", "may accumulate hazardous waste on–site"])
def test_quotes_found(quote):
    s, e, ratio = quotes.locate(quote, SRC)
    assert ratio == 1.0 and SRC[s:e].lower().startswith("may accumulate")


def test_quotes_refused():
    for quote in ("may store radioactive waste forever", "waste", "", None, "  "):
        assert quotes.locate(quote, SRC) is None


def test_fuzzy_quotes():
    assert quotes.locate("accumulate hazardous waste on-site for not more than 90 days", SRC)[2] >= 0.95
    assert quotes.locate("accumulate hazardous waste on-site for no more than ninety days", SRC) is None
    assert quotes.locate("accumulate hazardous waste on-site for not more than 90 days", SRC, fuzzy=False) is None


def test_length_changing_folds_keep_offsets():
    text = "½ ofﬁce ﬂow: the operator must file a notice"
    s, e, _ = quotes.locate("the operator must file", text)
    assert text[s:e] == "the operator must file"


def test_verify_citations(spark):
    src = spark.createDataFrame([("q", 1, "c", 100, SRC)], "query_id string, place int, chunk_id string, char_start int, text string")
    cites = spark.createDataFrame([("q", "1", "may accumulate hazardous waste"), ("q", "2", "may accumulate hazardous waste"), ("q", "x", "may accumulate"), ("q", "1", "something else entirely")], "query_id string, source string, quote string")
    good, counts = quotes.verify_citations(cites, src)
    row = good.collect()[0]
    assert row.quote == "may accumulate hazardous waste" and row.doc_char_start == 100 + SRC.index("may")
    assert tuple(counts.first()) == ("q", 1, 3)


def test_verify_citations_fuzzy(spark, data):
    """Altered quotes are found by the matcher only; the four places outside and other texts are dropped."""
    got = {r.query_id: (r.verified, r.dropped) for r in QUERIES["verify_citations_fuzzy"](spark, data).collect()}
    ranked = QUERIES["hydrate_hits"](spark, data).collect()
    places = {}
    for r in ranked:
        places.setdefault(r.search_id, []).append(r["rank"])
    assert {q: sum(c) for q, c in got.items()} == {q: len(p) + 4 * (1 in p) for q, p in places.items()}
    altered = sum(p % 4 in (1, 2, 3) for own in places.values() for p in own)
    whole = sum(p % 4 == 1 for own in places.values() for p in own)
    assert 1.5 * whole < sum(v for v, _ in got.values()) <= altered
    assert all(dropped >= 4 * (1 in places[q]) for q, (_, dropped) in got.items())


# --- dense


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("c", [0.0, 1.0])], "item string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, vec array<float>")
    rows = dense.dense_topk(q, v, k=2, dim=2).collect()
    assert sorted((r["rank"], r["item"]) for r in rows) == [(1, "a"), (2, "b")]
    assert dense.dense_topk(q, v.limit(0), dim=2).count() == 0
    assert v.select(dense.norm(dense.normalize(F.col("vec")))).first()[0] == 1.0
    assert spark.range(1).select(F.size(dense.hashing_embedder(F.lit("some words here")))).first()[0] == 64


# --- ranks, filters, tables


@pytest.mark.parametrize("hot", [3, 10**9])
def test_ranks_of_hot_groups(spark, hot):
    rows = [("g", i, float(i * 7 % 50)) for i in range(200)] + [("h", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(r.g, r.i): (r.r, r.n) for r in ranking.rank_in_groups(ranking.rank_in_groups(df, ["g"], "v", "r", hot_rows=hot), ["g"], "v", "n", ties=["i"], hot_rows=hot).collect()}
    for g in "gh":
        own = [(i, v) for x, i, v in rows if x == g]
        order = sorted(own, key=lambda t: (-t[1], t[0]))
        for i, v in own:
            assert got[g, i] == (1 + sum(w > v for _, w in own), 1 + order.index((i, v)))


def test_maybe_in_loses_nothing(spark):
    df = spark.range(5000).withColumn("k", F.concat(F.lit("k"), "id"))
    keys = df.filter("id % 100 = 0").select("k")
    kept = filters.maybe_in(df, F.col("k"), keys, "k")
    assert kept.join(keys, "k").count() == 50 and kept.count() < 200
    assert filters.maybe_in(df, F.col("k"), keys.limit(0), "k").count() == 0


SNAP = "snapshot_id bigint, doc_id bigint, text string, fetched_at timestamp, extra int"


def snap(spark, rows):
    return spark.createDataFrame([(*r, dt.datetime(2025, 1, 1, i % 24), i) for i, r in enumerate(rows)], SNAP)


def test_snapshots(spark):
    rows = [(1, 10, "a"), (1, 11, None), (1, 12, ""), (1, 13, "x"), (3, 10, "old"), (3, 10, "a"), (3, 11, ""), (3, 12, ""), (3, 99, "n"), (4, 99, "n"), (None, 1, "z"), (4, None, "z")]
    got = sorted(tuple(r) for r in snapshots.snapshot_changes(snap(spark, rows)).collect())
    assert got == [(3, 11, "changed"), (3, 13, "removed"), (3, 99, "added"), (4, 10, "removed"), (4, 11, "removed"), (4, 12, "removed")]
    assert snapshots.snapshot_changes(snap(spark, rows).limit(0)).count() == 0


def test_ordinals_persist(spark):
    first = snapshots.ordinals(spark.createDataFrame([(5,), (7,), (None,), (5,)], "k int"), "k")
    then = snapshots.ordinals(spark.createDataFrame([(1,), (7,), (9,)], "k int"), "k", first)
    assert {r.k: r.ordinal for r in first.collect()} == {5: 0, 7: 1}
    assert {r.k: r.ordinal for r in then.collect()} == {5: 0, 7: 1, 1: 2, 9: 3}


def test_ordinals_after_one_key(spark):
    one = snapshots.ordinals(spark.createDataFrame([(5,)], "k int"), "k")
    then = snapshots.ordinals(spark.createDataFrame([(1,), (5,)], "k int"), "k", one)
    assert {r.k: r.ordinal for r in then.collect()} == {5: 0, 1: 1}
    assert [r.ordinal for r in snapshots.ordinals(spark.createDataFrame([(3,)], "k int"), "k", one.limit(0)).collect()] == [0]
    rows = [(1, 10, "a"), (2, 10, "b"), (2, 11, "n")]
    known = spark.createDataFrame([(10, 0)], "doc_id bigint, ordinal bigint")
    assert sorted(tuple(r) for r in snapshots.snapshot_changes(snap(spark, rows), known=known).collect()) == [(2, 10, "changed"), (2, 11, "added")]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "t", "a"), (2, "t", "b")], "k int, title string, text string")
    new = spark.createDataFrame([(2, "other", None), (3, "n", "c")], "k int, title string, text string")
    assert sorted(map(tuple, tables.upsert(old, new, "k", ["text"], ["title"]).collect())) == [(1, "t", "a"), (2, "t", None), (3, "n", "c")]


def test_replace_strategy(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda *r: spark.createDataFrame(r, "chunk_id string, strategy string")
    tables.replace_strategy(make(("a", "fixed"), ("b", "section")), path)
    tables.replace_strategy(make(("c", "fixed")), path)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == ["b", "c"]


# --- serving


def test_bucket():
    b = serving.Bucket(2, 0.5)
    assert [b.take(0.0)[0] for _ in range(3)] == [True, True, False]
    assert b.take(0.0) == (False, 2.0) and b.take(2.0)[0]
    assert serving.Bucket(0, 0).take(0.0) == (False, math.inf)


def test_token_bucket_of_a_hot_key(spark):
    rows = [(i, 1 if i % 3 else i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i)) for i in range(300)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp")
    got = {r.event_id: r.allowed for r in serving.token_bucket(df, capacity=5, refill=0.1).collect()}
    buckets, want = {}, {}
    for i, u, _ in rows[:-1]:
        want[i] = buckets.setdefault(u, serving.Bucket(5, 0.1)).take(float(i))[0]
    assert got == want


# --- sources

XML = """<ROOT><DIV5 N="262"><HEAD>PART 262</HEAD><DIV6 N="A"><HEAD>Subpart A</HEAD><DIV7><HEAD>Group</HEAD>
<DIV8 N="262.17" hierarchy_metadata="{&amp;quot;citation&amp;quot;:&amp;quot;40 CFR 262.17&amp;quot;}"><HEAD>Conditions</HEAD><P>First  <I>part</I>.</P><CITA>[45 FR]</CITA><TABLE><TR><TD>a</TD><TD/><TH>b</TH></TR></TABLE>
<DIV9 N="A B"><HEAD>Appendix</HEAD><P>More</P></DIV9></DIV8></DIV7><DIV8 N="262.17"><HEAD>Again</HEAD><P>x</P></DIV8><DIV8 N="262.18"><HEAD>[Reserved]</HEAD></DIV8><DIV8><HEAD>None</HEAD><P>y</P></DIV8></DIV6></DIV5></ROOT>"""


def test_xml(spark, tmp_path):
    (tmp_path / "262.xml").write_text(XML)
    rows = {r.doc_id: r for r in xml.documents(xml.read_parts(spark, str(tmp_path), "40")).collect()}
    assert sorted(rows) == ["ecfr:40:262.17", "ecfr:40:262.17-appAB", "ecfr:40:262.17~1"]
    first = rows["ecfr:40:262.17"]
    assert first.heading_path == "Title 40 > PART 262 > Subpart A > Group > Conditions" and first.citation == "40 CFR 262.17"
    assert first.text.startswith("Conditions\n\nFirst part.\n\na | b") and "45 FR" not in first.text


def test_jsonl_and_exports(spark, data, tmp_path):
    rows = [("q1", "exact", "é?"), ("q2", None, "x")]
    files.write_jsonl(spark.createDataFrame(rows, files.QUERIES), str(tmp_path / "q"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "q"), files.QUERIES).collect())) == rows
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none"), files.QUERIES).count()
    qrels = spark.read.parquet(f"{data}/qrels.parquet")
    files.export_qrels(qrels, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), files.QRELS).count() == qrels.count()
    assert "| 0.500 | -- |" in files.markdown(spark.sql("SELECT 0.5D AS a, cast(null AS int) AS b"))
    chunks, vectors, docs = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("chunks", "vectors", "documents"))
    with pytest.raises(ValueError):
        files.export_static(chunks, vectors, docs, str(tmp_path / "x"))
    vectors = vectors.filter("vec IS NOT NULL")
    files.export_static(chunks.join(vectors, "chunk_id", "left_semi"), vectors, docs, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/vectors")).count() == vectors.select("chunk_id").distinct().count()


# --- hot groups, hot values, compressed bitmaps


@pytest.mark.parametrize("hot", [10, 10**9])
def test_ranks_with_one_hot_value_and_null_groups(spark, hot):
    """Nine in ten rows share one value; some rows have no group."""
    rows = [("g", i, 1.0 if i % 10 else float(i)) for i in range(300)] + [(None, i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    tied = {(r.g, r.i): r.r for r in ranking.rank_in_groups(df, ["g"], "v", "r", hot_rows=hot).collect()}
    numbered = {(r.g, r.i): r.r for r in ranking.rank_in_groups(df, ["g"], "v", "r", ties=["i"], hot_rows=hot).collect()}
    for g in ("g", None):
        own = [(i, v) for x, i, v in rows if x == g]
        order = sorted(own, key=lambda t: (-t[1], t[0]))
        assert all(tied[g, i] == 1 + sum(w > v for _, w in own) for i, v in own)
        assert all(numbered[g, i] == 1 + order.index((i, v)) for i, v in own)
    assert len(tied) == len(numbered) == 330


@pytest.mark.parametrize("hot", [5, 10**9])
def test_running_total(spark, hot):
    rows = [("g", i, 1 + i % 3) for i in range(100)] + [("h", 7, 5)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = {(r.g, r.i): r.t for r in ranking.running_total(df, ["g"], [F.col("i")], F.col("n"), "t", hot_rows=hot).collect()}
    assert got == {("g", i): sum(1 + j % 3 for j in range(i)) for i in range(100)} | {("h", 7): 0}
    assert ranking.running_total(df.limit(0), ["g"], [F.col("i")], F.col("n"), "t").count() == 0


def test_percentile_of_one_common_value(spark):
    """A value that very many rows share is one row with its count."""
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") < 199_000, 2.0).otherwise(F.col("id").cast("double")).alias("v")).union(spark.createDataFrame([("a", None)], "g string, v double"))
    assert [tuple(r) for r in evaluation.percentile(df, ["g"], "v", 0.95, "p").collect()] == [("a", 2.0)]
    assert [tuple(r) for r in evaluation.percentile(df, ["g"], "v", 1.0, "p").collect()] == [("a", 199_999.0)]


def test_bits_of_the_filter(spark):
    assert filters.bits_for(0) == 1 << 16 and filters.bits_for(1 << 20) == 1 << 24 and filters.bits_for(10**8) == filters.MOST_BITS and filters.bits_for(10**9) == 0
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    assert filters.maybe_in(df, F.col("k"), df, "k", most=1).count() == 2  # more keys than the filter could tell apart: nothing but nulls is dropped


@pytest.mark.parametrize("a,b", [(range(0, 100), range(50, 150)), (range(0, 30_000), range(5, 9)), (range(0, 20_000, 2), range(0, 30_000, 3)), ((), (1,)), ((), ())])
def test_bitmaps(a, b):
    import numpy as np

    x, y = (snapshots.Bitmap.of(np.array(list(v), np.int64)) for v in (a, b))
    assert x.members().tolist() == sorted(a) and y.members().tolist() == sorted(b)
    assert x.and_not(y).tolist() == sorted(set(a) - set(b)) and y.and_not(x).tolist() == sorted(set(b) - set(a)) and x.and_(y).tolist() == y.and_(x).tolist() == sorted(set(a) & set(b))


def test_stored_ordinals_over_two_deliveries(spark, tmp_path):
    """A second delivery keeps the first one's ordinals, and changes are those of a run that sees all at once."""
    path = str(tmp_path / "ordinals")
    first = [(1, k, f"t{k}") for k in (5, 6)]
    second = [(2, k, f"t{k}" if k != 6 else "new") for k in (1, 6, 9)]
    before = {r.doc_id: r.ordinal for r in snapshots.stored_ordinals(snap(spark, first), "doc_id", path).collect()}
    whole = snap(spark, first + second)
    kept = snapshots.stored_ordinals(whole, "doc_id", path)
    after = {r.doc_id: r.ordinal for r in kept.collect()}
    assert all(after[k] == n for k, n in before.items()) and sorted(after.values()) == [0, 1, 2, 3]
    want = {(2, 5, "removed"), (2, 6, "changed"), (2, 1, "added"), (2, 9, "added")}
    assert {tuple(r) for r in snapshots.snapshot_changes(whole, known=kept).collect()} == want == {tuple(r) for r in snapshots.snapshot_changes(whole).collect()}


def test_dense_keeps_ties_over_batches(spark):
    """Equal vectors in many batches: the smallest ids are kept."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select(F.col("id").alias("item"), F.array(*(F.lit(1.0) for _ in range(4))).alias("vec"))
        q = spark.createDataFrame([("q", [1.0, 1.0, 1.0, 1.0])], "query_id string, vec array<double>")
        assert [r.item for r in dense.dense_topk(q, df, k=5, dim=4).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
        assert dense.dense_topk(q.limit(0), df, dim=4).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_longest_common_run_against_difflib():
    import difflib

    rng = random.Random(11)
    for _ in range(200):
        source = "".join(rng.choice("ab ") for _ in range(rng.randrange(20, 200)))
        k = rng.randrange(0, len(source) - 15)
        quote = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) + source[k : k + rng.randrange(12, 40)] + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 6)))
        m = difflib.SequenceMatcher(None, source, quote, autojunk=False).find_longest_match(0, len(source), 0, len(quote))
        least = max(quotes.LEAST, len(quote) // 2)
        want = (m.a, m.b, m.size) if m.size >= least else (0, 0, 0)
        assert quotes.longest_common(source, quote, least) == want


def test_folded_places_point_at_the_source():
    text = " \n ﬁne ½ “Quote” – İstanbul\t\tend \n"
    own = quotes.Folded(text)
    assert not own.text.startswith(" ") and not own.text.endswith(" ") and "  " not in own.text
    for i, c in enumerate(own.text):
        assert c in quotes._folded_one(text[own.at[i]]) or c == " " and text[own.at[i]].isspace()
    assert quotes.Folded("").text == quotes.Folded("  \n").text == ""


def test_cache_put_and_import(spark, tmp_path):
    t = lambda n: dt.datetime(2025, 1, n)
    new = spark.createDataFrame([(" What ", 1, t(1)), ("what", 2, t(3)), ("WHAT", 3, t(3)), (None, 4, t(9)), ("other", 5, t(1))], "query string, n int, at timestamp")
    old = new.limit(1).select(serving.query_key(F.col("query")).alias("key"), "n", F.lit(t(2)).alias("at"))
    assert sorted(r.n for r in serving.cache_put(old, new, ["n"], "at", "n").collect()) == [3, 5]
    (tmp_path / "q.jsonl").write_text('{"query_id": "q", "doc_id": 1, "grade": 2, "judged_at": "2025-01-02T00:00:00", "judged_by": "llm"}\n\n')
    had = spark.createDataFrame([("q", 1, 3, "human", t(1)), ("q", 2, 0, "llm", t(1))], "query_id string, doc_id bigint, grade int, judged_by string, judged_at timestamp_ntz")
    assert {(r.doc_id, r.grade) for r in files.import_qrels(spark, str(tmp_path / "q.jsonl"), had).collect()} == {(1, 3), (2, 0)}


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tessera import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", setCheckpointDir=lambda d: pytest.fail("no folder was named"))
    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
    with pytest.raises(ValueError):
        session.cut(frame)


def test_plain_bm25_with_repeated_rows(spark, monkeypatch):
    """Repeats of a row count once; so they do not change any score."""
    c = spark.createDataFrame([("a", "structured", "alpha beta beta"), ("b", "structured", "beta gamma"), ("n", "structured", None), ("e", "structured", "")], "chunk_id string, strategy string, text string")
    q = spark.createDataFrame([("q", "Beta alpha employer's"), ("none", None), ("other", "zeta")], "query_id string, query string")
    once = [tuple(r) for r in lexical.bm25_plain(c, q).orderBy("rank").collect()]
    assert [r[1] for r in once] == ["a", "b"]
    assert [tuple(r) for r in lexical.bm25_plain(c.union(c).union(c), q).orderBy("rank").collect()] == once
    assert lexical.bm25_plain(c.limit(0), q).count() == lexical.bm25_plain(c, q.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "LISTED_TERMS", 1)  # more terms than are listed
    for most in (10, 0):
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", most)
        assert [tuple(r) for r in lexical.bm25_plain(c.union(c), q).orderBy("rank").collect()] == once
