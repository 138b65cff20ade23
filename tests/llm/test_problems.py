"""Operators against brute force on whole small tables, and on hand-made hostile rows."""

import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import canon, encode, leak, neardup, neighbours, rank, repeat, split, terms
from tessera.llm import queries as Q
from tessera.llm.words import words


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r for r in read(spark, data, "documents").collect()}


@pytest.fixture(scope="module")
def chunks(spark, data):
    return {r.chunk_id: r for r in read(spark, data, "chunks").collect()}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(spark, *values):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, "x", i, 1) for i, v in enumerate(values)], "doc_id bigint, text string, heading_path string, h bigint, rank int")


# --- 1 splitting


def stated(t):
    out, s = [], 0
    while len(t) - s > 1400:
        e = s + 1400
        for kind in (lambda a, b: a == b == "\n", lambda a, b: b == "。" or b in " \t\n" and a in ".;:!?", lambda a, b: b in " \t\n"):
            fit = [x for x in range(s + 700, s + 1401) if kind(t[x - 2], t[x - 1])]
            if fit:
                e = fit[-1]
                break
        out.append((s, e))
        s = e - 200
    return [*out, (s, len(t))]


def test_p1(spark, data, docs):
    assert rows(Q.p1_found(spark, data)) == {(i, *s) for i, r in docs.items() if r.text and len(r.text) > 1400 for s in stated(r.text)}


@pytest.mark.parametrize("lookahead", [0.0, 0.5, 1.0])
def test_split_hostile(spark, lookahead):
    values = [None, "", " " * 5000, "x" * 1400, "x" * 1401, "x" * 9999, "字。" * 2000, "a\n\n" * 3000, "😀 " * 2500, "word. " * 50_000]
    got = defaultdict(list)
    for r in split.split_oversized(texts(spark, *values), "doc_id", keep=("heading_path",), lookahead=lookahead).collect():
        got[r.doc_id].append((r.char_start, r.char_end))
    assert set(got) == {i for i, v in enumerate(values) if v and len(v) > 1400}
    for i, spans in got.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(values[i])
        assert all(e - s <= 1400 for s, e in spans)
        assert all(b[0] == a[1] - 200 for a, b in zip(spans, spans[1:]))


def test_least_total_beats_the_chain():
    def cost(text, spans):
        ends, kinds = split.boundaries(text)
        kind = dict(zip(ends.tolist(), kinds.tolist()))
        return sum((0 if e == len(text) else split.PENALTY[kind.get(e, 3)]) + (1400 - (e - s)) / 1400 for s, e in spans)

    rng = np.random.default_rng(5)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "end. ", "\n\n", "longerword"], p=[0.6, 0.2, 0.05, 0.15]) for _ in range(1500))
        assert cost(text, split.cut(text, lookahead=1.0)) <= cost(text, split.cut(text)) + 1e-9


def test_penalties_decide_the_cuts(monkeypatch):
    """All cuts come from the dynamic programme's costs: without the penalties only the size decides."""
    text = ("word " * 150 + "end. " + "\n\n") * 20
    with_them = split.cut(text)
    monkeypatch.setattr(split, "PENALTY", (0.0, 0.0, 0.0, 0.0))
    without = split.cut(text)
    assert with_them != without and all(text[e - 2 : e] == "\n\n" for _, e in with_them[:-1])


# --- 2 fusion


def test_p2(spark, data):
    hits = defaultdict(dict)
    for r in read(spark, data, "hits").collect():
        low = float("-inf")
        hits[r.search_id][r.chunk_id] = [low if v is None else v for v in (r.score, r.rerank_score, None if r.lexical_rank is None else -r.lexical_rank, None if r.dense_rank is None else -r.dense_rank)]
    want = {(s, a) for s, own in hits.items() for a, x in own.items() if all(sum(p > q for p, q in zip(x, y)) >= 3 for b, y in own.items() if a != b)}
    assert rows(Q.p2_found(spark, data)) == want and want


@pytest.mark.parametrize("hot", [4, 10**9])
def test_fusion_hostile(spark, hot):
    data = [("s", f"i{k}", float(k % 7), None, k % 5, 1) for k in range(40)] + [("s", "i3", 3.0, None, 3, 1), ("s", "none", None, float("nan"), None, None), (None, "x", 1.0, 1.0, 1, 1), ("t", "only", None, None, None, None)]
    df = spark.createDataFrame(data, "g string, i string, a double, b double, c int, rrf int")
    fused = rank.fuse_scores(df, "g", "i", ["a", "b"], ["c"], hot_rows=hot)
    got = {(r.g, r.i): r for r in fused.collect()}
    assert len(got) == 42 and got["s", "none"].rrf == 0 and got["s", "none"].fused_rank == 41
    assert sorted(r.fused_rank for k, r in got.items() if k[0] == "s") == list(range(1, 42))
    assert ("t", "only") in rows(rank.undisputed_first(fused, "g", "i", ["a", "b", "c"], 2))
    assert rank.fuse_scores(df.limit(0), "g", "i", ["a"], []).count() == 0


def test_undisputed_first_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(rank, "FOLD", 3)
    data = [(1, f"i{k:03}", float(k), float(k), float(-k)) for k in range(50)] + [(2, "a", 1.0, 2.0, 3.0), (2, "b", 2.0, 3.0, 1.0), (2, "c", 3.0, 1.0, 2.0)]
    df = spark.createDataFrame(data, "g int, i string, a double, b double, c double")
    assert rows(rank.undisputed_first(rank.fuse_scores(df, "g", "i", ["a", "b", "c"], []), "g", "i", ["a", "b", "c"], 2)) == {(1, "i049")}


def test_fused_score_bounds_the_contenders(spark, data):
    """Every undisputed hit reaches the bound, and many others don't."""
    fused = rank.fuse_scores(read(spark, data, "hits"), "search_id", "chunk_id", Q.HIGHER, Q.LOWER).cache()
    fields = Q.HIGHER + Q.LOWER
    few = rank.contenders(fused, fields, 3)
    won = rank.undisputed_first(fused, "search_id", "chunk_id", fields)
    assert won.join(few, ["search_id", "chunk_id"]).count() == won.count()
    assert few.count() < 0.7 * fused.count()


def test_bound_holds_for_any_ranks(spark):
    rng = np.random.default_rng(6)
    data = []
    for g in range(300):
        n = int(rng.integers(2, 12))
        v = rng.integers(0, 4, (n, 4)).astype(float)
        v[0] += rng.integers(0, 4, 4)
        v[rng.random((n, 4)) < 0.15] = np.nan
        data += [(g, f"i{k}", *map(float, row)) for k, row in enumerate(v)]
    df = spark.createDataFrame(data, "g int, i string, a double, b double, c double, d double")
    low = defaultdict(dict)
    for g, i, *v in data:
        low[g][i] = [float("-inf") if np.isnan(x) else x for x in v]
    want = {(g, a) for g, own in low.items() for a, x in own.items() if all(sum(p > q for p, q in zip(x, y)) >= 3 for b, y in own.items() if a != b)}
    fused = rank.fuse_scores(df, "g", "i", ["a", "b", "c", "d"], [])
    assert rows(rank.undisputed_first(fused, "g", "i", ["a", "b", "c", "d"])) == want and len(want) > 20


# --- 3 neighbours


def neighbours_by_force(vectors, k=5, least=0.85):
    own = defaultdict(dict)
    for r in vectors:
        if r.vec is not None and len(r.vec) == 64 and any(r.vec):
            own[r.strategy, r.model][r.chunk_id] = np.array(r.vec, np.float64) / np.linalg.norm(r.vec)
    out = set()
    for part in own.values():
        ids, x = list(part), np.stack(list(part.values()))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(ids)):
            out |= {tuple(sorted((ids[i], ids[j]))) for j in np.argsort(-s[i])[:k] if s[i, j] >= least}
    return out


@pytest.mark.parametrize("cell,fit_rows", [(neighbours.CELL, 10_000), (40, 10_000), (40, 300)])
def test_p3(spark, data, cell, fit_rows):
    v = read(spark, data, "vectors")
    got = {tuple(sorted((r.a, r.b))) for r in neighbours.nearest(v, ["strategy", "model"], cell=cell, fit_rows=fit_rows).collect()}
    want = neighbours_by_force(v.collect())
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def unit_vectors(n, centres, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, 64))
    x = c[rng.integers(0, centres, n)] + 0.35 * rng.standard_normal((n, 64))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("levels", [2, 4, 6, 8])
def test_copies_and_leaves_stay_bounded(levels):
    """At most three copies of a vector and leaves of the size they are laid out for, however deep the trees are; recall with them."""
    n = 16_384
    cell = n >> levels
    x = unit_vectors(n, 1_000)
    margin = neighbours.MARGIN * np.sqrt(0.3) / 8
    sample = x[np.random.default_rng(0).choice(n, min(n, int(n * neighbours.LEAF_ROWS / (neighbours.FILL * cell))), replace=False)]
    trees = [neighbours.grow(sample, n, cell, 0.85, margin, 100 + t)[0] for t in range(neighbours.TREES)]
    r, t, leaf, home = neighbours.route(trees, x, margin)
    assert len(r) <= 3 * n and np.bincount(r[home]).tolist() == [2] * n
    assert np.bincount(np.unique(t << 40 | leaf, return_inverse=True)[1]).max() <= 1.5 * cell
    found = set()
    where = t << 40 | leaf
    for own in np.split(np.argsort(where, kind="stable"), np.flatnonzero(np.diff(np.sort(where))) + 1):
        a, b, _ = neighbours.search(x[r[own]], home[own], 5, 0.85)
        found |= set(zip(r[own][a].tolist(), r[own][b].tolist()))
    asked = np.random.default_rng(1).choice(n, 500, replace=False)
    s = x[asked] @ x.T
    s[np.arange(500), asked] = -2
    want = {(int(i), int(j)) for i, row in zip(asked, s) for j in np.argsort(-row)[:5] if row[j] >= 0.851}
    assert len(want) > 1000 and len(want & found) >= 0.93 * len(want)  # the centres fill the space evenly, so planes find no gaps


def test_trees_are_kept_as_bytes_and_joined():
    x = unit_vectors(4_000, 1_000)
    tree, opened = neighbours.grow(x[:200], 4_000, 40, 0.85, 0.07, 1)
    assert opened
    leaf = tree.down(x, np.zeros(len(x), int))
    below = {o: neighbours.grow(x[leaf == o], float((leaf == o).sum()), 40, 0.85, 0.07, 2)[0] for o in opened}
    whole = tree.joined({o: neighbours.Tree.loaded(t.dumped()) for o, t in below.items()})
    new = whole.down(x, np.zeros(len(x), int))
    assert whole.leaves > tree.leaves and np.bincount(new).max() <= 40
    for o, t in below.items():  # a leaf's vectors are parted as its own tree parts them
        own = t.down(x[leaf == o], np.full((leaf == o).sum(), 0 if len(t.t) else -1))
        assert len(set(zip(own.tolist(), new[leaf == o].tolist()))) == len(set(own.tolist()))


def crowd(n, size, cosine, seed=5):
    """Unit vectors of which the first ``size`` are one topic with that mutual cosine."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, 64)))
    x[:size] = unit(np.sqrt(cosine) * unit(rng.standard_normal(64)) + np.sqrt(1 - cosine) * x[:size])
    return x.astype(np.float32)


def crowd_recall(x, size, got):
    asked = np.random.default_rng(1).choice(size, 200, replace=False)
    s = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    s[np.arange(200), asked] = -2
    want = {(int(i), int(j)) for row, i in zip(s, asked) for j in np.argsort(-row)[:5] if row[j] >= 0.85}
    assert len(want) > 900
    return len(want & got) / len(want)


@pytest.mark.parametrize("cosine", [0.93, 0.87, 0.78])
def test_crowded_topic(spark, cosine):
    """A topic of more vectors than a leaf is laid out for stays in one leaf."""
    x = crowd(12_000, 5000, cosine)
    df = spark.createDataFrame([(i, "s", "m", v.tolist()) for i, v in enumerate(x)], "chunk_id int, strategy string, model string, vec array<float>")
    got = neighbours.nearest(df, ["strategy", "model"], cell=1000).collect()
    assert crowd_recall(x, 5000, {(r.a, r.b) for r in got}) >= 0.95 and max(Counter(r.a for r in got).values()) <= 5


def test_neighbours_hostile(spark):
    one = [1.0] * 64
    rows_ = [(f"c{i:02}", "s", "m", one) for i in range(20)] * 2 + [("z", "s", "m", [0.0] * 64), ("n", "s", "m", None), ("short", "s", "m", [1.0]), ("nan", "s", "m", [float("nan")] * 64), (None, "s", "m", one), ("g", None, "m", one), ("alone", "t", "m", one)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows_], "chunk_id string, strategy string, model string, vec array<float>, h int, cell string")
    got = neighbours.nearest(df, ["strategy", "model"]).collect()
    count = Counter(r.a for r in got)
    assert set(count) == {f"c{i:02}" for i in range(20)} and set(count.values()) == {5}
    assert neighbours.nearest(df.limit(0), ["strategy", "model"]).count() == 0


# --- 4 near-duplicates


def shingles(t, n):
    w = words(t)
    return set(zip(*(w[k:] for k in range(n))))


def test_p4(spark, data, chunks):
    sets = {c: (r.strategy, s) for c, r in chunks.items() if len(s := shingles(r.text, 3)) >= 20}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a][0] == sets[b][0] and 10 * len(sets[a][1] & sets[b][1]) >= 7 * len(sets[a][1] | sets[b][1])}
    assert rows(Q.p4_found(spark, data)) == want and want


@pytest.mark.parametrize("hot,per_task", [(neardup.HOT, neardup.PER_TASK), (8, 3)])
def test_hot_shards_and_groups(spark, hot, per_task):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 200, i % 6):
            w[k] = f"e{i}"
        made.append((f"a{i:02}", "s", " ".join(w)))
    made += [(f"b{i:02}", "s", " ".join([*base, f"day{i}"])) for i in range(20)]  # many texts with one fingerprint
    made += [("copy", "s", made[0][2].upper()), ("other", "t", made[0][2]), ("null", "s", None), ("empty", "s", ""), ("few", "s", "one two"), (None, "s", made[0][2])]
    df = spark.createDataFrame([(*r, 1, "t") for r in made + made[:3]], "chunk_id string, strategy string, text string, f int, t string")
    members, links = neardup.near_duplicates(df, gram=3, threshold=0.8, hot=hot, per_task=per_task)
    sets = {c: (g, shingles(t, 3)) for c, g, t in made if c and t and len(words(t)) > 2}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])}
    assert rows(neardup.expanded(members, links)) == want
    got = {r.id: r for r in neardup.groups(members, links).collect()}
    assert set(got) == set(sets) and got["copy"].class_id == got["a00"].class_id
    assert len({got[c].group_id for c in got if c[0] in "ab"}) == 1
    assert neardup.near_duplicates(df.limit(0))[1].count() == 0


def test_vantage_points():
    rng = np.random.default_rng(2)
    near = rng.integers(0, 1 << 62, 30)[:, None] ^ (1 << rng.integers(0, 62, (30, 20)))
    p = np.unique(near.ravel())
    q, f = neardup.VantagePoints(p, leaf=4).within(p, 3)
    d = np.bitwise_count((p[:, None] ^ p[None, :]).view(np.uint64))
    assert set(zip(q.tolist(), f.tolist())) == {(int(p[i]), int(p[j])) for i, j in zip(*np.nonzero(d <= 3))}


# --- 5 terms


def test_p5(spark, data, docs, chunks):
    spread = Counter(w for r in docs.values() for w in set(words(r.text)))
    want = set()
    for c, r in chunks.items():
        if r.strategy == "structured":
            heading = set(words(docs[r.doc_id].heading)) if r.doc_id in docs else set()
            want |= {(c, w) for w, n in Counter(words(r.text)).items() if n >= 3 and len(w) >= 4 and w.isalpha() and w in heading and 1 <= spread[w] <= 5}
    assert rows(Q.p5_found(spark, data)) == want


def test_terms_hostile(spark):
    df = texts(spark, "a b b", "b", "", None, "É é x_y ٣", "b " * 50_000).union(texts(spark, "a b b"))
    spread = {r.term: (r.df, r.gf, round(r.global_weight, 6)) for r in terms.term_spread(df, "doc_id").collect()}
    assert spread["a"] == (1, 1, 1.0) and spread["b"][:2] == (3, 50_003) and spread["é"] == (1, 2, 1.0) and {"x", "y", "٣"} <= set(spread)
    counts = {(r.doc_id, r.term): r.tf for r in terms.term_counts(df, ["doc_id"]).collect()}
    assert counts[0, "b"] == 2 and counts[5, "b"] == 50_000
    assert terms.term_spread(df.limit(0), "doc_id").count() == 0
    assert [round(r.weight, 6) for r in terms.weights(terms.term_counts(df, ["doc_id"]), terms.term_spread(df, "doc_id"), ["doc_id"]).filter("term = 'a'").collect()] == [0.693147]


# --- 7 canonical forms

PLAIN = "Café of the operator, section 12 (fine print): "
ALIKE = [
    PLAIN, unicodedata.normalize("NFD", PLAIN), PLAIN.replace("o", "о").replace("a", "а"), PLAIN.replace(" ", " "), PLAIN.replace("of", "o​f"), PLAIN.replace("12", "１２"), PLAIN.replace("fi", "ﬁ"), PLAIN.replace("C", "С"),
]
OTHER = [PLAIN.upper(), PLAIN.replace("é", "e"), PLAIN.replace(",", "."), PLAIN.replace(" ", "  "), PLAIN.replace(" ", "\n"), PLAIN.replace("12", "١٢"), PLAIN.replace("12", "1½"), PLAIN.replace(" ", "\t")]


def test_look_alikes(spark):
    many = [t * 10 for t in [*ALIKE, *OTHER]] + [None, "", "short", PLAIN * 10, "ё" * 300, "ë" * 300, "й" * 300]
    got = defaultdict(set)
    for r in canon.look_alike_classes(texts(spark, *many), ["doc_id"]).collect():
        got[r.class_id].add(r.doc_id)
    classes = sorted(map(sorted, (c for c in got.values() if len(c) > 1)))
    assert classes == [[*range(8), 19], [20, 21]]
    assert canon.look_alike_classes(texts(spark, *many).limit(0), ["doc_id"]).count() == 0
    forms = {r.doc_id: r.form for r in canon.canonical_texts(texts(spark, *many), "doc_id").collect()}
    assert len({forms[i] for i in range(8)}) == 1 and len({forms[i] for i in range(16)}) == 9 and forms[16] is None


def test_letters_and_ligatures(spark):
    """Every listed letter stands for one Latin letter, and every ligature is made plain in SQL as in Python."""
    for others, latin in (canon._CYRILLIC, canon._GREEK):
        assert len(others) == len(latin) == len(set(others)) and latin.isascii()
    values = [f"{c} and {c}" for c in [*canon._CYRILLIC[0], *canon._GREEK[0], *canon._LIGATURES]]
    got = {r.doc_id: r.m for r in texts(spark, *values).select("doc_id", canon.mapped(F.col("text")).alias("m")).collect()}
    assert [got[i] for i in range(len(values))] == [canon.canonical(v) for v in values] and len(canon._LIGATURES) >= 16


def test_tables_are_kept_apart(spark):
    df = spark.createDataFrame([("a", 1, PLAIN * 9), ("b", 2, ALIKE[2] * 9), ("b", 3, PLAIN * 9)], "table_name string, k int, text string")
    assert {r.k for r in canon.look_alike_classes(df, ["table_name", "k"], within="table_name").collect()} == {2, 3}


def test_p7_classes(spark, data):
    of = {(r.table_name, r.key): r.class_id for r in Q.p7_classes(spark, data).collect()}
    pairs = Q.p7_found(spark, data).collect()
    assert pairs and all(of[r.table_name, r.key_a] == of[r.table_name, r.key_b] for r in pairs)


def test_p7(spark, data, docs, chunks):
    want = set()
    for name, own in (("documents", {i: r.text for i, r in docs.items()}), ("chunks", {i: r.text for i, r in chunks.items() if r.strategy == "structured"})):
        forms = defaultdict(list)
        for i, t in own.items():
            if t and len(t) >= 200:
                forms[canon.canonical(t)].append(i)
        want |= {(name, str(a), str(b)) for ids in forms.values() for a in ids for b in ids if a < b and own[a] != own[b]}
    assert rows(Q.p7_found(spark, data)) == want


# --- 8 token ids


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_p8(spark, data, docs, plain_ids):
    got = {r.doc_id: r.ids for r in Q.p8_ids(spark, data).collect()}
    assert got == {i: plain_ids(r.text or "") for i, r in docs.items()}


def test_encode_hostile(spark, plain_ids):
    rng = np.random.default_rng(0)
    shared = "The operator's record isn't kept   at the site.\n\n  12,5 % — naïve 😀 " * 20
    values = [None, "", " ", "\n" * 3000, "x" * 5000, "字" * 4000, "<|endoftext|> is text", shared, "pre " + shared, "p" + shared + " ", "\x1c'll\x1c " * 400, "".join(rng.choice(list("ab'  \n\t.1é字 \x1d"), 30_000))]
    got = {r.doc_id: r.ids for r in encode.token_ids(texts(spark, *values), "doc_id").collect()}
    assert got == {i: plain_ids(v or "") for i, v in enumerate(values)}
    e = encode.Encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    passage = " ".join(map(str, rng.integers(0, 10_000, 2_000)))
    for before in ("", "pre ", "p"):
        e(before + passage)
    assert e.reused > 0  # chunks are shared whatever precedes them
    assert e.joins > 10 and e.widened == 0


def test_disagreement_widens_to_the_whole_text(plain_ids):
    """Where the ids around a join don't agree with the chunk's, the text is encoded as a whole."""
    e = encode.Encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    passage = " ".join(map(str, np.random.default_rng(7).integers(0, 10_000, 2_000)))
    chunk = e.chunk
    e.chunk = lambda piece: [*chunk(piece)[:-1], 0]
    assert e(passage) == plain_ids(passage) and e.widened == 1


def test_chunk_reuse(spark):
    passage = " ".join(map(str, np.random.default_rng(7).integers(0, 10_000, 2_000)))
    r = encode.chunk_reuse(texts(spark, passage, passage, None, "", "short")).first()
    assert r.chunks == 2 * r.distinct_chunks - 1 and r.bytes == 2 * len(passage) + 5 and r.distinct_bytes == len(passage) + 5
    assert tuple(encode.chunk_reuse(texts(spark, "x").limit(0)).first()) == (0, 0, 0, 0)


def test_memo_outlives_a_task(spark):
    """Both tasks of one Python worker use one encoder."""
    path = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
    passage = " ".join(map(str, np.random.default_rng(0).integers(0, 10_000, 2_000)))
    df = texts(spark, passage).coalesce(1)
    for _ in range(12):  # more tasks than workers
        encode.token_ids(df, "doc_id").collect()

    def reused(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode.encoder(path).reused])], names=["n"])

    assert max(r.n for r in spark.range(0, 16, 1, 16).mapInArrow(reused, "n bigint").collect()) > 0


# --- 9 leaks


def test_p9(spark, data, docs):
    runs = defaultdict(set)
    for r in read(spark, data, "eval_items").collect():
        for g in shingles(r.text, 13):
            runs[g].add(r.item_id)
    assert rows(Q.p9_found(spark, data)) == {(i, item) for i, r in docs.items() for g in shingles(r.text, 13) for item in runs.get(g, ())}


def test_leaks_hostile(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, item), (2, item), (3, "one two three"), (4, None), (5, ""), (6, "the " * 20)], "item_id bigint, text string")
    docs_ = texts(spark, item.upper(), "x " + " ".join(item.split()[1:]), " ".join(item.split()[:12]), None, "", "the " * 5000, " - ".join(item.split()), item.replace("seven", "seven x"))
    want = {(0, 1), (0, 2), (1, 1), (1, 2), (5, 6), (6, 1), (6, 2)}
    assert rows(leak.leaked_items(docs_, items)) == want
    monkeypatch.setattr(leak, "INDEX_BYTES", 3000)
    assert rows(leak.leaked_items(docs_.union(docs_), items)) == want
    assert leak.leaked_items(docs_, items.limit(0)).count() == 0 and leak.leaked_items(docs_.limit(0), items).count() == 0


def leaks_by_force(texts_, items, run):
    own = {i: set(zip(*(words(t)[k:] for k in range(run)))) for i, t in items}
    return sorted((n, i) for n, t in enumerate(texts_) for i in own if own[i] & set(zip(*(words(t)[k:] for k in range(run)))))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_wand_finds_all_and_skips(block):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 30)))) for i in range(80)]
    made = []
    for _ in range(60):
        t = list(rng.choice(vocabulary, 80))
        w = items[rng.integers(0, 80)][1].split()
        k = int(rng.integers(0, 60))
        t[k : k + 6] = w[:6]
        made.append(" ".join(t))
    index = leak.Index(items, run=6, block=block)
    want = leaks_by_force(made, items, 6)
    assert index.leaks(made) == sorted(want, key=lambda x: (x[0], str(x[1]))) and len(want) > 30
    assert index.evaluated < 0.5 * index.passages * len(index.ids)


def test_wand_work_does_not_grow_with_the_items():
    """Ten times the items, of which most share few words with a passage, cost far less than ten times the rounds; the index stays small."""
    rng = np.random.default_rng(9)
    share = 1 / np.arange(1, 40_001)
    share /= share.sum()
    vocabulary = np.array([f"w{i}" for i in range(40_000)])
    items = [(i, " ".join(vocabulary[rng.choice(40_000, 70, p=share)])) for i in range(5_000)]
    made = [" ".join(vocabulary[rng.choice(40_000, 600, p=share)]) for _ in range(60)] + [items[7][1]]
    few, many = leak.Index(items[:500]), leak.Index(items)
    assert (60, 7) in many.leaks(made) and (60, 7) in few.leaks(made)
    assert many.nbytes() < 100e6
    assert many.evaluated / max(many.passages, 1) < 0.02 * len(many.ids)


# --- 10 repetition


def test_p10(spark, data, docs):
    want = set()
    for i, r in docs.items():
        w = words(r.text)
        five = list(zip(*(w[k:] for k in range(5))))
        if len(w) >= 50 and 10 * (len(five) - len(set(five))) >= 3 * len(five):
            want.add((i,))
    assert rows(Q.p10_found(spark, data)) == want


def test_repetition_hostile(spark):
    df = texts(spark, None, "", "word", "a b c d e " * 40, " ".join(map(str, range(300))), "no words: !!! ...", "x " * 100_000)
    got = {r.doc_id: r for r in repeat.repetition(df, "doc_id").collect()}
    assert [got[i].words for i in range(7)] == [0, 0, 1, 200, 300, 2, 100_000]
    assert round(got[3].share, 3) == 0.974 and got[3].candidate and got[6].candidate
    assert all(not got[i].candidate and got[i].share is None for i in (0, 1, 2, 5))
    exact = {r.doc_id: (r.words, round(r.share, 3)) for r in repeat.shares(df, "doc_id").collect()}
    assert exact[0] == exact[1] == (0, 0.0) and exact[3] == (200, 0.974) and exact[4] == (300, 0.0)
    assert repeat.repetition(df.limit(0), "doc_id").count() == 0


def test_trees_choose_what_is_counted(spark, data):
    """Without the trees every document of the least length would be counted; with them few are, and none that counts is lost."""
    df = read(spark, data, "documents")
    scored = repeat.repetition(df, "doc_id").collect()
    wanted = {r.doc_id for r in repeat.shares(df, "doc_id").collect() if r.words >= 50 and r.share >= 0.3}
    counted = {r.doc_id for r in scored if r.candidate}
    assert wanted <= counted and all((r.share is not None) == r.candidate for r in scored)
    assert len(counted) < 0.5 * sum(r.words >= 50 for r in scored)


def test_cheap_statistics_are_bounds():
    """No document has less of a statistic than the corner of its own share and length."""
    rng = np.random.default_rng(10)
    made = []
    for _ in range(300):
        w = list(rng.choice([f"w{i}" for i in range(400)], rng.integers(50, 400)))
        for _ in range(rng.integers(0, 6)):
            k, n = rng.integers(0, len(w) - 20), int(rng.integers(5, 20))
            w += w[k : k + n]
        made.append(" ".join(w))
    c = repeat.counted(made, repeat.Ids())
    for share, n, own in zip(c.shares(), c.words, c.features):
        assert (own >= repeat.corner(share, int(n))[0] - 1e-9).all()


def test_trees_never_fall():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 5))
    y = ((x[:, 0] + 0.2 * x[:, 1] + 0.1 * rng.standard_normal(3000)) > 0.7).astype(float)
    t = repeat.fit(x[:2000], y[:2000])
    assert (((t.score(x[2000:]) > 0) == y[2000:]).mean()) > 0.9
    for f in range(5):
        grid = np.repeat(x[2000:2050], 50, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 50), 50)
        assert (np.diff(t.score(grid).reshape(50, 50), axis=1) >= -1e-12).all()
    assert (repeat.fit(np.zeros((0, 5)), np.zeros(0)).score(x[:3]) == 0).all()
