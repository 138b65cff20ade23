"""The most similar vectors of every vector: a forest of random-projection trees with one priority queue.

1. A forest of TREES trees is fitted on a sample. A node's plane stands between the centres of two groups that grow from two random
   rows, at the place with the fewest rows in its margin, so planes run where few close pairs lie. A node is split until its
   leaf is expected to hold ``cell`` vectors, to any depth.
2. Every vector goes to its leaf in each tree. All planes on its ways down wait in one queue over all trees; the PROBES nearest ones are
   crossed too, if they lie within the margin, and the leaf behind each is visited. So no vector has more than TREES + PROBES
   copies, whatever the depth of the trees.
3. A leaf is a task: its own vectors are compared exactly with one another and with the visitors, and the best k of each remain; a
   pair met from one side counts for the other too. The best k over all leaves are the result.
4. A plane through a crowded topic would part neighbours whatever its place. A node most of whose rows are near each other
   stays one leaf up to ``dense`` vectors, and is compared as a whole.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Vectors that a leaf is laid out for, visitors included, and that a leaf of one crowded topic may hold.
CELL, DENSE = 16_384, 131_072
#: The part of it that a leaf's own vectors may take up.
FILL = 0.55
#: Trees of the forest; leaves that a vector visits from the queue.
TREES, PROBES = 2, 1
#: Sample rows: a leaf at least, for all leaves together at least, and at once on the driver at most.
LEAF_ROWS, LEAST_ROWS, FIT_ROWS = 128, 20_000, 131_072
#: Planes of which the best becomes a node's.
TRIES = 32
#: Half-width of the margin in standard deviations of a close pair's projected difference.
MARGIN = 0.6
#: Bytes of planes that are broadcast at most; with more vectors than these can part, leaves are laid out larger.
PLANES = 1 << 30


class Tree:
    """Planes in flat arrays. A child below 0 is the leaf -child - 1."""

    def __init__(self, w: np.ndarray, t: np.ndarray, child: np.ndarray, leaves: int):
        self.w, self.t, self.child, self.leaves = w, t, child, leaves

    def step(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Signed distances from the planes at ``node``."""
        return np.einsum("ij,ij->i", x, self.w[node]) - self.t[node]

    def down(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaves below the given nodes."""
        node = node.copy()
        while len(at := np.flatnonzero(node >= 0)):
            node[at] = self.child[node[at], (self.step(x[at], node[at]) > 0).astype(int)]
        return -node - 1

    def ways(self, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, gap, other): each row's leaf, and for the ``keep`` nearest planes on its way the distance and the node behind."""
        n = len(x)
        node = np.full(n, 0 if len(self.t) else -1)
        gap, other = np.full((n, keep), np.inf, np.float32), np.full((n, keep), -1)
        while len(at := np.flatnonzero(node >= 0)):
            d = self.step(x[at], node[at])
            right = (d > 0).astype(int)
            near = np.concatenate([gap[at], np.abs(d)[:, None]], axis=1)
            behind = np.concatenate([other[at], self.child[node[at], 1 - right][:, None]], axis=1)
            order = np.argsort(near, axis=1, kind="stable")[:, :keep]
            gap[at], other[at] = np.take_along_axis(near, order, 1), np.take_along_axis(behind, order, 1)
            node[at] = self.child[node[at], right]
        return -node - 1, gap, other

    def joined(self, below: dict[int, Tree]) -> Tree:
        """The tree with some of its leaves replaced by trees."""
        w, t, child, leaves = [self.w], [self.t], self.child.copy(), self.leaves
        added = []
        for leaf, sub in below.items():
            if not len(sub.t):
                continue
            shift = sum(map(len, t))
            codes = np.where(sub.child >= 0, sub.child + shift, sub.child - leaves)
            leaves += sub.leaves
            w.append(sub.w)
            t.append(sub.t)
            added.append(codes)
            child[child == -leaf - 1] = shift
        return Tree(np.concatenate(w), np.concatenate(t), np.concatenate([child, *added]), leaves)

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, w=self.w, t=self.t, child=self.child, leaves=self.leaves)
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Tree:
        f = np.load(io.BytesIO(data))
        return Tree(f["w"], f["t"], f["child"], int(f["leaves"]))


def _plane(x: np.ndarray, margin: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """Of a few planes between two random rows' groups the one with the fewest rows in its margin, near the middle if it can be."""
    best = None
    for _ in range(TRIES):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(3):
            w = a - b
            side = x @ w > (a + b) @ w / 2
            if side.all() or not side.any():
                break
            a, b = x[side].mean(axis=0), x[~side].mean(axis=0)
        w = a - b
        if (size := np.linalg.norm(w)) < 1e-6:
            continue
        w = (w / size).astype(np.float32)
        p = np.sort(x @ w)
        share = np.linspace(0.25, 0.75, 21)
        at = p[(share * (len(p) - 1)).astype(int)]
        crossed = (np.searchsorted(p, at + margin) - np.searchsorted(p, at - margin)) / len(p) + 0.15 * np.abs(share - 0.5)
        i = int(np.argmin(crossed))
        if p[0] <= at[i] < p[-1] and (best is None or crossed[i] < best[0]):
            best = (crossed[i], w, float(at[i]))
    return best and best[1:]


def grow(x: np.ndarray, total: float, cell: int, least: float, margin: float, seed: int, dense: int = DENSE) -> tuple[Tree, list[int]]:
    """A tree over ``total`` vectors of which the rows of x are a sample, and the leaves that need a larger sample to be split on."""
    rng = np.random.default_rng(seed)
    w: list[np.ndarray] = []
    t: list[float] = []
    child: list[list[int]] = []
    open_: list[int] = []
    leaves = 0
    stack = [(np.arange(len(x)), -1, 0)]  # rows, parent, side
    while stack:
        rows, parent, side = stack.pop()
        size = len(rows) * total / max(len(x), 1)
        own = x[rows if len(rows) <= 2048 else rows[:: -(-len(rows) // 2048)]]
        plane = None
        if size > FILL * cell and len(rows) >= 8:
            some = own[:256]
            crowded = size <= dense and np.mean(some @ some.T >= 2 * least - 1) > 0.5
            plane = None if crowded else _plane(own, margin, rng)
            if plane and len(rows) < LEAF_ROWS and size > cell and len(x) < total:
                open_.append(leaves)
                plane = None
        if plane is None:
            code = -leaves - 1
            leaves += 1
        else:
            code = len(t)
            w.append(plane[0])
            t.append(plane[1])
            child.append([0, 0])
            right = x[rows] @ plane[0] > plane[1]
            stack += [(rows[~right], code, 0), (rows[right], code, 1)]
        if parent >= 0:
            child[parent][side] = code
    dim = x.shape[1]
    return Tree(np.array(w, np.float32).reshape(-1, dim), np.array(t, np.float32), np.array(child, np.int64).reshape(-1, 2), leaves), open_


def route(trees: list[Tree], x: np.ndarray, margin: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf, home): every row's leaf in each tree, and the leaves behind the nearest planes from one queue over all trees."""
    n = len(x)
    ways = [t.ways(x, probes) for t in trees]
    rows, tree = [np.tile(np.arange(n), len(trees))], [np.repeat(np.arange(len(trees)), n)]
    leaf, home = [np.concatenate([w[0] for w in ways])], [np.ones(n * len(trees), bool)]
    gap, other = np.concatenate([w[1] for w in ways], axis=1), np.concatenate([w[2] for w in ways], axis=1)
    order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
    for k in range(order.shape[1]):
        i, j = np.flatnonzero(gap[np.arange(n), order[:, k]] < margin), order[:, k]
        at = j[i] // probes
        found = np.zeros(len(i), np.int64)
        for t, own in enumerate(trees):
            mine = at == t
            found[mine] = own.down(x[i[mine]], other[i[mine], j[i[mine]]])
        rows.append(i)
        tree.append(at)
        leaf.append(found)
        home.append(np.zeros(len(i), bool))
    return np.concatenate(rows), np.concatenate(tree), np.concatenate(leaf), np.concatenate(home)


def _upper(q: np.ndarray, x: np.ndarray, want: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of x): the best ``want`` rows of x of each row of q, at least ``least`` similar, in single precision."""
    rows, cols = [], []
    step = max(16, (1 << 22) // max(len(x), 1))
    for lo in range(0, len(q), step):
        s = q[lo : lo + step] @ x.T
        mask = s >= least
        many = np.flatnonzero(np.count_nonzero(mask, axis=1) > want)
        if len(many):
            own = s[many]
            mask[many] = own >= np.partition(own, own.shape[1] - want, axis=1)[:, own.shape[1] - want, None]
        r, c = np.nonzero(mask)
        over = np.bincount(r, minlength=len(s)) > want  # many equally similar ones: the first are as good as any
        if over.any():
            place = np.arange(len(r)) - np.searchsorted(r, r)
            strict = s[r, c] > np.where(over, np.where(mask, s, 9).min(axis=1), -9)[r]
            ok = strict | (place < 4 * want)
            r, c = r[ok], c[ok]
        rows.append(r + lo)
        cols.append(c)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(x: np.ndarray, home: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) within one leaf: the best k of each row among those met; visitors don't meet one another."""
    own, guests = np.flatnonzero(home), np.flatnonzero(~home)
    order = np.concatenate([own, guests])
    y = x[order]
    a, b = _upper(y[: len(own)], y, k + 5, least - 1e-4)
    c, d = _upper(y[len(own) :], y[: len(own)], k + 5, least - 1e-4)
    a, b = np.concatenate([a, c + len(own), b, d]), np.concatenate([b, d, a, c + len(own)])
    pairs = np.unique(a[a != b] * len(x) + b[a != b])
    a, b = order[pairs // max(len(x), 1)], order[pairs % max(len(x), 1)]
    s = np.concatenate([np.einsum("ij,ij->i", x[a[lo : lo + 100_000]].astype(np.float64), x[b[lo : lo + 100_000]].astype(np.float64)) for lo in range(0, len(a), 100_000)] or [np.zeros(0)])
    s = np.round(s, 7)
    a, b, s = a[s >= least], b[s >= least], s[s >= least]
    at = np.lexsort((b, -s, a))
    a, b, s = a[at], b[at], s[at]
    best = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[best], b[best], s[best]


def _forests(sample: DataFrame, totals: dict[str, int], dim: int, cell: int, least: float, margin: float, trees: int, dense: int, fit_rows: int) -> dict[str, list[Tree]]:
    """The forest of each group in ``totals``, fitted on (g, x), a sample of its vectors.

    Up to ``fit_rows`` rows of a group are taken to the driver. Leaves that these are too few for get trees of their own, fitted in
    tasks over the whole sample; only planes come back, whose number is that of the leaves.
    """
    out: dict[str, list[Tree]] = {}
    for g, n in sorted(totals.items()):
        held = sample.filter(F.col("g") == g)
        rows = held.count()
        some = held if rows <= fit_rows else held.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int(0.9 * fit_rows / rows * (1 << 20)))
        part = some.limit(fit_rows).toPandas()
        x = np.frombuffer(b"".join(part.x), np.float32).reshape(-1, dim)
        forest = [grow(x, n, cell, least, margin, 100 + t, dense) for t in range(trees)]
        opened = [set(o) for _, o in forest]
        if any(opened):
            first = [t for t, _ in forest]

            def deeper(batches: Iterator[pa.RecordBatch], first=first, opened=opened) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    y = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, dim)
                    for t, tree in enumerate(first):
                        leaf = tree.down(y, np.full(len(y), 0 if len(tree.t) else -1))
                        own = np.flatnonzero(np.isin(leaf, list(opened[t])))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array(leaf[own]), b.column(0).take(pa.array(own))], names=["tree", "leaf", "x"])

            share = n / max(rows, 1)

            def fitted(key: tuple, t: pa.Table) -> pa.Table:
                y = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, dim)
                sub, _ = grow(y, len(y) * share, cell, least, margin, 1000 + key[0].as_py() * 7919 + key[1].as_py(), dense)
                return pa.table({"tree": [key[0].as_py()], "leaf": [key[1].as_py()], "planes": [sub.dumped()]})

            more = held.select("x").mapInArrow(deeper, "tree bigint, leaf bigint, x binary").groupBy("tree", "leaf").applyInArrow(fitted, "tree bigint, leaf bigint, planes binary").collect()
            out[g] = [tree.joined({r.leaf: Tree.loaded(bytes(r.planes)) for r in more if r.tree == t}) for t, tree in enumerate(first)]
        else:
            out[g] = [t for t, _ in forest]
    return out


def nearest(
    vectors: DataFrame, groups: list[str], item: str = "chunk_id", vec: str = "vec", k: int = 5, least: float = 0.85, dim: int = 64,
    cell: int = CELL, margin: float = MARGIN, trees: int = TREES, probes: int = PROBES, dense: int = DENSE, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(a, b, cosine): b is among the k most similar other items of a in its group, and their cosine is at least ``least``.

    Only vectors of ``dim`` values, none of them null or NaN, that aren't all zero take part; rows with a null item or group neither.
    Repeated rows count once. Cosines are rounded to 7 places; of equal ones the smaller id comes first, so an item whose
    vector many others share still has at most k partners. An item may have less than k partners. ``least`` is also what the margin is
    laid out for. The sample fixes only where planes cut; every vector is indexed and every vector is a query. A crowded topic
    of more than ``dense`` vectors is split like anything else and loses recall.

    The vectors are read twice: for ids, hashes and the sample, which are written to the checkpoint folder (jobs that run while the
    query is built), and for the leaves.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.concat_ws("\x1f", *groups).alias("g"), F.col(item).alias("id"), F.col(vec).alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") == dim) & F.expr(" AND ".join(f"`{g}` IS NOT NULL" for g in groups))
    )

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            x = np.ascontiguousarray((x[ok] / norm[ok][:, None]).astype(np.float32))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), raw], names=["g", "id", "x"])

    units = given.mapInArrow(unit, f"g string, id {given.schema['id'].dataType.simpleString()}, x binary")
    units = units.withColumn("h", F.xxhash64("g", "x"))
    n = vectors.count()  # of parquet, from the footers alone
    cell = max(cell, int(n * trees * (4 * dim + 24) / (FILL * PLANES)))
    share = min(1.0, max(LEAF_ROWS / (FILL * cell), LEAST_ROWS / max(n, 1)))
    sampled = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30))
    known = cut(units.select("g", "id", "h", F.when(sampled, F.col("x")).alias("x")))
    totals = {r["g"]: r["n"] for r in known.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > FILL * cell).collect()}  # at most n / cell groups
    chord = float(np.sqrt(max(2 - 2 * least, 0)))
    width = margin * chord / float(np.sqrt(dim))
    forests = _forests(known.filter("x IS NOT NULL").select("g", "x"), totals, dim, cell, least, width, trees, dense, fit_rows)
    planes = spark.sparkContext.broadcast(forests)  # within PLANES

    # equal vectors meet in their leaf. Of one that very many rows share only the first goes there; by the threshold these are 100,000 at most
    often = max(1000, n // 100_000)
    hot = known.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") > often).select("h", "first")
    nodes = units.join(F.broadcast(hot), "h", "left").filter(F.col("first").isNull() | (F.col("id") == F.col("first"))).select("g", "h", "x")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column(0).dictionary_encode()
            code = group.indices.to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, dim)
            parts = []
            for i, g in enumerate(group.dictionary.to_pylist()):
                own = np.flatnonzero(code == i)
                if g in planes.value:
                    r, t, leaf, home = route(planes.value[g], x[own], width, probes)
                else:
                    r, t, leaf, home = np.arange(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.ones(len(own), bool)
                # a leaf's number holds its group, tree and place; as a hash it is as short as can be in the largest exchange
                named = (leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
                parts.append((own[r], (named ^ np.uint64(xxhash.xxh3_64_intdigest(g))).view(np.int64), home))
            if not parts:
                continue
            rows, leaf, home = (np.concatenate(p) for p in zip(*parts))
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(home), taken.column(1), taken.column(2)], names=["leaf", "home", "h", "x"])

    def within(t: pa.Table) -> pa.Table:
        h, home = t.column("h").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, dim)
        order = np.lexsort((~home, h))
        first = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])] if len(h) else order
        a, b, s = search(np.ascontiguousarray(x[first]), home[first], k, least)
        return pa.table({"ha": h[first][a], "hb": h[first][b], "cosine": s})

    edges = nodes.mapInArrow(spread, "leaf bigint, home boolean, h bigint, x binary").groupBy("leaf").applyInArrow(within, "ha bigint, hb bigint, cosine double")
    edges = edges.dropDuplicates(["ha", "hb"])
    edges = edges.withColumn("r", F.row_number().over(Window.partitionBy("ha").orderBy(F.desc("cosine"), "hb"))).filter(f"r <= {k}").drop("r")
    # equal vectors: the first k + 1 ids of each; Spark cuts the ranks within each task before it shuffles
    heads = known.select("h", "id").withColumn("r", F.dense_rank().over(Window.partitionBy("h").orderBy("id"))).filter(f"r <= {k + 1}").dropDuplicates(["h", "r"])
    ids = cut(heads.select("h", "id", "r"))
    shared = ids.filter("r = 2").select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(1.0).alias("cosine"))
    a = ids.select(F.col("h").alias("ha"), F.col("id").alias("a"))
    b = ids.select(F.col("h").alias("hb"), F.col("id").alias("b"))
    # the copies beyond the first k + 1 of a vector have the first k as their partners
    crowded = ids.filter(f"r = {k + 1}").select("h")
    rest = known.select("h", "id").join(crowded, "h").join(ids.select("h", "id"), ["h", "id"], "left_anti").distinct()
    more = rest.select(F.col("h").alias("hb"), F.col("id").alias("a")).join(ids.filter(f"r <= {k}").select(F.col("h").alias("hb"), F.col("id").alias("b")), "hb").select("a", "b", F.lit(1.0).alias("cosine"))
    best = (
        edges.unionByName(shared).join(a, "ha").join(b, "hb").filter("a <> b")
        .withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).filter(f"r <= {k}")
        .select("a", "b", "cosine")
    )
    return best.unionByName(more)
