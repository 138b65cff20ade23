"""Near-duplicate texts: fingerprints in vantage-point trees, and exact comparison of what the trees find.

A text is the set of its runs of ``gram`` words. Its minimum hashes under BANDS * ROWS hash functions give two things: a
64-bit fingerprint (a bit of each minimum), whose Hamming distance from another's is expected to be 32 * (1 - similarity),
and band keys (ROWS minima together).

Fingerprints of unrelated texts all lie near distance 32 from one another, so a vantage-point tree over the whole collection could
not prune anything: every shard would lie across every boundary. So the band keys make the shards: similar texts agree in at
least one band, unrelated ones hardly ever. Within a shard the fingerprints are kept in a vantage-point tree and each is
searched within RADIUS, with branches pruned by the triangle inequality. A shard that holds more than HOT fingerprints is cut
into blocks, and every pair of blocks is a task of its own: the trees of one block are queried with the other's fingerprints.

Only pairs of fingerprints within the radius go on, each once; their texts are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeat import _distinct
from tessera.llm.words import Ids, flat_ids, grams, words
from tessera.operators.filters import maybe_in
from tessera.session import cut, spread

BANDS, ROWS, RADIUS = 32, 4, 23
#: Fingerprints of a shard that one task takes at most; beyond, it is cut into blocks.
HOT = 20_000
#: Different texts of one fingerprint that one task joins at most.
PER_TASK = 1_000
LEAF = 32

_rng = np.random.default_rng(20240901)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FULL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, 32-bit band keys) of each set of hashes; every set must have a member."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    n = len(bounds) - 1
    least = np.empty((n, len(_A)), np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B)):
        least[:, i] = np.minimum.reduceat(low * a + b, bounds[:-1])
    bits = (_mixed(least[:, :64].astype(np.uint64) + (np.arange(64, dtype=np.uint64) << np.uint64(32))) >> np.uint64(40)) & np.uint64(1)
    prints = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
    for r in range(ROWS):
        keys = _mixed(keys * _FULL + least[:, r::ROWS])
    return prints.view(np.int64), (keys >> np.uint64(32)).astype(np.uint32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16)  # of a signed number it would count the absolute value


class VantagePoints:
    """A vantage-point tree over 64-bit fingerprints."""

    def __init__(self, prints: np.ndarray, leaf: int = LEAF):
        self.prints = np.unique(prints)
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(self.prints)), leaf)

    def _grow(self, at: np.ndarray, leaf: int) -> int:
        if len(at) <= leaf:
            self.nodes.append((None, at))
            return len(self.nodes) - 1
        point = self.prints[at[len(at) // 2]]
        d = distances(self.prints[at], point)
        middle = int(np.median(d))
        inside = d <= middle
        if inside.all():
            inside = d < middle
        near, far = self._grow(at[inside], leaf), self._grow(at[~inside], leaf)
        self.nodes.append((point, int(d[inside].max(initial=0)), int(d[~inside].min(initial=64)), near, far))
        return len(self.nodes) - 1

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, found) for all fingerprints within the radius; all queries go down the tree together."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(self.root, queries)]
        while stack:
            i, q = stack.pop()
            node = self.nodes[i]
            if node[0] is None:
                for lo in range(0, len(q), 65_536):
                    own = q[lo : lo + 65_536]
                    r, c = np.nonzero(distances(own[:, None], self.prints[node[1]][None, :]) <= radius)
                    out.append((own[r], self.prints[node[1]][c]))
                continue
            point, inner, outer, near, far = node
            d = distances(q, point)
            for child, keep in ((near, d <= inner + radius), (far, d >= outer - radius)):
                if keep.any():
                    stack.append((child, q[keep]))
        return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (queries[:0], queries[:0])


def _close(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of fingerprints that share a key and lie within the radius. Both arrays are ordered by key, then fingerprint."""
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    keys, prints = keys[first], prints[first]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    small = np.repeat(sizes <= LEAF, sizes)
    for step in range(1, LEAF):  # shards that would be a single leaf, all at once
        i = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step])) if len(keys) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[distances(prints[i], prints[i + step]) <= radius]
        a.append(prints[i])
        b.append(prints[i + step])
    for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        q, f = VantagePoints(prints[s : s + n]).within(prints[s : s + n], radius)
        a.append(q[q < f])
        b.append(f[q < f])
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def fingerprints(df: DataFrame, gram: int, least: int) -> DataFrame:
    """(g, id, t, f, bands) of the rows (g, text, id) whose text has at least ``least`` different runs. t: hash of the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                flat, offsets = flat_ids(part.column(1).to_pylist(), ids)
                runs, bounds = grams(flat, offsets, gram)
                enough = _distinct(runs, bounds) >= max(least, 1)
                if not enough.any():
                    continue
                own = np.repeat(enough, np.diff(bounds))
                prints, keys = signatures(runs[own], np.concatenate([[0], np.cumsum(np.diff(bounds)[enough])]))
                place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
                exact = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(flat + place.astype(np.uint64) * _FULL))])
                t = (exact[offsets[1:]] - exact[offsets[:-1]])[enough].view(np.int64)
                rows = pa.array(np.flatnonzero(enough))
                packed = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(2).take(rows), pa.array(t), pa.array(prints), packed], names=["g", "id", "t", "f", "bands"])

    return spread(df).mapInArrow(run, f"g string, id {df.schema['id'].dataType.simpleString()}, t bigint, f bigint, bands binary")


def _candidates(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """(g, fa, fb), fa < fb: different fingerprints within the radius that share a band."""
    spark = prints.sparkSession
    salted = cut(prints.select(F.xxhash64("g").alias("s"), "f", "bands"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                if part.num_rows:
                    keys = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(part.num_rows, BANDS).astype(np.uint64)
                    keys += np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
                    s = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                    # a key is made for each group and band, so they never meet
                    yield _mixed(keys ^ s[:, None]).view(np.int64).ravel(), np.repeat(part.column(1).to_numpy(zero_copy_only=False), BANDS)

    parts = max(1, salted.rdd.getNumPartitions())

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key with more than ``hot`` rows has more than hot / parts in some partition
        got = [k for k, _ in unpack(batches)]
        keys, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        many = n > hot / parts
        yield pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(n[many])], names=["key", "n"])

    crowded = cut(salted.mapInArrow(often, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > hot / 2))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f in unpack(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f)], names=["key", "f"])

    rows = salted.mapInArrow(explode, "key bigint, f bigint")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            k = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([prints, b.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])  # the last shard may go on in the next batch
            x, y = _close(k[:last], f[:last], radius)
            keys, prints = k[last:], f[last:]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["fa", "fb"])
        x, y = _close(keys, prints, radius)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["fa", "fb"])

    pairs = "fa bigint, fb bigint"
    if crowded.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key", "f").mapInArrow(shard, pairs).distinct()
    calm = rows.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key", "f").mapInArrow(shard, pairs)

    def block_pair(key: tuple, t: pa.Table) -> pa.Table:
        f, side = t.column("f").to_numpy(), t.column("block").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        q, x = VantagePoints(f[side == j]).within(np.unique(f[side == i]), radius)
        q, x = np.minimum(q, x), np.maximum(q, x)
        return pa.table({"fa": q[q < x], "fb": x[q < x]})

    crowd = rows.join(crowded, "key").withColumn("blocks", F.ceil(F.col("n") / hot)).withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")))
    crowd = crowd.dropDuplicates(["key", "f"])
    i, j = F.least("block", "other"), F.greatest("block", "other")
    blocks = crowd.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("key", i.alias("i"), j.alias("j"), "f", "block")
    return calm.unionByName(blocks.groupBy("key", "i", "j").applyInArrow(block_pair, pairs)).distinct()


def near_duplicates(
    df: DataFrame, item: str = "chunk_id", group: str = "strategy", text: str = "text", gram: int = 5, threshold: float = 0.8, least: int = 1, radius: int = RADIUS, hot: int = HOT, per_task: int = PER_TASK
) -> tuple[DataFrame, DataFrame]:
    """Two tables: members (g, t, id), and links (g, ta, tb, similarity), ta < tb, between different texts.

    t is the hash of a text's words, so texts with equal words are one class and have one t. A link says that two classes'
    sets of runs of ``gram`` words overlap by at least ``threshold`` of their union; both sets have at least ``least``
    members. Links are between classes: copies aren't expanded. Null and empty texts, and texts with too few runs, are no
    members. Repeated rows count once. Rows with a null item or group are left out. A pair at exactly 0.7 shares no band with
    a probability of 2e-4 and lies beyond the radius with one of 1e-5; both fall fast with the similarity.
    """
    rows = df.filter(F.col(item).isNotNull() & F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(text).alias("text"), F.col(item).alias("id"))
    index = cut(fingerprints(rows, gram, least))
    classes = cut(index.groupBy("g", "f", "t").agg(F.min("id").alias("id")))
    alike = cut(classes.groupBy("g", "f").agg(F.count("*").alias("n")).filter("n > 1"))
    pairs = _candidates(index.select("g", "f", "bands").distinct(), radius, hot).unionByName(alike.select(F.col("f").alias("fa"), F.col("f").alias("fb")).distinct())
    # a fingerprint that very many different texts have: one side of its join is dealt out in parts, the other goes to every part
    many = alike.filter(F.col("n") > per_task).select("g", "f", F.ceil(F.col("n") / per_task).alias("parts"))
    dealt = classes.withColumn("parts", F.lit(1)) if many.isEmpty() else classes.join(many, ["g", "f"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))
    a = dealt.select("g", F.col("f").alias("fa"), F.col("t").alias("ta"), F.col("id").alias("ida"))
    b = dealt.select("g", F.col("f").alias("fb"), F.col("t").alias("tb"), F.col("id").alias("idb"), F.pmod(F.xxhash64("t"), F.col("parts")).alias("part"))
    sides = pairs.join(a, "fa")
    if not many.isEmpty():
        wide = many.select("g", F.col("f").alias("fb"), "parts")
        sides = sides.join(wide, ["g", "fb"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", every).drop("parts")
    else:
        sides = sides.withColumn("part", F.lit(0).cast("bigint"))
    compared = cut(sides.join(b, ["g", "fb", "part"]).filter("fa <> fb OR ta < tb").filter("ta <> tb").select("g", "ta", "tb", "ida", "idb"))
    needed = compared.select(F.explode(F.array("ida", "idb")).alias("id")).distinct()
    texts = maybe_in(rows, F.col("id"), needed, "id").join(needed, "id").groupBy("g", "id").agg(F.max("text").alias("text"))
    both = compared.join(texts.withColumnsRenamed({"id": "ida", "text": "xa"}), ["g", "ida"]).join(texts.withColumnsRenamed({"id": "idb", "text": "xb"}), ["g", "idb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set] = {}

        def runs(t: int, text: str) -> set:
            if t not in kept:
                if len(kept) >= 2_000:
                    kept.clear()
                w = words(text)
                kept[t] = set(zip(*(w[k:] for k in range(gram))))
            return kept[t]

        for x in batches:
            rows, found = [], []
            for i, (ta, tb, xa, xb) in enumerate(zip(*(x.column(k).to_pylist() for k in range(1, 5)))):
                p, q = runs(ta, xa), runs(tb, xb)
                common = len(p & q)
                union = len(p) + len(q) - common
                if common and common >= threshold * union - 1e-9 and min(len(p), len(q)) >= least:
                    rows.append(i)
                    found.append(common / union)
            yield pa.RecordBatch.from_arrays([*x.take(pa.array(rows, pa.int64())).columns[:3], pa.array(found, pa.float64())], names=["g", "ta", "tb", "similarity"])

    links = both.select("g", "ta", "tb", "xa", "xb").mapInArrow(compare, "g string, ta bigint, tb bigint, similarity double")
    links = links.select("g", F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb"), "similarity").distinct()
    return index.select("g", "t", "id").distinct(), links


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of items that are in one class or in linked classes."""
    a, b = members.select("g", F.col("t").alias("ta"), F.col("id").alias("x")), members.select("g", F.col("t").alias("tb"), F.col("id").alias("y"))
    many = members.groupBy("g", "t").agg(F.count("*").alias("n")).filter("n > 1").select("g", F.col("t").alias("ta"), F.col("t").alias("tb"))
    pairs = links.select("g", "ta", "tb").unionByName(many).join(a, ["g", "ta"]).join(b, ["g", "tb"]).filter("ta <> tb OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links, group_id): one row for each member; groups are what links hold together, directly or through others.

    The least class id spreads along the links, and each round also jumps to the label of its label, so the rounds
    grow with the logarithm of a group's width. Nothing is collected; each round is written to the checkpoint folder.
    """
    edges = cut(links.select("g", "ta", "tb").unionByName(links.select("g", F.col("tb").alias("ta"), F.col("ta").alias("tb"))))
    degree = edges.groupBy("g", "ta").agg(F.count("*").alias("links"))
    label = cut(degree.select("g", F.col("ta").alias("t"), F.col("ta").alias("l")))
    while True:
        seen = edges.join(label.withColumnsRenamed({"t": "tb", "l": "m"}), ["g", "tb"]).groupBy("g", "ta").agg(F.min("m").alias("m"))
        near = label.join(seen.withColumnRenamed("ta", "t"), ["g", "t"]).select("g", "t", "l", F.least("l", "m").alias("n"))
        jump = near.join(label.select("g", F.col("t").alias("n"), F.col("l").alias("far")), ["g", "n"], "left").select("g", "t", "l", F.least("n", "far").alias("n"))
        jump = cut(jump)
        label = jump.select("g", "t", F.col("n").alias("l"))
        if jump.filter("n <> l").isEmpty():
            break
    named = degree.withColumnRenamed("ta", "t").join(label, ["g", "t"])
    return members.join(named, ["g", "t"], "left").select("id", F.col("t").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("l", "t").alias("group_id"))
