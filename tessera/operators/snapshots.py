"""What changed between full snapshots: bitmaps of persistent ordinals, and column vectors aligned to them.

Every key gets an ordinal that it keeps in all snapshots, and in later deliveries where the map is stored. A snapshot is then, for each
range of ordinals, a compressed bitmap of the keys that it holds and a vector of digests in the ordinals' order. Added is new AND NOT old,
removed is old AND NOT new, and where both have a bit the digests are compared. A range holds RANGE ordinals, so a task's memory
is bounded whatever the tables' size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

RANGE = 1 << 15


class Bitmap:
    """Ordinals of one range, held as a sorted list where they are few, else as bits: at most RANGE / 8 bytes either way."""

    #: Members from which bits are smaller than a list of 16-bit numbers.
    MANY = RANGE // 16

    def __init__(self, few: np.ndarray | None, bits: np.ndarray | None):
        self.few, self.bits = few, bits

    @staticmethod
    def of(at: np.ndarray) -> Bitmap:
        own = np.unique(at).astype(np.uint16)
        if len(own) < Bitmap.MANY:
            return Bitmap(own, None)
        there = np.zeros(RANGE, bool)
        there[own] = True
        return Bitmap(None, np.packbits(there))

    def members(self) -> np.ndarray:
        return (np.flatnonzero(np.unpackbits(self.bits)) if self.few is None else self.few).astype(np.int64)

    def _of(self, at: np.ndarray) -> np.ndarray:
        """Whether each of the ordinals is a member."""
        if self.few is None:
            return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return np.isin(at, self.few, assume_unique=True)

    def and_not(self, other: Bitmap) -> np.ndarray:
        if self.few is None and other.few is None:
            return np.flatnonzero(np.unpackbits(self.bits & ~other.bits))
        own = self.members()
        return own[~other._of(own)]

    def and_(self, other: Bitmap) -> np.ndarray:
        if self.few is None and other.few is None:
            return np.flatnonzero(np.unpackbits(self.bits & other.bits))
        small, large = (self, other) if self.few is not None else (other, self)
        own = small.members()
        return own[large._of(own)]


def ordinals(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, ordinal): dense numbers from 0 for the different keys that aren't null.

    ``known`` (key, ordinal) is an earlier result: its keys keep their ordinals and new ones come after them. Numbering takes a sort
    by key in many tasks and a sum over the partitions' counts; no task sees all keys.
    """
    fresh = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    start = 0
    if known is not None:
        fresh = fresh.join(known, key, "left_anti")
        last = known.agg(F.max("ordinal")).first()[0]
        start = 0 if last is None else last + 1
    placed = cut(fresh.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n") + start).alias("__before"))  # a row per partition
    numbered = placed.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(key))).join(before, "__part").select(key, (F.col("__before") + F.col("__row") - 1).alias("ordinal"))
    return numbered if known is None else known.select(key, "ordinal").unionByName(numbered)


def snapshot_changes(df: DataFrame, snapshot: str = "snapshot_id", key: str = "doc_id", values: tuple[str, ...] = ("text",), latest: str = "fetched_at", known: DataFrame | None = None) -> DataFrame:
    """(snapshot, key, change): what each existing snapshot added, removed or changed against the one before it.

    If a key appears more than once in a snapshot, the row with the greatest ``latest`` counts (null is least; then the greatest digest).
    Changed: any of ``values`` differs in any character, or is null in one only; null and the empty text differ. The
    first snapshot yields no rows. Rows whose snapshot or key is null are left out. Texts are digested (128 bits) before anything is
    shuffled, and copies of a key combine in their own task first.
    """
    digest = F.md5(F.concat_ws("\x1e", *(F.coalesce(F.concat(F.lit("v"), F.length(v), F.lit(":"), F.col(v)), F.lit("n")) for v in values)))
    halves = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint").alias(n) for i, n in enumerate("pq")]
    rows = df.filter(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(snapshot, key, F.col(latest).alias("__at"), *halves)
    current = cut(rows.groupBy(snapshot, key).agg(F.max(F.struct("__at", "p", "q")).alias("m")).select(snapshot, key, "m.p", "m.q"))
    order = current.select(snapshot).distinct().withColumn("pair", F.row_number().over(Window.orderBy(snapshot)))  # a row per snapshot
    numbers = cut(ordinals(current, key, known))
    placed = current.join(F.broadcast(order), snapshot).join(numbers, key).select("pair", "ordinal", "p", "q")
    # a snapshot is the new side of its own pair and the old side of the next
    sides = placed.select(F.floor(F.col("ordinal") / RANGE).alias("block"), (F.col("ordinal") % RANGE).cast("int").alias("at"), "p", "q", F.explode(F.array(F.struct("pair", F.lit(True).alias("new")), F.struct((F.col("pair") + 1).alias("pair"), F.lit(False).alias("new")))).alias("side"))
    sides = sides.select("block", "side.pair", "side.new", "at", "p", "q")

    def compare(group: tuple, t: pa.Table) -> pa.Table:
        block, pair = group[0].as_py(), group[1].as_py()
        at, new = t.column("at").to_numpy(), t.column("new").to_numpy(zero_copy_only=False)
        old_side, now_side = (Bitmap.of(at[new == side]) for side in (False, True))
        added, removed, common = now_side.and_not(old_side), old_side.and_not(now_side), now_side.and_(old_side)
        # vectors of digests in the order of the ordinals; a place in them is the number of ordinals below
        digests = np.column_stack([t.column(n).to_numpy() for n in "pq"])
        vectors = [digests[new == side][np.argsort(at[new == side], kind="stable")] for side in (False, True)]
        old_ats, now_ats = old_side.members(), now_side.members()
        differ = vectors[0][np.searchsorted(old_ats, common)] != vectors[1][np.searchsorted(now_ats, common)]
        changed = common[differ.any(axis=1)]
        where = np.concatenate([added, removed, changed]).astype(np.int64)
        return pa.table({"pair": pa.array(np.full(len(where), pair), pa.int32()), "ordinal": block * RANGE + where, "change": ["added"] * len(added) + ["removed"] * len(removed) + ["changed"] * len(changed)})

    found = sides.groupBy("block", "pair").applyInArrow(compare, "pair int, ordinal bigint, change string")
    # pair 1 has no older side, and beyond the last there is no snapshot
    return found.filter("pair > 1").join(F.broadcast(order), "pair").join(numbers, "ordinal").select(snapshot, key, "change")


def stored_ordinals(keys: DataFrame, key: str, path: str) -> DataFrame:
    """(key, ordinal) for all keys met so far, kept as parquet under ``path``: what is there stays, and new keys are appended.

    Every delivery is numbered through it before it is compared, with ``snapshot_changes(..., known=...)``. Only one writer at a time. A
    job that failed while it appended leaves nothing behind, as the rows of one append come into being together.
    """
    spark = keys.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.parquet(path) if there else None
    numbered = ordinals(keys, key, known)
    fresh = numbered if known is None else numbered.join(known, key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)
