"""One ranking from several scores by reciprocal rank fusion.

Every score is ranked on its own within its group, so that its scale, direction and outliers don't matter; the ranks' inverses
are summed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import HOT_ROWS, rank_in_groups
from tessera.session import cut

K = 60
#: Rows of one search that are compared one after another in a task.
FOLD = 1_000


def fuse_scores(df: DataFrame, group: str, item: str, higher: list[str], lower: list[str], k: int = K, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, r_<score> for each score, rrf, fused_rank, n): one row for each (group, item); n is the group's number of items.

    ``higher`` names the scores where more is better, ``lower`` those where less is. Equal values share the best of their ranks.
    A null or NaN score has no rank and adds nothing; an item without any score has rrf 0. Of several rows of one item,
    each score's best counts, so exact repeats count once. Equal sums are ordered by item. Rows whose group or item is null
    are left out. All ranks of a group take one exchange; only groups of more than ``hot_rows`` items are ranked in slices.
    """
    best = [F.max(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in higher] + [F.max(F.nanvl(-F.col(c).cast("double"), F.lit(None))).alias(c) for c in lower]
    fields = [*higher, *lower]
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*best)
    large = cut(rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows))
    total = sum((F.coalesce(1 / (F.lit(k) + F.col(f"r_{c}")), F.lit(0.0)) for c in fields), F.lit(0.0))
    kept = [group, item, *(f"r_{c}" for c in fields), "rrf"]

    def calm(some: DataFrame) -> DataFrame:
        own = Window.partitionBy(group)
        ranked = some.repartition(group).withColumns(
            {f"r_{c}": F.when(F.col(c).isNotNull(), F.rank().over(own.orderBy(F.desc_nulls_last(c)))) for c in fields} | {"n": F.count("*").over(own)}
        )
        ranked = ranked.withColumn("rrf", total)
        return ranked.select(*kept, F.row_number().over(own.orderBy(F.desc("rrf"), item)).alias("fused_rank"), "n")

    if large.isEmpty():
        return calm(rows)
    hot = rows.join(F.broadcast(large), group)  # of groups that hold more than hot_rows rows each
    pairs = F.array(*(F.struct(F.lit(i).alias("__field"), F.col(c).alias("__value")) for i, c in enumerate(fields)))
    long = hot.select(group, item, F.inline(pairs)).filter("__value is not null")
    ranked = rank_in_groups(long, [group, "__field"], "__value", "__rank", hot_rows=hot_rows).select(group, item, "__field", "__rank")
    # the item's own row keeps items without any score
    either = ranked.unionByName(hot.select(group, item, F.lit(None).cast("int").alias("__field"), F.lit(None).cast("int").alias("__rank")))
    wide = either.groupBy(group, item).agg(*(F.max(F.when(F.col("__field") == i, F.col("__rank"))).alias(f"r_{c}") for i, c in enumerate(fields))).withColumn("rrf", total)
    sliced = rank_in_groups(wide, [group], "rrf", "fused_rank", ties=[item], hot_rows=hot_rows).join(F.broadcast(large), group)
    return calm(rows.join(F.broadcast(large), group, "left_anti")).unionByName(sliced.select(*kept, "fused_rank", "n"))


def least_rrf(n: Column, fields: int, k: int = K) -> Column:
    """The least fused score of an item that beats each of the other n - 1 items of its group in all but one of the fields at least.

    Each rival is ahead of it in one field at most, so its ranks exceed 1 by n - 1 in all. For given total the sum of 1 / (k + rank) is least
    where the ranks are equal, as the function is convex. An item without a value in one field gains nothing there on
    rivals that have none either, and must be first in all other fields. A lone item needs nothing.
    """
    level = F.lit(fields) / (k + 1 + (n - 1) / fields)
    return F.when(n > 1, F.least(F.lit((fields - 1) / (k + 1)), level) - 1e-12).otherwise(F.lit(0.0))


def _wins(x: list[Column], y: list[Column], needed: int) -> Column:
    """Whether the ranks x are strictly better than y in enough fields; a missing rank is worse than any."""
    far = F.lit(2**31 - 1)
    return reduce(lambda p, q: p + q, (F.when(F.coalesce(a, far) < F.coalesce(b, far), 1).otherwise(0) for a, b in zip(x, y))) >= needed


def contenders(fused: DataFrame, fields: list[str], needed: int, k: int = K) -> DataFrame:
    """The rows of fuse_scores whose fused score an undisputed item may have. The bound holds where all fields but one at most decide."""
    if needed < len(fields) - 1:
        return fused
    return fused.filter(F.col("rrf") >= least_rrf(F.col("n"), len(fields), k))


def undisputed_first(fused: DataFrame, group: str, item: str, fields: list[str], needed: int = 3, k: int = K) -> DataFrame:
    """(group, item): the item that beats every other item of its group in at least ``needed`` of the fields' ranks.

    ``fused`` comes from fuse_scores. The fused score decides who contends: below ``least_rrf`` no item can be undisputed. The
    contenders meet in knock-out rounds, in the order of fusion, FOLD of them in a task at most, until one is left in each
    group; it is held against every item of the group. An item that beats all others can't be knocked out. A group of one
    item yields it.
    """
    ranks = [f"r_{c}" for c in fields]
    most = fused.agg(F.max("n")).first()[0] or 0
    left = contenders(fused, fields, needed, k)

    def better(x: Column, y: Column) -> Column:
        return _wins([x[r] for r in ranks], [y[r] for r in ranks], needed)

    rounds = max(1, math.ceil(math.log(max(most, 2), FOLD)))
    for i in range(rounds):
        salt = F.pmod(F.xxhash64(F.lit(i), item), F.ceil(F.col("n") / FOLD ** (i + 1))) if i < rounds - 1 else F.lit(0)
        held = left.withColumn("__salt", salt).groupBy(group, "n", "__salt").agg(F.sort_array(F.collect_list(F.struct("fused_rank", item, *ranks))).alias("__all"))
        pick = F.reduce(F.slice("__all", 2, F.greatest(F.size("__all") - 1, F.lit(1))), F.element_at("__all", 1), lambda best, x: F.when(better(x, best), x).otherwise(best))
        left = held.select(group, "n", pick.alias("__best")).select(group, "n", "__best.*")
    champion = left.select(group, F.col(item).alias("__item"), *(F.col(r).alias(f"__{r}") for r in ranks))
    beaten = (F.col(item) == F.col("__item")) | _wins([F.col(f"__{r}") for r in ranks], [F.col(r) for r in ranks], needed)
    held = fused.select(group, item, *ranks).join(champion, group).groupBy(group, "__item").agg(F.min(beaten).alias("__all"))
    return held.filter("__all").select(group, F.col("__item").alias(item))
