"""Neighbour, fill and running-sum operators that survive hot keys.

A plain window sends all rows of a key to one task. Each operator here first
asks whether any key is that large: either the caller proves a bound (for
example the number of builds) or the keys are counted. Small keys use a plain
window. Otherwise the rows are range-partitioned on ``keys, order``, which
cuts a hot key into pieces; each piece is worked on alone and a short table of
piece ends (at most one row per partition and key that spans partitions)
carries the result across the cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasledger.session import checkpointed

HOT_SETTING = "spark.atlasledger.hotKeyRows"
HOT_ROWS = 2_000_000


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_SETTING, str(HOT_ROWS)))


def has_hot_key(df: DataFrame, keys: list[str], bound: int | None = None) -> bool:
    """True when some key may hold more rows than one task should sort."""
    limit = hot_limit(df)
    if bound is not None and bound <= limit:
        return False
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > limit).isEmpty()


def _pieces(
    df: DataFrame, keys: list[str], order: list[str], save: Callable[[DataFrame], DataFrame] = checkpointed
) -> DataFrame:
    columns = [F.col(c) for c in (*keys, *order)]
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(pieces, *columns)
    return save(placed.withColumn("_piece", F.spark_partition_id()))


def _spanning(ends: DataFrame, keys: list[str]) -> DataFrame:
    """Piece-end rows of keys that lie in several pieces."""
    several = F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1
    return ends.withColumn("_several", several).where("_several").drop("_several")


def with_neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    step: int = -1,
    bound: int | None = None,
    mark: str | None = None,
) -> DataFrame:
    """Add the previous (``step=-1``) or next (``+1``) row's values.

    ``columns`` maps a source column to the new column's name. ``mark`` names
    an optional boolean column that is true where there is a neighbour.
    """
    pick = F.lag if step < 0 else F.lead
    values = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    work = df.withColumn("_v", values)
    if not has_hot_key(df, keys, bound):
        out = work.withColumn("_v", pick("_v").over(W.partitionBy(*keys).orderBy(*order)))
    else:
        work = _pieces(work, keys, order)
        inside = W.partitionBy("_piece", *keys).orderBy(*order)
        end = F.max_by if step < 0 else F.min_by
        ends = work.groupBy(*keys, "_piece").agg(end("_v", F.struct(*order)).alias("_end"))
        carried = _spanning(ends, keys).withColumn(
            "_end", pick("_end").over(W.partitionBy(*keys).orderBy("_piece"))
        )
        out = (
            join_carried(work, carried, keys)
            .withColumn("_v", F.coalesce(pick("_v").over(inside), "_end"))
            .drop("_end", "_piece")
        )
    if mark:
        out = out.withColumn(mark, F.col("_v").isNotNull())
    for name in columns.values():
        out = out.withColumn(name, F.col(f"_v.{name}"))
    return out.drop("_v")


def join_carried(work: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``carried`` (one row per key and piece) beside each row; null keys are keys too."""
    side = carried
    for key in keys:
        side = side.withColumnRenamed(key, f"_k_{key}")
    side = side.withColumnRenamed("_piece", "_k_piece")
    same = work["_piece"] == side["_k_piece"]
    for key in keys:
        same = same & work[key].eqNullSafe(side[f"_k_{key}"])
    return work.join(side, same, "left").drop("_k_piece", *[f"_k_{k}" for k in keys])


def with_last_known(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    column: str,
    name: str,
    forward: bool = True,
    bound: int | None = None,
) -> DataFrame:
    """Add the nearest non-null ``column`` at or before (or after) each row."""
    pick = F.last if forward else F.first
    frame = (W.unboundedPreceding, 0) if forward else (0, W.unboundedFollowing)

    def nearest(*partition: str) -> Column:
        window = W.partitionBy(*partition).orderBy(*order).rowsBetween(*frame)
        return pick(column, ignorenulls=True).over(window)

    if not has_hot_key(df, keys, bound):
        return df.withColumn(name, nearest(*keys))
    work = _pieces(df, keys, order)
    end = F.max_by if forward else F.min_by
    ends = work.groupBy(*keys, "_piece").agg(
        end(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_end")
    )
    before = W.partitionBy(*keys).orderBy("_piece")
    if forward:
        before = before.rowsBetween(W.unboundedPreceding, -1)
    else:
        before = before.rowsBetween(1, W.unboundedFollowing)
    carried = _spanning(ends, keys).withColumn("_end", pick("_end", ignorenulls=True).over(before))
    return (
        join_carried(work, carried, keys)
        .withColumn(name, F.coalesce(nearest("_piece", *keys), "_end"))
        .drop("_end", "_piece")
    )


def with_running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    column: str,
    name: str,
    bound: int | None = None,
) -> DataFrame:
    """Add the sum of ``column`` up to and including each row."""

    def running(*partition: str) -> Column:
        window = W.partitionBy(*partition).orderBy(*order)
        return F.sum(column).over(window.rowsBetween(W.unboundedPreceding, 0))

    if not has_hot_key(df, keys, bound):
        return df.withColumn(name, running(*keys))
    work = _pieces(df, keys, order)
    ends = work.groupBy(*keys, "_piece").agg(F.sum(column).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = _spanning(ends, keys).withColumn("_end", F.sum("_end").over(before))
    return (
        join_carried(work, carried, keys)
        # null while the key has shown nothing but nulls, as without pieces
        .withColumn(name, F.coalesce(running("_piece", *keys) + F.coalesce("_end", F.lit(0)), "_end"))
        .drop("_end", "_piece")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key, ranked.

    Spark drops rows ranked above ``k`` before the shuffle (its window group
    limit), so a hot key sends at most ``k`` rows per task.
    """
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
