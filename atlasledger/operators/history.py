"""Version histories: name changes, version groups, neighbours and nearest builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger.operators.ordered import (
    has_hot_key,
    with_last_known,
    with_neighbour,
    with_running_sum,
)


def name_changes(facts: DataFrame, bound: int | None = None) -> DataFrame:
    """Rows of ``map_id, build_id, name`` where the name starts or changes.

    Works on raw facts in any arrival order; nulls are not names.
    """
    named = facts.where(F.col("name").isNotNull()).select("map_id", "build_id", "name")
    with_before = with_neighbour(
        named, ["map_id"], ["build_id"], {"name": "_before"}, bound=bound
    )
    return with_before.where(F.col("_before").isNull() | (F.col("_before") != F.col("name"))).drop(
        "_before"
    )


def name_histories(changes: DataFrame) -> DataFrame:
    """Change points of each map as one ``map<build, name>`` in build order."""
    entries = F.sort_array(F.collect_list(F.struct("build_id", "name")))
    return changes.groupBy("map_id").agg(F.map_from_entries(entries).alias("name_history"))


def alias_ranges(changes: DataFrame, maps: DataFrame, bound: int | None = None) -> DataFrame:
    """Earlier names of each map and when they applied.

    A range ends at the next change, or is open. The map's present name is left
    out. ``maps`` is ``map_id, name``.
    """
    ranged = with_neighbour(
        changes, ["map_id"], ["build_id"], {"build_id": "until"}, step=1, bound=bound
    )
    present = maps.select("map_id", F.col("name").alias("_present"))
    return (
        ranged.join(present, "map_id")
        .where(F.col("name") != F.col("_present"))
        .select("map_id", F.col("name").alias("alias"), F.col("build_id").alias("since"), "until")
    )


def version_groups(
    versions: DataFrame, keys: list[str], fingerprint: str, bound: int | None = None
) -> DataFrame:
    """Number the runs of consecutive builds with equal fingerprints.

    Adds ``group_no`` from 1 and ``first_of_group``.
    """
    out = with_neighbour(
        versions, keys, ["build_id"], {fingerprint: "_before"}, bound=bound, mark="_has_before"
    )
    changed = ~F.col("_has_before") | ~F.col("_before").eqNullSafe(F.col(fingerprint))
    out = out.withColumn("_step", changed.cast("int"))
    out = with_running_sum(out, keys, ["build_id"], "_step", "group_no", bound=bound)
    return out.withColumn("first_of_group", F.col("_step") == 1).drop(
        "_before", "_has_before", "_step"
    )


def group_ranges(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Oldest and newest build and the size of each version group."""
    return grouped.groupBy(*keys, "group_no").agg(
        F.min("build_id").alias("oldest"),
        F.max("build_id").alias("newest"),
        F.count(F.lit(1)).alias("builds"),
    )


def neighbours(
    df: DataFrame, keys: list[str], order: str, bound: int | None = None
) -> DataFrame:
    """Previous and next ``order`` value of each row; null at the ends."""
    out = with_neighbour(df, keys, [order], {order: f"prev_{order}"}, bound=bound)
    return with_neighbour(out, keys, [order], {order: f"next_{order}"}, step=1, bound=bound)


def first_last_composed(layers: DataFrame) -> DataFrame:
    """First and last build of each map that has a composition."""
    return (
        layers.where(F.col("composition_hash").isNotNull())
        .groupBy("map_id")
        .agg(F.min("build_id").alias("first_build"), F.max("build_id").alias("last_build"))
    )


def latest(versions: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The newest build of each map (or of other keys) and its value."""
    return versions.groupBy(*(keys or ["map_id"])).agg(
        F.max("build_id").alias("build_id"), F.max_by(value, "build_id").alias(value)
    )


def nearest_build(
    requests: DataFrame, versions: DataFrame, bound: int | None = None
) -> DataFrame:
    """The build to show for each request of ``map_id, requested``.

    The exact build, else the one at the smallest distance; the older wins a
    tie. Requests and versions are merged in build order and each request
    looks one step back and one ahead, so no pair of them is ever formed.
    Maps without versions get a null build.
    """
    asked = requests.select("map_id", "requested").distinct()
    line = versions.select(
        "map_id",
        F.col("build_id").alias("at"),
        F.lit(0).alias("kind"),
        F.col("build_id").alias("v"),
    ).unionByName(
        asked.select(
            "map_id",
            F.col("requested").alias("at"),
            F.lit(1).alias("kind"),
            F.lit(None).cast("bigint").alias("v"),
        )
    )
    order = ["at", "kind"]
    if not has_hot_key(line, ["map_id"], bound):
        bound = 0  # asked once for both directions
    line = with_last_known(line, ["map_id"], order, "v", "older", bound=bound)
    line = with_last_known(line, ["map_id"], order, "v", "newer", forward=False, bound=bound)
    older_wins = F.col("newer").isNull() | (
        F.col("at") - F.col("older") <= F.col("newer") - F.col("at")
    )
    build = F.when(F.col("older").isNotNull() & older_wins, F.col("older")).otherwise(
        F.col("newer")
    )
    picked = line.where(F.col("kind") == 1).select(
        "map_id", F.col("at").alias("requested"), build.alias("build_id")
    )
    found = picked.withColumn("is_fallback", F.col("build_id") != F.col("requested"))
    return requests.join(found, ["map_id", "requested"], "left")
