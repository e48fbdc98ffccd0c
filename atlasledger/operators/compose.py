"""Compositions: one layer of one map in one build, as a set of placed hashes.

Tile rows carry ``x, y, hash``; a null hash is a coordinate the build lists
but cannot resolve. A composition lies on a 64 x 64 grid, so gathering one is
bounded by 4,096 rows once ``one_per_cell`` has been applied to raw facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.hashes import is_hash, le32_pair_hex

# Tile size when no tile tells one, and the least pyramid tile.
DEFAULT_TILE_SIZE = 512
LEAST_LOD_TILE_SIZE = 64


def one_per_cell(tiles: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Keep the last writer of each coordinate of raw tile facts."""
    return tiles.groupBy(*keys, "x", "y").agg(F.max_by("hash", newest).alias("hash"))


def compositions(tiles: DataFrame, keys: list[str], cdn: bool = False, placed: bool = False) -> DataFrame:
    """Composition hash, counts and inclusive extents of each key.

    The hash runs over the tiles in x, y order as (x, y, content hash), then
    over the missing coordinates in x, y order as (x, y); numbers are 32-bit,
    lowest byte first. One shuffle on the keys; none of ``placed`` tiles, which lie by some of the
    keys already. With ``cdn`` the sorted distinct CDN-missing hashes come along, null when there are none.
    """
    held = F.col("hash").isNotNull()
    at = le32_pair_hex(F.col("x"), F.col("y"))
    # tiles before missing coordinates, each in signed x, y order
    place = F.shiftleft(F.col("x").cast("bigint"), 32) + (F.col("y").cast("bigint") + 2**31)
    entry = F.struct(
        (~held).alias("missing"), place.alias("at"), F.concat(at, F.coalesce("hash", F.lit(""))).alias("p")
    )
    extra = []
    if cdn:
        lost = F.collect_set(F.when(F.col("cdn_missing"), F.col("hash")))
        extra = [F.sort_array(lost).alias("_cdn")]
    # gathering does not shrink the rows, so they are placed first and the
    # whole aggregation runs behind that one shuffle
    columns = [*keys, "x", "y", "hash", *(["cdn_missing"] if cdn else [])]
    gathered = tiles.select(*columns)
    if not placed:
        gathered = gathered.repartition(*[F.col(k) for k in keys])
    grouped = gathered.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("_entries"),
        F.count("hash").cast("int").alias("tiles"),
        F.count_if(~held).cast("int").alias("missing"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        F.max("x").alias("x1"),
        F.max("y").alias("y1"),
        *extra,
    )
    return grouped.select(
        *keys,
        F.md5(F.unhex(F.array_join("_entries.p", ""))).alias("composition_hash"),
        "tiles",
        "missing",
        "x0",
        "y0",
        "x1",
        "y1",
        *([F.when(F.size("_cdn") > 0, F.col("_cdn")).alias("cdn_missing")] if cdn else []),
    )


def viewer_bounds(compositions_: DataFrame) -> DataFrame:
    """Exclusive bounds, size and centre a viewer frames a composition with."""
    width = F.col("x1") - F.col("x0") + 1
    height = F.col("y1") - F.col("y0") + 1
    return (
        compositions_.withColumn("max_x", F.col("x1") + 1)
        .withColumn("max_y", F.col("y1") + 1)
        .withColumn("width", width)
        .withColumn("height", height)
        .withColumn("center_x", F.col("x0") + width / 2)
        .withColumn("center_y", F.col("y0") + height / 2)
    )


def sized(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tiles with their size; a tile that is present but unknown is an error."""
    joined = tiles.join(sizes, "hash", "left")
    lost = F.raise_error(F.concat(F.lit("no size for tile "), F.col("hash")))
    return joined.withColumn(
        "tile_size",
        F.when(F.col("cdn_missing") | F.col("hash").isNull(), F.lit(None).cast("int"))
        .when(F.col("tile_size").isNull(), lost)
        .otherwise(F.col("tile_size").cast("int")),
    )


def tile_size_counts(tiles: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles per size of each composition, CDN-missing tiles left out."""
    return (
        sized(tiles, sizes)
        .where(F.col("hash").isNotNull())
        .groupBy(*keys, "tile_size")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def composition_tile_sizes(tiles: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Tile size of each composition that has tiles, and its mixed-size report.

    The most frequent size wins, the larger on a tie; 512 when every tile is
    missing from the CDN.
    """
    counts = tile_size_counts(tiles, sizes, keys)
    known = F.col("tile_size").isNotNull()
    # only a handful of sizes exist, so the report's list is short
    report = F.sort_array(F.collect_list(F.when(known, F.struct("tile_size", "n"))))
    text = F.array_join(
        F.transform("_counts", lambda c: F.concat(c["tile_size"], F.lit("px="), c["n"])), ", "
    )
    return (
        counts.groupBy(*keys)
        .agg(
            F.max(F.when(known, F.struct("n", "tile_size"))).alias("_best"),
            report.alias("_counts"),
        )
        .select(
            *keys,
            F.coalesce(F.col("_best.tile_size"), F.lit(DEFAULT_TILE_SIZE)).alias("tile_size"),
            F.when(F.size("_counts") > 1, text).alias("mixed"),
        )
    )


def layer_metrics(tiles: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Scan metrics of each key.

    Total and distinct tiles, tiles and hashes the store does not have yet,
    their share in percent, and the distinct hashes missing from the CDN.
    Counting distinct hashes goes over (key, hash) first, which spreads a hot
    key over all tasks.
    """
    per_hash = (
        tiles.where(F.col("hash").isNotNull())
        .groupBy(*keys, "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("cdn_missing").alias("cdn"))
    )
    marked = per_hash.join(known.select("hash", F.lit(True).alias("_known")), "hash", "left")
    new = F.col("_known").isNull()
    return (
        marked.groupBy(*keys)
        .agg(
            F.sum("n").alias("total_tiles"),
            F.count(F.lit(1)).alias("unique_tiles"),
            F.count_if(new).alias("new_tiles"),
            F.count_if("cdn").alias("cdn_missing"),
        )
        .withColumn("new_percent", F.round(F.col("new_tiles") * 100.0 / F.col("unique_tiles"), 4))
    )


def cdn_missing_hashes(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct CDN-missing hashes of each layer, null when there are none.

    The list is part of the layer row; it holds at most one entry per grid cell.
    """
    hashes = F.sort_array(F.collect_set(F.when(F.col("cdn_missing"), F.col("hash"))))
    return (
        tiles.groupBy(*keys)
        .agg(hashes.alias("_h"))
        .select(*keys, F.when(F.size("_h") > 0, F.col("_h")).alias("cdn_missing"))
    )

