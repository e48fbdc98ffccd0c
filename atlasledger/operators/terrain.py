"""Terrain heights: statistics and 0..255 grey values per tile.

A chunk stores 145 heights as 17 rows of alternately 9 and 8 values. Heights
are relative to the chunk's base. Neighbouring chunks share border vertices;
a later chunk (row by row) overwrites them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layout of the picture a tile's heights fill.
OUTER, INNER = 9, 8
FLAT_GREY = 128


def height_cells(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, px, py, height`` of a tile's picture, one row per pixel.

    ``chunks``: ``keys, index_x, index_y, position_z, heights``.
    """
    rows = chunks.select(
        *keys,
        "index_x",
        "index_y",
        "position_z",
        F.posexplode("heights").alias("i", "relative"),
    )
    pair = F.floor(F.col("i") / (OUTER + INNER)).cast("int")
    within = F.col("i") % (OUTER + INNER)
    inner = within >= OUTER
    row = pair * 2 + inner.cast("int")
    column = F.when(inner, within - OUTER).otherwise(within)
    order = F.struct("index_y", "index_x")
    return (
        rows.withColumn("px", F.col("index_x") * INNER + column)
        .withColumn("py", F.col("index_y") * 16 + row)
        .withColumn("height", F.col("position_z") + F.col("relative"))
        .groupBy(*keys, "px", "py")
        .agg(F.max_by("height", order).alias("height"))
    )


def height_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Least, greatest and number of heights per tile, from arrays as they lie."""
    per_chunk = chunks.where(F.size("heights") > 0).select(
        *keys,
        (F.array_min("heights") + F.col("position_z")).alias("_lo"),
        (F.array_max("heights") + F.col("position_z")).alias("_hi"),
        F.size("heights").alias("_n"),
    )
    return per_chunk.groupBy(*keys).agg(
        F.min("_lo").alias("min_height"),
        F.max("_hi").alias("max_height"),
        F.sum("_n").alias("heights"),
    )


def grey(height: Column, low: Column, high: Column) -> Column:
    """Grey of a height: 0 for an unset pixel, 128 on flat tiles, else scaled."""
    scaled = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (height - low) / (high - low) * 255)))
    return (
        F.when(height == 0, F.lit(0))
        .when(high - low <= 0, F.lit(FLAT_GREY))
        .otherwise(scaled.cast("int"))
    )


def grey_pixels(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Grey value of every set pixel; the tile's range joins in by key."""
    return (
        height_cells(chunks, keys)
        .join(height_stats(chunks, keys), keys)
        .select(
            *keys,
            "px",
            "py",
            grey(F.col("height"), F.col("min_height"), F.col("max_height")).alias("grey"),
        )
    )
