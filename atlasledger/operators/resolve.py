"""From listed file ids to content hashes, and the work lists that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger import schema
from atlasledger.functions.labels import adt_path, wdt_path
from atlasledger.functions.versions import version_number


def layer_cells(cells: DataFrame) -> DataFrame:
    """Map cells as one row per layer that lists a file id (0 lists none).

    Layers 0 and 1 come from the cell; ``stack`` unpivots them in one pass.
    """
    return cells.select(
        "build_id",
        "map_id",
        "x",
        "y",
        F.expr("stack(2, 0, minimap_texture, 1, map_texture) AS (layer_type, fdid)"),
    ).where(F.col("fdid") != 0)


def override_cells(build_maps: DataFrame, overrides: DataFrame) -> DataFrame:
    """Static no-liquid tiles of each build's maps, for builds that know them.

    ``overrides`` is ``map_id, x, y, fdid``. The join is left to AQE, which
    broadcasts the table only when its measured size allows.
    """
    since = version_number(schema.BUILD_THRESHOLDS["no_liquid_tiles"])
    return (
        build_maps.where(F.col("build_id") >= since)
        .join(overrides, "map_id")
        .select("build_id", "map_id", "x", "y", F.lit(2).alias("layer_type"), "fdid")
    )


def resolve(cells: DataFrame, file_index: DataFrame) -> DataFrame:
    """Attach the content hash of each cell's file; null is build-missing.

    Of several index entries of one file the least hash counts, so no cell is ever doubled;
    ``index_cardinality`` reports such files.
    """
    # dealt out first: the least text is found by sorting, which is then done once, for the join as well
    dealt = file_index.repartition("build_id", "fdid")
    index = dealt.groupBy("build_id", "fdid").agg(F.min("ckey").alias("hash"))
    return cells.join(index, ["build_id", "fdid"], "left")


def index_cardinality(cells: DataFrame, file_index: DataFrame) -> DataFrame:
    """Whether each listed file id has no, one or several index entries."""
    entries = file_index.groupBy("build_id", "fdid").agg(F.count(F.lit(1)).alias("entries"))
    listed = cells.select("build_id", "fdid").distinct()
    kind = (
        F.when(F.col("entries").isNull(), F.lit("none"))
        .when(F.col("entries") == 1, F.lit("one"))
        .otherwise(F.lit("several"))
    )
    return listed.join(entries, ["build_id", "fdid"], "left").withColumn("kind", kind)


def wdt_file_ids(map_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """File id of each map's main file: the row's own from the build on that has
    them, else the path list's."""
    since = version_number(schema.BUILD_THRESHOLDS["row_file_ids"])
    own = F.when(F.col("build_id") >= since, F.nullif(F.col("wdt_fdid"), F.lit(0)))
    keyed = map_rows.withColumn("path", wdt_path(F.col("directory")))
    return keyed.join(paths, "path", "left").withColumn("wdt_fdid", F.coalesce(own, "fdid")).drop(
        "fdid", "path"
    )


def rectangle_files(rectangles: DataFrame, paths: DataFrame) -> DataFrame:
    """File id of every tile in inclusive rectangles; null reports a miss.

    A rectangle outside 0..63 or turned inside out is an error.
    """
    good = (
        (F.col("x0") >= 0)
        & (F.col("y0") >= 0)
        & (F.col("x1") <= 63)
        & (F.col("y1") <= 63)
        & (F.col("x0") <= F.col("x1"))
        & (F.col("y0") <= F.col("y1"))
    )
    span_x = F.when(good, F.sequence("x0", "x1")).otherwise(
        F.raise_error(F.lit("tile rectangle out of range"))
    )
    tiles = rectangles.select("directory", "y0", "y1", F.explode(span_x).alias("x")).select(
        "directory", "x", F.explode(F.sequence("y0", "y1")).alias("y")
    )
    keyed = tiles.withColumn("path", adt_path(F.col("directory"), F.col("x"), F.col("y")))
    return keyed.join(paths, "path", "left")


def first_metadata(tiles: DataFrame) -> DataFrame:
    """One (layer, file id) per hash: lowest layer, then lowest file id."""
    return (
        tiles.where(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(F.min(F.struct("layer_type", "fdid")).alias("_m"))
        .select("hash", F.col("_m.layer_type").alias("layer_type"), F.col("_m.fdid").alias("fdid"))
    )


def distinct_hashes(tiles: DataFrame) -> DataFrame:
    return tiles.where(F.col("hash").isNotNull()).select("hash").distinct()


def known(hashes: DataFrame, store: DataFrame) -> DataFrame:
    """Hashes the store has, with its size."""
    return hashes.join(store.select("hash", "tile_size"), "hash")


def unknown(hashes: DataFrame, store: DataFrame) -> DataFrame:
    """The work list: hashes the store does not have."""
    return hashes.join(store.select("hash"), "hash", "left_anti")


def tile_counts(cells: DataFrame) -> DataFrame:
    """Cells with terrain per build and map."""
    return cells.groupBy("build_id", "map_id").agg(
        F.count_if(F.col("root_adt") != 0).alias("wdt_tile_count")
    )


def maps_lacking_data(build_maps: DataFrame, layers: DataFrame) -> DataFrame:
    """Build maps without both data layers; each row names how many are there."""
    held = (
        layers.where(F.col("data_hash").isNotNull() & F.col("layer_type").isin(*schema.DATA_LAYERS))
        .groupBy("build_id", "map_id")
        .agg(F.count_distinct("layer_type").alias("held"))
    )
    return (
        build_maps.select("build_id", "map_id")
        .join(held, ["build_id", "map_id"], "left")
        .withColumn("held", F.coalesce("held", F.lit(0)))
        .where(F.col("held") < len(schema.DATA_LAYERS))
    )
