"""Composition documents and the other JSON documents a catalogue serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.coords import coord_text, parse_coord
from atlasledger.functions.hashes import hash_sort_key, parse_hash

COMPOSITION = "tiles map<string,array<string>>, missing array<string>, tileSize int"


def parse_compositions(docs: DataFrame, document: str) -> DataFrame:
    """Composition documents as structs; unknown members are skipped."""
    return docs.withColumn("_doc", F.from_json(F.col(document), COMPOSITION))


def composition_tiles(docs: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """``keys, x, y, hash`` of every tile in the documents."""
    by_hash = parse_compositions(docs, document).select(
        *keys, F.explode("_doc.tiles").alias("hash", "_coords")
    )
    by_coord = by_hash.select(*keys, "hash", F.explode("_coords").alias("_coord"))
    at = parse_coord(F.col("_coord"))
    return by_coord.select(*keys, parse_hash(F.col("hash")).alias("hash"), at.alias("_at")).select(
        *keys, F.col("_at.x").alias("x"), F.col("_at.y").alias("y"), "hash"
    )


def composition_missing(docs: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """``keys, x, y`` of every missing coordinate in the documents."""
    by_coord = parse_compositions(docs, document).select(
        *keys, F.explode("_doc.missing").alias("_coord")
    )
    at = parse_coord(F.col("_coord"))
    return by_coord.select(*keys, at.alias("_at")).select(
        *keys, F.col("_at.x").alias("x"), F.col("_at.y").alias("y")
    )


def composition_documents(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Composition document of each key.

    ``tiles`` has one row per coordinate: ``hash`` (null where the tile is
    missing from the build) and the key's ``tile_size``. Both grouping steps
    hash on the keys, so they share one shuffle; a group is at most one grid.
    """
    at = F.struct("x", "y")
    placed = tiles.repartition(*[F.col(k) for k in keys])
    by_hash = placed.groupBy(*keys, "hash").agg(
        F.sort_array(F.collect_list(at)).alias("_at"), F.max("tile_size").alias("_size")
    )
    coords = F.transform(F.col("_at"), lambda c: coord_text(c["x"], c["y"]))
    entry = F.struct(
        hash_sort_key(F.col("hash")).alias("k"), F.col("hash").alias("h"), coords.alias("c")
    )
    grouped = by_hash.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("hash").isNotNull(), entry))).alias("_tiles"),
        F.max(F.when(F.col("hash").isNull(), coords)).alias("missing"),
        F.max("_size").alias("tileSize"),
    )
    tiles_map = F.map_from_entries(
        F.transform(F.col("_tiles"), lambda e: F.struct(e["h"].alias("key"), e["c"].alias("value")))
    )
    sized = (F.size("_tiles") == 0) | F.coalesce(F.col("tileSize") > 0, F.lit(False))
    document = F.to_json(
        F.struct(tiles_map.alias("tiles"), F.col("missing"), F.col("tileSize"))
    )
    return grouped.select(
        *keys,
        F.when(sized, document)
        .otherwise(F.raise_error(F.lit("a composition with tiles needs a tile size")))
        .alias("document"),
    )


def versions_document(layers: list[Column], missing: list[Column], products: Column) -> Column:
    """Wire form of one build's entry; null members are left out."""
    return F.to_json(
        F.struct(
            F.array(*layers).alias("l"),
            F.when(
                F.greatest(*[F.coalesce(m.isNotNull().cast("int"), F.lit(0)) for m in missing]) > 0,
                F.array(*missing),
            ).alias("m"),
            products.alias("p"),
        )
    )
