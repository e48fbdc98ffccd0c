"""Served queries: what a viewer of the catalogue asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.labels import parent_map, preferred_base
from atlasledger.operators import areas as area_ops
from atlasledger.operators import merge
from atlasledger.operators.diff import composition_diff
from atlasledger.operators.history import nearest_build
from atlasledger.sources.documents import versions_document

LAYER_CODES = range(5)


def products_per_build(products: DataFrame) -> DataFrame:
    """Distinct products of each build, in order of their first sighting.

    Reduced to one row per (build, product) first, so the list is as long as
    the product catalogue at most.
    """
    # equal sightings go first: the least of texts is found by sorting
    sightings = products.select("build_id", "product", "first_seen").distinct()
    seen = sightings.groupBy("build_id", "product").agg(F.min("first_seen").alias("first_seen"))
    entries = F.sort_array(F.collect_list(F.struct("first_seen", "product")))
    return seen.groupBy("build_id").agg(
        F.transform(entries, lambda e: e["product"]).alias("products")
    )


def layer_pivot(layers: DataFrame) -> DataFrame:
    """One row per build and map with the five layer hashes and missing lists.

    A pivot by conditional aggregates: one shuffle, no pass over the layer
    codes. ``layers`` has one row per (build, map, layer).
    """
    hash_ = F.coalesce("composition_hash", "data_hash")
    columns = []
    for code in LAYER_CODES:
        here = F.col("layer_type") == code
        columns.append(F.max(F.when(here, hash_)).alias(f"l{code}"))
        columns.append(F.max(F.when(here, F.col("cdn_missing"))).alias(f"m{code}"))
    return layers.groupBy("build_id", "map_id").agg(*columns)


def map_versions(layers: DataFrame, products: DataFrame) -> DataFrame:
    """Every version of every map: layer hashes, missing lists and products."""
    return with_products(layer_pivot(layers), products_per_build(products))


def with_products(versions: DataFrame, per_build: DataFrame) -> DataFrame:
    """Versions with the products of their builds, none where a build has none."""
    none = F.array().cast("array<string>")
    return versions.join(per_build, "build_id", "left").withColumn("products", F.coalesce("products", none))


def version_documents(versions: DataFrame) -> DataFrame:
    """Wire document of each version."""
    document = versions_document(
        [F.col(f"l{c}") for c in LAYER_CODES],
        [F.col(f"m{c}") for c in LAYER_CODES],
        F.col("products"),
    )
    return versions.select("map_id", "build_id", document.alias("document"))


def map_list(maps: DataFrame, build_maps: DataFrame) -> DataFrame:
    """Maps one can look at, with parent and the tile count of their last build."""
    last = build_maps.select(
        "map_id", F.col("build_id").alias("last_seen"), F.col("wdt_tile_count").alias("_n")
    )
    return (
        merge.base_layer_maps(maps)
        .withColumn("parent", parent_map(F.col("json")))
        .join(last, ["map_id", "last_seen"], "left")
        .withColumn("wdt_tile_count", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def load_maps(requests: DataFrame, versions: DataFrame, preferred: int = 0) -> DataFrame:
    """Layers and base layer of each requested map at its nearest version.

    ``requests``: ``map_id, requested``; a null request asks for the latest. A map without versions
    keeps its row, with a null build and ``known`` false.
    """
    newest = versions.groupBy("map_id").agg(F.max("build_id").alias("_newest"))
    asked = (
        requests.join(newest, "map_id", "left")
        .withColumn("is_latest", F.col("requested").isNull())
        .withColumn("requested", F.coalesce("requested", "_newest"))
        .drop("_newest")
    )
    found = nearest_build(asked, versions.select("map_id", "build_id"))
    base = preferred_base(F.lit(preferred), F.col("l0").isNotNull(), F.col("l1").isNotNull())
    out = found.join(versions, ["map_id", "build_id"], "left").withColumn("base_layer", base)
    return out.withColumn("known", F.col("build_id").isNotNull())


def parent_chains(requests: DataFrame, parents: DataFrame) -> DataFrame:
    """Each requested map with all maps it hangs under, at the same request.

    ``parents``: ``map_id, parent_id``. The closure works on distinct maps, so
    it does not grow with the requests.
    """
    chain = area_ops.ancestor_closure(
        requests.select(F.col("map_id").alias("root"), F.col("map_id").alias("area_id")),
        parents.select(F.col("map_id").alias("area_id"), "parent_id"),
        ["root"],
    )
    return requests.withColumnRenamed("map_id", "root").join(chain, "root").select(
        "root", F.col("area_id").alias("map_id"), "requested"
    )


def change_between(requests: DataFrame, tiles: DataFrame, versions: DataFrame) -> DataFrame:
    """Tile changes of maps between two requested versions.

    ``requests``: ``map_id, old_requested, new_requested``.
    """

    def side(requested: str) -> DataFrame:
        asked = requests.select("map_id", F.col(requested).alias("requested")).distinct()
        picked = nearest_build(asked, versions.select("map_id", "build_id").distinct())
        return (
            requests.withColumn("requested", F.col(requested))
            .join(picked, ["map_id", "requested"])
            .select("map_id", "old_requested", "new_requested", "build_id")
            .join(tiles.select("map_id", "build_id", "x", "y", "hash"), ["map_id", "build_id"])
        )

    keys = ["map_id", "old_requested", "new_requested"]
    return composition_diff(side("old_requested"), side("new_requested"), keys)


def zone_panels(chunks: DataFrame, areas: DataFrame, maps: DataFrame) -> DataFrame:
    """Ordered, labelled zones of every map with their place in the tree."""
    owned = chunks.select("map_id", "area_id").distinct()
    closure = area_ops.ancestor_closure(owned, areas.select("area_id", "parent_id"), ["map_id"], marked=True)
    return area_ops.zone_order(area_ops.zone_panel(closure, areas, maps))
