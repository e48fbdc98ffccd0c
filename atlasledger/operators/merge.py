"""Merges of incoming rows into catalogue tables.

Parquet has no row-level merge, so each rule is a pure function from the
current and the incoming rows to the merged table (or to the rows to append);
``streaming.snapshots`` swaps whole snapshots. All merges are a join or one
algebraic aggregation on the table's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger import schema
from atlasledger.operators.history import name_changes


def new_rows(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the table does not hold: insert if absent.

    One row per new key, the least by the remaining columns.
    """
    rest = [c for c in incoming.columns if c not in keys]
    fresh = incoming.join(current.select(*keys), keys, "left_anti")
    if not rest:
        return fresh.distinct()
    return (
        fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    ).select(*incoming.columns)


def latest_wins(
    current: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None
) -> DataFrame:
    """Upsert: an incoming row replaces the current row of its key.

    ``order`` ranks several incoming rows of a key; without it they must agree.
    """
    rest = [c for c in current.columns if c not in keys]
    rank = F.col(order) if order else F.lit(0)
    none = F.lit(None).cast(dict(incoming.dtypes)[order] if order else "int")
    both = current.select(
        *keys, *rest, F.struct(F.lit(0).alias("side"), none.alias("rank")).alias("_o")
    ).unionByName(
        incoming.select(
            *keys, *rest, F.struct(F.lit(1).alias("side"), rank.alias("rank")).alias("_o")
        )
    )
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "_o").alias("_r"))
        .select(*keys, "_r.*")
        .select(*current.columns)
    )


def merge_products(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Products by (build, product): regions are appended, never dropped.

    Both sides carry ``build_id, product, config_regions`` (sets as arrays).
    ``processed`` marks new products and those that gained a region.
    """
    keys = ["build_id", "product"]
    old = current.select(*keys, F.col("config_regions").alias("_old"))
    new = incoming.select(*keys, F.col("config_regions").alias("_new"))
    none = F.array().cast("array<string>")
    added = F.sort_array(F.array_except(F.coalesce("_new", none), F.coalesce("_old", none)))
    return (
        old.join(new, keys, "full_outer")
        .withColumn("_added", added)
        .select(
            *keys,
            F.concat(F.coalesce("_old", none), "_added").alias("config_regions"),
            F.col("_added").alias("new_regions"),
            (F.col("_old").isNull() | (F.size("_added") > 0)).alias("processed"),
        )
    )


def merge_sources(
    current: DataFrame, incoming: DataFrame, product_key: list[str] | None = None
) -> DataFrame:
    """Product sources: incoming regions replace, the first sighting stays."""
    keys = [*(product_key or ["product_id"]), "config_build", "config_cdn", "config_product"]
    old = current.select(
        *keys, F.col("config_regions").alias("_oldr"), F.col("first_seen").alias("_oldf")
    )
    new = incoming.select(
        *keys, F.col("config_regions").alias("_newr"), F.col("first_seen").alias("_newf")
    )
    return old.join(new, keys, "full_outer").select(
        *keys,
        F.coalesce("_newr", "_oldr").alias("config_regions"),
        F.coalesce("_oldf", "_newf").alias("first_seen"),
    )


def queue_scans(
    scans: DataFrame, processed: DataFrame, product_key: list[str] | None = None
) -> DataFrame:
    """Pending scan rows for processed products that have none yet."""
    keys = product_key or ["product_id"]
    return (
        processed.select(*keys)
        .distinct()
        .join(scans.select(*keys), keys, "left_anti")
        .select(*keys, F.lit("pending").alias("state"))
    )


def merge_maps(facts: DataFrame, bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Maps and their name changes out of all per-build map rows, old and new alike.

    The newest build gives json, directory and name; the seen range only
    widens; the name history is the change points over all builds, whatever
    order the builds arrived in, and stays one row per change
    (``history.name_histories`` makes the documents). ``facts`` is
    ``build_id, map_id, json, directory, name``.
    """
    newest = F.max_by(F.struct("json", "directory", "name"), "build_id").alias("_n")
    rows = facts.groupBy("map_id").agg(
        newest, F.min("build_id").alias("first_seen"), F.max("build_id").alias("last_seen")
    )
    maps = rows.select("map_id", "_n.*", "first_seen", "last_seen")
    return maps, name_changes(facts, bound)


def merge_tile_sizes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tile sizes by hash; ``changed`` marks rows whose size really differs."""
    old = current.select("hash", F.col("tile_size").alias("_old"))
    new = incoming.select("hash", F.col("tile_size").alias("_new"), F.lit(True).alias("_in"))
    return old.join(new, "hash", "full_outer").select(
        "hash",
        F.when(F.col("_in"), F.col("_new")).otherwise(F.col("_old")).alias("tile_size"),
        (
            F.coalesce(F.col("_in"), F.lit(False)) & ~F.col("_old").eqNullSafe(F.col("_new"))
        ).alias("changed"),
    )


LAYER_KEY = ["build_id", "map_id", "layer_type"]


def merge_layers(current: DataFrame, composed: DataFrame, data: DataFrame) -> DataFrame:
    """Layer rows after a scan's composition side and then its data side.

    A composition replaces hash and CDN-missing list and leaves the data hash;
    a data blob sets the data hash and clears the composition hash.
    """
    old = current.select(*LAYER_KEY, "composition_hash", "data_hash", "cdn_missing")
    new = composed.select(
        *LAYER_KEY,
        F.col("composition_hash").alias("_ch"),
        F.col("cdn_missing").alias("_cm"),
        F.lit(True).alias("_comp"),
    )
    blob = data.select(*LAYER_KEY, F.col("data_hash").alias("_dh"), F.lit(True).alias("_data"))
    joined = old.join(new, LAYER_KEY, "full_outer").join(blob, LAYER_KEY, "full_outer")
    composition = F.when(F.col("_comp"), F.col("_ch")).otherwise(F.col("composition_hash"))
    return joined.select(
        *LAYER_KEY,
        F.when(F.col("_data"), F.lit(None)).otherwise(composition).alias("composition_hash"),
        F.coalesce("_dh", "data_hash").alias("data_hash"),
        F.when(F.col("_comp"), F.col("_cm")).otherwise(F.col("cdn_missing")).alias("cdn_missing"),
    )


def layer_masks(layers: DataFrame) -> DataFrame:
    """Bit i of a map's mask: layer i was ever seen."""
    return layers.groupBy("map_id").agg(
        F.bit_or(F.expr("shiftleft(1, layer_type)")).alias("layer_mask")
    )


def merge_masks(maps: DataFrame, layers: DataFrame) -> DataFrame:
    """Or newly seen layers into each map's mask."""
    seen = layer_masks(layers).withColumnRenamed("layer_mask", "_seen")
    return (
        maps.join(seen, "map_id", "left")
        .withColumn(
            "layer_mask",
            F.coalesce("layer_mask", F.lit(0)).bitwiseOR(F.coalesce("_seen", F.lit(0))),
        )
        .drop("_seen")
    )


def record_results(scans: DataFrame, results: DataFrame, data_version: int) -> DataFrame:
    """Scan rows after finished scans.

    ``results``: ``product_id, new_state, finished, took_ms, key, key_maps``.
    A locked build or map table stores its key, a partial result the locked
    maps by key; the version error is cleared.
    """
    done = F.col("new_state").isNotNull()
    locked = F.col("new_state").isin("encrypted_build", "encrypted_map_database")
    partial = F.col("new_state") == "partial_decrypt"
    version = F.lit(data_version)

    def put(column: str, value: Column, when: Column = done) -> Column:
        return F.when(when, value).otherwise(F.col(column)).alias(column)

    return scans.join(results, "product_id", "left").select(
        "product_id",
        put("state", F.col("new_state")),
        put("last_scanned", F.col("finished")),
        put("scan_ms", F.col("took_ms")),
        put("encrypted_key", F.col("key"), F.coalesce(locked, F.lit(False))),
        put("encrypted_maps", F.col("key_maps"), F.coalesce(partial, F.lit(False))),
        put("data_version", version),
        put("data_version_attempt", version),
        put("data_version_error", F.lit(None).cast("string")),
    )


def record_failures(scans: DataFrame, failures: DataFrame, data_version: int) -> DataFrame:
    """Scan rows after failed scans.

    A failed upgrade keeps its state and only notes the attempt; a failed first
    scan becomes an exception. ``failures``: ``product_id, error, finished``.
    """
    failed = F.col("error").isNotNull()
    upgrade = failed & (F.col("state") != "pending")
    first = failed & (F.col("state") == "pending")
    return scans.join(failures, "product_id", "left").select(
        "product_id",
        F.when(first, F.lit("exception")).otherwise(F.col("state")).alias("state"),
        F.when(failed, F.col("finished")).otherwise(F.col("last_scanned")).alias("last_scanned"),
        F.when(first, F.col("error")).otherwise(F.col("exception")).alias("exception"),
        F.when(upgrade, F.lit(data_version))
        .otherwise(F.col("data_version_attempt"))
        .alias("data_version_attempt"),
        F.when(upgrade, F.col("error"))
        .otherwise(F.col("data_version_error"))
        .alias("data_version_error"),
    )


def record_outcomes(told: DataFrame, data_version: int) -> DataFrame:
    """``record_results`` and ``record_failures`` of scan rows that carry what came of them.

    ``told`` is scan rows with ``new_state, finished, took_ms, key, key_maps, error``: no error and
    no state is a row that was not scanned, an error goes before a state.
    """
    failed = F.col("error").isNotNull()
    done = ~failed & F.col("new_state").isNotNull()
    first, upgrade = failed & (F.col("state") == "pending"), failed & (F.col("state") != "pending")
    locked = done & F.col("new_state").isin("encrypted_build", "encrypted_map_database")
    partial = done & (F.col("new_state") == "partial_decrypt")
    version, none = F.lit(data_version), F.lit(None).cast("string")

    def put(column: str, *cases: tuple[Column, Column]) -> Column:
        out = F.col(column)
        for when, value in cases:
            out = F.when(when, value).otherwise(out)
        return out

    return told.withColumns(
        {
            "state": put("state", (done, F.col("new_state")), (first, F.lit("exception"))),
            "last_scanned": put("last_scanned", (done | failed, F.col("finished"))),
            "scan_ms": put("scan_ms", (done, F.col("took_ms"))),
            "exception": put("exception", (first, F.col("error"))),
            "encrypted_key": put("encrypted_key", (locked, F.col("key"))),
            "encrypted_maps": put("encrypted_maps", (partial, F.col("key_maps"))),
            "data_version": put("data_version", (done, version)),
            "data_version_attempt": put("data_version_attempt", (done | upgrade, version)),
            "data_version_error": put("data_version_error", (done, none), (upgrade, F.col("error"))),
        }
    )


def affected_layers(layers: DataFrame, arrived: DataFrame) -> DataFrame:
    """Layer rows whose CDN-missing list names a hash that has now arrived."""
    named = layers.where(F.col("cdn_missing").isNotNull()).select(
        *LAYER_KEY, F.explode("cdn_missing").alias("hash")
    )
    return named.join(arrived.select("hash"), "hash", "left_semi").select(*LAYER_KEY).distinct()


def sweep(layers: DataFrame, arrived: DataFrame) -> DataFrame:
    """Layer rows with arrived hashes struck from their CDN-missing lists.

    A list that runs empty becomes null. ``swept`` marks changed rows. The
    arrived side is joined on the hash, so it may be of any size; a list holds
    at most one entry per grid cell.
    """
    named = layers.where(F.col("cdn_missing").isNotNull()).select(
        *LAYER_KEY, F.explode("cdn_missing").alias("hash")
    )
    here = arrived.select("hash").distinct().withColumn("_here", F.lit(True))
    left = (
        named.join(here, "hash", "left")
        .groupBy(*LAYER_KEY)
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("_here").isNull(), F.col("hash")))
            ).alias("_left"),
            F.bool_or(F.col("_here").isNotNull()).alias("_hit"),
        )
    )
    return layers.join(left, LAYER_KEY, "left").select(
        *[c for c in layers.columns if c != "cdn_missing"],
        F.when(F.size("_left") > 0, F.col("_left")).alias("cdn_missing"),
        F.coalesce("_hit", F.lit(False)).alias("swept"),
    )


def requeue_builds(scans: DataFrame, products: DataFrame, builds: DataFrame) -> DataFrame:
    """Put the scans of affected builds back to pending.

    ``builds`` are the swept builds without the one just scanned; scans are
    reached through their products. ``requeued`` marks changed rows.
    """
    hit = (
        products.join(builds.select("build_id").distinct(), "build_id", "left_semi")
        .select("product_id")
        .distinct()
        .withColumn("requeued", F.lit(True))
    )
    marked = scans.join(hit, "product_id", "left").withColumn(
        "requeued", F.coalesce("requeued", F.lit(False))
    )
    return marked.withColumn(
        "state", F.when(F.col("requeued"), F.lit("pending")).otherwise(F.col("state"))
    )


def requeue_all(scans: DataFrame) -> DataFrame:
    """Put everything that is not locked back to pending."""
    locked = F.col("state").isin("encrypted_build", "encrypted_map_database")
    return scans.withColumn("state", F.when(~locked, F.lit("pending")).otherwise(F.col("state")))


def layers_from_build_maps(layers: DataFrame, build_maps: DataFrame) -> DataFrame:
    """Minimap layer rows for compositions once kept on the build map itself."""
    moved = build_maps.where(F.col("composition_hash").isNotNull()).select(
        "build_id", "map_id", F.lit(0).alias("layer_type"), "composition_hash"
    )
    return moved.join(layers.select(*LAYER_KEY), LAYER_KEY, "left_anti")


def base_layer_maps(maps: DataFrame) -> DataFrame:
    """Maps with a layer one can look at."""
    return maps.where(F.col("layer_mask").bitwiseAND(F.lit(schema.BASE_LAYER_MASK)) != 0)
