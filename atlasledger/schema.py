"""Declared schemas of the catalogue tables and of the facts a scan reads."""

from __future__ import annotations

from pyspark.sql import types as T

# The five layers, their codes and the classes they belong to.
LAYERS = [
    # code, name, is_composition, is_data, is_base
    (0, "minimap", True, False, True),
    (1, "map_texture", True, False, True),
    (2, "no_liquid", True, False, False),
    (3, "impass", False, True, False),
    (4, "area_id", False, True, False),
]
LAYER_SCHEMA = (
    "layer_type int, layer_name string, is_composition boolean, is_data boolean, is_base boolean"
)
BASE_LAYER_MASK = 3
DATA_LAYERS = (3, 4)

# The states a product scan can be in.
SCAN_STATES = (
    "pending",
    "exception",
    "encrypted_build",
    "encrypted_map_database",
    "partial_decrypt",
    "full_decrypt",
)

# Layer names used before the rename, and what they became.
LEGACY_LAYER_NAMES = {
    "maptexture": "map_texture",
    "noliquid": "no_liquid",
    "areaid": "area_id",
}

# Version thresholds a scan consults.
BUILD_THRESHOLDS = {
    "no_liquid_tiles": "4.0.0.0",
    "content_archive": "6.0.1.18125",
    "expansion_seven": "7.0.0.0",
    "last_flat_tables": "7.0.3.21287",
    "row_file_ids": "9.0.1.33978",
}

TABLES: dict[str, str] = {
    "builds": "id bigint, version string, discovered timestamp",
    "products": "id bigint, build_id bigint, product string, config_regions array<string>, "
    "first_seen timestamp",
    "product_sources": "id bigint, product_id bigint, config_build string, config_cdn string, "
    "config_product string, config_regions array<string>, first_seen timestamp",
    "product_scans": "product_id bigint, state string, last_scanned timestamp, "
    "scan_time interval day to second, exception string, encrypted_key string, "
    "encrypted_maps map<string,array<int>>, data_version int, data_version_attempt int, "
    "data_version_error string",
    "maps": "id int, json string, directory string, name string, name_history map<bigint,string>, "
    "first_seen bigint, last_seen bigint, parent int, layer_mask int",
    "build_maps": "build_id bigint, map_id int, wdt_tile_count smallint",
    "build_map_layers": "build_id bigint, map_id int, layer_type int, composition_hash string, "
    "data_hash string, cdn_missing array<string>",
    "compositions": "hash string, composition string, tiles int, x0 smallint, y0 smallint, "
    "x1 smallint, y1 smallint",
    "minimap_tiles": "hash string, tile_size smallint",
    "data_blobs": "hash string, data binary",
    "adt_data_extractions": "adt_hash string, layer_type int, data_hash string",
    "tact_keys": "key_name string, key binary",
    "settings": "key string, value string",
    # facts a scan reads
    "map_rows": "build_id bigint, id int, directory string, name string, wdt_fdid bigint, "
    "parent_id int, cosmetic_parent_id int",
    "maid": "build_id bigint, map_id int, x int, y int, root_adt bigint, obj0_adt bigint, "
    "obj1_adt bigint, tex0_adt bigint, lod_adt bigint, map_texture bigint, map_texture_n bigint, "
    "minimap_texture bigint",
    "file_index": "build_id bigint, fdid bigint, ckey string",
    "chunk_headers": "adt_hash string, index_x int, index_y int, flags bigint, area_id bigint, "
    "position_z float, heights array<float>",
    "area_table": "build_id bigint, id bigint, parent_area_id bigint, area_name string, "
    "zone_name string, continent_id int",
    "feed_versions": "seqn bigint, product string, region string, build_config string, "
    "cdn_config string, version string, product_config string",
    "viewports": "view_id bigint, center_x double, center_y double, zoom double, width int, "
    "height int",
    "event_log": "key string, seq bigint, msg string",
}


def struct(table: str) -> T.StructType:
    """The schema of one catalogue table."""
    return T.StructType.fromDDL(TABLES[table])
