"""Compositions, pyramids and tile sizes over the derived tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import (
    LAYER_KEYS,
    build_count,
    layer_tiles,
    shipment_pieces,
    sql,
    tile_sizes,
    tiles,
)
from atlasledger.operators import compose, lod
from atlasledger.operators.history import group_ranges, version_groups
from atlasledger.sources import documents

KEYS = ["build_id", "map_id"]


@check(
    "composition_hash",
    sql("""
SELECT build_id, map_id, layer_type, composition_hash FROM compositions"""),
)
def composition_hash(spark, sf):
    out = compose.compositions(layer_tiles(spark, sf, placed=True), LAYER_KEYS, placed=True)
    return out.select("build_id", "map_id", "layer_type", "composition_hash")


@check(
    "composition_extents",
    sql("""
SELECT build_id, map_id, layer_type, tiles, missing, tiles + missing AS total, x0, y0, x1, y1,
       x1 + 1 AS max_x, y1 + 1 AS max_y, x1 - x0 + 1 AS width, y1 - y0 + 1 AS height,
       x0 + (x1 - x0 + 1) / 2.0 AS center_x, y0 + (y1 - y0 + 1) / 2.0 AS center_y
FROM compositions"""),
)
def composition_extents(spark, sf):
    comps = compose.compositions(layer_tiles(spark, sf, placed=True), LAYER_KEYS, placed=True)
    out = compose.viewer_bounds(comps)
    return out.select(
        "build_id", "map_id", "layer_type", "tiles", "missing",
        (F.col("tiles") + F.col("missing")).alias("total"),
        "x0", "y0", "x1", "y1", "max_x", "max_y", "width", "height", "center_x", "center_y",
    )


LOD_SQL = """
, lod_children AS (
  SELECT build_id, map_id, level, (x >> level) << level AS lx, (y >> level) << level AS ly, x, y,
         CASE WHEN cdn_missing THEN repeat('67', 16) ELSE hash END AS h, hash
  FROM tiles, range(1, 7) t(level) WHERE hash IS NOT NULL
),
lod_slots AS (
  SELECT build_id, map_id, level, lx, ly, slot,
         lx + slot % (1 << level) AS x, ly + slot // (1 << level) AS y
  FROM (SELECT DISTINCT build_id, map_id, level, lx, ly FROM lod_children),
       range(4096) s(slot)
  WHERE slot < (1 << (2 * level))
),
lod AS (
  SELECT s.build_id, s.map_id, s.level, s.lx AS x, s.ly AS y,
         md5(unhex(string_agg(coalesce(c.h, repeat('00', 16)), '' ORDER BY s.slot))) AS hash,
         md5(string_agg(coalesce(c.hash, '-'), ',' ORDER BY s.slot)) AS components,
         count(*) AS slots, count(*) - count(c.h) AS holes
  FROM lod_slots s LEFT JOIN lod_children c
    ON c.build_id = s.build_id AND c.map_id = s.map_id AND c.level = s.level
    AND c.x = s.x AND c.y = s.y
  GROUP BY 1, 2, 3, 4, 5
)
"""


@check(
    "lod_pyramid",
    sql(LOD_SQL + "SELECT build_id, map_id, level, x, y, hash FROM lod"),
)
def lod_pyramid(spark, sf):
    return lod.lod_cells(tiles(spark, sf, placed=True), KEYS, placed=True)


@check(
    "lod_pyramid_update",
    sql(LOD_SQL + "SELECT build_id, map_id, level, x, y, hash FROM lod"),
)
def lod_pyramid_update(spark, sf):
    """Each build's pyramid out of the one before it of the same map; the first builds' in full."""
    return lod.lod_history(tiles(spark, sf, placed=True), KEYS, "build_id", placed=True)


@check(
    "lod_level_summary",
    sql(LOD_SQL + """
SELECT level, count(*) AS cells, count(DISTINCT hash) AS hashes FROM lod GROUP BY 1"""),
)
def lod_level_summary(spark, sf):
    return lod.lod_summary(lod.lod_cells(tiles(spark, sf, placed=True), KEYS, placed=True))


@check(
    "lod_components",
    sql(LOD_SQL + """
SELECT build_id, map_id, level, x, y, slots, holes, components FROM lod"""),
)
def lod_components(spark, sf):
    out = lod.lod_components(tiles(spark, sf), KEYS)
    text = F.array_join("components", ",", "-")
    return out.select(
        "build_id", "map_id", "level", "x", "y",
        F.size("components").alias("slots"),
        (F.size("components") - F.size(F.array_compact("components"))).alias("holes"),
        F.md5(text.cast("binary")).alias("components"),
    )


@check(
    "lod_consistency",
    sql(LOD_SQL + """
SELECT hash FROM lod GROUP BY 1 HAVING count(DISTINCT components) > 1
UNION SELECT hash FROM lod WHERE level = 6"""),
)
def lod_consistency(spark, sf):
    both = lod.digested_cells(tiles(spark, sf, placed=True), KEYS, placed=True)
    # a clash at the top of every pyramid: the same hash for other components
    other = F.when(F.col("level") == 6, F.array("digest", F.md5("digest"))).otherwise(F.array("digest"))
    return lod.inconsistent_cells(both.select("hash", F.explode(other).alias("digest")), "hash", "digest")


@check(
    "lod_tile_cache",
    sql(LOD_SQL + """
, cache AS (
  SELECT build_id, map_id, 0 AS level, x, y, hash FROM tiles WHERE hash IS NOT NULL AND NOT cdn_missing
  UNION ALL SELECT build_id, map_id, level, x, y, hash FROM lod
)
SELECT build_id, map_id, level, hash, string_agg(x || ',' || y, ' ' ORDER BY x, y) AS coords
FROM cache GROUP BY 1, 2, 3, 4"""),
)
def lod_tile_cache(spark, sf):
    t = tiles(spark, sf, placed=True)
    out = lod.coords_by_hash(t, lod.lod_cells(t, KEYS, placed=True), KEYS)
    texts = F.transform("coords", lambda c: F.concat_ws(",", c["x"], c["y"]))
    return out.withColumn("coords", F.array_join(texts, " "))


SIZED_SQL = """
, sized AS (
  SELECT t.build_id, t.map_id, t.x, t.y, t.hash,
         CASE WHEN NOT t.cdn_missing THEN s.tile_size END AS tile_size
  FROM tiles t JOIN tile_sizes s ON s.hash = t.hash
)
"""


@check(
    "composition_tile_size",
    sql(SIZED_SQL + """
, counted AS (
  SELECT build_id, map_id, tile_size, count(*) AS n FROM sized GROUP BY 1, 2, 3
)
SELECT build_id, map_id,
       coalesce(arg_max(tile_size, n * 100000 + tile_size) FILTER (tile_size IS NOT NULL), 512)
         AS tile_size,
       CASE WHEN count(tile_size) > 1
            THEN string_agg(tile_size || 'px=' || n, ', ' ORDER BY tile_size)
                 FILTER (tile_size IS NOT NULL) END AS mixed
FROM counted GROUP BY 1, 2"""),
)
def composition_tile_size(spark, sf):
    return compose.composition_tile_sizes(tiles(spark, sf), tile_sizes(spark, sf), KEYS)


@check(
    "lod_tile_size",
    sql(SIZED_SQL + """
SELECT build_id, map_id, level, (x >> level) << level AS x, (y >> level) << level AS y,
       greatest(coalesce(max(tile_size), 0), 64) AS tile_size
FROM sized, range(1, 7) t(level) GROUP BY 1, 2, 3, 4, 5"""),
)
def lod_tile_size(spark, sf):
    t, pieces = tiles(spark, sf, placed=True), shipment_pieces(spark, sf)
    return lod.lod_tile_sizes(t, tile_sizes(spark, sf), KEYS, placed=True, pieces=pieces)


@check(
    "layer_metrics",
    sql("""
, store AS (SELECT hash FROM tile_sizes WHERE tile_size = 256),
per_layer AS (
  SELECT build_id, map_id, layer_type, t.hash, count(*) AS n, bool_or(cdn_missing) AS cdn,
         bool_or(s.hash IS NULL) AS new
  FROM layer_tiles t LEFT JOIN store s ON s.hash = t.hash
  WHERE t.hash IS NOT NULL GROUP BY 1, 2, 3, 4
)
SELECT build_id, map_id, layer_type, sum(n)::BIGINT AS total_tiles, count(*) AS unique_tiles,
       count(*) FILTER (new) AS new_tiles, count(*) FILTER (cdn) AS cdn_missing,
       round(count(*) FILTER (new) * 100.0 / count(*), 4) AS new_percent
FROM per_layer GROUP BY 1, 2, 3"""),
)
def layer_metrics(spark, sf):
    store = tile_sizes(spark, sf).where(F.col("tile_size") == 256)
    return compose.layer_metrics(
        layer_tiles(spark, sf), ["build_id", "map_id", "layer_type"], store
    ).withColumn("new_percent", F.col("new_percent").cast("double"))


@check(
    "cdn_missing_per_layer",
    sql("""
SELECT build_id, map_id, layer_type, array_to_string(cdn_missing, ' ') AS cdn_missing
FROM compositions"""),
)
def cdn_missing_per_layer(spark, sf):
    out = compose.cdn_missing_hashes(
        layer_tiles(spark, sf), ["build_id", "map_id", "layer_type"]
    )
    return out.withColumn("cdn_missing", F.array_join("cdn_missing", " "))


DOCUMENT_SQL = """
, by_hash AS (
  SELECT t.build_id, t.map_id, t.hash, max(s.tile_size) AS tile_size,
         '[' || string_agg('"' || x || ',' || y || '"', ',' ORDER BY x, y) || ']' AS coords,
         t.hash[15:16] || t.hash[13:14] || t.hash[11:12] || t.hash[9:10]
         || t.hash[7:8] || t.hash[5:6] || t.hash[3:4] || t.hash[1:2]
         || t.hash[31:32] || t.hash[29:30] || t.hash[27:28] || t.hash[25:26]
         || t.hash[23:24] || t.hash[21:22] || t.hash[19:20] || t.hash[17:18] AS hash_order
  FROM tiles t LEFT JOIN tile_sizes s ON s.hash = t.hash
  GROUP BY 1, 2, 3
),
docs AS (
  SELECT build_id, map_id,
    '{"tiles":{' || coalesce(string_agg('"' || hash || '":' || coords, ',' ORDER BY hash_order)
                             FILTER (hash IS NOT NULL), '') || '}'
    || coalesce(',"missing":' || max(coords) FILTER (hash IS NULL), '')
    || coalesce(',"tileSize":' || max(tile_size), '') || '}' AS document
  FROM by_hash GROUP BY 1, 2
)
"""


def composition_docs(spark, sf):
    sized = tiles(spark, sf).join(tile_sizes(spark, sf), "hash", "left")
    return documents.composition_documents(sized, KEYS)


@check(
    "composition_document_write",
    sql(DOCUMENT_SQL + "SELECT build_id, map_id, document FROM docs"),
)
def composition_document_write(spark, sf):
    return composition_docs(spark, sf)


@check(
    "composition_document_read",
    sql("SELECT build_id, map_id, x, y, hash FROM tiles"),
)
def composition_document_read(spark, sf):
    docs = composition_docs(spark, sf)
    held = documents.composition_tiles(docs, "document", KEYS)
    holes = documents.composition_missing(docs, "document", KEYS)
    return held.unionByName(holes.withColumn("hash", F.lit(None).cast("string")))


@check(
    "version_groups",
    sql("""
, marked AS (
  SELECT *, CASE WHEN composition_hash IS NOT DISTINCT FROM
                      lag(composition_hash) OVER (PARTITION BY map_id ORDER BY build_id)
                 THEN 0 ELSE 1 END AS step
  FROM compositions WHERE layer_type = 0
)
SELECT map_id, build_id, composition_hash,
       (sum(step) OVER (PARTITION BY map_id ORDER BY build_id))::BIGINT AS group_no,
       step = 1 AS first_of_group
FROM marked"""),
)
def version_groups_query(spark, sf):
    comps = compose.compositions(tiles(spark, sf), KEYS).select(*KEYS, "composition_hash")
    bound = build_count(spark, sf)
    return version_groups(comps, ["map_id"], "composition_hash", bound).select(
        "map_id", "build_id", "composition_hash", "group_no", "first_of_group"
    )


@check(
    "version_group_ranges",
    sql("""
, marked AS (
  SELECT *, CASE WHEN composition_hash IS NOT DISTINCT FROM
                      lag(composition_hash) OVER (PARTITION BY map_id ORDER BY build_id)
                 THEN 0 ELSE 1 END AS step
  FROM compositions WHERE layer_type = 0
),
grouped AS (
  SELECT *, (sum(step) OVER (PARTITION BY map_id ORDER BY build_id))::BIGINT AS group_no FROM marked
)
SELECT map_id, group_no, min(build_id) AS oldest, max(build_id) AS newest, count(*) AS builds
FROM grouped GROUP BY 1, 2"""),
)
def version_group_ranges(spark, sf):
    comps = compose.compositions(tiles(spark, sf), KEYS).select(*KEYS, "composition_hash")
    grouped = version_groups(comps, ["map_id"], "composition_hash", build_count(spark, sf))
    return group_ranges(grouped, ["map_id"])
