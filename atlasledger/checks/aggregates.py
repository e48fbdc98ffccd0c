"""Aggregations: feeds, chunk layers, areas, constraints and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import areas, builds, chunks, feed_versions, sql, table
from atlasledger.operators import areas as area_ops
from atlasledger.operators import chunks as chunk_ops
from atlasledger.operators import discovery, terrain
from atlasledger.operators import scans as scan_ops
from atlasledger.session import checkpointed

TILE = ["map_id", "x", "y"]


@check(
    "locked_maps_by_key",
    sql("""
SELECT l_orderkey AS scan_id, lower(l_returnflag || l_linestatus) AS key_name,
       string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS map_ids
FROM lineitem GROUP BY 1, 2"""),
)
def locked_maps_by_key(spark, sf):
    locked = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        F.concat("l_returnflag", "l_linestatus").alias("key_name"),
        F.col("l_linenumber").alias("map_id"),
    )
    out = scan_ops.locked_maps_by_key(locked, ["scan_id"])
    return out.withColumn("map_ids", F.array_join("map_ids", ","))


@check(
    "product_sightings",
    sql("""
SELECT build_id, product, string_agg(DISTINCT region, ' ' ORDER BY region) AS config_regions
FROM feed_versions GROUP BY 1, 2"""),
)
def product_sightings(spark, sf):
    out = discovery.product_sightings(feed_versions(spark, sf))
    return out.withColumn("config_regions", F.array_join("config_regions", " "))


@check(
    "source_sightings",
    sql("""
SELECT build_id, product, build_config, cdn_config, product_config,
       string_agg(DISTINCT region, ' ' ORDER BY region) AS config_regions
FROM feed_versions GROUP BY 1, 2, 3, 4, 5"""),
)
def source_sightings(spark, sf):
    out = discovery.source_sightings(feed_versions(spark, sf))
    return out.withColumn("config_regions", F.array_join("config_regions", " "))


@check(
    "distinct_versions",
    sql("SELECT count(*) AS feed_rows, count(DISTINCT version) AS versions FROM feed_versions"),
)
def distinct_versions(spark, sf):
    return discovery.version_count(feed_versions(spark, sf))


GRID_SQL = """
, tile_grid AS (
  SELECT t.map_id, t.x, t.y, i.idx, coalesce(c.area_id, 0) AS area_id,
         coalesce(c.impass, false) AS impass
  FROM (SELECT DISTINCT map_id, x, y FROM chunks) t CROSS JOIN range(256) i(idx)
  LEFT JOIN chunks c ON c.map_id = t.map_id AND c.x = t.x AND c.y = t.y AND c.idx = i.idx
),
bitsets AS (
  SELECT map_id, x, y, string_agg(printf('%02x', v), '' ORDER BY byte) AS bits
  FROM (SELECT map_id, x, y, idx // 8 AS byte,
               sum(CASE WHEN impass THEN 1 << (idx % 8)::INT ELSE 0 END)::BIGINT AS v
        FROM tile_grid GROUP BY 1, 2, 3, 4)
  GROUP BY 1, 2, 3
),
grids AS (
  SELECT map_id, x, y, string_agg(area_id, ',' ORDER BY idx) AS area_ids
  FROM tile_grid GROUP BY 1, 2, 3
)
"""


@check(
    "impassable_bitsets",
    sql(GRID_SQL + "SELECT map_id, x, y, bits FROM bitsets"),
)
def impassable_bitsets(spark, sf):
    return chunk_ops.impass_bitsets(chunks(spark, sf), TILE)


@check(
    "area_grids",
    sql(GRID_SQL + "SELECT map_id, x, y, area_ids FROM grids"),
)
def area_grids(spark, sf):
    out = chunk_ops.area_grids(chunks(spark, sf), TILE)
    return out.withColumn("area_ids", F.array_join("area_ids", ","))


@check(
    "impassable_document",
    sql(GRID_SQL + """
, docs AS (
  SELECT map_id, '{"tiles":{' || string_agg('"' || x || ',' || y || '":"' || base64(unhex(bits)) || '"',
                                            ',' ORDER BY x || ',' || y) || '}}' AS document
  FROM bitsets WHERE bits <> repeat('00', 32) GROUP BY 1
)
SELECT map_id, document, md5(document) AS data_hash FROM docs"""),
)
def impassable_document(spark, sf):
    bits = chunk_ops.impass_bitsets(chunks(spark, sf), TILE)
    return chunk_ops.impass_documents(bits, ["map_id"])


def embedded(spark, sf):
    return areas(spark, sf).select(
        "area_id",
        F.col("area_id").alias("ID"),
        F.col("parent_id").alias("ParentAreaID"),
        F.col("name").alias("AreaName_lang"),
        F.col("internal_name").alias("ZoneName"),
        F.col("continent_id").alias("ContinentID"),
    )



CLOSURE_CTE = """
, closure AS (
  SELECT DISTINCT map_id, area_id FROM chunks WHERE area_id <> 0
  UNION
  SELECT c.map_id, a.parent_id FROM closure c JOIN areas a ON a.area_id = c.area_id
  WHERE a.parent_id <> 0
)
"""


@check(
    "area_document",
    sql(GRID_SQL + CLOSURE_CTE + """
, area_text AS (
  SELECT c.map_id, '{' || string_agg('"' || a.area_id || '":{"ID":' || a.area_id
           || ',"ParentAreaID":' || a.parent_id || ',"AreaName_lang":"' || a.name
           || '","ZoneName":"' || a.internal_name || '","ContinentID":' || a.continent_id || '}',
           ',' ORDER BY a.area_id::VARCHAR) || '}' AS areas
  FROM closure c JOIN areas a ON a.area_id = c.area_id GROUP BY 1
),
tile_text AS (
  SELECT map_id, '{' || string_agg('"' || x || ',' || y || '":[' || area_ids || ']', ','
                                   ORDER BY x || ',' || y) || '}' AS tiles
  FROM grids GROUP BY 1
),
docs AS (
  SELECT t.map_id, '{"tiles":' || t.tiles || ',"areas":' || a.areas || '}' AS document
  FROM tile_text t JOIN area_text a ON a.map_id = t.map_id
)
SELECT map_id, length(document) AS chars, md5(document) AS data_hash FROM docs"""),
)
def area_document(spark, sf):
    c = chunks(spark, sf)
    grids = chunk_ops.area_grids(c, TILE).select(
        *TILE, F.to_json("area_ids").alias("area_text"), F.array_distinct("area_ids").alias("owned")
    )
    grids = checkpointed(grids)  # counted, then read
    parents = areas(spark, sf).select("area_id", "parent_id")
    docs = chunk_ops.data_documents(
        grids,
        embedded(spark, sf),
        ["map_id"],
        lambda owned: area_ops.ancestor_closure(owned, parents, ["map_id"], placed=True),
        grids.select("map_id").distinct().count(),
    )
    text = F.col("area")
    return docs.select("map_id", F.length(text).alias("chars"), F.md5(text.cast("binary")).alias("data_hash"))


@check(
    "referenced_areas",
    sql("SELECT DISTINCT map_id, area_id FROM chunks WHERE area_id <> 0"),
)
def referenced_areas(spark, sf):
    return chunk_ops.referenced_areas(chunks(spark, sf), ["map_id"])


@check(
    "area_boxes",
    sql("""
SELECT map_id, area_id, min(x + (idx % 16) / 16.0) AS min_x, min(y + (idx // 16) / 16.0) AS min_y,
       max(x + (idx % 16) / 16.0 + 1 / 16.0) AS max_x, max(y + (idx // 16) / 16.0 + 1 / 16.0) AS max_y
FROM chunks GROUP BY 1, 2"""),
)
def area_boxes(spark, sf):
    return chunk_ops.area_boxes(chunks(spark, sf), ["map_id"])


@check(
    "area_masks",
    sql(GRID_SQL + """
, wanted AS (SELECT map_id, min(area_id) AS area_id FROM chunks WHERE area_id <> 0 GROUP BY 1)
SELECT g.map_id, g.x, g.y, w.area_id,
       string_agg(CASE WHEN g.area_id = w.area_id THEN 255 ELSE 0 END, ',' ORDER BY idx) AS mask
FROM tile_grid g JOIN wanted w ON w.map_id = g.map_id
GROUP BY 1, 2, 3, 4 HAVING bool_or(g.area_id = w.area_id)"""),
)
def area_masks(spark, sf):
    c = chunks(spark, sf)
    wanted = c.where(F.col("area_id") != 0).groupBy("map_id").agg(F.min("area_id").alias("area_id"))
    out = chunk_ops.area_masks(chunk_ops.area_grids(c, TILE), wanted, ["map_id"])
    return out.withColumn("mask", F.array_join("mask", ","))


@check(
    "areas_with_chunks",
    sql("""
SELECT map_id, count(DISTINCT area_id) FILTER (area_id <> 0) AS areas,
       bool_or(area_id = 0) AS has_unassigned
FROM chunks GROUP BY 1"""),
)
def areas_with_chunks(spark, sf):
    return area_ops.areas_with_chunks(chunks(spark, sf), ["map_id"])


@check(
    "area_name_ambiguity",
    sql("SELECT name, count(DISTINCT area_id) AS same_name FROM areas GROUP BY 1"),
)
def area_name_ambiguity(spark, sf):
    return area_ops.name_ambiguity(areas(spark, sf), [])


@check(
    "continent_roots",
    sql(CLOSURE_CTE + """
, embedded AS (SELECT c.map_id, a.* FROM closure c JOIN areas a ON a.area_id = c.area_id)
SELECT map_id, continent_id, count(*) AS roots, min(name) AS first_name, max(name) AS last_name
FROM embedded e
WHERE NOT EXISTS (SELECT 1 FROM embedded p WHERE p.map_id = e.map_id AND p.area_id = e.parent_id)
GROUP BY 1, 2
UNION ALL
SELECT DISTINCT map_id, map_id, 1, 'Unassigned', 'Unassigned' FROM chunks WHERE area_id = 0"""),
)
def continent_roots(spark, sf):
    c = chunks(spark, sf)
    table_ = areas(spark, sf)
    # a map's areas meet their roots before they meet each other; no area has the number 0
    found = F.when(F.col("area_id") == 0, F.col("area_id")).otherwise(F.col("root_id")).alias("area_id")
    mine = c.select("map_id", "area_id").join(area_ops.roots(table_).drop("depth"), "area_id", "left").select("map_id", found)
    mine = checkpointed(mine.where(F.col("area_id").isNotNull()).distinct())
    roots = mine.join(table_, "area_id").select("map_id", "continent_id", "name")
    synthetic = area_ops.unassigned_zones(mine).select("map_id", "continent_id", "name")
    # the synthetic zone forms a group of its own, named after nothing else
    return (
        roots.withColumn("synthetic", F.lit(False))
        .unionByName(synthetic.withColumn("synthetic", F.lit(True)))
        .groupBy("map_id", "continent_id", "synthetic")
        .agg(
            F.count(F.lit(1)).alias("roots"),
            F.min("name").alias("first_name"),
            F.max("name").alias("last_name"),
        )
        .drop("synthetic")
    )


@check(
    "repeated_region_rows",
    sql("""
SELECT c_custkey AS product_id, n_regionkey || ' ' || (c_nationkey % 7) || ' ' || (c_custkey % 5) AS regions
FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey = c_nationkey % 7 OR n_regionkey = c_custkey % 5 OR c_nationkey % 7 = c_custkey % 5"""),
)
def repeated_region_rows(spark, sf):
    lists = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            F.col("c_custkey").alias("product_id"),
            F.array(
                F.col("n_regionkey").cast("string"),
                (F.col("c_nationkey") % 7).cast("string"),
                (F.col("c_custkey") % 5).cast("string"),
            ).alias("config_regions"),
        )
    )
    out = discovery.repeated_regions(lists)
    return out.select("product_id", F.array_join("config_regions", " ").alias("regions"))


@check(
    "mismatched_builds",
    sql("""
SELECT version, build_id + (CASE WHEN b > 20 THEN 1 ELSE 0 END) AS build_id FROM builds WHERE b > 20"""),
)
def mismatched_builds(spark, sf):
    stated = builds(spark, sf).select(
        "version", (F.col("build_id") + F.when(F.col("b") > 20, 1).otherwise(0)).alias("build_id")
    )
    return discovery.mismatched_builds(stated)


def patches(spark, sf):
    """Height patches: a vector is a chunk of the tile its label names."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("tile"),
        (F.col("vec_id") % 16).cast("int").alias("index_x"),
        F.floor(F.col("vec_id") / 16).cast("int").alias("index_y"),
        F.col("label").cast("double").alias("position_z"),
        F.transform("embedding", lambda v: v.cast("double")).alias("heights"),
    )


@check(
    "terrain_height_stats",
    sql("""
SELECT tile, min(h) AS min_height, max(h) AS max_height, count(*) AS heights
FROM (SELECT label AS tile, unnest(embedding)::DOUBLE + label AS h FROM embeddings) GROUP BY 1"""),
)
def terrain_height_stats(spark, sf):
    return terrain.height_stats(patches(spark, sf), ["tile"])


@check(
    "terrain_grey_pixels",
    sql("""
, points AS (
  SELECT label AS tile, vec_id % 16 AS cx, vec_id // 16 AS cy, label AS base,
         unnest(embedding)::DOUBLE + label AS h, unnest(range(len(embedding))) AS i
  FROM embeddings
),
pixels AS (
  SELECT tile, cx * 8 + CASE WHEN i % 17 >= 9 THEN i % 17 - 9 ELSE i % 17 END AS px,
         cy * 16 + (i // 17) * 2 + CASE WHEN i % 17 >= 9 THEN 1 ELSE 0 END AS py,
         arg_max(h, cy * 16 + cx) AS h
  FROM points GROUP BY 1, 2, 3
),
stats AS (SELECT tile, min(h) AS lo, max(h) AS hi FROM points GROUP BY 1)
SELECT p.tile, px, py,
       CASE WHEN h = 0 THEN 0 WHEN hi - lo <= 0 THEN 128
            ELSE floor(least(255, greatest(0, (h - lo) / (hi - lo) * 255)))::INT END AS grey
FROM pixels p JOIN stats s ON s.tile = p.tile"""),
)
def terrain_grey_pixels(spark, sf):
    return terrain.grey_pixels(patches(spark, sf), ["tile"])
