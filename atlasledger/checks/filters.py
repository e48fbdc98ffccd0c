"""Filters and predicates over the derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger import schema
from atlasledger.checks import check
from atlasledger.checks.derive import (
    builds,
    cells,
    chunks,
    feed_versions,
    layers,
    products,
    sql,
    table,
    tiles,
)
from atlasledger.functions import labels
from atlasledger.functions.versions import decode_version, version_number
from atlasledger.operators import chunks as chunk_ops
from atlasledger.operators import discovery, merge, resolve
from atlasledger.sources.tables import layer_dimension

# Fixed values of the checks: what a service would have configured.
INCLUDE = ["auto*", "m?chinery-*", "BUILD*"]
EXCLUDE = ["building-2", "building-4", "automobile-8"]


def summary(spark, sf):
    """Feed summary lines: one product per customer, its sequence the order count."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        table(spark, sf, "customer")
        .join(counts, "c_custkey", "left")
        .select(
            F.concat_ws("-", F.lower("c_mktsegment"), "c_custkey").alias("name"),
            F.coalesce("n", F.lit(0)).alias("product_seqn"),
            F.when(F.col("c_acctbal") < 0, "cdn")
            .when(F.col("c_acctbal") > 8000, "bgdl")
            .otherwise("")
            .alias("flags"),
        )
    )


SUMMARY_SQL = """
, summary AS (
  SELECT lower(c_mktsegment) || '-' || c_custkey AS name, coalesce(n, 0) AS product_seqn,
         CASE WHEN c_acctbal < 0 THEN 'cdn' WHEN c_acctbal > 8000 THEN 'bgdl' ELSE '' END AS flags
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
)
"""


@check(
    "feed_product_filter",
    sql(SUMMARY_SQL + """
SELECT name, product_seqn, flags, flags = '' AS queried FROM summary
WHERE flags <> 'cdn' AND name NOT IN ('building-2', 'building-4', 'automobile-8')
  AND (name LIKE 'auto%' OR name LIKE 'm_chinery-%' OR name LIKE 'build%')"""),
)
def feed_product_filter(spark, sf):
    wanted = discovery.wanted_products(summary(spark, sf), INCLUDE)
    wanted = discovery.without(wanted, "name", EXCLUDE)
    asked = discovery.queried_products(wanted).withColumn("queried", F.lit(True))
    rest = wanted.where(F.col("flags") != "").withColumn("queried", F.lit(False))
    return asked.unionByName(rest)


@check(
    "map_allow_list",
    sql("""
SELECT map_id, count(*) AS n, count(*) FILTER (map_id IN (1, 2, 5)) AS allowed
FROM tiles GROUP BY 1"""),
)
def map_allow_list(spark, sf):
    t = tiles(spark, sf).select("map_id")
    everything = discovery.only(t, "map_id", []).withColumn("a", F.lit(0))
    allowed = discovery.only(t, "map_id", [1, 2, 5]).withColumn("a", F.lit(1))
    return everything.unionByName(allowed).groupBy("map_id").agg(
        F.count_if(F.col("a") == 0).alias("n"), F.count_if(F.col("a") == 1).alias("allowed")
    )


@check(
    "base_layer_filter",
    sql("""
, masks AS (
  SELECT map_id, bit_or(1 << layer_type) AS layer_mask FROM (
    SELECT map_id, layer_type FROM layers
    UNION ALL SELECT map_id, 3 FROM chunks WHERE impass UNION ALL SELECT map_id, 4 FROM chunks)
  GROUP BY 1
)
SELECT map_id, layer_mask FROM masks WHERE layer_mask & 3 <> 0"""),
)
def base_layer_filter(spark, sf):
    c = chunks(spark, sf)
    seen = (
        layers(spark, sf)
        .select("map_id", "layer_type")
        .unionByName(c.where("impass").select("map_id", F.lit(3).alias("layer_type")))
        .unionByName(c.select("map_id", F.lit(4).alias("layer_type")))
    )
    return merge.base_layer_maps(merge.layer_masks(seen))


THRESHOLDS = list(schema.BUILD_THRESHOLDS.items())


@check(
    "build_thresholds",
    sql("""
SELECT version, build_id, build_id >= 18014398509481984 AS no_liquid_tiles,
       build_id >= ((6::BIGINT << 52) | (1::BIGINT << 32) | 18125) AS content_archive,
       build_id >= (7::BIGINT << 52) AS expansion_seven,
       build_id >= ((7::BIGINT << 52) | (3::BIGINT << 32) | 21287) AS last_flat_tables,
       build_id >= 40532400941335738 AS row_file_ids
FROM builds"""),
)
def build_thresholds(spark, sf):
    flags = [(F.col("build_id") >= version_number(v)).alias(n) for n, v in THRESHOLDS]
    return builds(spark, sf).select("version", "build_id", *flags)


@check(
    "map_search",
    sql("""
SELECT p_partkey AS map_id, p_name AS name, p_type AS directory FROM part
WHERE contains(p_partkey::VARCHAR, 'ring') OR contains(lower(p_name), 'ring')
   OR contains(lower(p_type), 'ring')
ORDER BY 1"""),
)
def map_search(spark, sf):
    maps = table(spark, sf, "part").select(
        F.col("p_partkey").alias("map_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("directory"),
    )
    found = labels.search_text("  RING ", F.col("map_id"), F.col("name"), F.col("directory"))
    return maps.where(found).orderBy("map_id")


@check(
    "version_search",
    sql("""
, listed AS (
  SELECT build_id, version, string_agg(DISTINCT product, ' ' ORDER BY product) AS products
  FROM feed_versions GROUP BY 1, 2
)
SELECT * FROM listed WHERE contains(version, '.3.0.') OR contains(lower(products), '.3.0.')"""),
)
def version_search(spark, sf):
    # the products of one build: a short list
    listed = (
        products(spark, sf)
        .groupBy("build_id")
        .agg(F.array_join(F.sort_array(F.collect_set("product")), " ").alias("products"))
        .withColumn("version", decode_version(F.col("build_id")))
    )
    return listed.where(labels.search_text(".3.0.", F.col("version"), F.col("products")))


@check(
    "listed_cells",
    sql("""
SELECT build_id, map_id, x, y, 0 AS layer_type, minimap_texture AS fdid FROM cells
UNION ALL SELECT build_id, map_id, x, y, 1, map_texture FROM cells WHERE map_texture <> 0"""),
)
def listed_cells(spark, sf):
    return resolve.layer_cells(cells(spark, sf))


@check(
    "terrain_tile_count",
    sql("""
SELECT build_id, map_id, count(*) FILTER (root_adt <> 0) AS wdt_tile_count
FROM cells GROUP BY 1, 2"""),
)
def terrain_tile_count(spark, sf):
    return resolve.tile_counts(cells(spark, sf))


@check(
    "non_empty_bitsets",
    sql("""
SELECT map_id, x, y, count(*) FILTER (impass) AS chunks FROM chunks
GROUP BY 1, 2, 3 HAVING bool_or(impass)"""),
)
def non_empty_bitsets(spark, sf):
    keys = ["map_id", "x", "y"]
    bits = chunk_ops.non_empty(chunk_ops.impass_bitsets(chunks(spark, sf), keys))
    return (
        chunk_ops.chunks_of_bitsets(bits, keys).groupBy(*keys).agg(F.count("idx").alias("chunks"))
    )


@check(
    "tile_rectangle",
    sql("""
SELECT build_id, map_id, x, y, hash FROM tiles
WHERE x BETWEEN 26 AND 33 AND y BETWEEN 30 AND 45 AND x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63"""),
)
def tile_rectangle(spark, sf):
    inside = F.col("x").between(26, 33) & F.col("y").between(30, 45)
    return tiles(spark, sf).where(inside).select("build_id", "map_id", "x", "y", "hash")


@check(
    "layer_classes",
    sql("""
SELECT l.build_id, l.map_id, l.layer_type, v.layer_name, v.is_composition, v.is_data, v.is_base,
       v.is_composition <> v.is_data AS one_class
FROM (SELECT build_id, map_id, layer_type FROM layers
      UNION SELECT DISTINCT 0, map_id, 3 FROM chunks WHERE impass
      UNION SELECT DISTINCT 0, map_id, 4 FROM chunks) l
JOIN (VALUES (0, 'minimap', true, false, true), (1, 'map_texture', true, false, true),
             (2, 'no_liquid', true, false, false), (3, 'impass', false, true, false),
             (4, 'area_id', false, true, false))
     v(layer_type, layer_name, is_composition, is_data, is_base) ON v.layer_type = l.layer_type"""),
)
def layer_classes(spark, sf):
    c = chunks(spark, sf).withColumn("build_id", F.lit(0).cast("bigint"))
    rows = (
        layers(spark, sf)
        .select("build_id", "map_id", "layer_type")
        .unionByName(
            c.where("impass").select("build_id", "map_id", F.lit(3).alias("layer_type")).distinct()
        )
        .unionByName(c.select("build_id", "map_id", F.lit(4).alias("layer_type")).distinct())
    )
    return rows.join(layer_dimension(spark), "layer_type").withColumn(
        "one_class", F.col("is_composition") != F.col("is_data")
    )


@check(
    "single_region",
    sql("""
SELECT product, version, count(*) FILTER (region = 'EUROPE') AS matches,
       count(*) FILTER (region = 'EUROPE') = 1 AS ok
FROM feed_versions GROUP BY 1, 2"""),
)
def single_region(spark, sf):
    return discovery.single_region(feed_versions(spark, sf), ["product", "version"], "EUROPE")
