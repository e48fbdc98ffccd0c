"""Merges over derived current and incoming rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import (
    builds,
    cells,
    feed_versions,
    layers,
    products,
    scans,
    sql,
    table,
    tile_sizes,
    tiles,
)
from atlasledger.operators import compose, discovery, merge

KEYS = ["build_id", "map_id"]


@check(
    "merge_builds",
    sql("""
SELECT build_id, version FROM builds WHERE build_id NOT IN (SELECT build_id FROM feed_versions)"""),
)
def merge_builds(spark, sf):
    held = products(spark, sf).select("build_id").distinct()
    return merge.new_rows(held, builds(spark, sf).select("build_id", "version"), ["build_id"])


@check(
    "merge_products",
    sql("""
, f AS (SELECT v.*, o_totalprice > 480000 AS early FROM feed_versions v JOIN orders ON o_orderkey = order_no),
held AS (SELECT build_id, product, list_sort(list(DISTINCT region)) AS r FROM f WHERE early GROUP BY 1, 2),
seen AS (SELECT build_id, product, list_sort(list(DISTINCT region)) AS r FROM f WHERE NOT early GROUP BY 1, 2),
m AS (
  SELECT coalesce(h.build_id, s.build_id) AS build_id, coalesce(h.product, s.product) AS product,
         coalesce(h.r, []) AS old, h.r IS NULL AS is_new,
         list_sort(list_filter(coalesce(s.r, []), lambda x: NOT list_contains(coalesce(h.r, []), x))) AS added
  FROM held h FULL JOIN seen s ON s.build_id = h.build_id AND s.product = h.product
)
SELECT build_id, product, array_to_string(old || added, ' ') AS config_regions,
       array_to_string(added, ' ') AS new_regions, is_new OR len(added) > 0 AS processed FROM m"""),
)
def merge_products(spark, sf):
    f = priced_feed(spark, sf)
    early = F.col("o_totalprice") > 480000
    out = merge.merge_products(
        discovery.product_sightings(f.where(early)), discovery.product_sightings(f.where(~early))
    )
    for name in ("config_regions", "new_regions"):
        out = out.withColumn(name, F.array_join(name, " "))
    return out


def priced_feed(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_no"), "o_totalprice", "o_orderstatus"
    )
    return feed_versions(spark, sf).join(orders, "order_no")


@check(
    "merge_sources",
    sql("""
, p AS (SELECT p.*, o_totalprice, o_orderstatus FROM products p JOIN orders ON o_orderkey = product_id),
held AS (SELECT build_id, config_build, config_cdn, config_product, min(first_seen) AS first_seen,
                string_agg(DISTINCT region, ' ' ORDER BY region) AS r
         FROM p WHERE o_totalprice > 150000 GROUP BY 1, 2, 3, 4),
seen AS (SELECT build_id, config_build, config_cdn, config_product, '2025-01-01' AS first_seen,
                string_agg(DISTINCT region, ' ' ORDER BY region) AS r
         FROM p WHERE o_totalprice < 200000 GROUP BY 1, 2, 3, 4)
SELECT coalesce(h.build_id, s.build_id) AS product_id, coalesce(h.config_build, s.config_build) AS config_build,
       coalesce(h.config_cdn, s.config_cdn) AS config_cdn,
       coalesce(h.config_product, s.config_product) AS config_product,
       coalesce(s.r, h.r) AS config_regions, coalesce(h.first_seen, s.first_seen) AS first_seen
FROM held h FULL JOIN seen s ON s.build_id = h.build_id AND s.config_build = h.config_build
  AND s.config_cdn = h.config_cdn AND s.config_product = h.config_product"""),
)
def merge_sources(spark, sf):
    p = products(spark, sf).join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("product_id"), "o_totalprice"),
        "product_id",
    )
    p = p.withColumn("product_id", F.col("build_id")).withColumn(
        "region", F.element_at("config_regions", 1)
    )
    keys = ["product_id", "config_build", "config_cdn", "config_product"]

    def grouped(df, seen):
        regions = F.sort_array(F.collect_set("region")).alias("config_regions")
        return df.groupBy(*keys).agg(regions, seen.alias("first_seen"))

    held = grouped(p.where(F.col("o_totalprice") > 150000), F.min("first_seen"))
    seen = grouped(p.where(F.col("o_totalprice") < 200000), F.lit("2025-01-01"))
    out = merge.merge_sources(held, seen)
    return out.withColumn("config_regions", F.array_join("config_regions", " "))


@check(
    "merge_scan_queue",
    sql("""
SELECT product_id, 'pending' AS state FROM products
WHERE product_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""),
)
def merge_scan_queue(spark, sf):
    held = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    held = held.select(F.col("o_orderkey").alias("product_id"))
    return merge.queue_scans(held, products(spark, sf))


@check(
    "merge_maps",
    sql("""
, f AS (SELECT user_id AS map_id, event_id AS build_id, props AS json, 'dir_' || event_type AS directory,
               event_type AS name FROM events),
changes AS (
  SELECT map_id, build_id, name FROM (
    SELECT *, lag(name) OVER (PARTITION BY map_id ORDER BY build_id) AS before FROM f)
  WHERE before IS NULL OR before <> name
),
histories AS (SELECT map_id, count(*) AS names, min(build_id) AS named_since FROM changes GROUP BY 1)
SELECT f.map_id, arg_max(json, build_id) AS json, arg_max(directory, build_id) AS directory,
       arg_max(f.name, build_id) AS name, min(build_id) AS first_seen, max(build_id) AS last_seen,
       any_value(h.names) AS names, any_value(h.named_since) AS named_since
FROM f JOIN histories h ON h.map_id = f.map_id GROUP BY 1"""),
)
def merge_maps(spark, sf):
    maps, changes = merge.merge_maps(map_facts(spark, sf))
    histories = changes.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("names"), F.min("build_id").alias("named_since")
    )
    return maps.join(histories, "map_id")


def map_facts(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("map_id"),
        F.col("event_id").alias("build_id"),
        F.col("props").alias("json"),
        F.concat(F.lit("dir_"), "event_type").alias("directory"),
        F.col("event_type").alias("name"),
    )


@check(
    "merge_tile_sizes",
    sql("""
, incoming AS (SELECT DISTINCT hash, 512 AS tile_size FROM tiles WHERE b >= 14 AND hash IS NOT NULL),
held AS (SELECT * FROM tile_sizes WHERE hash IN (SELECT hash FROM tiles WHERE b < 20))
SELECT coalesce(h.hash, i.hash) AS hash, coalesce(i.tile_size, h.tile_size) AS tile_size,
       i.hash IS NOT NULL AND i.tile_size IS DISTINCT FROM h.tile_size AS changed
FROM held h FULL JOIN incoming i ON i.hash = h.hash"""),
)
def merge_tile_sizes(spark, sf):
    t = tiles(spark, sf).where(F.col("hash").isNotNull())
    incoming = t.where(F.col("b") >= 14).select("hash").distinct().withColumn("tile_size", F.lit(512))
    held = tile_sizes(spark, sf).join(t.where(F.col("b") < 20).select("hash"), "hash", "left_semi")
    return merge.merge_tile_sizes(held, incoming)


@check(
    "merge_build_maps",
    sql("""
, held AS (SELECT build_id, map_id, count(*) AS n FROM cells WHERE b < 20 GROUP BY 1, 2),
incoming AS (SELECT build_id, map_id, count(*) FILTER (root_adt <> 0) AS n FROM cells WHERE b >= 14 GROUP BY 1, 2)
SELECT coalesce(i.build_id, h.build_id) AS build_id, coalesce(i.map_id, h.map_id) AS map_id,
       coalesce(i.n, h.n, 0) AS wdt_tile_count
FROM held h FULL JOIN incoming i ON i.build_id = h.build_id AND i.map_id = h.map_id"""),
)
def merge_build_maps(spark, sf):
    c = cells(spark, sf)
    held = c.where(F.col("b") < 20).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("wdt_tile_count"))
    incoming = c.where(F.col("b") >= 14).groupBy(*KEYS).agg(
        F.count_if(F.col("root_adt") != 0).alias("wdt_tile_count")
    )
    return merge.latest_wins(held, incoming, KEYS)


@check(
    "merge_compositions",
    sql("""
, held AS (SELECT DISTINCT composition_hash AS hash, 0 AS tiles, x0, y0, x1, y1 FROM compositions WHERE b < 20),
incoming AS (SELECT DISTINCT composition_hash AS hash, tiles, x0, y0, x1, y1 FROM compositions WHERE b >= 14)
SELECT coalesce(i.hash, h.hash) AS hash, coalesce(i.tiles, h.tiles) AS tiles, coalesce(i.x0, h.x0) AS x0,
       coalesce(i.y0, h.y0) AS y0, coalesce(i.x1, h.x1) AS x1, coalesce(i.y1, h.y1) AS y1
FROM held h FULL JOIN incoming i ON i.hash = h.hash"""),
)
def merge_compositions(spark, sf):
    from atlasledger.checks.derive import LAYER_KEYS, layer_tiles

    rows = compose.compositions(layer_tiles(spark, sf), LAYER_KEYS).select(
        "b", F.col("composition_hash").alias("hash"), "tiles", "x0", "y0", "x1", "y1"
    )
    held = rows.where(F.col("b") < 20).drop("b").distinct().withColumn("tiles", F.lit(0))
    return merge.latest_wins(held, rows.where(F.col("b") >= 14), ["hash"], "b")


LAYER_ROW = ["build_id", "map_id", "layer_type"]


@check(
    "merge_layers",
    sql("""
, held AS (SELECT * FROM layers WHERE b < 20),
composed AS (SELECT build_id, map_id, layer_type, md5(composition_hash) AS composition_hash,
                    CASE WHEN b > 20 THEN cdn_missing END AS cdn_missing FROM layers WHERE b >= 14),
blobs AS (SELECT DISTINCT build_id, map_id, 1 AS layer_type, md5('d-' || map_id) AS data_hash FROM cells
          WHERE NOT present AND root_adt = 0
          UNION SELECT DISTINCT build_id, map_id, 4, md5('e-' || map_id) FROM cells)
SELECT build_id, map_id, layer_type,
       CASE WHEN d.data_hash IS NOT NULL THEN NULL ELSE coalesce(c.composition_hash, h.composition_hash) END
         AS composition_hash,
       d.data_hash,
       array_to_string(CASE WHEN c.composition_hash IS NOT NULL THEN c.cdn_missing ELSE h.cdn_missing END, ' ')
         AS cdn_missing
FROM held h FULL JOIN composed c USING (build_id, map_id, layer_type)
FULL JOIN blobs d USING (build_id, map_id, layer_type)"""),
)
def merge_layers(spark, sf):
    rows = layers(spark, sf)
    held = rows.where(F.col("b") < 20).withColumn("data_hash", F.lit(None).cast("string"))
    composed = (
        rows.where(F.col("b") >= 14)
        .withColumn("composition_hash", F.md5(F.col("composition_hash").cast("binary")))
        .withColumn("cdn_missing", F.when(F.col("b") > 20, F.col("cdn_missing")))
    )
    c = cells(spark, sf)

    def blob(df, layer, prefix):
        return df.select(
            *KEYS, F.lit(layer).alias("layer_type"),
            F.md5(F.concat(F.lit(prefix), "map_id").cast("binary")).alias("data_hash"),
        ).distinct()

    gone = c.where(~F.col("present") & (F.col("root_adt") == 0))
    data = blob(gone, 1, "d-").unionByName(blob(c, 4, "e-"))
    out = merge.merge_layers(held, composed, data)
    return out.withColumn("cdn_missing", F.array_join("cdn_missing", " "))


@check(
    "merge_blobs",
    sql("""
SELECT md5(text) AS hash, min(text) AS data FROM documents
WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY 1"""),
)
def merge_blobs(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.md5(F.col("text").cast("binary")).alias("hash"), F.col("text").alias("data"), "lang"
    )
    held = docs.where(F.col("lang") == "en").select("hash").distinct()
    return merge.new_rows(held, docs.select("hash", "data"), ["hash"])


@check(
    "merge_layer_masks",
    sql("""
, held AS (SELECT DISTINCT p_partkey // 256 AS map_id, 16 AS layer_mask FROM part),
seen AS (SELECT map_id, bit_or(1 << layer_type) AS m FROM layers GROUP BY 1)
SELECT h.map_id, h.layer_mask | coalesce(m, 0) AS layer_mask FROM held h LEFT JOIN seen s ON s.map_id = h.map_id"""),
)
def merge_layer_masks(spark, sf):
    held = (
        table(spark, sf, "part")
        .select(F.floor(F.col("p_partkey") / 256).cast("int").alias("map_id"))
        .distinct()
        .withColumn("layer_mask", F.lit(16))
    )
    return merge.merge_masks(held, layers(spark, sf))


def scan_rows(spark, sf):
    none = F.lit(None).cast("string")
    return scans(spark, sf).select(
        "product_id", "state", "last_scanned", F.lit(0).alias("scan_ms"), none.alias("exception"),
        none.alias("encrypted_key"), none.alias("encrypted_maps"), F.lit(1).alias("data_version"),
        "data_version_attempt", F.lit("old").alias("data_version_error"),
    )


@check(
    "merge_scan_results",
    sql("""
, results AS (
  SELECT o_orderkey AS product_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'encrypted_build' WHEN '2-HIGH' THEN 'encrypted_map_database'
           WHEN '3-MEDIUM' THEN 'partial_decrypt' ELSE 'full_decrypt' END AS new_state,
         o_custkey AS took, 'key-' || o_custkey AS key FROM orders WHERE o_totalprice > 100000
)
SELECT s.product_id, coalesce(r.new_state, s.state) AS state,
       CASE WHEN r.new_state IS NULL THEN s.last_scanned ELSE '2025-01-01' END AS last_scanned,
       CASE WHEN r.new_state IS NULL THEN 0 ELSE r.took END AS scan_ms,
       CASE WHEN r.new_state IN ('encrypted_build', 'encrypted_map_database') THEN r.key END AS encrypted_key,
       CASE WHEN r.new_state = 'partial_decrypt' THEN r.key || ':1,2' END AS encrypted_maps,
       CASE WHEN r.new_state IS NULL THEN 1 ELSE 7 END AS data_version,
       CASE WHEN r.new_state IS NULL THEN s.data_version_attempt ELSE 7 END AS data_version_attempt,
       CASE WHEN r.new_state IS NULL THEN 'old' END AS data_version_error
FROM scans s LEFT JOIN results r ON r.product_id = s.product_id"""),
)
def merge_scan_results(spark, sf):
    priority = F.col("o_orderpriority")
    key = F.concat(F.lit("key-"), "o_custkey")
    results = table(spark, sf, "orders").where(F.col("o_totalprice") > 100000).select(
        F.col("o_orderkey").alias("product_id"),
        F.when(priority == "1-URGENT", "encrypted_build")
        .when(priority == "2-HIGH", "encrypted_map_database")
        .when(priority == "3-MEDIUM", "partial_decrypt")
        .otherwise("full_decrypt")
        .alias("new_state"),
        F.lit("2025-01-01").alias("finished"),
        F.col("o_custkey").alias("took_ms"),
        key.alias("key"),
        F.concat(key, F.lit(":1,2")).alias("key_maps"),
    )
    return merge.record_results(scan_rows(spark, sf), results, 7)


@check(
    "merge_scan_failures",
    sql("""
, failures AS (SELECT o_orderkey AS product_id, 'failed ' || o_custkey AS error FROM orders
               WHERE o_totalprice < 200000)
SELECT s.product_id, CASE WHEN f.error IS NOT NULL AND state = 'pending' THEN 'exception' ELSE state END AS state,
       CASE WHEN f.error IS NOT NULL THEN '2025-01-01' ELSE last_scanned END AS last_scanned,
       CASE WHEN f.error IS NOT NULL AND state = 'pending' THEN f.error END AS exception,
       CASE WHEN f.error IS NOT NULL AND state <> 'pending' THEN 7 ELSE data_version_attempt END
         AS data_version_attempt,
       CASE WHEN f.error IS NOT NULL AND state <> 'pending' THEN f.error ELSE 'old' END AS data_version_error
FROM scans s LEFT JOIN failures f ON f.product_id = s.product_id"""),
)
def merge_scan_failures(spark, sf):
    failures = table(spark, sf, "orders").where(F.col("o_totalprice") < 200000).select(
        F.col("o_orderkey").alias("product_id"),
        F.concat(F.lit("failed "), "o_custkey").alias("error"),
        F.lit("2025-01-01").alias("finished"),
    )
    return merge.record_failures(scan_rows(spark, sf), failures, 7)


def arrived(spark, sf):
    """Tiles that have turned up: what the older half of the builds lists."""
    t = tiles(spark, sf)
    return t.where((F.col("b") < 14) & F.col("cdn_missing")).select("hash").distinct()


SWEEP_SQL = """
, arrived AS (SELECT DISTINCT hash FROM tiles WHERE b < 14 AND cdn_missing),
rest AS (
  SELECT n.build_id, n.map_id, n.layer_type,
         string_agg(n.hash, ' ' ORDER BY n.hash) FILTER (a.hash IS NULL) AS rest,
         bool_or(a.hash IS NOT NULL) AS swept
  FROM (SELECT build_id, map_id, layer_type, unnest(cdn_missing) AS hash FROM layers) n
  LEFT JOIN arrived a ON a.hash = n.hash GROUP BY 1, 2, 3
),
swept_rows AS (
  SELECT l.build_id, l.map_id, l.layer_type, l.composition_hash, r.rest AS cdn_missing,
         coalesce(r.swept, false) AS swept
  FROM layers l LEFT JOIN rest r USING (build_id, map_id, layer_type)
)
"""


@check(
    "late_tile_sweep",
    sql(SWEEP_SQL + """
SELECT build_id, map_id, layer_type, composition_hash, cdn_missing, swept FROM swept_rows"""),
)
def late_tile_sweep(spark, sf):
    out = merge.sweep(layers(spark, sf).drop("b"), arrived(spark, sf))
    return out.withColumn("cdn_missing", F.array_join("cdn_missing", " "))


@check(
    "sweep_requeue",
    sql(SWEEP_SQL + """
, hit AS (SELECT DISTINCT build_id FROM swept_rows
          WHERE swept AND build_id <> (SELECT max(build_id) FROM builds)),
marked AS (
  SELECT s.*, s.product_id IN (SELECT product_id FROM products WHERE build_id IN (SELECT build_id FROM hit))
    AS requeued FROM scans s
)
SELECT product_id, CASE WHEN requeued THEN 'pending' ELSE state END AS state, requeued FROM marked"""),
)
def sweep_requeue(spark, sf):
    swept = merge.sweep(layers(spark, sf).drop("b"), arrived(spark, sf))
    current = builds(spark, sf).agg(F.max("build_id").alias("build_id"))
    hit = swept.where("swept").select("build_id").distinct()
    hit = hit.join(current, "build_id", "left_anti")
    waiting = scans(spark, sf).select("product_id", "state")
    return merge.requeue_builds(waiting, products(spark, sf), hit)


@check(
    "bulk_requeue",
    sql("""
SELECT product_id, CASE WHEN state IN ('encrypted_build', 'encrypted_map_database') THEN state
                        ELSE 'pending' END AS state FROM scans"""),
)
def bulk_requeue(spark, sf):
    return merge.requeue_all(scans(spark, sf).select("product_id", "state"))


@check(
    "layers_from_build_maps",
    sql("""
SELECT build_id, map_id, 0 AS layer_type, composition_hash FROM layers l
WHERE layer_type = 1 AND NOT EXISTS (
  SELECT 1 FROM layers h WHERE h.build_id = l.build_id AND h.map_id = l.map_id AND h.layer_type = 0 AND h.b < 14)"""),
)
def layers_from_build_maps(spark, sf):
    rows = layers(spark, sf)
    held = rows.where((F.col("layer_type") == 0) & (F.col("b") < 14))
    old = rows.where(F.col("layer_type") == 1).select(*KEYS, "composition_hash")
    return merge.layers_from_build_maps(held, old)
