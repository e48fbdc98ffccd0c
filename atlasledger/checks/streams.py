"""Streams run to completion with ``availableNow`` and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import builds, cells, layers, products, scans, sql, table, tiles
from atlasledger.checks.filters import SUMMARY_SQL, summary
from atlasledger.checks.ingest import feed_pages, scratch
from atlasledger.checks.served import CONTENT_SQL, MAP_ROWS_SQL, SCAN_SQL, map_rows, scan_facts
from atlasledger.operators import discovery, packing
from atlasledger.plans import serve
from atlasledger.streaming import discovery as discovery_stream
from atlasledger.session import checkpointed
from atlasledger.streaming import event_log, map_history
from atlasledger.streaming import scans as scan_stream
from atlasledger.streaming.catalogue import Catalogue

# Fixed values of the checks: followed products.
INCLUDE = ["*"]
EXCLUDE = ["furniture"]


def landed(spark, sf) -> str:
    """Version pages as text files, one page per file, filed by product."""
    root = scratch(spark, "landed")
    pages = feed_pages(spark, sf).select("product", F.col("document").alias("value"))
    writer = pages.write.partitionBy("product").option("maxRecordsPerFile", 1)
    writer.text(root)
    return root


def run_discovery(spark, sf) -> Catalogue:
    store = Catalogue(spark, scratch(spark, "catalogue"))
    pages = discovery_stream.landed_pages(spark, landed(spark, sf), files_per_tick=64)
    query = (
        discovery_stream.discovery_stream(pages, store, INCLUDE, EXCLUDE, seen="2025-01-01")
        .option("checkpointLocation", scratch(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store


@check(
    "discovery_stream",
    sql("""
, f AS (SELECT * FROM feed_versions WHERE product <> 'furniture'),
p AS (SELECT build_id, product, string_agg(DISTINCT region, ' ' ORDER BY region) AS regions,
             count(DISTINCT (build_config, cdn_config, product_config)) AS sources FROM f GROUP BY 1, 2)
SELECT p.build_id, v.version, p.product, p.regions, p.sources, 'pending' AS state
FROM p JOIN (SELECT DISTINCT build_id, version FROM f) v ON v.build_id = p.build_id"""),
)
def discovery_stream_query(spark, sf):
    store = run_discovery(spark, sf)
    sources = store.read("product_sources").groupBy("build_id", "product").agg(F.count(F.lit(1)).alias("sources"))
    return (
        store.read("products")
        .join(store.read("builds"), "build_id")
        .join(sources, ["build_id", "product"])
        .join(store.read("product_scans").select("product_id", "state"), "product_id")
        .select(
            "build_id", "version", "product",
            F.array_join(F.sort_array("config_regions"), " ").alias("regions"), "sources", "state",
        )
    )


@check(
    "first_seen_events",
    sql("""
SELECT DISTINCT 'build' AS kind, version AS subject FROM feed_versions
UNION ALL SELECT DISTINCT 'product', product || ' ' || version FROM feed_versions
UNION ALL SELECT DISTINCT 'region', product || ' ' || version || ' ' || region FROM feed_versions
UNION ALL SELECT DISTINCT 'scan', product || ' ' || version FROM feed_versions"""),
)
def first_seen_events(spark, sf):
    from atlasledger.sources.feeds import parse_feed

    pages = discovery_stream.landed_pages(spark, landed(spark, sf), files_per_tick=64)
    events = discovery_stream.first_seen_events(parse_feed(pages, "versions"))
    out = scratch(spark, "events")
    query = (
        events.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("kind string, subject string").parquet(out)


@check(
    "sequence_check",
    sql(SUMMARY_SQL + """
, pages AS (
  SELECT lower(c_mktsegment) || '-' || c_custkey AS product, count(DISTINCT o_orderdate) AS page_seqn
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1
)
SELECT name, product_seqn, flags, page_seqn FROM summary JOIN pages ON product = name
WHERE product_seqn <> page_seqn"""),
)
def sequence_check(spark, sf):
    """Products whose page counts order days, where the summary counts orders."""
    pages = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.concat_ws("-", F.lower("c_mktsegment"), "c_custkey").alias("product"))
        .agg(F.count_distinct("o_orderdate").alias("seqn"))
    )
    off = discovery.sequence_mismatches(summary(spark, sf), pages)
    return off.select("name", "product_seqn", "flags", "page_seqn")


@check(
    "scan_stream",
    sql(SCAN_SQL + """
, queued AS (SELECT DISTINCT build_id FROM products p JOIN scans s ON s.product_id = p.product_id
             WHERE state = 'pending' OR (state IN ('full_decrypt', 'partial_decrypt') AND data_version_attempt < 2))
SELECT build_id, map_id, layer_type, composition_hash, NULL AS data_hash, cdn_missing FROM composed
WHERE build_id IN (SELECT build_id FROM queued)
UNION ALL SELECT build_id, map_id, 3, NULL, data_hash, NULL FROM impass_docs WHERE build_id IN (SELECT build_id FROM queued)
UNION ALL SELECT build_id, map_id, 4, NULL, data_hash, NULL FROM area_docs WHERE build_id IN (SELECT build_id FROM queued)"""),
)
def scan_stream_query(spark, sf):
    """The whole queue worked down by scan ticks that a commit sets off."""
    store = scanned(spark, sf, scan_facts(spark, sf))
    return store.read("build_map_layers").withColumn("cdn_missing", F.array_join("cdn_missing", " "))


def scanned(spark, sf, facts) -> Catalogue:
    """A catalogue whose queue has been worked down."""
    store = Catalogue(spark, scratch(spark, "catalogue"))
    known = products(spark, sf).select("product_id", "build_id", "product", "first_seen")
    queue = scans(spark, sf).join(known.select("product_id", "build_id"), "product_id", "left")
    store.commit({"products": known, "product_scans": queue}, "setup", 0)
    return worked_down(spark, store, facts)


def worked_down(spark, store: Catalogue, facts) -> Catalogue:
    query = (
        scan_stream.scan_stream(
            scan_stream.commit_stream(spark, store.root), store, facts, data_version=2, builds_per_tick=1_000_000,
            finished="2025-01-01",
        )
        .option("checkpointLocation", scratch(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store


@check(
    "scan_outcome_stream",
    sql("""
, outcome AS (
  SELECT b.build_id, b.b,
         CASE WHEN b.b % 7 = 1 THEN 'tile list cannot be read' END AS error,
         CASE WHEN b.b % 7 = 2 THEN 'encrypted_build' WHEN b.b % 7 = 3 THEN 'encrypted_map_database'
              WHEN b.b % 7 = 4 AND EXISTS (SELECT 1 FROM cells c WHERE c.build_id = b.build_id AND c.map_id % 2 = 0) THEN 'partial_decrypt'
              ELSE 'full_decrypt' END AS new_state,
         CASE WHEN b.b % 7 IN (2, 3) THEN 'key-' || b.b END AS key
  FROM builds b
),
locked AS (
  SELECT build_id, '{"key":[' || string_agg(map_id, ',' ORDER BY map_id) || ']}' AS maps
  FROM (SELECT DISTINCT build_id, map_id FROM cells WHERE map_id % 2 = 0 AND b % 7 = 4) GROUP BY 1
),
queued AS (
  SELECT s.*, p.build_id, s.state <> 'pending' AS is_upgrade,
         s.state = 'pending' OR (s.state IN ('full_decrypt', 'partial_decrypt') AND s.data_version_attempt < 2) AS due
  FROM scans s JOIN products p ON p.product_id = s.product_id
)
SELECT q.product_id, q.build_id,
       CASE WHEN NOT due THEN q.state WHEN error IS NULL THEN coalesce(new_state, 'full_decrypt')
            WHEN is_upgrade THEN q.state ELSE 'exception' END AS state,
       CASE WHEN due THEN '2025-01-01' ELSE q.last_scanned END AS last_scanned,
       CASE WHEN due AND error IS NOT NULL AND NOT is_upgrade THEN error END AS exception,
       CASE WHEN due AND error IS NULL THEN o.key END AS encrypted_key,
       CASE WHEN due AND error IS NULL AND new_state = 'partial_decrypt' THEN l.maps END AS encrypted_maps,
       CASE WHEN due AND error IS NULL THEN 2 END AS data_version,
       CASE WHEN NOT due OR error IS NOT NULL AND NOT is_upgrade THEN q.data_version_attempt ELSE 2 END AS data_version_attempt,
       CASE WHEN due AND error IS NOT NULL AND is_upgrade THEN error END AS data_version_error
FROM queued q LEFT JOIN outcome o ON o.build_id = q.build_id LEFT JOIN locked l ON l.build_id = q.build_id"""),
)
def scan_outcome_stream(spark, sf):
    """Builds that fail, are locked as a whole, by their map table or by maps, each recorded as such."""
    facts = scan_facts(spark, sf)
    known = builds(spark, sf)
    b = F.col("b") % 7
    key = F.concat(F.lit("key-"), F.col("b"))
    facts.failures = known.where(b == 1).select("build_id", F.lit("tile list cannot be read").alias("error"))
    facts.locks = known.where(b.isin(2, 3)).select(
        "build_id", F.when(b == 2, key).alias("build_key"), F.when(b == 3, key).alias("table_key")
    )
    maps = cells(spark, sf).where((b == 4) & (F.col("map_id") % 2 == 0))
    facts.map_locks = maps.select("build_id", "map_id", F.lit("KEY").alias("key_name")).distinct()
    return scanned(spark, sf, facts).read("product_scans").drop("scan_ms")


@check(
    "scan_extractions",
    sql(SCAN_SQL + """
, queued AS (SELECT DISTINCT build_id FROM products p JOIN scans s ON s.product_id = p.product_id
             WHERE state = 'pending' OR (state IN ('full_decrypt', 'partial_decrypt') AND data_version_attempt < 2))
SELECT DISTINCT md5('adt-' || a.part) AS adt_hash, b.bits, g.area_ids
FROM adts a JOIN bitsets b ON b.map_id = a.map_id AND b.x = a.x AND b.y = a.y
JOIN grids g ON g.map_id = a.map_id AND g.x = a.x AND g.y = a.y
WHERE a.build_id IN (SELECT build_id FROM queued)"""),
)
def scan_extractions(spark, sf):
    """What the scan ticks have packed, a row per terrain file however many builds list it."""
    rows = scanned(spark, sf, scan_facts(spark, sf)).read("extractions")
    return rows.select("adt_hash", "bits", F.array_join("area_ids", ",").alias("area_ids"))


@check(
    "scan_stream_contents",
    sql(CONTENT_SQL + """
, queued AS (SELECT DISTINCT build_id FROM products p JOIN scans s ON s.product_id = p.product_id
             WHERE state = 'pending' OR (state IN ('full_decrypt', 'partial_decrypt') AND data_version_attempt < 2)),
named AS (
  SELECT DISTINCT composition_hash FROM composed WHERE build_id IN (SELECT build_id FROM queued)
),
spread AS (
  SELECT h.composition_hash, count(*) FILTER (hash IS NOT NULL) AS tiles, min(x) AS x0, min(y) AS y0, max(x) AS x1,
         max(y) AS y1
  FROM held h JOIN named n ON n.composition_hash = h.composition_hash GROUP BY 1
),
pyramids AS (
  SELECT composition_hash, count(*) AS cells, sum(size)::BIGINT AS sizes FROM (
    SELECT composition_hash, level, x >> level, y >> level, greatest(coalesce(max(tile_size), 0), 64) AS size
    FROM held, range(1, 7) t(level) WHERE hash IS NOT NULL GROUP BY 1, 2, 3, 4)
  GROUP BY 1
)
SELECT 'composition' AS kind, s.composition_hash AS hash, tiles, x0, y0, x1, y1, cells, sizes
FROM spread s JOIN pyramids p ON p.composition_hash = s.composition_hash
UNION ALL
SELECT DISTINCT 'blob', data_hash, length(document), NULL, NULL, NULL, NULL, NULL, NULL FROM (
  SELECT * FROM impass_docs UNION ALL SELECT * FROM area_docs)
WHERE build_id IN (SELECT build_id FROM queued)"""),
)
def scan_stream_contents(spark, sf):
    """What the scan ticks have stored by content: compositions with their pyramids, and documents."""
    store = scanned(spark, sf, scan_facts(spark, sf))
    cells = store.read("pyramid").groupBy(F.col("composition_hash").alias("hash")).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("tile_size").alias("sizes")
    )
    rows = store.read("compositions").join(cells, "hash").withColumn("kind", F.lit("composition"))
    blobs = store.read("data_blobs").select(
        F.lit("blob").alias("kind"), F.col("data_hash").alias("hash"), F.length("document").alias("tiles")
    )
    return rows.drop("document").unionByName(blobs, allowMissingColumns=True)


@check(
    "catalogue_pipeline",
    sql(SCAN_SQL + """
, followed AS (SELECT DISTINCT build_id, product FROM feed_versions WHERE product <> 'furniture'),
every AS (
  SELECT build_id, map_id, layer_type, composition_hash AS hash, cdn_missing FROM composed
  UNION ALL SELECT build_id, map_id, 3, data_hash, NULL FROM impass_docs
  UNION ALL SELECT build_id, map_id, 4, data_hash, NULL FROM area_docs
),
pivoted AS (
  SELECT build_id, map_id, max(hash) FILTER (layer_type = 0) AS l0, max(hash) FILTER (layer_type = 1) AS l1,
         max(hash) FILTER (layer_type = 2) AS l2, max(hash) FILTER (layer_type = 3) AS l3,
         max(hash) FILTER (layer_type = 4) AS l4, max(cdn_missing) FILTER (layer_type = 0) AS m0
  FROM every WHERE build_id IN (SELECT build_id FROM followed) GROUP BY 1, 2
)
SELECT map_id, p.build_id, l0, l1, l2, l3, l4, m0, f.products
FROM pivoted p JOIN (SELECT build_id, string_agg(product, ',' ORDER BY product) AS products FROM followed GROUP BY 1) f
  ON f.build_id = p.build_id"""),
)
def catalogue_pipeline(spark, sf):
    """From landed version pages over the scan queue to every version of every map, on one store."""
    store = worked_down(spark, run_discovery(spark, sf), scan_facts(spark, sf))
    out = serve.map_versions(store.read("build_map_layers"), store.read("products"))
    return out.select(
        "map_id", "build_id", "l0", "l1", "l2", "l3", "l4",
        F.array_join("m0", " ").alias("m0"), F.array_join("products", ",").alias("products"),
    )


@check(
    "map_history_merge",
    sql(MAP_ROWS_SQL + """
SELECT m.map_id, arg_max(json, build_id) AS json, arg_max(directory, build_id) AS directory,
       arg_max(name, build_id) AS name, min(build_id) AS first_seen, max(build_id) AS last_seen,
       any_value(c.names) AS names
FROM map_rows m JOIN changes c ON c.map_id = m.map_id GROUP BY 1"""),
)
def map_history_merge(spark, sf):
    """Builds come in out of order in three ticks, each makes its segments (a major version) anew."""
    store = Catalogue(spark, scratch(spark, "catalogue"))
    facts = checkpointed(map_rows(cells(spark, sf)))
    for tick in range(3):
        arrived = facts.where(F.pmod(F.xxhash64("build_id"), F.lit(3)) == tick)
        store.commit(map_history.segment_rows(store, arrived, bits=52), "maps", tick, store.begin())
    maps, changes = map_history.maps_and_names(store)
    return maps.join(changes.groupBy("map_id").agg(F.count(F.lit(1)).alias("names")), "map_id")


@check(
    "data_version_upgrades",
    sql("""
SELECT product_id, state, data_version_attempt FROM scans
WHERE state IN ('full_decrypt', 'partial_decrypt') AND data_version_attempt < 2"""),
)
def data_version_upgrades(spark, sf):
    from atlasledger.operators.scans import eligible_scans

    waiting = eligible_scans(scans(spark, sf), products(spark, sf), 2)
    return waiting.where("is_upgrade").select("product_id", "state", "data_version_attempt")


@check(
    "late_tile_stream",
    sql("""
, arrived AS (SELECT DISTINCT hash FROM tiles WHERE b < 14 AND cdn_missing),
rest AS (
  SELECT n.build_id, n.map_id, n.layer_type,
         string_agg(n.hash, ' ' ORDER BY n.hash) FILTER (a.hash IS NULL) AS cdn_missing
  FROM (SELECT build_id, map_id, layer_type, unnest(cdn_missing) AS hash FROM layers) n
  LEFT JOIN arrived a ON a.hash = n.hash GROUP BY 1, 2, 3
)
SELECT l.build_id, l.map_id, l.layer_type, l.composition_hash, r.cdn_missing
FROM layers l LEFT JOIN rest r USING (build_id, map_id, layer_type)"""),
)
def late_tile_stream(spark, sf):
    """Tiles arrive as a file stream; every arrival repairs the layers it is in."""
    arrivals = scratch(spark, "arrivals")
    t = tiles(spark, sf)
    t.where((F.col("b") < 14) & F.col("cdn_missing")).select("hash").distinct().write.parquet(arrivals)
    store = Catalogue(spark, scratch(spark, "catalogue"))
    held = checkpointed(layers(spark, sf).drop("b"))
    store.commit({"build_map_layers": held, "lacking": scan_stream.lacking(held)}, "setup", 0)
    query = (
        scan_stream.late_tile_stream(spark.readStream.schema("hash string").parquet(arrivals), store)
        .option("checkpointLocation", scratch(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = store.read("build_map_layers").drop("data_hash")
    return rows.withColumn("cdn_missing", F.array_join("cdn_missing", " "))


PACK_SQL = """
, numbered AS (
  SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
  FROM conversations
),
packed AS (
  SELECT conv_id, turn, n, i, n AS filled, 0 AS batch_no FROM numbered WHERE i = 1
  UNION ALL
  SELECT m.conv_id, m.turn, m.n, m.i,
         CASE WHEN p.filled > 0 AND p.filled + m.n + 1 > 2000 THEN m.n
              WHEN p.filled > 0 THEN p.filled + 1 + m.n ELSE m.n END,
         CASE WHEN p.filled > 0 AND p.filled + m.n + 1 > 2000 THEN p.batch_no + 1 ELSE p.batch_no END
  FROM packed p JOIN numbered m ON m.conv_id = p.conv_id AND m.i = p.i + 1
)
"""


@check(
    "event_log_batches",
    sql(PACK_SQL + """
SELECT conv_id, batch_no, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS messages,
       (sum(n) + count(*) - 1)::BIGINT AS chars FROM packed GROUP BY 1, 2"""),
)
def event_log_batches(spark, sf):
    log = table(spark, sf, "conversations")
    packed = packing.pack_messages(log, ["conv_id"], ["turn"], "text")
    return packing.batch_summaries(packed, ["conv_id"], "turn")


@check(
    "event_log_stream",
    sql(PACK_SQL + "SELECT conv_id, turn, n AS length, batch_no FROM packed"),
)
def event_log_stream(spark, sf):
    schema = table(spark, sf, "conversations").schema
    # the table may be one file or a folder of files; the pattern matches either
    log = spark.readStream.schema(schema).parquet(f"{sf}/[c]onversations.parquet")
    root = scratch(spark, "packed")
    query = (
        event_log.pack_stream(log, "conv_id", "turn", "text", root)
        .option("checkpointLocation", scratch(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return event_log.packed_log(spark, root, "conv_id", "turn", dict(log.dtypes))
