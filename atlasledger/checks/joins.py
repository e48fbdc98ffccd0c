"""Joins over the derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import (
    areas,
    builds,
    cells,
    chunks,
    file_index,
    layers,
    part_years,
    products,
    scans,
    sql,
    table,
    tile_sizes,
    tiles,
)
from atlasledger.operators import areas as area_ops
from atlasledger.operators import diff, discovery, resolve
from atlasledger.operators import chunks as chunk_ops
from atlasledger.operators import scans as scan_ops
from atlasledger.operators import viewport
from atlasledger.operators.merge import affected_layers
from atlasledger.operators.history import nearest_build
from atlasledger.sources import feeds

KEYS = ["build_id", "map_id"]
LAYER = ["build_id", "map_id", "layer_type"]


def resolved(spark, sf):
    return resolve.resolve(resolve.layer_cells(cells(spark, sf)), file_index(spark, sf))


RESOLVED_SQL = """
, listed AS (
  SELECT build_id, map_id, x, y, 0 AS layer_type, minimap_texture AS fdid FROM cells
  UNION ALL SELECT build_id, map_id, x, y, 1, map_texture FROM cells WHERE map_texture <> 0
),
resolved AS (
  SELECT l.*, f.ckey AS hash FROM listed l
  LEFT JOIN file_index f ON f.build_id = l.build_id AND f.fdid = l.fdid
)
"""


@check(
    "tile_resolve",
    sql(RESOLVED_SQL + "SELECT build_id, map_id, x, y, layer_type, fdid, hash FROM resolved"),
)
def tile_resolve(spark, sf):
    return resolved(spark, sf)


def overrides(spark, sf):
    return table(spark, sf, "nation").select(
        (F.col("n_nationkey") % 8).alias("map_id"),
        F.col("n_nationkey").alias("x"),
        F.lit(0).alias("y"),
        (F.col("n_nationkey").cast("bigint") * 2 + 1).alias("fdid"),
    )


@check(
    "static_override_tiles",
    sql("""
, build_maps AS (SELECT DISTINCT build_id, map_id FROM cells)
SELECT m.build_id, m.map_id, n_nationkey AS x, 0 AS y, 2 AS layer_type,
       n_nationkey * 2 + 1 AS fdid, f.ckey AS hash
FROM build_maps m JOIN nation ON n_nationkey % 8 = m.map_id
LEFT JOIN file_index f ON f.build_id = m.build_id AND f.fdid = n_nationkey * 2 + 1
WHERE m.build_id >= 18014398509481984"""),
)
def static_override_tiles(spark, sf):
    build_maps = cells(spark, sf).select("build_id", "map_id").distinct()
    listed = resolve.override_cells(build_maps, overrides(spark, sf))
    return resolve.resolve(listed, file_index(spark, sf))


def path_lines(spark, sf):
    """Path-list lines: parts with their first word as folder, tile name as file."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("line_no"),
        F.concat(
            F.col("p_partkey"),
            F.lit(";World/Maps/"),
            F.element_at(F.split("p_name", " "), 1),
            F.lit("/"),
            F.element_at(F.split("p_name", " "), 1),
            F.when(
                F.col("p_size") > 25,
                F.concat(F.lit("_"), F.col("p_size"), F.lit("_"), F.col("p_partkey") % 64, F.lit(".adt")),
            ).otherwise(F.lit(".wdt ")),
        ).alias("line"),
    )


PATHS_SQL = """
, paths AS (
  SELECT path, max(fdid) AS fdid FROM (
    SELECT p_partkey AS fdid, 'world/maps/' || folder || '/' || folder ||
           CASE WHEN p_size > 25 THEN '_' || p_size || '_' || (p_partkey % 64) || '.adt'
                ELSE '.wdt' END AS path
    FROM (SELECT *, lower(split_part(p_name, ' ', 1)) AS folder FROM part)) GROUP BY 1
)
"""


@check("path_list", sql(PATHS_SQL + "SELECT path, fdid FROM paths"))
def path_list(spark, sf):
    return feeds.parse_path_list(path_lines(spark, sf))


@check(
    "path_list_pages",
    sql("""
SELECT lower(trim(url)) AS path, arg_max(page_id, page_id) AS fdid FROM pages GROUP BY 1"""),
)
def path_list_pages(spark, sf):
    lines = table(spark, sf, "pages").select(
        F.col("page_id").alias("line_no"), F.concat_ws(";", "page_id", "url").alias("line")
    )
    return feeds.parse_path_list(lines)


@check(
    "file_id_fallback",
    sql(PATHS_SQL + """
, map_rows AS (
  SELECT (yr - 1990)::BIGINT << 52 AS build_id, part AS map_id, split_part(p_name, ' ', 1) AS directory,
         CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_partkey + 1 END AS own
  FROM part_years JOIN part ON p_partkey = part
)
SELECT m.build_id, m.map_id, m.directory,
       coalesce(CASE WHEN m.build_id >= 40532400941335738 THEN nullif(own, 0) END, p.fdid) AS wdt_fdid
FROM map_rows m
LEFT JOIN paths p ON p.path = 'world/maps/' || lower(directory) || '/' || lower(directory) || '.wdt'"""),
)
def file_id_fallback(spark, sf):
    shipped = part_years(spark, sf).select(
        F.shiftleft((F.col("yr") - 1990).cast("bigint"), 52).alias("build_id"),
        F.col("part").alias("p_partkey"),
    )
    rows = table(spark, sf, "part").join(shipped, "p_partkey").select(
        "build_id",
        F.col("p_partkey").alias("map_id"),
        F.element_at(F.split("p_name", " "), 1).alias("directory"),
        F.when(F.col("p_type") == "PROMO", 0).otherwise(F.col("p_partkey") + 1).alias("wdt_fdid"),
    )
    return resolve.wdt_file_ids(rows, feeds.parse_path_list(path_lines(spark, sf)))


@check(
    "grid_rectangle_paths",
    sql(PATHS_SQL + """
, rects AS (
  SELECT DISTINCT split_part(p_name, ' ', 1) AS directory, 20 AS x0, 0 AS y0, 40 AS x1, 63 AS y1
  FROM part
)
SELECT r.directory, tx.x, ty.y, p.fdid,
       'world/maps/' || lower(directory) || '/' || lower(directory) || '_' || tx.x || '_' || ty.y
         || '.adt' AS path
FROM rects r, range(20, 41) tx(x), range(0, 64) ty(y)
LEFT JOIN paths p ON p.path = 'world/maps/' || lower(directory) || '/' || lower(directory) || '_'
                              || tx.x || '_' || ty.y || '.adt'"""),
)
def grid_rectangle_paths(spark, sf):
    rects = (
        table(spark, sf, "part")
        .select(F.element_at(F.split("p_name", " "), 1).alias("directory"))
        .distinct()
        .select("directory", *[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (20, 0, 40, 63))])
    )
    return resolve.rectangle_files(rects, feeds.parse_path_list(path_lines(spark, sf)))


@check(
    "tile_existence_split",
    sql(RESOLVED_SQL + """
, store AS (SELECT hash, tile_size FROM tile_sizes WHERE tile_size = 256)
SELECT hash, tile_size, 'known' AS outcome FROM store
WHERE hash IN (SELECT hash FROM resolved)
UNION ALL
SELECT DISTINCT hash, NULL, 'work' FROM resolved
WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM store)"""),
)
def tile_existence_split(spark, sf):
    store = tile_sizes(spark, sf).where(F.col("tile_size") == 256)
    hashes = resolve.distinct_hashes(resolved(spark, sf))
    have = resolve.known(hashes, store).withColumn("outcome", F.lit("known"))
    work = resolve.unknown(hashes, store).select(
        "hash", F.lit(None).cast("int").alias("tile_size"), F.lit("work").alias("outcome")
    )
    return have.unionByName(work)


@check(
    "extraction_work_list",
    sql("""
SELECT DISTINCT md5('adt-' || part) AS adt_hash FROM chunks
WHERE md5('adt-' || part) NOT IN (SELECT md5('adt-' || part) FROM chunks WHERE impass)"""),
)
def extraction_work_list(spark, sf):
    adt = F.md5(F.concat(F.lit("adt-"), F.col("part")).cast("binary")).alias("hash")
    c = chunks(spark, sf)
    done = c.where("impass").select(adt).distinct()
    work = resolve.unknown(c.select(adt).distinct(), done)
    return work.withColumnRenamed("hash", "adt_hash")


def extractions(spark, sf):
    """(adt, layer, blob) rows: layer 3 the tile's flags, layer 4 its areas."""
    keys = ["part"]
    c = chunks(spark, sf)
    bits = chunk_ops.impass_bitsets(c, keys).select(
        "part", F.lit(3).alias("layer_type"), F.col("bits").alias("data")
    )
    grids = chunk_ops.area_grids(c, keys).select(
        "part", F.lit(4).alias("layer_type"), F.array_join("area_ids", ",").alias("data")
    )
    return bits.unionByName(grids).select(
        F.md5(F.concat(F.lit("adt-"), F.col("part")).cast("binary")).alias("adt_hash"),
        "layer_type",
        F.md5(F.col("data").cast("binary")).alias("data_hash"),
        "data",
    )


EXTRACTIONS_SQL = """
, grid AS (
  SELECT p.part, t.idx, coalesce(c.area_id, 0) AS area_id, coalesce(c.impass, false) AS impass
  FROM (SELECT DISTINCT part FROM chunks) p CROSS JOIN range(256) t(idx)
  LEFT JOIN chunks c ON c.part = p.part AND c.idx = t.idx
),
bits AS (
  SELECT part, string_agg(printf('%02x', v), '' ORDER BY byte) AS bits FROM (
    SELECT part, idx // 8 AS byte, sum(CASE WHEN impass THEN 1 << (idx % 8)::INT ELSE 0 END)::BIGINT AS v
    FROM grid GROUP BY 1, 2) GROUP BY 1
),
ids AS (SELECT part, string_agg(area_id, ',' ORDER BY idx) AS ids FROM grid GROUP BY 1),
extractions AS (
  SELECT md5('adt-' || part) AS adt_hash, 3 AS layer_type, md5(bits) AS data_hash, bits AS data FROM bits
  UNION ALL SELECT md5('adt-' || part), 4, md5(ids), ids FROM ids
)
"""


@check(
    "extractions_with_blobs",
    sql(EXTRACTIONS_SQL + """
, blobs AS (SELECT data_hash, min(data) AS data FROM extractions GROUP BY 1)
SELECT e.adt_hash, e.data_hash, CASE WHEN e.layer_type = 3 THEN b.data END AS impass,
       CASE WHEN e.layer_type = 4 THEN b.data END AS areas
FROM extractions e JOIN blobs b ON b.data_hash = e.data_hash"""),
)
def extractions_with_blobs(spark, sf):
    rows = extractions(spark, sf)
    blobs = rows.groupBy("data_hash").agg(F.min("data").alias("blob"))
    return rows.join(blobs, "data_hash").select(
        "adt_hash",
        "data_hash",
        F.when(F.col("layer_type") == 3, F.col("blob")).alias("impass"),
        F.when(F.col("layer_type") == 4, F.col("blob")).alias("areas"),
    )


DATA_LAYER_SQL = """
, data_layers AS (
  SELECT DISTINCT build_id, map_id, 3 AS layer_type FROM cells WHERE NOT present AND root_adt = 0
  UNION ALL
  SELECT DISTINCT build_id, map_id, 4 FROM cells WHERE NOT present AND map_texture <> 0
)
"""


@check(
    "maps_lacking_data_layers",
    sql(DATA_LAYER_SQL + """
SELECT m.build_id, m.map_id, count(d.layer_type) AS held
FROM (SELECT DISTINCT build_id, map_id FROM cells) m
LEFT JOIN data_layers d ON d.build_id = m.build_id AND d.map_id = m.map_id
GROUP BY 1, 2 HAVING count(d.layer_type) < 2"""),
)
def maps_lacking_data_layers(spark, sf):
    c = cells(spark, sf)
    gone = c.where(~F.col("present"))
    three = gone.where(F.col("root_adt") == 0).select("build_id", "map_id", F.lit(3).alias("layer_type"))
    four = gone.where(F.col("map_texture") != 0).select(
        "build_id", "map_id", F.lit(4).alias("layer_type")
    )
    held = three.unionByName(four).distinct().withColumn("data_hash", F.lit("x"))
    return resolve.maps_lacking_data(c.select("build_id", "map_id").distinct(), held)


def sources(spark, sf):
    return products(spark, sf).select(
        "product_id",
        F.col("product_id").alias("source_id"),
        "config_build",
        "config_cdn",
        "config_product",
        F.element_at("config_regions", 1).alias("region"),
        "first_seen",
    )


@check(
    "sources_newest_first",
    sql("""
SELECT product_id, product_id AS source_id, config_build, config_cdn, config_product, region,
       first_seen, product FROM products ORDER BY product_id, first_seen DESC"""),
)
def sources_newest_first(spark, sf):
    return scan_ops.sources_newest_first(sources(spark, sf), products(spark, sf))


@check(
    "scans_with_products",
    sql("""
SELECT s.product_id, s.state, p.build_id, p.product FROM scans s
LEFT JOIN (SELECT * FROM products WHERE region <> 'ASIA') p ON p.product_id = s.product_id"""),
)
def scans_with_products(spark, sf):
    p = products(spark, sf).where(F.element_at("config_regions", 1) != "ASIA")
    joined = scan_ops.scans_with_products(
        scans(spark, sf), p.select("product_id", "build_id", "product")
    )
    return joined.select("product_id", "state", "build_id", "product")


@check(
    "builds_with_products",
    sql("""
, listed AS (
  SELECT build_id, string_agg(product, ',' ORDER BY first_seen, product) AS products
  FROM (SELECT build_id, product, min(first_seen) AS first_seen FROM products GROUP BY 1, 2)
  GROUP BY 1
)
SELECT b.build_id, b.version, coalesce(l.products, '') AS products
FROM builds b LEFT JOIN listed l ON l.build_id = b.build_id"""),
)
def builds_with_products(spark, sf):
    from atlasledger.plans.serve import products_per_build

    listed = products_per_build(products(spark, sf))
    none = F.array().cast("array<string>")
    return (
        builds(spark, sf)
        .join(listed, "build_id", "left")
        .select("build_id", "version", F.array_join(F.coalesce("products", none), ",").alias("products"))
    )


@check(
    "composition_diff",
    sql("""
, old AS (SELECT * FROM tiles WHERE hash IS NOT NULL),
new AS (SELECT t.*, p.build_id AS before FROM tiles t
        JOIN builds n ON n.build_id = t.build_id JOIN builds p ON p.b = n.b - 1
        WHERE hash IS NOT NULL)
SELECT coalesce(o.map_id, n.map_id) AS map_id, coalesce(o.build_id, n.before) AS build_id,
       coalesce(o.x, n.x) AS x, coalesce(o.y, n.y) AS y, o.hash AS old_hash, n.hash AS new_hash,
       CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed'
            ELSE 'modified' END AS change
FROM (SELECT * FROM old WHERE build_id <> (SELECT max(build_id) FROM builds)) o
FULL JOIN new n ON n.before = o.build_id AND n.map_id = o.map_id AND n.x = o.x AND n.y = o.y
WHERE o.hash IS DISTINCT FROM n.hash"""),
)
def composition_diff(spark, sf):
    """Every build against the next one."""
    t = tiles(spark, sf)
    order = builds(spark, sf).select("b", "build_id")
    before = order.select((F.col("b") + 1).alias("b"), F.col("build_id").alias("before"))
    followed = order.select((F.col("b") - 1).alias("b"))
    old = t.join(followed, "b", "left_semi")
    new = t.join(before, "b").drop("build_id").withColumnRenamed("before", "build_id")
    return diff.composition_diff(old, new, KEYS)


REQUESTS_SQL = """
, versions AS (SELECT DISTINCT map_id, build_id FROM name_facts),
requests AS (SELECT user_id AS map_id, event_id + user_id AS requested FROM events)
"""


@check(
    "nearest_version",
    sql(REQUESTS_SQL + """
, low AS (
  SELECT r.map_id, r.requested, v.build_id AS older FROM (SELECT DISTINCT * FROM requests) r
  ASOF LEFT JOIN versions v ON v.map_id = r.map_id AND v.build_id <= r.requested
),
both_ AS (
  SELECT l.*, v.build_id AS newer FROM low l
  ASOF LEFT JOIN versions v ON v.map_id = l.map_id AND v.build_id >= l.requested
)
SELECT r.map_id, r.requested,
       CASE WHEN older IS NOT NULL AND (newer IS NULL OR r.requested - older <= newer - r.requested)
            THEN older ELSE newer END AS build_id,
       CASE WHEN older IS NOT NULL AND (newer IS NULL OR r.requested - older <= newer - r.requested)
            THEN older ELSE newer END <> r.requested AS is_fallback
FROM requests r JOIN both_ b ON b.map_id = r.map_id AND b.requested = r.requested"""),
)
def nearest_version(spark, sf):
    events = table(spark, sf, "events")
    versions = events.select(
        F.col("user_id").alias("map_id"), F.col("event_id").alias("build_id")
    ).distinct()
    requests = events.select(
        F.col("user_id").alias("map_id"),
        (F.col("event_id") + F.col("user_id")).alias("requested"),
    )
    return nearest_build(requests, versions)


@check(
    "cdn_missing_coords",
    sql("""
SELECT build_id, map_id, x, y, hash FROM tiles
WHERE hash IN (SELECT hash FROM tiles WHERE cdn_missing)"""),
)
def cdn_missing_coords(spark, sf):
    t = tiles(spark, sf)
    lost = layers(spark, sf).where(F.col("layer_type") == 0).select(
        *KEYS, F.explode("cdn_missing").alias("hash")
    )
    return viewport.cdn_missing_coords(t, lost, KEYS).select(*KEYS, "x", "y", "hash")


@check(
    "impassable_borders",
    sql("""
, flagged AS (
  SELECT map_id, x * 16 + idx % 16 AS gx, y * 16 + idx // 16 AS gy FROM chunks WHERE impass
)
SELECT c.map_id, c.gx, c.gy,
       1 + CASE WHEN r.gx IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN d.gx IS NOT NULL THEN 4 ELSE 0 END
       + CASE WHEN l.gx IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN u.gx IS NOT NULL THEN 16 ELSE 0 END
       AS bits
FROM flagged c
LEFT JOIN flagged r ON r.map_id = c.map_id AND r.gx = c.gx + 1 AND r.gy = c.gy
LEFT JOIN flagged d ON d.map_id = c.map_id AND d.gx = c.gx AND d.gy = c.gy + 1
LEFT JOIN flagged l ON l.map_id = c.map_id AND l.gx = c.gx - 1 AND l.gy = c.gy
LEFT JOIN flagged u ON u.map_id = c.map_id AND u.gx = c.gx AND u.gy = c.gy - 1"""),
)
def impassable_borders(spark, sf):
    return chunk_ops.impass_borders(chunks(spark, sf), ["map_id"])


@check(
    "area_with_parent",
    sql("""
SELECT a.area_id, p.area_id AS parent_id, p.area_id IS NULL AS is_root
FROM areas a LEFT JOIN areas p ON p.area_id = a.parent_id"""),
)
def area_with_parent(spark, sf):
    out = area_ops.with_parent(areas(spark, sf), [])
    return out.select("area_id", "parent_id", F.col("parent_id").isNull().alias("is_root"))


@check(
    "continent_names",
    sql("""
SELECT a.area_id, a.continent_id, coalesce(r_name, 'Map ' || a.continent_id) AS continent
FROM areas a LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON r_regionkey = a.continent_id"""),
)
def continent_names(spark, sf):
    maps = table(spark, sf, "region").where(F.col("r_name") != "ASIA").select(
        F.col("r_regionkey").alias("map_id"), F.col("r_name").alias("name")
    )
    zones = areas(spark, sf).select("area_id", "continent_id")
    return area_ops.continent_names(zones, maps)


@check(
    "late_tile_layers",
    sql("""
SELECT DISTINCT build_id, map_id, layer_type
FROM (SELECT build_id, map_id, layer_type, unnest(cdn_missing) AS hash FROM layers)
WHERE hash IN (SELECT hash FROM tile_sizes WHERE tile_size = 256)"""),
)
def late_tile_layers(spark, sf):
    arrived = tile_sizes(spark, sf).where(F.col("tile_size") == 256)
    return affected_layers(layers(spark, sf), arrived)


def contents(spark, sf):
    return table(spark, sf, "documents").select(
        F.md5(F.col("text").cast("binary")).alias("hash"), "text", "lang", "source", "doc_id"
    )


@check(
    "store_reconcile",
    sql("""
, store AS (SELECT md5(text) AS hash, bool_or(lang = 'en') AS local, bool_or(n_chars > 2000) AS remote
            FROM documents GROUP BY 1)
SELECT hash, CASE WHEN NOT local THEN 'missing' WHEN remote THEN 'skipped' ELSE 'upload' END AS status
FROM store"""),
)
def store_reconcile(spark, sf):
    c = contents(spark, sf)
    local = c.where(F.col("lang") == "en").select("hash").distinct()
    remote = (
        table(spark, sf, "documents")
        .where(F.col("n_chars") > 2000)
        .select(F.md5(F.col("text").cast("binary")).alias("hash"))
        .distinct()
    )
    return diff.reconcile(c.select("hash").distinct(), local, remote)


@check(
    "run_counters",
    sql("""
, store AS (SELECT md5(text) AS hash, bool_or(lang = 'en') AS local, bool_or(n_chars > 2000) AS remote
            FROM documents GROUP BY 1)
SELECT CASE WHEN NOT local THEN 'missing' WHEN remote THEN 'skipped' ELSE 'upload' END AS status,
       count(*) AS n FROM store GROUP BY 1"""),
)
def run_counters(spark, sf):
    return diff.status_counts(store_reconcile(spark, sf))


# Fixed values of the check: mirrors a service would have configured.
MIRRORS = ["mirror-a.test", "mirror-b.test", "NATION_3"]


@check(
    "endpoint_list",
    sql("""
, cdns AS (
  SELECT s_suppkey AS line_no, n_name || ' ' || s_name || '  ' || n_name AS hosts,
         'tpr/' || r_name AS path, 'tpr/configs/' || s_name AS config_path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
listed AS (
  SELECT host, path, arg_min(config_path, line_no) AS config_path
  FROM (SELECT unnest(string_split(hosts, ' ')) AS host, path, config_path, line_no FROM cdns)
  WHERE host <> '' GROUP BY 1, 2
)
SELECT host, path, config_path, 'listed' AS origin FROM listed
UNION ALL
SELECT m.host, s.path, s.config_path, 'mirror'
FROM (VALUES ('mirror-a.test'), ('mirror-b.test'), ('NATION_3')) m(host),
     (SELECT path, arg_min(config_path, line_no) AS config_path FROM cdns GROUP BY 1) s
WHERE (m.host, s.path) NOT IN (SELECT (host, path) FROM listed)"""),
)
def endpoint_list(spark, sf):
    cdns = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("line_no"),
            F.concat("n_name", F.lit(" "), "s_name", F.lit("  "), "n_name").alias("hosts"),
            F.concat(F.lit("tpr/"), "r_name").alias("path"),
            F.concat(F.lit("tpr/configs/"), "s_name").alias("config_path"),
        )
    )
    return discovery.endpoints(cdns, MIRRORS)


@check(
    "duplicate_scan_drop",
    sql("""
, kept AS (SELECT max(product_id) AS product_id FROM products
           GROUP BY build_id, product, config_build, config_product),
gone AS (SELECT * FROM products WHERE product_id NOT IN (SELECT product_id FROM kept))
SELECT s.product_id, s.state FROM scans s JOIN gone g ON g.product_id = s.product_id
WHERE EXISTS (SELECT 1 FROM products k JOIN scans ks ON ks.product_id = k.product_id
              WHERE k.product_id IN (SELECT product_id FROM kept) AND k.build_id = g.build_id
                AND k.product = g.product AND k.config_build = g.config_build
                AND k.config_product = g.config_product AND ks.state = s.state)"""),
)
def duplicate_scan_drop(spark, sf):
    return discovery.droppable_scans(products(spark, sf), scans(spark, sf).select("product_id", "state"))


@check(
    "source_rebuild",
    sql("""
SELECT k.kept_id, p.config_build, p.config_cdn, p.config_product, k.region AS config_regions,
       min(p.first_seen) AS first_seen
FROM products p JOIN (SELECT max(product_id) AS kept_id, build_id, product, config_build,
                             config_product, region
                      FROM products GROUP BY 2, 3, 4, 5, 6) k
  ON k.build_id = p.build_id AND k.product = p.product AND k.config_build = p.config_build
  AND k.config_product = p.config_product
GROUP BY 1, 2, 3, 4, 5"""),
)
def source_rebuild(spark, sf):
    out = discovery.rebuilt_sources(products(spark, sf))
    return out.withColumn("config_regions", F.array_join("config_regions", " "))


@check(
    "newest_duplicate",
    sql("""
SELECT build_id, product, config_build, config_product, max(product_id) AS product_id
FROM products GROUP BY 1, 2, 3, 4"""),
)
def newest_duplicate(spark, sf):
    return discovery.kept_products(products(spark, sf))


@check(
    "region_consolidation",
    sql("""
SELECT build_id, product, config_build, config_product, max(product_id) AS product_id,
       string_agg(DISTINCT region, ' ' ORDER BY region) AS config_regions
FROM products GROUP BY 1, 2, 3, 4"""),
)
def region_consolidation(spark, sf):
    out = discovery.consolidated_regions(products(spark, sf))
    return out.withColumn("config_regions", F.array_join("config_regions", " "))


@check(
    "index_cardinality",
    sql("""
, raw AS (
  SELECT DISTINCT year(l_shipdate) AS yr, l_partkey AS fdid, l_returnflag FROM lineitem
  WHERE l_returnflag <> 'R'
)
SELECT l.yr AS build_id, l.fdid, r.entries,
       CASE WHEN entries IS NULL THEN 'none' WHEN entries = 1 THEN 'one' ELSE 'several' END AS kind
FROM (SELECT DISTINCT year(l_shipdate) AS yr, l_partkey AS fdid FROM lineitem) l
LEFT JOIN (SELECT yr, fdid, count(*) AS entries FROM raw GROUP BY 1, 2) r
  ON r.yr = l.yr AND r.fdid = l.fdid"""),
)
def index_cardinality(spark, sf):
    shipped = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("build_id"), F.col("l_partkey").alias("fdid"), "l_returnflag"
    )
    index = shipped.where(F.col("l_returnflag") != "R").distinct()
    return resolve.index_cardinality(shipped, index)


@check(
    "first_tile_metadata",
    sql(RESOLVED_SQL + """
SELECT hash, min(layer_type) AS layer_type,
       min(fdid) FILTER (layer_type = first_layer) AS fdid
FROM (SELECT *, min(layer_type) OVER (PARTITION BY hash) AS first_layer FROM resolved
      WHERE hash IS NOT NULL) GROUP BY 1"""),
)
def first_tile_metadata(spark, sf):
    return resolve.first_metadata(resolved(spark, sf))
