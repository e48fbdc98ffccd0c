"""Histories, neighbours, queues, top-k and canonical orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.compositions import LOD_SQL
from atlasledger.checks.derive import (
    build_count,
    builds,
    layers,
    name_facts,
    place,
    products,
    scans,
    sql,
    table,
    tile_sizes,
    tiles,
)
from atlasledger.operators import history, lod, segments, viewport
from atlasledger.operators import scans as scan_ops

CHANGES_SQL = """
, changes AS (
  SELECT map_id, build_id, name FROM (
    SELECT *, lag(name) OVER (PARTITION BY map_id ORDER BY build_id) AS before FROM name_facts
    WHERE name IS NOT NULL)
  WHERE before IS NULL OR before <> name
)
"""


@check("name_changes", sql(CHANGES_SQL + "SELECT map_id, build_id, name FROM changes"))
def name_changes(spark, sf):
    return history.name_changes(name_facts(spark, sf))


@check("name_history_merge", sql(CHANGES_SQL + "SELECT map_id, build_id, name FROM changes"))
def name_history_merge(spark, sf):
    """Name changes of what segments of 1024 builds keep of their facts."""
    return history.name_changes(segments.name_points(name_facts(spark, sf), bits=10))


@check(
    "alias_ranges",
    sql(CHANGES_SQL + """
, ranged AS (SELECT *, lead(build_id) OVER (PARTITION BY map_id ORDER BY build_id) AS until FROM changes),
present AS (SELECT map_id, arg_max(name, build_id) AS name FROM name_facts GROUP BY 1)
SELECT r.map_id, r.name AS alias, r.build_id AS since, r.until
FROM ranged r JOIN present p ON p.map_id = r.map_id WHERE r.name <> p.name"""),
)
def alias_ranges(spark, sf):
    facts = name_facts(spark, sf)
    present = facts.groupBy("map_id").agg(F.max_by("name", "build_id").alias("name"))
    return history.alias_ranges(history.name_changes(facts), present)


@check(
    "name_history_documents",
    sql("""
, f AS (SELECT o_custkey AS map_id, build_id, max(o_orderpriority) AS name
        FROM orders JOIN feed_versions ON order_no = o_orderkey GROUP BY 1, 2),
changes AS (
  SELECT map_id, build_id, name FROM (
    SELECT *, lag(name) OVER (PARTITION BY map_id ORDER BY build_id) AS before FROM f)
  WHERE before IS NULL OR before <> name
)
SELECT map_id, '{' || string_agg('"' || build_id || '":"' || name || '"', ',' ORDER BY build_id) || '}'
         AS name_history
FROM changes GROUP BY 1"""),
)
def name_history_documents(spark, sf):
    """One name per map and build, so a history is as long as the build list at most."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("product_id"), "o_custkey", "o_orderpriority"
    )
    facts = (
        products(spark, sf)
        .join(orders, "product_id")
        .groupBy(F.col("o_custkey").alias("map_id"), "build_id")
        .agg(F.max("o_orderpriority").alias("name"))
    )
    bound = products(spark, sf).select("build_id").distinct().count()
    out = history.name_histories(history.name_changes(facts, bound))
    return out.withColumn("name_history", F.to_json("name_history"))


@check(
    "first_of_version_group",
    sql("""
, marked AS (
  SELECT *, lag(composition_hash) OVER (PARTITION BY map_id, layer_type ORDER BY build_id) AS before
  FROM layers
)
SELECT map_id, layer_type, build_id, composition_hash FROM marked WHERE before IS DISTINCT FROM composition_hash"""),
)
def first_of_version_group(spark, sf):
    grouped = history.version_groups(
        layers(spark, sf), ["map_id", "layer_type"], "composition_hash", build_count(spark, sf)
    )
    return grouped.where("first_of_group").select(
        "map_id", "layer_type", "build_id", "composition_hash"
    )


@check(
    "build_neighbours",
    sql("""
SELECT map_id, build_id, lag(build_id) OVER w AS prev_build_id, lead(build_id) OVER w AS next_build_id
FROM (SELECT DISTINCT map_id, build_id FROM layers) WINDOW w AS (PARTITION BY map_id ORDER BY build_id)"""),
)
def build_neighbours(spark, sf):
    rows = layers(spark, sf).select("map_id", "build_id").distinct()
    return history.neighbours(rows, ["map_id"], "build_id", build_count(spark, sf))


@check(
    "scan_queue_head",
    sql("""
SELECT s.product_id, s.state, s.state <> 'pending' AS is_upgrade, p.build_id, p.first_seen
FROM scans s LEFT JOIN products p ON p.product_id = s.product_id
WHERE state = 'pending' OR (state IN ('full_decrypt', 'partial_decrypt') AND data_version_attempt < 2)
ORDER BY CASE WHEN state = 'pending' THEN 0 ELSE 1 END, first_seen NULLS LAST, s.product_id LIMIT 10"""),
)
def scan_queue_head(spark, sf):
    waiting = scan_ops.eligible_scans(scans(spark, sf), products(spark, sf), 2)
    head = scan_ops.queue_head(waiting, 10)
    return head.select("product_id", "state", "is_upgrade", "build_id", "first_seen")


@check(
    "eligible_scans",
    sql("""
SELECT s.product_id, s.state, s.state <> 'pending' AS is_upgrade, p.build_id
FROM scans s LEFT JOIN products p ON p.product_id = s.product_id
WHERE state = 'pending' OR (state IN ('full_decrypt', 'partial_decrypt') AND data_version_attempt < 2)"""),
)
def eligible_scans(spark, sf):
    waiting = scan_ops.eligible_scans(scans(spark, sf), products(spark, sf), 2)
    return waiting.select("product_id", "state", "is_upgrade", "build_id")


@check(
    "newest_source_per_config",
    sql("""
SELECT product, config_build, max(first_seen) AS first_seen,
       arg_max(product_id, (first_seen, product_id)) AS source_id
FROM products GROUP BY 1, 2"""),
)
def newest_source_per_config(spark, sf):
    by_name = products(spark, sf).select(
        F.col("product").alias("product_id"),
        F.col("product_id").alias("source_id"),
        "config_build",
        "config_cdn",
        "config_product",
        "first_seen",
    )
    return scan_ops.newest_source_per_config(by_name).select(
        F.col("product_id").alias("product"), "config_build", "first_seen", "source_id"
    )


@check(
    "first_last_composition",
    sql("SELECT map_id, min(build_id) AS first_build, max(build_id) AS last_build FROM layers GROUP BY 1"),
)
def first_last_composition(spark, sf):
    return history.first_last_composed(layers(spark, sf))


@check(
    "latest_version",
    sql("""
SELECT map_id, layer_type, max(build_id) AS build_id, arg_max(composition_hash, build_id) AS composition_hash
FROM layers GROUP BY 1, 2"""),
)
def latest_version(spark, sf):
    return history.latest(layers(spark, sf), "composition_hash", ["map_id", "layer_type"])


@check(
    "map_neighbours",
    sql("""
SELECT build_id, map_id, lag(map_id) OVER w AS prev_map_id, lead(map_id) OVER w AS next_map_id
FROM (SELECT DISTINCT map_id, build_id FROM layers) WINDOW w AS (PARTITION BY build_id ORDER BY map_id)"""),
)
def map_neighbours(spark, sf):
    """The maps before and after each map of a build."""
    rows = layers(spark, sf).select("build_id", "map_id").distinct()
    return history.neighbours(rows, ["build_id"], "map_id")


@check(
    "group_neighbours",
    sql("""
, marked AS (
  SELECT map_id, build_id, (lag(composition_hash) OVER w IS DISTINCT FROM composition_hash)::INT AS step
  FROM layers WHERE layer_type = 0 WINDOW w AS (PARTITION BY map_id ORDER BY build_id)
),
firsts AS (SELECT map_id, build_id AS oldest FROM marked WHERE step = 1)
SELECT map_id, oldest, lag(oldest) OVER w AS prev_oldest, lead(oldest) OVER w AS next_oldest
FROM firsts WINDOW w AS (PARTITION BY map_id ORDER BY oldest)"""),
)
def group_neighbours(spark, sf):
    """The version groups before and after each group of a map's minimap layer."""
    bound = build_count(spark, sf)
    rows = layers(spark, sf).where(F.col("layer_type") == 0)
    grouped = history.version_groups(rows, ["map_id"], "composition_hash", bound)
    ranges = history.group_ranges(grouped, ["map_id"]).select("map_id", "oldest")
    return history.neighbours(ranges, ["map_id"], "oldest", bound)


# --- viewports --------------------------------------------------------------


def viewports(spark, sf):
    """One viewport per customer, over the map of the part with its number; builds take turns."""
    at = place(F.col("c_custkey"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("view_id"),
        (F.col("c_custkey") % build_count(spark, sf)).cast("int").alias("b"),
        at["map_id"].alias("map_id"),
        (at["x"] + 0.5).alias("center_x"),
        (at["y"] + 0.25).alias("center_y"),
        (F.lit(1.0) + F.col("c_nationkey") % 5).alias("zoom"),
        F.lit(2048).alias("width"),
        F.lit(1024).alias("height"),
    )


VIEW_SQL = """
, views AS (
  SELECT *, greatest(0, least(6, greatest(0, floor(log2(zoom))::INT))) AS level,
         floor(center_x - 2048 / (512.0 / zoom) / 2)::INT AS min_x,
         ceil(center_x + 2048 / (512.0 / zoom) / 2)::INT AS max_x,
         floor(center_y - 1024 / (512.0 / zoom) / 2)::INT AS min_y,
         ceil(center_y + 1024 / (512.0 / zoom) / 2)::INT AS max_y
  FROM (SELECT c_custkey AS view_id, (c_custkey % (SELECT count(*) FROM builds))::INT AS b, c_custkey // 256 AS map_id, 24 + c_custkey % 16 + 0.5 AS center_x,
               24 + (c_custkey // 16) % 16 + 0.25 AS center_y, 1.0 + c_nationkey % 5 AS zoom
        FROM customer)
)
"""


@check(
    "viewport_bounds",
    sql(VIEW_SQL + "SELECT view_id, level, min_x, max_x, min_y, max_y FROM views"),
)
def viewport_bounds(spark, sf):
    views = viewport.with_view(viewports(spark, sf), F.lit(512))
    return views.select("view_id", "level", "min_x", "max_x", "min_y", "max_y")


def all_cells(spark, sf):
    """Pyramids of every build, level 0 included, as build, map, level, x, y."""
    t = tiles(spark, sf).where(F.col("hash").isNotNull())
    cells = lod.lod_cells(t, ["b", "map_id"])
    return t.select("b", "map_id", F.lit(0).alias("level"), "x", "y", "hash").unionByName(cells)


CELLS_SQL = """
, cell_list AS (
  SELECT DISTINCT b, map_id, level, (x >> level) << level AS x, (y >> level) << level AS y
  FROM (SELECT * FROM tiles WHERE hash IS NOT NULL), range(0, 7) t(level)
),
shown AS (
  SELECT v.view_id, v.b, v.map_id, v.level, c.x, c.y,
         greatest(0, 1000 - sqrt(pow(c.x + (1 << v.level) / 2.0 - center_x, 2)
                                 + pow(c.y + (1 << v.level) / 2.0 - center_y, 2)) * 10)
         + CASE WHEN v.level = 5 THEN 50000 ELSE (6 - v.level) * 1000 END AS priority
  FROM views v JOIN cell_list c ON c.b = v.b AND c.map_id = v.map_id AND c.level = v.level
    AND NOT (c.x + (1 << v.level) <= min_x OR c.x >= max_x
             OR c.y + (1 << v.level) <= min_y OR c.y >= max_y)
)
"""


@check(
    "viewport_tiles",
    sql(VIEW_SQL + CELLS_SQL + """
SELECT view_id, b, map_id, level, x, y, round(priority, 4) AS priority FROM shown"""),
)
def viewport_tiles(spark, sf):
    views = viewport.with_view(viewports(spark, sf), F.lit(512))
    shown = viewport.visible_tiles(views, all_cells(spark, sf), keys=("b", "map_id"))
    return shown.select(
        "view_id", "b", "map_id", "level", "x", "y", F.round("priority", 4).alias("priority")
    )


@check(
    "tile_load_order",
    sql(VIEW_SQL + CELLS_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY round(priority, 6) DESC, x, y) AS rank
  FROM shown
)
SELECT view_id, rank, x, y FROM ranked WHERE rank <= 8"""),
)
def tile_load_order(spark, sf):
    views = viewport.with_view(viewports(spark, sf), F.lit(512))
    shown = viewport.visible_tiles(views, all_cells(spark, sf), keys=("b", "map_id"))
    shown = shown.withColumn("priority", F.round("priority", 6))
    return viewport.load_order(shown, 8).select("view_id", "rank", "x", "y")


@check(
    "tile_in_viewport",
    sql(VIEW_SQL + """
SELECT view_id, level,
       NOT (center_x + 3 + (1 << level) <= min_x OR center_x + 3 >= max_x
            OR center_y + 3 + (1 << level) <= min_y OR center_y + 3 >= max_y) AS visible
FROM views"""),
)
def tile_in_viewport(spark, sf):
    views = viewport.with_view(viewports(spark, sf), F.lit(512))
    bounds = {k: F.col(k) for k in ("min_x", "max_x", "min_y", "max_y")}
    inside = viewport.in_bounds(
        F.col("level"), F.col("center_x") + 3, F.col("center_y") + 3, bounds
    )
    return views.select("view_id", "level", inside.alias("visible"))


@check(
    "canonical_orders",
    sql("""
SELECT map_id, build_id, x, y, hash FROM tiles WHERE hash IS NOT NULL
ORDER BY map_id, build_id, x, y"""),
)
def canonical_orders(spark, sf):
    held = tiles(spark, sf).where(F.col("hash").isNotNull())
    return held.select("map_id", "build_id", "x", "y", "hash").orderBy(
        "map_id", "build_id", "x", "y"
    )


# --- sets -------------------------------------------------------------------


@check(
    "hash_union",
    sql(LOD_SQL + """
SELECT hash FROM tiles WHERE hash IS NOT NULL UNION SELECT hash FROM lod"""),
)
def hash_union(spark, sf):
    t = tiles(spark, sf)
    own = t.where(F.col("hash").isNotNull()).select("hash")
    return own.union(lod.lod_cells(t, ["build_id", "map_id"]).select("hash")).distinct()


@check(
    "work_list_by_level",
    sql(LOD_SQL + """
, work AS (SELECT hash FROM tile_sizes WHERE tile_size = 256 UNION SELECT hash FROM lod WHERE hash < '8')
SELECT hash, 0 AS level FROM (SELECT hash FROM work INTERSECT SELECT hash FROM tiles)
UNION ALL
SELECT DISTINCT hash, level FROM lod WHERE hash IN (SELECT hash FROM work)"""),
)
def work_list_by_level(spark, sf):
    t = tiles(spark, sf)
    cells = lod.lod_cells(t, ["build_id", "map_id"]).select("hash", "level").distinct()
    small = tile_sizes(spark, sf).where(F.col("tile_size") == 256).select("hash")
    work = small.union(cells.where(F.col("hash") < "8").select("hash")).distinct()
    first = work.intersect(t.select("hash")).withColumn("level", F.lit(0))
    return first.unionByName(cells.join(work, "hash", "left_semi"))


@check(
    "newly_available",
    sql("""
SELECT hash FROM tiles WHERE hash IS NOT NULL EXCEPT SELECT hash FROM tiles WHERE cdn_missing"""),
)
def newly_available(spark, sf):
    t = tiles(spark, sf).where(F.col("hash").isNotNull())
    return t.select("hash").subtract(t.where("cdn_missing").select("hash"))
